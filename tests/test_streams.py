"""Admission and job state over several micro-batches, one key holding a third of the rows."""

from pyspark.sql import functions as F

from lexquarry.operators.jobs import job_states
from lexquarry.streaming.batched import AdmitBatches, JobStateBatches, run_batches


def split(spark, rows, schema, folder, parts=3):
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def plain_admission(rows, limit, window):
    held, out = {}, {}
    for i, user, second in rows:
        mine = [t for t in held.get(user, []) if t > second - window]
        out[i] = len(mine) < limit
        held[user] = mine + [second] if out[i] else mine
    return out


def test_admission_over_batches_equals_one_pass_and_survives_a_repeat(spark, tmp_path):
    rows = [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"u{i % 5}", i // 4) for i in range(240)]
    asked = split(spark, rows, "id long, user string, second long", tmp_path / "in").select("id", "user", F.timestamp_seconds("second").alias("at"))
    step = AdmitBatches(str(tmp_path / "s"), "user", "at", "id", limit=3, window_seconds=10, n_buckets=4)
    run_batches(asked, str(tmp_path / "s"), step)
    got = {r.id: r.is_allowed for r in step.decisions(spark).collect()}
    assert got == plain_admission(rows, 3, 10)
    # the last batch comes again after its state was published
    again = spark.createDataFrame(rows[160:], "id long, user string, second long").select("id", "user", F.timestamp_seconds("second").alias("at"))
    step(again, 2)
    assert {r.id: r.is_allowed for r in step.decisions(spark).collect()} == got


def test_a_late_request_counts_when_it_arrives(spark, tmp_path):
    step = AdmitBatches(str(tmp_path / "s"), "user", "at", "id", limit=2, window_seconds=10, n_buckets=4)
    for number, rows in enumerate([[(1, "a", 100), (2, "a", 101)], [(3, "a", 50), (4, "b", 50), (5, "a", None)], [(6, "a", 111)]]):
        step(spark.createDataFrame(rows, "id long, user string, second long").select("id", "user", F.timestamp_seconds("second").alias("at")), number)
    assert {r.id: r.is_allowed for r in step.decisions(spark).collect()} == {1: True, 2: True, 3: False, 4: True, 5: None, 6: True}


def test_job_states_over_batches_equal_the_batch_result(spark, tmp_path):
    kinds = ["update", "update", "cancel", "finalize", "update"]
    rows = [("hot" if i % 3 == 0 else None if i % 11 == 0 else f"j{i % 40}", i, "update" if i % 3 == 0 and i < 290 else kinds[i * 7 % 5],
             [None, "PROCESSING", "PENDING", "FAILED"][0 if i % 13 else i % 4], i if i % 4 == 0 else None, f"s{i}" if i % 5 == 0 else None) for i in range(300)]
    schema = "job_id string, seq long, kind string, status string, progress int, stage string"
    step = JobStateBatches(str(tmp_path / "s"), n_buckets=4)
    run_batches(split(spark, rows, schema, tmp_path / "in"), str(tmp_path / "s"), step)
    want = job_states(spark.createDataFrame(rows, schema)).select("job_id", "status", "progress", "stage", "last_seq")
    key = str
    assert sorted(map(tuple, step.states(spark).select(want.columns).collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
