"""Admission, jobs, ordered scans, percentiles and answers."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexquarry.models.generation import CalledProvider
from lexquarry.operators.admission import admit
from lexquarry.operators.evaluation import nearest_rank
from lexquarry.operators.evidence import validate
from lexquarry.operators.jobs import job_states
from lexquarry.operators.scans import running
from lexquarry.plans.answering import answer
from lexquarry.sources import store

START = datetime(2024, 1, 1)


def admit_model(rows, limit, window):
    held, out = {}, {}
    for key, t, i in sorted(rows):
        live = [x for x in held.get(key, []) if x > t - window]
        out[i] = len(live) < limit
        held[key] = live + [t] if out[i] else live
    return out


@pytest.mark.parametrize("limit, window, partitions", [(3, 10, 1), (3, 10, 8), (1, 7, 8), (60, 60, 4)])
def test_admission_of_a_hot_key_over_many_partitions(spark, limit, window, partitions):
    rng = np.random.default_rng(5)
    rows = [(0 if i % 3 else int(rng.integers(1, 5)), int(t), i) for i, t in enumerate(rng.integers(0, 400, 900))]
    df = spark.createDataFrame([(k, START + timedelta(seconds=t), i) for k, t, i in rows], "k int, ts timestamp, i int")
    got = admit(df, "k", "ts", "i", limit, window, partitions).collect()
    want = admit_model(rows, limit, window)
    assert len(got) == len(rows) and all(r["is_allowed"] == want[r["i"]] for r in got)
    assert all(r["retry_after"] >= 1 for r in got if not r["is_allowed"])


def job_model(events):
    status, progress, stage = "PENDING", None, None
    for kind, s, p, g in events:
        if kind == "cancel" and status not in ("READY", "FAILED", "CANCELLED"):
            status, stage = "CANCELLED", "cancelled"
        elif kind == "finalize" and status not in ("CANCELLED", "FAILED"):
            status, progress, stage = "READY", 100, "complete"
        elif kind == "update":
            if s and (status not in ("CANCELLED", "FAILED") or s in ("CANCELLED", "FAILED")):
                status = s
            progress, stage = p if p is not None else progress, g or stage
    return status, progress, stage


def test_job_states_against_model(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for job in range(60):
        events = []
        for seq in range(int(rng.integers(1, 12))):
            kind = ["update", "update", "update", "cancel", "finalize"][rng.integers(5)]
            up = kind == "update"
            e = (kind, [None, "PROCESSING", "FAILED", "READY", "CANCELLED"][rng.integers(5)] if up else None,
                 int(rng.integers(100)) if up and rng.random() < .5 else None, f"s{rng.integers(3)}" if up and rng.random() < .5 else None)
            events.append(e)
            rows.append((f"j{job}", seq, *e))
        want[f"j{job}"] = job_model(events)
    df = spark.createDataFrame(rows, "job_id string, seq long, kind string, status string, progress int, stage string")
    got = {r["job_id"]: (r["status"], r["progress"], r["stage"]) for r in job_states(df, block_events=3).collect()}
    assert got == want


def test_running_over_blocks(spark):
    rows = [("g", b, i, (b * 10 + i) % 3, f"v{b}{i}" if (b + i) % 4 == 0 else None) for b in range(6) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, b int, i int, n int, v string")
    got = running(df, ["g"], "b", ["i"], sums={"s": F.col("n")}, lasts={"l": F.col("v")}).orderBy("b", "i").collect()
    total, last = 0, None
    for r in got:
        total, last = total + r["n"], r["v"] or last
        assert (r["s"], r["l"]) == (total, last)


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_nearest_rank(spark, n):
    values = [float((i * 37) % 101) for i in range(n)]
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    row = nearest_rank(df, "v", {"p50": 0.5, "p95": 0.95}, ["g"]).first()
    assert (row["p50"], row["p95"]) == (sorted(values)[n // 2], sorted(values)[int(0.95 * n)])


@pytest.mark.parametrize("grid, values", [(20, 60), (1000, 10_000)])
def test_nearest_rank_in_rounds(spark, monkeypatch, grid, values):
    """Brackets that are narrowed several times, with values that most rows share, one group with most rows, and an empty group."""
    from lexquarry.operators import evaluation

    monkeypatch.setattr(evaluation, "GRID", grid)
    monkeypatch.setattr(evaluation, "BRACKET_VALUES", values)
    rng = np.random.default_rng(8)
    groups = {
        "hot": [float(x) for x in rng.normal(size=1500)], "shared": [float(i) for i in range(60)] + [500.0] * 900, None: [3.0, 1.0, 2.0],
        "ends": [0.0] * 400 + [float(x) for x in rng.random(200)] + [1.0] * 400, "empty": []}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("empty", None), ("hot", None)]
    ps = {"p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p999": 0.999}
    got = {r.g: r for r in evaluation.nearest_rank(spark.createDataFrame(rows, "g string, v double"), "v", ps, ["g"]).collect()}
    for g, vs in groups.items():
        assert got[g].n == len(vs)
        assert [got[g][n] for n in ps] == ([sorted(vs)[int(len(vs) * p)] for p in ps.values()] if vs else [None] * len(ps)), g


EVIDENCE = [(1, "c1", "Bharatiya Nyaya Sanhita, 2023", "BNS", "VI", "Of offences", "103", "Murder", None, None, "substantive_section",
             "Whoever commits murder shall be punished with death or imprisonment for life, and shall also be liable to fine. (2) A group.", 10, 11, 0.9)]
SCHEMA = ("array<struct<rank:int,chunk_id:string,act:string,act_short:string,chapter:string,chapter_title:string,section_number:string,"
          "section_title:string,subsection:string,clause:string,chunk_type:string,text:string,page_start:int,page_end:int,score:double>>")


@pytest.mark.parametrize("text, valid, reason", [
    ("Murder is punished with death [BNS s.103].", True, None),
    ("Murder is punished under Section 103 of the Bharatiya Nyaya Sanhita.", True, None),
    ("Murder is punished with death [BNSS s.103].", False, "ACT_NOT_RETRIEVED"),
    ("Murder is punished with death [BNS s.104].", False, "SECTION_NOT_RETRIEVED"),
    ("Murder is punished with death [BNS s.103(2)].", True, None),
    ("Murder is punished with death [BNS s.103(9)].", False, "SUBSECTION_NOT_SUPPORTED"),
    ("Murder is punished with death [BNS s.103]. Robbery brings additional punishment of ten years.", False, "UNCITED_CLAIMS"),
    ("Whoever commits murder [BNS s.103] is meant. Imprisonment for life and fine shall also be liable.", True, None),
    ("The punishment is a fine.", False, "NO_CITATIONS"),
    ("Insufficient statutory evidence in the retrieved provisions.", True, None),
    ("", False, "EMPTY_ANSWER"),
])
def test_validation(spark, text, valid, reason):
    df = spark.createDataFrame([(text, EVIDENCE)], f"answer string, documents {SCHEMA}")
    v = validate(df).first()["validation"]
    assert v["is_valid"] == valid, v
    assert reason is None or any(r.startswith(reason) for r in v["reasons"])


def test_answering_tries_once_more_and_never_calls_for_refused(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def call(system, user):
        import uuid
        (log / uuid.uuid4().hex).write_text(user)
        if "<errors>" in user:
            return "Murder is punished with death [BNS s.103].", 5, 5
        return "Murder is punished with death [BNSS s.9].", 5, 5

    rows = [(1, "what of murder", EVIDENCE, False, None), (2, "the moon", None, True, "low_retrieval_confidence")]
    df = spark.createDataFrame(rows, f"query_id int, query_text string, documents {SCHEMA}, is_refused boolean, refusal_reason string")
    got = {r["query_id"]: r for r in answer(df, CalledProvider(call, pause=0)).collect()}
    assert (got[1]["status"], got[1]["attempts"], got[1]["citations"], got[1]["prompt_tokens"]) == ("SUCCESS", 2, ["[BNS s.103]"], 10)
    assert (got[2]["status"], got[2]["answer"], got[2]["attempts"]) == ("REFUSED", None, 0)
    assert len(list(log.iterdir())) == 2


def test_failing_provider_is_retried():
    tries = []

    def call(system, user):
        tries.append(1)
        raise RuntimeError("down")

    assert CalledProvider(call, max_retries=2, pause=0).attempt("s", "u") == (None, None, None, "down") and len(tries) == 3


def test_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("a", 1), ("b", 1)], "chunk_id string, v int")
    store.write_batch(rows, path, 0)
    store.write_batch(spark.createDataFrame([("b", 2), ("c", 2)], "chunk_id string, v int"), path, 1)
    store.write_batch(spark.createDataFrame([("b", 2), ("c", 2)], "chunk_id string, v int"), path, 1)
    now = store.read_current(spark, path, ["chunk_id"])
    assert sorted(map(tuple, now.collect())) == [("a", 1), ("b", 2), ("c", 2)]
    store.delete_batch(spark.createDataFrame([("a",)], "chunk_id string"), now, ["chunk_id"], path, 2)
    assert sorted(r[0] for r in store.read_current(spark, path, ["chunk_id"]).collect()) == ["b", "c"]


def test_admission_keeps_null_keys_and_times(spark):
    from lexquarry.operators.admission import admit

    rows = [(i, None if i % 3 == 0 else 2 ** 60 + i % 3, i * 1_000_000) for i in range(30)] + [(30, 2 ** 60 + 1, None)]
    asked = spark.createDataFrame(rows, "id long, user long, us long").selectExpr("id", "user", "timestamp_micros(us) AS at")
    got = admit(asked, "user", "at", "id", limit=2, window_seconds=10, partitions=4).collect()
    assert sorted(r.id for r in got) == list(range(31))
    assert {r.user for r in got} == {None, 2 ** 60 + 1, 2 ** 60 + 2}
    assert [r.is_allowed for r in got if r.id == 30] == [None]
    for user in {r.user for r in got}:
        held, want = [], []
        for i in [r[0] for r in rows if r[1] == user and r[2] is not None]:
            held = [t for t in held if t > i - 10]
            want.append(len(held) < 2)
            held += [i] if want[-1] else []
        mine = sorted((r for r in got if r.user == user and r.id < 30), key=lambda r: r.id)
        assert [r.is_allowed for r in mine] == want


def test_percentiles_keep_null_labels(spark):
    from lexquarry.operators.evaluation import nearest_rank

    rows = [(None, float(i)) for i in range(10)] + [("a", float(i)) for i in range(5)] + [("b", None)]
    got = {r.label: (r.n, r.p50) for r in nearest_rank(spark.createDataFrame(rows, "label string, v double"), "v", {"p50": 0.5}, ["label"]).collect()}
    assert got == {None: (10, 5.0), "a": (5, 2.0), "b": (0, None)}


def test_budget_counts_short_blocks(spark):
    from pyspark.sql import functions as F

    from lexquarry.operators.evidence import within_budget

    ranked = spark.range(1, 2001).selectExpr("1 AS q", "cast(id AS int) AS rank", "'ab' AS text")
    assert within_budget(ranked, "q", F.col("text"), 4000).count() == 1000


def test_streams_show_the_last_state_of_several_batches(spark, tmp_path):
    from lexquarry.streaming.batched import JobStateBatches, run_batches
    from lexquarry.streaming.jobs import counter_stream, latest, run_to_folder

    source = tmp_path / "in"
    schema = "job_id string, seq long, kind string, status string, progress int, stage string"
    for part in range(3):
        rows = [(f"j{k}", part * 10 + k, "update", "PROCESSING", part, f"s{part}") for k in range(part, 4)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    step = JobStateBatches(str(tmp_path / "a"), n_buckets=4)
    run_batches(stream, str(tmp_path / "a"), step)
    got = {r.job_id: (r.progress, r.stage) for r in step.states(spark).collect()}
    assert got == {"j0": (0, "s0"), "j1": (1, "s1"), "j2": (2, "s2"), "j3": (2, "s2")}
    run_to_folder(counter_stream(stream, ["job_id"], "progress"), str(tmp_path / "b"), "complete")
    assert {r.job_id: r.total for r in latest(spark, str(tmp_path / "b")).collect()} == {"j0": 1, "j1": 2, "j2": 3, "j3": 3}


def test_configurations_have_to_be_named(spark):
    import pytest

    from lexquarry.operators.evaluation import first_hits

    golden = spark.createDataFrame([(1, None, ["1"])], "query_id int, expected_act string, expected_sections array<string>")
    hits = spark.createDataFrame([("c", 1, 1, "BNS", "1")], "config string, query_id int, rank int, act_short string, section_number string")
    with pytest.raises(ValueError):
        first_hits(golden, hits, by=["config"])
    got = first_hits(golden, hits, by=["config"], configs=[("c",), ("d",)]).collect()
    assert {(r.config, r.first_rank) for r in got} == {("c", 1), ("d", 0)}
