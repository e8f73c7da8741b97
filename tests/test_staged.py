"""Staged ingestion: cancellation between stages, repeated batches, shared documents."""

from pyspark.sql import functions as F

from lexquarry.config import EngineConfig
from lexquarry.models.embedding import HashedEmbedding
from lexquarry.operators.jobs import job_states
from lexquarry.plans.ingest import STAGES
from lexquarry.plans.staged import StagedIngest
from lexquarry.streaming.jobs import ingest_stream

SCHEMA = "job_id string, user_id string, document_id string, page_number bigint, text string"
TEXT = "Clause one of the deed.\n\nClause two of the deed."
ORDER = [s for s, _ in STAGES]


def staged(spark, tmp_path, stops):
    """``stops``: job to the stage before which its request arrives."""
    def requests(number, stage):
        now = [(j,) for j, s in stops.items() if ORDER.index(s) <= ORDER.index(stage)]
        return spark.createDataFrame(now, "job_id string")

    config = EngineConfig(embedding_dim=8)
    return StagedIngest(str(tmp_path / "work"), HashedEmbedding(config), requests, config, n_buckets=4)


def outcome(spark, job):
    states = {r["job_id"]: (r["status"], r["progress"], r["stage"]) for r in job_states(job.events(spark)).collect()}
    stored = job.vectors(spark)
    return states, [] if stored is None else sorted(r[0] for r in stored.select("document_id").distinct().collect())


def test_jobs_stop_before_any_stage_and_leave_no_vector(spark, tmp_path):
    rows = [(f"j{i}", "u", f"d{i}", 1, TEXT) for i in range(7)] + [("blank", "u", "e", 1, " \n"), ("none", "u", "f", 1, None), (None, "u", "g", 1, TEXT)]
    job = staged(spark, tmp_path, {**{f"j{i}": s for i, s in enumerate(ORDER)}, "nobody": "extract"})
    job(spark.createDataFrame(rows, SCHEMA), 0)
    states, held = outcome(spark, job)
    before = [None, 25, 50, 75, 90]
    assert [states[f"j{i}"] for i in range(5)] == [("CANCELLED", p, "cancelled") for p in before]
    assert states["j5"] == states["j6"] == states[None] == ("READY", 100, "complete")
    assert states["blank"] == states["none"] == ("FAILED", None, "failed")
    assert held == ["d5", "d6", "g"]


def test_a_batch_repeated_after_a_cancel_removes_what_the_first_attempt_wrote(spark, tmp_path):
    rows = spark.createDataFrame([("a", "u", "d1", 1, TEXT), ("b", "u", "d2", 1, TEXT)], SCHEMA)
    stops = {}
    job = staged(spark, tmp_path, stops)
    job(rows, 3)
    assert outcome(spark, job)[1] == ["d1", "d2"]
    stops["a"] = "chunk"
    job(rows, 3)
    states, held = outcome(spark, job)
    assert states == {"a": ("CANCELLED", 25, "cancelled"), "b": ("READY", 100, "complete")}
    assert held == ["d2"]


def test_a_document_of_another_living_job_keeps_its_vectors(spark, tmp_path):
    rows = spark.createDataFrame([("a", "u", "d", 1, TEXT), ("b", "u", "d", 1, TEXT)], SCHEMA)
    job = staged(spark, tmp_path, {"a": "complete"})
    job(rows, 0)
    assert outcome(spark, job)[1] == ["d"]


def test_an_empty_batch_and_a_stream_of_three(spark, tmp_path):
    job = staged(spark, tmp_path, {"j1": "index", "j2": "extract"})
    job(spark.createDataFrame([], SCHEMA), 0)
    assert job.vectors(spark) is None
    source = tmp_path / "in"
    for i in range(3):
        spark.createDataFrame([(f"j{i}", "u", f"d{i}", p, TEXT) for p in (1, 2)], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    ingest_stream(stream, str(tmp_path / "s"), job)
    states, held = outcome(spark, job)
    assert {k: v[0] for k, v in states.items()} == {"j0": "READY", "j1": "CANCELLED", "j2": "CANCELLED"}
    assert held == ["d0"]
    assert job.events(spark).where("kind = 'finalize'").agg(F.count("*")).first()[0] == 1
