"""Ingestion jobs as event tables: state, cancellation, lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexquarry.operators.scans import running
from lexquarry.operators.tenancy import require_scope

DEAD = ["CANCELLED", "FAILED"]
TERMINAL = ["READY", "FAILED", "CANCELLED"]
FIELDS = ["progress", "stage", "error", "page_count", "chunk_count"]


def _placed(events: DataFrame, key: str, order: str, block_events: int) -> DataFrame:
    """Events with the status set last before them, as long as the job is alive."""
    e = events.withColumn("_block", F.floor(F.col(order) / block_events))
    sets = F.when(F.col("kind") == "update", F.col("status")).when(F.col("kind") == "finalize", F.lit("READY"))
    e = running(e, [key], "_block", [order], lasts={"_set": sets})
    # a cancel is not itself a setter, so the value up to here is the one before it
    return e.withColumn("_dies", ((F.col("kind") == "update") & F.col("status").isin(DEAD))
                        | ((F.col("kind") == "cancel") & (F.coalesce("_set", F.lit("PENDING")) != "READY"))).drop("_block")


def decided_events(events: DataFrame, key: str = "job_id", order: str = "seq", block_events: int = 65_536) -> DataFrame:
    """Events with ``took_effect``: whether a cancel or finalize was accepted.

    ``events``: job, seq, kind (update, cancel, finalize) and the fields a kind
    sets.  A job that is cancelled or failed stays so; a cancel does nothing to
    a finished job, a finalize nothing to a dead one, and whichever comes first
    wins.
    """
    placed = _placed(events, key, order, block_events)
    death = placed.where("_dies").groupBy(key).agg(F.min(order).alias("_death"))
    out = placed.join(death, key, "left")
    alive = F.col("_death").isNull() | (F.col(order) <= F.col("_death"))
    took = (
        F.when(F.col("kind") == "cancel", F.col("_dies") & alive & (F.col(order) == F.col("_death")))
        .when(F.col("kind") == "finalize", F.col("_death").isNull() | (F.col(order) < F.col("_death"))).otherwise(F.lit(True))
    )
    return out.withColumn("took_effect", took).drop("_set", "_dies")


def job_states(events: DataFrame, key: str = "job_id", order: str = "seq", block_events: int = 65_536) -> DataFrame:
    """Current state of every job.

    Aggregates alone: the first death, the last status that may still be set,
    the last value of every field, so one busy job does not hold up a task.
    """
    decided = decided_events(events, key, order, block_events)
    done, at = F.col("took_effect"), F.col(order)
    after = F.col("_death").isNotNull() & (at >= F.col("_death"))
    status = (
        F.when((F.col("kind") == "update") & F.when(F.col("_death").isNull(), F.lit(True)).otherwise(
            after & F.col("status").isin(DEAD)), F.col("status"))
        .when((F.col("kind") == "finalize") & done & F.col("_death").isNull(), F.lit("READY"))
        .when((F.col("kind") == "cancel") & done, F.lit("CANCELLED"))
    )
    fixed = {
        "progress": F.when((F.col("kind") == "finalize") & done, F.lit(100)),
        "stage": F.when((F.col("kind") == "finalize") & done, F.lit("complete")).when(
            (F.col("kind") == "cancel") & done, F.lit("cancelled")),
    }
    values = {}
    for name in FIELDS:
        if name not in events.columns:
            continue
        own = F.when(done, F.col(name))
        values[name] = F.coalesce(fixed[name], own) if name in fixed else own
    staged = decided.withColumns({"_status": status, **{f"_f_{n}": v for n, v in values.items()}})

    def last(column: str) -> object:
        return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), at))

    return staged.groupBy(key).agg(
        F.coalesce(last("_status"), F.lit("PENDING")).alias("status"), *[last(f"_f_{n}").alias(n) for n in values],
        F.count(F.lit(1)).alias("n_events"), F.max(order).alias("last_seq"))


def find_jobs(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Jobs by job id, else by document id, of their owner only.

    ``jobs``: job_id, document_id, user_id, status; ``wanted``: user_id, target.
    A missing job and a foreign one both come back without a job.
    """
    asked = require_scope(wanted).withColumn("target", F.trim("target"))
    by_job = jobs.select(F.col("job_id").alias("target"), F.struct("job_id", "document_id", "user_id", "status").alias("_j"))
    newest = jobs.groupBy("document_id").agg(
        F.max_by(F.struct("job_id", "document_id", "user_id", "status"), "job_id").alias("_d")).withColumnRenamed("document_id", "target")
    out = asked.join(by_job, "target", "left").join(newest, "target", "left").withColumn("_job", F.coalesce("_j", "_d"))
    mine = F.when(F.col("_job.user_id") == F.col("user_id"), F.col("_job"))
    return out.select("user_id", "target", mine["job_id"].alias("job_id"), mine["document_id"].alias("document_id"),
                      mine["status"].alias("status"))


# What a caller is told about a cancelled job.
CANCEL_MESSAGES = {
    "READY": "Job has already completed and cannot be cancelled.", "FAILED": "Job has already failed.",
    "CANCELLED": "Job is already cancelled.",
}


def cancel(jobs: DataFrame, wanted: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Outcome of cancel requests: status after, message, and whether vectors have to be purged.

    A job is looked for first, then the document registry (document_id,
    user_id, status); a target nobody owns gives no status.
    """
    found = find_jobs(jobs, wanted)
    if registry is not None:
        docs = registry.select("user_id", F.col("document_id").alias("target"), F.col("status").alias("_doc_status"))
        found = found.join(docs, ["user_id", "target"], "left").withColumns({
            "document_id": F.coalesce("document_id", F.when(F.col("_doc_status").isNotNull(), F.col("target"))),
            "status": F.coalesce("status", "_doc_status")}).drop("_doc_status")
    known, over = F.col("status").isNotNull(), F.col("status").isin(TERMINAL)
    message = F.lit("Ingestion job successfully cancelled.")
    for status, text in CANCEL_MESSAGES.items():
        message = F.when(F.col("status") == status, text).otherwise(message)
    return found.select(
        "user_id", "target", "job_id", "document_id", F.when(known, F.when(over, F.col("status")).otherwise("CANCELLED")).alias("status"),
        F.when(known, message).alias("message"), F.coalesce(known & ~over, F.lit(False)).alias("purge"))
