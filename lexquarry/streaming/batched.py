"""Keyed state of a stream in buckets: every micro-batch runs the batch operators, which split hot keys, over state and new rows.

Batch *n* reads version *n* - 1 of the state and publishes version *n*, so a repeated batch starts from the same state and publishes
nothing twice.  Only the buckets of the batch's keys are read and rewritten.  Bound the size of a batch at the source
(``maxFilesPerTrigger``); no task holds the rows of a key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexquarry.operators.admission import MICROS, admit, micros
from lexquarry.operators.jobs import job_states
from lexquarry.sizing import join_bounded
from lexquarry.sources import buckets


def run_batches(stream: DataFrame, folder: str, step) -> None:
    """Process what is available in micro-batches and stop."""
    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(
        availableNow=True).start().awaitTermination()


def _before(spark: SparkSession, store: str, keys: DataFrame, number: int) -> DataFrame | None:
    """State of the keys before batch ``number``; none before the first."""
    if number == 0:
        return None
    if buckets.manifest(spark, store, number - 1) is None:
        raise ValueError(f"{store} has no state of batch {number - 1}")
    return buckets.lookup(spark, store, keys, number - 1)


def _publish(rows: DataFrame, store: str, key: str, number: int, n_buckets: int) -> None:
    if buckets.manifest(rows.sparkSession, store, number) is None:
        buckets.upsert(rows, store, [key], buckets=n_buckets)


@dataclass(frozen=True)
class AdmitBatches:
    """Sliding-window admission.  State of a key: the times of its admitted requests in the last window, at most ``limit``.

    Those are put before the new requests and admitted again, which restores the window.  A request that arrives in a later batch than
    one admitted counts as made no earlier than that.  A null key is a principal of its own; a request without a time has no decision.
    """

    folder: str
    key: str
    time: str
    tie: str
    limit: int = 60
    window_seconds: int = 60
    n_buckets: int = buckets.BUCKETS

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, store = batch.sparkSession, f"{self.folder}/state"
        name = F.coalesce(F.concat(F.lit("k"), F.col(self.key).cast("string")), F.lit(""))
        new = batch.select(name.alias("_principal"), self.key, self.tie, micros(batch, self.time).alias("_made"), F.lit(False).alias("_replayed"))
        held = _before(spark, store, new.select("_principal"), number)
        if held is not None:
            floor = F.when(F.col("_made").isNotNull(), F.greatest("_made", F.array_max("held")))
            new = join_bounded(new, held, ["_principal"], "left").select("_principal", self.key, self.tie, floor.alias("_made"), "_replayed")
            old = held.select("_principal", F.explode("held").alias("_made"), F.lit(True).alias("_replayed"))
            new = new.unionByName(old, allowMissingColumns=True)
        timed = new.withColumn("_at", F.timestamp_micros("_made"))
        path = f"{self.folder}/decided/batch={number}"
        # a replayed request has no tie and so stands before a new one of the same time
        admit(timed, "_principal", "_at", self.tie, self.limit, self.window_seconds).write.mode("overwrite").parquet(path)
        allowed = spark.read.parquet(path).where("is_allowed").select("_principal", "_made")
        last = allowed.groupBy("_principal").agg(F.max("_made").alias("_last"))
        live = join_bounded(allowed, last, ["_principal"]).where(F.col("_made") > F.col("_last") - self.window_seconds * MICROS)
        _publish(live.groupBy("_principal").agg(F.sort_array(F.collect_list("_made")).alias("held")), store, "_principal", number, self.n_buckets)

    def decisions(self, spark: SparkSession) -> DataFrame:
        rows = spark.read.parquet(f"{self.folder}/decided")
        return rows.where("NOT _replayed").select(self.key, self.tie, "is_allowed", "retry_after")


@dataclass(frozen=True)
class JobStateBatches:
    """State of every job: status, progress, stage and the last event.

    A job's state enters a batch as one event before its new ones; those of a later batch count as later, whatever their number.
    """

    folder: str
    key: str = "job_id"
    order: str = "seq"
    n_buckets: int = buckets.BUCKETS

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, store = batch.sparkSession, f"{self.folder}/state"
        events = batch.select(self.key, self.order, "kind", "status", "progress", "stage")
        state = _before(spark, store, events.select(self.key), number)
        if state is not None:
            first = events.groupBy(self.key).agg(F.min(self.order).alias("_first")).withColumnRenamed(self.key, "_of")
            entering = state.join(first, state[self.key].eqNullSafe(first["_of"])).select(
                self.key, (F.col("_first") - 1).alias(self.order), F.lit("update").alias("kind"), "status", "progress", "stage")
            events = events.unionByName(entering)
        now = job_states(events, self.key, self.order)
        _publish(now.select(self.key, "status", "progress", "stage", "last_seq"), store, self.key, number, self.n_buckets)

    def states(self, spark: SparkSession) -> DataFrame:
        return buckets.read(spark, f"{self.folder}/state")
