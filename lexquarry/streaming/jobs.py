"""Counters and ingestion as Structured Streaming queries; admission and job state are in ``batched``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def counter_stream(rows: DataFrame, labels: list[str], seconds: str) -> DataFrame:
    """Running counters; the state is one row per label tuple."""
    return rows.groupBy(*labels).agg(F.count(F.lit(1)).alias("total"), F.sum(seconds).alias("duration_sum"))


def run_to_folder(stream: DataFrame, folder: str, mode: str = "append") -> None:
    """Process what is available, write it as parquet, and stop.

    ``append`` adds files with exactly-once commits; ``complete`` and ``update``
    write every micro-batch to a folder of its own, and ``latest`` reads the state they leave.
    """
    if mode == "append":
        writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out")
    else:
        def save(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        writer = stream.writeStream.outputMode(mode).foreachBatch(save)
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, folder: str, keys: list[str] | None = None, order: str | None = None) -> DataFrame:
    """State after the last micro-batch that ``run_to_folder`` wrote.

    In ``complete`` mode that is the last batch.  In ``update`` mode give the ``keys``: their last row by batch (then ``order``) counts.
    """
    rows = spark.read.parquet(f"{folder}/out")
    if keys is None:
        return rows.join(rows.agg(F.max("batch").alias("batch")), "batch", "left_semi").drop("batch")
    at = F.struct("batch", order) if order else F.col("batch")
    fields = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), at).alias("_last")).select(*keys, "_last.*")


def ingest_stream(uploads: DataFrame, folder: str, steps) -> None:
    """Run the ingestion steps for every micro-batch of uploads and stop.

    ``steps(batch, number)`` writes by batch number, so a repeated batch
    replaces its own output.
    """
    uploads.writeStream.foreachBatch(steps).option("checkpointLocation", f"{folder}/checkpoint").trigger(
        availableNow=True).start().awaitTermination()
