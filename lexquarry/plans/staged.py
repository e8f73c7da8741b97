"""Staged ingestion of uploads: micro-batches, a look for cancellations before every stage, compensation of cancelled jobs.

A batch passes the stages of ``ingest.STAGES``.  Before each of them the cancel requests are read anew; jobs named there leave the batch
and take no part in what follows.  A stage's output is stored, and the next one reads it.  Vectors are laid over those of the store in
stage ``index``; before ``complete`` the chunks of every cancelled job of the batch are deleted again, also those that an earlier
attempt at the same batch had written.  A job is final with the event that is written last: a request that is first seen after that
changes nothing.

Everything is written by batch and step, so a repeated batch replaces its own output.  Vectors of a document that another job of
the batch still ingests stay.

Defined results: a job without any text is FAILED at ``extract``; a request for an unknown job is ignored; a null job id is a job like
any other, but nobody can cancel it; an empty batch writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexquarry.config import EngineConfig
from lexquarry.functions.ids import user_point_id
from lexquarry.functions.text import strip
from lexquarry.operators.chunking import chunk_pages
from lexquarry.plans.ingest import STAGES, Embedding
from lexquarry.sizing import join_bounded, union_all
from lexquarry.sources import buckets

JOB = ["job_id", "user_id", "document_id"]
KEY = ["user_id", "document_id", "chunk_id"]
EVENT = "job_id string, seq bigint, kind string, status string, progress int, stage string"


@dataclass(frozen=True)
class StagedIngest:
    """``steps`` of one ingestion stream (``streaming.jobs.ingest_stream``).

    ``folder``: shared folder for events, stage outputs and the vector store.  ``requests(batch, stage)``: the cancel requests
    (job_id) known at that moment; it is called before every stage and has to read them anew.
    """

    folder: str
    model: Embedding
    requests: Callable[[int, str], DataFrame]
    config: EngineConfig = field(default_factory=EngineConfig)
    n_buckets: int = buckets.BUCKETS

    @property
    def store(self) -> str:
        return f"{self.folder}/vectors"

    def _kept(self, df: DataFrame, number: int, name: str) -> DataFrame:
        path = f"{self.folder}/work/{name}/batch={number}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def _note(self, jobs: DataFrame, number: int, step: int, kind: str, status: str | None, progress: int | None, stage: str) -> None:
        values = {"kind": kind, "status": status, "progress": progress, "stage": stage}
        fields = {c: t for c, t in (x.split(" ") for x in EVENT.split(", "))}
        jobs.select(F.col("job_id").cast("string").alias("job_id"), F.lit(step).cast("bigint").alias("step"), *(
            F.lit(v).cast(fields[c]).alias(c) for c, v in values.items())).write.mode("overwrite").parquet(
            f"{self.folder}/events/batch={number}/part={step}-{kind}-{status or 'none'}")

    def _checked(self, jobs: DataFrame, number: int, step: int, stage: str) -> tuple[DataFrame, DataFrame]:
        """Jobs that go on, and those that are cancelled now."""
        asked = self.requests(number, stage).select("job_id").where(F.col("job_id").isNotNull()).distinct().withColumn("_asked", F.lit(True))
        seen = self._kept(join_bounded(jobs, asked, ["job_id"], "left").select(*JOB, F.coalesce("_asked", F.lit(False)).alias("cancelled")),
                          number, f"before-{stage}")
        gone = seen.where("cancelled").select(*JOB)
        self._note(gone, number, step, "cancel", None, None, "cancelled")
        return seen.where("NOT cancelled").select(*JOB), gone

    def _of(self, rows: DataFrame, jobs: DataFrame) -> DataFrame:
        """Rows of the jobs; a null id meets itself."""
        ids = jobs.select(F.struct("job_id").alias("_job")).distinct()
        return join_bounded(rows.withColumn("_job", F.struct("job_id")), ids, ["_job"], "left_semi").drop("_job")

    def _without(self, rows: DataFrame, gone: list[DataFrame]) -> DataFrame:
        """Rows of other jobs than those that are cancelled, which are few; a null id is never cancelled."""
        ids = union_all(gone).select("job_id").distinct()
        return join_bounded(rows, ids, ["job_id"], "left_anti")

    def _chunks(self, pages: DataFrame) -> DataFrame:
        c = self.config
        return chunk_pages(pages, c.chunk_target_chars, c.chunk_overlap_chars, c.chunk_min_chars)

    def __call__(self, batch: DataFrame, number: int) -> None:
        """``batch``: job_id, user_id, document_id, page_number, text and columns to carry along."""
        pages = self._kept(batch, number, "received")
        if pages.isEmpty():
            return
        alive = pages.select(*JOB).distinct()
        data, lost = pages, []
        for i, (stage, progress) in enumerate(STAGES):
            alive, gone = self._checked(alive, number, 2 * i, stage)
            lost.append(gone)
            if stage == "extract":
                # the verdicts are stored; the pages are, since they were received
                full = F.length(strip(F.coalesce(F.col("text"), F.lit("")))) > 0
                jobs = self._kept(self._without(pages, lost).groupBy(*JOB).agg(F.bool_or(full).alias("_full")), number, stage)
                self._note(jobs.where("NOT _full"), number, 2 * i + 1, "update", "FAILED", None, "failed")
                data, alive = pages.where(full), jobs.where("_full").select(*JOB)
            elif stage == "chunk":
                data = self._kept(self._chunks(self._without(data, lost)), number, stage)
            elif stage == "embed":
                data = self._kept(self._without(data, lost).withColumns({
                    "embedding": self.model.documents(F.col("text")),
                    "point_id": user_point_id(F.col("user_id"), F.col("document_id"), F.col("chunk_id"))}), number, stage)
            elif stage == "index":
                buckets.upsert(self._without(data, lost), self.store, KEY, buckets=self.n_buckets)
            else:
                self.compensate(pages, lost, alive)
            last = stage == STAGES[-1][0]
            self._note(alive, number, 2 * i + 1, "finalize" if last else "update", None if last else "PROCESSING", progress, stage)

    def compensate(self, pages: DataFrame, lost: list[DataFrame], alive: DataFrame) -> None:
        """Delete the chunks of cancelled jobs; their keys follow from the pages."""
        doomed = self._of(pages, union_all(lost))
        doomed = join_bounded(doomed, alive.select("user_id", "document_id").distinct(), ["user_id", "document_id"], "left_anti")
        if buckets.manifest(pages.sparkSession, self.store) is not None and not doomed.isEmpty():
            buckets.delete(self._chunks(doomed).select(*KEY), self.store)

    def events(self, spark: SparkSession) -> DataFrame:
        """Events of all batches in order, as ``operators.jobs.job_states`` takes them."""
        rows = spark.read.schema(EVENT.replace("seq bigint", "step bigint") + ", batch bigint").option(
            "recursiveFileLookup", "false").option("basePath", f"{self.folder}/events").parquet(f"{self.folder}/events")
        return rows.withColumn("seq", F.col("batch") * (2 * len(STAGES)) + F.col("step")).select(
            *(x.split(" ")[0] for x in EVENT.split(", ")))

    def vectors(self, spark: SparkSession) -> DataFrame | None:
        """The stored chunks with their vectors; none where no batch reached the store."""
        return None if buckets.manifest(spark, self.store) is None else buckets.read(spark, self.store)
