"""Stored passages, vectors and index tables.

A store is a folder of numbered batches.  Writing a batch again replaces it, so
a repeated job changes nothing; reading keeps the last row of every key, and a
delete is a row that says so.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lexquarry.operators.lexical import Bm25
from lexquarry.operators.pruned import RANGE_DOCS, block_terms, layout, packed_blocks, posting_blocks, unpacked, write_blocks
from lexquarry.operators.tenancy import latest

LAYOUT = ["chunk_type", "act_short"]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    return next((p for p in paths if p and exists(spark, p)), None)


def write_batch(rows: DataFrame, store: str, batch: int, layout: list[str] | None = None) -> None:
    """Write one batch; ``layout`` columns become folders that scans can skip."""
    marked = rows if "is_deleted" in rows.columns else rows.withColumn("is_deleted", F.lit(False))
    writer = marked.write.mode("overwrite")
    if layout:
        writer = writer.partitionBy(*layout)
    writer.parquet(f"{store}/batch={batch}")


def delete_batch(keys: DataFrame, current: DataFrame, key: list[str], store: str, batch: int,
                 layout: list[str] | None = None) -> None:
    """Write a batch that deletes the stored rows with these keys."""
    doomed = current.join(keys.select(*key).distinct(), key, "left_semi")
    write_batch(doomed.withColumn("is_deleted", F.lit(True)), store, batch, layout)


def read_current(spark: SparkSession, store: str, key: list[str]) -> DataFrame:
    rows = spark.read.option("basePath", store).parquet(f"{store}/batch=*")
    return latest(rows, key, ["batch"]).where(~F.col("is_deleted")).drop("is_deleted", "batch")


def compact(spark: SparkSession, store: str, target: str, key: list[str], layout: list[str] | None = None) -> None:
    """Write the current rows as the first batch of a new store."""
    write_batch(read_current(spark, store, key), target, 0, layout)


def save_index(index: dict[str, DataFrame], folder: str, doc: str, params: Bm25 = Bm25(), range_docs: int = RANGE_DOCS) -> None:
    """Write index tables of ``lexical.build_index`` for searches that skip blocks.

    Texts are cut once, for the rows of ``cut``; postings are stored packed.  The corpus row comes from them and is written before the blocks, as they depend on
    the average length; terms are counted from the blocks that were written.
    """
    spark = index["tokens"].sparkSession
    kind = index["tokens"].schema[doc].dataType
    cut = packed_blocks(index["tokens"], doc, range_docs)
    cut.write.mode("overwrite").parquet(f"{folder}/cut")
    cut = spark.read.schema(cut.schema).parquet(f"{folder}/cut")
    layout(cut, params).coalesce(1).write.mode("overwrite").parquet(f"{folder}/corpus")
    corpus = spark.read.parquet(f"{folder}/corpus")
    blocks = posting_blocks(cut, corpus, params)
    # keeps the columns of an index without a posting
    spark.createDataFrame([], T.StructType([*blocks.schema, T.StructField("id", kind)])).write.mode("overwrite").parquet(f"{folder}/columns")
    write_blocks(blocks, f"{folder}/blocks")
    terms = block_terms(_blocks(spark, folder), corpus, params)
    terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/terms")


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The stored blocks, with lists of their postings for readers that name them."""
    columns = spark.read.parquet(f"{folder}/columns").schema
    stored = T.StructType([f for f in columns if f.name != "id"])
    return unpacked(spark.read.schema(stored).parquet(f"{folder}/blocks"), columns["id"].dataType)


def load_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {"blocks": _blocks(spark, folder), **{name: spark.read.parquet(f"{folder}/{name}") for name in ("terms", "corpus")}}


GOLDEN_SCHEMA = ("id string, type string, query string, expected_act string, expected_sections array<string>, "
                 "should_refuse boolean")
MANIFEST_SCHEMA = (
    "schedule string, forms array<struct<form_number:int,form_id:string,title:string,slug:string,filename:string,"
    "section_references:array<string>,page_start:int,page_end:int,page_count:int,byte_size:bigint,sha256:string,"
    "extraction_confidence:double,needs_review:boolean,provenance:string,raw_text:string>>")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions, one JSON object a line."""
    return spark.read.schema(GOLDEN_SCHEMA).json(path)


def read_manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Form entries of the first manifest that exists; no rows when none does."""
    path = first_existing(spark, paths)
    if path is None:
        return spark.createDataFrame([], MANIFEST_SCHEMA).select(F.explode("forms").alias("f")).select("f.*")
    rows = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path)
    return rows.select(F.explode("forms").alias("f")).select("f.*")


def forms_of_manifest(entries: DataFrame) -> DataFrame:
    """Manifest entries as form rows, missing values filled in."""
    n = F.col("form_number").cast("string")
    empty_text = F.coalesce("title", F.lit(""))
    return entries.select(
        F.coalesce("form_id", F.concat(F.lit("BNSS_FORM_"), F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n))).alias("form_id"),
        "form_number", empty_text.alias("form_title"),
        F.coalesce("section_references", F.array().cast("array<string>")).alias("applicable_sections"),
        F.coalesce("page_start", F.lit(0)).alias("page_start"), F.coalesce("page_end", F.lit(0)).alias("page_end"),
        F.coalesce("raw_text", empty_text).alias("raw_text"),
        F.coalesce("provenance", F.concat(F.lit("[BNSS Second Schedule, Form "), n, F.lit("]"))).alias("provenance"))


def export_forms(texts: DataFrame, manifest: DataFrame, folder: str) -> None:
    """One text file per form and the manifest as JSON lines.

    ``texts``: filename, text.
    """
    texts.select("filename", "text").repartition("filename").write.mode("overwrite").partitionBy("filename").text(f"{folder}/forms")
    manifest.write.mode("overwrite").json(f"{folder}/manifest")


def write_lines(lines: DataFrame, folder: str) -> None:
    """Lines of a metrics exposition or of event frames, in their order."""
    lines.select("line").coalesce(1).write.mode("overwrite").text(folder)


def needs_ingest(spark: SparkSession, store: str, key: list[str], least: int) -> bool:
    """Whether a store still lacks its rows; a bootstrap that finds them does nothing."""
    return not exists(spark, store) or read_current(spark, store, key).limit(least).count() < least


def describe(summary: DataFrame) -> str:
    """A one-row summary as JSON, for a log."""
    return json.dumps(summary.first().asDict(), default=str)
