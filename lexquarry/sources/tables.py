"""Reader of the test tables, with their declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

# Tables whose rows cost much work each.
TEXT_TABLES = ["documents", "pages"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows) if name in TEXT_TABLES else rows


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out when their scan has fewer splits than the cluster has cores; files of one row group cannot be split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
