"""Reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexquarry.operators.topk import top_k

MISSING_RANK = 9999


def fuse(dense: DataFrame, sparse: DataFrame, query: str, doc: str, k: int = 60, top: int | None = 25,
         by: list[str] | None = None) -> DataFrame:
    """Merge two ranked lists: sum of 1/(k+rank), one shuffle for both sides.

    Order: score, then the better of the two ranks, then id.  Output scores are
    rounded to six digits.
    """
    merged = _merge(dense, sparse, [*(by or []), query, doc], k)
    order = [F.round("rrf", 12).desc(),
             F.least(F.coalesce("dense_rank", F.lit(MISSING_RANK)), F.coalesce("bm25_rank", F.lit(MISSING_RANK))).asc(),
             F.col(doc).asc()]
    ranked = top_k(merged, [*(by or []), query], order, top)
    return ranked.withColumn("score", F.round("rrf", 6)).drop("rrf")


def fuse_user(dense: DataFrame, sparse: DataFrame, query: str, doc: str, k: int = 60, top: int = 10,
              by: list[str] | None = None) -> DataFrame:
    """Variant for user documents: equal scores keep dense hits first, then lexical ones."""
    merged = _merge(dense, sparse, [*(by or []), query, doc], k)
    order = [F.round("rrf", 12).desc(), F.col("dense_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last()]
    return top_k(merged, [*(by or []), query], order, top).withColumnRenamed("rrf", "score")


def _merge(dense: DataFrame, sparse: DataFrame, keys: list[str], k: int) -> DataFrame:
    none = F.lit(None)
    left = dense.select(*keys, "rank", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"),
                        none.cast("int").alias("bm25_rank"), none.cast("double").alias("bm25_score"))
    right = sparse.select(*keys, "rank", none.cast("int").alias("dense_rank"),
                          none.cast("double").alias("dense_score"),
                          F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    return left.unionByName(right).groupBy(*keys).agg(
        F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("rrf"),
        *[F.max(c).alias(c) for c in ("dense_rank", "dense_score", "bm25_rank", "bm25_score")])
