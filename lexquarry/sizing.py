"""Size checks and skew handling shared by the join-heavy operators."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 200_000
HOT_ROWS = 2_000_000
SALTS = 64


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows.  Reads no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def join_bounded(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join a large ``left`` with a ``right`` that is usually small.

    ``right`` is broadcast only after its row count was checked; beyond the
    bound the join shuffles, and keys that are hot in ``left`` are split.
    """
    if fits(right, max_rows):
        return left.join(F.broadcast(right), on, how)
    return skew_join(left, right, on, how, hot_rows=hot_rows)


def join_shuffled(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join two sides that may both be large: sorted and merged, never collected in the driver.

    Without the hint Spark broadcasts a side whose shuffled files are small; compressed, they are a small part of what the driver would hold.
    """
    return left.join(right.hint("merge"), on, how)


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Shuffled join that spreads every key with more than ``hot_rows`` left rows.

    Hot keys are found with a pre-aggregated count.  Their left rows are dealt
    over ``salts`` numbers by a hash of the row (a retried task deals the same
    way), their right rows are repeated once per number, and every other row
    carries number 0, so only the hot part of ``right`` is repeated.  Rows with a
    null key match nothing, so they never meet the join.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"skew_join cannot split the left side of a {how} join")
    null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in on])
    whole, left = left, left.where(~null_key)
    alone = whole.where(null_key) if how in ("left", "left_anti") else None

    def with_alone(joined: DataFrame) -> DataFrame:
        return joined if alone is None else joined.unionByName(alone, allowMissingColumns=True)

    hot = (
        left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > hot_rows).select(*on, F.lit(True).alias("_hot"))
    )
    found = hot.limit(BROADCAST_ROWS + 1).count()
    if found == 0:
        return with_alone(join_shuffled(left, right, on, how))
    if found <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    dealt = F.pmod(F.xxhash64(*left.columns), F.lit(salts))
    left_s = (
        left.join(hot, on, "left")
        .withColumn("_salt", F.when(F.col("_hot"), dealt).otherwise(F.lit(0)).cast("int")).drop("_hot")
    )
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right_s = right.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return with_alone(join_shuffled(left_s, right_s, [*on, "_salt"], how).drop("_salt"))


def blocks(df: DataFrame, key: str, max_rows: int) -> list[DataFrame]:
    """Split ``df`` by a hash of ``key`` into parts of about ``max_rows`` rows."""
    n = df.count()
    if n <= max_rows:
        return [df]
    parts = ceil(1.25 * n / max_rows)
    return [df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)]


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
