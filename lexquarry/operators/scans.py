"""Ordered scans that stay parallel inside one large group.

A plain window puts a whole group into one task.  Here rows carry a ``block``
(a page, or a run of positions): the scan runs inside each (group, block), the
blocks' totals are scanned in runs of ``FAN`` blocks, the totals of the runs per
group, and the levels are joined back on the keys they are partitioned by.  A
task holds one block, one run of blocks, or one row per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from lexquarry.session import reliable_checkpoint

FIRST_TO_HERE = (W.unboundedPreceding, W.currentRow)
BEFORE_HERE = (W.unboundedPreceding, -1)


def running(
    df: DataFrame,
    group: list[str],
    block: str,
    order: list[str],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
) -> DataFrame:
    """Add inclusive running sums and last non-null values in (block, order) order.

    The totals of the blocks, one narrow row each, are stored, as they are read twice; rows are computed for them, and once more.
    """
    sums, lasts = sums or {}, lasts or {}
    keys = [*group, block]
    for name, value in {**sums, **lasts}.items():
        df = df.withColumn(f"_v_{name}", value)
    inner = W.partitionBy(*keys).orderBy(*order).rowsBetween(*FIRST_TO_HERE)
    inside = df
    for name in sums:
        inside = inside.withColumn(f"_in_{name}", F.sum(f"_v_{name}").over(inner))
    for name in lasts:
        inside = inside.withColumn(f"_in_{name}", F.last(f"_v_{name}", ignorenulls=True).over(inner))

    position = F.struct(*order)
    totals = df.groupBy(*keys).agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max_by(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), position)).alias(f"_t_{n}")
          for n in lasts],
    )
    carried = _carried(reliable_checkpoint(totals), group, block, list(sums), list(lasts))
    out = inside.join(carried, keys, "left")
    for name in sums:
        out = out.withColumn(name, F.coalesce(F.col(f"_c_{name}"), F.lit(0)) + F.col(f"_in_{name}"))
    for name in lasts:
        out = out.withColumn(name, F.coalesce(F.col(f"_in_{name}"), F.col(f"_c_{name}")))
    return out.drop(*[f"{p}{n}" for n in [*sums, *lasts] for p in ("_v_", "_in_", "_c_")])


#: Blocks whose totals one task scans.
FAN = 4096


def _carried(totals: DataFrame, group: list[str], block: str, sums: list[str], lasts: list[str]) -> DataFrame:
    """Totals ``_t_`` of all earlier blocks of the group, as ``_c_``."""
    names = [*sums, *lasts]
    whole = isinstance(totals.schema[block].dataType, T.IntegralType)
    runs = totals.withColumn("_run", F.floor(F.col(block) / FAN) if whole else F.lit(0))

    def before(n: str, value: str, window) -> Column:
        return F.sum(value).over(window) if n in sums else F.last(value, ignorenulls=True).over(window)

    inner = W.partitionBy(*group, "_run").orderBy(block).rowsBetween(*BEFORE_HERE)
    near = runs.select(*group, block, "_run", *[before(n, f"_t_{n}", inner).alias(f"_n_{n}") for n in names])
    position = F.col(block)
    of_run = runs.groupBy(*group, "_run").agg(*[
        (F.sum(f"_t_{n}") if n in sums else F.max_by(f"_t_{n}", F.when(F.col(f"_t_{n}").isNotNull(), position))).alias(f"_r_{n}")
        for n in names])
    outer = W.partitionBy(*group).orderBy("_run").rowsBetween(*BEFORE_HERE)
    far = of_run.select(
        *[F.col(g).alias(f"_g_{g}") for g in group], F.col("_run").alias("_of"), *[before(n, f"_r_{n}", outer).alias(f"_f_{n}") for n in names])
    same = F.col("_run") == F.col("_of")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = near.join(far, same, "left")
    added = [(F.coalesce(f"_n_{n}", F.lit(0)) + F.coalesce(f"_f_{n}", F.lit(0))).alias(f"_c_{n}") for n in sums]
    return joined.select(*group, block, *added, *[F.coalesce(f"_n_{n}", f"_f_{n}").alias(f"_c_{n}") for n in lasts])


def neighbours(
    df: DataFrame, group: list[str], block: str, order: list[str], columns: dict[str, tuple[str, int]]
) -> DataFrame:
    """Add ``lag`` (negative) or ``lead`` (positive) values within a block.

    ``columns`` maps a new name to (column, distance).
    """
    w = W.partitionBy(*group, block).orderBy(*order)
    for name, (column, distance) in columns.items():
        value = F.lead(column, distance) if distance > 0 else F.lag(column, -distance)
        df = df.withColumn(name, value.over(w))
    return df


def occurrence(df: DataFrame, key: list[str], block: str, order: list[str], name: str) -> DataFrame:
    """Running number of a row among those of its key, from 1."""
    return running(df, key, block, order, sums={name: F.lit(1)})
