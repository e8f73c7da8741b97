"""Checkpoints in the shared folder, ranks inside hot classes, and connected components."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from inspect import signature
from uuid import uuid4

from pyspark.sql import DataFrame, Window as W, functions as F

from lexquarry.session import checkpoint_folder, reliable_checkpoint

MAX_STAR_ROUNDS = 200


#: The struct that carries the columns of ``keep``.
BOX = "_kept"
#: Kept columns that no operator uses inside.
PLAIN = {"doc_id", BOX}


def carries(*results: str) -> Callable:
    """Let ``keep`` of an operator name any columns, also those that it uses inside.

    Such columns travel as one struct.  A column that has the name of a result cannot be carried: a ValueError says so before a job
    runs.  Rows of which only the id is kept are not boxed.
    """
    def around(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        shape = signature(operator)

        @wraps(operator)
        def run(*args, **named) -> DataFrame:
            call = shape.bind(*args, **named)
            docs, keep = call.arguments["docs"], list(dict.fromkeys(call.arguments["keep"]))
            clash = sorted(set(keep) & set(results))
            if clash:
                raise ValueError(f"columns {clash} are results of this operator; rename them or leave them out of keep")
            if set(keep) <= PLAIN:
                return operator(*args, **named)
            call.arguments["docs"] = docs.withColumn(BOX, F.struct(*(docs[c] for c in keep)))
            call.arguments["keep"] = [BOX]
            out = operator(*call.args, **call.kwargs)
            return out.select(*(F.col(BOX).getField(c).alias(c) for c in keep), *(c for c in out.columns if c != BOX))

        return run

    return around


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back: lineage is cut, and columns can be read alone."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, key: str, order: list[str], rank: str, chunks: int | None = None) -> DataFrame:
    """Number the rows of every ``key`` value without gaps from 0, so that no task holds a whole hot value.

    Rows of a value are dealt to ``chunks`` (default: four per shuffle partition) by a hash of ``order``, ranked there, and moved
    by the number of rows in earlier chunks.  Equal rows are interchangeable.
    """
    chunks = chunks or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    counts = dealt.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(F.col(key).alias("_key"), F.col("_chunk").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy(key, "_chunk").orderBy(*order)) - 1
    return (
        dealt.withColumn("_own", own)
        .join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_chunk") == F.col("_at")))
        .withColumn(rank, (F.col("_own") + F.col("_before")).cast("long"))
        .drop("_chunk", "_own", "_key", "_at", "_before"))


def components(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) of every node of the undirected edges ``a``, ``b``.

    Large-star and small-star rounds: every node's neighbours are tied to its smallest one, until nothing changes.  A round is two
    aggregations and two joins on the node; each is checkpointed and only its row count and hash sum reach the driver.  With ``tasks``,
    that many write each exchange, however many partitions a shuffle has: few edges then leave few files.
    """

    def dealt(df: DataFrame) -> DataFrame:
        return df if tasks is None else df.coalesce(tasks)

    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = reliable_checkpoint(dealt(now))
    seen = _print_of(now)
    for _ in range(MAX_STAR_ROUNDS):
        if seen[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = dealt(dealt(large).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        moved = large.join(low, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = dealt(low.select(F.col("k").alias("u"), F.col("m").alias("v")).unionByName(moved)).distinct()
        now, before = reliable_checkpoint(dealt(small)), seen
        seen = _print_of(now)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _print_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


__all__ = ["carries", "components", "ranked", "reliable_checkpoint", "stored"]
