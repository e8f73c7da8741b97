"""Nearest neighbours by a block matrix join of int8 tiles.

Vectors are packed into blocks.  Every query block is sent to each of ``groups`` groups of candidate blocks and meets the blocks there:
the stated queries against all rows, block by block.  In a pair of blocks, vectors rounded to int8 (one step size per vector) give all
inner products of a tile as one product of integer matrices.  With x = x' + e, |x.y - x'.y'| <= |x'||e_y| + |e_x||y|, so each estimate
has an error bound, and a pair is dropped only if its upper bound is below the k-th best lower bound of the tile or the k-th best score
the query has already.  Pairs that survive are recomputed from the original vectors in double precision and merged into one heap of
``k`` per query; heaps of few query blocks are held at a time, and a window merges what tasks return.  The answer is exact.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an id;
vectors meet only vectors of equal length; equal rows among the queries are one query, rows with one id and different vectors are
queries of their own; a query's own id is never its neighbour; ties go to the smaller id; extra columns are not carried.
"""

from __future__ import annotations

import heapq
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lexquarry.llm.shared import reliable_checkpoint

K = 20
QUERY_ROWS = 1024
CANDIDATE_ROWS = 4096
HELD_BLOCKS = 8
PAIRS = 1 << 15


def usable(vector: Column) -> Column:
    """True for vectors of finite numbers, not all zero."""
    finite = F.forall(vector, lambda x: F.coalesce(x.cast("double").between(-1.7976931348623157e308, 1.7976931348623157e308), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Pack (id, vector) into rows of at most ``size`` vectors of one length: dim, ids and values as binary."""

    def run(batches):
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1)
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.diff(vectors.offsets.to_numpy().astype(np.int64)))
            dims = np.diff(np.concatenate([[0], ends]))
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                for lo in range(0, len(mine), size):
                    part = mine[lo:lo + size]
                    values = flat[(ends[part] - dim)[:, None] + np.arange(dim)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(dim)], pa.int32()), pa.array([ids[part].astype("<i8").tobytes()], pa.binary()),
                         pa.array([values.astype("<f8").tobytes()], pa.binary())], names=["dim", "ids", "data"])

    return rows.mapInArrow(run, "dim int, ids binary, data binary")


class Block:
    def __init__(self, dim: int, ids: bytes, data: bytes):
        self.ids = np.frombuffer(ids, "<i8")
        self.exact = np.frombuffer(data, "<f8").reshape(-1, dim)
        # products of int8 numbers add up exactly in 32-bit floats up to this many dimensions
        kind = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64
        largest = np.abs(self.exact).max(1)
        self.step = largest / 127
        whole = np.rint(self.exact / largest[:, None] * 127).astype(np.int8)
        near = whole * self.step[:, None]
        self.whole = whole.astype(kind)
        #: a last share for the rounding of the bound itself
        self.norm = np.sqrt((self.exact**2).sum(1)) * (1 + 1e-9)
        self.near_norm = np.sqrt((near**2).sum(1)) * (1 + 1e-9)
        self.error = np.sqrt(((self.exact - near) ** 2).sum(1)) * (1 + 1e-9) + self.norm * 1e-12


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, components added in order."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


class Heaps:
    """The k best of every query of a block."""

    def __init__(self, queries: Block, k: int):
        self.queries, self.k = queries, k
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in queries.ids]
        self.floor = np.full(len(queries.ids), -np.inf)

    def meet(self, other: Block) -> None:
        q, k = self.queries, self.k
        estimate = (q.whole @ other.whole.T) * q.step[:, None] * other.step[None, :]
        bound = q.near_norm[:, None] * other.error[None, :] + q.error[:, None] * other.norm[None, :]
        own = q.ids[:, None] == other.ids[None, :]
        low = np.where(own, -np.inf, estimate - bound)
        floor = self.floor
        if len(other.ids) > k:
            floor = np.maximum(floor, np.partition(low, len(other.ids) - k, axis=1)[:, len(other.ids) - k])
        row, column = np.nonzero((estimate + bound >= floor[:, None]) & ~own)
        exact = np.concatenate([np.zeros(0), *(
            scores(q.exact[row[s:s + PAIRS]], other.exact[column[s:s + PAIRS]]) for s in range(0, len(row), PAIRS))])
        ids = other.ids[column]
        order = np.lexsort((ids, -exact, row))
        row, exact, ids = row[order], exact[order], ids[order]
        begin = np.searchsorted(row, np.arange(len(q.ids)))
        best = np.arange(len(row)) - begin[row] < k
        for i, score, number in zip(row[best].tolist(), exact[best].tolist(), ids[best].tolist()):
            heap = self.heaps[i]
            if len(heap) < k:
                heapq.heappush(heap, (score, -number))
            else:
                heapq.heappushpop(heap, (score, -number))
        for i in np.unique(row).tolist():
            if len(self.heaps[i]) == k:
                self.floor[i] = self.heaps[i][0][0]

    def rows(self) -> pa.RecordBatch | None:
        out = []
        for i, heap in enumerate(self.heaps):
            row = xxhash.xxh3_64_intdigest(self.queries.exact[i].tobytes()) - (1 << 63)
            out += [(int(self.queries.ids[i]), row, -n, s) for s, n in heap]
        if not out:
            return None
        q, r, v, s = zip(*out)
        return pa.RecordBatch.from_arrays(
            [pa.array(q, pa.int64()), pa.array(r, pa.int64()), pa.array(v, pa.int64()), pa.array(s)],
            names=["query_id", "query_row", "vec_id", "score"])


def nearest(
    queries: DataFrame, candidates: DataFrame, k: int = K, vec_id: str = "vec_id", vector: str = "embedding",
    query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS, groups: int | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` candidates of largest inner product for every query."""
    spark = queries.sparkSession
    groups = groups or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def good(rows):
        return rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(
            F.col("id").isNotNull() & usable(F.col("v")))

    # stored, so that a block keeps its queries if a task runs again
    asked = reliable_checkpoint(blocks(good(queries).distinct(), query_rows)).select(
        "dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.xxhash64("ids", "data").alias("q_block"))
    asked = asked.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    there = blocks(good(candidates), candidate_rows).withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    pairs = there.join(asked, ["g", "dim"]).select("dim", "q_block", "q_ids", "q_data", "ids", "data")

    def tile(batches):
        held: OrderedDict[tuple, Heaps] = OrderedDict()
        for batch in batches:
            for i in range(batch.num_rows):
                dim, number, q_ids, q_data, ids, data = (c[i].as_py() for c in batch.columns)
                heaps = held.get((dim, number))
                if heaps is None:
                    if len(held) == HELD_BLOCKS:
                        _, done = held.popitem(last=False)
                        if (out := done.rows()) is not None:
                            yield out
                    heaps = held[dim, number] = Heaps(Block(dim, q_ids, q_data), k)
                heaps.meet(Block(dim, ids, data))
        for done in held.values():
            if (out := done.rows()) is not None:
                yield out

    found = pairs.mapInArrow(tile, "query_id long, query_row long, vec_id long, score double")
    order = W.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    return nearest(rows.where("vec_id % 20 = 0"), rows)


OP6_SQL = f"""
WITH good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= {K}"""
