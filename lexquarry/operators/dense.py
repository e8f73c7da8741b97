"""Exhaustive vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lexquarry.operators.topk import top_k
from lexquarry.sizing import blocks, union_all

ORDER_DIGITS = 12
BLOCK_ROWS = 4_096


def cosine(a: Column, b: Column) -> Column:
    """Inner product in double precision; equals cosine on unit vectors."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def best_positions(scores: np.ndarray, ids: np.ndarray, k: int, digits: int = ORDER_DIGITS) -> np.ndarray:
    """Positions of the best k scores, ties by id; exact under ties at the cut."""
    key = np.round(scores, digits)
    if len(key) > k:
        cut = np.partition(key, len(key) - k)[len(key) - k]
        keep = np.flatnonzero(key >= cut)
    else:
        keep = np.arange(len(key))
    return keep[np.lexsort((ids[keep], -key[keep]))[:k]]


def dense_top_k(
    passages: DataFrame,
    queries: DataFrame,
    doc: str,
    vector: str,
    query: str,
    query_vector: str,
    k: int,
    where: Column | None = None,
    floor: float | None = None,
    scope: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query, doc, score, rank): best ``k`` passages by inner product.

    ``scope`` names a column of both sides; a query then sees only the passages
    of its own scope.

    Queries are taken in blocks of bounded size.  A block is sent to the tasks
    as one matrix, every task multiplies its own passages with it and keeps
    ``k`` rows per query, and only those rows are shuffled.
    """
    pool = (passages.where(where) if where is not None else passages).select(
        doc, vector, *([scope] if scope else []))
    types = {f.name: f.dataType for f in [pool.schema[doc], queries.schema[query]]}
    schema = T.StructType([T.StructField(query, types[query]), T.StructField(doc, types[doc]),
                           T.StructField("score", T.DoubleType())])
    sc = pool.sparkSession.sparkContext
    parts = []
    asked = queries.select(query, query_vector, *([scope] if scope else []))
    for block in blocks(asked, query, block_rows):
        table = block.toArrow()
        if table.num_rows == 0:
            continue
        of_scope: dict = {}
        for j, s in enumerate(table.column(scope).to_pylist() if scope else [None] * table.num_rows):
            of_scope.setdefault(s, []).append(j)
        shared = sc.broadcast(
            (table.column(query).to_pylist(), _matrix(table.column(query_vector)).T.copy(), of_scope))
        parts.append(pool.mapInArrow(_searcher(shared, query, doc, vector, scope, k, floor), schema))
    if not parts:
        hits = pool.sparkSession.createDataFrame([], schema)
    else:
        hits = union_all(parts)
    order = [F.round("score", ORDER_DIGITS).desc(), F.col(doc).asc()]
    return top_k(hits, [query], order, k)


def _searcher(shared, query: str, doc: str, vector: str, scope: str | None, k: int, floor: float | None):
    def groups(batch: pa.RecordBatch, of_scope: dict) -> Iterator[tuple[list[int], np.ndarray | slice]]:
        """Query positions and the batch rows they may see."""
        if scope is None:
            yield of_scope[None], slice(None)
            return
        present, code = np.unique(np.asarray(batch.column(scope).to_pylist()), return_inverse=True)
        for c, value in enumerate(present.tolist()):
            if value in of_scope:
                yield of_scope[value], np.flatnonzero(code == c)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, wanted, of_scope = shared.value
        best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(names)
        types = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            types = batch.schema.field(doc).type
            ids = batch.column(doc).to_numpy(zero_copy_only=False)
            if ids.dtype == object:
                ids = ids.astype(str)
            vectors = _matrix(batch.column(vector))
            for positions, rows in groups(batch, of_scope):
                scores = vectors[rows] @ wanted[:, positions]
                for column, j in enumerate(positions):
                    s, i = scores[:, column], ids[rows]
                    if floor is not None:
                        s, i = s[s >= floor], i[s >= floor]
                    if best[j] is not None:
                        s, i = np.concatenate([best[j][0], s]), np.concatenate([best[j][1], i])
                    at = best_positions(s, i, k)
                    best[j] = (s[at], i[at])
        for j, kept in enumerate(best):
            if kept is not None and len(kept[0]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[j]] * len(kept[0])), pa.array(kept[1].tolist(), type=types), pa.array(kept[0])],
                    names=[query, doc, "score"])
    return search
