"""Top-k vector search over stored cells, without reading those that cannot matter.

A store deals its vectors to cells, one around each of a number of centres, and keeps every cell's radius.  The product of a query and
a vector of a cell is at most ``query . centre + |query| * radius``.  A search scores the ``SEED_CELLS`` cells with the best bounds of
a query in full; their k-th score is a floor, and of all other cells only those are read whose bound reaches it.  Centres are fitted on
a bounded sample, every vector is stored, and nothing is estimated: the result is that of a scan, whatever the centres.

With ``owner`` the folders above the cells hold the vectors of some owners (users), and a query sees its own owner's only.
Rows without a vector, or with a component that is null or not finite, are not stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lexquarry.operators.dense import ORDER_DIGITS, _matrix, best_positions
from lexquarry.operators.topk import top_k
from lexquarry.session import reliable_checkpoint
from lexquarry.sizing import blocks, union_all

#: Rows on which centres are fitted, rounds of fitting, and the most cells.
SAMPLE_ROWS, FIT_ROUNDS, MOST_CELLS = 20_000, 6, 4_096
#: Folders of owners.
OWNER_FOLDERS = 64
SEED_CELLS = 2
#: Queries of one search; their bounds for all cells are at most ``BLOCK_ROWS * MOST_CELLS`` numbers.
BLOCK_ROWS = 1_024
#: What rounding may add to a product.
SLACK = 1e-9


def usable(vector: str) -> Column:
    """Whether a vector takes part: no null, no component that is null or not finite."""
    value = F.col(vector)
    whole = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return value.isNotNull() & (F.size(value) > 0) & F.coalesce(whole, F.lit(False))


def owner_folder(owner: Column) -> Column:
    return F.pmod(F.xxhash64(owner), F.lit(OWNER_FOLDERS)).cast("int")


def _nearest(rows: np.ndarray, centres: np.ndarray, step: int = 1_024) -> np.ndarray:
    """The centre closest to every row; ``step`` rows are compared at a time."""
    size = (centres ** 2).sum(1)
    found = [(size - 2.0 * (rows[i:i + step] @ centres.T)).argmin(1) for i in range(0, len(rows), step)]
    return np.concatenate(found) if found else np.zeros(0, dtype="int64")


def centres_of(vectors: DataFrame, doc: str, vector: str, cells: int | None = None, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Centres by k-means over the ``sample_rows`` rows with the smallest hash of ``doc``; by default the square root of the rows."""
    if cells is None:
        cells = min(MOST_CELLS, int(np.ceil(np.sqrt(vectors.count()))))
    sample = vectors.select(doc, vector).orderBy(F.xxhash64(doc), doc).limit(sample_rows).select(vector).toArrow()
    rows = _matrix(sample.column(0))
    if not len(rows):
        return np.zeros((0, 0))
    centres = np.unique(rows, axis=0)
    centres = centres[np.random.default_rng(11).permutation(len(centres))[:max(1, cells)]]
    for _ in range(FIT_ROUNDS):
        at = _nearest(rows, centres)
        n = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, rows)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def save_cells(vectors: DataFrame, path: str, doc: str, vector: str, owner: str | None = None, keep: list[str] | None = None,
               cells: int | None = None) -> None:
    """Write ``path/vectors`` in folders by owner and cell, and ``path/cells`` (cell, centre, radius, n).

    Rows are ranged by folder and a hash of ``doc``, so that a large cell is written by several tasks.
    """
    spark = vectors.sparkSession
    kept = list(dict.fromkeys([doc, vector, *([owner] if owner else []), *(keep or [])]))
    rows = vectors.where(usable(vector)).select(*kept)
    centres = centres_of(rows, doc, vector, cells)
    shared = spark.sparkContext.broadcast(centres)
    dealt = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("distance", T.DoubleType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(vector))
                at = _nearest(x, shared.value)
                away = np.sqrt(((x - shared.value[at]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(at.astype(np.int32)), pa.array(away)], names=dealt.names)

    placed = rows.mapInArrow(deal, dealt).withColumn("owner_folder", owner_folder(F.col(owner)) if owner else F.lit(0))
    placed.repartitionByRange("owner_folder", "cell", F.xxhash64(doc)).sortWithinPartitions("owner_folder", "cell").write.mode(
        "overwrite").partitionBy("owner_folder", "cell").parquet(f"{path}/vectors")
    # keeps the columns of a store without a vector
    spark.createDataFrame([], placed.schema).write.mode("overwrite").parquet(f"{path}/columns")
    radii = _stored(spark, path).groupBy("cell").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("n"))
    centre = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    radii.join(F.broadcast(centre), "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/vectors")


def load_cells(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {"vectors": _stored(spark, path), "cells": spark.read.parquet(f"{path}/cells")}


def bounds_of(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """The most that a vector of each cell can score for each query."""
    size = np.sqrt((queries ** 2).sum(1))
    bound = queries @ centres.T + size[:, None] * radii
    return bound + SLACK * (1.0 + np.abs(bound))


def search_cells(
    index: dict[str, DataFrame], queries: DataFrame, doc: str, vector: str, query: str, query_vector: str, k: int,
    where: Column | None = None, owner: str | None = None, seed_cells: int = SEED_CELLS, block_rows: int = BLOCK_ROWS,
    seen: list[tuple[int, int]] | None = None,
) -> DataFrame:
    """(query, doc, score, rank) of stored vectors, the result of ``dense_top_k``.

    ``where`` limits the rows; it may use any stored column.  ``owner`` names a column of both sides, the one of ``save_cells``.
    ``seen`` takes for every block of queries the number of (query, cell) scored, and of all there are.  The cells' table, at most
    ``MOST_CELLS`` rows, and a block's floors reach the driver; each block of queries is two passes over the cells it needs.
    """
    spark = queries.sparkSession
    pool = index["vectors"] if where is None else index["vectors"].where(where)
    cells = index["cells"].orderBy("cell").select("cell", "centre", "radius").toArrow()
    number = np.array(cells.column("cell").to_pylist(), dtype="int64")
    schema = T.StructType([T.StructField(query, queries.schema[query].dataType), T.StructField(doc, pool.schema[doc].dataType),
                           T.StructField("score", T.DoubleType())])
    order = [F.round("score", ORDER_DIGITS).desc(), F.col(doc).asc()]
    asked = queries.where(usable(query_vector)).select(query, query_vector, *([owner] if owner else []))
    parts = []
    for block in blocks(asked, query, block_rows) if len(number) else []:
        table = block.toArrow()
        if table.num_rows == 0:
            continue
        names, wanted = table.column(query).to_pylist(), _matrix(table.column(query_vector))
        owners = table.column(owner).to_pylist() if owner else None
        mine = pool
        if owner:
            folders = sorted({r[0] for r in block.select(owner_folder(F.col(owner))).distinct().collect()})
            mine = pool.where(F.col("owner_folder").isin(folders))
        bounds = bounds_of(wanted, _matrix(cells.column("centre")), cells.column("radius").to_numpy())
        first = np.zeros(bounds.shape, dtype=bool)
        best = np.argpartition(-bounds, min(seed_cells, bounds.shape[1]) - 1, axis=1)[:, :seed_cells]
        np.put_along_axis(first, best, True, axis=1)

        def scored(open_cells: np.ndarray) -> DataFrame:
            used = np.flatnonzero(open_cells.any(axis=0))
            if not len(used):
                return spark.createDataFrame([], schema)
            positions = {int(number[c]): np.flatnonzero(open_cells[:, c]) for c in used}
            shared = spark.sparkContext.broadcast((names, wanted, owners, positions))
            rows = mine.where(F.col("cell").isin(list(positions)))
            rows = rows.select(doc, vector, "cell", *([F.col(owner).alias("_owner")] if owner else []))
            return rows.mapInArrow(_scorer(shared, query, doc, vector, k), schema)

        seeds = reliable_checkpoint(top_k(scored(first), [query], order, k))
        floor = dict(seeds.where(F.col("rank") == k).select(query, "score").collect())
        at = np.array([floor.get(n, -np.inf) for n in names])
        rest = (bounds >= at[:, None]) & ~first
        if seen is not None:
            seen.append((int(first.sum() + rest.sum()), first.size))
        parts += [seeds.select(query, doc, "score"), scored(rest)]
    hits = union_all(parts) if parts else spark.createDataFrame([], schema)
    return top_k(hits, [query], order, k)


def _scorer(shared, query: str, doc: str, vector: str, k: int):
    """Products of the rows of a cell with the queries it is open for; a task keeps ``k`` rows of each query."""
    def runs(codes: np.ndarray) -> Iterator[np.ndarray]:
        by = np.argsort(codes, kind="stable")
        yield from np.split(by, np.flatnonzero(np.diff(codes[by])) + 1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, wanted, owners, positions = shared.value
        of_owner: dict = {}
        for j, value in enumerate(owners or []):
            of_owner.setdefault(value, []).append(j)
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        kind = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            kind = batch.schema.field(doc).type
            ids = batch.column(doc).to_numpy(zero_copy_only=False)
            ids = ids.astype(str) if ids.dtype == object else ids
            x, cell = _matrix(batch.column(vector)), batch.column("cell").to_numpy()
            for rows in runs(cell):
                open_for = positions[int(cell[rows[0]])]
                groups = [(rows, open_for)]
                if owners is not None:
                    coded = batch.column("_owner").take(pa.array(rows)).dictionary_encode()
                    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                    groups = []
                    for part in runs(codes):
                        value = coded.dictionary[int(codes[part[0]])].as_py() if codes[part[0]] >= 0 else None
                        theirs = [] if value is None else of_owner.get(value, [])
                        groups.append((rows[part], np.intersect1d(open_for, np.array(theirs, dtype="int64"))))
                for some, asked in groups:
                    if not len(asked):
                        continue
                    product = x[some] @ wanted[asked].T
                    for column, j in enumerate(asked.tolist()):
                        s, i = product[:, column], ids[some]
                        if j in best:
                            s, i = np.concatenate([best[j][0], s]), np.concatenate([best[j][1], i])
                        keep = best_positions(s, i, k)
                        best[j] = (s[keep], i[keep])
        for j, (s, i) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[j]] * len(s)), pa.array(i.tolist(), type=kind), pa.array(s)], names=[query, doc, "score"])
    return search
