"""Vector search over stored cells: the results of a scan, from few cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexquarry.operators.cells import load_cells, save_cells, search_cells
from lexquarry.operators.dense import dense_top_k

DIM = 8


@pytest.fixture(scope="module")
def vectors(spark):
    """Twelve tight groups of unit vectors, ties among them, and rows that take no part; one user has half of the rows."""
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(12, DIM))
    x = middle[rng.integers(0, 12, 600)] + 0.02 * rng.normal(size=(600, DIM))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[50:60] = x[40]
    rows = [(i, v.tolist(), i % 5, "hot" if i % 2 else f"u{i % 7}") for i, v in enumerate(x)]
    odd = [(1001, None, 0, "hot"), (1002, [float("nan")] * DIM, 0, "hot"), (1003, [None] * DIM, 0, "u0"), (1004, [float("inf")] * DIM, 1, None)]
    return spark.createDataFrame(rows + odd, "doc long, vec array<double>, label int, user string")


@pytest.fixture(scope="module")
def queries(vectors):
    good = vectors.where("doc < 1000 and doc % 20 = 0")
    return good.select(F.col("doc").alias("q"), F.col("vec").alias("qv"), "user")


def rows(hits):
    return sorted((r.q, r["rank"], r.doc, round(r.score, 9)) for r in hits.collect())


@pytest.fixture(scope="module")
def store(spark, vectors, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells"))
    save_cells(vectors, path, "doc", "vec", owner="user", keep=["label"], cells=12)
    return load_cells(spark, path)


@pytest.mark.parametrize("k, seeds, block", [(1, 1, 1024), (7, 2, 9), (120, 1, 1024), (700, 2, 1024)])
def test_same_as_a_scan(vectors, queries, store, k, seeds, block):
    scanned = dense_top_k(vectors.where("doc < 1000"), queries, "doc", "vec", "q", "qv", k)
    got = search_cells(store, queries, "doc", "vec", "q", "qv", k, seed_cells=seeds, block_rows=block)
    assert rows(got) == rows(scanned)


def test_few_cells_are_scored(queries, store):
    seen = []
    search_cells(store, queries, "doc", "vec", "q", "qv", 5, seen=seen, seed_cells=1).count()
    assert sum(a for a, _ in seen) <= 0.4 * sum(b for _, b in seen)


def test_filtered(vectors, queries, store):
    want = dense_top_k(vectors.where("doc < 1000"), queries, "doc", "vec", "q", "qv", 9, where=F.col("label") == 3)
    assert rows(search_cells(store, queries, "doc", "vec", "q", "qv", 9, where=F.col("label") == 3)) == rows(want)


def test_owners_see_their_own(vectors, queries, store):
    want = dense_top_k(vectors.where("doc < 1000"), queries, "doc", "vec", "q", "qv", 9, scope="user")
    assert rows(search_cells(store, queries, "doc", "vec", "q", "qv", 9, owner="user")) == rows(want)


def test_every_usable_row_is_stored_under_its_radius(store):
    assert store["vectors"].count() == 600
    assert store["vectors"].join(store["cells"], "cell").where("distance > radius").count() == 0


def test_empty(spark, vectors, queries, tmp_path):
    save_cells(vectors.where("doc > 1000"), str(tmp_path), "doc", "vec")
    assert search_cells(load_cells(spark, str(tmp_path)), queries, "doc", "vec", "q", "qv", 3).count() == 0
