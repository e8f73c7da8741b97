"""Nearest neighbours against all pairs; error bounds; ties, repeats and unusable vectors."""

import math
import random

import numpy as np

from lexquarry.llm.op06_nearest import Block, nearest, op6_nearest


def brute(rows, queries, k):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = set()
    for q, a in {(q, tuple(a)) for q, a in good if q in queries}:
        scored = []
        for i, b in good:
            if i != q and len(a) == len(b):
                s = 0.0
                for x, y in zip(a, b):
                    s += x * y
                scored.append((-s, i))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])}
    return out


def test_bound_holds():
    draw = np.random.default_rng(2)
    a = Block(16, np.arange(50, dtype="<i8").tobytes(), draw.normal(size=(50, 16)).tobytes())
    b = Block(16, np.arange(80, dtype="<i8").tobytes(), (draw.normal(size=(80, 16)) ** 5).tobytes())
    estimate = (a.whole @ b.whole.T) * a.step[:, None] * b.step
    bound = a.near_norm[:, None] * b.error + a.error[:, None] * b.norm
    assert (np.abs(estimate - a.exact @ b.exact.T) <= bound).all()


def test_random_and_tied_vectors(spark):
    draw = random.Random(3)
    rows = [(i, [draw.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(6)]) for i in range(300)]
    rows += [(i, [1.0, 1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(300, 420)]
    rows += [(500, None), (501, []), (502, [0.0] * 6), (503, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (504, [float("nan")] * 6), (505, [float("inf")] * 6),
             (None, [1.0] * 6), (506, [1.0, 2.0]), (507, [2.0, 1.0]), (20, [9.0] * 6), (600, [1e-30] * 6), (601, [1e30] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asked = frame.where("vec_id % 20 = 0 OR vec_id > 499")
    queries = {i for i, _ in rows if i is not None and (i % 20 == 0 or i > 499)}
    for sizes in ((1024, 4096), (7, 50)):
        got = nearest(asked, frame, 5, query_rows=sizes[0], candidate_rows=sizes[1], groups=3).collect()
        assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == brute(rows, queries, 5)
    assert nearest(asked.limit(0), frame, 5).count() == 0 and nearest(asked, frame.limit(0), 5).count() == 0


def test_query(spark, folder):
    import pyarrow.parquet as pq

    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{folder}/embeddings.parquet").to_pylist()]
    got = op6_nearest(spark, folder).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == brute(rows, {i for i, _ in rows if i % 20 == 0}, 20)
