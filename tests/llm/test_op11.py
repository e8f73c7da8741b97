"""MinHash links, estimates and components against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexquarry.llm import op11_minhash as m

WHITE = "".join(map(chr, [32, *range(9, 14)]))


def words_of(text):
    lower = (text or "").encode().lower()
    return lower.split()


def plain_set(text, shingle):
    w = words_of(text)
    return frozenset([tuple(w)] if 0 < len(w) < shingle else [tuple(w[i:i + shingle]) for i in range(len(w) - shingle + 1)])


def plain(rows, shingle, percent=80):
    """(id, size, component, kept) of every row."""
    sets = [plain_set(t, shingle) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(root(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return Counter(out)


def drawn(seed, bases, copies):
    draw = random.Random(seed)
    pool = [f"w{i}" for i in range(60)]
    rows, n = [], 0
    for _ in range(bases):
        base = [draw.choice(pool) for _ in range(draw.choice([1, 2, 5, 20, 60, 200]))]
        for _ in range(draw.randint(1, copies)):
            text = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 4, 9])):
                text[draw.randrange(len(text))] = draw.choice(pool)
            n += 1
            rows.append((n, " ".join(t.upper() if draw.random() < 0.1 else t for t in text)))
    draw.shuffle(rows)
    return rows


def found(spark, rows, **how):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = m.near_duplicates(frame, ["doc_id"], **how).select("doc_id", "n_shingles", "component_id", "kept").collect()
    return Counter(map(tuple, out))


def test_against_brute_force(spark):
    rows = drawn(1, 60, 5)
    assert found(spark, rows, shingle=2) == plain(rows, 2)
    rows = drawn(2, 40, 8)
    assert found(spark, rows, shingle=5) == plain(rows, 5)


def test_many_trees_lose_nothing(spark):
    """One large group of near copies around a text, some of them linked over others only, dealt to many small trees."""
    draw = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    rows = [(500, " ".join(base))]
    for i in range(90):
        text = list(base)
        for k in draw.sample(range(60), draw.choice([1, 2, 3, 5, 8])):
            text[k] = f"x{draw.randint(0, 9)}"
        rows.append((i, " ".join(text)))
    assert len({c for _, _, c, _ in plain(rows, 2)}) > 5
    for tree, few in ((7, 1), (20, 1), (9, 100)):
        assert found(spark, rows, shingle=2, tree_rows=tree, least_tree=tree, few_trees=few) == plain(rows, 2)


def test_odd_rows(spark, odd, none):
    from conftest import ODD

    out = m.near_duplicates(odd, ["doc_id", "size", "_text", "start"], shingle=2).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out) == plain(ODD, 2)
    assert m.near_duplicates(none, ["doc_id"]).count() == 0
    names = ["_row", "_id", "_of", "_number", "name", "keys", "sign", "size", "place", "tree", "root", "own", "of", "class", "_component"]
    wide = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, None)], "doc_id long, text string").select(
        "*", *(F.lit(n).alias(n) for n in names))
    out = m.near_duplicates(wide, ["doc_id", *names], shingle=2).collect()
    assert Counter((r.doc_id, r.component_id, r.name, r["size"]) for r in out) == Counter([(1, 1, "name", "size"), (2, 1, "name", "size"), (3, 3, "name", "size")])
    for name in m.RESULTS:
        with pytest.raises(ValueError):
            m.near_duplicates(none.withColumn(name, F.lit(1)), ["doc_id", name])
    blank = spark.createDataFrame([(1, ""), (2, None), (2, " ")], "doc_id long, text string").coalesce(1)
    assert Counter((r.component_id, r.kept) for r in m.near_duplicates(blank, ["doc_id"]).collect()) == Counter([(1, True), (2, True), (2, True)])


def test_estimate_is_corrected_and_lets_similar_sets_through():
    draw = np.random.default_rng(5)
    for size, common in ((5, 4), (50, 40), (400, 340), (400, 100)):
        both = draw.integers(0, 2**63, (300, 2 * size - common), np.uint64)
        both = m.mixed(both)
        sets = [np.sort(x[:size]) for x in both] + [np.sort(x[size - common:]) for x in both]
        smallest = m.minima(sets)
        signs = np.ascontiguousarray(m.packed_bits(smallest)).view(np.uint64)
        lanes = np.array([m.equal_lanes(signs[i], signs[300 + i:301 + i])[0] for i in range(300)])
        plain_lanes = [sum((a >> b & 3) == (c >> b & 3) for x, y in zip(signs[i].tolist(), signs[300 + i].tolist()) for a, c in [(x, y)]
                           for b in range(0, 64, 2)) for i in range(5)]
        assert lanes[:5].tolist() == plain_lanes
        true = common / (2 * size - common)
        assert abs(m.estimate(lanes).mean() - true) < 0.02
        if true >= 0.8:
            assert (m.estimate(lanes) >= m.least_estimate(0.8)).all()
    assert 0.45 < m.least_estimate(0.8) < 0.6


def test_shingle_sets():
    texts = ["a b c a b", "A", "", None, "x  y", "\x0bé é é é"]
    sets = m.shingle_sets(pa.array(texts, pa.string()), 2)
    assert [len(s) for s in sets] == [3, 1, 0, 0, 1, 1]
    assert m.shingle_sets(pa.array(["a", "a a"]), 2)[0].tolist() != m.shingle_sets(pa.array(["b", "a"]), 2)[0].tolist()


def test_query_and_sql(spark, folder, documents):
    import duckdb

    want = plain(documents, 2)
    columns = ["doc_id", "n_shingles", "component_id", "kept"]
    assert Counter(map(tuple, m.op11_minhash(spark, folder).select(columns).collect())) == want
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert Counter(db.sql(f"SELECT {', '.join(columns)} FROM ({m.OP11_SQL})").fetchall()) == want
