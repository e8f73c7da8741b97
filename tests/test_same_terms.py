"""Queries that differ only in words of no document are searched once; frequent terms are scored as a dense product."""

import random

import numpy as np

from lexquarry.operators import lexical as L


def rows(frame):
    return {(r["query"], r["rank"]): (r["doc"], round(r["score"], 9)) for r in frame.collect()}


def test_words_of_no_document_do_not_make_another_search(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 7 + 1))) for i in range(40)] + [(50, None)], "doc long, text string")
    asked = spark.createDataFrame([(i, f"w3 w5 unknown{i}") for i in range(60)] + [(100, "w5 w3"), (101, "w3 w5 w5"), (102, "none"), (103, None)],
                                  "query long, asked string")
    args = (docs, asked, "doc", "text", "query", "asked", 3)
    whole, sent, best = rows(L.bm25_search(*args)), [], L._best

    def counted(stream, table, *rest, **kw):
        sent.append(len(set(table.column("query").to_pylist())))
        return best(stream, table, *rest, **kw)

    monkeypatch.setattr(L, "_best", counted)
    assert rows(L.bm25_search(*args, broadcast_rows=20)) == whole and len(whole) == 62 * 3
    assert sum(sent) == 2


def test_dense_terms_give_the_same_scores(spark, monkeypatch):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(draw.choices(words, [1 / (i + 1) for i in range(60)], k=n))
    docs = spark.createDataFrame([(f"d{i % 90:03d}", text(i % 30 + 1)) for i in range(90)], "doc string, text string")
    asked = spark.createDataFrame([(i, text(8)) for i in range(40)], "query long, asked string")
    found = []
    for share, cells in ((2.0, 2_000_000), (0.0, 2_000_000), (0.05, 300)):
        monkeypatch.setattr(L, "DENSE_SHARE", share)
        monkeypatch.setattr(L, "CELLS", cells)
        found.append(rows(L.bm25_search(docs, asked, "doc", "text", "query", "asked", 7)))
    assert found[0] == found[1] == found[2] and len(found[0]) == 40 * 7


def test_best_hits_of_every_query():
    draw = np.random.default_rng(3)
    q, s, ids = draw.integers(0, 9, 400), draw.integers(0, 6, 400) / 7, np.array([f"d{i}" for i in draw.permutation(400)])
    at = L._best_of(q, s, ids, 5)
    want = [r for j in range(9) for r in sorted((-x, i) for x, i, of in zip(s, ids, q) if of == j)[:5]]
    assert [(-s[i], ids[i]) for i in at] == want
