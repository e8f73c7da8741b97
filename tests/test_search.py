"""Search operators against brute force, and the rules of fusion and confidence."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexquarry.functions.confidence import confidence
from lexquarry.operators import lexical as L
from lexquarry.operators.dense import dense_top_k
from lexquarry.operators.exact import exact_lookup, with_intent
from lexquarry.operators.fusion import fuse
from lexquarry.operators.tenancy import require_scope
from lexquarry.sizing import blocks, skew_join
from lexquarry.sources.tables import table

FOLDER = "/root/testdata/sf0.001"


def bm25_model(docs, queries, k1=1.5, b=0.75, eps=0.25):
    toks = {d: re.findall(r"\w+", t.lower()) for d, t in docs.items()}
    df = Counter(w for t in toks.values() for w in set(t))
    n, avgdl = len(toks), sum(map(len, toks.values())) / len(toks)
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: eps * mean if v < 0 else v for w, v in raw.items()}
    out = {}
    for q, text in queries.items():
        for d, t in toks.items():
            tf = Counter(t)
            out[q, d] = sum(idf.get(w, 0) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(t) / avgdl))
                            for w in re.findall(r"\w+", text.lower()))
    return out


@pytest.mark.parametrize("path", ["local", "shuffled", "tiny cells", "index"])
def test_bm25_against_model(spark, monkeypatch, path):
    docs = table(spark, FOLDER, "documents").select("doc_id", "text")
    asked = table(spark, FOLDER, "benchmark").select("item_id", F.col("text").alias("asked"))
    want = bm25_model(dict(docs.collect()), dict(asked.collect()))
    if path == "tiny cells":
        monkeypatch.setattr(L, "CELLS", 400)
    args = (docs, asked, "doc_id", "text", "item_id", "asked")
    if path == "index":
        hits = L.search_index(L.build_index(docs, "doc_id", "text"), asked, "doc_id", "item_id", "asked", 7)
    elif path == "shuffled":
        hits = L.bm25_search(*args, 7, broadcast_rows=3)
    else:
        hits = L.bm25_search(*args, 7)
    got = {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in hits.collect()}
    for q in {q for q, _ in want}:
        best = sorted(((-round(s, 9), d) for (qq, d), s in want.items() if qq == q and s > 0))[:7]
        for rank, (s, d) in enumerate(best, 1):
            assert got[q, rank][0] == d and abs(got[q, rank][1] + s) < 1e-6


def test_filter_does_not_change_scores(spark):
    docs = table(spark, FOLDER, "documents")
    asked = table(spark, FOLDER, "benchmark").select("item_id", F.col("text").alias("asked"))
    args = (docs, asked, "doc_id", "text", "item_id", "asked", 10_000)
    whole = {(r["item_id"], r["doc_id"]): r["score"] for r in L.bm25_search(*args).collect()}
    part = L.bm25_search(*args, where=F.col("lang") == "de").collect()
    assert part and all(abs(whole[r["item_id"], r["doc_id"]] - r["score"]) < 1e-9 for r in part)


def test_scoped_statistics(spark):
    docs = spark.createDataFrame([("a", 1, "x y"), ("a", 2, "y z"), ("b", 3, "x x x"), ("b", 4, "q")], "s string, d long, t string")
    asked = spark.createDataFrame([("a", "q1", "x"), ("b", "q2", "x")], "s string, q string, w string")
    got = L.bm25_search(docs, asked, "d", "t", "q", "w", 5, by=["s"], fallback=True).collect()
    assert {(r["q"], r["d"]) for r in got} == {("q1", 1), ("q2", 3)}


@pytest.mark.parametrize("block_rows", [4096, 7])
def test_dense_against_model(spark, block_rows):
    e = table(spark, FOLDER, "embeddings").select("vec_id", "embedding").collect()
    ids, m = np.array([r[0] for r in e]), np.array([r[1] for r in e], dtype="float64")
    queries = table(spark, FOLDER, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    got = dense_top_k(table(spark, FOLDER, "embeddings"), queries, "vec_id", "embedding", "q", "qv", 5, block_rows=block_rows).collect()
    for q in {r["q"] for r in got}:
        s = m @ m[ids == q][0]
        best = sorted(zip(-np.round(s, 12), ids))[:5]
        assert [r["vec_id"] for r in sorted((r for r in got if r["q"] == q), key=lambda r: r["rank"])] == [d for _, d in best]


def test_fusion_constants(spark):
    rows = lambda ids: spark.createDataFrame([(1, d, i, 1.0) for i, d in enumerate(ids, 1)], "q int, d string, rank int, score double")
    got = {r["d"]: r for r in fuse(rows("abc"), rows("acb"), "q", "d").collect()}
    assert got["a"]["score"] == round(2 / 61, 6) and got["a"]["rank"] == 1
    assert (got["b"]["rank"], got["c"]["rank"]) == (2, 3)


def test_exact_lookup_rules(spark):
    p = spark.createDataFrame([
        ("c1", "BNS", "103(1)", None, "substantive_section"), ("c2", "BNS", "103(2)", "(2)", "schedule_entry"),
        ("c3", "BNSS", "103", None, "substantive_section"), ("c4", "BNS", "1034", None, "substantive_section")],
        "chunk_id string, act_short string, section_number string, subsection string, chunk_type string")
    q = spark.createDataFrame([(1, "section 103 BNS"), (2, "section 103(2)"), (3, "section 999")], "query_id int, t string")
    got = sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in exact_lookup(p, with_intent(q, "t"), "query_id", "chunk_id").collect())
    assert got == [(1, 1, "c1"), (1, 2, "c2"), (2, 1, "c2"), (2, 2, "c1"), (2, 3, "c3")]


DOCS = ("array<struct<chunk_id:string,act_short:string,section_number:string,section_title:string,score:double,raw_score:double,"
        "dense_rank:int,bm25_rank:int,is_exact_match:boolean>>")


@pytest.mark.parametrize("docs, intent, theta, score, decision, reason", [
    (None, False, 0.75, 0.0, "REFUSE", "no_retrieval_results"),
    ([], True, 0.75, 0.0, "REFUSE", "exact_section_not_found"),
    ([("a", "BNS", "103", "murder", 1.0, None, None, None, True)], False, 0.75, 1.0, "ACCEPT", "exact_section_match"),
    ([("a", "BNS", "1", "alpha", 0.85, None, 1, 1, False), ("b", "BNS", "2", "beta", 0.40, None, 5, 4, False)], False, 0.35,
     round(0.45 * 0.85 + 0.25 + 0.15, 4), "ACCEPT", "high_retrieval_confidence"),
    ([("a", "BNS", "103(1)", "murder", 0.9, 7.59, 1, 1, False), ("b", "BNS", "103(2)", "murder", 0.9, 7.58, 2, 2, False)], False, 0.75,
     1.0, "ACCEPT", "high_retrieval_confidence"),
    ([("a", "BNS", "1", "alpha", 0.1, -10.0, 30, None, False), ("b", "BNS", "2", "beta", 0.1, -10.2, None, 9, False)], False, 0.75,
     round(min(0.45 * (0.5 / 6) + 0.25 * 0.35 + 0.15 * (0.2 / 1.5), 2 * 0.5 / 6), 4), "REFUSE", "low_retrieval_confidence"),
])
def test_confidence_branches(spark, docs, intent, theta, score, decision, reason):
    df = spark.createDataFrame([(docs,)], f"docs {DOCS}")
    c = df.select(confidence(F.col("docs"), F.lit(False), F.lit(intent), theta).alias("c")).first()["c"]
    assert (c["decision"], c["reason"]) == (decision, reason) and abs(c["confidence_score"] - score) < 1e-4


def test_skew_join_equals_join(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    right = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(tuple, skew_join(left, right, ["k"], how, hot_rows=100, salts=4).collect()), key=repr)
        assert a == sorted(map(tuple, left.join(right, ["k"], how).collect()), key=repr)


def test_blocks_cover(spark):
    parts = blocks(spark.range(100), "id", 30)
    assert len(parts) > 1 and sorted(r[0] for p in parts for r in p.collect()) == list(range(100))


def test_blank_scope_fails(spark):
    with pytest.raises(Exception, match="user id is required"):
        require_scope(spark.createDataFrame([(" ",)], "user_id string")).collect()
