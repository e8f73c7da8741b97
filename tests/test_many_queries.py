"""Searches of many queries: what they join, hold and store does not grow with queries times documents."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexquarry.operators import lexical as L
from lexquarry.operators.exact import exact_lookup, with_intent
from lexquarry.operators.forms import lookup


def joined_rows(frame):
    """The most rows that a join of the collected frame gave."""
    frame.collect()
    most, todo = 0, [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if "Join" in kind and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most


def test_equal_questions_meet_the_passages_once(spark):
    """300 passages of one section, asked for by 300 queries."""
    passages = spark.range(300).select(
        F.format_string("c%03d", "id").alias("chunk_id"), F.lit("BNS").alias("act_short"), F.lit("7").alias("section_number"),
        F.when(F.col("id") % 50 == 0, "(2)").alias("subsection"), F.lit("substantive_section").alias("chunk_type"))
    asked = spark.range(300).select(F.col("id").alias("query_id"), F.when(F.col("id") % 2 == 0, "section 7 BNS").otherwise("s. 7(2)").alias("text"))
    found = exact_lookup(passages, with_intent(asked, "text"), "query_id", "chunk_id", 3)
    assert joined_rows(found) <= 2 * 300 + 3 * 300
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {q: ["c000", "c001", "c002"] if q % 2 == 0 else ["c000", "c050", "c100"] for q in range(300)}


def test_many_query_terms_are_scored_in_passes(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(words[i % 7:: 1 + i % 5])) for i in range(60)] + [(60, None), (61, "")]
    asked = [(i, " ".join(words[i % 11:: 3 + i % 4])) for i in range(50)] + [(100, "w1 w2"), (101, "w1 w2"), (102, None), (103, "none")]
    frames = (spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(asked, "query long, asked string"))
    args = (*frames, "doc", "text", "query", "asked", 4)
    for kw in ({}, {"where": F.col("doc") % 2 == 0}, {"fallback": True}):
        whole = {(r["query"], r["rank"]): (r["doc"], round(r["score"], 9)) for r in L.bm25_search(*args, **kw).collect()}
        with monkeypatch.context() as m:
            m.setattr(L, "bm25_scores", None)
            parts = L.bm25_search(*args, broadcast_rows=20, **kw).collect()
        assert len(parts) == len(whole) > 50
        assert {(r["query"], r["rank"]): (r["doc"], round(r["score"], 9)) for r in parts} == whole


def test_products_of_a_task_are_bounded(monkeypatch):
    """Documents share 40 terms, and each is in all of 300 queries."""
    monkeypatch.setattr(L, "CELLS", 20_000)
    queries, terms, docs = 300, 40, 200
    shared = SimpleNamespace(value=(list(range(queries)), np.arange(terms + 1) * queries, np.tile(np.arange(queries), terms),
                                    np.ones(terms * queries), np.full(terms, float(terms))))
    rows = docs * terms
    batch = pa.record_batch({"doc": np.repeat(np.arange(docs), terms), "dl": np.full(rows, terms), "key": np.tile(np.arange(terms), docs),
                             "tf": np.ones(rows, dtype="int64")})
    run = L._scorer(shared, "query", "doc", 2, L.Bm25(), False)
    tracemalloc.start()
    out = [r for b in run(iter([batch])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4_000_000
    assert len(out) == 2 * queries and {r["doc"] for r in out} == {0, 1} and all(abs(r["score"] - terms) < 1e-9 for r in out)


def test_a_section_of_many_forms_is_counted_once(spark):
    """200 forms of one section and of one title word, 200 queries for each: no join meets all of their pairs."""
    forms = spark.range(200).select(
        F.col("id").cast("int").alias("form_number"), F.concat(F.lit("bond "), F.concat(F.lit("t"), F.col("id"))).alias("form_title"),
        F.array(F.lit("7")).alias("applicable_sections"))
    asked = spark.range(400).select(F.col("id").alias("query_id"), F.when(F.col("id") % 2 == 0, "under section 7").otherwise("a bond").alias("query_text"))
    found = lookup(asked, forms)
    assert joined_rows(found) <= 4000
    rows = found.collect()
    assert {(r.query_id % 2, r.step, r.status, r.n_section_forms) for r in rows} == {
        (0, "section", "AMBIGUOUS", 200), (1, "similar", "AMBIGUOUS", None)} and len(rows) == 400
    assert all(r.similar_forms == [0, 1, 2, 3, 4] for r in rows if r.query_id % 2)


def test_texts_are_cut_twice(spark):
    """Once for the statistics and once for the scores."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def made(text):
        calls.add(1)
        return text

    docs = spark.createDataFrame([(i, f"word{i % 5} common other{i}") for i in range(30)], "doc long, text string").withColumn("text", made("text"))
    queries = spark.createDataFrame([(1, "word1 common"), (2, "other7")], "query long, asked string")
    assert L.bm25_search(docs, queries, "doc", "text", "query", "asked", 3).count() == 4
    assert calls.value <= 2 * 30


def test_joined_search_splits_heavy_terms(spark, monkeypatch):
    """Terms of many products are met in parts; scores are those of the broadcast path."""
    docs = spark.createDataFrame([(i, f"word{i % 5} common " * (i % 3 + 1)) for i in range(40)], "doc long, text string")
    queries = spark.createDataFrame([(i, f"word{i % 5} common none") for i in range(20)], "query long, asked string")

    def scores(bound):
        rows = L.bm25_scores(docs, queries, "doc", "text", "query", "asked", broadcast_rows=bound).collect()
        return {(r["query"], r["doc"]): (round(r.score, 9), r.matches) for r in rows}

    monkeypatch.setattr(L, "PAIR_ROWS", 50)
    assert scores(1) == scores(1_000) and len(scores(1)) == 800
