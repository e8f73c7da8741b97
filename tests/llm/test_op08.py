"""Decontamination: plain loops, several broadcast parts, removal of spans."""

import re
from collections import Counter

from lexquarry.llm.op08_decontaminate import decontaminate


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def brute(docs, items, width=10):
    grams = {}
    for item, text in items:
        w = words(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i:i + n]), set()).add("null" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if own := grams.get(tuple(w[i:i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        out.append((doc, len(w), len(hit), ",".join(sorted(found))))
    return Counter(out)


def got(frame):
    return Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in frame.collect())


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Same TEXT, here"), (2, "word word"), (10, None), (11, ""),
         (None, "without an id"), (12, "one"), (30, "é ü ß")]


def test_odd_rows(spark, odd, none):
    from conftest import ODD

    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert got(decontaminate(odd, items, ["doc_id"])) == brute(ODD, ITEMS)
    assert got(decontaminate(odd, items, ["doc_id"], part_words=5)) == brute(ODD, ITEMS)
    assert decontaminate(none, items, ["doc_id"]).count() == 0
    assert got(decontaminate(odd, items.limit(0), ["doc_id"])) == brute(ODD, [])


def test_spans_are_cut(spark):
    docs = spark.createDataFrame(
        [(1, "before, One two-three four FIVE six seven eight nine ten eleven! after"), (2, "clean  text"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    clean = {r.doc_id: r.clean_text for r in decontaminate(docs, items, ["doc_id"]).collect()}
    assert clean == {1: "before, ! after", 2: "clean  text", 3: None}


def test_documents(spark, folder, documents):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = brute(documents, [(r.item_id, r.text) for r in items.collect()])
    assert got(decontaminate(docs, items, ["doc_id"])) == want and sum(1 for w in want if w[2]) > 0


def test_copies_of_an_item_are_dealt_over_the_parts(spark):
    from lexquarry.llm.op08_decontaminate import parts

    text = "One\ttwo\nthree four"
    items = spark.createDataFrame([(i, text) for i in range(100)], "item_id long, text string")
    sets = parts(items, 10, 40)
    assert len(sets) == 10
    docs = spark.createDataFrame([(1, "zero one two three four five")], "doc_id long, text string")
    row = decontaminate(docs, items, ["doc_id"], part_words=40).first()
    assert (row.n_words, row.n_hit, len(row["items"])) == (6, 4, 100)
