"""Substring dedup against brute force; a small sketch must not change results."""

import hashlib
import random
from collections import Counter

from lexquarry.llm import op03_substring_dedup as op


def brute(docs, width):
    words = [(t or "").encode().split() for _, t in docs]
    seen = Counter(tuple(w[i:i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (d, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i:i + width])] > 1:
                gone.update(range(i, i + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def got(frame):
    from pyspark.sql import functions as F

    return Counter(tuple(r) for r in frame.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect())


def test_random_texts(spark):
    draw = random.Random(5)
    shared = [" ".join(draw.choice("abcdefgh") for _ in range(60)) for _ in range(4)]
    docs = []
    for i in range(120):
        own = " ".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(0, 90)))
        docs.append((i, own + draw.choice(["", " " + draw.choice(shared)]) + draw.choice(["", "\n" + draw.choice(shared)[5:70]])))
    docs += [(200 + i, "a " * 50) for i in range(3)] + docs[:10]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for width, gram in ((35, 20), (8, 5), (3, 3)):
        assert got(op.remove_repeats(frame, ["doc_id"], width=width, gram=gram)) == brute(docs, width)


def test_full_sketch_loses_nothing(spark, monkeypatch, documents):
    monkeypatch.setattr(op, "MIN_CELLS", 1 << 16)
    frame = spark.createDataFrame(documents[:60], "doc_id long, text string").repartition(3)
    assert got(op.remove_repeats(frame, ["doc_id"], max_cells=1 << 16)) == brute(documents[:60], 35)


def test_odd_rows(odd, none):
    from conftest import ODD

    assert got(op.remove_repeats(odd, ["doc_id"])) == brute(ODD, 35)
    assert op.remove_repeats(none, ["doc_id"]).count() == 0
