"""Phrases against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from lexquarry.llm.op12_phrases import MAX_BITS, OP12_SQL, Bits, bitmap, exact_score, op12_phrases, phrase_hashes, phrases, seeds

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain(rows, limit):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                f[lang].update(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, c in f.items():
        found = []
        for p, a in c.items():
            if a < 10 or len(p) == 1:
                continue
            longer = [b for q, b in c.items() if len(q) == 3 and len(p) == 2 and b >= 10 and p in (q[:2], q[1:])]
            if any(100 * b >= 50 * a for b in longer):
                continue
            cuts = [(10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:limit]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return Counter(out)


def drawn(seed, n):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["ß", "É", "漢字"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(draw.randint(0, 40)):
            parts.append(draw.choice([" ".join(draw.choices(words, weights, k=3)), "New York City", "new york", "ad hoc", "a b c b c"]))
        rows.append((draw.choice([" ", ". ", "\n", " \t"]).join(parts), draw.choice(["en", "de", None, "und"])))
    return rows


def test_against_plain(spark):
    for seed, n, limit, ranks in ((1, 150, 2000, (2, 8, 32)), (2, 200, 5, (1, 2)), (3, 200, 20, (2,)), (4, 120, 9, ())):
        rows = drawn(seed, n)
        found = phrases(spark.createDataFrame(rows, "text string, lang string"), limit=limit, ranks=ranks).select(COLUMNS).collect()
        assert Counter(map(tuple, found)) == plain(rows, limit)


def test_odd_rows(spark):
    rows = [(None, "en"), ("", None), (" \t", "en"), (" . , ", "en"), ("one", "x"), ("a b " * 30_000, "en"), ("A B c. " * 12, "en"),
            *[("same text twice over", "en")] * 12, *[("im\vhaus! im haus\r", None)] * 6, ("word\x00 word\x1c " * 15, "y")]
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "text string, lang string, a long, phrase string")
    assert Counter(map(tuple, phrases(frame).select(COLUMNS).collect())) == plain(rows, 2000)
    none = spark.createDataFrame([], "text string, lang string")
    assert phrases(none).collect() == [] and phrases(none).columns == COLUMNS


def test_scores_pass_64_bits(spark):
    big = 3_000_000_000_019
    row = spark.createDataFrame([(big, big + 5, big + 7)], "a long, l long, r long").select(
        exact_score(*(__import__("pyspark").sql.functions.col(c) for c in "alr")).alias("s")).first()
    assert row.s == 10**6 * big * big // ((big + 5) * (big + 7))


def test_bits_lose_nothing(spark):
    rows = [("en", f"w{i} v{i}") for i in range(3000)]
    for most in (MAX_BITS, 1 << 16):
        held = Bits(*bitmap(spark.createDataFrame(rows, "lang string, phrase string"), most))
        import xxhash

        one, two = (np.array([xxhash.xxh3_64_intdigest(p.split()[k]) for _, p in rows], np.uint64) for k in (0, 1))
        assert held.holds(phrase_hashes(np.repeat(seeds(["en"]), len(rows)), one, two)).all()
        assert held.holds(phrase_hashes(np.repeat(seeds(["de"]), len(rows)), one, two)).mean() < 0.1


def test_query_and_sql(spark, folder):
    import duckdb
    import pyarrow.parquet as pq

    rows = [(r["text"], r["lang"]) for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()]
    want = plain(rows, 2000)
    assert Counter(map(tuple, op12_phrases(spark, folder).select(COLUMNS).collect())) == want
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert Counter(db.sql(f"SELECT {', '.join(COLUMNS)} FROM ({OP12_SQL})").fetchall()) == want
