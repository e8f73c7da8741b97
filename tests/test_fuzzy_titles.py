"""Similar titles against all pairs, and how few pairs are met."""

import random
import re

from pyspark.sql import functions as F

from lexquarry.operators import forms as M

STOP, ASKED = set(M.TITLE_STOP), set(M.QUERY_STOP)


def words(text, stop):
    return {w for w in re.sub(r"[^a-z0-9\s]", " ", (text or "").lower()).split() if w not in stop}


def plain(queries, forms):
    out = {}
    for q, text in queries:
        a = words(text, ASKED)
        for f, title in forms:
            b = words(title, STOP)
            n = len(a & b)
            if n:
                p, r = n / len(a), n / len(b)
                s = 0.6 * p + 0.4 * (2 * p * r / (p + r))
                if s > 0.3:
                    out[q, f] = round(s, 9)
    return out


def drawn(seed):
    draw = random.Random(seed)
    rare, common = [f"r{i}" for i in range(60)], ["notice", "order", "court", "form"]
    title = lambda: " ".join(draw.sample(rare, draw.randint(1, 4)) + draw.sample(common, draw.randint(0, 3)))
    forms = [(i, title()) for i in range(150)] + [(900, None), (901, ""), (902, "of the")]
    queries = [(i, " ".join(draw.sample(draw.choice(forms[:150])[1].split() + rare[:3] + common + ["what", "is", "zzz"], 4))) for i in range(120)]
    return queries + [(500, None), (501, "  "), (502, "show the form"), (503, "r1 " * 40), (504, " ".join(rare))], forms


def test_against_all_pairs(spark):
    for seed, bound in ((1, 200_000), (2, 3)):
        queries, forms = drawn(seed)
        found = M.fuzzy_scores(spark.createDataFrame(queries, "query_id long, query_text string"),
                               spark.createDataFrame(forms, "form_number int, form_title string"), broadcast_rows=bound).collect()
        assert len(found) == len({(r.query_id, r.form_number) for r in found})
        assert {(r.query_id, r.form_number): round(r.match_score, 9) for r in found} == plain(queries, forms)


def test_common_words_meet_few_pairs(spark):
    """Every title has one word in common; pairs are met by their rare words."""
    forms = [(i, f"a{i} b{i} court") for i in range(300)]
    queries = [(i, f"a{i} c{i} b{i} court") for i in range(300)]
    frame = M.fuzzy_scores(spark.createDataFrame(queries, "query_id long, query_text string"),
                           spark.createDataFrame(forms, "form_number int, form_title string"))
    assert frame.count() == 300
    # the same without the filter of the score: what the join lets through
    needed = spark.range(1).select(M._needed(F.lit(4), F.lit(3)).alias("n")).first().n
    assert needed == 2
    joined = frame.groupBy().agg(F.count(F.lit(1)).alias("n"))
    assert joined.first().n <= 5 * 300


def test_pairs_of_a_common_word_are_dealt_to_many_tasks(spark, monkeypatch):
    """Each query shares one word with each title, and that word is all that they share."""
    monkeypatch.setattr(M, "CELL_PAIRS", 4000, raising=False)
    monkeypatch.setattr(M, "CELL_TITLES", 90, raising=False)
    forms = [(i, "court") for i in range(250)]
    queries = [(i, f"court x{i % 2}") for i in range(200)]
    found = M.fuzzy_scores(spark.createDataFrame(queries, "query_id long, query_text string"),
                           spark.createDataFrame(forms, "form_number int, form_title string"), broadcast_rows=3)
    rows = found.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sum(r.n for r in rows) == found.distinct().count() == 250 * 200
    assert max(r.n for r in rows) <= 250 * 200 / 2
    assert {round(r.match_score, 9) for r in found.collect()} == {round(0.6 * 0.5 + 0.4 * 2 / 3, 9)}


def test_first_titles_against_all_pairs(spark, monkeypatch):
    """The first five of each query, also where words are listed up to two only and the rest takes the other way."""
    for seed, bound, most in ((1, 200_000, 32), (2, 3, 32), (3, 200_000, 3)):
        monkeypatch.setattr(M, "PAIR_WORDS", most)
        queries, forms = drawn(seed)
        forms += [(2000 + i, t) for i, (_, t) in enumerate(forms[:80])]
        found = M.similar_titles(spark.createDataFrame(queries, "query_id long, query_text string"),
                                 spark.createDataFrame(forms, "form_number int, form_title string"), broadcast_rows=bound).collect()
        want = {}
        for (q, f), s in plain(queries, forms).items():
            want.setdefault(q, []).append((-s, f))
        got = {}
        for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
            got.setdefault(r.query_id, []).append((-round(r.match_score, 9), r.form_number))
        assert got == {q: sorted(rows)[:5] for q, rows in want.items()}
