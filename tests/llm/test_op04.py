"""Language identification: Viterbi against all paths, scripts, spans, held-out accuracy, clean texts stay."""

import itertools
import random
from collections import Counter

import numpy as np

from lexquarry.llm import op04_language as op


def test_viterbi_against_all_paths():
    draw = np.random.default_rng(3)
    for _ in range(20):
        sizes = draw.integers(0, 6, 5)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        emission = draw.normal(size=(starts[-1], 3)).astype(np.float32) * 3
        got = op.viterbi(emission, starts, 2.0)
        for lo, hi in zip(starts[:-1], starts[1:]):
            def value(path):
                return sum(emission[lo + i, k] for i, k in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))
            best = max(value(p) for p in itertools.product(range(3), repeat=hi - lo))
            assert abs(value(got[lo:hi]) - best) < 1e-4


WORDS = {
    "en": "the house stands near water and people walk there every morning with their dogs", "de": "das haus steht neben dem wasser und menschen gehen dort jeden morgen",
    "ru": "дом стоит рядом с водой и люди гуляют там каждое утро", "el": "το σπίτι είναι δίπλα στο νερό και οι άνθρωποι περπατούν",
}


def corpus():
    draw = random.Random(1)
    rows = []
    for i in range(300):
        lang = draw.choice(list(WORDS))
        rows.append((i, " ".join(draw.choice(WORDS[lang].split()) for _ in range(draw.randint(3, 30))), lang))
    return rows


def test_scripts_spans_and_accuracy(spark):
    rows = corpus() + [(1000, "дом house стоит", None), (1001, None, "en"), (1002, "123 !!", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = op.learned(docs)
    assert model.names == ["de", "el", "en", "ru"]
    cyrillic = op.SCRIPT_NAMES.index("cyrillic")
    assert model.allowed[cyrillic].tolist() == [False, False, False, True]
    got = {r.doc_id: r for r in op.identify(docs, ["doc_id"], model).collect()}
    held = [(r, got[r[0]]) for r in rows[:300]]
    assert sum(r[2] == g.lang_pred for r, g in held) >= 0.97 * len(held)
    assert got[1000].lang_pred == "ru" and got[1001].lang_pred == got[1002].lang_pred == "und" and got[1002].score == 0.0
    mixed = spark.createDataFrame([(1, WORDS["en"] + " " + WORDS["ru"])], "doc_id long, text string")
    spans = op.identify(mixed, ["doc_id"], model).first().lang_spans
    assert spans == ["en:0:14", "ru:14:25"]


def test_query(spark, folder):
    import pyarrow.parquet as pq

    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()}
    rows = op.op4_language(spark, folder).collect()
    assert Counter(r.doc_id for r in rows) == Counter(lang.keys())
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.score >= 0.5 for r in rows) >= 0.98 * len(rows)


def test_odd_rows(spark, odd, none):
    from conftest import ODD

    labelled = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    model = op.learned(labelled)
    rows = op.identify(odd, ["doc_id"], model).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in ODD)
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"}
    assert op.identify(none, ["doc_id"], model).count() == 0
    untaught = op.learned(labelled.limit(0))
    assert {r.lang_pred for r in op.identify(odd, ["doc_id"], untaught).collect()} == {"und"}


def test_share_of_words(spark):
    lines = [("the house and the garden of the father", "en"), ("das haus und der garten von dem vater", "de")] * 40
    model = op.train(spark.createDataFrame(lines, "text string, lang string"), "text", "lang")
    docs = spark.createDataFrame([(1, "the house and the garden das haus und der garten"), (2, "the house and the garden of the father"), (3, " 12 ")],
                                 "doc_id long, text string")
    got = {r.doc_id: (r.lang_share, r.score) for r in op.identify(docs, ["doc_id"], model).collect()}
    assert got[1][0] == 0.5 and got[1][1] <= 0.5
    assert got[2][0] == 1.0 and got[3] == (0.0, 0.0)
