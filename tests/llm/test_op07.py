"""Hidden Markov model: recursions against all state paths, probabilities that sum to one, base scores, counts, learning."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lexquarry.llm import op07_hmm as op


def small_model(states=2, classes=3, seed=1):
    return op.first_model(states, np.full(classes, 1 / classes), seed)


def plain(model, sequence, start):
    total = 0.0
    for path in itertools.product(range(len(model.start)), repeat=len(sequence)):
        p = start[path[0]]
        for a, b in zip(path, path[1:]):
            p *= model.move[a, b]
        for s, o in zip(path, sequence):
            p *= model.emit[o, s]
        total += p
    return total


def test_forward_is_the_sum_over_paths():
    model = small_model()
    sequences = [[0], [1, 2], [2, 2, 0, 1], [0, 1, 2, 0, 1]]
    flat = np.array(sum(sequences, []))
    lengths = np.array([len(s) for s in sequences])
    got = op.forward_log10(flat, np.cumsum(lengths) - lengths, lengths, model)
    assert np.allclose(10**got, [plain(model, s, model.start) for s in sequences])
    every = np.array(list(itertools.product(range(3), repeat=3)))
    got = op.forward_log10(every.reshape(-1), np.arange(27) * 3, np.full(27, 3), model)
    assert math.isclose((10**got).sum(), 1.0)


def test_counts_are_expectations():
    model, sequence = small_model(), [0, 2, 1, 1]
    total = plain(model, sequence, model.start)
    start, emit, move = np.zeros(2), np.zeros((3, 2)), np.zeros((2, 2))
    for path in itertools.product(range(2), repeat=4):
        p = model.start[path[0]] * math.prod(model.move[a, b] for a, b in zip(path, path[1:])) * math.prod(
            model.emit[o, s] for s, o in zip(path, sequence)) / total
        start[path[0]] += p
        for s, o in zip(path, sequence):
            emit[o, s] += p
        for a, b in zip(path, path[1:]):
            move[a, b] += p
    got = op.expected_counts(np.array(sequence), np.array([0]), np.array([4]), np.array([True]), model)
    assert np.allclose(got[0], start) and np.allclose(got[2], move) and np.allclose(got[3], emit) and np.allclose(got[1], 0)
    assert math.isclose(got[4][0], math.log10(total))


def base_scores(docs, held):
    words = {d: [w for w in (t or "").encode().lower().split()] for d, t in docs}
    count, n_end = Counter(w for d, ws in words.items() if not held[d] for w in ws), sum(not held[d] for d, _ in docs)
    n, v = sum(count.values()) + n_end, len(count) + (n_end > 0)
    out = {}
    for d, ws in words.items():
        c = [count[w] for w in ws] + [n_end]
        out[d] = len(c), sum(x > 0 for x in c), n, sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in c)
    return out


def check(rows, docs):
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in docs}
    want = base_scores(docs, held)
    for r in rows:
        assert r.held_out == held[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert math.isclose(r.base_score, want[r.doc_id][3], rel_tol=1e-9)
    assert len(rows) == len(docs)


def test_query_and_held_out_gain(spark, folder, documents):
    rows = op.op7_hmm(spark, folder).collect()
    check(rows, documents)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_rounds_raise_the_likelihood(spark, documents):
    docs = spark.createDataFrame(documents[:60], "doc_id long, text string")
    lex = op.lexicon(op.word_counts(docs, "text"), 60, 50, 1000)
    seen = op.observed(docs, ["doc_id"], "text", spark.sparkContext.broadcast(lex), 50).cache()
    model = op.first_model(3, np.full(50 + op.HASHED + 1, 1 / (50 + op.HASHED + 1)))
    likely = []
    for _ in range(5):
        model, one = op.baum_welch(seen, model)
        likely.append(one)
    assert likely == sorted(likely)


def test_few_shared_words_change_nothing(spark, documents):
    docs = spark.createDataFrame(documents[:80], "doc_id long, text string")
    held = op.remainder(F.col("doc_id"), 10) == 0
    few = op.score_texts(docs, ["doc_id"], held, iterations=1, own_classes=10, shared_words=20).collect()
    many = {r.doc_id: r for r in op.score_texts(docs, ["doc_id"], held, iterations=1, own_classes=10, shared_words=10**6).collect()}
    check(few, documents[:80])
    assert all(math.isclose(r.score, many[r.doc_id].score, rel_tol=1e-9) for r in few)


def test_odd_rows(spark, odd, none):
    from conftest import ODD

    held = op.remainder(F.col("doc_id"), 10) == 0
    rows = op.score_texts(odd, ["doc_id"], held, iterations=1).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in ODD)
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert all(r.held_out for r in rows if r.doc_id is None)
    assert op.score_texts(none, ["doc_id"], held, iterations=1).count() == 0
    untaught = op.score_texts(odd, ["doc_id"], F.lit(True), iterations=1).collect()
    assert {r.train_tokens for r in untaught} == {0} and all(r.base_score == 0 for r in untaught)


def test_a_partition_of_texts_without_words(spark):
    rows = [(i, text) for i, text in enumerate([None, "", " \t", "\n"] * 3)] + [(100, "a text with words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(4, "doc_id")
    held = op.remainder(F.col("doc_id"), 10) == 0
    got = {r.doc_id: r for r in op.score_texts(docs, ["doc_id"], held, iterations=1).collect()}
    assert len(got) == 13 and all(math.isfinite(r.score) for r in got.values())
    assert {r.n_tokens for d, r in got.items() if d != 100} == {1}
    blank = op.score_texts(docs.where("doc_id < 100").coalesce(1), ["doc_id"], held, iterations=1)
    assert blank.count() == 12
