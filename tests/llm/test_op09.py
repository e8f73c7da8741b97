"""Packing: exact ids, whole coverage, no overlap, little padding."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from lexquarry.llm.op09_packing import op9_packing, pack, pieces, plan_rows, shortest_pack_first, vocabulary_path


def ids_of(text):
    return Tokenizer.from_file(vocabulary_path()).encode(text or "", add_special_tokens=False).ids + [2]


def test_patterns_place_every_piece_once():
    draw = random.Random(2)
    for _ in range(40):
        histogram = Counter(draw.choice([draw.randint(1, 64), draw.randint(1, 9), 40]) for _ in range(draw.randint(1, 400)))
        patterns = shortest_pack_first(histogram, 64)
        placed, rows = Counter(), plan_rows(patterns)
        for count, pattern in patterns:
            assert sum(n * t for n, t in pattern) <= 64
            for n, t in pattern:
                placed[n] += count * t
        assert placed == histogram
        for n, k in histogram.items():
            assert sorted(r for row in rows if row[0] == n for r in range(row[1], row[2])) == list(range(k))


def check(rows, docs):
    """rows of one document each with distinct ids."""
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        of_doc[r.doc_id].append(r)
        of_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(of_doc) == {d for d, _ in docs}
    for d, text in docs:
        ids, at = ids_of(text), 0
        for r in sorted(of_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for places in of_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert sorted(of_sequence) == list(range(len(of_sequence)))


def test_query(spark, folder, documents):
    rows = op9_packing(spark, folder).collect()
    check(rows, documents)
    assert sum(r.length for r in rows) > 0.97 * 4096 * (1 + max(r.sequence_id for r in rows))


def test_odd_rows(spark, none):
    from conftest import ODD

    docs = [(i, t) for i, (_, t) in enumerate(ODD)] + [(100, "it's İstanbul 12 a1b2 naïve don't. ﬁ Å Å ... x¨y"), (101, "K Ω ΑΣ ΣΑΣ ǅ")]
    cut = pieces(spark.createDataFrame(docs, "doc_id long, text string"), ["doc_id"], vocabulary_path(), with_ids=True)
    rows = cut.collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    check(pack(cut.drop("ids"), ["doc_id", "start"]).collect(), docs)
    repeated = spark.createDataFrame([(None, None), (None, None), (1, "a"), (1, "a")], "doc_id long, text string")
    packed = pack(pieces(repeated, ["doc_id"], vocabulary_path()), ["doc_id", "start"]).collect()
    assert sorted((r.length, r.offset, r.sequence_id) for r in packed) == [(1, 4, 0), (1, 5, 0), (2, 0, 0), (2, 2, 0)]
    assert pack(pieces(none, ["doc_id"], vocabulary_path()), ["doc_id"]).count() == 0
