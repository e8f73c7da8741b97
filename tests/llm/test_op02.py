"""Sharding against a plain best-fit-decreasing loop and the invariants of its law."""

import random
import zlib
from collections import Counter, defaultdict

from lexquarry.llm.op02_sharding import level_sizes, op2_sharding, pack_sizes, shard


def plain(sizes, capacity):
    room, out = [], Counter()
    for s in sorted(sizes, reverse=True):
        fit = [(r, i) for i, r in enumerate(room) if r >= s]
        if fit:
            i = min(fit)[1]
        else:
            room.append(capacity)
            i = len(room) - 1
        room[i] -= s
        out[s, i] += 1
    return out


def test_packing_equals_the_plain_loop():
    draw = random.Random(3)
    for _ in range(60):
        sizes = [draw.choice([draw.randint(1, 100), draw.randint(1, 10)]) for _ in range(draw.randint(1, 200))]
        got = Counter()
        for size, lo, hi, number in pack_sizes(Counter(sizes), 100):
            got[size, number] += hi - lo
        assert got == plain(sizes, 100)


def test_level_covers_ranks_and_sets_large_groups_apart():
    rows = level_sizes(Counter({1000: 2, 10: 50, 3: 100, 1: 40}), 8)
    ranks, load = defaultdict(list), Counter()
    for size, lo, hi, number in rows:
        ranks[size] += range(lo, hi)
        load[number] += size * (hi - lo)
    assert {s: sorted(r) for s, r in ranks.items()} == {1000: [0, 1], 10: list(range(50)), 3: list(range(100)), 1: list(range(40))}
    assert sorted(load.values())[-2:] == [1000, 1000] and max(sorted(load.values())[:6]) - min(load.values()) <= 10


def check(rows, docs):
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in docs)
    text = defaultdict(list)
    for d, t in docs:
        text[d].append(t)
    slots, of_text = defaultdict(list), defaultdict(set)
    for r in rows:
        options = {(len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in text[r.doc_id]}
        assert (r["size"], r.text_crc32) in options
        slots[r.shard].append(r.slot)
        if len(text[r.doc_id]) == 1:
            of_text[text[r.doc_id][0]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())


def test_query(spark, folder, documents):
    rows = op2_sharding(spark, folder).collect()
    check(rows, documents)
    load = Counter()
    for r in rows:
        load[r.shard] += r["size"]
    assert len(load) == 16 and max(load.values()) < 1.02 * min(load.values())


def test_odd_rows(odd, none):
    from conftest import ODD

    check(shard(odd, ["doc_id"], bins=3).collect(), ODD)
    assert shard(none, ["doc_id"]).count() == 0
    by_capacity = shard(odd, ["doc_id"], bins=None, capacity=200_000).collect()
    check(by_capacity, ODD)
    assert max(r.shard for r in by_capacity) == 1
