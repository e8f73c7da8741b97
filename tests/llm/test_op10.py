"""SimHash links and components against brute force."""

import random
from collections import Counter

import xxhash

from lexquarry.llm.op10_simhash import BKTree, fingerprints, links, near_duplicates, op10_simhash


def plain_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, radius):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = sorted(parent)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    return {p: root(p) for p in values}


def test_query(spark, folder, documents):
    rows = op10_simhash(spark, folder).collect()
    prints = {d: plain_print(t) for d, t in documents}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == prints
    root = plain_classes(prints.values(), 2)
    least = {}
    for d, p in sorted(prints.items(), reverse=True):
        least[root[p]] = d
    assert {r.doc_id: r.component_id for r in rows} == {d: least[root[p]] for d, p in prints.items()}


def test_links_connect_what_brute_force_connects(spark):
    draw = random.Random(1)
    for radius, tree_rows in ((2, 20_000), (2, 3), (1, 2), (3, 5)):
        seeds = [draw.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
        values = set(seeds)
        for _ in range(240):
            v = draw.choice(list(values))
            for b in draw.sample(range(64), draw.randint(1, 5)):
                v ^= 1 << b
            values.add(v)
        signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
        found = links(spark.createDataFrame(signed, "simhash long"), radius, tree_rows).collect()
        assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= radius for r in found)
        from lexquarry.llm.shared import components

        frame = spark.createDataFrame(found, "a long, b long")
        stars = {r.node: r.root for r in components(frame).collect()}
        want = plain_classes(values, radius)
        groups = lambda m: Counter(frozenset(k for k, v in m.items() if v == g) for g in set(m.values()))
        named = {v & (1 << 64) - 1: stars.get(v, v) & (1 << 64) - 1 for (v,) in signed}
        assert groups(named) == groups(want)


def test_tree_follows_edges():
    draw, tree = random.Random(4), BKTree()
    values = list({draw.getrandbits(16) for _ in range(500)})
    for v in values:
        tree.add(v)
    for v in values[:50]:
        assert sorted(tree.near(v, 2)) == sorted(x for x in values if (x ^ v).bit_count() <= 2)


def test_odd_rows(spark, odd, none):
    from conftest import ODD

    rows = near_duplicates(odd, ["doc_id"]).collect()
    prints = [(d, plain_print(t)) for d, t in ODD]
    assert Counter((r.doc_id, r.simhash & (1 << 64) - 1) for r in rows) == Counter(prints)
    zero = {r.component_id for r in rows if r.simhash == 0}
    assert zero == {1}
    assert {r.component_id for r in rows if r.doc_id in (8, 9)} == {8}
    assert near_duplicates(none, ["doc_id"]).count() == 0
    assert fingerprints(none, ["doc_id"]).count() == 0
    only = near_duplicates(spark.createDataFrame([(None, "x y z")], "doc_id long, text string"), ["doc_id"]).collect()
    assert [(r.doc_id, r.component_id) for r in only] == [(None, None)]
