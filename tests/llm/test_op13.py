"""The prefix trie against a plain one."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

from lexquarry.llm.op13_prefix_trie import OP13_SQL, TernaryTree, middle_first, op13_prefix_trie, prefix_trie, rebuilt

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def name_of(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def plain(rows):
    """Nodes of the rebuilt conversations, by dictionaries of prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, name_of(role, text), role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        path = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids = Counter(p[:-1] for p in members if p)
    out = []
    for p, convs in members.items():
        under = [q for q in members if q[:len(p)] == p]
        sha = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((
            min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), kids[p], sum(not kids[q] for q in under),
            sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q), sha))
    return Counter(out)


def drawn(seed, n):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(-150, 900), n):
        for t in range(draw.choice([1, 2, 3, 3, 9])):
            rows.append((c, t, draw.choice(["user", "assistant"]), draw.choice(["a", "bb", "cé", "ddd"])))
    draw.shuffle(rows)
    return rows


def test_against_plain(spark):
    for seed, n, piece in ((1, 120, 1_000_000), (2, 90, 1), (3, 150, 20), (4, 1, 5)):
        rows = drawn(seed, n)
        found = prefix_trie(rebuilt(spark.createDataFrame(rows, SCHEMA)), piece).select(COLUMNS).collect()
        assert Counter(map(tuple, found)) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "no conversation"), (1, None, "user", "first"), (1, 2, None, "no role"), (1, 1, "user", None), (1, 1, "user", None),
        (2, 0, "", ""), (2, 1, None, None), (3, 5, "user", "x" * 200_000), (3, 5, "user", "tie"), (3, 5, "user", "tie"), (101, 0, "u", "own"),
        (7, None, None, None), *((4, t, "user", f"turn {t}") for t in range(300)), *((c, 0, "system", "one start") for c in range(400, 460)),
    ]
    frame = spark.createDataFrame([(*r, "k", 0) for r in rows], SCHEMA + ", key string, depth long")
    for piece in (1_000_000, 40):
        found = prefix_trie(rebuilt(frame), piece).select(COLUMNS).collect()
        assert Counter(map(tuple, found)) == plain(rows)
    assert prefix_trie(rebuilt(spark.createDataFrame([], SCHEMA))).count() == 0
    assert prefix_trie(rebuilt(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA))).count() == 0


def test_tree_is_balanced():
    assert sorted(middle_first(10)) == list(range(10)) and next(middle_first(9)) == 4
    tree = TernaryTree()
    for i in middle_first(1000):
        tree.add([i], i)
    steps = []
    for i in range(1000):
        at, n = tree.equal[0], 1
        while tree.code[at] != i:
            at, n = (tree.low if i < tree.code[at] else tree.high)[at], n + 1
        steps.append(n)
    assert max(steps) <= 10


def test_query_and_sql(spark, folder):
    import duckdb
    import pyarrow.parquet as pq

    rows = [tuple(r.values()) for r in pq.read_table(f"{folder}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()]
    want = plain(rows)
    assert Counter(map(tuple, op13_prefix_trie(spark, folder).select(COLUMNS).collect())) == want
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    assert Counter(db.sql(f"SELECT {', '.join(COLUMNS)} FROM ({OP13_SQL})").fetchall()) == want
