"""Prefix trie of conversations, from ternary search trees of range shards.

A turn is known by 128 bits of a digest of its role and text, a conversation by the sequence of its turns.  Equal sequences are one row
with their number, smallest conversation and the digest of their conversations.  The rows are dealt by ranges of sequences, and a task
cuts its range into pieces of ``piece_turns`` turns.  In a piece the turns are numbered by a dictionary and the sequences enter a
ternary search tree, the middle one first, then those of both halves; one pass from the last node to the first adds up members,
leaves and savings.  Nodes on the first or last sequence of a piece may go on in another one.  Their parts are merged by a digest of
the prefix, and their subtrees are summed by doubling the distance to the ancestor, so the rounds grow with the logarithm of the depth.
All other nodes are whole within their piece.

Equal sequences are counted before they are dealt; their conversations are joined in chunks of ids, so a sequence that a third of all
conversations share sends one row for a chunk.  A conversation is one row of 20 bytes a turn, and is folded in one task.

Defined results: turns go by number, null first, and turns of one number by their digest, so repeated turns stay; null role or text is
empty; rows without a conv_id belong to no conversation and are left out; an empty table has no nodes, not even the root.  Further
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexquarry.llm.shared import reliable_checkpoint, stored
from lexquarry.sizing import join_bounded

#: Conversations of a hundred share the head of the first one; so many of its turns at most.
FAMILY, HEADS = 100, 6
#: Turns of the sequences that one tree takes.
PIECE_TURNS = 1_000_000
#: 2 ** CHUNK_BITS ids at most are joined in one row.
CHUNK_BITS = 10
NO_ENDS = hashlib.sha256(b"").hexdigest()
ROOT = b"\0" * 16


def digest(role: Column, text: Column) -> Column:
    """32 hex digits that name a turn."""
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.sha2(whole.cast("binary"), 256), 1, 32)


def sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id`` and ``own``: its turns in order, as structs of turn id and code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(
        F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"), F.unhex(digest(role, text)).alias("id"),
        F.length(text).alias("size"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    own = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size")))
    return rows.groupBy("conv_id").agg(own.alias("own"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id`` and ``path``: the first h turns of the family's first conversation, then the own turns after the first h.

    h = crc32(decimal conv_id) % 6.
    """
    own = stored(sequences(conversations))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    none = F.slice("own", 1, 0)
    path = F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("own", h + 1, F.size("own")))
    return own.withColumn("base", base).join(heads, "base", "left").select("conv_id", path.alias("path"))


def distinct_paths(paths: DataFrame) -> DataFrame:
    """``ids``, ``sizes``, ``n``, ``least`` and ``ends`` (SHA-256 of the conversations, comma-joined) of every distinct path."""
    ids, sizes = F.transform("path", lambda t: t["id"]), F.transform("path", lambda t: t["size"])
    key = F.unhex(F.sha2(F.array_join(F.transform("path", lambda t: F.hex(t["id"])), "").cast("binary"), 256))
    rows = stored(paths.select("conv_id", key.alias("key"), ids.alias("ids"), sizes.alias("sizes")))
    whole = rows.groupBy("key").agg(
        F.first("ids").alias("ids"), F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    chunks = rows.groupBy("key", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("part"))
    chunks = chunks.repartition("key").sortWithinPartitions("key", "chunk").select("key", "part")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            keys, ends = [], []
            for key, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key == now:
                    state.update(b",")
                else:
                    if now is not None:
                        keys.append(now)
                        ends.append(state.digest())
                    now, state = key, hashlib.sha256()
                state.update(part.encode())
            if keys:
                yield pa.RecordBatch.from_pydict({"of": pa.array(keys, pa.binary()), "ends": pa.array(ends, pa.binary())})
        if now is not None:
            yield pa.RecordBatch.from_pydict({"of": pa.array([now], pa.binary()), "ends": pa.array([state.digest()], pa.binary())})

    ended = chunks.mapInArrow(joined, "of binary, ends binary")
    return whole.join(ended, F.col("key") == F.col("of")).select("ids", "sizes", "n", "least", "ends")


class TernaryTree:
    """A ternary search tree of sequences of numbers.  Node 0 is the empty prefix; parents come before their children."""

    def __init__(self) -> None:
        self.code, self.low, self.equal, self.high = [-1], [0], [0], [0]
        self.above, self.depth, self.path = [-1], [0], [-1]

    def _new(self, code: int, above: int) -> int:
        self.code.append(code)
        for links in (self.low, self.equal, self.high):
            links.append(0)
        self.above.append(above)
        self.depth.append(self.depth[above] + 1)
        self.path.append(-1)
        return len(self.code) - 1

    def add(self, codes: list[int], number: int) -> None:
        """Insert sequence ``number``; its last node keeps the number."""
        code, low, equal, high = self.code, self.low, self.equal, self.high
        above = 0
        for c in codes:
            at = equal[above]
            if not at:
                at = equal[above] = self._new(c, above)
            while code[at] != c:
                side = low if c < code[at] else high
                if not side[at]:
                    side[at] = self._new(c, above)
                at = side[at]
            above = at
        self.path[above] = number

    def chain(self, codes: list[int]) -> list[int]:
        """The nodes of a stored sequence, the empty prefix first."""
        out = [0]
        for c in codes:
            at = self.equal[out[-1]]
            while self.code[at] != c:
                at = self.low[at] if c < self.code[at] else self.high[at]
            out.append(at)
        return out


def middle_first(n: int) -> Iterator[int]:
    """0 to n - 1: the middle of a range, then the middles of both halves."""
    todo = [(0, n)]
    for lo, hi in todo:
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            todo += ((lo, mid), (mid + 1, hi))


NODES = ("key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved long, size long, ends binary")
KINDS = [pa.binary(), pa.binary(), *[pa.int64()] * 8, pa.binary()]
NAMES = [f.split()[0] for f in NODES.split(", ")]


def piece_nodes(rows: list[tuple]) -> pa.RecordBatch:
    """The nodes of a range of sorted paths (ids, sizes, n, least, ends).

    A node on the first or last path has a ``key`` and counts only its own members below, without those of children with a key.
    """
    numbers = {t: i for i, t in enumerate(sorted({t for ids, *_ in rows for t in ids}))}
    coded = [[numbers[t] for t in ids] for ids, *_ in rows]
    tree = TernaryTree()
    for i in middle_first(len(rows)):
        tree.add(coded[i], i)
    names = list(numbers)
    size_of = np.zeros(len(names), np.int64)
    for codes, (_, sizes, *_) in zip(coded, rows):
        size_of[codes] = sizes
    n = len(tree.code)
    keys: dict[int, bytes] = {0: ROOT}
    for codes in (coded[0], coded[-1]):
        chain = tree.chain(codes)
        for above, at in zip(chain, chain[1:]):
            keys[at] = hashlib.sha256(keys[above] + names[tree.code[at]]).digest()[:16]
    size = [0, *size_of[np.array(tree.code[1:], np.int64)].tolist()]
    convs, least, kids, leaves, saved = [0] * n, [None] * n, [0] * n, [0] * n, [0] * n
    for at in range(n - 1, -1, -1):
        if tree.path[at] >= 0:
            _, _, here, first, _ = rows[tree.path[at]]
            convs[at] += here
            least[at] = first if least[at] is None else min(first, least[at])
        open_ended = at in keys
        if not open_ended:
            leaves[at] = leaves[at] or 1
            saved[at] += (convs[at] - 1) * size[at]
        above = tree.above[at]
        if above >= 0:
            convs[above] += convs[at]
            least[above] = least[at] if least[above] is None else min(least[at], least[above])
            if not open_ended:
                kids[above] += 1
                leaves[above] += leaves[at]
                saved[above] += saved[at]
    parent = [None if at == 0 or tree.above[at] in keys else least[tree.above[at]] for at in range(n)]
    columns = [
        [keys.get(at) for at in range(n)], [None if at == 0 else keys.get(tree.above[at]) for at in range(n)], least, tree.depth, parent,
        convs, kids, leaves, saved, size, [rows[p][4] if p >= 0 else None for p in tree.path]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS)], names=NAMES)


def shard_nodes(paths: DataFrame, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """The nodes of all pieces."""
    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = paths.select("ids", "sizes", "n", "least", "ends").repartitionByRange(parts, "ids").sortWithinPartitions("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, turns = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if piece and turns + len(row[0]) > piece_turns:
                    yield piece_nodes(piece)
                    piece, turns = [], 0
                piece.append(row)
                turns += len(row[0])
        if piece:
            yield piece_nodes(piece)

    return ranges.mapInArrow(run, NODES)


def merged(parts: DataFrame) -> DataFrame:
    """Nodes with a key, whole: those of all pieces merged, and leaves and savings of their subtrees."""
    one = parts.groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")), F.max("size").alias("size"), F.max("ends").alias("ends"))
    one = stored(one)
    below = one.where("parent_key is not null").groupBy(F.col("parent_key").alias("of")).agg(F.count(F.lit(1)).alias("more"))
    children = F.col("n_children") + F.coalesce("more", F.lit(0))
    whole = stored(one.join(below, F.col("key") == F.col("of"), "left").select(
        "key", "parent_key", "conv_id", "depth", "n_convs", children.alias("n_children"), "ends",
        F.when(children == 0, 1).otherwise(F.col("n_leaves")).cast("long").alias("leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("size")).alias("saved")))
    sums = whole.select("key", F.col("parent_key").alias("up"), "leaves", "saved")
    deepest = whole.agg(F.max("depth")).first()[0] or 0
    for _ in range(int(deepest).bit_length()):
        more = sums.where("up is not null").groupBy(F.col("up").alias("to")).agg(
            F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        farther = sums.select(F.col("key").alias("via"), F.col("up").alias("beyond"))
        sums = reliable_checkpoint(
            sums.join(more, F.col("key") == F.col("to"), "left").join(farther, F.col("up") == F.col("via"), "left").select(
                "key", F.col("beyond").alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")))
    total = sums.select(F.col("key").alias("k"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    above = whole.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return whole.join(total, F.col("key") == F.col("k")).join(above, F.col("parent_key") == F.col("parent"), "left").select(
        "key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")


def prefix_trie(paths: DataFrame, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """One row for every distinct prefix of the paths (``conv_id``, ``path`` of structs of turn id and size)."""
    nodes = stored(shard_nodes(distinct_paths(paths), piece_turns))
    border = stored(merged(nodes.where("key is not null")))
    ends = F.coalesce(F.lower(F.hex("ends")), F.lit(NO_ENDS)).alias("ends_sha256")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends]
    inner = nodes.where("key is null").withColumnRenamed("saved", "saved_tokens")
    deep = inner.where("parent_key is null").select(*columns)
    top = inner.where("parent_key is not null").drop("parent_conv_id", "key")
    parents = border.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return border.select(*columns).unionByName(deep).unionByName(join_bounded(top, parents, ["parent_key"], "left").select(*columns))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    conversations = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return prefix_trie(rebuilt(conversations))


# CRC-32 by its definition: eight steps for each byte, reflected polynomial 0xEDB88320.
_STEP = "lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)"
OP13_SQL = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, left(sha256(length(role)::VARCHAR || ':' || role || text), 32)) AS t
  FROM turns GROUP BY conv_id),
shares AS (SELECT *, xor(list_reduce([4294967295::UBIGINT] || list_transform(range(1, length(conv_id::VARCHAR) + 1),
    lambda i: ascii(substring(conv_id::VARCHAR, i, 1))::UBIGINT), lambda c, b: list_reduce([xor(c, b)] || repeat([0::UBIGINT], 8), {_STEP})),
    4294967295::UBIGINT) % {HEADS} AS h FROM own),
built AS MATERIALIZED (SELECT s.conv_id, coalesce(b.t[1:s.h], []) || s.t[s.h + 1:] AS p
  FROM shares s LEFT JOIN own b ON b.conv_id = s.conv_id - s.conv_id % {FAMILY}),
named AS MATERIALIZED (SELECT conv_id, p, list_transform(range(0, len(p) + 1), lambda d: sha256(p[1:d]::VARCHAR)) AS k FROM built),
members AS (SELECT conv_id, unnest(range(0, len(p) + 1)) AS d, len(p) AS n, k, p FROM named),
nodes AS MATERIALIZED (SELECT k[d + 1] AS key, min(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(k[d]) AS parent,
    any_value(coalesce(length(p[d].text), 0)) AS size, any_value(k[1:d + 1]) AS chain,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM members GROUP BY k[d + 1]),
kids AS (SELECT parent, count(*) AS c FROM nodes WHERE depth > 0 GROUP BY parent),
below AS (SELECT a.key, sum(a.leaf) AS n_leaves, sum(a.saved) AS saved_tokens
  FROM (SELECT unnest(chain) AS key, CASE WHEN c IS NULL THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * size AS saved
    FROM nodes LEFT JOIN kids ON kids.parent = nodes.key) a GROUP BY a.key)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(kids.c, 0)::BIGINT AS n_children,
  below.n_leaves::BIGINT AS n_leaves, below.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below ON below.key = n.key LEFT JOIN kids ON kids.parent = n.key
LEFT JOIN nodes u ON n.depth > 0 AND u.key = n.parent"""
