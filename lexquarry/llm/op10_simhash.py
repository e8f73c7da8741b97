"""SimHash near-duplicates, linked through BK-trees.

A fingerprint has a bit for each of the 64 bits of the shingles' hashes, set where more than half of them have it.  Distinct
fingerprints (with the smallest doc_id of each) are cut into ``radius + 2`` blocks of bits; two fingerprints within the radius agree
on at least two whole blocks, so every pair of blocks with its values names a shard, and each link lies in at least one shard.  In a
shard the fingerprints enter a BK-tree (children keyed by their Hamming distance to the parent) and a search follows only the edges
that can lead inside the radius.  A shard of more than ``tree_rows`` fingerprints is cut into several trees that are sent to as many
tasks; its fingerprints search the trees before their own, so each pair is still met once and no tree outgrows a task.  A shard
returns the links of a spanning forest, not all pairs; stars on the links give the components.

The search runs over distinct fingerprints, so copies of one text cost one row.  Nothing but round counters reaches the driver.

Defined results: null and empty texts have the fingerprint zero, as have texts without words; fewer words than a shingle are one
shingle; rows with a null doc_id are fingerprinted and linked but never name a component (null if no other row can); repeated rows
come back as often as they came in; extra columns are carried only if named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lexquarry.llm.shared import carries, components, reliable_checkpoint, stored
from lexquarry.llm.words import LOWER, mixed, per_text, translated
from lexquarry.sizing import fits

SHINGLE = 3
RADIUS = 2
SEED = 42
TREE_ROWS = 20_000


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """SimHash of a sequence of words, as a signed 64-bit number."""
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(shingle, len(words))
    one = xxhash.xxh64_intdigest
    hashes = np.array(
        [one(joined[s:e], SEED) for s, e in zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist())], ">u8")
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[lo:lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``keep`` and ``simhash`` (signed 64 bits) of every row."""

    def make():
        def one(texts):
            raw = translated(texts, LOWER).cast(pa.binary())
            return [[fingerprint(t.as_py().split(), shingle) for t in raw]]

        return one

    return per_text(docs, keep, text, [("simhash", T.LongType())], make)


class BKTree:
    """Numbers under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        at = 0
        while at != new:
            at = self.children[at].setdefault((self.values[at] ^ value).bit_count(), new)

    def near(self, value: int, radius: int) -> Iterator[int]:
        """Stored numbers at most ``radius`` bits away."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            away = (self.values[at] ^ value).bit_count()
            if away <= radius:
                yield self.values[at]
            below = self.children[at]
            if len(below) <= 2 * radius + 1:
                todo += [c for d, c in below.items() if away - radius <= d <= away + radius]
            else:
                todo += [below[d] for d in range(away - radius, away + radius + 1) if d in below]


class Forest:
    """Links of a spanning forest of one shard, tree members first."""

    def __init__(self, radius: int):
        self.radius, self.tree, self.parent = radius, BKTree(), {}

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def add(self, value: int, stays: bool) -> Iterator[tuple[int, int]]:
        """Links of a further fingerprint; it enters the tree if it ``stays``."""
        for other in self.tree.near(value, self.radius):
            a, b = self.root(value), self.root(other)
            if a != b:
                self.parent[a] = b
                yield value, other
        if stays:
            self.tree.add(value)


def shard_keys(value: Column, radius: int) -> Column:
    """Arrays of (pair of blocks, their bits) of a fingerprint."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    parts = [F.shiftrightunsigned(F.shiftleft(value, 64 - hi), 64 - hi + lo) for lo, hi in zip(edges, edges[1:])]
    return F.array(*(
        F.struct(F.lit(k).alias("pair"), parts[i].alias("x"), parts[j].alias("y"))
        for k, (i, j) in enumerate(combinations(range(n), 2))))


def links(prints: DataFrame, radius: int = RADIUS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """``a``, ``b``: links that connect all distinct numbers ``simhash`` within the radius, directly or over others."""
    shard = ["pair", "x", "y"]
    rows = prints.select("simhash", F.explode(shard_keys(F.col("simhash"), radius)).alias("s")).select("simhash", "s.*")
    sizes = rows.groupBy(*shard).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(sizes, shard)
    trees = F.ceil(F.col("n") / tree_rows).cast("int")
    own = F.pmod(F.xxhash64("simhash"), trees).cast("int")
    rows = rows.withColumn("own", own).withColumn(
        "tree", F.explode(F.when(F.col("n") > tree_rows, F.sequence(F.lit(0), "own")).otherwise(F.array("own"))))
    rows = rows.select(*shard, "tree", "simhash", (F.col("own") == F.col("tree")).alias("stays"))
    rows = rows.repartition(*shard, "tree").sortWithinPartitions(*shard, "tree", F.desc("stays"), "simhash")

    def run(batches):
        key, shard_links = None, Forest(radius)
        for batch in batches:
            found = []
            for *place, value, stays in zip(*(c.to_pylist() for c in batch.columns)):
                if place != key:
                    key, shard_links = place, Forest(radius)
                found += shard_links.add(value & 0xFFFFFFFFFFFFFFFF, stays)
            if found:
                both = np.array(found, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


@carries("simhash", "component_id")
def near_duplicates(
    docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
    radius: int = RADIUS, tree_rows: int = TREE_ROWS,
) -> DataFrame:
    """``keep``, ``simhash`` and ``component_id`` (smallest ``doc_id`` reachable over links) of every row."""
    carried = list(dict.fromkeys([doc_id, *keep]))
    prints = reliable_checkpoint(fingerprints(docs, carried, text, shingle))
    distinct = reliable_checkpoint(prints.groupBy("simhash").agg(F.min(doc_id).alias("least")))
    stars = components(links(distinct, radius, tree_rows))
    rooted = distinct.join(stars, F.col("simhash") == F.col("node"), "left").select(
        F.col("simhash").alias("print"), "least", F.coalesce("root", "simhash").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    classes = rooted.join(named, F.col("root") == F.col("r")).select("print", "component_id")
    return prints.join(classes, F.col("simhash") == F.col("print")).select(*keep, "simhash", "component_id")


KEYS = 10
BINS = 256
#: What a sketch may miss of the true similarity: six standard deviations for long texts at 0.8.
MARGIN = 0.15
#: Texts, and shingles of all of them, that one task compares exactly.
SET_ROWS = 2_000
SET_SHINGLES = 4_000_000
#: Representatives of loosely linked texts that are broadcast to the texts; more are shuffled with them.
LOOSE_ROWS = 1_000_000
#: For quotients of whole numbers: far below the distance of two different ones.
SLACK = 1e-9


def shingles(words: list[bytes], shingle: int) -> np.ndarray:
    """Sorted hashes of the set of shingles; fewer words than a shingle are one."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(shingle, len(words))
    one = xxhash.xxh3_64_intdigest
    return np.unique(np.array(
        [one(joined[s:e]) for s, e in zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist())], np.uint64))


def signature(hashes: np.ndarray) -> tuple[int, list[int], bytes]:
    """Size, ``KEYS`` min-hash keys and a sketch of ``BINS`` smallest hashes (16 bits each) of a set of shingles."""
    if not len(hashes):
        return 0, [0] * KEYS, b"\0" * (2 * BINS)
    keys = [int(mixed(hashes + np.uint64(k << 32)).min()) - (1 << 63) for k in range(1, KEYS + 1)]
    bins, first = np.unique(hashes >> np.uint64(56), return_index=True)
    sketch = np.zeros(BINS, "<u2")
    sketch[bins.astype(np.int64)] = (mixed(hashes[first]) & np.uint64(0xFFFF)) | np.uint64(1)  # zero: no shingle in the bin
    return len(hashes), keys, sketch.tobytes()


def sketch_shares(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Shares of equal bins, an estimate of the similarity."""
    there = np.stack(others)
    return ((there == own) & (own != 0)).sum(1) / np.maximum(((there != 0) | (own != 0)).sum(1), 1)


def jaccard_shares(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarities of a set with others, none of them empty."""
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    flat = np.concatenate(others)
    same = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
    common = np.add.reduceat(same, np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.int64)
    return common / (len(own) + sizes - common)


class SimilarForest:
    """Links of a spanning forest of texts whose ``shares`` reach ``least``.

    Texts are compared with all whose size allows ``similarity``, but not with those that they are already linked to over others.
    """

    BLOCK = 128

    def __init__(self, similarity: float, shares: Callable[[np.ndarray, list[np.ndarray]], np.ndarray], least: float):
        self.similarity, self.shares, self.least = similarity - SLACK, shares, least - SLACK
        self.names: list[bytes] = []
        self.items: list[np.ndarray] = []
        self.sizes, self.groups, self.made = np.zeros(16, np.int64), np.zeros(16, np.int64), 0

    def add(self, name: bytes, size: int, item: np.ndarray, stays: bool) -> Iterator[tuple[bytes, bytes]]:
        """Links of a further text; later ones are compared with it if it ``stays``."""
        n, own = len(self.names), self.made
        self.made += 1
        sizes, groups = self.sizes[:n], self.groups[:n]
        fit = np.flatnonzero((sizes >= self.similarity * size) & (sizes * self.similarity <= size))
        for lo in range(0, len(fit), self.BLOCK):
            block = fit[lo:lo + self.BLOCK]
            block = block[groups[block] != own]
            if not len(block):
                continue
            for i in block[self.shares(item, [self.items[k] for k in block.tolist()]) >= self.least].tolist():
                if groups[i] != own:
                    groups[groups == groups[i]] = own
                    yield name, self.names[i]
        if stays:
            if n == len(self.sizes):
                self.sizes, self.groups = np.resize(self.sizes, 2 * n), np.resize(self.groups, 2 * n)
            self.sizes[n], self.groups[n] = size, own
            self.names.append(name)
            self.items.append(item)


def _forests(rows: DataFrame, place: list[str], make: Callable[[], SimilarForest], read: Callable[[bytes], np.ndarray]) -> DataFrame:
    """``a``, ``b``: links of the forests of all places, of rows (place, name, size, content, stays); ``read`` gives the item of a content."""
    rows = rows.select(*place, "name", "size", "content", "stays")
    rows = rows.repartition(*place).sortWithinPartitions(*place, F.desc("stays"), "name")

    def run(batches):
        at, forest = None, make()
        for batch in batches:
            found = []
            for *now, name, size, content, stays in zip(*(c.to_pylist() for c in batch.columns)):
                if now != at:
                    at, forest = now, make()
                found += forest.add(name, size, read(content), stays)
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary").distinct()


def _dealt(rows: DataFrame, trees: Column) -> DataFrame:
    """Rows dealt to ``tree``s by name: each stays in its own one and searches those before it, so that every pair is met once."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("name"), trees).cast("int"))
    return rows.withColumn("tree", F.explode(F.sequence(F.lit(0), "own"))).withColumn("stays", F.col("own") == F.col("tree"))


def similar_links(texts: DataFrame, similarity: float, tree_rows: int = TREE_ROWS) -> DataFrame:
    """``a``, ``b``: links that connect all texts that may be similar, of rows (name, size, keys, sketch).

    Two texts of similarity s share a min-hash key with probability s, so they miss each other in all ``KEYS`` shards with (1 - s) **
    ``KEYS`` (0.0000001 for 0.8); their sketches miss each other with less than that.  Nothing else is lost: a shard with more than
    ``tree_rows`` texts (a passage that many share) is cut into several trees as in ``links``, which meets every pair of it.
    """
    shard = ["k", "key"]
    rows = texts.select("name", "size", F.posexplode("keys").alias("k", "key"))
    sizes = rows.groupBy(*shard).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = _dealt(rows.join(sizes, shard), F.ceil(F.col("n") / tree_rows))
    # only texts with company carry their sketch on
    rows = rows.join(texts.select(F.col("name").alias("of"), F.col("sketch").alias("content")), F.col("name") == F.col("of"))
    return _forests(rows, [*shard, "tree"], lambda: SimilarForest(similarity, sketch_shares, similarity - MARGIN),
                    lambda sketch: np.frombuffer(sketch, "<u2"))


def exact_links(
    members: DataFrame, contents: DataFrame, similarity: float, shingle: int, set_rows: int = SET_ROWS, set_shingles: int = SET_SHINGLES,
) -> DataFrame:
    """``a``, ``b``: links that connect the texts of each group by the Jaccard similarity of their shingles.

    ``members``: name, size, group, and the number of a row that has the text; ``contents``: number and text.  Only texts of groups are
    moved.  A group of more than ``set_rows`` texts or ``set_shingles`` shingles is cut into several trees as in ``links``.
    """
    trees = F.greatest(F.ceil(F.count(F.lit(1)) / set_rows), F.ceil(F.sum("size") / set_shingles))
    cuts = members.groupBy("group").agg(trees.alias("trees")).withColumnRenamed("group", "g")
    members = stored(members.join(cuts, F.col("group") == F.col("g")).select("name", "size", "group", "number", "trees"))
    if fits(members, LOOSE_ROWS):
        members = F.broadcast(members)
    rows = contents.withColumnRenamed("number", "of").join(members, F.col("of") == F.col("number"))
    rows = _dealt(rows.withColumn("content", F.coalesce("text", F.lit(""))), F.col("trees"))

    def read(text: str) -> np.ndarray:
        return shingles(translated(pa.array([text], pa.string()), LOWER).cast(pa.binary())[0].as_py().split(), shingle)

    return _forests(rows, ["group", "tree"], lambda: SimilarForest(similarity, jaccard_shares, similarity), read)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows of ``docs`` without near duplicates: of each group of texts linked by ``similarity`` of their shingles, the row of smallest id.

    At 0.8 on five words, texts differ by about ten of 64 bits, where blocks of equal bits select nothing.  The shards are therefore
    those of min-hash keys, and in a shard the share of equal sketch bins links whatever may be similar.  Inside the groups that these
    links connect, the Jaccard similarity of the sets of shingles (as 64-bit hashes) decides.  Texts without words are one group.
    """

    def make():
        def one(texts):
            out = []
            for t in translated(texts, LOWER).cast(pa.binary()):
                words = t.as_py().split()
                out.append((xxhash.xxh3_128_digest(b" ".join(words)), *signature(shingles(words, shingle))))
            return [list(x) for x in zip(*out)] if out else [[], [], [], []]

        return one

    fields = [("name", T.BinaryType()), ("size", T.LongType()), ("keys", T.ArrayType(T.LongType())), ("sketch", T.BinaryType())]
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), docs[text].alias("_of"))
    rows = per_text(rows, ["_row"], "_of", fields, make).withColumn("_number", F.monotonically_increasing_id())
    rows = stored(rows)
    first = F.struct(F.col(f"_row.{doc_id}").isNull().alias("none"), F.col(f"_row.{doc_id}").alias("id"), F.col("_number").alias("number"))
    texts = rows.groupBy("name").agg(
        F.min(first).alias("least"), *(F.first(c).alias(c) for c in ("size", "keys", "sketch")))
    texts = stored(texts)
    loose = components(similar_links(texts, similarity))
    members = texts.join(loose, F.col("name") == F.col("node")).select(
        "name", "size", F.col("root").alias("group"), F.col("least")["number"].alias("number"))
    contents = rows.select(F.col("_number").alias("number"), F.col(f"_row.{text}").alias("text"))
    stars = components(exact_links(members, contents, similarity, shingle))
    rooted = texts.select("name", "least").join(stars, F.col("name") == F.col("node"), "left")
    stay = rooted.groupBy(F.coalesce("root", "name").alias("group")).agg(F.min("least")["number"].alias("stays"))
    return rows.join(stay, F.col("_number") == F.col("stays"), "left_semi").select("_row.*")


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = near_duplicates(docs.select("doc_id", "text"), ["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")
