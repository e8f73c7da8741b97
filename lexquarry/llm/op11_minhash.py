"""MinHash near-duplicates with b-bit signatures.

Texts with equal sets of shingles are one row.  A set has ``MINIMA`` smallest hashes.  Pairs of them name the buckets of ``BANDS`` bands;
of all of them ``BITS`` low bits are kept and packed into 32 bytes.  In a bucket, texts whose sizes allow the similarity are compared by
the number of equal low bits, from which the share that is equal by chance is taken off.  The least estimate lets a pair at the
similarity through but for a chance of ``LOSS``.  What is linked so is a loose group, and inside loose groups the whole sets decide.

Both steps run ``linked``: every bucket (or loose group) is dealt to trees of bounded size.  A tree keeps the links of a spanning forest,
so copies of one text cost one comparison each and no bucket emits all its pairs.  In a bucket of few trees every text visits the trees
before its own.  Where there are more, the texts with most links of every tree are shown to the others, and of what is still apart only
the texts outside the largest component visit all trees.
Every pair is thus compared or known to be connected, and a large group of near copies is not compared with itself tree by tree.

A pair of similarity s misses all bands with probability (1 - s ** 2) ** 24: 2e-11 at 0.8, less above; with ``LOSS`` that is all that can
be lost, whatever the size of a bucket.

Defined results: texts without words (null, empty or blank) have no shingles and are linked with nothing; fewer words than a shingle are
one shingle; a null doc_id never names a component (``component_id`` is null if no other row can, and such rows are kept); repeated rows
come back as often as they came; extra columns are carried only if named in ``keep``, which must not name a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from lexquarry.llm.shared import components, stored
from lexquarry.llm.words import LOWER, mixed, per_text, split_words, windows
from lexquarry.sizing import fits

SHINGLE = 5
#: Least similarity in hundredths.
PERCENT = 80
MINIMA, BITS, BANDS, BAND_ROWS = 128, 2, 24, 2
LOSS = 1e-10
FACTOR = 0x9E3779B97F4A7C15
#: Texts of one tree: at most, at least, and shingles of the texts that one tree compares exactly.
TREE_ROWS, LEAST_TREE, TREE_SHINGLES = 20_000, 512, 4_000_000
#: Trees of one bucket up to which every text simply visits the trees before its own.
FEW_TREES = 16
#: Links that one task joins.
EDGES = 250_000
#: Texts of every tree that are shown to the other trees of its bucket.
HUBS = 4
#: Texts in loose groups that are broadcast to the texts; more are joined.
LOOSE_ROWS = 1_000_000
RESULTS = ("n_shingles", "component_id", "kept")
_SALTS = mixed(np.arange(1, MINIMA + 1, dtype=np.uint64))
_TIMES = mixed(np.arange(MINIMA + 1, 2 * MINIMA + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.StringArray, shingle: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of every text; fewer words are one shingle."""
    words = split_words(texts, LOWER)
    hashes = words.hashes(xxhash.xxh3_64_intdigest)
    whole = mixed(windows(hashes, shingle, FACTOR))
    out = []
    for lo, hi in zip(words.starts[:-1].tolist(), words.starts[1:].tolist()):
        if hi - lo >= shingle:
            out.append(np.unique(whole[lo:hi - shingle + 1]))
        elif hi > lo:
            # the number of words keeps short sequences apart from shingles
            out.append(mixed(windows(hashes[lo:hi], hi - lo, FACTOR) + np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """``MINIMA`` smallest hashes (rows) of every set (columns), none of them empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    out = np.empty((MINIMA, len(sets)), np.uint64)
    for i in range(MINIMA):
        out[i] = np.minimum.reduceat((flat ^ _SALTS[i]) * _TIMES[i], starts)
    return out


def band_keys(smallest: np.ndarray) -> np.ndarray:
    """One number per set and band."""
    rows = smallest[:BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS, -1)
    total = np.arange(BANDS, dtype=np.uint64)[:, None] + np.zeros((1, smallest.shape[1]), np.uint64)
    for i in range(BAND_ROWS):
        total = mixed(total * np.uint64(FACTOR) + rows[:, i])
    return total.T


def packed_bits(smallest: np.ndarray) -> np.ndarray:
    """``BITS`` low bits of all minima, packed: one row of bytes per set."""
    low = (mixed(smallest + _SALTS[:, None]) & np.uint64((1 << BITS) - 1)).astype(np.uint8).T
    lanes = low.reshape(len(low), -1, 8 // BITS)
    return np.bitwise_or.reduce(lanes << np.arange(0, 8, BITS, dtype=np.uint8), axis=2)


def equal_lanes(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Number of equal ``BITS``-bit lanes of a signature (64-bit words) and rows of others."""
    differ = own ^ others
    differ = (differ | differ >> np.uint64(1)) & np.uint64(0x5555555555555555)
    return MINIMA - np.bitwise_count(differ).sum(1, dtype=np.int64)


def estimate(lanes: np.ndarray | float) -> np.ndarray | float:
    """Similarity from the number of equal lanes, corrected for those equal by chance."""
    chance = 0.5 ** BITS
    return (lanes / MINIMA - chance) / (1 - chance)


def least_estimate(similarity: float, loss: float = LOSS) -> float:
    """Estimate that a pair of the similarity fails to reach with a probability of at most ``loss``."""
    p = similarity + (1 - similarity) * 0.5 ** BITS
    missed, lanes = 0.0, 0
    while True:
        missed += comb(MINIMA, lanes) * p ** lanes * (1 - p) ** (MINIMA - lanes)
        if missed > loss:
            return float(estimate(lanes))
        lanes += 1


class Forest:
    """Links of a spanning forest of the texts of one tree.

    A text that asks is compared with those that stay, but for those in its own component.  With texts, their sets decide.
    """

    BLOCK = 256

    def __init__(self, percent: int, shingle: int):
        self.percent, self.shingle, self.least = percent, shingle, least_estimate(percent / 100) - 1e-9
        self.names: list[int] = []
        self.texts: list[str | None] = []
        self.sets: list[np.ndarray | None] = []
        self.sizes, self.groups = np.zeros(8, np.int64), np.zeros(8, np.int64)
        self.signs = np.zeros((8, MINIMA * BITS // 64), np.uint64)
        self.made, self.of_root, self.moved = 0, {}, {}

    def _group(self, root: int | None) -> int:
        if root is None or root not in self.of_root:
            self.made += 1
            if root is not None:
                self.of_root[root] = self.made
            return self.made
        at = self.of_root[root]
        while at in self.moved:
            at = self.moved[at]
        return at

    def _similar(self, own: np.ndarray, i: int) -> bool:
        if self.sets[i] is None:
            self.sets[i] = self.set_of(self.texts[i])
        other = self.sets[i]
        few, many = (own, other) if len(own) <= len(other) else (other, own)
        common = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
        return 100 * common >= self.percent * (len(own) + len(other) - common)

    def set_of(self, text: str) -> np.ndarray:
        return shingle_sets(pa.array([text], pa.string()), self.shingle)[0]

    def add(self, name: int, size: int, sign: bytes, text: str | None, stays: bool, asks: bool, root: int | None) -> Iterator[tuple[int, int]]:
        n, own, row, mine = len(self.names), self._group(root), np.frombuffer(sign, np.uint64), None
        if asks and n:
            sizes, groups = self.sizes[:n], self.groups[:n]
            fit = np.flatnonzero((100 * sizes >= self.percent * size) & (self.percent * sizes <= 100 * size) & (groups != own))
            for lo in range(0, len(fit), self.BLOCK):
                block = fit[lo:lo + self.BLOCK]
                block = block[groups[block] != own]
                if not len(block):
                    continue
                for i in block[estimate(equal_lanes(row, self.signs[block])) >= self.least].tolist():
                    if groups[i] == own:
                        continue
                    if text is not None and mine is None:
                        mine = self.set_of(text)
                    if text is None or self._similar(mine, i):
                        self.moved[int(groups[i])] = own
                        groups[groups == groups[i]] = own
                        yield name, self.names[i]
        if stays:
            if n == len(self.sizes):
                self.sizes, self.groups = np.resize(self.sizes, 2 * n), np.resize(self.groups, 2 * n)
                self.signs = np.resize(self.signs, (2 * n, self.signs.shape[1]))
            self.sizes[n], self.groups[n], self.signs[n] = size, own, row
            self.names.append(name)
            self.texts.append(text)
            self.sets.append(mine)


def _forests(rows: DataFrame, percent: int, shingle: int) -> DataFrame:
    """``a``, ``b``: the links of the forests of all trees, of rows (place, tree, name, size, sign, text, stays, asks, root)."""
    rows = rows.select("place", "tree", "name", "size", "sign", "text", "stays", "asks", "root")
    rows = rows.repartition("place", "tree").sortWithinPartitions("place", "tree", F.desc("stays"), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, forest = None, None
        for batch in batches:
            found = []
            for place, tree, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (place, tree) != at:
                    at, forest = (place, tree), Forest(percent, shingle)
                found += forest.add(*row)
            if found:
                both = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def joined(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` of the components of edges ``a``, ``b``; tasks join their own edges first, so few rounds are left."""
    edges = stored(edges)
    tasks = 1 + edges.count() // EDGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while above.setdefault(x, x) != x:
                above[x] = x = above[above[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                above[max(a, b)] = min(a, b)
        nodes = list(above)
        if nodes:
            yield pa.RecordBatch.from_pydict({"a": pa.array(nodes, pa.int64()), "b": pa.array([root(x) for x in nodes], pa.int64())})

    return components(edges.coalesce(tasks).mapInArrow(run, "a long, b long"), tasks)


def linked(
    rows: DataFrame, percent: int, shingle: int, tree_rows: int = TREE_ROWS, least_tree: int = LEAST_TREE, few_trees: int = FEW_TREES,
) -> DataFrame:
    """``a``, ``b``: links that connect every two similar texts of a place, of rows (place, name, size, sign, text).

    A place of more than ``tree_rows`` texts, or of more than its even share of all rows, has several trees.
    """
    spark = rows.sparkSession
    rows = stored(rows)
    total = rows.count()
    share = max(least_tree, min(tree_rows, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    trees = F.greatest(F.ceil(F.count(F.lit(1)) / share), F.ceil(F.sum(F.when(F.col("text_there"), F.col("size"))) / TREE_SHINGLES))
    hot = stored(rows.select("place", "size", F.col("text").isNotNull().alias("text_there")).groupBy("place").agg(
        trees.cast("int").alias("trees")).where("trees > 1"))
    n_hot = hot.count()

    def dealt(of: DataFrame) -> DataFrame:
        return of.withColumn("own", F.pmod(F.xxhash64("name"), F.col("trees")).cast("int"))

    def flags(stays: bool, asks: bool, root: Column) -> list[Column]:
        return [F.lit(stays).alias("stays"), F.lit(asks).alias("asks"), root.cast("long").alias("root")]

    columns = ["place", "tree", "name", "size", "sign", "text"]
    if not n_hot:
        return _forests(rows.select("place", F.lit(0).alias("tree"), *columns[2:], *flags(True, True, F.lit(None))), percent, shingle)
    most = hot.agg(F.max("trees")).first()[0]
    # a tree has share rows or more, so there are at most 4 hot places for each shuffle partition, or one for tree_rows rows
    side = F.broadcast(hot) if n_hot <= LOOSE_ROWS else hot
    all_rows = dealt(rows.join(side, "place", "left").withColumn("trees", F.coalesce("trees", F.lit(1))))
    if most <= few_trees:
        every = all_rows.withColumn("tree", F.explode(F.sequence(F.lit(0), "own")))
        return _forests(every.select(*columns, (F.col("own") == F.col("tree")).alias("stays"), F.lit(True).alias("asks"),
                                     F.lit(None).cast("long").alias("root")), percent, shingle)
    first = stored(_forests(all_rows.withColumn("tree", F.col("own")).select(*columns, *flags(True, True, F.lit(None))), percent, shingle))
    several = stored(dealt(rows.join(side, "place")))
    degree = first.select(F.explode(F.array("a", "b")).alias("of")).groupBy("of").agg(F.count(F.lit(1)).alias("links"))
    ranked = several.select("place", "own", "trees", "name").join(degree, F.col("name") == F.col("of"), "left").withColumn(
        "_rank", F.row_number().over(W.partitionBy("place", "own").orderBy(F.desc_nulls_last("links"), "name")))
    hubs = ranked.where(F.col("_rank") <= HUBS).select(F.col("place").alias("at"), "name", F.explode(
        F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"))
    shown = hubs.join(several.select("place", "name", "size", "sign", "text"), "name").where("place = at").select(
        *columns, *flags(True, True, F.lit(None)))
    asking = several.withColumn("tree", F.col("own")).select(*columns, *flags(False, True, F.lit(None)))
    second = stored(first.unionByName(_forests(shown.unionByName(asking), percent, shingle)))
    stars = joined(second)
    rooted = several.join(stars, F.col("name") == F.col("node"), "left").withColumn("root", F.coalesce("root", "name")).drop("node")
    rooted = stored(rooted)
    sizes = rooted.groupBy("place", "root").agg(F.count(F.lit(1)).alias("n"))
    giant = sizes.groupBy(F.col("place").alias("at")).agg(
        F.max(F.struct("n", "root"))["root"].alias("giant"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    apart = rooted.join(F.broadcast(giant) if n_hot <= LOOSE_ROWS else giant, F.col("place") == F.col("at"))
    there = apart.withColumn("tree", F.col("own")).select(*columns, *flags(True, False, F.col("root")))
    visits = apart.where("root <> giant").withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1))).where("tree <> own").select(
        *columns, *flags(False, True, F.col("root")))
    return second.unionByName(_forests(there.unionByName(visits), percent, shingle)).distinct()


def near_duplicates(
    docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
    tree_rows: int = TREE_ROWS, least_tree: int = LEAST_TREE, few_trees: int = FEW_TREES,
) -> DataFrame:
    """``keep``, ``n_shingles``, ``component_id`` (smallest ``doc_id`` reachable over links) and ``kept`` of every row."""
    clash = sorted(set(keep) & set(RESULTS))
    if clash:
        raise ValueError(f"columns {clash} are results of this operator; rename them or leave them out of keep")

    def make():
        def one(texts):
            sets = shingle_sets(texts, shingle)
            filled = [s for s in sets if len(s)]
            names, keys, signs = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if filled:
                smallest = minima(filled)
                bands, bits = band_keys(smallest).view(np.int64), packed_bits(smallest)
                for k, i in enumerate(i for i, s in enumerate(sets) if len(s)):
                    names[i], keys[i], signs[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), bands[k], bits[k].tobytes()
            return [names, [len(s) for s in sets], keys, signs]

        return one

    fields = [("name", T.BinaryType()), ("size", T.LongType()), ("keys", T.ArrayType(T.LongType())), ("sign", T.BinaryType())]
    held = docs.select(F.struct(*(docs[c] for c in keep)).alias("_row"), docs[doc_id].alias("_id"), docs[text].alias("_of"))
    rows = stored(per_text(held, ["_row", "_id", "_of"], "_of", fields, make).withColumn("_number", F.monotonically_increasing_id()))
    texts = stored(rows.where("size > 0").groupBy("name").agg(
        F.min("_number").alias("number"), F.min("_id").alias("least"), *(F.first(c).alias(c) for c in ("size", "keys", "sign"))))
    banded = texts.select(F.col("number").alias("name"), F.explode("keys").alias("place"))
    company = banded.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("place")
    signs = texts.select(F.col("number").alias("name"), "size", "sign", F.lit(None).cast("string").alias("text"))
    loose = joined(linked(banded.join(company, "place").join(signs, "name"), percent, shingle, tree_rows, least_tree, few_trees))
    members = stored(texts.join(loose, F.col("number") == F.col("node")).select(F.col("root").alias("place"), F.col("number").alias("name"), "size", "sign"))
    of_members = F.broadcast(members) if fits(members, LOOSE_ROWS) else members
    whole = rows.select(F.col("_number").alias("name"), F.col("_of").alias("text")).join(of_members, "name")
    stars = joined(linked(whole, percent, shingle, min(tree_rows, 2_000), least_tree, few_trees))
    rooted = texts.select(F.col("name").alias("of"), "least", "number").join(stars, F.col("number") == F.col("node"), "left").withColumn(
        "root", F.coalesce("root", "number"))
    named = rooted.groupBy(F.col("root").alias("class")).agg(F.min("least").alias("_component"))
    classes = rooted.join(named, F.col("root") == F.col("class")).select("of", "_component")
    component = F.when(F.col("size") == 0, F.col("_id")).otherwise(F.col("_component"))
    return rows.select("_row", "_id", "name", "size").join(classes, F.col("name") == F.col("of"), "left").select(
        "_row.*", F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def op11_minhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, ["doc_id"], shingle=2).select("doc_id", "n_shingles", "component_id", "kept")


# Pairs share a shingle of the prefix, the fifth of a set that is rarest; components by the smallest id reachable.
OP11_SQL = rf"""
WITH RECURSIVE words AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM words),
texts AS MATERIALIZED (SELECT min(r) AS t, s FROM sets WHERE len(s) > 0 GROUP BY s),
shingles AS MATERIALIZED (SELECT t, len(s) AS n, unnest(s) AS g FROM texts),
rarity AS (SELECT g, count(*) AS c FROM shingles GROUP BY g),
placed AS (SELECT t, n, g, row_number() OVER (PARTITION BY t ORDER BY c, g) AS p FROM shingles JOIN rarity USING (g)),
prefix AS MATERIALIZED (SELECT t, n, g FROM placed WHERE p <= n - ceil(n * {PERCENT} / 100.0) + 1),
pairs AS (SELECT DISTINCT x.t AS a, y.t AS b FROM prefix x JOIN prefix y ON x.g = y.g AND x.t < y.t
  AND 100 * x.n >= {PERCENT} * y.n AND 100 * y.n >= {PERCENT} * x.n),
common AS (SELECT a, b, len(x.s) AS n, len(y.s) AS m, len(list_intersect(x.s, y.s)) AS c
  FROM pairs JOIN texts x ON x.t = a JOIN texts y ON y.t = b),
edges AS MATERIALIZED (SELECT a, b FROM common WHERE 100 * c >= {PERCENT} * (n + m - c)),
both_ways AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
least AS (SELECT t, min(doc_id) AS d FROM sets JOIN texts USING (s) GROUP BY t),
reach AS (SELECT t, t AS u FROM texts UNION SELECT reach.t, b FROM reach JOIN both_ways ON a = u),
named AS (SELECT reach.t, min(d) AS component_id FROM reach JOIN least ON least.t = u GROUP BY reach.t)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, CASE WHEN len(sets.s) = 0 THEN doc_id ELSE component_id END AS component_id,
  doc_id IS NOT DISTINCT FROM CASE WHEN len(sets.s) = 0 THEN doc_id ELSE component_id END AS kept
FROM sets LEFT JOIN texts USING (s) LEFT JOIN named USING (t)"""
