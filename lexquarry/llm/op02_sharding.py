"""Sharding by best-fit-decreasing bin packing of indivisible groups.

A group is all documents with equal text (by SHA-256).  Groups enter, largest first, the bin whose remaining capacity is the tightest
that still holds them; remaining capacities are kept in a balanced tree (a treap).  Groups of equal size are interchangeable and the
tightest bin stays the tightest while it can take them, so the packing works on the histogram of group sizes: its number of entries
D obeys D * D / 2 <= bytes, whatever the number of documents.  Bins go back to groups by size and rank, and to documents by group.

``pack_sizes`` opens as many bins of a fixed capacity as it needs.  ``level_sizes`` turns that around for a fixed number of bins: a
group larger than an equal share of what is left gets a bin of its own, and for the rest the smallest capacity is searched with
which best-fit-decreasing needs no more bins than there are.

Defined results: a null text has no bytes (size 1, CRC 0) and forms one group with other nulls, apart from empty texts; repeated rows
are documents of their own in one group; null ids take slots like others; fewer groups than shards leave shards empty; extra columns
are carried only if named in ``keep``.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexquarry.llm.shared import carries, ranked, reliable_checkpoint

SHARDS = 16


class CapacityTree:
    """Balanced search tree (treap) of (remaining capacity, bin)."""

    def __init__(self) -> None:
        self.root = None
        self.seed = 0x2545F491

    def _priority(self) -> int:
        x = self.seed
        x ^= x << 13 & 0xFFFFFFFF
        x ^= x >> 17
        self.seed = x ^ (x << 5 & 0xFFFFFFFF)
        return self.seed

    def _split(self, node, key):
        """Subtrees of keys below ``key`` and of the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return [node[0], node[1], node[2], low], high
        low, high = self._split(node[2], key)
        return low, [node[0], node[1], high, node[3]]

    def _merge(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            return [low[0], low[1], low[2], self._merge(low[3], high)]
        return [high[0], high[1], self._merge(low, high[2]), high[3]]

    def add(self, room: int, number: int) -> None:
        low, high = self._split(self.root, (room, number))
        self.root = self._merge(self._merge(low, [(room, number), self._priority(), None, None]), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the smallest (room, bin) with room for ``size``."""
        node, found = self.root, None
        while node is not None:
            if node[0][0] >= size:
                found, node = node[0], node[2]
            else:
                node = node[3]
        if found is not None:
            low, rest = self._split(self.root, found)
            _, high = self._split(rest, (found[0], found[1] + 1))
            self.root = self._merge(low, high)
        return found


def pack_sizes(histogram: dict[int, int], capacity: int, most: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Best-fit-decreasing of ``histogram`` (size: count) into bins of ``capacity``.

    Rows (size, first rank, past the last rank, bin); None if more than ``most`` bins are needed.
    """
    tree, bins, out = CapacityTree(), 0, []
    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            found = tree.take_tightest(size)
            if found is None:
                if bins == most or size > capacity:
                    return None
                found, bins = (capacity, bins), bins + 1
            room, number = found
            count = min(left, room // size)
            out.append((size, rank, rank + count, number))
            rank, left = rank + count, left - count
            tree.add(room - count * size, number)
    return out


def level_sizes(histogram: dict[int, int], bins: int) -> list[tuple[int, int, int, int]]:
    """Rows as of ``pack_sizes`` for a fixed number of bins of nearly equal load."""
    rest, own, offset = dict(histogram), [], defaultdict(int)
    total, free = sum(s * n for s, n in rest.items()), bins
    while free > 1 and rest and max(rest) * free > total:
        size = max(rest)
        free -= 1
        own.append((size, offset[size], offset[size] + 1, free))
        offset[size] += 1
        total -= size
        rest[size] -= 1
        if not rest[size]:
            del rest[size]
    if not rest:
        return own
    # with a full share plus the largest group in every bin, no group can be left over
    low = -(-total // free)
    high = low + max(rest)
    best = pack_sizes(rest, high, free)
    while low < high:
        middle = (low + high) // 2
        tried = pack_sizes(rest, middle, free)
        if tried is None:
            low = middle + 1
        else:
            best, high = tried, middle
    return own + [(s, a + offset[s], b + offset[s], k) for s, a, b, k in best]


@carries("size", "text_crc32", "shard", "slot")
def shard(
    docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text", bins: int | None = SHARDS,
    capacity: int | None = None,
) -> DataFrame:
    """``keep``, size, text_crc32, shard and slot of every document.

    ``bins`` near-equal shards, or as many shards of ``capacity`` bytes as are needed.
    """
    if (bins is None) == (capacity is None):
        raise ValueError("give a number of bins or a capacity")
    spark, content = docs.sparkSession, F.col(text).cast("binary")
    rows = docs.select(
        *dict.fromkeys([doc_id, *keep]), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(content), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(content, 256)), F.lit(b"")).alias("_group"))
    rows = reliable_checkpoint(rows)
    groups = rows.groupBy(F.col("_group").alias("_g")).agg(F.sum("size").alias("_bytes"))
    histogram = {r[0]: r[1] for r in groups.groupBy("_bytes").count().toLocalIterator()}
    plan = level_sizes(histogram, bins) if bins else pack_sizes(histogram, capacity)
    if plan is None:
        raise ValueError(f"a group of {max(histogram)} bytes is larger than a shard of {capacity}")
    table = spark.createDataFrame(plan, "p_bytes long, p_from long, p_to long, shard int")
    placed = ranked(groups, "_bytes", ["_g"], "_rank").join(
        table, (F.col("_bytes") == F.col("p_bytes")) & (F.col("_rank") >= F.col("p_from")) & (F.col("_rank") < F.col("p_to")))
    found = rows.join(placed.select("_g", "shard"), F.col("_group") == F.col("_g")).drop("_g")
    out = ranked(found, "shard", ["_group", doc_id], "slot")
    return out.select(*keep, "size", "text_crc32", "shard", "slot")


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return shard(docs, ["doc_id"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
