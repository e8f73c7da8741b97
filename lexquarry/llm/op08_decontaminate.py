"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Items and documents become words (ASCII lower-cased; letters, digits and everything beyond ASCII).  Windows of ``width`` words of
the items, or the whole of a shorter item, go into hash sets that are broadcast; a task scans the token windows of its texts,
filters them by a bit table and a hash, and compares the words of what is left.

The broadcast is bounded: items are dealt by a hash into parts of at most ``part_words`` words, and each part is a further map in
the same stage that adds its hits to the row, so a large benchmark needs more maps but no larger broadcast.

Defined results: null and empty texts have no words and no hits; an item without words matches nothing; rows are independent, so
repeated rows get equal results; items with the same id count once, an item with a null id counts as "null"; extra columns are
carried only if named in ``keep``.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lexquarry.llm.shared import carries
from lexquarry.llm.words import ALPHANUMERIC, Words, mixed, per_text, split_words, windows

WIDTH = 10
#: a word before A-Z are lower-cased
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PART_WORDS = 2_000_000
FACTOR = 0x9E3779B97F4A7C15
TABLE_BITS = 22

HITS = T.ArrayType(T.LongType())
ITEMS = T.ArrayType(T.StringType())


def _windows(words: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows inside one text, and their hashes."""
    full = mixed(windows(hashes, width, FACTOR))
    ends = np.repeat(words.starts[1:], np.diff(words.starts))[:len(full)]
    inside = np.flatnonzero(np.arange(len(full)) + width <= ends)
    return inside, full[inside]


class TestSet:
    """Windows of the items by length: a bit table, sorted hashes, and for each hash the windows with their items."""

    __test__ = False

    def __init__(self, rows: list[tuple[object, str]], width: int):
        words = split_words(pa.array([t for _, t in rows], pa.string()), ALPHANUMERIC)
        hashes = words.hashes(xxhash.xxh3_64_intdigest)
        self.by_width: dict[int, tuple[np.ndarray, dict[int, dict[bytes, set[str]]]]] = {}
        found: dict[int, dict[int, dict[bytes, set[str]]]] = {}
        for i, (item, _) in enumerate(rows):
            lo, hi = int(words.starts[i]), int(words.starts[i + 1])
            size = min(width, hi - lo)
            if not size:
                continue
            own = mixed(windows(hashes[lo:hi], size, FACTOR)).tolist()
            spelled = [words.values[c] for c in words.codes[lo:hi]]
            for k, h in enumerate(own):
                same = found.setdefault(size, {}).setdefault(h, {})
                same.setdefault(b" ".join(spelled[k:k + size]), set()).add("null" if item is None else str(item))
        for size, by_hash in found.items():
            table = np.zeros(1 << TABLE_BITS, bool)
            table[np.fromiter(by_hash, np.uint64, len(by_hash)) >> np.uint64(64 - TABLE_BITS)] = True
            self.by_width[size] = table, by_hash

    def hits(self, words: Words) -> tuple[list[list[int]], list[set[str]]]:
        """Start and end, in turn, of the hit windows of every text, and its items."""
        n = len(words.starts) - 1
        ranges: list[list[int]] = [[] for _ in range(n)]
        items: list[set[str]] = [set() for _ in range(n)]
        hashes = words.hashes(xxhash.xxh3_64_intdigest)
        for size, (table, by_hash) in self.by_width.items():
            at, h = _windows(words, hashes, size)
            likely = np.flatnonzero(table[h >> np.uint64(64 - TABLE_BITS)])
            at, h = at[likely], h[likely]
            texts = np.searchsorted(words.starts, at, "right") - 1
            for start, hashed, text in zip(at.tolist(), h.tolist(), texts.tolist()):
                same = by_hash.get(hashed)
                if same is None:
                    continue
                own = same.get(b" ".join([words.values[c] for c in words.codes[start:start + size]]))
                if own:
                    first = start - int(words.starts[text])
                    if ranges[text] and ranges[text][-2] <= first <= ranges[text][-1]:
                        ranges[text][-1] = max(ranges[text][-1], first + size)
                    else:
                        ranges[text] += [first, first + size]
                    items[text] |= own
        return ranges, items


def parts(benchmark: DataFrame, width: int, part_words: int, item_id: str = "item_id", text: str = "text") -> list:
    """The benchmark as broadcast test sets of about ``part_words`` words.

    Items are dealt by id and text, so that copies of one text under many ids spread; an item is never cut.
    """
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("t is not null")
    words = rows.agg(F.sum(F.regexp_count("t", F.lit(ANY_CASE_WORD)))).first()[0] or 0
    n = ceil(words / part_words) or 1
    out = []
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        out.append(spark.sparkContext.broadcast(TestSet([tuple(r) for r in part.toLocalIterator()], width)))
    return out


@carries("hit_text", "hits", "items")
def find_hits(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", width: int = WIDTH,
    part_words: int = PART_WORDS,
) -> DataFrame:
    """``keep``, the text, hit word ranges (start, end in turn) and item ids of every document."""
    out = docs.select(*keep, F.col(text).alias("_t"), F.array().cast(HITS).alias("_h"), F.array().cast(ITEMS).alias("_i"))
    for sets in parts(benchmark, width, part_words):

        def make(sets=sets):
            def one(texts):
                ranges, items = sets.value.hits(split_words(texts, ALPHANUMERIC))
                return [ranges, [sorted(x) for x in items]]

            return one

        found = per_text(out, [*keep, "_t", "_h", "_i"], "_t", [("_h2", HITS), ("_i2", ITEMS)], make)
        out = found.select(*keep, "_t", F.concat("_h", "_h2").alias("_h"), F.array_union("_i", "_i2").alias("_i"))
    return out.select(*keep, F.col("_t").alias("hit_text"), F.col("_h").alias("hits"), F.col("_i").alias("items"))


@carries("n_words", "n_hit", "items", "clean_text")
def decontaminate(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", width: int = WIDTH,
    part_words: int = PART_WORDS,
) -> DataFrame:
    """For every document: ``keep``, n_words, n_hit (words inside a hit window), items (sorted) and clean_text.

    ``clean_text`` is the text without its hit words and without the separators between two of them.  Dropping documents instead of
    spans is a filter on ``n_hit``.
    """
    found = find_hits(docs, benchmark, keep, text, width, part_words)
    fields = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("clean_text", T.StringType())]
    kept = found.select(*keep).schema.fields
    schema = T.StructType([*kept, T.StructField("items", ITEMS), *(T.StructField(n, t) for n, t in fields)])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            texts, hits = batch.column(len(kept) + 1), batch.column(len(kept) + 2).to_pylist()
            counts = np.diff(split_words(texts, ALPHANUMERIC).starts)
            n_hit, clean = [], []
            for i, own in enumerate(hits):
                value = texts[i].as_py()
                if not own:
                    n_hit.append(0)
                    clean.append(value)
                    continue
                hit = np.zeros(counts[i], bool)
                for lo, hi in zip(own[::2], own[1::2]):
                    hit[lo:hi] = True
                n_hit.append(int(hit.sum()))
                clean.append(_without(value, hit))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(kept) + 1)), pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()),
                 pa.array(clean, pa.string())], names=out.names)

    items = F.array_sort("items").alias("items")
    return found.select(*keep, items, "hit_text", "hits").mapInArrow(run, schema)


def _without(text: str, hit: np.ndarray) -> str:
    """Cut every run of hit words, from its first byte to its last."""
    raw = text.encode()
    word = np.frombuffer(raw.translate(ALPHANUMERIC), np.uint8) != 32
    edges = np.diff(np.concatenate([[0], word.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    runs = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    out, at = [], 0
    for lo, hi in zip(np.flatnonzero(runs == 1), np.flatnonzero(runs == -1)):
        out.append(raw[at:first[lo]])
        at = last[hi - 1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = decontaminate(docs.select("doc_id", "text"), benchmark, ["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8_SQL = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), {WIDTH}) AS width, array_to_string(w[i:i + least(len(w), {WIDTH}) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WIDTH}) + 2)) AS i FROM items WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM item_windows),
docs AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
doc_windows AS (
  SELECT doc_id, width, i, array_to_string(w[i:i + width - 1], ' ') AS gram
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM docs, widths WHERE len(w) >= width)),
hits AS (SELECT doc_id, i, width, item_id FROM doc_windows JOIN item_windows USING (width, gram)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items t USING (doc_id)"""
