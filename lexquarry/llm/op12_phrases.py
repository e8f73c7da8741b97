"""Phrase collocations by best-first branch-and-bound growth.

Phrases grow word by word.  Pass 1 counts the words of every language, pass 2 the pairs of words that are frequent enough.  A pair is the
prefix of triples, and its counts bound the score of all of them: a triple occurs at most as often as its prefix, and every cut gives at
most the share of the prefix in its first word.  The frontier is opened best bound first: the first level is the score of the pair of
rank 2 * ``limit`` in a language, then deeper ones.  A level opens the prefixes whose bound reaches it, and those whose triples can
cover a pair that reaches it; one pass counts the triples of the prefixes that are new.  A language is settled when ``limit`` phrases
that no longer one covers reach its level; level zero opens everything.  Triples are counted once, whatever the number of levels.

Tasks know the frequent words, the frequent pairs and the open prefixes by bitmaps of hashes, sized from their number and bounded by
``MAX_BITS`` (32 MB each).  A bit set by two phrases only lets a phrase be counted that the exact counts then refuse.  Counts are summed
in the task before they are shuffled, so a hot word or language sends one row a task and slice.  Two rows for each language and level
reach the driver.  Scores are exact: products are decimals of 38 digits.

Defined results: null and empty texts have no words; a null language is ``und``; repeated rows count as often as they come; a language
without candidates has no rows; an empty table gives none.  Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zlib
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lexquarry.llm.shared import stored
from lexquarry.llm.words import LOWER, mixed, slices, split_words, translated

LEAST, LIMIT, COVER = 10, 2000, 50
UNKNOWN = "und"
#: Ranks of the pairs whose scores are the first levels, as multiples of the limit; then everything is opened.
RANKS = (2, 8, 32)
MIN_BITS, MAX_BITS, BLOCK = 1 << 16, 1 << 28, 1 << 16
#: Text bytes whose phrases are summed at once.
SLICE_BYTES = 2 << 20
#: Rows that a task hands over at once.
BATCH_ROWS = 50_000
FACTOR = 0x9E3779B97F4A7C15
#: Piece ends become line feeds, tabs become spaces, A-Z lower case.
MARKS = bytes(10 if chr(b) in ".,;:!?\n\v\f\r" else 32 if b == 9 else LOWER[b] for b in range(256))


class Slice:
    """Words of a slice of texts with the languages of the texts."""

    def __init__(self, texts: pa.StringArray, langs: pa.StringArray):
        texts = translated(texts, MARKS)
        words = split_words(texts)
        self.values, self.codes = words.values, words.codes.astype(np.int64)
        coded = pc.fill_null(langs, UNKNOWN).dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        per_text = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        text_of = words.text_of_word()
        self.lang = per_text[text_of]
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[int(offsets[0]):int(offsets[-1])]
        inside = (raw != 32) & (raw != 10)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begins = (offsets[:-1] - offsets[0])[np.diff(offsets) > 0]
        first[begins] = inside[begins]
        piece = np.cumsum(raw == 10)[np.flatnonzero(first)]
        #: word i and the next one lie in one piece
        self.joined = (piece[1:] == piece[:-1]) & (text_of[1:] == text_of[:-1]) if len(piece) else np.zeros(0, bool)
        one = np.fromiter(map(xxhash.xxh3_64_intdigest, self.values), np.uint64, len(self.values))
        self.hashes, self.seeds = one, seeds(self.langs)

    def word_hashes(self) -> np.ndarray:
        return phrase_hashes(self.seeds[self.lang], self.hashes[self.codes])

    def pair_hashes(self, at: np.ndarray) -> np.ndarray:
        return phrase_hashes(self.seeds[self.lang[at]], self.hashes[self.codes[at]], self.hashes[self.codes[at + 1]])

    def counted(self, at: np.ndarray, size: int) -> tuple[list, list, np.ndarray]:
        """Languages, phrases of ``size`` words and their numbers, of the phrases that start at ``at``."""
        if not len(at):
            return [], [], np.zeros(0, np.int64)
        key = self.lang[at]
        for i in range(size):
            if i == 2:
                key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            key = key * len(self.values) + self.codes[at + i]
        _, first, times = np.unique(key, return_index=True, return_counts=True)
        at = at[first]
        values = pa.array(self.values, pa.binary())
        parts = [values.take(pa.array(self.codes[at + i])) for i in range(size)]
        phrases = parts[0] if size == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()))
        return pa.array(self.langs, pa.string()).take(pa.array(self.lang[at])), phrases.cast(pa.string()), times


def seeds(langs: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in langs), np.uint64, len(langs))


def phrase_hashes(seed: np.ndarray, *words: np.ndarray) -> np.ndarray:
    total = seed.copy()
    for w in words:
        total = total * np.uint64(FACTOR) + w
    return mixed(total)


class Bits:
    """Set of hashes that may hold more than was put in."""

    def __init__(self, bits: int, packed: bytes):
        self.shift, self.packed = np.uint64(64 - (bits.bit_length() - 1)), np.frombuffer(packed, np.uint8)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.packed[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap(phrases: DataFrame, max_bits: int = MAX_BITS) -> tuple[int, bytes]:
    """Number of bits, and the bits of all rows (lang, phrase)."""
    n = phrases.count()
    bits = min(max_bits, max(MIN_BITS, 1 << (16 * n).bit_length()))
    shift = np.uint64(64 - (bits.bit_length() - 1))
    kind = "block long, data binary"

    def block_of(number: int, block: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"block": pa.array([number], pa.int64()), "data": pa.array([zlib.compress(block.tobytes(), 1)], pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.zeros(0, np.uint64)]
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            seed = seeds(langs.dictionary.to_pylist())[langs.indices.to_numpy(zero_copy_only=False)]
            parts = pc.split_pattern(batch.column(1).cast(pa.binary()), b" ")
            flat, size = parts.flatten().to_pylist(), pc.list_value_length(parts)
            if not flat:
                continue
            words = np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat)).reshape(-1, size[0].as_py())
            found.append(np.unique(phrase_hashes(seed, *words.T) >> shift))
        at = np.unique(np.concatenate(found)).astype(np.int64)
        for number in np.unique(at // BLOCK).tolist():
            lo, hi = np.searchsorted(at, [number * BLOCK, (number + 1) * BLOCK])
            block = np.zeros(BLOCK, np.uint8)
            block[at[lo:hi] % BLOCK] = 1
            yield block_of(number, np.packbits(block, bitorder="little"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, whole = None, None
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if number != now:
                    if whole is not None:
                        yield block_of(now, whole)
                    now, whole = number, np.zeros(BLOCK // 8, np.uint8)
                whole = whole | np.frombuffer(zlib.decompress(data), np.uint8)
        if whole is not None:
            yield block_of(now, whole)

    out = np.zeros(bits // 8, np.uint8)
    parts = phrases.select("lang", "phrase").mapInArrow(count, kind).repartition("block").sortWithinPartitions("block")
    for number, data in parts.mapInArrow(merge, kind).toLocalIterator():
        out[number * BLOCK // 8:(number + 1) * BLOCK // 8] = np.frombuffer(zlib.decompress(data), np.uint8)
    return bits, out.tobytes()


def counts(docs: DataFrame, find: Callable[[Slice], Iterator[tuple[list, list, np.ndarray]]]) -> DataFrame:
    """``lang``, ``phrase``, ``f``: what ``find`` counts in the slices of all texts, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column(0), batch.column(1)
            for lo, hi in slices(texts, SLICE_BYTES):
                for lang, phrase, times in find(Slice(texts.slice(lo, hi - lo), langs.slice(lo, hi - lo))):
                    for at in range(0, len(phrase), BATCH_ROWS):
                        part = [pa.array(x[at:at + BATCH_ROWS], k) for x, k in ((lang, pa.string()), (phrase, pa.string()), (times, pa.int64()))]
                        yield pa.RecordBatch.from_arrays(part, names=["lang", "phrase", "f"])

    rows = docs.mapInArrow(run, "lang string, phrase string, f long")
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def exact_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly."""
    wide = "decimal(20,0)"
    top = (F.lit(1_000_000).cast("decimal(7,0)") * (a.cast(wide) * a.cast(wide)).cast("decimal(31,0)")).cast("decimal(38,0)")
    return F.call_function("div", top, (left.cast(wide) * right.cast(wide)).cast("decimal(38,0)"))


def words_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words (lang, phrase, f) met ``LEAST`` times or more, and ``n`` of every language."""

    def find(part: Slice):
        yield part.counted(np.arange(len(part.codes)), 1)
        # the empty word counts them all
        times = np.bincount(part.lang, minlength=len(part.langs))
        yield part.langs, [""] * len(part.langs), times

    found = counts(docs, find)
    kept = stored(found.where((F.col("phrase") == "") | (F.col("f") >= LEAST)))
    return kept.where("phrase <> ''"), kept.where("phrase = ''").select("lang", F.col("f").alias("n"))


def pairs_of(docs: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs met ``LEAST`` times or more: lang, phrase, w1, w2, a, l, r, score and bound (of the triples that they begin)."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(words))

    def find(part: Slice):
        frequent = Bits(*shared.value).holds(part.word_hashes())
        yield part.counted(np.flatnonzero(part.joined & frequent[1:] & frequent[:-1]), 2)

    found = counts(docs, find).where(F.col("f") >= LEAST)
    parts = F.split("phrase", " ")
    found = found.select("lang", "phrase", parts[0].alias("w1"), parts[1].alias("w2"), F.col("f").alias("a"))
    left = words.select("lang", F.col("phrase").alias("w1"), F.col("f").alias("l"))
    right = words.select("lang", F.col("phrase").alias("w2"), F.col("f").alias("r"))
    both = found.join(left, ["lang", "w1"]).join(right, ["lang", "w2"])
    return stored(both.select(
        "lang", "phrase", "w1", "w2", "a", "l", "r", exact_score(F.col("a"), F.col("l"), F.col("r")).alias("score"),
        F.floor(F.lit(1_000_000.0) * F.col("a") / F.col("l") + F.lit(1)).cast("long").alias("bound")))


def opened(pairs: DataFrame, levels: DataFrame) -> DataFrame:
    """Prefixes (lang, phrase) whose triples can reach the level of their language or cover a pair that reaches it."""
    ranked = pairs.join(F.broadcast(levels), "lang")
    # a triple covers the pair of its last two words from half of the pair's count on
    needed = ranked.where("score >= level").groupBy("lang", F.col("w1").alias("w2")).agg(F.min("a").alias("needs"))
    within = ranked.join(needed, ["lang", "w2"], "left")
    covers = 100 * F.col("a") >= COVER * F.col("needs")
    return within.where((F.col("bound") >= F.col("level")) | (F.col("score") >= F.col("level")) | F.coalesce(covers, F.lit(False))).select(
        "lang", "phrase")


def triples_of(docs: DataFrame, frequent: tuple, prefixes: DataFrame, pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Triples met ``LEAST`` times or more that begin with one of the prefixes, with their lowest cut."""
    spark = docs.sparkSession
    shared, begun = spark.sparkContext.broadcast(frequent), spark.sparkContext.broadcast(bitmap(prefixes))

    def find(part: Slice):
        at = np.flatnonzero(part.joined[1:] & part.joined[:-1])
        at = at[Bits(*begun.value).holds(part.pair_hashes(at))]
        yield part.counted(at[Bits(*shared.value).holds(part.pair_hashes(at + 1))], 3)

    found = counts(docs, find).where(F.col("f") >= LEAST)
    parts = F.split("phrase", " ")
    found = found.select(
        "lang", "phrase", F.concat_ws(" ", parts[0], parts[1]).alias("head"), F.concat_ws(" ", parts[1], parts[2]).alias("tail"),
        parts[0].alias("w1"), parts[2].alias("w3"), F.col("f").alias("a"))
    # bits may let triples of other prefixes through; they belong to another level
    found = found.join(prefixes.select("lang", F.col("phrase").alias("head")), ["lang", "head"], "left_semi")
    head = pairs.select("lang", F.col("phrase").alias("head"), F.col("a").alias("c12"))
    tail = pairs.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("c23"))
    first = words.select("lang", F.col("phrase").alias("w1"), F.col("f").alias("f1"))
    last = words.select("lang", F.col("phrase").alias("w3"), F.col("f").alias("f3"))
    whole = found.join(head, ["lang", "head"]).join(tail, ["lang", "tail"]).join(first, ["lang", "w1"]).join(last, ["lang", "w3"])
    one, two = exact_score(F.col("a"), F.col("f1"), F.col("c23")), exact_score(F.col("a"), F.col("c12"), F.col("f3"))
    cut = F.when(one <= two, F.struct(one.alias("score"), F.col("f1").alias("l"), F.col("c23").alias("r"))).otherwise(
        F.struct(two.alias("score"), F.col("c12").alias("l"), F.col("f3").alias("r")))
    return stored(whole.select("lang", "phrase", "head", "tail", "a", cut.alias("cut")).select("lang", "phrase", "head", "tail", "a", "cut.*"))


def surviving(pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """Pairs that no triple covers, and all triples: lang, phrase, a, l, r, score."""
    columns = ["lang", "phrase", "a", "l", "r", "score"]
    inside = triples.select("lang", F.col("head").alias("phrase"), F.col("a").alias("longer")).unionByName(
        triples.select("lang", F.col("tail").alias("phrase"), F.col("a").alias("longer")))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    alone = pairs.join(inside, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < COVER * F.col("a")))
    return alone.select(*columns).unionByName(triples.select(*columns))


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", limit: int = LIMIT, ranks: tuple[int, ...] = RANKS) -> DataFrame:
    """The ``limit`` best phrases of every language: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    docs = docs.select(docs[text].cast("string").alias("_text"), F.coalesce(docs[lang].cast("string"), F.lit(UNKNOWN)).alias("_lang"))
    words, totals = words_of(docs)
    pairs = pairs_of(docs, words)
    frequent = bitmap(pairs)
    open_langs = {r.lang for r in totals.collect()}
    best = W.partitionBy("lang").orderBy(F.desc("score"))
    known: DataFrame | None = None
    prefixes: DataFrame | None = None
    settled: dict[str, int] = {}
    for rank in (*(limit * r for r in ranks), None):
        if not open_langs:
            break
        levels = dict.fromkeys(open_langs, 0)
        if rank is not None:
            of_rank = pairs.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= rank)
            levels |= {r.lang: r.level for r in of_rank.groupBy("lang").agg(
                F.when(F.count(F.lit(1)) < rank, 0).otherwise(F.min("score")).cast("long").alias("level")).collect() if r.lang in open_langs}
        new = opened(pairs, spark.createDataFrame(list(levels.items()), "lang string, level long"))
        if prefixes is not None:
            new = new.join(prefixes, ["lang", "phrase"], "left_anti")
        new = stored(new)
        found = triples_of(docs, frequent, new, pairs, words)
        known = found if known is None else known.unionByName(found)
        prefixes = new if prefixes is None else prefixes.unionByName(new)
        reached = surviving(pairs, known).join(
            F.broadcast(spark.createDataFrame(list(levels.items()), "lang string, level long")), "lang").where("score >= level")
        many = {r.lang: r.n for r in reached.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
        done = {x: level for x, level in levels.items() if level == 0 or many.get(x, 0) >= limit}
        settled |= done
        open_langs -= set(done)
    if known is None:
        return spark.createDataFrame([], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")
    floor = spark.createDataFrame(list(settled.items()), "lang string, level long")
    # below its level a language has phrases whose triples were never counted
    found = surviving(pairs, known).join(F.broadcast(floor), "lang").where("score >= level")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return top.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, folder: str) -> DataFrame:
    found = phrases(spark.read.parquet(f"{folder}/documents.parquet").select("text", "lang"))
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


OP12_SQL = rf"""
WITH pieces AS (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
filled AS (SELECT lang, w FROM pieces WHERE len(w) > 0),
one AS MATERIALIZED (SELECT lang, w, count(*) AS f FROM (SELECT lang, unnest(w) AS w FROM filled) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang),
two AS MATERIALIZED (SELECT lang, w[1] AS w1, w[2] AS w2, count(*) AS f FROM (SELECT lang, w[i:i + 1] AS w FROM (
  SELECT lang, w, unnest(range(1, len(w))) AS i FROM filled)) GROUP BY ALL HAVING count(*) >= {LEAST}),
three AS MATERIALIZED (SELECT lang, w[1] AS w1, w[2] AS w2, w[3] AS w3, count(*) AS f FROM (SELECT lang, w[i:i + 2] AS w FROM (
  SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM filled)) GROUP BY ALL HAVING count(*) >= {LEAST}),
covered AS (SELECT lang, w1, w2, max(f) AS longer FROM (
  SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL),
scored AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, x.f AS l, y.f AS r, (1000000::HUGEINT * t.f * t.f // (x.f::HUGEINT * y.f)) AS score
  FROM two t JOIN one x ON x.lang = t.lang AND x.w = t.w1 JOIN one y ON y.lang = t.lang AND y.w = t.w2
  LEFT JOIN covered c ON c.lang = t.lang AND c.w1 = t.w1 AND c.w2 = t.w2 WHERE coalesce(100 * c.longer < {COVER} * t.f, true)
  UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN f1 ELSE c12 END, CASE WHEN s1 <= s2 THEN c23 ELSE f3 END, least(s1, s2) FROM (
    SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.f AS a, x.f AS f1, q.f AS c23, p.f AS c12, y.f AS f3,
      1000000::HUGEINT * t.f * t.f // (x.f::HUGEINT * q.f) AS s1, 1000000::HUGEINT * t.f * t.f // (p.f::HUGEINT * y.f) AS s2
    FROM three t JOIN one x ON x.lang = t.lang AND x.w = t.w1 JOIN one y ON y.lang = t.lang AND y.w = t.w3
    JOIN two p ON p.lang = t.lang AND p.w1 = t.w1 AND p.w2 = t.w2 JOIN two q ON q.lang = t.lang AND q.w1 = t.w2 AND q.w2 = t.w3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored)
SELECT p.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM placed p JOIN totals USING (lang) WHERE rank <= {LIMIT}"""
