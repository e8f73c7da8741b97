"""Substring dedup with a count-min prefilter.

A window is ``width`` consecutive words.  Pass 1 sketches the corpus: each task counts the anchors of its windows in a count-min
sketch with saturating cells (nothing above two matters), and the sketches of all tasks are merged block by block.  The anchor of a
window is the leftmost smallest hash among its ``gram``-word parts; equal windows have equal anchors in different places, so the
count of the anchor is never below that of the window, and one anchor stands for about ``(width - gram) / 2`` windows.  Pass 2 hashes
only the windows whose anchor is estimated at two or more, to 96 bits.  Windows met twice in one batch of a task are settled there,
and one row per distinct window of a batch is shuffled, so a passage in a third of all documents sends a row per batch, not per
document.  The rows of a hash that meets twice become word ranges of their text.  Pass 3 joins the ranges to the texts and cuts them.
The sketch overestimates, so it loses no repeated window; what it lets through in error is refused by the exact grouping.

The sketch has two rows of ``cells`` cells of two bits, sized from the number of bytes of text and bounded by ``MAX_CELLS`` (the
broadcast has at most 128 MB); beyond that bound more windows reach the exact pass, and the result stays the same.

A text is named by 96 bits of its content: equal texts have equal ranges.  Rows leave a task in the order of its texts, so that the
names of neighbours are equal and compress.

Defined results: null and empty texts have no words; a text of fewer than ``width`` words has no window and keeps all its words;
repeated rows are different documents, so their windows repeat; null ids are carried like any other; extra columns are carried only
if named in ``keep``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lexquarry.llm.shared import carries
from lexquarry.llm.words import Words, mixed, per_text, slices, split_words, windows

WIDTH = 35
GRAM = 20
MIN_CELLS, MAX_CELLS = 1 << 20, 1 << 28
BLOCK = 1 << 16
ROWS = 2
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SEEDS = (11, 23)


class Slice:
    """Windows and anchors of a slice of texts."""

    def __init__(self, texts: pa.StringArray, width: int, gram: int):
        self.width, self.gram = width, gram
        self.words: Words = split_words(texts)
        self.first = self.words.hashes(lambda w: xxhash.xxh3_64_intdigest(w, SEEDS[0]))
        n = len(self.first)
        ends = np.repeat(self.words.starts[1:], np.diff(self.words.starts))
        #: starts of the windows that lie inside one text
        self.at = np.flatnonzero(np.arange(max(0, n - width + 1)) + width <= ends[:max(0, n - width + 1)])
        grams = mixed(windows(self.first, gram, FACTORS[0]))
        best = np.arange(len(grams))
        reach = width - gram + 1
        covered = 1
        while covered < reach:
            step = min(covered, reach - covered)
            left, right = best[:-step], best[step:]
            best = np.where(grams[left] <= grams[right], left, right)
            covered += step
        #: place of the anchor of each window, and all places once
        self.anchor = best[self.at] if n >= width else np.zeros(0, np.int64)
        self.places = np.unique(self.anchor)
        self.values = grams[self.places]

    def repeated(self, sketch: Sketch) -> np.ndarray:
        """Numbers in ``at`` of the windows that may occur twice."""
        may = np.zeros(len(self.first) + 1, bool)
        may[self.places[sketch.twice(self.values)]] = True
        return np.flatnonzero(may[self.anchor])

    def hashes(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = self.at[chosen]
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        second = self.words.hashes(lambda w: xxhash.xxh3_64_intdigest(w, SEEDS[1]))
        low = mixed(windows(second, self.width, FACTORS[1]))[starts] >> np.uint64(32)
        return mixed(windows(self.first, self.width, FACTORS[0]))[starts], low


class Sketch:
    """Count-min sketch with cells that stop at two."""

    def __init__(self, cells: int, packed: bytes | None = None):
        self.cells, self.shift = cells, np.uint64(64 - (cells.bit_length() - 1))
        self.packed = np.zeros(ROWS * cells // 4, np.uint8) if packed is None else np.frombuffer(packed, np.uint8)

    def places(self, values: np.ndarray, row: int) -> np.ndarray:
        return ((mixed(values + np.uint64(row)) >> self.shift) + np.uint64(row * self.cells)).astype(np.int64)

    def twice(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), bool)
        for row in range(ROWS):
            at = self.places(values, row)
            out &= ((self.packed[at >> 2] >> ((at & 3) << 1).astype(np.uint8)) & 3) >= 2
        return out


def _packed(counts: np.ndarray) -> bytes:
    four = counts.reshape(-1, 4)
    return zlib.compress((four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    packed = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.stack([packed >> s & 3 for s in (0, 2, 4, 6)], 1).reshape(-1)


def sketch(docs: DataFrame, text: str, width: int, gram: int, max_cells: int = MAX_CELLS) -> Sketch:
    """The merged sketch of all texts."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    likely = size / 6 * 2 / (width - gram + 2)
    cells = min(max_cells, max(MIN_CELLS, 1 << int(2 * likely).bit_length()))

    def count(batches):
        one = Sketch(cells)
        found = [np.zeros(0, np.uint64)]
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                found.append(Slice(batch.column(0).slice(lo, hi - lo), width, gram).values)
        values = np.concatenate(found)
        for row in range(ROWS):
            at = np.sort(one.places(values, row))
            new = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
            at, times = at[new], np.minimum(2, np.diff(np.concatenate([np.flatnonzero(new), [len(new)]]))).astype(np.uint8)
            cuts = np.flatnonzero(np.concatenate([[True], at[1:] // BLOCK != at[:-1] // BLOCK])) if len(at) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(at)]):
                block = np.zeros(BLOCK, np.uint8)
                block[at[lo:hi] % BLOCK] = times[lo:hi]
                yield pa.RecordBatch.from_pydict({"block": pa.array([int(at[lo] // BLOCK)], pa.int64()), "cells": [_packed(block)]})

    def merge(batches):
        now, sums = None, None
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if number != now:
                    if sums is not None:
                        yield pa.RecordBatch.from_pydict({"block": pa.array([now], pa.int64()), "cells": [_packed(sums)]})
                    now, sums = number, np.zeros(BLOCK, np.uint8)
                sums = np.minimum(2, sums + _unpacked(data))
        if sums is not None:
            yield pa.RecordBatch.from_pydict({"block": pa.array([now], pa.int64()), "cells": [_packed(sums)]})

    kind = "block long, cells binary"
    parts = docs.select(text).mapInArrow(count, kind)
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, kind)
    whole = Sketch(cells)
    for number, data in merged.toLocalIterator():
        at = number * BLOCK // 4
        whole.packed[at:at + BLOCK // 4] = np.frombuffer(zlib.decompress(data), np.uint8)
    return whole


def _name(raw: bytes) -> tuple[int, int]:
    whole = xxhash.xxh3_128_intdigest(raw)
    return (whole >> 64) - (1 << 63), (whole & 0xFFFFFFFF) - (1 << 31)


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive sorted numbers."""
    new = np.flatnonzero(np.concatenate([[True], np.diff(starts) != 1]))
    return starts[new], starts[np.concatenate([new[1:], [len(starts)]]) - 1]


def repeated_ranges(docs: DataFrame, text: str = "text", width: int = WIDTH, gram: int = GRAM, max_cells: int = MAX_CELLS) -> DataFrame:
    """Word ranges [lo, hi) that repeated windows cover: t1, t2 (name of the text), ranges as lo and hi in turn."""
    spark = docs.sparkSession
    whole = sketch(docs, text, width, gram, max_cells)
    cells, shared = whole.cells, spark.sparkContext.broadcast(whole.packed.tobytes())
    columns = ["h1", "h2", "t1", "t2", "lo", "hi"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    schema = "h1 long, h2 int, t1 long, t2 int, lo int, hi int"

    def batch_of(*arrays):
        return pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(arrays, kinds)], names=columns)

    def candidates(batches):
        """Rows with hi = 0: a window to be grouped.  With hi > 0: a range that is known already."""
        filled = Sketch(cells, shared.value)
        for batch in batches:
            texts, gathered, names = batch.column(0), [], []
            for lo, hi in slices(texts):
                part = Slice(texts.slice(lo, hi - lo), width, gram)
                chosen = part.repeated(filled)
                one, two = part.hashes(chosen)
                starts = part.at[chosen]
                owner = np.searchsorted(part.words.starts, starts, "right") - 1
                gathered.append((one, two, owner + lo, starts - part.words.starts[owner]))
            one, two, owner, start = (np.concatenate(x) for x in zip(*gathered)) if gathered else (np.zeros(0, np.uint64),) * 4
            if not len(one):
                continue
            own, owner = np.unique(owner, return_inverse=True)
            names = np.array([_name(texts[int(i)].as_py().encode()) for i in own], np.int64).reshape(-1, 2)
            order = np.lexsort((two, one))
            same = np.concatenate([[False], (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])])
            group = np.cumsum(~same) - 1
            many = np.bincount(group)[group] > 1
            send = np.sort(order[~same])
            settled = np.zeros(len(one), bool)
            settled[order[many]] = True
            # the row that is sent for a settled window carries hi = -1: it needs no answer
            yield batch_of(one[send].view(np.int64), two[send].astype(np.uint32).view(np.int32), names[owner[send], 0], names[owner[send], 1],
                           start[send].astype(np.int32), np.where(settled[send], -1, 0).astype(np.int32))
            place = np.lexsort((start[settled], owner[settled]))
            o, s = owner[settled][place].astype(np.int64), start[settled][place].astype(np.int64)
            if len(o):
                # texts are kept apart by a gap
                first, last = _runs(o * (1 << 40) + s)
                t = first >> 40
                lo, hi = first & ((1 << 40) - 1), (last & ((1 << 40) - 1)) + width
                yield batch_of(names[t, 0] ^ lo, names[t, 1].astype(np.int32), names[t, 0], names[t, 1], lo.astype(np.int32), hi.astype(np.int32))

    def settle(batches):
        """Of rows sorted by hash: ranges that are known, and windows whose hash came twice."""
        last: dict[str, np.ndarray] | None = None
        for batch in batches:
            now = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(columns, batch.columns)}
            if last is not None:
                now = {n: np.concatenate([last[n], now[n]]) for n in columns}
            tail = np.flatnonzero((now["h1"] != now["h1"][-1]) | (now["h2"] != now["h2"][-1]))
            keep_from = int(tail[-1]) + 1 if len(tail) else 0
            last = {n: now[n][keep_from:] for n in columns}
            # of a long run of one hash, what is left need not stay whole
            if len(last["h1"]) > 2 * 10_000:
                yield from answered(last)
                last = {n: np.concatenate([last[n][:2]]) for n in columns}
                last["hi"] = np.full(2, -1, np.int32)
            if keep_from:
                yield from answered({n: now[n][:keep_from] for n in columns})
        if last is not None and len(last["h1"]):
            yield from answered(last)

    def answered(x):
        known = x["hi"] > 0
        if known.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[n][known]) for n in ("t1", "t2", "lo", "hi")], names=["t1", "t2", "lo", "hi"])
        x = {n: x[n][~known] for n in columns}
        if not len(x["h1"]):
            return
        new = np.concatenate([[True], (x["h1"][1:] != x["h1"][:-1]) | (x["h2"][1:] != x["h2"][:-1])])
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        met = (size > 1) | (np.bincount(group, weights=x["hi"] == -1) > 0)
        out = np.flatnonzero(met[group] & (x["hi"] == 0))
        if len(out):
            # hi = 0: the range of one window; rows of a text leave together
            out = out[np.lexsort((x["lo"][out], x["t2"][out], x["t1"][out]))]
            yield pa.RecordBatch.from_arrays([pa.array(x[n][out]) for n in ("t1", "t2", "lo", "hi")], names=["t1", "t2", "lo", "hi"])

    rows = docs.select(text).mapInArrow(candidates, schema).repartition("h1", "h2").sortWithinPartitions("h1", "h2")
    found = rows.mapInArrow(settle, "t1 long, t2 int, lo int, hi int")

    def joined(batches):
        """Ranges of each text, united; rows are sorted by text and start."""
        name, ranges = None, []
        for batch in batches:
            out = []
            for t1, t2, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
                if (t1, t2) != name:
                    if name is not None:
                        out.append((*name, ranges))
                    name, ranges = (t1, t2), []
                hi = hi or lo + width
                if ranges and lo <= ranges[-1]:
                    ranges[-1] = max(ranges[-1], hi)
                else:
                    ranges += [lo, hi]
            if out:
                yield tables(out)
        if name is not None:
            yield tables([(*name, ranges)])

    def tables(out):
        t1, t2, ranges = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(t1, pa.int64()), pa.array(t2, pa.int32()), pa.array(ranges, pa.list_(pa.int32()))],
                                          names=["t1", "t2", "ranges"])

    sorted_rows = found.repartition("t1", "t2").sortWithinPartitions("t1", "t2", "lo")
    return sorted_rows.mapInArrow(joined, "t1 long, t2 int, ranges array<int>")


@carries("n_words", "n_removed", "kept_text")
def remove_repeats(
    docs: DataFrame, keep: list[str], text: str = "text", width: int = WIDTH, gram: int = GRAM, max_cells: int = MAX_CELLS,
) -> DataFrame:
    """For every row: ``keep``, n_words, n_removed, and kept_text (the words left, joined by single spaces)."""
    def make_name():
        def one(texts):
            names = [_name(t.as_py().encode()) if t.is_valid else (0, 0) for t in texts]
            return [[a for a, _ in names], [b for _, b in names]]

        return one

    ranges = repeated_ranges(docs, text, width, gram, max_cells)
    named = per_text(docs, [*keep, text] if text not in keep else keep, text, [("_t1", T.LongType()), ("_t2", T.IntegerType())], make_name)
    both = named.join(ranges, (F.col("_t1") == F.col("t1")) & (F.col("_t2") == F.col("t2")), "left")
    kept = named.select(*keep).schema.fields
    schema = T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("kept_text", T.StringType())])

    def cut(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            texts, ranges = batch.column(len(kept)), batch.column(len(kept) + 1)
            for lo, hi in slices(texts):
                words = split_words(texts.slice(lo, hi - lo))
                gone = np.zeros(len(words.codes) + 1, np.int32)
                for i in range(lo, hi):
                    own = ranges[i].as_py()
                    if own:
                        base = int(words.starts[i - lo])
                        np.add.at(gone, np.array(own[::2]) + base, 1)
                        np.add.at(gone, np.array(own[1::2]) + base, -1)
                left = np.cumsum(gone[:-1]) == 0
                values = np.array([*words.values, b""], object)
                before = np.concatenate([[0], np.cumsum(left)])
                total, stays = np.diff(words.starts), before[words.starts[1:]] - before[words.starts[:-1]]
                spelled = values[words.codes[left]].tolist()
                ends = np.concatenate([[0], np.cumsum(stays)])
                joined = [b" ".join(spelled[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(lo, hi - lo) for k in range(len(kept))), pa.array(total, pa.int64()),
                     pa.array(total - stays, pa.int64()), pa.array(joined, pa.binary()).cast(pa.string())], names=out.names)

    return both.select(*keep, F.col(text).alias("_text"), "ranges").mapInArrow(cut, schema)


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, ["doc_id"]).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
grams AS (SELECT r, i, md5(array_to_string(w[i:i + {WIDTH - 1}], ' ')) AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - {WIDTH - 2})) AS i FROM docs WHERE len(w) >= {WIDTH})),
twice AS (SELECT g FROM grams GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {WIDTH})) AS p FROM grams SEMI JOIN twice USING (g)),
places AS (SELECT r, list(p) AS ps FROM gone GROUP BY r),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t FROM (
    SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs) ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(len(p.ps), 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM docs d LEFT JOIN places p USING (r) LEFT JOIN kept k USING (r)"""
