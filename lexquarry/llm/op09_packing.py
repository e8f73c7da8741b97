"""Packing token sequences shortest-pack-first over the length histogram.

Documents become token ids (plus an end id), cut into pieces of at most ``capacity``.  Only the histogram of piece lengths, at most
``capacity`` numbers, reaches the driver.  Lengths are placed longest first: a piece goes into the shortest open pack (the one with
most room); if it fits nowhere, a new pack is opened.  All pieces of a length and all packs with equal room are handled at once, by
counts of packing patterns.  The patterns are then joined back to the pieces by length and rank: ranks inside a length are taken in
chunks, so a length that a third of the pieces share is not one task.

Tokens come from distinct words: the vocabulary's tokenizer splits at white space first, so the ids of a text are those of its
words in a row.  A word of letters, perhaps with ASCII punctuation behind it, is looked up or encoded together with other new words;
any other word is encoded on its own.

Defined results: a null or empty text has the end id only, so a piece of length 1; repeated rows are packed as often as they occur;
a text longer than ``capacity`` has pieces of ``capacity`` and a last one that may be shorter; extra columns are carried only if named
in ``keep``; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import os
import unicodedata
import zlib
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lexquarry.llm.shared import carries, ranked, reliable_checkpoint
from lexquarry.llm.words import Words, slices, split_words

CAPACITY = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
CACHED_PARTS = 600_000
PUNCTUATION = b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"

_encoders: dict[str, WordEncoder] = {}


class Pool:
    """Id sequences by name, stored in a row; room grows by doubling."""

    def __init__(self) -> None:
        self.number: dict = {}
        self.count, self.used = 0, 0
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def add(self, names: list, flat: np.ndarray, size: np.ndarray) -> None:
        self.number.update(zip(names, range(self.count, self.count + len(names))))
        self.begin = self._put(self.begin, self.count, self.used + np.cumsum(size) - size)
        self.size = self._put(self.size, self.count, size)
        self.flat = self._put(self.flat, self.used, flat)
        self.count, self.used = self.count + len(size), self.used + len(flat)

    @staticmethod
    def _put(room: np.ndarray, at: int, new: np.ndarray) -> np.ndarray:
        if at + len(new) > len(room):
            room = np.concatenate([room[:at], np.zeros(max(at, len(new)), room.dtype)])
        room[at:at + len(new)] = new
        return room

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences one after the other, and the end of each."""
        size = self.size[numbers]
        ends = np.cumsum(size)
        source = np.repeat(self.begin[numbers] - (ends - size), size)
        source += np.arange(len(source))
        return self.flat[source], ends


class WordEncoder:
    """Token ids of words, with a bounded memory of parts seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.parts, self.judged = Pool(), {}
        self.parts.add([b""], np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def heads(self, values: list[bytes]) -> tuple[pa.Array, list[bytes]]:
        """Letters of each word (coded) and the punctuation behind them; of a word that is anything else, nothing and the word.

        The vocabulary's lower case is that of single characters; only A-Z are mapped here.
        """
        trimmed = pc.ascii_rtrim(pa.array(values, pa.binary()).cast(pa.string()), PUNCTUATION.decode())
        plain, size = pc.ascii_is_alpha(trimmed), pc.binary_length(trimmed).to_numpy()
        whole = ~plain.to_numpy(zero_copy_only=False)
        lowered = pc.ascii_lower(trimmed)
        doubtful = np.flatnonzero(whole & (size > 0) & ~pc.string_is_ascii(trimmed).to_numpy(zero_copy_only=False))
        if len(doubtful):
            whole[doubtful] = [not self.made_of_letters(values[i][:n]) for i, n in zip(doubtful.tolist(), size[doubtful].tolist())]
            lowered = pc.if_else(plain, lowered, trimmed)
        coded = pc.if_else(pa.array(whole), "", lowered).dictionary_encode()
        return coded, [v[n:] for v, n in zip(values, np.where(whole, 0, size).tolist())]

    def made_of_letters(self, head: bytes) -> bool:
        if head not in self.judged:
            text = head.decode("utf-8", "replace")
            self.judged[head] = text.isalpha() and "".join(map(str.lower, text)).isalpha() and unicodedata.is_normalized("NFC", text)
        return self.judged[head]

    def learn(self, heads: list[bytes], others: list[bytes]) -> None:
        """Encode new parts; runs of letters are encoded together."""
        known = self.parts.number
        heads = [h for h in heads if h not in known]
        others = [x for x in others if x not in known]
        for lo in range(0, len(heads), 20_000):
            part = heads[lo:lo + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, np.int64)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                self.parts.add(part, ids, np.diff(cuts, prepend=0))
            else:
                others += part
        others = [x for x in dict.fromkeys(others) if x not in known]
        if others:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in others], add_special_tokens=False)]
            self.parts.add(others, np.fromiter(chain.from_iterable(found), np.uint32), np.array([len(x) for x in found], np.int64))

    def ids(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text begins."""
        if len(self.parts.number) + len(self.judged) + 2 * len(words.values) > CACHED_PARTS:
            self.forget()
        coded, tails = self.heads(words.values)
        heads = coded.dictionary.cast(pa.binary()).to_pylist()
        self.learn(heads, list(set(tails)))
        number = self.parts.number
        of_head = np.fromiter(map(number.__getitem__, heads), np.int64, len(heads))
        pair = np.empty((len(tails), 2), np.int64)
        pair[:, 0] = of_head[coded.indices.to_numpy(zero_copy_only=False)] if len(tails) else 0
        pair[:, 1] = np.fromiter(map(number.__getitem__, tails), np.int64, len(tails))
        by_word, ends = self.parts.joined(pair.reshape(-1))
        local = Pool()
        local.add([], by_word, np.diff(ends[1::2], prepend=0))
        flat, ends = local.joined(words.codes)
        return flat, np.concatenate([[0], ends])[words.starts]


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


@carries("start", "length", "ids_crc32", "doc_tokens", "ids")
def pieces(
    docs: DataFrame, keep: list[str], path: str, text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of every text: ``keep``, start, length, ids_crc32, doc_tokens and, if asked for, the ids."""
    kept = docs.select(*keep).schema.fields
    fields = [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType([*kept, *fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out, encode = to_arrow_schema(schema), encoder(path)
        for batch in batches:
            texts = batch.column(len(kept))
            for lo, hi in slices(texts):
                flat, starts = encode.ids(split_words(texts.slice(lo, hi - lo)))
                flat = np.insert(flat, starts[1:], end_id).astype("<u4")
                starts = starts + np.arange(len(starts))
                rows, begin, length, total = [], [], [], []
                for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
                    for s in range(a, b, capacity):
                        rows.append(lo + i)
                        begin.append(s)
                        length.append(min(capacity, b - s))
                        total.append(b - a)
                begin, length, row = np.array(begin, np.int64), np.array(length, np.int64), np.array(rows, np.int64)
                raw = memoryview(flat).cast("B") if len(flat) else memoryview(b"")
                crc = [zlib.crc32(raw[4 * s:4 * (s + n)]) for s, n in zip(begin.tolist(), length.tolist())]
                arrays = [batch.column(k).take(pa.array(row)) for k in range(len(kept))]
                arrays += [pa.array(x, pa.int64()) for x in (begin - starts[row - lo], length, crc, total)]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(
                        pa.array(np.concatenate([begin, [len(flat)]]), pa.int32()), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    return docs.select(*keep, docs[text].alias("_text")).mapInArrow(run, schema)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Packing patterns with their counts; a pattern is (length, times) in turn, from its front."""
    open_packs: dict[int, list] = defaultdict(list)
    room_heap: list[int] = []
    full: list = []

    def put(room: int, count: int, pattern: tuple) -> None:
        if room == 0:
            full.append((count, pattern))
        else:
            if not open_packs[room]:
                heapq.heappush(room_heap, -room)
            open_packs[room].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while room_heap and not open_packs[-room_heap[0]]:
                heapq.heappop(room_heap)
            if room_heap and -room_heap[0] >= length:
                room = -room_heap[0]
                count, pattern = open_packs[room].pop()
                used = min(count, left)
                if used < count:
                    open_packs[room].append((count - used, pattern))
                put(room - length, used, _longer(pattern, length, 1))
            else:
                # a new pack stays the shortest until it has no room for this length
                times = min(capacity // length, left)
                used = left // times
                put(capacity - times * length, used, ((length, times),))
                used *= times
            left -= used
    return full + [x for packs in open_packs.values() for x in packs]


def _longer(pattern: tuple, length: int, times: int) -> tuple:
    if pattern and pattern[-1][0] == length:
        return (*pattern[:-1], (length, pattern[-1][1] + times))
    return (*pattern, (length, times))


def plan_rows(patterns: list) -> list[tuple[int, int, int, int, int, int]]:
    """For each part of a pattern: length, first rank, past the last rank, first sequence, first offset, times."""
    rank: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for count, pattern in patterns:
        offset = 0
        for length, times in pattern:
            first = rank[length]
            rank[length] += count * times
            out.append((length, first, rank[length], sequence, offset, times))
            offset += length * times
        sequence += count
    return out


def pack(rows: DataFrame, order: list[str], capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces.  ``order``: columns that rank the pieces of a length.

    Equal values of ``order`` must mean equal rows.  ``rows`` is read twice: give a stored table.
    """
    spark = rows.sparkSession
    histogram = dict(tuple(r) for r in rows.groupBy(length).count().collect())  # at most ``capacity`` lengths
    plan = spark.createDataFrame(
        plan_rows(shortest_pack_first(histogram, capacity)),
        "p_length long, p_from long, p_to long, p_sequence long, p_offset long, p_times long")
    at = F.col("_rank") - F.col("p_from")
    numbered = ranked(rows, length, order, "_rank")
    # the plan has a bounded number of rows: parts of patterns, of which a histogram of ``capacity`` lengths has few thousand
    placed = numbered.join(
        F.broadcast(plan), (F.col(length) == F.col("p_length")) & (F.col("_rank") >= F.col("p_from")) & (F.col("_rank") < F.col("p_to")))
    return placed.select(
        *rows.columns, (F.col("p_sequence") + F.floor(at / F.col("p_times"))).cast("long").alias("sequence_id"),
        (F.col("p_offset") + F.pmod(at, F.col("p_times")) * F.col(length)).cast("long").alias("offset"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    cut = reliable_checkpoint(pieces(docs, ["doc_id"], vocabulary_path()))
    return pack(cut, ["doc_id", "start", "doc_tokens", "ids_crc32"])
