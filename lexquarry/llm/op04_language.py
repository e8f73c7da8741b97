"""Language identification: script ranges, per-word scores, and Viterbi over the words of a text.

Training sums, in the tasks, how often each language has each letter trigram (hashed to ``BUCKETS`` buckets) and each script; the
sums have languages x buckets entries at most, and only they reach the driver.  A word's score in a language is the log-probability
of its trigrams; the script of its first letter leaves only the languages that use that script.  Viterbi labels the words of a text,
with a penalty for each switch of language, all texts of a slice at once.  A text's language is the one with most of its words;
``score`` is the share of those words times the posterior of that language against the next best on them.

Training rows are all labelled rows given.  Defined results: null texts and texts without a letter are ``und`` with score 0 and no
spans; words without a letter follow their neighbours and do not vote; a script no language uses leaves all languages; without any
labelled row every text is ``und``; ties go to the language that sorts first; repeated rows get equal results; extra columns are
carried only if named in ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lexquarry.llm.op07_hmm import remainder
from lexquarry.llm.shared import carries
from lexquarry.llm.words import LOWER, Words, per_text, slices, split_words

BUCKETS = 1 << 16
SWITCH = 8.0
FLOOR = -12.0
SCRIPT_SHARE = 0.01
UNKNOWN = "und"

# First code point of script ranges of Unicode; ranges without a script of interest are "".
SCRIPTS = [
    (0x0000, "latin"), (0x0250, ""), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, ""), (0x0750, "arabic"), (0x0780, ""), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1400, ""), (0x1780, "khmer"), (0x1800, "mongolian"),
    (0x18B0, ""), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x3040, "kana"), (0x3100, ""), (0x3130, "hangul"),
    (0x3190, ""), (0x31F0, "kana"), (0x3200, ""), (0x3400, "han"), (0x4DC0, ""), (0x4E00, "han"), (0xA000, ""),
    (0xAC00, "hangul"), (0xD7B0, ""), (0xF900, "han"), (0xFB00, "latin"), (0xFB10, ""), (0xFB50, "arabic"), (0xFE00, ""),
    (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF60, "kana"), (0xFFA0, "hangul"), (0xFFE0, ""), (0x20000, "han"), (0x32000, ""),
]
SCRIPT_NAMES = sorted({n for _, n in SCRIPTS})


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@cache
def _script_starts() -> tuple[np.ndarray, np.ndarray]:
    return np.array([s for s, _ in SCRIPTS]), np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS])


def features(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct words: trigram buckets, the word of each, and each word's script (-1: no letter)."""
    script = np.full(len(values), -1)
    points = np.frombuffer((b" " + b" ".join(values) + b" ").decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    gap = points == 32
    word = np.cumsum(gap) - 1
    letters = np.flatnonzero(_letters()[points])
    first_of, at = np.unique(word[letters], return_index=True)
    starts, kinds = _script_starts()
    script[first_of] = kinds[np.searchsorted(starts, points[letters[at]], "right") - 1]
    middle = np.flatnonzero(~gap)
    code = (points[middle - 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (points[middle].astype(np.uint64) * np.uint64(
        0xC2B2AE3D27D4EB4F)) + points[middle + 1].astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (code >> np.uint64(48)).astype(np.int64), word[middle], script


@dataclass
class Languages:
    """names; log-probability of each bucket [bucket, language]; allowed languages [script, language]."""

    names: list[str]
    log: np.ndarray
    allowed: np.ndarray


def train(labelled: DataFrame, text: str, lang: str) -> Languages:
    """Learn from rows with a language; rows without one are left out."""

    def count(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                words = split_words(batch.column(0).slice(lo, hi - lo), LOWER)
                langs = batch.column(1).slice(lo, hi - lo).dictionary_encode()
                of_text = langs.indices.to_numpy(zero_copy_only=False)
                bucket, word, script = features(words.values)
                owner = of_text[words.text_of_word()]
                for k, name in enumerate(langs.dictionary.to_pylist()):
                    times = np.bincount(words.codes[owner == k], minlength=len(words.values))
                    grams = np.bincount(bucket, weights=times[word] * (script[word] >= 0), minlength=BUCKETS)
                    scripts = np.bincount(script[script >= 0], weights=times[script >= 0], minlength=len(SCRIPT_NAMES))
                    n = np.concatenate([grams, scripts]).astype(np.int64)
                    seen = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(n[seen])], names=["lang", "bucket", "n"])

    parts = labelled.where(F.col(lang).isNotNull()).select(text, lang).mapInArrow(count, "lang string, bucket int, n long")
    sums = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages x buckets at most
    names = sorted(set(sums.column("lang").to_pylist()))
    counts = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(names)))
    place = {n: i for i, n in enumerate(names)}
    columns = np.array([place[x] for x in sums.column("lang").to_pylist()], np.int64)
    counts[sums.column("bucket").to_numpy(), columns] = sums.column("n").to_numpy()
    grams, scripts = counts[:BUCKETS], counts[BUCKETS:]
    log = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS))
    allowed = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(0))
    allowed[~allowed.any(1)] = True
    return Languages(names, log.astype(np.float32), allowed)


def word_scores(words: Words, model: Languages) -> tuple[np.ndarray, np.ndarray]:
    """Score of each distinct word in each language, below its best one, and whether it has a letter."""
    bucket, word, script = features(words.values)
    out = np.zeros((len(words.values), len(model.names)), np.float32)
    voting = script[word] >= 0
    for k in range(len(model.names)):
        out[:, k] = np.bincount(word[voting], weights=model.log[bucket[voting], k], minlength=len(out))
    out = np.where((script >= 0)[:, None] & ~model.allowed[script], np.float32(-1e6), out)
    out -= out.max(1, keepdims=True, initial=-np.inf)
    return np.maximum(out, np.float32(FLOOR)), script >= 0


def viterbi(emission: np.ndarray, starts: np.ndarray, switch: float) -> np.ndarray:
    """Best label of every word; ``emission`` [word, label] of texts in a row.  All texts step together, longest first."""
    lengths = np.diff(starts)
    labels = np.zeros(len(emission), np.int32)
    order = np.argsort(-lengths, kind="stable")
    at = starts[:-1][order]
    active = np.cumsum(np.bincount(lengths, minlength=1)[::-1])[::-1][1:].tolist()
    if not active:
        return labels
    own = np.arange(emission.shape[1], dtype=np.int32)
    back, last = [], np.zeros(active[0], np.int32)
    score = None
    for t, n in enumerate(active):
        if t:
            ended = score[n:]
            if len(ended):
                last[n:len(score)] = ended.argmax(1)
            score = score[:n]
            best = score.max(1)[:, None] - switch
            stay = score >= best
            back.append(np.where(stay, own, score.argmax(1).astype(np.int32)[:, None]).astype(np.int16))
            score = np.where(stay, score, best) + emission[at[:n] + t]
            score -= score.max(1)[:, None]
        else:
            score = emission[at[:n]]
    last[:len(score)] = score.argmax(1)
    now = last.copy()
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        labels[at[:n] + t] = now[:n]
        if t:
            now[:n] = back[t - 1][np.arange(n), now[:n]]
    return labels


def label(words: Words, model: Languages, switch: float) -> tuple[list, list, list, list]:
    """Language, score, spans ("language:first word:past the last word") and the language's share of the words of each text."""
    n, kinds = len(words.starts) - 1, len(model.names)
    if not kinds:
        return [UNKNOWN] * n, [0.0] * n, [[] for _ in range(n)], [0.0] * n
    per_value, voting = word_scores(words, model)
    emission, votes = per_value[words.codes], voting[words.codes]
    labels = viterbi(emission, words.starts, switch)
    owner = words.text_of_word()
    count = np.bincount(owner[votes] * kinds + labels[votes], minlength=n * kinds).reshape(n, kinds)
    total, best = count.sum(1), count.argmax(1)
    mine = votes & (labels == best[owner])
    # of no words at all, the sums are whole numbers
    sums = np.stack([np.bincount(owner[mine], weights=emission[mine, k], minlength=n) for k in range(kinds)], 1).astype(np.float64)
    own = sums[np.arange(n), best]
    sums[np.arange(n), best] = -np.inf
    rival = sums.max(1)
    posterior = 1 / (1 + np.exp(np.clip(rival - own, -50, 50))) if kinds > 1 else np.ones(n)
    share = count.max(1) / np.maximum(1, total)
    score = np.where(total > 0, share * posterior, 0.0)
    edge = np.ones(len(labels) + 1, bool)
    edge[1:-1] = (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])
    cuts = np.flatnonzero(edge)
    spans: list[list[str]] = [[] for _ in range(n)]
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        i = owner[lo]
        if total[i]:
            spans[i].append(f"{model.names[labels[lo]]}:{lo - words.starts[i]}:{hi - words.starts[i]}")
    return [model.names[b] if t else UNKNOWN for b, t in zip(best, total)], score.tolist(), spans, share.tolist()


@carries("lang_pred", "score", "lang_spans", "lang_share")
def identify(docs: DataFrame, keep: list[str], model: Languages, text: str = "text", switch: float = SWITCH) -> DataFrame:
    """``keep``, lang_pred, score, lang_spans and lang_share (of the words that vote) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("lang_spans", T.ArrayType(T.StringType())),
              ("lang_share", T.DoubleType())]
    return per_text(docs, keep, text, fields, lambda: lambda texts: label(split_words(texts, LOWER), shared.value, switch))


def learned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Languages:
    """The model of all labelled rows whose id does not hold them out."""
    return train(docs.where(remainder(F.col(doc_id), 3) != 1), text, lang)


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), ["doc_id"], learned(docs))
    return found.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
