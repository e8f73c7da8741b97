"""Hidden Markov language model.

Words are observed through classes: each of the ``own_classes`` most frequent words is a class, the others share ``HASHED`` classes
by their ending, and the end of a text is the last class.  A state emits a class, a class emits a word by its corpus count (add 0.1, one
further word reserved for what was never seen), so the model gives every word its own probability while the tables of states stay
small.  Baum-Welch: each task runs scaled forward and backward recursions over its training texts and returns expected counts, which
are summed by state and block of classes; the sums, of fixed size, reach the driver.  For training, a text is cut into runs of at most
``RUN`` tokens; later runs start from a distribution of their own.  Scoring runs the scaled forward recursion over the whole text.

Word counts are exact and cover all training texts.  The ``SHARED_WORDS`` most frequent words are broadcast; a word beyond them
joins the table of counts, so nothing broadcast grows with the corpus, and no join key is hot.

Defined results: a null or empty text is its end token only; a null id counts as the empty text (held out); without any training
text, N and V are 0 and the base score of a token is log10(0.1 / 0.1) = 0; repeated rows are scored (and counted) each; extra columns
are carried only if named in ``keep``.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lexquarry.llm.shared import carries, stored
from lexquarry.llm.words import LOWER, slices, split_words

STATES = 8
OWN_CLASSES = 2000
HASHED = 254
SHARED_WORDS = 300_000
ITERATIONS = 4
RUN = 256
RUN_TOKENS = 1 << 18
BLOCK = 256
ADD = 0.1
#: How often a state keeps itself at first: the texts of one kind then gather in one state within a round.
STAY = 0.95


def hashed_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % HASHED


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of an id as text, modulo ``of``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(of))


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """word, n and its hashed class over all texts; counts are summed in the tasks first."""

    def count(batches):
        for batch in batches:
            texts = batch.column(0)
            for lo, hi in slices(texts, 8 << 20):
                words = split_words(texts.slice(lo, hi - lo), LOWER)
                n = np.bincount(words.codes, minlength=len(words.values))
                seen = np.flatnonzero(n)
                values = pa.array(words.values, pa.binary()).take(pa.array(seen))
                hashed = [hashed_class(words.values[i]) for i in seen.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [values.cast(pa.string()), pa.array(n[seen], pa.int64()), pa.array(hashed, pa.int32())], names=["word", "n", "hashed"])

    parts = docs.select(text).mapInArrow(count, "word string, n long, hashed int")
    return parts.groupBy("word").agg(F.sum("n").alias("n"), F.first("hashed").alias("hashed"))


@dataclass
class Lexicon:
    """Shared words (at most so many; words of one count are shared together) by frequency, and totals for probabilities."""

    shared: dict[bytes, int]
    counts: np.ndarray
    class_size: np.ndarray
    tokens: int
    distinct: int
    texts: int

    def codes(self, values: list[bytes]) -> np.ndarray:
        """Rank of each word among the shared ones, or -1."""
        get = self.shared.get
        return np.fromiter((get(w, -1) for w in values), np.int64, len(values))


def lexicon(counts: DataFrame, texts: int, own_classes: int, shared_words: int) -> Lexicon:
    # how often each count occurs: D distinct counts need D * D / 2 tokens, so this stays small beside the vocabulary
    seen, least = 0, None
    for n, types in sorted((tuple(r) for r in counts.groupBy("n").count().toLocalIterator()), reverse=True):
        seen += types
        if seen > shared_words:
            break
        least = n
    top = counts.where(F.lit(False) if least is None else F.col("n") >= least).select("word", "n").toArrow()
    words, n = top.column("word").cast(pa.binary()).to_pylist(), top.column("n").to_numpy().astype(np.int64)
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    words, n = [words[i] for i in order], n[order]
    size = np.zeros(HASHED)
    tokens = distinct = 0
    for hashed, total, types in counts.groupBy("hashed").agg(F.sum("n"), F.count(F.lit(1))).collect():
        size[hashed] = total + ADD * (types + 1)
        tokens, distinct = tokens + total, distinct + types
    for word, k in zip(words[:own_classes], n[:own_classes].tolist()):
        size[hashed_class(word)] -= k + ADD
    size = np.where(size <= 0, ADD, size)
    return Lexicon({w: i for i, w in enumerate(words)}, n, size, tokens + texts, distinct + (texts > 0), texts)


def observed(docs: DataFrame, keep: list[str], text: str, shared, own_classes: int) -> DataFrame:
    """One row per text: classes of its tokens and sums over its shared words; ``rare`` has its other words with their counts."""
    kept = docs.select(*keep).schema.fields
    words_type = T.ArrayType(T.StringType())
    schema = T.StructType([
        *kept, T.StructField("classes", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()),
        T.StructField("log_count", T.DoubleType()), T.StructField("log_member", T.DoubleType()), T.StructField("rare", words_type),
        T.StructField("rare_n", T.ArrayType(T.IntegerType()))])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        lex, out = shared.value, to_arrow_schema(schema)
        log_n, log_size = np.log10(np.append(lex.counts, 0) + ADD), np.log10(lex.class_size)
        for batch in batches:
            texts = batch.column(len(kept))
            for lo, hi in slices(texts):
                words = split_words(texts.slice(lo, hi - lo), LOWER)
                rank = lex.codes(words.values)
                hashed = np.fromiter(map(hashed_class, words.values), np.int64, len(words.values))
                own = (rank >= 0) & (rank < own_classes)
                class_of = np.where(own, rank, own_classes + hashed)
                value_log = np.where(rank >= 0, log_n[rank], 0.0)
                member_log = np.where(own, 0.0, value_log - log_size[hashed])
                codes, n = words.codes, hi - lo
                owner = words.text_of_word()
                total = np.diff(words.starts)
                classes = np.insert(class_of[codes], words.starts[1:], own_classes + HASHED).astype("<u2")
                ends = words.starts + np.arange(n + 1)
                raw = classes.tobytes()
                is_rare = rank[codes] < 0
                pairs, times = np.unique(owner[is_rare] * (len(words.values) + 1) + codes[is_rare], return_counts=True)
                rare_at = np.searchsorted(pairs // (len(words.values) + 1), np.arange(n + 1)).astype(np.int32)
                rare_words = pa.array(words.values, pa.binary()).cast(pa.string()).take(pa.array(pairs % (len(words.values) + 1), pa.int64()))
                # without a word, bincount gives whole numbers whatever the weights
                sums = [np.bincount(owner, weights=x[codes], minlength=n).astype(np.float64) for x in (value_log, member_log, rank >= 0)]
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(k).slice(lo, n) for k in range(len(kept))),
                    pa.array([raw[2 * a:2 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary()),
                    pa.array(total + 1, pa.int64()), pa.array(sums[2].astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]),
                    pa.ListArray.from_arrays(pa.array(rare_at), rare_words),
                    pa.ListArray.from_arrays(pa.array(rare_at), pa.array(times, pa.int32()))], names=out.names)

    return docs.select(*keep, docs[text].alias("_text")).mapInArrow(run, schema)


@dataclass
class Model:
    """Start of a text, start of a later run, transitions [from, to], and emissions [class, state]."""

    start: np.ndarray
    resume: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_model(states: int, share: np.ndarray, seed: int = 7) -> Model:
    draw = np.random.default_rng(seed)
    emit = share[:, None] * draw.uniform(0.5, 1.5, (len(share), states))
    even = np.full(states, 1 / states)
    move = STAY * np.eye(states) + (1 - STAY) * even
    return Model(even, even.copy(), move, emit / emit.sum(0))


def _steps(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by length, longest first, and how many are longer than t for each t."""
    order = np.argsort(-lengths, kind="stable")
    longer = np.cumsum(np.bincount(lengths, minlength=1)[::-1])[::-1]
    return order, longer[1:] if len(longer) > 1 else longer[:0]


def forward_log10(classes: np.ndarray, begin: np.ndarray, lengths: np.ndarray, model: Model) -> np.ndarray:
    """log10 probability of each class sequence, by the scaled forward recursion over its whole length."""
    order, active = _steps(lengths)
    at, out = begin[order], np.zeros(len(order))
    alpha = np.tile(model.start, (len(order), 1))
    for t, n in enumerate(active.tolist()):
        alpha = alpha[:n] @ model.move if t else alpha[:n]
        alpha = alpha * model.emit[classes[at[:n] + t]]
        scale = alpha.sum(1)
        out[:n] += np.log10(scale)
        alpha /= scale[:, None]
    back = np.empty(len(order))
    back[order] = out
    return back


def expected_counts(classes: np.ndarray, begin: np.ndarray, lengths: np.ndarray, fresh: np.ndarray, model: Model) -> list[np.ndarray]:
    """Baum-Welch counts of runs: start, resume, move, emit, log-likelihood.  ``fresh``: the run begins its text."""
    order, active = _steps(lengths)
    at, fresh = begin[order], fresh[order]
    alphas, scales = [], []
    alpha = np.where(fresh[:, None], model.start, model.resume)
    for t, n in enumerate(active.tolist()):
        alpha = alpha[:n] @ model.move if t else alpha[:n]
        alpha = alpha * model.emit[classes[at[:n] + t]]
        scale = alpha.sum(1, keepdims=True)
        alpha /= scale
        alphas.append(alpha)
        scales.append(scale)
    states = len(model.start)
    move, beta = np.zeros((states, states)), np.ones((0, states))
    gammas, seen = [], []
    for t in range(len(alphas) - 1, -1, -1):
        n, later = len(alphas[t]), len(beta)
        grown = np.ones((n, states))
        if later:
            ahead = model.emit[classes[at[:later] + t + 1]] * beta / scales[t + 1]
            move += alphas[t][:later].T @ ahead
            grown[:later] = ahead @ model.move.T
        beta = grown
        gammas.append(alphas[t] * beta)
        seen.append(classes[at[:n] + t])
    first = gammas[-1] if gammas else np.zeros((0, states))
    gamma, seen = np.concatenate(gammas or [first]), np.concatenate(seen or [np.zeros(0, np.int64)])
    emit = np.stack([np.bincount(seen, weights=gamma[:, k], minlength=len(model.emit)) for k in range(states)], 1)
    likely = sum(float(np.log10(s).sum()) for s in scales)
    return [first[fresh[:len(first)]].sum(0), first[~fresh[:len(first)]].sum(0), move * model.move, emit, np.array([likely])]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Class numbers of all rows and where each row begins."""
    lengths = np.array([len(x) // 2 for x in column.to_pylist()], np.int64)
    classes = np.frombuffer(b"".join(column.to_pylist()), "<u2")
    return classes, np.concatenate([[0], np.cumsum(lengths)])


def baum_welch(sequences: DataFrame, model: Model) -> tuple[Model, float]:
    """One round over all sequences (column ``classes``)."""
    shared = sequences.sparkSession.sparkContext.broadcast(model)
    states, n_classes = len(model.start), len(model.emit)

    def expect(batches):
        total = None
        for batch in batches:
            classes, starts = _flat(batch.column(0))
            begin, fresh, length = [], [], []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                for s in range(a, b, RUN):
                    begin.append(s)
                    fresh.append(s == a)
                    length.append(min(RUN, b - s))
            begin, fresh, length = np.array(begin, np.int64), np.array(fresh, bool), np.array(length, np.int64)
            cut = np.cumsum(length) // RUN_TOKENS
            for k in np.unique(cut):
                part = cut == k
                got = expected_counts(classes, begin[part], length[part], fresh[part], shared.value)
                total = got if total is None else [x + y for x, y in zip(total, got)]
        if total is not None:
            rows = [("s", 0, total[0]), ("r", 0, total[1]), ("l", 0, total[4])] + [("m", i, total[2][i]) for i in range(states)]
            rows += [("e", k, total[3][k * BLOCK:(k + 1) * BLOCK].reshape(-1)) for k in range(-(-n_classes // BLOCK))]
            yield _table(rows)

    def add(batches):
        key, total = None, None
        for batch in batches:
            for kind, k, values in zip(*(c.to_pylist() for c in batch.columns)):
                if (kind, k) != key:
                    if key is not None:
                        yield _table([(*key, total)])
                    key, total = (kind, k), np.zeros(len(values))
                total = total + np.array(values)
        if key is not None:
            yield _table([(*key, total)])

    schema = "kind string, k int, counts array<double>"
    sums = sequences.select("classes").mapInArrow(expect, schema)
    sums = sums.repartition("kind", "k").sortWithinPartitions("kind", "k").mapInArrow(add, schema)
    got = {(r[0], r[1]): np.array(r[2]) for r in sums.collect()}  # numbers of states and classes, not of texts
    if not got:
        return model, 0.0
    move = np.stack([got["m", i] for i in range(states)])
    emit = np.concatenate([got["e", k] for k in range(-(-n_classes // BLOCK))]).reshape(-1, states)
    share = emit.sum(1)
    emit = emit + 1e-2 * states * (share + ADD)[:, None] / (share + ADD).sum() + 1e-9
    even = lambda x: (x + ADD) / (x + ADD).sum()
    found = Model(even(got["s", 0]), even(got["r", 0]), (move + ADD) / (move + ADD).sum(1, keepdims=True), emit / emit.sum(0))
    return found, float(got["l", 0][0])


def _table(rows: list) -> pa.RecordBatch:
    kinds, numbers, counts = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds), pa.array(numbers, pa.int32()), pa.array([c.tolist() for c in counts], pa.list_(pa.float64()))],
        names=["kind", "k", "counts"])


@carries("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
def score_texts(
    docs: DataFrame, keep: list[str], held_out: Column, text: str = "text", states: int = STATES, iterations: int = ITERATIONS,
    own_classes: int = OWN_CLASSES, shared_words: int = SHARED_WORDS,
) -> DataFrame:
    """``keep``, held_out, n_tokens, n_known, train_tokens, base_score and score of every text.

    The model learns from the texts that are not held out.
    """
    spark = docs.sparkSession
    rows = docs.select(*keep, docs[text].alias("_words"), held_out.alias("held_out"))
    training = rows.where("not held_out")
    counts = stored(word_counts(training, "_words"))
    lex = lexicon(counts, training.count(), own_classes, shared_words)
    shared = spark.sparkContext.broadcast(lex)
    seen = observed(rows, [*keep, "held_out"], "_words", shared, own_classes).withColumn("_row", F.monotonically_increasing_id())
    seen = stored(seen)
    share = np.concatenate([np.zeros(own_classes), lex.class_size, [lex.texts]])
    share[:min(own_classes, len(lex.counts))] = lex.counts[:own_classes]
    model = first_model(states, (share + ADD) / (share + ADD).sum())
    for _ in range(iterations):
        model, _likely = baum_welch(seen.where("not held_out"), model)
    trained = spark.sparkContext.broadcast(model)

    kept = seen.drop("classes", "rare", "rare_n").columns
    schema = T.StructType([*seen.select(*kept).schema.fields, T.StructField("log_classes", T.DoubleType())])

    def score(batches):
        for batch in batches:
            classes, starts = _flat(batch.column(len(kept)))
            found = forward_log10(classes, starts[:-1], np.diff(starts), trained.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(found)], names=schema.names)

    scored = seen.select(*kept, "classes").mapInArrow(score, schema)
    # words beyond the shared ones meet their counts by a join; such a word has at most 1 / shared_words of all tokens
    rare = seen.select("_row", F.explode(F.arrays_zip("rare", "rare_n")).alias("w")).select("_row", F.col("w.rare").alias("word"), F.col("w.rare_n").alias("times"))
    looked = rare.join(counts.select("word", "n"), "word", "left").groupBy(F.col("_row").alias("_r")).agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + ADD)).alias("rare_log"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    both = scored.join(looked, F.col("_row") == F.col("_r"), "left")
    rare_log, rare_known = F.coalesce("rare_log", F.lit(0.0)), F.coalesce("rare_known", F.lit(0))
    base_size = float(np.log10(lex.tokens + ADD * (lex.distinct + 1)))
    end = float(np.log10(lex.texts + ADD))
    return both.select(
        *keep, "held_out", "n_tokens", (F.col("known") + rare_known + int(lex.texts > 0)).cast("long").alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("log_count") + rare_log + end - F.col("n_tokens") * base_size).alias("base_score"),
        (F.col("log_classes") + F.col("log_member") + rare_log).alias("score"))


def op7_hmm(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return score_texts(docs, ["doc_id"], remainder(F.col("doc_id"), 10) == 0)


