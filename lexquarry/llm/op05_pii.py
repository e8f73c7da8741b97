"""Personal data: high-recall generators, boosted trees on format and context, calibrated thresholds.  DataFrame functions only.

Generators propose spans that may overlap: the base kinds, and looser ones (``loose_at``: anything around an at sign, also spelled
out; ``loose_number``: runs of digits with separators).  Features describe a candidate's format (digits, groups, separators, plus
sign, brackets, last label) and its context (a telling word before it, the characters around it), each with few levels, so all
candidates of the corpus fall into a bounded number of feature vectors.  Their counts, over all rows, with weak labels (a loose
candidate is positive if it covers just what a base kind finds) train gradient-boosted trees on one half of the texts; on the other
half the scores are calibrated: the threshold of a generator is the lowest score at and above which at least ``PRECISION`` of all
candidates are positive.  Vectors above it are accepted, and candidates with such a vector are reported beside the base spans, which
always stay.  Only the table of feature vectors meets the driver; its size does not depend on the rows.

Defined results: a null text is an empty one and has no span; rows are judged alone; null ids are carried; a corpus whose candidates
are all of one label trains nothing and adds nothing; extra columns are carried only if named in ``keep``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexquarry.llm.shared import carries, stored
from lexquarry.llm.spans import found, masked, of_kind, spelled

BASE = ["email", "ip", "card", "phone"]
LOOSE = ["loose_at", "loose_number"]
PRECISION = 0.95
ROUNDS = 12
DEPTH = 4

# The base kinds.  None repeats a group (see ``spans``), so separators that cannot belong to a match are replaced by a
# character of the same length first.
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
LONE_DOT = rf"\.(?![{_LABEL}])|(?<![{_LABEL}])\."
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++\.[{_LABEL}.]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
LONE_GAP = r"[\x20-](?![0-9])|(?<![0-9])[\x20-]"
CARD = r"[0-9][0-9\x20-]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Our own loose generators.
LOOSE_AT = r"[^\s@<>(),;:\"]{1,64}(?:@|\x20?[(\[]at[)\]]\x20?)[^\s@<>(),;:\"]{1,255}"
LOOSE_NUMBER = r"(?<![\w.,-])\+?\(?[0-9][0-9\x20().-]{6,40}[0-9](?![\w-])"
TELLING = r"(?i)(?:tel|phone|call|fax|mobile|cell|mail|contact|card|visa|account|iban|ip|host|addr)[\w.]*[\x20:=#(]*$"

FEATURES = ["generator", "digits", "groups", "plus", "brackets", "dots", "spaces", "at", "ending", "telling", "before", "after"]
LEVELS = [2, 24, 8, 2, 2, 5, 5, 3, 5, 2, 3, 3]


def luhn(digits: Column) -> Column:
    """The check digit of a string of digits is right."""
    doubled = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    none = found(F.lit(""), "x")
    dotted = F.regexp_replace(text, LONE_DOT, "_")
    email = F.when(text.contains("@"), found(dotted, EMAIL)).otherwise(none)
    ip = F.filter(found(text, IP), lambda s: s["value"].rlike(OCTETS))
    card = F.filter(
        F.when(text.rlike(r"[0-9]"), found(F.regexp_replace(text, LONE_GAP, "x"), CARD)).otherwise(none),
        lambda s: (lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))(F.regexp_replace(s["value"], "[ -]", "")))
    phone = F.filter(found(text, PHONE), lambda s: F.length(F.regexp_replace(s["value"], "[^0-9]", "")).between(8, 15))
    return {"email": email, "ip": ip, "card": card, "phone": phone}


def vector(text: Column, s: Column, generator: int) -> Column:
    """Levels of the features of a candidate, as one number."""
    value = s["value"]
    digits = F.regexp_replace(value, "[^0-9]", "")
    before = F.substring(text, F.greatest(F.lit(1), s["start"] - 19), F.least(F.lit(20), s["start"]))
    last = F.regexp_extract(value, r"\.([A-Za-z]+)$", 1)

    def side(c: Column) -> Column:
        return F.when((c == "") | c.rlike(r"^\s$"), 0).when(c.rlike(r"^\w$"), 1).otherwise(2)

    levels = [
        F.lit(generator), F.length(digits), F.size(F.split(F.trim(F.regexp_replace(value, "[^0-9]+", " ")), " ")),
        value.contains("+").cast("int"), value.contains("(").cast("int"), F.length(F.regexp_replace(value, "[^.]", "")),
        F.length(F.regexp_replace(value, "[^ -]", "")), F.when(value.contains("@"), 1).when(value.contains("at"), 2).otherwise(0),
        F.length(last), before.rlike(TELLING).cast("int"), side(F.when(s["start"] > 0, F.substring(before, -1, 1)).otherwise("")),
        side(F.substring(text, s["end"] + 1, 1)),
    ]
    capped = [F.least(x, F.lit(n - 1)).cast("long") for x, n in zip(levels, LEVELS)]
    return reduce(lambda code, pair: code * pair[1] + pair[0], zip(capped[1:], LEVELS[1:]), capped[0])


def features_of(code: Column) -> list[Column]:
    """The levels that ``vector`` packed."""
    out = []
    for name, levels in reversed(list(zip(FEATURES, LEVELS))):
        out.append(F.pmod(code, F.lit(levels)).cast("double").alias(name))
        code = F.floor(code / levels)
    return out[::-1]


def candidates(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """keep, base spans, loose candidates (start, end, kind, code, known), and the half of the text."""
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*keep, content.alias("_c"))
    c = F.col("_c")
    base = base_spans(c)
    rows = rows.select(*keep, "_c", F.concat(*(of_kind(base[k], k, i) for i, k in enumerate(BASE))).alias("base"))

    def loose(pattern: str, kind: str, generator: int) -> Column:
        return F.transform(found(c, pattern), lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), vector(c, s, generator).alias("code"),
            F.exists("base", lambda b: (F.abs(b["start"] - s["start"]) <= 1) & (F.abs(b["end"] - s["end"]) <= 1)).alias("known"),
            F.exists("base", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])).alias("covered")))

    found_loose = F.concat(
        F.when(c.rlike(r"@|[(\[]at[)\]]"), loose(LOOSE_AT, LOOSE[0], 0)).otherwise(F.array()),
        F.when(c.rlike("[0-9]"), loose(LOOSE_NUMBER, LOOSE[1], 1)).otherwise(F.array()))
    return rows.select(*keep, "base", found_loose.alias("loose"), F.pmod(F.crc32(c.cast("binary")), F.lit(2)).alias("half"))


def accepted_codes(rows: DataFrame, precision: float = PRECISION, rounds: int = ROUNDS, depth: int = DEPTH) -> list[int]:
    """Feature vectors that the boosted trees and their thresholds accept."""
    counts = rows.select("half", F.explode("loose").alias("s")).groupBy(
        "half", "s.code", "s.kind", F.col("s.known").cast("double").alias("label")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    # one row per feature vector, label and half, however many candidates there are
    table = stored(counts.coalesce(1)).select("*", *features_of(F.col("code"))).cache()
    try:
        fit = table.where("half = 0")
        if fit.select("label").distinct().count() < 2:
            return []
        assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
        trees = GBTClassifier(labelCol="label", weightCol="n", maxIter=rounds, maxDepth=depth, maxBins=max(LEVELS), seed=5)
        model = trees.fit(assembler.transform(fit))
        score = vector_to_array("probability")[1].alias("score")
        scored = model.transform(assembler.transform(table)).select("half", "kind", "code", "label", "n", score).collect()
    finally:
        table.unpersist()
    accepted = set()
    for kind in LOOSE:
        total = positive = 0.0
        threshold = None
        held = sorted(((r["score"], r["label"], r["n"]) for r in scored if r["kind"] == kind and r["half"] == 1), reverse=True)
        for i, (s, label, n) in enumerate(held):
            total, positive = total + n, positive + n * label
            if (i + 1 == len(held) or held[i + 1][0] < s) and positive >= precision * total:
                threshold = s
        if threshold is not None:
            accepted |= {r["code"] for r in scored if r["kind"] == kind and r["score"] >= threshold}
    return sorted(accepted)


@carries("base", "spans")
def scan(docs: DataFrame, keep: list[str], text: str = "text", precision: float = PRECISION) -> DataFrame:
    """``keep``, ``base`` (by kind, then start) and ``spans`` (base and accepted ones) of every row."""
    rows = stored(candidates(docs, keep, text))
    codes = accepted_codes(rows, precision)
    # an accepted candidate that a base span covers in part adds nothing: the base span stays
    good = F.filter("loose", lambda s: ~s["covered"] & s["code"].isin(codes)) if codes else F.filter("loose", lambda s: F.lit(False))
    more = F.transform(good, lambda s: F.struct(
        s["start"].alias("start"), F.when(s["kind"] == LOOSE[0], len(BASE)).otherwise(len(BASE) + 1).alias("place"), s["end"].alias("end"),
        s["kind"].alias("kind")))
    by_kind = lambda a: F.transform(
        F.array_sort(F.transform(a, lambda s: F.struct(s["place"], s["start"], s["end"], s["kind"]))),
        lambda s: F.struct(s["start"], s["place"], s["end"], s["kind"]))
    return rows.select(*keep, by_kind(F.col("base")).alias("base"), by_kind(F.concat("base", more)).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with its spans replaced by their kinds."""
    return masked(text, F.array_sort(spans))


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs, ["doc_id"]).select(
        "doc_id", *(count(k) for k in BASE), F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"))
