"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong candidates stand alone: assigned values of 12 characters and more, access keys, long hexadecimal strings.  Weak candidates are
reported only when a complementary part is near: an assigned value of 6 to 11 characters or a mixed random-looking string (a secret)
needs an identifier or an endpoint, an identifier or an endpoint needs a secret.  A scope is ``SCOPE`` code points to either side of a
candidate inside one text.  Scopes are joined as intervals: each candidate is dealt to the blocks of ``SCOPE`` code points that it
touches, weak ones also to those of their scope, and the two sides meet by text and block, so a block holds a bounded number of
candidates however long the text is.

A text is named by its SHA-256 there, and candidates of equal texts are joined once.  Only texts with parts of both sides are joined.

Defined results: a null text is an empty one and has no span; rows are judged alone, so repeated rows get equal results; null ids are
carried; spans of one start are ordered by kind as listed in ``KINDS``; extra columns are carried only if named in ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexquarry.llm.shared import carries, reliable_checkpoint, stored
from lexquarry.llm.spans import found, masked, of_kind, spelled

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "weak_secret", "random", "identifier", "endpoint"]
SECRET, LINK = "secret", "link"
#: Which part of a credential a kind can be.
PART = {"assign": SECRET, "hex": SECRET, "weak_secret": SECRET, "random": SECRET, "access": LINK, "identifier": LINK, "endpoint": LINK}
WEAK = ["weak_secret", "random", "identifier", "endpoint"]
SCOPE = 200
#: Spans of linked weak candidates that are broadcast.
LINKED_SPANS = 100_000

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
# Our own weak patterns.
RANDOM = r"[A-Za-z0-9+/_=-]{24,}"
IDENTIFIER = r"""(?i)(?:access_?key_?id|client_?id|account|username|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,}"""
ENDPOINT = r"""(?i)(?:https?|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp|s3|ftp)://[^\x00-\x20"'<>]+"""


def candidates(text: Column) -> Column:
    """All candidates of a text: array<struct<start, place, end, kind>>, in order of kinds."""
    def graded(s: Column) -> Column:
        n = F.length(F.regexp_extract(s["value"], ASSIGN, 2))
        strong = n >= 12
        kind, weak = KINDS.index("assign"), KINDS.index("weak_secret")
        return F.struct(
            s["start"].alias("start"), F.when(strong, kind).when(n >= 6, weak).alias("place"), s["end"].alias("end"),
            F.when(strong, "assign").otherwise("weak_secret").alias("kind"))

    assigned = F.filter(F.transform(found(text, ASSIGN), graded), lambda s: s["place"].isNotNull())
    mixed = F.filter(found(text, RANDOM), lambda s: s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[0-9]"))
    of = {"access": found(text, ACCESS), "hex": found(text, HEX), "random": mixed, "identifier": found(text, IDENTIFIER),
          "endpoint": found(text, ENDPOINT)}
    return F.concat(assigned, *(of_kind(s, k, KINDS.index(k)) for k, s in of.items()))


def linked(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """_text and ``links``: weak candidates with a complementary part in their scope, of rows (_text, _weak, _all)."""

    def blocks(lo: Column, hi: Column) -> Column:
        return F.explode(F.sequence(F.floor(lo / scope), F.floor(hi / scope)))

    def part(kind: Column) -> Column:
        return F.when(kind.isin([k for k, p in PART.items() if p == SECRET]), SECRET).otherwise(LINK)

    # every distinct text once
    texts = rows.groupBy("_text").agg(F.first("_weak").alias("weak"), F.first("_all").alias("all"))
    weak = texts.select("_text", F.explode("weak").alias("w")).select(
        "_text", "w", (F.col("w.start") - scope).alias("lo"), (F.col("w.end") + scope).alias("hi"), part(F.col("w.kind")).alias("part"))
    weak = weak.select("*", blocks(F.col("lo"), F.col("hi")).alias("block"))
    there = texts.select(F.col("_text").alias("t"), F.explode("all").alias("c")).select(
        "t", F.col("c.start").alias("start"), F.col("c.end").alias("end"), part(F.col("c.kind")).alias("other"))
    there = there.select("*", blocks(F.col("start"), F.col("end")).alias("at"))
    met = (F.col("_text") == F.col("t")) & (F.col("block") == F.col("at"))
    near = (F.col("start") <= F.col("hi")) & (F.col("end") >= F.col("lo")) & (F.col("part") != F.col("other"))
    return weak.join(there, met & near, "left_semi").groupBy("_text").agg(F.collect_set("w").alias("links"))


@carries("base", "spans")
def scan(docs: DataFrame, keep: list[str], text: str = "text", scope: int = SCOPE, linked_spans: int = LINKED_SPANS) -> DataFrame:
    """``keep``, ``base`` and ``spans`` of every row: arrays of (start, place, end, kind), sorted by start, then kind.

    Texts are read twice and never moved: once for the texts whose parts have to be joined, once for the result.  The links are
    broadcast while they hold at most ``linked_spans`` spans; beyond that, the rows of those texts alone are shuffled to them.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    secret = F.exists("_all", lambda s: s["kind"].isin([k for k in KINDS if PART[k] == SECRET]))
    link = F.exists("_all", lambda s: s["kind"].isin([k for k in KINDS if PART[k] == LINK]))
    rows = docs.select(*keep, content.alias("_content"), candidates(content).alias("_all"))
    rows = rows.withColumn("_weak", F.filter("_all", lambda s: s["kind"].isin(WEAK)))
    name = F.when(secret & link & (F.size("_weak") > 0), F.sha2(F.col("_content").cast("binary"), 256))
    rows = rows.select(*keep, "_all", "_weak", name.alias("_text"))

    # a generator in place of a filter, which would be pushed below the candidates and compute them again
    part = F.struct("_text", "_weak", "_all")
    some = rows.select(F.explode(F.when(F.col("_text").isNotNull(), F.array(part)).otherwise(F.array().cast(
        rows.select(F.array(part).alias("a")).schema["a"].dataType))).alias("o"))
    links = reliable_checkpoint(linked(stored(some.select("o.*")), scope)).withColumnRenamed("_text", "_t")
    same = F.col("_text") == F.col("_t")
    if (links.agg(F.sum(F.size("links"))).first()[0] or 0) <= linked_spans:
        both = rows.join(F.broadcast(links), same, "left")
    else:
        moved = rows.where("_text is not null").join(links, same, "left")
        both = moved.unionByName(rows.where("_text is null"), allowMissingColumns=True)
    base = F.filter("_all", lambda s: s["kind"].isin(BASE))
    all_spans = F.concat(base, F.coalesce("links", F.array().cast(rows.schema["_all"].dataType)))
    return both.select(*keep, F.array_sort(base).alias("base"), F.array_sort(all_spans).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with its spans replaced by their kinds."""
    return masked(text, spans)


def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs, ["doc_id"]).select(
        "doc_id", *(count(k) for k in BASE), F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"))


def _either_case(pattern: str) -> str:
    """The pattern without its (?i), whose meaning beyond ASCII differs between engines."""
    out, inside, escaped = [], 0, False
    for c in pattern.removeprefix("(?i)"):
        if escaped or not c.isalpha() or inside:
            out.append(c)
        else:
            out.append(f"[{c.upper()}{c.lower()}]")
        inside += {"[": 1, "]": -1}.get(c, 0) if not escaped else 0
        escaped = c == "\\" and not escaped
    return "".join(out).replace("'", "''")


def _found_sql(kind: str, pattern: str) -> str:
    return f"""SELECT r, '{kind}' AS found, unnest(m) AS v, unnest(list_transform(range(1, len(m) + 1), lambda i:
      list_sum(list_transform(p[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x)))))::BIGINT AS e
    FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM docs)"""


_ASSIGN_SQL = _either_case(ASSIGN).replace(r"\x20", " ")
_PARTS = {
    "assign": _ASSIGN_SQL, "access": ACCESS, "hex": HEX, "random": RANDOM, "identifier": _either_case(IDENTIFIER).replace(r"\x20", " "),
    "endpoint": _either_case(ENDPOINT),
}
OP1_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
matches AS ({" UNION ALL ".join(_found_sql(k, p) for k, p in _PARTS.items())}),
graded AS (
  SELECT r, e - length(v) AS s, e, CASE WHEN found <> 'assign' THEN found
    WHEN length(regexp_extract(v, '{_ASSIGN_SQL}', 2)) >= 12 THEN 'assign'
    WHEN length(regexp_extract(v, '{_ASSIGN_SQL}', 2)) >= 6 THEN 'weak_secret' END AS kind FROM matches
  WHERE found <> 'random' OR (regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]'))),
spans AS (
  SELECT *, list_position({KINDS}, kind) AS place, kind IN {tuple(BASE)} AS base, kind IN {tuple(k for k, p in PART.items() if p == SECRET)} AS secret
  FROM graded WHERE kind IS NOT NULL),
kept AS (
  SELECT * FROM spans w WHERE base OR EXISTS (
    SELECT 1 FROM spans o WHERE o.r = w.r AND o.secret <> w.secret AND o.s <= w.e + {SCOPE} AND o.e >= w.s - {SCOPE})),
told AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (base) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS spans
  FROM kept GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN told USING (r)"""
