"""Extraction, registry and lookup of forms."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from lexquarry.functions import forms as P
from lexquarry.functions.refs import normalize_section
from lexquarry.functions.text import form_filename, normalize_key, slugify, strip
from lexquarry.operators.scans import running
from lexquarry.operators.topk import top_k
from lexquarry.session import reliable_checkpoint
from lexquarry.sizing import BROADCAST_ROWS, fits, join_bounded, join_shuffled, union_all
from lexquarry.sources.tables import spread

# Words a query and a title do not match on.
TITLE_STOP = ["the", "of", "to", "an", "a", "for", "in", "by", "under"]
QUERY_STOP = [*TITLE_STOP, "show", "give", "what", "is", "form"]
# How a query names a form or a section.
FORM_NUMBER = r"(?i)(?:^|\b)(?:bnss\s+)?form\s+(?:no\.?|#)?\s*(\d+)(?:\b|$)"
SECTION = r"(?i)(?:^|\b)(?:under\s+)?(?:section|sec\.?|s\.|u/s)\s*(\d+(?:\s*\(\s*[0-9a-zA-Z]+\s*\))*)"
MIN_SCORE, SURE, LEAD, MAYBE, CANDIDATE, MAX_CANDIDATES = 0.3, 0.70, 0.15, 0.50, 0.45, 5


def _two(n: Column) -> Column:
    s = n.cast("string")
    return F.when(F.length(s) < 2, F.lpad(s, 2, "0")).otherwise(s)


def parse_forms(lines: DataFrame, group: list[str], with_heads: list[int] = (33,),
                dropped: list[str] = ()) -> DataFrame:
    """One row per form, from its ``FORM No.`` line to the next one.

    ``with_heads`` lists the forms that hold charge heads, ``dropped`` lines of
    the printer.
    """
    rows = lines.withColumn("text", strip(F.col("text"))).where(
        (F.col("text") != "") & ~F.col("text").rlike(P.RUNNING_HEAD))
    if dropped:
        rows = rows.where(~F.col("text").isin(list(dropped)))
    number = F.regexp_extract("text", P.HEADER, 1)
    # a number beyond an int is no form number
    rows = rows.withColumns({"_number": number, "_start": number.try_cast("int").isNotNull()})
    rows = running(rows, group, "page", ["line_no"], sums={"seq": F.col("_start").cast("int")}).where(F.col("seq") > 0)
    blocks = rows.groupBy(*group, "seq").agg(
        F.max(F.when(F.col("_start"), F.col("_number"))).cast("int").alias("form_number"),
        F.min("page").alias("page_start"), F.max("page").alias("page_end"),
        F.transform(F.sort_array(F.collect_list(F.struct("page", "line_no", "text"))), lambda x: x["text"]).alias("lines"))
    blocks = blocks.withColumns({"raw_text": F.array_join("lines", "\n"), "_p": P.title_and_sections(F.col("lines"))})
    prefix = F.concat(F.lit("bnss_f"), _two(F.col("form_number")))
    return blocks.select(
        *group, "seq", F.concat(F.lit("BNSS_FORM_"), _two(F.col("form_number"))).alias("form_id"), "form_number",
        F.col("_p.title").alias("form_title"), F.col("_p.sections").alias("applicable_sections"), "page_start", "page_end",
        "raw_text", P.fields(F.col("_p.body"), prefix).alias("fields"), P.signatures(F.col("_p.body")).alias("signatures"),
        F.when(F.col("form_number").isin(list(with_heads)), P.charge_heads(F.col("raw_text"))).otherwise(
            F.filter(P.charge_heads(F.lit("")), lambda h: F.lit(False))).alias("heads"),
        provenance(F.col("form_number")).alias("provenance"))


def provenance(number: Column) -> Column:
    return F.concat(F.lit("[BNSS Second Schedule, Form "), number.cast("string"), F.lit("]"))


def form_list(forms: DataFrame, manifest: DataFrame, expected: int = 58, api_prefix: str = "/api/v1") -> DataFrame:
    """Forms with their manifest entries; values the manifest lacks are computed."""
    m = manifest.select("form_number", F.lit(True).alias("_cached"), *[
        F.col(c).alias(f"_m_{c}") for c in ("filename", "slug", "byte_size", "sha256", "extraction_confidence", "needs_review")])
    parts = F.size("fields") + F.size("signatures") + F.size("heads")
    own = P.extraction_confidence(F.col("form_number"), F.col("form_title"), F.col("raw_text"),
                                  F.size("applicable_sections"), parts, expected)
    joined = forms.withColumn("_own", own).join(m, "form_number", "left")
    cached = F.coalesce("_cached", F.lit(False))
    return joined.select(
        "form_number", "form_id", F.col("form_title").alias("title"),
        F.when(cached, F.col("_m_slug")).otherwise(slugify(F.col("form_title"))).alias("slug"),
        F.when(cached, F.col("_m_filename")).otherwise(form_filename(F.col("form_number"), F.col("form_title"))).alias("filename"),
        "applicable_sections", "page_start", "page_end", (F.col("page_end") - F.col("page_start") + 1).alias("page_count"),
        F.col("_m_byte_size").alias("byte_size"), F.col("_m_sha256").alias("sha256"),
        F.when(cached, F.coalesce("_m_extraction_confidence", F.lit(1.0))).otherwise(F.col("_own.confidence")).alias("extraction_confidence"),
        F.when(cached, F.coalesce("_m_needs_review", F.lit(False))).otherwise(F.col("_own.needs_review")).alias("needs_review"),
        F.concat(F.lit(f"{api_prefix}/forms/"), F.col("form_number").cast("string"), F.lit("/download")).alias("download_url"),
        "provenance")


def section_keys(forms: DataFrame) -> DataFrame:
    """(key, form_number): every section of a form, and its leading digits."""
    ref = forms.select("form_number", F.explode("applicable_sections").alias("_s"))
    full = normalize_section(F.col("_s"))
    keys = F.filter(F.array(full, F.regexp_extract(full, r"^\d+", 0)), lambda k: k != "")
    return ref.select("form_number", F.explode(keys).alias("key")).distinct()


def forms_by_section(queries: DataFrame, forms: DataFrame, section: str = "section",
                     broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(query columns, form_number) for queries that name a section."""
    asked = queries.withColumn("key", normalize_section(F.col(section)))
    return join_bounded(section_keys(forms), asked, ["key"], max_rows=broadcast_rows).drop("key").select(*queries.columns, "form_number")


def forms_by_title(queries: DataFrame, forms: DataFrame, text: str = "query_text",
                   broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(query columns, form_number) on equal normalised titles; the last form of a title wins."""
    titles = forms.groupBy(normalize_key(F.col("form_title")).alias("_key")).agg(F.max("form_number").alias("form_number"))
    return join_bounded(queries.withColumn("_key", normalize_key(F.col(text))), titles, ["_key"],
                        max_rows=broadcast_rows).drop("_key")


def form_by_key(queries: DataFrame, forms: DataFrame, key: str = "key") -> DataFrame:
    """Form by number when the key is digits, else by id; null when there is none."""
    asked = queries.withColumn("_k", strip(F.col(key)))
    by_number = forms.select(F.col("form_number").cast("string").alias("_k"), F.col("form_number").alias("_by_number"))
    by_id = forms.select(F.upper("form_id").alias("_id"), F.col("form_number").alias("_by_id"))
    joined = asked.withColumns({
        "_id": F.upper("_k"), "_k": F.when(F.col("_k").rlike(r"^\d+$"), F.regexp_replace("_k", r"^0+(?=\d)", ""))})
    return joined.join(by_number, "_k", "left").join(by_id, "_id", "left").withColumn(
        "form_number", F.when(F.col("_k").isNotNull(), F.col("_by_number")).otherwise(F.col("_by_id"))
    ).drop("_k", "_id", "_by_number", "_by_id")


def _tokens(text: Column, stop: list[str]) -> Column:
    words = F.filter(F.split(normalize_key(text), " "), lambda w: (w != "") & ~w.isin(stop))
    return F.array_distinct(words)


def _needed(nq: Column, nt: Column) -> Column:
    """Shared words below which no score passes; 0.6 n / nq + 0.8 n / (nq + nt) is the score of n shared words."""
    return F.floor(F.lit(MIN_SCORE) / (F.lit(0.6) / nq + F.lit(0.8) / (nq + nt)) - F.lit(1e-9)) + 1


def _rarest_first(rows: DataFrame, words: str, key: list[str], counts: DataFrame, broadcast_rows: int) -> DataFrame:
    """``key`` and ``words`` with ``known``: the words that titles have, rarest first."""
    each = rows.distinct().withColumn("word", F.explode(words))
    placed = join_bounded(each, counts, ["word"], max_rows=broadcast_rows)
    known = F.transform(F.sort_array(F.collect_list(F.struct("_df", "word"))), lambda x: x["word"])
    return placed.groupBy(*key, words).agg(known.alias("known"))


# Pairs of a word that a task of ``fuzzy_scores`` meets, on average.
CELL_PAIRS = 50_000_000
# Words up to which lists are compared one by one.
FEW_WORDS = 4


def _shared(words: Column, held: Column) -> Column:
    """How many of the distinct ``words`` are in ``held``; the function of sets costs more than a few comparisons."""
    few = sum((F.coalesce(F.array_contains(held, F.get(words, F.lit(i))), F.lit(False)).cast("int") for i in range(FEW_WORDS)), F.lit(0))
    return F.when(F.size(words) <= FEW_WORDS, few).otherwise(F.size(F.array_intersect(words, held)))


def _meet(asked: DataFrame, titles: DataFrame, on: list[str], query: str, broadcast_rows: int) -> DataFrame:
    """Join on ``on``; a key of many pairs is dealt to a grid of parts of its queries and parts of its titles, by their numbers.

    Every query is copied to a row of cells and every title to a column: parts of as many titles as queries make the fewest copies.
    """
    counted = [rows.groupBy(*on).agg(F.count(F.lit(1)).alias(n)) for rows, n in ((asked, "_n_asked"), (titles, "_n_titles"))]
    load = counted[0].join(counted[1], on).withColumn("_pairs", F.col("_n_asked") * F.col("_n_titles").cast("double"))
    total = load.agg(F.sum("_pairs")).first()[0] or 0
    if total <= CELL_PAIRS:
        return join_bounded(asked, titles, on, max_rows=broadcast_rows)
    side, parts = F.lit(CELL_PAIRS ** 0.5), F.col("_pairs") / CELL_PAIRS
    # a side smaller than that stays whole
    across = F.greatest(F.lit(1), F.least(F.ceil(F.col("_n_titles") / side), F.ceil(parts)))
    hot = load.where(F.col("_pairs") > CELL_PAIRS).select(
        *on, across.cast("int").alias("_across"), F.ceil(parts / across).cast("int").alias("_down"))
    hot = reliable_checkpoint(hot)
    hot = F.broadcast(hot) if fits(hot, BROADCAST_ROWS) else hot
    down, across = F.coalesce("_down", F.lit(1)), F.coalesce("_across", F.lit(1))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = asked.join(hot, on, "left").withColumn("_i", F.pmod(F.xxhash64(query), down).cast("int")).withColumn("_j", every(across))
    right = titles.join(hot, on, "left").withColumn("_j", F.pmod(F.xxhash64("form_number"), across).cast("int")).withColumn("_i", every(down))
    tasks = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(total / CELL_PAIRS))
    at = [*on, "_i", "_j"]
    left, right = (rows.drop("_down", "_across").repartition(tasks, *at) for rows in (left, right))
    return left.join(right.hint("merge"), at)


def fuzzy_scores(queries: DataFrame, forms: DataFrame, query: str = "query_id", text: str = "query_text",
                 broadcast_rows: int = BROADCAST_ROWS, digits: int | None = None) -> DataFrame:
    """(query, form_number, match_score) of similar titles: 0.6 precision + 0.4 F1, above 0.3, rounded to ``digits``.

    The numbers of words of a query and a title give the words they have to share.  If they share that many, then one of the first
    words of both, rarest first, is shared, so a common word at the end of a list joins nothing.  A pair is kept at the first word
    that it shares: only the words before it are looked for, and those after it counted.  Scores depend on three numbers of words and
    are listed before the join.  Titles and queries with their words are checkpointed; pairs are neither stored nor shuffled.
    """
    # a small file is one split
    titles = reliable_checkpoint(spread(forms.select("form_number", "form_title")).select(
        "form_number", _tokens(F.col("form_title"), TITLE_STOP).alias("_t")))
    counts = reliable_checkpoint(titles.select(F.explode("_t").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("_df")))
    titles = reliable_checkpoint(_rarest_first(titles, "_t", ["form_number"], counts, broadcast_rows).select(
        "form_number", F.size("_t").alias("_nt"), F.col("known").alias("_words")))
    asked = spread(queries.select(query, text)).select(query, _tokens(F.col(text), QUERY_STOP).alias("_q"))
    asked = reliable_checkpoint(_rarest_first(asked, "_q", [query], counts, broadcast_rows).select(query, F.size("_q").alias("_nq"), "known"))
    asked = asked.withColumn("_nt", F.explode(titles.agg(F.collect_set("_nt")).scalar()))

    def score(n: Column) -> Column:
        p, r = n / F.col("_nq"), n / F.col("_nt")
        s = 0.6 * p + 0.4 * (2 * p * r / (p + r))
        return F.when(s > MIN_SCORE, s if digits is None else F.round(s, digits))

    scores = F.transform(F.sequence(F.lit(1), F.least("_nq", "_nt")), score)
    asked = asked.select(query, "_nt", "known", scores.alias("_scores"), (F.col("_nq") - _needed(F.col("_nq"), F.col("_nt"))).alias("_last"),
                         (F.col("_nt") - _needed(F.col("_nq"), F.col("_nt"))).alias("_last_place"))
    asked = asked.select("*", F.posexplode("known").alias("_at", "word")).where(F.col("_at") <= F.col("_last")).select(
        query, "word", "_nt", "_scores", "_last_place", F.slice("known", 1, F.col("_at")).alias("_before"),
        F.slice("known", F.col("_at") + 2, F.size("known")).alias("_after"))
    titles = titles.select("form_number", "_nt", "_words", F.posexplode("_words").alias("_place", "word"))
    met = _meet(asked, titles, ["word", "_nt"], query, broadcast_rows).where(
        (F.col("_place") <= F.col("_last_place")) & (_shared(F.col("_before"), F.col("_words")) == 0))
    found = F.get("_scores", _shared(F.col("_after"), F.col("_words")))
    return met.select(query, "form_number", found.alias("match_score")).where(F.col("match_score").isNotNull())


# Words up to which pairs of a title's or a query's words are listed.
PAIR_WORDS = 32


def _pairs(words: Column, last: Column | None = None) -> Column:
    """Pairs (a, b) of words, a before b; with ``last`` those whose a and b are in the first ``last`` and ``last`` + 1."""
    size = F.size(words) if last is None else last + 1
    return F.flatten(F.transform(F.slice(words, 1, F.greatest(size - 1, F.lit(0))), lambda a, i: F.transform(
        F.slice(words, i + 2, F.greatest(size - 1 - i, F.lit(0))), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def similar_titles(queries: DataFrame, forms: DataFrame, k: int = MAX_CANDIDATES, query: str = "query_id", text: str = "query_text",
                   broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(query, form_number, match_score, rank): the first ``k`` rows per query of ``fuzzy_scores``, without its other pairs.

    Among titles of one length the score grows with the shared words alone.  A title that shares one word (or two) with a query is
    therefore among the ``k`` smallest numbers of that word (or pair) and length, or ``k`` others come before it.  Only pairs that
    share three words are met one by one, by their two rarest.  Queries of equal words are searched once; queries and titles of more
    than ``PAIR_WORDS`` words go through ``fuzzy_scores``.
    """
    titles = forms.select("form_number", _tokens(F.col("form_title"), TITLE_STOP).alias("_t"))
    counts = reliable_checkpoint(titles.select(F.explode("_t").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("_df")))
    titles = reliable_checkpoint(_rarest_first(titles, "_t", ["form_number"], counts, broadcast_rows).select(
        "form_number", F.size("_t").alias("_nt"), F.col("known").alias("_words")))
    asked = _rarest_first(queries.select(query, _tokens(F.col(text), QUERY_STOP).alias("_q")), "_q", [query], counts, broadcast_rows)
    asked = reliable_checkpoint(asked.select(query, F.size("_q").alias("_nq"), "known"))
    sets = asked.where(F.size("known") <= PAIR_WORDS).select("_nq", "known").distinct()
    short = titles.where(F.col("_nt") <= PAIR_WORDS)

    met = []
    for part in (lambda words: F.transform(words, lambda a: F.struct(a.alias("a"), F.lit("").alias("b"))), _pairs):
        first = top_k(short.select("form_number", "_nt", "_words", F.inline(part(F.col("_words")))), ["a", "b", "_nt"],
                      [F.col("form_number").asc()], k).drop("rank")
        met.append(join_bounded(sets.select("_nq", "known", F.inline(part(F.col("known")))), first, ["a", "b"], max_rows=broadcast_rows))
    rarest = [rows.select("*", F.inline(_pairs(F.col(words), F.size(words) - 2))) for rows, words in ((sets, "known"), (short, "_words"))]
    three = join_bounded(*rarest, ["a", "b"], max_rows=broadcast_rows).withColumn("_both", F.array_intersect("known", "_words"))
    met.append(three.where((F.size("_both") > 2) & (F.col("_both")[0] == F.col("a")) & (F.col("_both")[1] == F.col("b"))))
    pairs = union_all([m.select("_nq", "known", "form_number", "_nt", F.size(F.array_intersect("known", "_words")).alias("_n")) for m in met])
    p, r = F.col("_n") / F.col("_nq"), F.col("_n") / F.col("_nt")
    pairs = pairs.distinct().withColumn("match_score", 0.6 * p + 0.4 * (2 * p * r / (p + r))).where(F.col("match_score") > MIN_SCORE)
    order = [F.round("match_score", 12).desc(), F.col("form_number").asc()]
    best = top_k(pairs, ["_nq", "known"], order, k).select("_nq", "known", "form_number", "match_score")
    found = join_bounded(asked, best, ["_nq", "known"], max_rows=broadcast_rows).select(query, "form_number", "match_score")

    wide_asked, wide_titles = asked.where(F.size("known") > PAIR_WORDS), titles.where(F.col("_nt") > PAIR_WORDS)
    if not fits(wide_asked, 0):
        found = found.unionByName(fuzzy_scores(queries.join(wide_asked.select(query), query, "left_semi"), forms, query, text, broadcast_rows))
    if not fits(wide_titles, 0):
        found = found.unionByName(fuzzy_scores(queries, forms.join(wide_titles.select("form_number"), "form_number", "left_semi"), query, text, broadcast_rows))
    return top_k(found.distinct(), [query], order, k)


def named(queries: DataFrame, forms: DataFrame, query: str = "query_id", text: str = "query_text",
          broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The form number and the section that a query names, and what forms they have.

    Forms are counted by section before queries meet them.
    """
    q = strip(F.col(text))
    number = F.regexp_extract(q, FORM_NUMBER, 1)
    bare = F.when(q.rlike(r"^\d+$"), q)
    asked = queries.select(query, text, q.alias("_q"), F.coalesce(F.nullif(number, F.lit("")), bare).alias("_number"),
                           F.nullif(strip(F.regexp_extract(q, SECTION, 1)), F.lit("")).alias("_section"))
    asked = asked.withColumn("_number", F.regexp_replace("_number", r"^0+(?=\d)", ""))
    numbers = forms.select(F.col("form_number").cast("string").alias("_number"), F.col("form_number").alias("_by_number"))
    out = join_bounded(asked, numbers.distinct(), ["_number"], "left", max_rows=broadcast_rows)
    sections = section_keys(forms).groupBy("key").agg(F.count(F.lit(1)).alias("_n_section"), F.min("form_number").alias("_by_section"))
    out = out.withColumn("key", F.when(F.col("_number").isNull(), normalize_section(F.col("_section"))))
    return join_bounded(out, sections, ["key"], "left", max_rows=broadcast_rows).drop("key")


def lookup(queries: DataFrame, forms: DataFrame, query: str = "query_id", text: str = "query_text",
           broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Status, form and candidates of every query.

    Tried in order: form number, bare number, section, exact title, similar
    titles.  A number that no form has ends the search; a section without
    forms does not.
    """
    # both are read many times, and a small file is one split
    forms = reliable_checkpoint(spread(forms.select("form_number", "form_title", "applicable_sections")))
    queries = reliable_checkpoint(spread(queries.select(query, text)))
    out = named(queries, forms, query, text, broadcast_rows)
    titles = forms.groupBy(normalize_key(F.col("form_title")).alias("_key")).agg(F.max("form_number").alias("_by_title"))
    out = out.withColumn("_key", F.when(F.col("_number").isNull(), normalize_key(F.col("_q"))))
    # used again by the search for similar titles
    out = reliable_checkpoint(join_bounded(out, titles, ["_key"], "left", max_rows=broadcast_rows).drop("_key"))

    fuzzy_open = F.col("_number").isNull() & F.col("_n_section").isNull() & F.col("_by_title").isNull()
    ranked = similar_titles(out.where(fuzzy_open).select(query, "_q"), forms, MAX_CANDIDATES, query, "_q", broadcast_rows)
    best = ranked.groupBy(query).agg(
        F.max(F.when(F.col("rank") == 1, F.col("match_score"))).alias("_s1"),
        F.max(F.when(F.col("rank") == 2, F.col("match_score"))).alias("_s2"),
        F.max(F.when(F.col("rank") == 1, F.col("form_number"))).alias("_f1"),
        F.sort_array(F.collect_list(F.when(F.col("match_score") >= CANDIDATE, F.struct(
            "rank", "form_number", F.round("match_score", 2).alias("match_score"))))).alias("_cands"))
    out = join_shuffled(out, best, query, "left")

    sure = (F.col("_s1") >= SURE) & (F.col("_s2").isNull() | (F.round(F.col("_s1") - F.col("_s2"), 12) >= LEAD))
    step = (
        F.when(F.col("_q") == "", "empty").when(F.col("_number").isNotNull(), "number")
        .when(F.col("_n_section").isNotNull(), "section").when(F.col("_by_title").isNotNull(), "title")
        .when(F.col("_s1").isNotNull(), "similar").otherwise("none")
    )
    out = out.withColumn("step", step)
    status = (
        F.when(step == "number", F.when(F.col("_by_number").isNotNull(), "SUCCESS").otherwise("NOT_FOUND"))
        .when(step == "section", F.when(F.col("_n_section") == 1, "SUCCESS").otherwise("AMBIGUOUS"))
        .when(step == "title", "SUCCESS")
        .when(step == "similar", F.when(sure, "SUCCESS").when(F.col("_s1") >= MAYBE, "AMBIGUOUS").otherwise("NOT_FOUND"))
        .otherwise("NOT_FOUND")
    )
    form = (
        F.when(step == "number", F.col("_by_number")).when((step == "section") & (F.col("_n_section") == 1), F.col("_by_section"))
        .when(step == "title", F.col("_by_title")).when((step == "similar") & sure, F.col("_f1"))
    )
    candidates = F.when((step == "similar") & (status == "AMBIGUOUS"), F.transform("_cands", lambda c: c["form_number"]))
    return out.select(query, text, "step", status.alias("status"), form.alias("form_number"),
                      F.when((step == "section") & (F.col("_n_section") > 1), F.col("_n_section")).alias("n_section_forms"),
                      candidates.alias("similar_forms"), (status == "NOT_FOUND").alias("is_refused"))


def section_candidates(queries: DataFrame, forms: DataFrame, looked_up: DataFrame, query: str = "query_id",
                       text: str = "query_text") -> DataFrame:
    """The forms behind an ambiguous section, as rows: a section may have any number of forms.

    ``looked_up``: rows of ``lookup``, or of ``named``, which is all that it takes.
    """
    if "step" in looked_up.columns:
        wide = looked_up.where((F.col("step") == "section") & (F.col("status") == "AMBIGUOUS")).select(query)
    else:
        wide = looked_up.where(F.col("_number").isNull() & (F.col("_n_section") > 1)).select(query)
    asked = queries.join(wide, query, "left_semi").select(
        query, F.regexp_extract(strip(F.col(text)), SECTION, 1).alias("section"))
    return forms_by_section(asked, forms).select(query, "form_number")


def invariants(forms: DataFrame, expected: int, anchors: dict[int, tuple[int, int | None]] | None = None) -> DataFrame:
    """(code, n) of every broken rule: count, gaps and repeats of numbers, page anchors, titles, texts, page order.

    ``anchors`` maps a form number to its first page and, when known, its last.
    """
    checks = [
        ("FORM_COUNT", F.when(F.count(F.lit(1)) != expected, F.count(F.lit(1)))),
        ("OUT_OF_RANGE", F.count_if(~F.col("form_number").between(1, expected))),
        ("MISSING_NUMBERS", F.lit(expected) - F.count_distinct(F.when(F.col("form_number").between(1, expected), F.col("form_number")))),
        ("DUPLICATE_NUMBERS", F.count(F.lit(1)) - F.count_distinct("form_number")),
        ("SHORT_TITLE", F.count_if(F.length(strip(F.col("form_title"))) < 3)),
        ("SHORT_TEXT", F.count_if(F.length(strip(F.col("raw_text"))) < 50)),
        ("PAGE_ORDER", F.count_if(F.col("page_start") > F.col("page_end"))),
    ]
    for number, (first, last) in (anchors or {}).items():
        wrong = (F.col("page_start") != first) | (F.col("page_end") != last if last is not None else F.lit(False))
        checks.append((f"ANCHOR_{number}", F.count_if((F.col("form_number") == number) & wrong)))
    row = forms.agg(*[c.cast("long").alias(code) for code, c in checks])
    pairs = F.array(*[F.struct(F.lit(code).alias("code"), F.col(code).alias("n")) for code, _ in checks])
    return row.select(F.explode(pairs).alias("p")).select("p.*").where(F.coalesce("n", F.lit(0)) != 0)


def manifest_rows(forms: DataFrame, expected: int = 58) -> DataFrame:
    """Manifest entries of extracted forms; size and hash are those of the form's text."""
    parts = F.size("fields") + F.size("signatures") + F.size("heads")
    conf = P.extraction_confidence(F.col("form_number"), F.col("form_title"), F.col("raw_text"),
                                   F.size("applicable_sections"), parts, expected)
    return forms.withColumn("_c", conf).select(
        "form_number", "form_id", F.col("form_title").alias("title"), slugify(F.col("form_title")).alias("slug"),
        form_filename(F.col("form_number"), F.col("form_title")).alias("filename"),
        F.col("applicable_sections").alias("section_references"), "page_start", "page_end",
        (F.col("page_end") - F.col("page_start") + 1).alias("page_count"),
        F.octet_length("raw_text").cast("long").alias("byte_size"), F.sha2("raw_text", 256).alias("sha256"),
        F.col("_c.confidence").alias("extraction_confidence"), F.col("_c.needs_review").alias("needs_review"), "provenance")
