"""Form, tenancy, validation, evaluation, admission, job and metric queries."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexquarry.catalog.search import _asked, _search, bm25_ctes, bm25_top, documents
from lexquarry.catalog.stand_ins import PASSAGES_SQL, passages, table
from lexquarry.catalog.structure import LINES_SQL, _lines
from lexquarry.functions.forms import SCHEDULE_TITLE, extraction_confidence, render_markdown, render_text
from lexquarry.functions.text import document_tokens
from lexquarry.operators import evaluation as Q
from lexquarry.operators import forms as M
from lexquarry.operators import jobs as J
from lexquarry.operators import lexical as L
from lexquarry.operators import metrics as C
from lexquarry.operators import tenancy as N
from lexquarry.operators import validation as V
from lexquarry.operators.admission import admit
from lexquarry.session import checkpoint_folder, reliable_checkpoint
from lexquarry.sizing import join_bounded, join_shuffled, union_all
from lexquarry.sources import buckets
from lexquarry.sources.documents import extract_pages


def _s(c: Column) -> Column:
    return c.cast("string")


# --- forms --------------------------------------------------------------------

def forms(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as forms: number, a title with two coded words and the brand, sections, text."""
    k = F.col("p_partkey")
    words = F.split("p_name", " ")
    title = F.concat_ws(" ", F.concat(F.upper(words[0]), _s(k % 97)), F.concat(words[1], _s(k % 89)), F.lit("of the"),
                        F.regexp_replace("p_brand", "#", ""))
    sections = F.when(k % 9 == 0, F.array().cast("array<string>")).otherwise(F.array(
        _s(k % 531 + 1), F.concat(_s(k * 3 % 531 + 1), F.lit("("), _s(F.col("p_size")), F.lit(")"))))
    empty = F.array().cast("array<struct<signatory_title:string,seal_required:boolean>>")
    return table(spark, folder, "part").select(
        (k + 1).cast("int").alias("form_number"), F.concat(F.lit("BNSS_FORM_"), _s(k + 1)).alias("form_id"), title.alias("form_title"),
        sections.alias("applicable_sections"), (k % 60 + 190).alias("page_start"), (k % 60 + 190 + k % 2).alias("page_end"),
        F.repeat(F.concat(F.col("p_type"), F.lit(" text. ")), F.col("p_size")).alias("raw_text"),
        F.array().cast("array<struct<field_id:string,label:string,field_type:string,raw_text:string,placeholder:string>>").alias("fields"),
        F.when(k % 3 == 0, F.array(F.struct(F.lit("(Signature)").alias("signatory_title"), F.lit(False).alias("seal_required")))).otherwise(empty).alias("signatures"),
        F.array().cast("array<struct<head_number:string,head_title:string,charge_text:string>>").alias("heads"),
        M.provenance(k + 1).alias("provenance"))


FORMS_SQL = """SELECT (p_partkey + 1)::INT AS form_number, 'BNSS_FORM_' || (p_partkey + 1) AS form_id,
  upper(string_split(p_name, ' ')[1]) || (p_partkey % 97) || ' ' || string_split(p_name, ' ')[2] || (p_partkey % 89) || ' of the ' || replace(p_brand, '#', '') AS form_title,
  CASE WHEN p_partkey % 9 = 0 THEN []::VARCHAR[] ELSE [(p_partkey % 531 + 1)::VARCHAR, (p_partkey * 3 % 531 + 1) || '(' || p_size || ')'] END AS applicable_sections,
  p_partkey % 60 + 190 AS page_start, p_partkey % 60 + 190 + p_partkey % 2 AS page_end, repeat(p_type || ' text. ', p_size) AS raw_text,
  CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS n_parts FROM part"""


def form_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Customers ask for forms: by number, digits, section, exact and partial title."""
    n = F.col("c_custkey")
    f = forms(spark, folder).select("form_number", "form_title")
    asked = table(spark, folder, "customer").select(n.alias("query_id"), (n * 3 + 1).cast("int").alias("form_number"))
    word = F.split("form_title", " ")
    text = (
        F.when(n % 6 == 0, F.concat(F.lit("Form No. "), _s(n * 2))).when(n % 6 == 1, _s(n * 5))
        .when(n % 6 == 2, F.concat(F.lit("form under section "), _s(n % 600))).when(n % 6 == 3, F.coalesce("form_title", F.lit("no title")))
        .when(n % 6 == 4, F.concat(F.lit("show "), F.coalesce(word[0], F.lit("nothing")), F.lit(" "), F.coalesce(word[1], F.lit("")), F.lit(" please")))
        .otherwise(F.concat(F.lit("what is "), F.coalesce(word[0], F.lit("x")), F.lit(" "), F.coalesce(word[4], F.lit("y"))))
    ).alias("query_text")
    c = table(spark, folder, "customer").select("c_custkey", F.col("c_custkey").alias("query_id"))
    return join_shuffled(join_shuffled(asked, f, "form_number", "left"), c, "query_id").select("query_id", text)


FORM_QUERIES_SQL = """SELECT n AS query_id, CASE n % 6 WHEN 0 THEN 'Form No. ' || (n * 2) WHEN 1 THEN (n * 5)::VARCHAR WHEN 2 THEN 'form under section ' || (n % 600)
  WHEN 3 THEN coalesce(form_title, 'no title') WHEN 4 THEN 'show ' || coalesce(w[1], 'nothing') || ' ' || coalesce(w[2], '') || ' please'
  ELSE 'what is ' || coalesce(w[1], 'x') || ' ' || coalesce(w[5], 'y') END AS query_text
FROM (SELECT c_custkey AS n, form_title, string_split(form_title, ' ') AS w FROM customer LEFT JOIN forms ON form_number = c_custkey * 3 + 1)"""


def form_by_section(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "supplier").select("s_suppkey", F.concat(F.lit("Section "), _s(F.col("s_suppkey") * 5 % 531 + 1)).alias("section"))
    return M.forms_by_section(asked, forms(spark, folder)).select("s_suppkey", "form_number")


def form_by_title(spark: SparkSession, folder: str) -> DataFrame:
    return M.forms_by_title(form_queries(spark, folder), forms(spark, folder)).select("query_id", "form_number")


def form_by_key(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("c_custkey")
    asked = table(spark, folder, "customer").select("c_custkey", F.when(n % 2 == 0, F.concat(F.lit(" 0"), _s(n * 2))).otherwise(
        F.concat(F.lit("bnss_form_"), _s(n))).alias("key"))
    return M.form_by_key(asked, forms(spark, folder)).select("c_custkey", "form_number")


def form_fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    return M.fuzzy_scores(form_queries(spark, folder), forms(spark, folder), digits=6).select("query_id", "form_number", "match_score")


def lookup_ladder(spark: SparkSession, folder: str) -> DataFrame:
    return M.lookup(form_queries(spark, folder), forms(spark, folder)).select(
        "query_id", "step", "status", "form_number", "is_refused", F.coalesce(F.array_join("similar_forms", ","), F.lit("")).alias("similar"))


def lookup_candidates(spark: SparkSession, folder: str) -> DataFrame:
    q, f = form_queries(spark, folder), forms(spark, folder)
    return M.section_candidates(q, f, M.named(q, f))


def left_join_manifest(spark: SparkSession, folder: str) -> DataFrame:
    manifest = table(spark, folder, "part").where(F.col("p_partkey") % 2 == 0).select(
        (F.col("p_partkey") + 1).cast("int").alias("form_number"), F.concat(F.lit("f"), _s(F.col("p_partkey"))).alias("filename"),
        F.col("p_name").alias("slug"), F.col("p_size").cast("long").alias("byte_size"), F.sha2("p_name", 256).alias("sha256"),
        F.lit(0.9).alias("extraction_confidence"), F.lit(False).alias("needs_review"))
    return M.form_list(forms(spark, folder), manifest).select(
        "form_number", "slug", "filename", "byte_size", "sha256", "extraction_confidence", "needs_review", "page_count", "download_url")


def form_confidence(spark: SparkSession, folder: str) -> DataFrame:
    c = extraction_confidence(F.col("form_number"), F.col("form_title"), F.col("raw_text"), F.size("applicable_sections"), F.size("signatures"))
    return forms(spark, folder).select("form_number", c.alias("c")).select("form_number", "c.confidence", "c.needs_review")


def form_invariants(spark: SparkSession, folder: str) -> DataFrame:
    return M.invariants(forms(spark, folder), 2100, {1: (190, 190), 33: (222, 224)})


def form_texts(spark: SparkSession, folder: str) -> DataFrame:
    return forms(spark, folder).select("form_number", F.md5(render_text()).alias("text_md5"), F.length(render_markdown()).alias("markdown_chars"))


def form_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return M.manifest_rows(forms(spark, folder)).select("form_number", "filename", "byte_size", "sha256", "page_count")


def _form_lines(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("page") * 3 + F.col("line_no")
    raw = F.col("raw")
    case = n % 10
    text = (
        F.when(case == 0, F.concat(F.lit("FORM No. "), _s(F.floor(n / 10) % 70 + 1))).when(case == 1, raw)
        .when(case == 2, F.concat(F.lit("[See section "), _s(n % 531 + 1), F.lit(" (2) and 90]")))
        .when(case == 3, F.concat(F.lit("Whereas ........ [name and address] "), raw)).when(case == 4, F.lit("________ day"))
        .when(case == 5, F.lit("(date and time)")).when(case == 6, F.lit("(Signature and seal) ....")).when(case == 7, F.concat(F.lit("II. "), raw))
        .otherwise(raw)
    )
    return _lines(spark, folder).select("act_key", "page", "line_no", text.alias("text"))


def parse_forms(spark: SparkSession, folder: str) -> DataFrame:
    return M.parse_forms(_form_lines(spark, folder), ["act_key"]).select(
        "act_key", F.col("seq").cast("long").alias("seq"), "form_number", "page_start", "page_end", F.md5("form_title").alias("title_md5"),
        F.array_join("applicable_sections", ",").alias("sections"), F.md5("raw_text").alias("text_md5"),
        F.size("signatures").alias("n_signatures"))


def form_fields(spark: SparkSession, folder: str) -> DataFrame:
    return M.parse_forms(_form_lines(spark, folder), ["act_key"]).select("act_key", "seq", F.explode("fields").alias("f")).groupBy(
        "act_key", "f.field_type", "f.label").agg(F.count(F.lit(1)).alias("n"))


# --- tenancy ------------------------------------------------------------------

def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents owned by the users of the event table."""
    d = F.col("doc_id")
    return documents(spark, folder).select(
        _s(d * 7 % 150).alias("user_id"), F.concat(F.lit("doc"), _s(d % 40)).alias("document_id"), F.concat(F.lit("c"), _s(d)).alias("chunk_id"),
        F.when(d % 4 != 0, F.concat(F.lit("s"), _s(d % 3))).alias("session_id"), F.element_at(F.array(F.lit("READY"), F.lit("PROCESSING"), F.lit("READY")), (d % 3 + 1).cast("int")).alias("status"), "text")


CHUNKS_SQL = """SELECT (doc_id * 7 % 150)::VARCHAR AS user_id, 'doc' || (doc_id % 40) AS document_id, 'c' || doc_id AS chunk_id,
  CASE WHEN doc_id % 4 <> 0 THEN 's' || (doc_id % 3) END AS session_id, ['READY', 'PROCESSING', 'READY'][doc_id % 3 + 1] AS status, text FROM documents"""


def scoped_search(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that the users of the event table may see in the session of their event."""
    scopes = table(spark, folder, "events").select(F.concat(F.lit(" "), _s(F.col("user_id"))).alias("user_id"), F.concat(F.lit("s"), _s(F.col("event_id") % 3)).alias("want")).distinct()
    seen = _chunks(spark, folder).join(N.require_scope(scopes), "user_id")
    return seen.where(N.visible_in_session(F.col("status"), F.col("session_id"), F.col("want"))).groupBy("user_id", "want").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("document_id").alias("n_documents"))


def active_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Document ids in force per user: requested, scoped, or all ready ones."""
    e = table(spark, folder, "events").select(_s(F.col("user_id")).alias("user_id")).distinct()
    ready = _chunks(spark, folder).where("status = 'READY'").groupBy("user_id").agg(F.sort_array(F.collect_set("document_id")).alias("ready"))
    n = F.col("user_id").cast("int")
    none = F.lit(None).cast("array<string>")
    requested = F.when(n % 3 == 0, F.array(F.lit("doc1"), F.concat(F.lit("doc"), _s(n % 40)))).otherwise(none)
    scope = F.when(n % 3 == 1, F.array(F.lit("doc2"), F.concat(F.lit("doc"), _s(n * 3 % 40)))).otherwise(none)
    empty = F.array().cast("array<string>")
    active = N.active_documents(requested, scope, F.coalesce("ready", empty))
    return e.join(ready, "user_id", "left").select("user_id", F.array_join(active, ",").alias("active"))


def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("value"))
    store = f"{checkpoint_folder(spark)}/orders-{uuid4().hex}"
    for part in (o.where(F.col("version") % 2 == 0), o.where(F.col("version") % 2 == 1)):
        buckets.upsert(part, store, ["key"], ["version"], 16)
    return buckets.read(spark, store)


def scoped_delete(spark: SparkSession, folder: str) -> DataFrame:
    doomed = table(spark, folder, "events").where("event_type = 'error'").select(
        _s(F.col("user_id")).alias("user_id"), F.concat(F.lit("doc"), _s(F.col("event_id") % 40)).alias("document_id"))
    return N.delete_scoped(_chunks(spark, folder), doomed).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_chunks"))


def deleted_counts(spark: SparkSession, folder: str) -> DataFrame:
    doomed = table(spark, folder, "events").where("event_type = 'error'").select(
        _s(F.col("user_id")).alias("user_id"), F.concat(F.lit("doc"), _s(F.col("event_id") % 40)).alias("document_id"))
    return N.deleted_counts(_chunks(spark, folder), doomed)


def ingest_dedup(spark: SparkSession, folder: str) -> DataFrame:
    uploads = _chunks(spark, folder).select("user_id", F.encode("text", "UTF-8").alias("content"), F.col("chunk_id").alias("filename"))
    registry = N.new_uploads(uploads.where(F.length("filename") < 4), _chunks(spark, folder).select("document_id", "status")).select("document_id", F.lit("READY").alias("status"))
    return N.new_uploads(uploads, registry).select("user_id", "filename", "file_hash", "document_id", "is_deduplicated")


def redact(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    key = F.element_at(F.array(*[F.lit(k) for k in ("user_id", "password", "stage", "text")]), (e % 4 + 1).cast("int"))
    entries = table(spark, folder, "events").select("event_id", key.alias("key"), _s(F.col("user_id")).alias("value"))
    return N.redact(entries)


# --- validation ---------------------------------------------------------------

def missing_keys(spark: SparkSession, folder: str) -> DataFrame:
    seen = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("number"))
    return V.missing_numbers(seen, "number", table(spark, folder, "orders").count())


def duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    return V.duplicates(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


def corpus_report(spark: SparkSession, folder: str) -> DataFrame:
    p = passages(spark, folder)
    return V.corpus_totals(p, p)


def corpus_issues(spark: SparkSession, folder: str) -> DataFrame:
    p = passages(spark, folder)
    return V.corpus_issues(p, p, 198).groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n_issues"), F.sum("n").alias("n"))


def short_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return V.short_chunks(documents(spark, folder), "doc_id", "text", 200).select("doc_id", F.col("n_chars").cast("long").alias("n_chars"))


def readiness(spark: SparkSession, folder: str) -> DataFrame:
    """Tables as components: embeddings are the vector store, parts the forms."""
    def part(name: str, kind: str) -> DataFrame:
        return table(spark, folder, name).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("name"), F.lit(kind).alias("kind"), "n", F.lit(None).cast("string").alias("error"))
    return V.readiness(part("embeddings", "vector_store").unionByName(part("part", "forms")).unionByName(part("documents", "embedding")))


def readable_uploads(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("document_id"), F.when(F.col("page_id") % 5 == 0, " ").otherwise(F.col("html")).alias("text"))
    return V.readable_uploads(pages)


def upload_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Web pages as uploaded files: a paragraph is a page of them; some are empty, encrypted or of another kind.  Pages 1 to 20."""
    n, text = F.col("page_id"), F.replace(F.col("html"), F.lit("</p>"), F.lit("\f"))
    content = F.when(n % 13 == 0, F.lit("")).when(n % 11 == 0, text).when(
        n % 7 == 0, F.concat(F.lit("%PDF-1.7 trailer /Encrypt 5 0 R "), text)).otherwise(F.concat(F.lit("%PDF-1.7 "), text))
    files = table(spark, folder, "pages").select(n.alias("path"), content.cast("binary").alias("content"))
    return extract_pages(files, pages=(1, 20)).select(
        F.col("path").cast("long").alias("page_id"), "page_number", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("md5"), "problem")


# --- evaluation ---------------------------------------------------------------

def _in_a_row(tokens: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def golden(spark: SparkSession, folder: str) -> DataFrame:
    """Items with the documents that contain them whole; items in none are to be refused.

    A document contains an item if the item's tokens occur in it in a row; an item
    without tokens is in none.  Candidates come from the search index: such a
    document holds all tokens of the item, among them the rarest.
    """
    tokens = L.tokenized(documents(spark, folder), "doc_id", "text")
    docs = tokens.select("doc_id", _in_a_row(F.col("tokens")).alias("body"))
    items = _asked(spark, folder).select("item_id", _in_a_row(document_tokens(F.col("text"))).alias("item"))
    df = L.document_frequencies(tokens)
    rare = L.query_terms(_asked(spark, folder), "item_id", "text").join(df, "term").groupBy("item_id").agg(
        F.min_by("term", F.struct("df", "term")).alias("term"))
    pairs = tokens.select("doc_id", F.explode(F.array_distinct("tokens")).alias("term"))
    pairs = join_bounded(pairs, rare, ["term"]).select("item_id", "doc_id")
    found = join_bounded(docs.join(pairs, "doc_id"), items, ["item_id"]).where(F.contains("body", F.col("item")))
    hits = found.groupBy("item_id").agg(F.sort_array(F.collect_set(_s(F.col("doc_id")))).alias("expected_sections"))
    return _asked(spark, folder).select("item_id").join(hits, "item_id", "left").select(
        F.col("item_id").alias("query_id"), F.lit(None).cast("string").alias("expected_act"),
        F.coalesce("expected_sections", F.array().cast("array<string>")).alias("expected_sections"),
        F.col("expected_sections").isNull().alias("should_refuse"))


GOLDEN_SQL = r"""SELECT b.item_id AS query_id, list(d.doc_id ORDER BY d.doc_id) FILTER (d.doc_id IS NOT NULL) AS docs, count(d.doc_id) = 0 AS should_refuse
FROM (SELECT item_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') || ' ' AS item FROM benchmark) b
LEFT JOIN (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') || ' ' AS body FROM documents) d
  ON contains(d.body, b.item) AND trim(b.item) <> '' GROUP BY b.item_id"""


def golden_set(spark: SparkSession, folder: str) -> DataFrame:
    return golden(spark, folder).select("query_id", F.array_join(F.sort_array(F.transform("expected_sections", lambda x: x.cast("long"))), ",").alias("docs"), "should_refuse")


def _hits(spark: SparkSession, folder: str, k: int = 10) -> DataFrame:
    return _search(spark, folder, k).select(
        F.col("item_id").alias("query_id"), "rank", F.lit("BNS").alias("act_short"), _s(F.col("doc_id")).alias("section_number"), "score", "doc_id")


def recall_mrr(spark: SparkSession, folder: str) -> DataFrame:
    g = golden(spark, folder).where(~F.col("should_refuse"))
    return Q.ranking_metrics(Q.first_hits(g, _hits(spark, folder)))


def first_hit_ranks(spark: SparkSession, folder: str) -> DataFrame:
    g = golden(spark, folder).where(~F.col("should_refuse"))
    return Q.first_hits(g, _hits(spark, folder), prefix=True, check_act=False).select("query_id", F.col("first_rank").cast("int").alias("first_rank"))


def config_compare(spark: SparkSession, folder: str) -> DataFrame:
    """Lexical search with and without the small-corpus fallback, and with other BM25 parameters."""
    g = golden(spark, folder).where(~F.col("should_refuse"))
    runs = []
    settings = [("k1=1.5 b=0.75", L.Bm25(), False), ("k1=1.5 b=0.75 fallback", L.Bm25(), True),
                ("k1=1.2 b=0.5", L.Bm25(1.2, 0.5), False), ("k1=2 b=0", L.Bm25(2.0, 0.0), False)]
    counts = L.corpus_counts(documents(spark, folder), "doc_id", "text")
    for name, params, fallback in settings:
        top = _search(spark, folder, 10, params=params, counts=counts, fallback=fallback)
        runs.append(top.select(F.lit(name).alias("config"), F.col("item_id").alias("query_id"), "rank", F.lit("BNS").alias("act_short"),
                               _s(F.col("doc_id")).alias("section_number")))
    return Q.ranking_metrics(Q.first_hits(g, union_all(runs), by=["config"], configs=[(n,) for n, _, _ in settings]), ["config"])


def _confidences(spark: SparkSession, folder: str) -> DataFrame:
    """Top score squeezed to [0, 1] as the confidence of an item."""
    # one row per item, and k hits of each: stored, as the plan below takes them apart
    g, hits = reliable_checkpoint(golden(spark, folder)), reliable_checkpoint(_hits(spark, folder))
    first = Q.first_hits(g, hits)
    top = hits.where("rank = 1").select("query_id", F.round(F.least(F.lit(1.0), F.col("score") / 200.0), 4).alias("confidence_score"))
    return g.join(first, "query_id").join(top, "query_id", "left").select(
        "should_refuse", F.coalesce("confidence_score", F.lit(0.0)).alias("confidence_score"), (F.col("first_rank") > 0).alias("correct"))


def threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return Q.threshold_sweep(_confidences(spark, folder))


def best_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return Q.best_threshold(Q.threshold_sweep(_confidences(spark, folder)))


def label_refusals(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as a judged set: toxic documents are to be refused, low quality ones are not accepted."""
    judged = table(spark, folder, "labels").select((F.col("toxic") == 1).alias("should_refuse"), (F.col("quality") == 1).alias("accepted"),
                                                   (F.col("doc_id") % 3 != 0).alias("correct"))
    return Q.refusal_rates(judged)


def nearest_rank_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return Q.nearest_rank(table(spark, folder, "events"), "value", {"p50": 0.5, "p95": 0.95}, ["event_type"])


# --- admission, jobs, metrics -------------------------------------------------

LIMIT, WINDOW = 3, 36 * 3600


def rate_limit(spark: SparkSession, folder: str) -> DataFrame:
    return admit(table(spark, folder, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", LIMIT, WINDOW).select(
        "event_id", "is_allowed", "retry_after")


def job_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as job events: a user's job is updated, cancelled and finalised over and over."""
    return job_events_of(table(spark, folder, "events"))


def job_events_of(e: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_id") % 41 == 0, "cancel").when(F.col("event_id") % 17 == 0, "finalize").otherwise("update")
    status = F.when(F.col("event_id") % 97 == 0, "FAILED").when(F.col("event_type") == "click", "PROCESSING").when(F.col("event_type") == "signup", "PENDING")
    update = kind == "update"
    return e.select(
        F.concat(F.lit("job"), _s(F.col("user_id") * 100 + F.col("event_id") % 10)).alias("job_id"), F.col("event_id").alias("seq"), kind.alias("kind"),
        F.when(update, status).alias("status"), F.when(update & (F.col("event_type") == "view"), (F.col("value") % 100).cast("int")).alias("progress"),
        F.when(update & (F.col("event_type") == "purchase"), F.concat(F.lit("stage"), _s(F.col("event_id") % 5))).alias("stage"))


def job_states(spark: SparkSession, folder: str) -> DataFrame:
    return J.job_states(job_events(spark, folder), block_events=1000).select("job_id", "status", "progress", "stage", "n_events", "last_seq")


def _registry(spark: SparkSession, folder: str) -> DataFrame:
    o = F.col("o_orderkey")
    status = F.element_at(F.array(*[F.lit(s) for s in ("PENDING", "PROCESSING", "READY", "FAILED", "CANCELLED")]), (o % 5 + 1).cast("int"))
    return table(spark, folder, "orders").select(F.concat(F.lit("job"), _s(o)).alias("job_id"), F.concat(F.lit("doc"), _s(o)).alias("document_id"),
                                                 _s(F.col("o_custkey")).alias("user_id"), status.alias("status"))


def cancel_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Line items ask for cancellation of their order's job, by job or by document, some for a foreign one."""
    k = F.col("l_orderkey")
    asks = table(spark, folder, "lineitem").select((k + F.col("l_linenumber") % 2).alias("o_orderkey"), "l_linenumber", k).join(
        table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    target = F.concat(F.when(k % 2 == 0, "job").otherwise("doc"), _s(k))
    return J.cancel(_registry(spark, folder), asks.select(_s(F.col("o_custkey")).alias("user_id"), target.alias("target")).distinct())


def counters(spark: SparkSession, folder: str) -> DataFrame:
    return C.counters(table(spark, folder, "events"), ["event_type"], "value").select("event_type", "total", F.round("duration_sum", 4).alias("duration_sum"))


def token_cost(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "conversations").select("role", F.size(F.split("text", r"\s+")).alias("words"))
    used = t.select("role", F.when(F.col("role") == "user", F.col("words")).otherwise(0).cast("long").alias("p"),
                    F.when(F.col("role") == "assistant", F.col("words")).otherwise(0).cast("long").alias("c"))
    return C.token_cost(used, "p", "c", 0.5, 1.5, ["role"]).withColumn("estimated_cost", F.round("estimated_cost", 6))


def metrics_text(spark: SparkSession, folder: str) -> DataFrame:
    counted = C.counters(table(spark, folder, "events"), ["event_type"], "value")
    lines = C.exposition_lines(counted, "engine_requests_total", ["event_type"], _s(F.col("total")), "Requests handled.")
    sums = C.exposition_lines(counted, "engine_duration_seconds_sum", ["event_type"], F.format_string("%.2f", F.col("duration_sum")), "Summed latency.")
    return lines.unionByName(sums).select("metric", F.col("ord").cast("int").alias("ord"), "line")


QUERIES = {f.__name__: f for f in (
    form_by_section, form_by_title, form_by_key, form_fuzzy, lookup_ladder, lookup_candidates, left_join_manifest, form_confidence,
    form_invariants, form_texts, form_manifest, parse_forms, form_fields, scoped_search, active_documents, upsert_latest, scoped_delete,
    deleted_counts, ingest_dedup, redact, missing_keys, duplicate_keys, corpus_report, corpus_issues, short_chunks, readiness,
    readable_uploads, upload_pages, golden_set, recall_mrr, first_hit_ranks, config_compare, threshold_sweep, best_threshold, label_refusals,
    nearest_rank_percentiles, rate_limit, job_states, cancel_jobs, counters, token_cost, metrics_text)}


def _with(**ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({q})" for n, q in ctes.items()) + "\n"


_KEY = r"trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_STOP = "['the','of','to','an','a','for','in','by','under']"
_QSTOP = "['the','of','to','an','a','for','in','by','under','show','give','what','is','form']"
FORM_CTES = {
    "forms": FORMS_SQL, "asked": FORM_QUERIES_SQL,
    "told": f"""SELECT *, array_to_string(applicable_sections, ', ') AS listed, '[BNSS Second Schedule, Form ' || form_number || ']' AS tag,
      CASE WHEN len(applicable_sections) = 0 THEN '' ELSE concat('*(See ', array_to_string(list_transform(applicable_sections, lambda x: 'Section ' || x), ', '),
        ' of the {SCHEDULE_TITLE})*', chr(10), chr(10)) END AS see FROM forms""",
    "keys": r"""SELECT DISTINCT form_number, unnest([k, regexp_extract(k, '^\d+')]) AS key FROM (SELECT form_number, regexp_replace(unnest(applicable_sections), '\s+', '', 'g') AS k FROM forms)""",
    "titles": f"SELECT {_KEY.format('form_title')} AS key, max(form_number) AS form_number FROM forms GROUP BY 1",
    "qw": f"SELECT query_id, list_distinct(list_filter(string_split({_KEY.format('query_text')}, ' '), lambda w: w <> '' AND NOT list_contains({_QSTOP}, w))) AS q FROM asked",
    "tw": f"SELECT form_number, list_distinct(list_filter(string_split({_KEY.format('form_title')}, ' '), lambda w: w <> '' AND NOT list_contains({_STOP}, w))) AS t FROM forms",
    "shared": """SELECT query_id, form_number, nq, nt, count(*) AS n FROM (SELECT query_id, len(q) AS nq, unnest(q) AS w FROM qw) JOIN (SELECT form_number, len(t) AS nt, unnest(t) AS w FROM tw) USING (w) GROUP BY ALL""",
    "fuzzy": """SELECT query_id, form_number, s AS match_score FROM (SELECT *, 0.6 * (n / nq) + 0.4 * (2 * (n / nq) * (n / nt) / ((n / nq) + (n / nt))) AS s FROM shared) WHERE s > 0.3""",
    "parts": r"""SELECT query_id, query_text, regexp_replace(query_text, '^\s+|\s+$', '', 'g') AS q,
      coalesce(nullif(regexp_extract(query_text, '(?i)(?:^|\b)(?:bnss\s+)?form\s+(?:no\.?|#)?\s*(\d+)(?:\b|$)', 1), ''), CASE WHEN regexp_full_match(query_text, '\d+') THEN query_text END) AS num,
      nullif(regexp_extract(query_text, '(?i)(?:^|\b)(?:under\s+)?(?:section|sec\.?|s\.|u/s)\s*(\d+(?:\s*\(\s*[0-9a-zA-Z]+\s*\))*)', 1), '') AS sec FROM asked""",
    "secs": "SELECT query_id, count(*) AS n, min(k.form_number) AS f FROM parts JOIN keys k ON k.key = sec WHERE num IS NULL GROUP BY query_id",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(match_score, 12) DESC, form_number) AS rank FROM fuzzy QUALIFY rank <= 5",
    "best": """SELECT query_id, max(match_score) FILTER (rank = 1) AS s1, max(match_score) FILTER (rank = 2) AS s2, max(form_number) FILTER (rank = 1) AS f1,
      string_agg(form_number::VARCHAR, ',' ORDER BY rank) FILTER (match_score >= 0.45) AS cands FROM ranked GROUP BY query_id""",
    "stepped": f"""SELECT p.query_id, f.form_number AS by_num, s.n AS n_sec, s.f AS by_sec, t.form_number AS by_title, s1, s2, f1, cands,
      CASE WHEN num IS NOT NULL THEN 'number' WHEN s.n IS NOT NULL THEN 'section' WHEN t.form_number IS NOT NULL THEN 'title' WHEN s1 IS NOT NULL THEN 'similar' ELSE 'none' END AS step
      FROM parts p LEFT JOIN forms f ON f.form_number::VARCHAR = p.num LEFT JOIN secs s USING (query_id) LEFT JOIN titles t ON t.key = {_KEY.format('p.q')} LEFT JOIN best b ON b.query_id = p.query_id""",
    "judged": """SELECT *, s1 >= 0.7 AND (s2 IS NULL OR round(s1 - s2, 12) >= 0.15) AS sure FROM stepped""",
}


def _forms(*names: str) -> str:
    return _with(**{n: FORM_CTES[n] for n in names})


_ALL_FORMS = tuple(FORM_CTES)
_CONF = """0.20e0 * CASE WHEN form_number BETWEEN 1 AND 58 THEN 1.0e0 ELSE 0.0e0 END + 0.30e0 * CASE WHEN length(form_title) >= 10 AND NOT starts_with(lower(form_title), 'form') THEN 1.0e0 WHEN length(form_title) >= 3 THEN 0.85e0 ELSE 0.2e0 END
  + 0.25e0 * CASE WHEN length(trim(raw_text)) >= 150 THEN 1.0e0 WHEN length(trim(raw_text)) >= 50 THEN 0.85e0 ELSE 0.3e0 END + 0.15e0 * CASE WHEN len(applicable_sections) > 0 THEN 1.0e0 ELSE 0.8e0 END + 0.10e0 * CASE WHEN n_parts > 0 THEN 1.0e0 ELSE 0.7e0 END"""
# the decimal keeps a double just below a half from being rounded up
_CONF = f"round(({_CONF})::DOUBLE::VARCHAR::DECIMAL(20, 17), 2)::DOUBLE"
_REVIEW = f"({_CONF} < 0.85 OR length(trim(raw_text)) < 50)"
_SLUG = r"""array_to_string(list_transform(string_split(form_title, ' '), lambda w, i: CASE WHEN i = 1 OR NOT list_contains(['of', 'the'], lower(w)) THEN upper(w[1]) || lower(w[2:]) ELSE lower(w) END), '-')"""
_GOLD = {"golden": GOLDEN_SQL, **bm25_ctes(), "hits": bm25_top(10)}
_FIRST = """SELECT g.query_id, g.should_refuse, coalesce(min(h.rank) FILTER (list_contains(g.docs, h.doc)), 0) AS first_rank, max(h.score) AS top
  FROM golden g LEFT JOIN hits h ON h.query = g.query_id GROUP BY ALL"""
_METRICS = """count(*) AS queries, round(avg(CASE WHEN first_rank BETWEEN 1 AND 5 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_5,
  round(avg(CASE WHEN first_rank BETWEEN 1 AND 10 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_10, round(avg(CASE WHEN first_rank > 0 THEN 1.0 / first_rank ELSE 0.0 END), 4) AS mrr"""
_RATES = """count(*) FILTER (NOT should_refuse) AS in_scope_total, count(*) FILTER (NOT should_refuse AND accepted) AS in_scope_accepted,
  count(*) FILTER (NOT should_refuse AND NOT accepted) AS in_scope_refused,
  round(count(*) FILTER (NOT should_refuse AND accepted AND correct) / greatest(count(*) FILTER (NOT should_refuse), 1), 4) AS in_scope_accuracy,
  round(count(*) FILTER (NOT should_refuse AND NOT accepted) / greatest(count(*) FILTER (NOT should_refuse), 1), 4) AS false_refusal_rate,
  count(*) FILTER (should_refuse) AS out_of_scope_total, count(*) FILTER (should_refuse AND NOT accepted) AS out_of_scope_refused,
  count(*) FILTER (should_refuse AND accepted) AS out_of_scope_accepted,
  round(count(*) FILTER (should_refuse AND NOT accepted) / greatest(count(*) FILTER (should_refuse), 1), 4) AS out_of_scope_refusal_rate"""
_SWEEP = {**_GOLD, "firsts": _FIRST,
          "scored": "SELECT should_refuse, round(least(1.0, coalesce(top, 0) / 200.0), 4) AS c, first_rank > 0 AS correct FROM firsts",
          "grid": "SELECT round(i * 0.05, 2)::DOUBLE AS threshold FROM range(2, 19) t(i)",
          "sweep": f"SELECT threshold, {_RATES} FROM (SELECT *, c >= threshold AS accepted FROM scored, grid) GROUP BY threshold"}


def _scores_sql(k1: float, b: float, fallback: bool) -> str:
    score = f"sum(qtf * idf * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * len(t.toks) / avgdl)))"
    if fallback:
        score = f"CASE WHEN {score} > 0 THEN {score} ELSE count(*)::DOUBLE END"
    return (f"SELECT query, p.doc, {score} AS score "
            "FROM b_q JOIN b_post p USING (term) JOIN b_idf USING (term) JOIN b_tok t ON t.doc = p.doc, b_stat GROUP BY query, p.doc")


_SETTINGS = [("k1=1.5 b=0.75", 1.5, 0.75, False), ("k1=1.5 b=0.75 fallback", 1.5, 0.75, True), ("k1=1.2 b=0.5", 1.2, 0.5, False), ("k1=2 b=0", 2.0, 0.0, False)]
_COMPARE = {
    "golden": GOLDEN_SQL, **{k: v for k, v in bm25_ctes().items() if k != "scores"},
    "runs": " UNION ALL ".join(f"SELECT '{n}' AS config, * FROM ({_scores_sql(k1, b, fallback)})" for n, k1, b, fallback in _SETTINGS),
    "hits": "SELECT *, row_number() OVER (PARTITION BY config, query ORDER BY round(score, 9) DESC, doc) AS rank FROM runs WHERE score > 0 QUALIFY rank <= 10",
    "firsts": """SELECT c.config, g.query_id, coalesce(min(h.rank) FILTER (list_contains(g.docs, h.doc)), 0) AS first_rank
      FROM (SELECT DISTINCT config FROM runs) c, golden g LEFT JOIN hits h ON h.query = g.query_id AND h.config = c.config WHERE NOT g.should_refuse GROUP BY ALL""",
}
_SEE = r"(?i)(?:\[|\()\s*See\s+sections?\s+([0-9a-zA-Z\s,\(\)andu/]+)(?:\]|\))"
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
FORM_LINE_CTES = {
    "lines": LINES_SQL,
    "fl": f"""SELECT act_key, page, line_no, {_TRIM.format('t')} AS text FROM (SELECT act_key, page, line_no, CASE (page * 3 + line_no) % 10
        WHEN 0 THEN 'FORM No. ' || ((page * 3 + line_no) // 10 % 70 + 1) WHEN 1 THEN raw WHEN 2 THEN '[See section ' || ((page * 3 + line_no) % 531 + 1) || ' (2) and 90]'
        WHEN 3 THEN 'Whereas ........ [name and address] ' || raw WHEN 4 THEN '________ day' WHEN 5 THEN '(date and time)' WHEN 6 THEN '(Signature and seal) ....'
        WHEN 7 THEN 'II. ' || raw ELSE raw END AS t FROM lines)""",
    "fs": r"SELECT *, regexp_extract(text, '(?i)^\s*FORM\s+(?:No\.?|NO\.?)\s*(\d+)', 1) AS num FROM fl WHERE text <> ''",
    "fq": "SELECT *, num <> '' AS start, sum((num <> '')::INT) OVER (PARTITION BY act_key ORDER BY page, line_no ROWS UNBOUNDED PRECEDING) AS seq FROM fs",
    "fb": """SELECT act_key, seq::BIGINT AS seq, max(num) FILTER (start) AS num, min(page) AS page_start, max(page) AS page_end, list(text ORDER BY page, line_no) AS ls
      FROM fq WHERE seq > 0 GROUP BY act_key, seq""",
    "fh": f"SELECT *, ls[2:6] AS head, list_min(list_transform(ls[2:6], lambda x, i: CASE WHEN regexp_matches(x, '{_SEE}') THEN i END)) AS hit FROM fb",
    "ft": f"""SELECT *, {_TRIM.format("array_to_string(CASE WHEN hit IS NOT NULL THEN head[1:hit - 1] ELSE head END, ' ')")} AS joined,
      {_TRIM.format(f"regexp_extract(head[hit], '{_SEE}', 1)")} AS refs FROM fh""",
    "fp": r"""SELECT *, regexp_replace(CASE WHEN joined = '' AND len(ls) >= 2 THEN ls[2] ELSE joined END, '\s+', ' ', 'g') AS title,
      CASE WHEN hit IS NULL THEN [] ELSE list_transform(regexp_extract_all(refs, '\d+(?:\s*\(\s*[0-9a-zA-Z]+\s*\))*'), lambda x: regexp_replace(x, '\s+', '', 'g')) END AS secs,
      ls[CASE WHEN joined = '' AND len(ls) >= 2 THEN 3 WHEN hit IS NOT NULL THEN hit + 2 ELSE 2 END:] AS body FROM ft""",
}

SQL = {
    "config_compare": _with(**_COMPARE) + f"SELECT config, {_METRICS} FROM firsts GROUP BY config",
    "parse_forms": _with(**FORM_LINE_CTES) + """SELECT act_key, seq, num::INT AS form_number, page_start, page_end, md5(title) AS title_md5, array_to_string(secs, ',') AS sections,
  md5(array_to_string(ls, chr(10))) AS text_md5, len(list_filter(body, lambda x: contains(x, '(Signature') OR contains(x, '(Seal of the Court)') OR contains(x, 'Signature and seal') OR contains(x, 'Police Officer')))::INT AS n_signatures FROM fp""",
    "form_by_section": _forms("forms", "keys") + "SELECT s_suppkey, form_number FROM supplier JOIN keys ON key = (s_suppkey * 5 % 531 + 1)::VARCHAR",
    "form_by_title": _forms("forms", "asked", "titles") + f"SELECT query_id, form_number FROM asked JOIN titles ON key = {_KEY.format('query_text')}",
    "form_by_key": _forms("forms") + """SELECT c_custkey, f.form_number FROM customer LEFT JOIN forms f ON CASE WHEN c_custkey % 2 = 0 THEN f.form_number = c_custkey * 2 ELSE f.form_id = 'BNSS_FORM_' || c_custkey END""",
    "form_fuzzy": _forms("forms", "asked", "qw", "tw", "shared", "fuzzy") + "SELECT query_id, form_number, round(match_score, 6) AS match_score FROM fuzzy",
    "lookup_ladder": _forms(*_ALL_FORMS) + """SELECT query_id, step, status, CASE WHEN status = 'SUCCESS' THEN CASE step WHEN 'number' THEN by_num WHEN 'section' THEN by_sec WHEN 'title' THEN by_title ELSE f1 END END AS form_number,
  status = 'NOT_FOUND' AS is_refused, CASE WHEN step = 'similar' AND status = 'AMBIGUOUS' THEN cands ELSE '' END AS similar FROM (
  SELECT *, CASE step WHEN 'number' THEN CASE WHEN by_num IS NOT NULL THEN 'SUCCESS' ELSE 'NOT_FOUND' END WHEN 'section' THEN CASE WHEN n_sec = 1 THEN 'SUCCESS' ELSE 'AMBIGUOUS' END WHEN 'title' THEN 'SUCCESS'
    WHEN 'similar' THEN CASE WHEN sure THEN 'SUCCESS' WHEN s1 >= 0.5 THEN 'AMBIGUOUS' ELSE 'NOT_FOUND' END ELSE 'NOT_FOUND' END AS status FROM judged)""",
    "lookup_candidates": _forms("forms", "asked", "keys", "parts", "secs") + "SELECT p.query_id, k.form_number FROM parts p JOIN secs s USING (query_id) JOIN keys k ON k.key = p.sec WHERE s.n > 1",
    "left_join_manifest": _forms("forms") + f"""SELECT form_number, CASE WHEN m THEN p_name ELSE slug END AS slug, CASE WHEN m THEN 'f' || (form_number - 1) ELSE 'FORM-' || form_number || '_' || slug || '.pdf' END AS filename,
  CASE WHEN m THEN p_size::BIGINT END AS byte_size, CASE WHEN m THEN sha256(p_name) END AS sha256, CASE WHEN m THEN 0.9 ELSE {_CONF} END::DOUBLE AS extraction_confidence,
  CASE WHEN m THEN false ELSE {_REVIEW} END AS needs_review, page_end - page_start + 1 AS page_count, '/api/v1/forms/' || form_number || '/download' AS download_url
FROM (SELECT f.*, p.p_name, p.p_size, p_partkey % 2 = 0 AS m, {_SLUG} AS slug FROM forms f JOIN part p ON p.p_partkey + 1 = f.form_number)""",
    "form_texts": _forms("forms", "told") + """SELECT form_number,
  md5(concat('FORM No. ', form_number, ': ', form_title, chr(10), 'Applicable Sections: ', CASE WHEN listed = '' THEN 'N/A' ELSE listed END, chr(10),
    'Provenance: ', tag, ' (Pages ', page_start, '-', page_end, ')', chr(10), chr(10), raw_text)) AS text_md5,
  length(concat('# FORM No. ', form_number, chr(10), '## ', form_title, chr(10), chr(10), see, '**Canonical Citation**: `', tag, '`  ', chr(10),
    '**Source Pages**: Gazette PDF Pages ', page_start, '–', page_end, chr(10), chr(10), '---', chr(10), chr(10), '### Statutory Text', chr(10), '```text', chr(10),
    trim(raw_text), chr(10), '```', chr(10), chr(10),
    CASE WHEN n_parts > 0 THEN concat('### Execution & Seal Requirements', chr(10), '- (Signature)', chr(10), chr(10)) ELSE '' END))::INT AS markdown_chars FROM told""",
    "form_confidence": _forms("forms") + f"SELECT form_number, {_CONF} AS confidence, {_REVIEW} AS needs_review FROM forms",
    "form_invariants": _forms("forms") + """SELECT code, n FROM (SELECT unnest([{'code': 'FORM_COUNT', 'n': CASE WHEN count(*) <> 2100 THEN count(*) END}, {'code': 'OUT_OF_RANGE', 'n': count(*) FILTER (form_number NOT BETWEEN 1 AND 2100)},
  {'code': 'MISSING_NUMBERS', 'n': 2100 - count(DISTINCT form_number) FILTER (form_number BETWEEN 1 AND 2100)}, {'code': 'DUPLICATE_NUMBERS', 'n': count(*) - count(DISTINCT form_number)},
  {'code': 'SHORT_TITLE', 'n': count(*) FILTER (length(form_title) < 3)}, {'code': 'SHORT_TEXT', 'n': count(*) FILTER (length(trim(raw_text)) < 50)}, {'code': 'PAGE_ORDER', 'n': count(*) FILTER (page_start > page_end)},
  {'code': 'ANCHOR_1', 'n': count(*) FILTER (form_number = 1 AND (page_start <> 190 OR page_end <> 190))}, {'code': 'ANCHOR_33', 'n': count(*) FILTER (form_number = 33 AND (page_start <> 222 OR page_end <> 224))}], recursive := true) FROM forms) WHERE coalesce(n, 0) <> 0""",
    "form_manifest": _forms("forms") + f"SELECT form_number, 'FORM-' || form_number || '_' || {_SLUG} || '.pdf' AS filename, strlen(raw_text) AS byte_size, sha256(raw_text) AS sha256, page_end - page_start + 1 AS page_count FROM forms",
    "scoped_search": _with(chunks=CHUNKS_SQL) + """SELECT user_id, want, count(*) AS n_chunks, count(DISTINCT document_id) AS n_documents FROM chunks
  JOIN (SELECT DISTINCT user_id::VARCHAR AS user_id, 's' || (event_id % 3) AS want FROM events) USING (user_id) WHERE status = 'READY' AND (session_id IS NULL OR session_id = want) GROUP BY ALL""",
    "active_documents": _with(chunks=CHUNKS_SQL) + """SELECT user_id, array_to_string(CASE WHEN n % 3 = 0 THEN list_filter(list_distinct(['doc1', 'doc' || (n % 40)]), lambda x: list_contains(ready, x))
  WHEN n % 3 = 1 THEN CASE WHEN len(ready) = 0 THEN ['doc2', 'doc' || (n * 3 % 40)] ELSE list_filter(['doc2', 'doc' || (n * 3 % 40)], lambda x: list_contains(ready, x)) END ELSE ready END, ',') AS active
FROM (SELECT e.user_id::VARCHAR AS user_id, e.user_id AS n, coalesce(r.ready, []) AS ready FROM (SELECT DISTINCT user_id FROM events) e
  LEFT JOIN (SELECT user_id, list_sort(list(DISTINCT document_id)) AS ready FROM chunks WHERE status = 'READY' GROUP BY user_id) r ON r.user_id = e.user_id::VARCHAR)""",
    "upsert_latest": "SELECT o_custkey AS key, max(o_orderkey) AS version, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY o_custkey",
    "scoped_delete": _with(chunks=CHUNKS_SQL) + "SELECT user_id, count(*) AS n_chunks FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'error' AND e.user_id::VARCHAR = c.user_id AND 'doc' || (e.event_id % 40) = c.document_id) GROUP BY user_id",
    "deleted_counts": _with(chunks=CHUNKS_SQL) + """SELECT k.user_id, k.document_id, count(c.chunk_id) AS deleted FROM (SELECT DISTINCT user_id::VARCHAR AS user_id, 'doc' || (event_id % 40) AS document_id FROM events WHERE event_type = 'error') k
  LEFT JOIN chunks c ON c.user_id = k.user_id AND c.document_id = k.document_id GROUP BY ALL""",
    "ingest_dedup": _with(chunks=CHUNKS_SQL, hashed="SELECT user_id, chunk_id AS filename, sha256(text) AS file_hash, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('corpus://doc/' || user_id || '/' || sha256(text))) AS h FROM chunks",
                          named="SELECT *, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][('0x' || h[17])::INT % 4 + 1] || h[18:20] || '-' || h[21:32] AS document_id FROM hashed")
    + "SELECT user_id, filename, file_hash, document_id, document_id IN (SELECT document_id FROM named WHERE length(filename) < 4) AS is_deduplicated FROM named",
    "redact": "SELECT event_id, ['user_id_hash', 'password', 'stage', 'text'][event_id % 4 + 1] AS key, CASE event_id % 4 WHEN 0 THEN left(sha256(user_id::VARCHAR), 12) WHEN 2 THEN user_id::VARCHAR ELSE '<REDACTED_CONTENT>' END AS value FROM events",
    "missing_keys": "SELECT i AS number FROM range(1, (SELECT count(*) FROM orders) + 1) t(i) WHERE i NOT IN (SELECT l_orderkey FROM lineitem)",
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "corpus_report": _with(passages=PASSAGES_SQL) + "SELECT count(DISTINCT chapter) AS total_chapters, count(*) AS total_sections, count(*) AS total_chunks, count(*) FILTER (chunk_type = 'schedule_entry') AS total_schedule_entries FROM passages",
    "corpus_issues": _with(passages=PASSAGES_SQL) + r"""SELECT severity, code, count(*) AS n_issues, sum(n)::BIGINT AS n FROM (
  SELECT CASE WHEN count(*) <= 5 THEN 'WARNING' ELSE 'ERROR' END AS severity, 'MISSING_SECTIONS' AS code, count(*) AS n FROM range(1, 532) t(i) WHERE i NOT IN (SELECT section_number::BIGINT FROM passages WHERE regexp_full_match(section_number, '\d+')) HAVING count(*) > 0
  UNION ALL SELECT 'ERROR', 'DUPLICATE_SECTIONS', count(*) FROM passages GROUP BY section_number HAVING count(*) > 1
  UNION ALL SELECT 'ERROR', 'INVALID_PAGE_RANGE', 1 FROM passages WHERE page_start < 1 OR page_end > 198 OR page_start > page_end
  UNION ALL SELECT 'WARNING', 'SUSPICIOUS_SHORT_CHUNK', length(text) FROM passages WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 25
  UNION ALL SELECT 'WARNING', 'UNFILTERED_BOILERPLATE', 1 FROM passages WHERE contains(text, '_____')) GROUP BY ALL""",
    "short_chunks": r"SELECT doc_id, length(text) AS n_chars FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 200",
    "readiness": "SELECT unnest(['embeddings', 'part', 'documents']) AS name, unnest([CASE WHEN (SELECT count(*) FROM embeddings) = 0 THEN 'DEGRADED' ELSE 'READY' END, CASE WHEN (SELECT count(*) FROM part) = 58 THEN 'READY' ELSE 'DEGRADED' END, 'READY']) AS status, CASE WHEN (SELECT count(*) FROM part) = 58 THEN 'READY' ELSE 'UNAVAILABLE' END AS overall",
    "readable_uploads": r"SELECT page_id AS document_id, count(*) AS n_pages, sum(CASE WHEN page_id % 5 = 0 THEN 0 ELSE length(regexp_replace(html, '^\s+|\s+$', '', 'g')) END)::BIGINT AS n_chars, page_id % 5 <> 0 AS accepted FROM pages GROUP BY page_id",
    "upload_pages": r"""SELECT page_id, 0::INT AS page_number, 0::BIGINT AS n_chars, md5('') AS md5,
        CASE WHEN page_id % 13 = 0 THEN 'EMPTY' WHEN page_id % 11 = 0 THEN 'NOT_PDF' ELSE 'ENCRYPTED' END AS problem
      FROM pages WHERE page_id % 13 = 0 OR page_id % 11 = 0 OR page_id % 7 = 0
      UNION ALL SELECT page_id, n::INT, length(t)::BIGINT, md5(t), NULL FROM (
        SELECT page_id, n, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM (
          SELECT page_id, unnest(texts) AS text, generate_subscripts(texts, 1) AS n FROM (
            SELECT page_id, string_split(replace('%PDF-1.7 ' || html, '</p>', chr(12)), chr(12)) AS texts FROM pages
            WHERE page_id % 13 <> 0 AND page_id % 11 <> 0 AND page_id % 7 <> 0)) WHERE n <= 20)""",
    "golden_set": _with(golden=GOLDEN_SQL) + "SELECT query_id, coalesce(array_to_string(docs, ','), '') AS docs, should_refuse FROM golden",
    "recall_mrr": _with(**_GOLD, firsts=_FIRST) + f"SELECT {_METRICS} FROM firsts WHERE NOT should_refuse",
    "first_hit_ranks": _with(**_GOLD) + """SELECT g.query_id, coalesce(min(h.rank) FILTER (len(list_filter(g.docs, lambda d: starts_with(h.doc::VARCHAR, d::VARCHAR))) > 0), 0)::INT AS first_rank
  FROM golden g LEFT JOIN hits h ON h.query = g.query_id WHERE NOT g.should_refuse GROUP BY g.query_id""",
    "threshold_sweep": _with(**_SWEEP) + "SELECT * FROM sweep",
    "best_threshold": _with(**_SWEEP) + "SELECT coalesce(min(threshold) FILTER (out_of_scope_refusal_rate >= 0.95 AND false_refusal_rate <= 0.05), 0.35)::DOUBLE AS best_threshold FROM sweep",
    "label_refusals": f"SELECT {_RATES} FROM (SELECT toxic = 1 AS should_refuse, quality = 1 AS accepted, doc_id % 3 <> 0 AS correct FROM labels)",
    "nearest_rank_percentiles": "SELECT event_type, count(*) AS n, list_sort(list(value))[floor(count(*) * 0.5)::INT + 1] AS p50, list_sort(list(value))[floor(count(*) * 0.95)::INT + 1] AS p95 FROM events GROUP BY event_type",
    "rate_limit": _with(
        o="SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events",
        r=f"""SELECT event_id, user_id, n, t, true AS is_allowed, 0 AS retry_after, [t] AS held FROM o WHERE n = 1
      UNION ALL SELECT o.event_id, o.user_id, o.n, o.t, len(live) < {LIMIT}, CASE WHEN len(live) < {LIMIT} THEN 0 ELSE greatest(1, floor(({WINDOW}::BIGINT * 1000000 - (o.t - live[1])) / 1000000))::INT END,
        CASE WHEN len(live) < {LIMIT} THEN list_append(live, o.t) ELSE live END
      FROM (SELECT r.user_id, r.n, list_filter(r.held, lambda x: x > p.t - {WINDOW}::BIGINT * 1000000) AS live FROM r JOIN o p ON p.user_id = r.user_id AND p.n = r.n + 1) s
      JOIN o ON o.user_id = s.user_id AND o.n = s.n + 1""") + "SELECT event_id, is_allowed, retry_after FROM r",
    "job_states": _with(
        e="""SELECT 'job' || (user_id * 100 + event_id % 10) AS job_id, event_id AS seq, CASE WHEN event_id % 41 = 0 THEN 'cancel' WHEN event_id % 17 = 0 THEN 'finalize' ELSE 'update' END AS kind,
      CASE WHEN event_id % 97 = 0 THEN 'FAILED' WHEN event_type = 'click' THEN 'PROCESSING' WHEN event_type = 'signup' THEN 'PENDING' END AS st,
      CASE WHEN event_type = 'view' THEN (value % 100)::DOUBLE END AS pr, CASE WHEN event_type = 'purchase' THEN 'stage' || (event_id % 5) END AS sg FROM events""",
        o="SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS n FROM e",
        r="""SELECT job_id, 0::BIGINT AS n, 'PENDING' AS status, NULL::INT AS progress, NULL::VARCHAR AS stage, NULL::BIGINT AS last_seq FROM o WHERE n = 1
      UNION ALL SELECT o.job_id, o.n,
        CASE o.kind WHEN 'cancel' THEN CASE WHEN r.status IN ('READY', 'FAILED', 'CANCELLED') THEN r.status ELSE 'CANCELLED' END
          WHEN 'finalize' THEN CASE WHEN r.status IN ('CANCELLED', 'FAILED') THEN r.status ELSE 'READY' END
          ELSE CASE WHEN o.st IS NULL OR (r.status IN ('CANCELLED', 'FAILED') AND o.st NOT IN ('CANCELLED', 'FAILED')) THEN r.status ELSE o.st END END,
        CASE o.kind WHEN 'finalize' THEN CASE WHEN r.status IN ('CANCELLED', 'FAILED') THEN r.progress ELSE 100 END WHEN 'update' THEN coalesce(floor(o.pr)::INT, r.progress) ELSE r.progress END,
        CASE o.kind WHEN 'finalize' THEN CASE WHEN r.status IN ('CANCELLED', 'FAILED') THEN r.stage ELSE 'complete' END
          WHEN 'cancel' THEN CASE WHEN r.status IN ('READY', 'FAILED', 'CANCELLED') THEN r.stage ELSE 'cancelled' END ELSE coalesce(o.sg, r.stage) END, o.seq
      FROM r JOIN o ON o.job_id = r.job_id AND o.n = r.n + 1""") + "SELECT job_id, status, progress, stage, n AS n_events, last_seq FROM r QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY n DESC) = 1",
    "cancel_jobs": """WITH asks AS (SELECT DISTINCT o.o_custkey::VARCHAR AS user_id, CASE WHEN l_orderkey % 2 = 0 THEN 'job' ELSE 'doc' END || l_orderkey AS target, l_orderkey AS k
    FROM lineitem JOIN orders o ON o.o_orderkey = l_orderkey + l_linenumber % 2),
  found AS (SELECT a.*, j.o_orderkey, ['PENDING', 'PROCESSING', 'READY', 'FAILED', 'CANCELLED'][j.o_orderkey % 5 + 1] AS st FROM asks a LEFT JOIN orders j ON j.o_orderkey = a.k AND j.o_custkey::VARCHAR = a.user_id)
SELECT user_id, target, 'job' || o_orderkey AS job_id, 'doc' || o_orderkey AS document_id, CASE WHEN st IN ('READY', 'FAILED', 'CANCELLED') THEN st WHEN st IS NOT NULL THEN 'CANCELLED' END AS status,
  CASE st WHEN 'READY' THEN 'Job has already completed and cannot be cancelled.' WHEN 'FAILED' THEN 'Job has already failed.' WHEN 'CANCELLED' THEN 'Job is already cancelled.'
    WHEN 'PENDING' THEN 'Ingestion job successfully cancelled.' WHEN 'PROCESSING' THEN 'Ingestion job successfully cancelled.' END AS message, coalesce(st IN ('PENDING', 'PROCESSING'), false) AS purge FROM found""",
    "counters": "SELECT event_type, count(*) AS total, round(sum(value), 4) AS duration_sum FROM events GROUP BY event_type",
    "token_cost": r"""SELECT role, sum(p)::BIGINT AS prompt_tokens, sum(c)::BIGINT AS completion_tokens, sum(p + c)::BIGINT AS total_tokens, round(sum(p / 1000.0 * 0.5 + c / 1000.0 * 1.5), 6) AS estimated_cost
FROM (SELECT role, CASE WHEN role = 'user' THEN len(regexp_split_to_array(text, '\s+')) ELSE 0 END AS p, CASE WHEN role = 'assistant' THEN len(regexp_split_to_array(text, '\s+')) ELSE 0 END AS c FROM conversations) GROUP BY role""",
    "metrics_text": """WITH c AS (SELECT event_type, count(*) AS total, sum(value) AS s FROM events GROUP BY event_type)
SELECT 'engine_requests_total' AS metric, 0 AS ord, '# HELP engine_requests_total Requests handled.' AS line UNION ALL SELECT 'engine_requests_total', 1, '# TYPE engine_requests_total counter'
UNION ALL SELECT 'engine_requests_total', 2, 'engine_requests_total{event_type="' || event_type || '"} ' || total FROM c
UNION ALL SELECT 'engine_duration_seconds_sum', 0, '# HELP engine_duration_seconds_sum Summed latency.' UNION ALL SELECT 'engine_duration_seconds_sum', 1, '# TYPE engine_duration_seconds_sum counter'
UNION ALL SELECT 'engine_duration_seconds_sum', 2, 'engine_duration_seconds_sum{event_type="' || event_type || '"} ' || format('{:.2f}', s) FROM c""",
}
