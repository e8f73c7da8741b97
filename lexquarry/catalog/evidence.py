"""Citation, validation, context, routing and event queries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexquarry.catalog.stand_ins import INTENT_SQL, PASSAGES_SQL, TURNS_SQL, passages, table, turns
from lexquarry.functions import validation as V
from lexquarry.functions import routing as R
from lexquarry.functions.refs import DOC_TAG, FORM_TAG, STATUTE_TAG
from lexquarry.functions.refs import normalize_citations as normalized
from lexquarry.functions.render import answer_words, citation_view, event_frame, evidence_block
from lexquarry.functions.text import plain_sentences, sentences
from lexquarry.operators import evidence as E

_EVIDENCE = ["chunk_id", "act", "act_short", "chapter", "chapter_title", "section_number", "section_title", "subsection",
             "clause", "text", "page_start", "page_end"]


def _s(c: Column) -> Column:
    return c.cast("string")


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant turns with citations written after them: right ones, wrong acts, missing sections, natural references."""
    c = table(spark, folder, "conversations").where(F.col("role") == "assistant")
    conv, turn = F.col("conv_id"), F.col("turn")
    act, other = F.when(conv % 2 == 0, "BNS").otherwise("BNSS"), F.when(conv % 2 == 0, "BNSS").otherwise("BNS")
    number = _s(conv * 7 % 531 + 1)
    case = (conv + F.floor(turn / 2)) % 5
    tail = (
        F.when(case == 0, F.concat(F.lit(" The offence is punishable with fine ["), act, F.lit(" s."), number, F.lit("].")))
        .when(case == 1, F.concat(F.lit(" Murder is punished ["), other, F.lit(" s."), number, F.lit("]. The court may award bail.")))
        .when(case == 2, F.concat(F.lit(" See ["), act, F.lit(" s.999]. The accused was in custody on that day.")))
        .when(case == 3, F.concat(F.lit(" It holds ["), act, F.lit(" s."), number, F.lit("("), _s(turn % 4 + 1), F.lit(")(a)] and [DOC p."),
                                  _s(conv % 200 + 1), F.lit("-"), _s(conv % 200 + 3), F.lit("].")))
        .otherwise(F.concat(F.lit(" Under Section "), number, F.lit(" of the Bharatiya Nyaya Sanhita the fine is due. [DOC:notice.pdf page "),
                            _s(conv % 200 + 2), F.lit("] [Form No. "), _s(conv % 70 + 1), F.lit("]")))
    )
    return c.select((conv * 1000 + turn).alias("answer_id"), "conv_id", F.concat("text", tail).alias("answer"))


ANSWERS_SQL = """SELECT conv_id * 1000 + turn AS answer_id, conv_id, text || CASE (conv_id + turn // 2) % 5
  WHEN 0 THEN ' The offence is punishable with fine [' || act || ' s.' || num || '].'
  WHEN 1 THEN ' Murder is punished [' || other || ' s.' || num || ']. The court may award bail.'
  WHEN 2 THEN ' See [' || act || ' s.999]. The accused was in custody on that day.'
  WHEN 3 THEN ' It holds [' || act || ' s.' || num || '(' || (turn % 4 + 1) || ')(a)] and [DOC p.' || (conv_id % 200 + 1) || '-' || (conv_id % 200 + 3) || '].'
  ELSE ' Under Section ' || num || ' of the Bharatiya Nyaya Sanhita the fine is due. [DOC:notice.pdf page ' || (conv_id % 200 + 2) || '] [Form No. ' || (conv_id % 70 + 1) || ']' END AS answer
FROM (SELECT *, CASE WHEN conv_id % 2 = 0 THEN 'BNS' ELSE 'BNSS' END AS act, CASE WHEN conv_id % 2 = 0 THEN 'BNSS' ELSE 'BNS' END AS other,
  conv_id * 7 % 531 + 1 AS num FROM conversations WHERE role = 'assistant')"""


def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Three passages per answer: the document with the conversation's number and the two after it."""
    asked = answers(spark, folder).select("answer_id", F.explode(F.array(*[
        F.struct((F.col("conv_id") + i).alias("doc_id"), F.lit(i + 1).alias("rank")) for i in range(3)])).alias("e"))
    return passages(spark, folder).join(asked.select("answer_id", "e.*"), "doc_id").select("answer_id", "rank", *_EVIDENCE, F.lit(0.5).alias("score"))


EVIDENCE_SQL = """SELECT a.answer_id, e.r AS rank, p.* FROM answers a, (SELECT unnest([1, 2, 3]) AS r) e
  JOIN passages p ON p.doc_id = a.conv_id + e.r - 1"""


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    fields = ["rank", *_EVIDENCE, "score"]
    docs = _evidence(spark, folder).groupBy("answer_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("documents"))
    return answers(spark, folder).join(docs, "answer_id")


def parse_citations(spark: SparkSession, folder: str) -> DataFrame:
    return E.parsed(answers(spark, folder), "answer_id", "answer").select(
        "answer_id", "n", "raw", "act_short", "section_number", "subsection", "clause", "canonical_tag",
        (F.col("end") - F.col("start")).alias("width"))


def parse_doc_citations(spark: SparkSession, folder: str) -> DataFrame:
    return E.parsed(answers(spark, folder), "answer_id", "answer", "document")


def parse_form_citations(spark: SparkSession, folder: str) -> DataFrame:
    return E.parsed(answers(spark, folder), "answer_id", "answer", "form").select("answer_id", "n", "raw", "form_number")


def verify_citations(spark: SparkSession, folder: str) -> DataFrame:
    return E.verify_citations(E.parsed(answers(spark, folder), "answer_id", "answer"), _evidence(spark, folder), "answer_id").select(
        "answer_id", "n", "canonical_tag", "reason", "is_verified", "chunk_id")


def page_range_verify(spark: SparkSession, folder: str) -> DataFrame:
    return E.verify_pages(E.parsed(answers(spark, folder), "answer_id", "answer", "document"), _evidence(spark, folder), "answer_id").select(
        "answer_id", "n", "canonical_tag", "chunk_id", "is_verified")


def form_citation_verify(spark: SparkSession, folder: str) -> DataFrame:
    forms = table(spark, folder, "part").select((F.col("p_partkey") % 58 + 1).cast("int").alias("form_number"), F.lit("Form").alias("form_title")).distinct()
    seen = answers(spark, folder).select("answer_id", (F.col("conv_id") % 61 + 1).cast("int").alias("form_number"))
    return E.verify_forms(E.parsed(answers(spark, folder), "answer_id", "answer", "form"), forms, seen, "answer_id").select(
        "answer_id", "n", "form_number", "reason", "is_verified")


def normalize_citations(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder).select("answer_id", normalized(F.col("answer"), F.col("documents")).alias("answer"))


def sentence_split(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("n", "sentence")).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_sentences"), F.max(F.length("sentence")).cast("long").alias("longest"))


def sentence_split_plain(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.posexplode(plain_sentences(F.col("text"))).alias("n", "sentence")).select(
        "doc_id", "n", F.md5("sentence").alias("sentence_md5"))


def claim_sentences(spark: SparkSession, folder: str) -> DataFrame:
    s = answers(spark, folder).select("answer_id", F.posexplode(plain_sentences(F.col("answer"))).alias("n", "s"))
    return s.select("answer_id", "n", V.is_claim(F.col("s")).alias("is_claim"), V.is_meta(F.col("s")).alias("is_meta"))


def uncited_claims_dual(spark: SparkSession, folder: str) -> DataFrame:
    return answers(spark, folder).select("answer_id", F.posexplode(V.dual_uncited_claims(F.col("answer"))).alias("n", "claim"))


def validate_answers(spark: SparkSession, folder: str) -> DataFrame:
    return E.validate(_judged(spark, folder)).select(
        "answer_id", "validation.is_valid", "validation.checked", "validation.valid", "validation.invalid",
        F.size("validation.uncited").alias("n_uncited"), F.array_join("validation.reasons", "; ").alias("reasons"))


def validate_dual_answers(spark: SparkSession, folder: str) -> DataFrame:
    chunks = F.transform("documents", lambda d: F.struct(
        d["chunk_id"].alias("chunk_id"), F.lit("notice.pdf").alias("filename"), d["page_start"].alias("page_start"),
        d["page_end"].alias("page_end"), d["text"].alias("text")))
    return E.validate_dual(_judged(spark, folder).withColumn("chunks", chunks)).select(
        "answer_id", "validation.is_valid", "validation.checked", "validation.valid", "validation.invalid",
        F.size("validation.uncited").alias("n_uncited"), F.array_join("validation.reasons", "; ").alias("reasons"))


def render_context(spark: SparkSession, folder: str) -> DataFrame:
    e = _evidence(spark, folder)
    row = F.struct(*[F.col(c) for c in [*_EVIDENCE, "score"]])
    return e.select("answer_id", "rank", F.md5(evidence_block(row, F.col("rank"))).alias("block_md5"))


def context_budget(spark: SparkSession, folder: str) -> DataFrame:
    return E.within_budget(_evidence(spark, folder), "answer_id", F.col("text"), 4000).select("answer_id", "rank", "chunk_id", F.col("used").cast("long").alias("used"))


def citation_views(spark: SparkSession, folder: str) -> DataFrame:
    p = passages(spark, folder)
    d = F.col("doc_id")
    tag = F.when(d % 3 == 0, F.concat(F.lit("[DOC p."), _s(d), F.lit("]"))).when(
        d % 3 == 1, F.concat(F.lit("[BNSS Second Schedule, Form "), _s(d), F.lit("]"))).otherwise(
        F.concat(F.lit("[BNS s."), F.col("section_number"), F.lit("]")))
    source = F.concat("chunk_id", F.lit("_p3_c1"))
    view = citation_view(tag, source, F.concat(F.lit("Form "), _s(d)), F.col("section_title"), F.col("act"), F.col("act_short"))
    return p.select("doc_id", view.alias("v")).select("doc_id", "v.citation_type", "v.document_id", "v.form_number", "v.section_title")


def route_queries(spark: SparkSession, folder: str) -> DataFrame:
    docs = F.when(F.col("query_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("d1")))
    return turns(spark, folder).select("query_id", R.route(F.col("query_text"), docs).alias("r")).select(
        "query_id", "r.intent", "r.confidence", "r.section")


def form_intent(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat(F.when(F.col("query_id") % 3 == 0, "Show form ").when(F.col("query_id") % 11 == 0, "A Bail Bond ").otherwise(""), F.col("query_text"))
    return turns(spark, folder).select("query_id", R.is_form_intent(text).alias("is_form"))


def sse_words(spark: SparkSession, folder: str) -> DataFrame:
    words = answers(spark, folder).select("answer_id", F.posexplode(answer_words(F.col("answer"))).alias("n", "word"))
    frame = event_frame(F.lit("token"), F.to_json(F.struct(F.col("word").alias("token"))))
    return words.select("answer_id", "n", F.md5(frame).alias("frame_md5"))


def principals(spark: SparkSession, folder: str) -> DataFrame:
    u = _s(F.col("c_custkey"))
    token = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("token_"), u, F.lit("_x"))).when(
        F.col("c_custkey") % 4 == 1, F.concat(F.lit("user_"), u)).when(F.col("c_custkey") % 4 == 2, F.concat(u, F.lit(":s"), u)).otherwise(u)
    return table(spark, folder, "customer").select("c_custkey", R.principal_of(token).alias("principal"), R.session_of(token).alias("session"))


def endpoint_labels(spark: SparkSession, folder: str) -> DataFrame:
    o = _s(F.col("o_orderkey"))
    path = F.concat(F.lit("/api/v1/"), F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("documents/"), o)).when(
        F.col("o_orderkey") % 4 == 1, F.concat(F.lit("documents/status/"), o)).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("forms/"), o)).otherwise("documents/upload"))
    return table(spark, folder, "orders").select(R.endpoint_label(path).alias("endpoint")).groupBy("endpoint").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    parse_citations, parse_doc_citations, parse_form_citations, verify_citations, page_range_verify, form_citation_verify,
    normalize_citations, sentence_split, sentence_split_plain, claim_sentences, uncited_claims_dual, validate_answers,
    validate_dual_answers, render_context, context_budget, citation_views, route_queries, form_intent, sse_words, principals,
    endpoint_labels)}

_TAG, _DOC, _FORM = STATUTE_TAG, DOC_TAG, FORM_TAG
_CTES = {
    "passages": PASSAGES_SQL, "answers": ANSWERS_SQL, "evidence": EVIDENCE_SQL,
    "raws": f"SELECT answer_id, generate_subscripts(regexp_extract_all(answer, '{_TAG}'), 1) - 1 AS n, unnest(regexp_extract_all(answer, '{_TAG}')) AS raw FROM answers",
    "parts": f"""SELECT *, upper(regexp_extract(raw, '{_TAG}', 1)) AS act_short, regexp_extract(raw, '{_TAG}', 2) AS section_number,
      regexp_extract(raw, '{_TAG}', 3) AS s1, regexp_extract(raw, '{_TAG}', 4) AS s2, regexp_extract(raw, '{_TAG}', 5) AS s3 FROM raws""",
    "cited": r"""SELECT answer_id, n::INT AS n, raw, act_short, section_number, nullif(s1 || s2 || s3, '') AS subsection,
      CASE WHEN s1 <> '' AND s2 <> '' AND NOT regexp_matches(s1, '^\([a-zA-Z]+\)$') AND regexp_matches(s2, '^\([a-zA-Z]+\)$') THEN s2 END AS clause,
      '[' || act_short || ' s.' || section_number || s1 || s2 || s3 || ']' AS canonical_tag FROM parts""",
    "doc_raws": f"SELECT answer_id, generate_subscripts(regexp_extract_all(answer, '{_DOC}'), 1) - 1 AS n, unnest(regexp_extract_all(answer, '{_DOC}')) AS raw FROM answers",
    "doc_cited": f"""SELECT answer_id, n::INT AS n, raw, filename, page_number, page_end, '[DOC p.' || page_number || CASE WHEN page_end = page_number THEN '' ELSE '-' || page_end END || ']' AS canonical_tag
      FROM (SELECT *, nullif(regexp_extract(raw, '{_DOC}', 1), '') AS filename, regexp_extract(raw, '{_DOC}', 2)::INT AS page_number,
        coalesce(TRY_CAST(nullif(regexp_extract(raw, '{_DOC}', 3), '') AS INT), regexp_extract(raw, '{_DOC}', 2)::INT) AS page_end FROM doc_raws)""",
    "form_cited": f"SELECT answer_id, (generate_subscripts(l, 1) - 1)::INT AS n, unnest(l) AS raw, regexp_extract(unnest(l), '{_FORM}', 1)::INT AS form_number FROM (SELECT answer_id, regexp_extract_all(answer, '{_FORM}') AS l FROM answers)",
    "sents": r"""SELECT answer_id, list_filter(list_transform(string_split(regexp_replace(answer, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
      lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ss FROM answers""",
}


def _use(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({_CTES[n]})" for n in names) + "\n"


_CITE = ("passages", "answers", "evidence", "raws", "parts", "cited")
_ANY = "|".join
_DOC_SIGNALS = _ANY(rf"\b{re.escape(s)}\b" if len(s) <= 2 else re.escape(s) for s in R.DOCUMENT_SIGNALS).replace("\\ ", " ")
_STATUTE_SIGNALS = _ANY(re.escape(s) for s in R.STATUTE_SIGNALS).replace("\\ ", " ")

SQL = {
    "parse_citations": _use("answers", "raws", "parts", "cited") + "SELECT *, length(raw)::INT AS width FROM cited",
    "parse_doc_citations": _use("answers", "doc_raws", "doc_cited") + "SELECT * FROM doc_cited",
    "parse_form_citations": _use("answers", "form_cited") + "SELECT * FROM form_cited",
    "verify_citations": _use(*_CITE) + r"""SELECT answer_id, n, canonical_tag, reason, reason IS NULL AS is_verified, CASE WHEN reason IS NULL THEN best END AS chunk_id FROM (
  SELECT c.answer_id, c.n, c.canonical_tag, arg_min(e.chunk_id, e.rank) AS best,
    CASE WHEN NOT EXISTS (SELECT 1 FROM evidence x WHERE x.answer_id = c.answer_id AND x.act_short = c.act_short) THEN 'ACT_NOT_RETRIEVED'
      WHEN count(e.rank) = 0 THEN 'SECTION_NOT_RETRIEVED'
      WHEN NOT bool_or(c.subsection IS NULL OR (coalesce(e.subsection, '') <> '' AND (contains(e.subsection, c.subsection) OR contains(c.subsection, e.subsection)))
        OR contains(e.section_number, c.subsection) OR contains(e.text, c.subsection)) THEN 'SUBSECTION_NOT_SUPPORTED' END AS reason
  FROM cited c LEFT JOIN evidence e ON e.answer_id = c.answer_id AND e.act_short = c.act_short
    AND c.section_number IN (e.section_number, regexp_extract(e.section_number, '^\d+[A-Za-z]?')) GROUP BY c.answer_id, c.n, c.canonical_tag, c.act_short)""",
    "page_range_verify": _use("passages", "answers", "evidence", "doc_raws", "doc_cited") + """SELECT c.answer_id, c.n, c.canonical_tag, arg_min(e.chunk_id, e.rank) AS chunk_id, count(e.rank) > 0 AS is_verified
FROM doc_cited c LEFT JOIN evidence e ON e.answer_id = c.answer_id AND c.page_number BETWEEN e.page_start AND e.page_end GROUP BY ALL""",
    "form_citation_verify": _use("answers", "form_cited") + """SELECT c.answer_id, n, c.form_number, r AS reason, r IS NULL AS is_verified FROM (
  SELECT c.*, CASE WHEN c.form_number NOT IN (SELECT p_partkey % 58 + 1 FROM part) THEN 'FORM_DOES_NOT_EXIST' WHEN c.form_number <> a.conv_id % 61 + 1 THEN 'FORM_NOT_RETRIEVED' END AS r
  FROM form_cited c JOIN answers a USING (answer_id)) c""",
    "sentence_split_plain": r"""SELECT doc_id, (generate_subscripts(ss, 1) - 1)::INT AS n, md5(unnest(ss)) AS sentence_md5 FROM (SELECT doc_id, list_filter(list_transform(
  string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ss FROM documents)""",
    "claim_sentences": _use("answers", "sents") + f"""SELECT answer_id, n, regexp_matches(lower(s), '{_ANY(V.CLAIM_WORDS)}') AS is_claim, regexp_matches(lower(s), '{_ANY(V.META_OPENINGS)}') AS is_meta
FROM (SELECT answer_id, (generate_subscripts(ss, 1) - 1)::INT AS n, unnest(ss) AS s FROM sents)""",
    "uncited_claims_dual": _use("answers", "sents") + rf"""SELECT answer_id, (generate_subscripts(cs, 1) - 1)::INT AS n, unnest(cs) AS claim FROM (SELECT answer_id, list_filter(ss,
  lambda s: NOT regexp_matches(s, '(?i)\[(?:BNS|BNSS|DOC)(?::|\s)[^\]]+\]') AND length(s) > 30 AND regexp_matches(s, '(?i){_ANY(V.DUAL_CLAIMS)}')) AS cs FROM sents)""",
    "render_context": _use("passages", "answers", "evidence") + """SELECT answer_id, rank, md5(concat_ws(chr(10), '--- [EVIDENCE ITEM #' || rank || '] ---', 'Chunk ID: ' || chunk_id, 'Act: ' || act || ' (' || act_short || ')',
  'Chapter: ' || chapter || ' - ' || chapter_title, 'Section: ' || section_number || ' - ' || section_title, 'Subsection: ' || coalesce(subsection, 'None') || ' | Clause: None',
  'Pages: ' || page_start || '–' || page_end, 'Relevance Score: 0.5000', 'Statutory Text:', trim(text), '----------------------------')) AS block_md5 FROM evidence""",
    "context_budget": _use("passages", "answers", "evidence") + """SELECT answer_id, rank, chunk_id, used::BIGINT AS used FROM (
  SELECT *, sum(length(text) + 2) OVER (PARTITION BY answer_id ORDER BY rank) AS used FROM evidence) WHERE rank = 1 OR used <= 4000""",
    "citation_views": _use("passages") + """SELECT doc_id, ['document', 'form', 'statutory'][doc_id % 3 + 1] AS citation_type, CASE WHEN doc_id % 3 = 0 THEN chunk_id END AS document_id,
  CASE WHEN doc_id % 3 = 1 THEN doc_id::INT END AS form_number, CASE WHEN doc_id % 3 = 2 THEN section_title END AS section_title FROM passages""",
    "route_queries": f"WITH turns AS ({TURNS_SQL}), intents AS ({INTENT_SQL})" + f"""
SELECT query_id, ['STATUTORY_ONLY', 'COMBINED', 'DOCUMENT_ONLY', 'STATUTORY_ONLY', 'COMBINED'][c] AS intent, [1.0, 0.95, 0.9, 0.9, 0.7][c]::DOUBLE AS confidence,
  CASE WHEN c IN (2, 4) THEN section_number END AS section FROM (
  SELECT *, CASE WHEN query_id % 7 = 0 THEN 1 WHEN d AND s THEN 2 WHEN d THEN 3 WHEN s THEN 4 ELSE 5 END AS c FROM (
    SELECT *, regexp_matches(lower(query_text), '{_DOC_SIGNALS}') AS d, section_number IS NOT NULL OR regexp_matches(lower(query_text), '{_STATUTE_SIGNALS}') AS s FROM intents))""",
    "form_intent": f"WITH turns AS ({TURNS_SQL})" + """
SELECT query_id, (contains(t, 'form') AND regexp_matches(t, 'no|number|1|2|3|4|33|58|show|get|what is')) OR regexp_matches(t, 'notice for appearance|warrant of arrest|bail bond') AS is_form
FROM (SELECT query_id, lower(CASE WHEN query_id % 3 = 0 THEN 'Show form ' WHEN query_id % 11 = 0 THEN 'A Bail Bond ' ELSE '' END || query_text) AS t FROM turns)""",
    "sse_words": _use("answers") + """SELECT answer_id, (i - 1)::INT AS n, md5('event: token' || chr(10) || 'data: {"token":"' || replace(replace(w || CASE WHEN i < k THEN ' ' ELSE '' END, '"', '\\"'), chr(10), '\\n') || '"}' || chr(10) || chr(10)) AS frame_md5
FROM (SELECT answer_id, len(ws) AS k, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT answer_id, string_split(answer, ' ') AS ws FROM answers))""",
    "principals": """SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN 'user_' || c_custkey WHEN c_custkey % 4 = 3 AND length(c_custkey::VARCHAR) < 3 THEN NULL ELSE c_custkey::VARCHAR END AS principal,
  CASE WHEN c_custkey % 4 = 2 THEN 's' || c_custkey END AS session FROM customer""",
    "endpoint_labels": """SELECT ['/api/v1/documents/{id}', '/api/v1/documents/{id}/status', '/api/v1/forms/{id}', '/api/v1/documents/upload'][o_orderkey % 4 + 1] AS endpoint, count(*) AS n FROM orders GROUP BY 1""",
}

