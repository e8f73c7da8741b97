"""Text cleaning, structure, chunking, layout, schedule and form queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexquarry.catalog.stand_ins import table
from lexquarry.functions import text as T
from lexquarry.functions.ids import chunk_point_id
from lexquarry.functions.refs import cross_references
from lexquarry.operators import structure as S
from lexquarry.operators.chunking import all_passages, chunk_pages, chunk_schedule, chunk_sections
from lexquarry.operators.schedule import COURTS, schedule_entries

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _s(c: Column) -> Column:
    return c.cast("string")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the documents: a source is an act, a document one of its pages."""
    return table(spark, folder, "documents").select(
        F.col("source").alias("act_key"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw")
    ).select("act_key", "page", (F.col("pos") + 1).alias("line_no"), T.strip(F.col("raw")).alias("raw")).where(F.col("raw") != "")


LINES_SQL = f"""SELECT act_key, page, line_no::INT AS line_no, raw FROM (
  SELECT source AS act_key, doc_id AS page, generate_subscripts(string_split(text, chr(10)), 1) AS line_no,
    {STRIP.format("unnest(string_split(text, chr(10)))")} AS raw FROM documents) WHERE raw <> ''"""


def statute_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines with section starts, subsections, blocks and chapters written into them."""
    n = F.col("page") * 3 + F.col("line_no")
    case = n % 8
    number = _s(n % 600)
    raw = F.col("raw")
    text = (
        F.when(case == 0, F.concat(number, F.lit(". The "), raw))
        .when(case == 1, F.concat(F.lit("(1) "), raw)).when(case == 2, F.concat(F.lit("(2) "), raw))
        .when(case == 3, F.concat(F.lit("(a) "), raw)).when(case == 4, F.concat(F.lit("Provided that "), raw))
        .when(case == 5, F.concat(raw, F.lit(" with it. "), number, F.lit(". Whoever so acts.")))
        .when((case == 6) & (F.col("page") % 5 == 0), F.concat(F.lit("CHAPTER "), F.element_at(
            F.array(*[F.lit(x) for x in ("I", "V", "X", "L", "C")]), (n % 5 + 1).cast("int"))))
        .when(case == 6, F.concat(F.lit("Explanation. "), raw)).otherwise(raw)
    )
    return _lines(spark, folder).select("act_key", "page", "line_no", text.alias("text"))


STATUTE_SQL = """SELECT act_key, page, line_no, CASE (page * 3 + line_no) % 8
  WHEN 0 THEN ((page * 3 + line_no) % 600) || '. The ' || raw WHEN 1 THEN '(1) ' || raw WHEN 2 THEN '(2) ' || raw
  WHEN 3 THEN '(a) ' || raw WHEN 4 THEN 'Provided that ' || raw
  WHEN 5 THEN raw || ' with it. ' || ((page * 3 + line_no) % 600) || '. Whoever so acts.'
  WHEN 6 THEN CASE WHEN page % 5 = 0 THEN 'CHAPTER ' || ['I', 'V', 'X', 'L', 'C'][(page * 3 + line_no) % 5 + 1]
                   ELSE 'Explanation. ' || raw END
  ELSE raw END AS text FROM lines"""

SECTION_CTES = {
    "lines": LINES_SQL, "statute": STATUTE_SQL,
    "flags": r"""SELECT *, upper(regexp_extract(text, '(?i)^\s*CHAPTER\s+([IVXLCDM]+)\s*$', 1)) AS chap,
      coalesce(nullif(regexp_extract(text, '^(|.*?\.\s)(\d+)\.\s*[A-Z(].*$', 2), ''), regexp_extract(text, '^(\d+)\.[A-Za-z].*$', 1)) AS num,
      regexp_extract(text, '^(|.*?\.\s)(\d+)\.\s*[A-Z(].*$', 1) AS prefix,
      regexp_matches(text, '(?i)^\s*CHAPTER\s+([IVXLCDM]+)\s*$') OR regexp_matches(text, '^(|.*?\.\s)(\d+)\.\s*[A-Z(].*$') AS brk FROM statute""",
    "near": """SELECT *, lead(text, 1) OVER w AS t1, lead(text, 2) OVER w AS t2, lead(text, 3) OVER w AS t3,
      NOT coalesce(lead(brk, 1) OVER w, true) AS k1, NOT coalesce(lead(brk, 2) OVER w, true) AS k2, NOT coalesce(lead(brk, 3) OVER w, true) AS k3,
      coalesce(lag(chap, 1) OVER w <> '', false) AS c1, coalesce(lag(chap, 2) OVER w <> '', false) AS c2, coalesce(lag(chap, 3) OVER w <> '', false) AS c3,
      coalesce(lag(brk, 1) OVER w, true) AS b1, coalesce(lag(brk, 2) OVER w, true) AS b2
      FROM flags WINDOW w AS (PARTITION BY act_key, page ORDER BY line_no)""",
    "marked": """SELECT *, NOT brk AND (c1 OR (c2 AND NOT b1) OR (c3 AND NOT b1 AND NOT b2)) AS taken,
      CASE WHEN chap <> '' AND k1 THEN concat_ws(' ', t1, CASE WHEN k2 THEN t2 END, CASE WHEN k2 AND k3 THEN t3 END) END AS title FROM near""",
    "started": """SELECT *, chap = '' AND NOT taken AND coalesce(TRY_CAST(nullif(num, '') AS INT) BETWEEN 1 AND 531, false) AS start,
      chap = '' AND NOT taken AS content FROM marked""",
    "pieces": f"""SELECT act_key, page, line_no, 1 AS part, CASE WHEN start AND {STRIP.format('prefix')} <> '' THEN {STRIP.format('substr(text, length(' + STRIP.format('prefix') + ') + 1)')} ELSE text END AS text,
        start, num, content, nullif(chap, '') AS chap, title FROM started
      UNION ALL SELECT act_key, page, line_no, 0, {STRIP.format('prefix')}, false, num, content, NULL, NULL FROM started WHERE start AND {STRIP.format('prefix')} <> ''""",
    "scanned": """SELECT *, sum(start::INT) OVER w AS seq, last_value(chap IGNORE NULLS) OVER w AS chapter, last_value(title IGNORE NULLS) OVER w AS chapter_title
      FROM pieces WINDOW w AS (PARTITION BY act_key ORDER BY page, line_no, part ROWS UNBOUNDED PRECEDING)""",
    "sections": """SELECT act_key, seq::BIGINT AS seq, max(num) FILTER (start) AS section_number, max(coalesce(chapter, 'I')) FILTER (start) AS chapter,
      max(coalesce(chapter_title, 'PRELIMINARY')) FILTER (start) AS chapter_title, max(page) FILTER (start) AS page_start,
      max(page) FILTER (part = 1) AS page_end, string_agg(text, chr(10) ORDER BY page, line_no, part) AS raw_text, count(*) AS n_lines
      FROM scanned WHERE content AND seq > 0 GROUP BY act_key, seq""",
}


def _with(ctes: dict[str, str]) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in ctes.items())


def _sections(spark: SparkSession, folder: str) -> DataFrame:
    return S.detect_sections(statute_lines(spark, folder), ["act_key"])


def line_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return _sections(spark, folder).select(
        "act_key", "seq", "section_number", "chapter", "chapter_title", "page_start", "page_end",
        F.size("lines").cast("long").alias("n_lines"), F.md5("raw_text").alias("text_md5"))


def chapter_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return S.chapters(_sections(spark, folder), ["act_key"])


def attached_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return _sections(spark, folder).select(
        "act_key", "seq", F.posexplode(S.attached_blocks(F.col("lines"))).alias("n", "b")).select(
        "act_key", "seq", "n", "b.kind", F.md5("b.text").alias("text_md5"))


def subsections(spark: SparkSession, folder: str) -> DataFrame:
    return _sections(spark, folder).select(
        "act_key", "seq", F.posexplode(S.subsections(F.col("raw_text"))).alias("n", "s")).select(
        "act_key", "seq", "n", "s.subsection_id", F.size("s.clauses").cast("long").alias("n_clauses"),
        F.md5("s.text").alias("text_md5"))


def _with_act(sections: DataFrame) -> DataFrame:
    return sections.withColumns({"act": F.col("act_key"), "act_short": F.lit("BNSS")})


def pack_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_sections(_with_act(_sections(spark, folder)), ["act_key"], 1200).select(
        "act_key", "seq", F.col("part").cast("int").alias("part"), "chunk_id", "subsection", F.length("text").cast("long").alias("n_chars"),
        F.md5("text").alias("text_md5"), "has_proviso", "has_explanation")


def user_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """A source is an uploaded document, a document one of its pages; blank lines stand before every fourth line."""
    pages = table(spark, folder, "documents").select(
        F.col("source").alias("document_id"), F.col("doc_id").alias("page_number"),
        F.regexp_replace("text", r"\n", "\n\n").alias("text"))
    return chunk_pages(pages, 900, 100).select(
        "document_id", F.col("page_start"), "chunk_index", "chunk_id", F.length("text").cast("long").alias("n_chars"),
        F.md5("text").alias("text_md5"), F.col("token_count").cast("long").alias("token_count"))


def clean_whitespace(spark: SparkSession, folder: str) -> DataFrame:
    messy = F.concat(F.lit("  "), F.regexp_replace("text", " (?=[aeiou])", " \t  "), F.lit(" \n\n\n\n end "))
    return table(spark, folder, "documents").select(
        "doc_id", F.md5(T.normalize_whitespace(messy)).alias("text_md5"))


def strip_boilerplate(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("page") + F.col("line_no")
    heads = F.array(*[F.lit(x) for x in ("THE GAZETTE OF INDIA EXTRAORDINARY ", "Sec. 1] ", "___________ ", "CG-DL-E-", "———", " ", " ")])
    line = F.when(n % 6 == 0, _s(n % 1500)).when(n % 3 == 0, F.concat(F.element_at(heads, (n % 7 + 1).cast("int")), F.col("raw"))).otherwise(F.col("raw"))
    return _lines(spark, folder).select("page", "line_no", line.alias("text")).where(~T.is_boilerplate(F.col("text"))).select(
        "page", "line_no", F.md5(F.rtrim("text")).alias("text_md5"))


def dehyphenate(spark: SparkSession, folder: str) -> DataFrame:
    broken = F.regexp_replace("text", r"([a-z]{3})([a-z]{3}) ", "$1-\n$2 ")
    return table(spark, folder, "documents").select("doc_id", F.md5(T.dehyphenate(broken)).alias("text_md5"))


def clean_documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("text_md5"))


def token_estimate(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", T.token_estimate(F.col("text")).cast("long").alias("n_tokens"))


def slugify(spark: SparkSession, folder: str) -> DataFrame:
    title = F.concat(_s(F.col("p_partkey")), F.lit(": THE "), F.upper("p_name"), F.lit(" for Bail-BOND of "), F.col("p_brand"))
    return table(spark, folder, "part").select("p_partkey", T.slugify(title).alias("slug"),
                                               T.form_filename(F.col("p_partkey"), title).alias("filename"))


def normalize_titles(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.concat(F.col("p_name"), F.lit(". "), F.col("p_brand"), F.lit(" 2 of 1974. "), _s(F.col("p_size")))
    return table(spark, folder, "part").select(
        "p_partkey", T.normalize_key(raw).alias("key"), T.clean_note_title(raw).alias("title"))


def chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        "o_orderkey", chunk_point_id(F.concat(F.lit("bns-s"), _s(F.col("o_orderkey")))).alias("point_id"))


def cross_refs(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("doc_id")
    text = F.concat(F.col("text"), F.lit(" section "), _s(d % 500), F.lit("(2) of the Bharatiya Nyaya Sanhita, and sections "),
                    _s(d % 90 + 1), F.lit(", 7 and 9 of Chapter V; see the "), F.when(d % 2 == 0, "First").otherwise("second"),
                    F.lit(" Schedule."), F.repeat(F.lit(" and"), 30), F.lit(" under section "), _s(d % 77), F.lit("A."))
    return table(spark, folder, "documents").select("doc_id", F.array_join(cross_references(text), "; ").alias("refs"))


def _elements(spark: SparkSession, folder: str) -> DataFrame:
    """Positioned text: every line of a page at a place made from its number."""
    n, p = F.col("line_no"), F.col("page")
    x = F.element_at(F.array(F.lit(50.0), F.lit(150.0), F.lit(480.0), F.lit(150.0)), (n % 4 + 1).cast("int"))
    y = F.lit(790.0) - (n * 13 + p % 3) % 770
    text = F.when(n % 4 == 1, F.concat(_s(n * 5 % 560 + 1), F.lit(". The "), F.col("raw"))).otherwise(F.col("raw"))
    return _lines(spark, folder).select("act_key", "page", n.alias("element"), x.alias("x"), y.alias("y"), text.alias("text"))


ELEMENTS_SQL = """SELECT act_key, page, line_no AS element, [50.0, 150.0, 480.0, 150.0][line_no % 4 + 1]::DOUBLE AS x,
  (790.0 - (line_no * 13 + page % 3) % 770)::DOUBLE AS y,
  CASE WHEN line_no % 4 = 1 THEN (line_no * 5 % 560 + 1) || '. The ' || raw ELSE raw END AS text FROM lines"""


def layout_columns(spark: SparkSession, folder: str) -> DataFrame:
    e = S.split_columns(_elements(spark, folder), T.is_boilerplate(F.col("text")))
    return e.select("page", "element", "is_margin", F.col("x"), F.col("y"))


def page_lines(spark: SparkSession, folder: str) -> DataFrame:
    e = S.split_columns(_elements(spark, folder), T.is_boilerplate(F.col("text")))
    return S.text_lines(e.where(~F.col("is_margin")), ["act_key"]).select("act_key", "page", "y_line", F.md5("text").alias("text_md5"))


def _clusters(spark: SparkSession, folder: str) -> DataFrame:
    e = S.split_columns(_elements(spark, folder), T.is_boilerplate(F.col("text")))
    return S.note_clusters(e.where("is_margin"), ["act_key"], 60.0, T.clean_note_title)


def gap_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return _clusters(spark, folder).select("act_key", "page", F.col("cluster").cast("int").alias("cluster"), "y_top", "y_bottom",
                                           F.md5("title").alias("title_md5"))


def margin_titles(spark: SparkSession, folder: str) -> DataFrame:
    e = S.split_columns(_elements(spark, folder), T.is_boilerplate(F.col("text")))
    lines = S.text_lines(e.where(~F.col("is_margin")), ["act_key"])
    return S.note_titles(lines, _clusters(spark, folder), ["act_key"], 531, 55.0)


def _schedule_lines(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("page") + F.col("line_no")
    raw = F.col("raw")
    tail = F.element_at(F.array(*[F.lit(x) for x in (
        " Imprisonment for 3 years. Cognizable Bailable Any Magistrate", " Death, Non-cognizable. Non-bailable High Court", " Fine.",
        " Same as for the offence. Magistrate of the first class.")]), (n % 4 + 1).cast("int"))
    text = (
        F.when(n % 4 == 0, F.concat(_s(n % 400 + 1), F.lit(" ( 2 ) "), raw, tail))
        .when(n % 9 == 1, F.concat(F.lit("Section Offence "), raw)).otherwise(F.concat(raw, tail))
    )
    return _lines(spark, folder).select("act_key", "page", "line_no", text.alias("text"))


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    return schedule_entries(_schedule_lines(spark, folder), ["act_key"])


def schedule_fields(spark: SparkSession, folder: str) -> DataFrame:
    return _entries(spark, folder).select(
        "act_key", F.col("seq").cast("long").alias("seq"), "section_number", "page", F.md5("offence_name").alias("offence_md5"),
        F.md5("punishment").alias("punishment_md5"), "cognizable_status", "bailable_status", "triable_court")


def schedule_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_schedule(_entries(spark, folder), ["act_key"], "Bharatiya Nyaya Sanhita, 2023", "BNS").select(
        "act_key", F.col("seq").cast("long").alias("seq"), "chunk_id", F.md5("text").alias("text_md5"))


def statute_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Sections and schedule rows of every act as one table of passages."""
    body = chunk_sections(_with_act(_sections(spark, folder)), ["act_key"])
    rows = chunk_schedule(_entries(spark, folder), ["act_key"], "Bharatiya Nyaya Sanhita, 2023", "BNS")
    return all_passages(body, rows).groupBy("act_key", "chunk_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


def html_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of markup as text lines: tags become line ends, boilerplate lines go."""
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", ""), r"<[^>]*>", "\n")
    return table(spark, folder, "pages").select("page_id", F.explode(F.split(text, "\n", -1)).alias("line")).select(
        "page_id", T.strip(F.col("line")).alias("line")).where((F.col("line") != "") & ~T.is_boilerplate(F.col("line"))).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


QUERIES = {f.__name__: f for f in (
    line_sessions, chapter_rollup, attached_blocks, subsections, pack_chunks, user_chunks, clean_whitespace, strip_boilerplate,
    dehyphenate, clean_documents, token_estimate, slugify, normalize_titles, chunk_ids, cross_refs, layout_columns, page_lines,
    gap_clusters, margin_titles, schedule_fields, schedule_chunks, statute_passages, html_blocks)}

_BOILER = "|".join(f"(?:{p})" for p in [*T.BOILERPLATE_PATTERNS, r"^\d{1,3}$"]).replace("'", "''")


def _is_boiler(x: str) -> str:
    return f"regexp_matches(trim({x}), '(?i)(?:{_BOILER})')"


_NOTE = (r"regexp_replace(" + STRIP.format(r"regexp_replace({0}, '(?i)\b\d+\s+of\s+\d{{4}}\.?\b', '', 'g')") + r", '\s+\d+$', '')")


def _note_sql(x: str) -> str:
    return STRIP.format("rtrim(regexp_replace(" + STRIP.format(_NOTE.format(STRIP.format(x))) + r", '\s+', ' ', 'g'), ' .—,-')")


_SPLIT_CTES = {
    "lines": LINES_SQL, "elements": ELEMENTS_SQL,
    "placed": f"SELECT *, CASE WHEN page % 2 = 0 THEN x < 110 ELSE x > 475 END AS is_margin FROM elements WHERE NOT {_is_boiler('text')} AND y BETWEEN 35 AND 765",
}
_CLUSTER_CTES = {
    **_SPLIT_CTES,
    "steps": rf"""SELECT *, coalesce(lag(y) OVER w - y > 60 OR lag(y) OVER w - y < 0 OR ends_with(lag(t0) OVER w, '.'), true)::INT AS new
      FROM (SELECT act_key, page, element, y, {STRIP.format('text')} AS t0, text FROM placed WHERE is_margin) WINDOW w AS (PARTITION BY act_key, page ORDER BY y DESC, element)""",
    "numbered": "SELECT *, sum(new) OVER (PARTITION BY act_key, page ORDER BY y DESC, element ROWS UNBOUNDED PRECEDING) AS cluster FROM steps",
    "joined": "SELECT act_key, page, cluster, max(y) AS y_top, min(y) AS y_bottom, string_agg(text, ' ' ORDER BY y DESC, element) AS raw FROM numbered GROUP BY ALL",
    "clusters": f"SELECT act_key, page, cluster, y_top, y_bottom, {_note_sql('raw')} AS title FROM joined WHERE {_note_sql('raw')} <> ''",
}
_KIND = r"""CASE WHEN regexp_matches(x, '(?i)^Provided\s+(?:further\s+|also\s+)?that\b') THEN 'proviso'
  WHEN regexp_matches(x, '(?i)^Exception(?:\s+\d+)?\s*[.—]') THEN 'exception' WHEN regexp_matches(x, '(?i)^Explanation(?:\s+\d+)?\s*[.—]') THEN 'explanation'
  WHEN regexp_matches(x, '(?i)^Illustration(?:\s+[a-z]|\s*\([a-z]\))?\s*[.—]') THEN 'illustration' WHEN regexp_matches(x, '^\((\d+)\)\s*') THEN 'subsection' END"""
BLOCK_CTES = {
    **SECTION_CTES,
    "kinds": f"SELECT act_key, seq, page, line_no, part, text AS x, {_KIND} AS kind FROM scanned WHERE content AND seq > 0",
    "opened": "SELECT *, count(kind) OVER (PARTITION BY act_key, seq ORDER BY page, line_no, part ROWS UNBOUNDED PRECEDING) AS block FROM kinds",
    "blocks": """SELECT act_key, seq::BIGINT AS seq, block, max(kind) AS kind, string_agg(x, chr(10) ORDER BY page, line_no, part) AS text
      FROM opened WHERE block > 0 GROUP BY act_key, seq, block""",
}
# RE2 has no look-behind: subsection marks after a full stop are found with the stop kept.
_CUT_SQL = r"string_split(regexp_replace(regexp_replace({0}, '(^|\n)(\([0-9]+\))', chr(1) || '\2', 'g'), '(\.\s)(\([0-9]+\))', '\1' || chr(1) || '\2', 'g'), chr(1))"
SUBSECTION_CTES = {
    **SECTION_CTES,
    "cut": f"SELECT *, {_CUT_SQL.format('raw_text')} AS ps FROM sections",
    "subs": f"""SELECT act_key, seq, generate_subscripts(ps, 1) - 2 AS n, {STRIP.format('unnest(ps)')} AS text FROM cut""",
}
_HEADER = "'[BNSS s.' || s.section_number || ': Section ' || s.section_number || ' | Chapter ' || s.chapter || ': ' || s.chapter_title || ']' || chr(10)"
PACK_CTES = {
    **SUBSECTION_CTES, **{k: v for k, v in BLOCK_CTES.items() if k in ("kinds", "opened", "blocks")},
    "items": """SELECT c.act_key, c.seq, list({'n': length(s.text), 't': s.text, 'id': CASE WHEN s.n >= 0 THEN regexp_extract(s.text, '^(\\([0-9]+\\))', 1) END} ORDER BY s.n) AS its
      FROM cut c JOIN subs s USING (act_key, seq) WHERE s.n >= 0 OR s.text <> '' GROUP BY ALL""",
    "folded": """SELECT *, list_reduce(list_transform(its, lambda i: {'n': i.n, 't': i.t, 'id': i.id, 'out': []::STRUCT(t VARCHAR, id VARCHAR)[]}),
        lambda a, i: CASE WHEN a.n + i.n > 1200 AND a.id IS NOT NULL THEN {'n': i.n, 't': i.t, 'id': i.id, 'out': list_append(a.out, {'t': a.t, 'id': a.id})}
          ELSE {'n': a.n + i.n, 't': a.t || chr(10) || chr(10) || i.t, 'id': i.id, 'out': a.out} END) AS f FROM items""",
    "chunks": f"""SELECT s.*, CASE WHEN length(s.raw_text) <= 1200 OR len(c.ps) = 1 THEN [{{'t': s.raw_text, 'id': NULL::VARCHAR}}]
        ELSE list_transform(list_append(f.f.out, {{'t': f.f.t, 'id': f.f.id}}), lambda x: {{'t': {_HEADER} || x.t, 'id': x.id}}) END AS ch
      FROM sections s JOIN cut c USING (act_key, seq) LEFT JOIN folded f USING (act_key, seq)""",
    "flat": "SELECT act_key, seq, section_number, generate_subscripts(ch, 1) AS part, unnest(ch) AS c FROM chunks",
    "flags2": "SELECT act_key, seq, bool_or(kind = 'proviso') AS p, bool_or(kind = 'explanation') AS e FROM blocks GROUP BY ALL",
}
_TRIM_BUF = STRIP.format("{}")
USER_CTES = {
    "paras": f"""SELECT source, doc_id, list_filter(list_transform(regexp_split_to_array({STRIP.format("replace(text, chr(10), chr(10) || chr(10))")}, '\\n\\s*\\n+'),
        lambda p: {STRIP.format('p')}), lambda p: p <> '') AS ps FROM documents""",
    "seeds": "SELECT source, doc_id, list_prepend({'buf': '', 'p': '', 'out': []::VARCHAR[]}, list_transform(ps, lambda p: {'buf': '', 'p': p, 'out': []::VARCHAR[]})) AS l FROM paras",
    "folds": f"""SELECT source, doc_id, list_reduce(l, lambda a, i: CASE
        WHEN length(a.buf) + length(i.p) + 1 <= 900 THEN {{'buf': {STRIP.format("a.buf || chr(10) || chr(10) || i.p")}, 'p': '', 'out': a.out}}
        WHEN a.buf <> '' THEN {{'buf': {STRIP.format("(CASE WHEN length(a.buf) > 100 THEN right(a.buf, 100) ELSE '' END) || chr(10) || i.p")}, 'p': '', 'out': list_append(a.out, a.buf)}}
        ELSE {{'buf': '', 'p': '', 'out': list_concat(a.out, list_filter(list_transform(range(0, length(i.p), 800), lambda k: {STRIP.format("substr(i.p, k + 1, 900)")}), lambda c: c <> ''))}} END) AS f FROM seeds""",
    "texts": "SELECT source, doc_id, CASE WHEN f.buf <> '' THEN list_append(f.out, f.buf) ELSE f.out END AS cs FROM folds",
    "rows": "SELECT source, doc_id, generate_subscripts(cs, 1) AS i, unnest(cs) AS text FROM texts",
    "idx": "SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, i)::INT AS chunk_index FROM rows",
}
_SCHED_TAILS = "[' Imprisonment for 3 years. Cognizable Bailable Any Magistrate', ' Death, Non-cognizable. Non-bailable High Court', ' Fine.', ' Same as for the offence. Magistrate of the first class.']"
_ROW = r"'^(\d+(?:\s*\(\s*[0-9a-zA-Z]+\s*\))*)\s+(.*)$'"
_PEN = r"\b(?:Imprisonment|Death|Rigorous|Simple|Fine|Same\s+as)\b"
SCHEDULE_CTES = {
    "lines": LINES_SQL,
    "sl": f"""SELECT act_key, page, line_no, {STRIP.format('t')} AS text FROM (SELECT *, CASE WHEN (page + line_no) % 4 = 0 THEN ((page + line_no) % 400 + 1) || ' ( 2 ) ' || raw || {_SCHED_TAILS}[1]
        WHEN (page + line_no) % 9 = 1 THEN 'Section Offence ' || raw ELSE raw || {_SCHED_TAILS}[(page + line_no) % 4 + 1] END AS t FROM lines)""",
    "st": rf"""SELECT *, regexp_replace(regexp_extract(text, {_ROW}, 1), '\s+', '', 'g') AS num, regexp_extract(text, {_ROW}, 2) AS rest FROM sl
        WHERE NOT {_is_boiler('text')} AND NOT starts_with(text, 'Section Offence') AND NOT starts_with(text, '12 3 4 5 6')
        AND NOT (contains(text, 'THE FIRST SCHEDULE') OR contains(text, 'CLASSIFICATION OF OFFENCES') OR contains(text, 'EXPLANATORY NOTES'))""",
    "sg": r"SELECT *, coalesce(TRY_CAST(regexp_extract(num, '^\d+') AS INT) BETWEEN 1 AND 356, false) AS start FROM st",
    "ss": "SELECT *, sum(start::INT) OVER (PARTITION BY act_key ORDER BY page, line_no ROWS UNBOUNDED PRECEDING) AS seq FROM sg",
    "se": f"""SELECT act_key, seq::BIGINT AS seq, max(num) FILTER (start) AS section_number, max(page) FILTER (start) AS page,
        {STRIP.format("string_agg(CASE WHEN start THEN rest ELSE text END, ' ' ORDER BY page, line_no)")} AS full_text FROM ss WHERE seq > 0 GROUP BY act_key, seq""",
    "entries": rf"""SELECT *, CASE WHEN pen THEN trim({STRIP.format('fore')}, ' .—,') ELSE trim(left(full_text, 60), ' .—,') END AS offence_name,
        CASE WHEN pen THEN trim(substr(full_text, length(fore) + 1), ' .—,') ELSE full_text END AS punishment,
        CASE WHEN regexp_matches(full_text, '(?i)\bNon-cognizable\b') THEN 'Non-cognizable' WHEN regexp_matches(full_text, '(?i)\bCognizable\b') THEN 'Cognizable' ELSE 'According as offence is cognizable or non-cognizable' END AS cognizable_status,
        CASE WHEN regexp_matches(full_text, '(?i)\bNon-bailable\b') THEN 'Non-bailable' WHEN regexp_matches(full_text, '(?i)\bBailable\b') THEN 'Bailable' ELSE 'According as offence is bailable or non-bailable' END AS bailable_status,
        coalesce({', '.join(f"nullif(trim(regexp_extract(full_text, '(?i){c}'), ' .'), '')" for c in COURTS)}, 'Court of Session') AS triable_court
      FROM (SELECT *, regexp_extract(full_text, '(?s)^(.*?){_PEN}', 1) AS fore, regexp_matches(full_text, '{_PEN}') AND {STRIP.format(f"regexp_extract(full_text, '(?s)^(.*?){_PEN}', 1)")} <> '' AS pen FROM se WHERE full_text <> '')""",
}
_SECTION_NUM = r"coalesce(nullif(regexp_extract(text, '^(|.*?\.\s)(\d+)\.\s*[A-Z(].*$', 2), ''), regexp_extract(text, '^(\d+)\.[A-Za-z].*$', 1))"

SQL = {
    "line_sessions": _with(SECTION_CTES) + " SELECT act_key, seq, section_number, chapter, chapter_title, page_start, page_end, n_lines, md5(raw_text) AS text_md5 FROM sections",
    "chapter_rollup": _with(SECTION_CTES) + """ SELECT act_key, chapter, arg_min(chapter_title, seq) AS chapter_title, arg_min(page_start, seq) AS page_start, arg_max(page_end, seq) AS page_end,
      count(*) AS n_sections, arg_min(section_number, seq) AS first_section, arg_max(section_number, seq) AS last_section FROM sections GROUP BY ALL""",
    "attached_blocks": _with(BLOCK_CTES) + """ SELECT act_key, seq, (row_number() OVER (PARTITION BY act_key, seq ORDER BY block) - 1)::INT AS n, kind, md5(text) AS text_md5
      FROM blocks WHERE kind <> 'subsection'""",
    "subsections": _with(SUBSECTION_CTES) + r""" SELECT act_key, seq, n::INT AS n, regexp_extract(text, '^(\([0-9]+\))', 1) AS subsection_id,
      len(list_filter(string_split(regexp_replace(text, '(^|\n)(\([a-z]+\))', chr(1) || '\2', 'g'), chr(1)), lambda c: regexp_matches(c, '^\([a-z]+\)'))) AS n_clauses,
      md5(text) AS text_md5 FROM subs WHERE n >= 0""",
    "pack_chunks": _with(PACK_CTES) + """ SELECT act_key, seq, part::INT AS part, 'bnss-s' || section_number || '-' || lpad(part::VARCHAR, 3, '0') AS chunk_id, c.id AS subsection,
      length(c.t) AS n_chars, md5(c.t) AS text_md5, coalesce(p, false) AS has_proviso, coalesce(e, false) AS has_explanation FROM flat LEFT JOIN flags2 USING (act_key, seq)""",
    "user_chunks": _with(USER_CTES) + r""" SELECT source AS document_id, doc_id AS page_start, chunk_index, source || '_p' || doc_id || '_c' || chunk_index AS chunk_id,
      length(text) AS n_chars, md5(text) AS text_md5, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS token_count FROM idx""",
    "clean_whitespace": r"""SELECT doc_id, md5(""" + STRIP.format(r"regexp_replace(regexp_replace(regexp_replace(m, '[ \t]+\n', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')") + r""") AS text_md5
FROM (SELECT doc_id, '  ' || regexp_replace(text, ' ([aeiou])', ' ' || chr(9) || '  \1', 'g') || ' ' || chr(10) || chr(10) || chr(10) || chr(10) || ' end ' AS m FROM documents)""",
    "strip_boilerplate": _with({"lines": LINES_SQL}) + f""" SELECT page, line_no, md5(rtrim(text)) AS text_md5 FROM (
  SELECT page, line_no, CASE WHEN (page + line_no) % 6 = 0 THEN ((page + line_no) % 1500)::VARCHAR
    WHEN (page + line_no) % 3 = 0 THEN ['THE GAZETTE OF INDIA EXTRAORDINARY ', 'Sec. 1] ', '___________ ', 'CG-DL-E-', '———', ' ', ' '][(page + line_no) % 7 + 1] || raw
    ELSE raw END AS text FROM lines) WHERE NOT {_is_boiler('text')}""",
    "token_estimate": r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS n_tokens FROM documents",
    "chunk_ids": """WITH h AS (SELECT o_orderkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('corpus://chunk/bns-s' || o_orderkey)) AS h FROM orders)
SELECT o_orderkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][('0x' || h[17])::INT % 4 + 1] || h[18:20] || '-' || h[21:32] AS point_id FROM h""",
    "slugify": r"""WITH t AS (SELECT p_partkey, string_split(regexp_replace('THE ' || upper(p_name) || ' for Bail-BOND of ' || p_brand, '[^A-Za-z0-9_\s-]', '', 'g'), ' ') AS ws FROM part),
s AS (SELECT p_partkey, array_to_string(list_transform(ws, lambda w, i: array_to_string(list_transform(string_split(w, '-'), lambda p, j:
  CASE WHEN (i = 1 AND j = 1) OR NOT list_contains(['a','an','and','as','at','before','by','for','in','of','on','or','the','to','under','with','after'], lower(p))
  THEN upper(p[1]) || lower(p[2:]) ELSE lower(p) END), '-')), '-') AS slug FROM t)
SELECT p_partkey, slug, 'FORM-' || p_partkey || '_' || slug || '.pdf' AS filename FROM s""",
    "normalize_titles": r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(r), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS key, """ + _note_sql("r") + r""" AS title
FROM (SELECT p_partkey, p_name || '. ' || p_brand || ' 2 of 1974. ' || p_size AS r FROM part)""",
    "layout_columns": _with(_SPLIT_CTES) + " SELECT page, element, is_margin, x, y FROM placed",
    "page_lines": _with(_SPLIT_CTES) + """ SELECT act_key, page, round_even(y / 2.0, 0)::DOUBLE * 2.0 AS y_line, md5(trim(string_agg(text, ' ' ORDER BY x, element))) AS text_md5
      FROM placed WHERE NOT is_margin GROUP BY ALL""",
    "gap_clusters": _with(_CLUSTER_CTES) + " SELECT act_key, page, cluster::INT AS cluster, y_top, y_bottom, md5(title) AS title_md5 FROM clusters",
    "schedule_fields": _with(SCHEDULE_CTES) + " SELECT act_key, seq, section_number, page, md5(offence_name) AS offence_md5, md5(punishment) AS punishment_md5, cognizable_status, bailable_status, triable_court FROM entries",
    "schedule_chunks": _with(SCHEDULE_CTES) + r""" SELECT act_key, seq, 'bns-sched1-s' || lower(regexp_replace(section_number, '[^0-9a-zA-Z]', '', 'g')) || '-' ||
        CASE WHEN k >= 1000 THEN k::VARCHAR ELSE lpad(k::VARCHAR, 3, '0') END AS chunk_id,
      md5('Bharatiya Nyaya Sanhita, 2023 (BNS) Section ' || section_number || chr(10) || 'Offence: ' || offence_name || chr(10) || 'Punishment: ' || punishment || chr(10) ||
        'Classification: ' || cognizable_status || ' | ' || bailable_status || chr(10) || 'Triable by: ' || triable_court) AS text_md5
      FROM (SELECT *, row_number() OVER (PARTITION BY act_key, section_number ORDER BY page, seq) AS k FROM entries)""",
    "html_blocks": rf"""SELECT page_id, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM (
  SELECT page_id, {STRIP.format('line')} AS line FROM (SELECT page_id, unnest(string_split(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]*>', chr(10), 'g'), chr(10))) AS line FROM pages))
WHERE line <> '' AND NOT {_is_boiler('line')} GROUP BY page_id""",
}
