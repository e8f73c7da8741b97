"""Stand-ins for the engine's inputs, derived from the test tables.

The statute corpus is not available, so its tables are computed from the test
tables: each stand-in exists twice, as a DataFrame and as SQL for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexquarry.plans.retrieval import PASSAGE_COLUMNS
from lexquarry.sources.tables import table

PENAL_TITLE = "Bharatiya Nyaya Sanhita, 2023"
PROCEDURE_TITLE = "Bharatiya Nagarik Suraksha Sanhita, 2023"


def _s(c: Column) -> Column:
    return c.cast("string")


def passages(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as one passage, with act, section and pages made from its id."""
    d = F.col("doc_id")
    number = _s(d * 7 % 531 + 1)
    sub = F.concat(F.lit("("), _s(d % 3 + 1), F.lit(")"))
    return table(spark, folder, "documents").select(
        "doc_id", F.concat(F.lit("d"), F.lpad(_s(d), 10, "0")).alias("chunk_id"),
        F.when(d % 2 == 0, PENAL_TITLE).otherwise(PROCEDURE_TITLE).alias("act"),
        F.when(d % 2 == 0, "BNS").otherwise("BNSS").alias("act_short"),
        _s(d % 39 + 1).alias("chapter"), F.concat(F.lit("Of "), F.col("source")).alias("chapter_title"),
        F.when(d % 5 == 0, F.concat(number, sub)).otherwise(number).alias("section_number"),
        F.array_join(F.slice(F.split("text", " ", -1), 1, 4), " ").alias("section_title"),
        F.when(d % 4 == 0, sub).alias("subsection"), F.lit(None).cast("string").alias("clause"),
        F.when(d % 7 == 0, "schedule_entry").otherwise("substantive_section").alias("chunk_type"),
        "text", (d % 200 + 1).cast("int").alias("page_start"), (d % 200 + 1 + d % 3).cast("int").alias("page_end"),
        F.col("text").alias("index_text"), "lang", "source")


PASSAGES_SQL = f"""
SELECT doc_id, 'd' || lpad(doc_id::VARCHAR, 10, '0') AS chunk_id,
  CASE WHEN doc_id % 2 = 0 THEN '{PENAL_TITLE}' ELSE '{PROCEDURE_TITLE}' END AS act,
  CASE WHEN doc_id % 2 = 0 THEN 'BNS' ELSE 'BNSS' END AS act_short,
  (doc_id % 39 + 1)::VARCHAR AS chapter, 'Of ' || source AS chapter_title,
  CASE WHEN doc_id % 5 = 0 THEN (doc_id * 7 % 531 + 1) || '(' || (doc_id % 3 + 1) || ')'
       ELSE (doc_id * 7 % 531 + 1)::VARCHAR END AS section_number,
  array_to_string(list_slice(string_split(text, ' '), 1, 4), ' ') AS section_title,
  CASE WHEN doc_id % 4 = 0 THEN '(' || (doc_id % 3 + 1) || ')' END AS subsection,
  CASE WHEN doc_id % 7 = 0 THEN 'schedule_entry' ELSE 'substantive_section' END AS chunk_type,
  text, (doc_id % 200 + 1)::INT AS page_start, (doc_id % 200 + 1 + doc_id % 3)::INT AS page_end,
  lang, source
FROM documents"""


def known_items(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark texts as queries; the vector with the item's number stands in for the query's."""
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text")).join(vectors, "query_id", "left")


def passage_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vector number n stands in for the vector of document n."""
    return table(spark, folder, "embeddings").select(
        F.concat(F.lit("d"), F.lpad(_s(F.col("vec_id")), 10, "0")).alias("chunk_id"), "embedding", "label",
        F.col("vec_id").alias("doc_id"))


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """User turns as questions; five of six are reworded as section questions."""
    c = table(spark, folder, "conversations").where(F.col("role") == "user")
    n = _s(F.col("conv_id") * 11 % 600 + 1)
    act = F.when(F.col("conv_id") % 2 == 0, "BNS").otherwise("BNSS")
    sub = _s(F.col("turn") % 3 + 1)
    case = (F.col("conv_id") + F.col("turn")) % 6
    text = (
        F.when(case == 0, F.concat(F.lit("What is section "), n, F.lit(" "), act, F.lit("?")))
        .when(case == 1, F.concat(F.lit("Explain Section "), n, F.lit("("), sub, F.lit(")")))
        .when(case == 2, F.concat(F.lit("s. "), n))
        .when(case == 3, F.concat(F.lit("Compare section "), n, F.lit(" and section 5")))
        .when(case == 4, F.concat(act, F.lit(" s."), n, F.lit("("), sub, F.lit(") of the notice")))
        .otherwise(F.col("text"))
    )
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), text.alias("query_text"))


TURNS_SQL = """
SELECT conv_id * 1000 + turn AS query_id,
  CASE (conv_id + turn) % 6
    WHEN 0 THEN 'What is section ' || (conv_id * 11 % 600 + 1) || ' ' || act || '?'
    WHEN 1 THEN 'Explain Section ' || (conv_id * 11 % 600 + 1) || '(' || (turn % 3 + 1) || ')'
    WHEN 2 THEN 's. ' || (conv_id * 11 % 600 + 1)
    WHEN 3 THEN 'Compare section ' || (conv_id * 11 % 600 + 1) || ' and section 5'
    WHEN 4 THEN act || ' s.' || (conv_id * 11 % 600 + 1) || '(' || (turn % 3 + 1) || ') of the notice'
    ELSE text END AS query_text
FROM (SELECT *, CASE WHEN conv_id % 2 = 0 THEN 'BNS' ELSE 'BNSS' END AS act
      FROM conversations WHERE role = 'user')"""

INTENT_SQL = r"""
SELECT query_id, query_text,
  CASE WHEN ok THEN num END AS section_number, CASE WHEN ok AND sub <> '' THEN '(' || sub || ')' END AS subsection,
  CASE WHEN NOT ok OR named = '' THEN NULL WHEN named LIKE '%NAGARIK%' OR named = 'BNSS' THEN 'BNSS' ELSE 'BNS' END AS act_short
FROM (SELECT *, num <> '' AND words <= 15 AND NOT rejected AS ok FROM (
  SELECT query_id, query_text,
    regexp_extract(q, '(?i)(?:section|sec\.?|s\.)\s*([0-9]+[a-z]?)(?:\s*\(([0-9]+[a-z]?)\))?', 1) AS num,
    regexp_extract(q, '(?i)(?:section|sec\.?|s\.)\s*([0-9]+[a-z]?)(?:\s*\(([0-9]+[a-z]?)\))?', 2) AS sub,
    upper(regexp_extract(q, '(?i)\b(BNS|BNSS|Bharatiya\s+Nyaya\s+Sanhita|Bharatiya\s+Nagarik\s+Suraksha\s+Sanhita)\b', 1)) AS named,
    len(list_filter(regexp_split_to_array(q, '\s+'), lambda w: w <> '')) AS words,
    regexp_matches(q, '(?i)\b(?:difference\s+between|compare|distinction\s+between)\b')
      OR regexp_matches(q, '(?i)(?:section|sec\.?|s\.)\s*[0-9]+\s+(?:and|vs\.?|versus|or)\s+(?:section|sec\.?|s\.)\s*[0-9]+')
      OR regexp_matches(q, '(?i)\bhow\s+many\s+sections\b') AS rejected
  FROM (SELECT *, regexp_replace(query_text, '^\s+|\s+$', '', 'g') AS q FROM turns)))"""

__all__ = [
    "INTENT_SQL", "PASSAGES_SQL", "PASSAGE_COLUMNS", "TURNS_SQL", "known_items", "passage_vectors", "passages",
    "table", "turns",
]
