"""Checks of an ingested corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexquarry.functions.text import strip


def missing_numbers(seen: DataFrame, number: str, top: int) -> DataFrame:
    """Numbers from 1 to ``top`` that do not occur."""
    expected = seen.sparkSession.range(1, top + 1).withColumnRenamed("id", number)
    return expected.join(seen.select(F.col(number).cast("long").alias(number)).distinct(), number, "left_anti")


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def short_chunks(chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "text", least: int = 25) -> DataFrame:
    return chunks.where(F.length(strip(F.col(text))) < least).select(chunk_id, F.length(text).alias("n_chars"))


def corpus_totals(sections: DataFrame, chunks: DataFrame, number: str = "section_number") -> DataFrame:
    """One row: chapters, sections, chunks, schedule rows."""
    s = sections.agg(F.count_distinct("chapter").alias("total_chapters"), F.count(number).alias("total_sections"))
    c = chunks.agg(F.count(F.lit(1)).alias("total_chunks"),
                   F.count_if(F.col("chunk_type") == "schedule_entry").alias("total_schedule_entries"))
    return s.select("*", c.select("total_chunks").scalar().alias("total_chunks"),
                    c.select("total_schedule_entries").scalar().alias("total_schedule_entries"))


def _issue(rows: DataFrame, severity: Column | str, code: str, location: Column | str, n: Column | int = 1) -> DataFrame:
    return rows.select(
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.lit(code).alias("code"),
        (F.lit(location) if isinstance(location, str) else location).alias("location"),
        (F.lit(n) if isinstance(n, int) else n).cast("long").alias("n"))


def corpus_issues(
    sections: DataFrame, chunks: DataFrame, total_pages: int, expected_sections: int = 531, few_missing: int = 5,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """(severity, code, location, n) rows: missing and repeated sections, page ranges, repeated ids, thin or dirty chunks.

    ``blocks`` (kind, ...) are the attached blocks found; provisos among them
    that no chunk is flagged for are an error.
    """
    plain = F.col("section_number").rlike(r"^\d+$")
    number = F.col("section_number").try_cast("bigint")
    numbers = sections.where(plain & number.isNotNull()).select("section_number")
    huge = sections.where(plain & number.isNull())
    gaps = missing_numbers(numbers, "section_number", expected_sections).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 0)
    bad_pages = (F.col("page_start") < 1) | (F.col("page_end") > total_pages) | (F.col("page_start") > F.col("page_end"))
    thin = F.length(strip(F.col("text"))) < 25
    parts = [
        _issue(gaps, F.when(F.col("n") <= few_missing, "WARNING").otherwise("ERROR"), "MISSING_SECTIONS", "sections", F.col("n")),
        _issue(duplicates(sections, ["section_number"]), "ERROR", "DUPLICATE_SECTIONS",
               F.concat(F.lit("section_"), F.col("section_number")), F.col("n")),
        _issue(huge, "ERROR", "SECTION_NUMBER_TOO_LARGE", F.concat(F.lit("section_"), F.col("section_number"))),
        _issue(sections.where(bad_pages), "ERROR", "INVALID_PAGE_RANGE", F.concat(F.lit("section_"), F.col("section_number"))),
        _issue(duplicates(chunks, ["chunk_id"]), "ERROR", "DUPLICATE_CHUNK_IDS", F.col("chunk_id"), F.col("n")),
        _issue(chunks.where(thin), "WARNING", "SUSPICIOUS_SHORT_CHUNK", F.col("chunk_id"), F.length("text")),
        _issue(chunks.where(F.contains("text", F.lit("_____"))), "WARNING", "UNFILTERED_BOILERPLATE", F.col("chunk_id")),
    ]
    if blocks is not None:
        flagged = chunks.agg(F.count_if("has_proviso").alias("f")).scalar()
        lost = blocks.agg(F.count_if(F.col("kind") == "proviso").alias("n")).where((F.col("n") > 0) & (flagged == 0))
        parts.append(_issue(lost, "ERROR", "LOST_PROVISO_METADATA", "chunks", F.col("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def assert_no_errors(issues: DataFrame) -> None:
    """Stop an ingest when there is an issue of severity ERROR."""
    first = issues.where(F.col("severity") == "ERROR").limit(5).collect()
    if first:
        raise ValueError("corpus validation failed: " + "; ".join(f"{r['code']} at {r['location']}" for r in first))


def assert_row_count(rows: DataFrame, least: int) -> DataFrame:
    """The rows, once a count has shown that there are at least ``least``."""
    if rows.limit(least).count() < least:
        raise ValueError(f"fewer than {least} rows")
    return rows


def readiness(components: DataFrame, expected_forms: int = 58) -> DataFrame:
    """Overall status and the status of every component.

    ``components``: name, kind (vector_store, forms, embedding, provider), n,
    error.  An empty store or a provider problem only degrades its component.
    """
    failed = F.col("error").isNotNull()
    status = (
        F.when(failed & (F.col("kind") == "provider"), "DEGRADED").when(failed, "UNAVAILABLE")
        .when((F.col("kind") == "vector_store") & (F.col("n") == 0), "DEGRADED")
        .when((F.col("kind") == "forms") & (F.col("n") != expected_forms), "DEGRADED").otherwise("READY")
    )
    fatal = (failed & (F.col("kind") != "provider")) | ((F.col("kind") == "forms") & (F.col("n") != expected_forms))
    judged = components.select("name", status.alias("status"), fatal.alias("_fatal"))
    overall = judged.agg(F.when(F.bool_or("_fatal"), "UNAVAILABLE").otherwise("READY").alias("overall"))
    return judged.select("name", "status", overall.scalar().alias("overall"))


def readable_uploads(pages: DataFrame) -> DataFrame:
    """(document_id, n_pages, n_chars, accepted): a document without any text is refused."""
    return pages.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_pages"), F.sum(F.length(strip(F.col("text")))).alias("n_chars")).withColumn(
        "accepted", F.col("n_chars") > 0)
