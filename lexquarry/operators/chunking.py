"""Passages out of sections, schedule rows and uploaded pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexquarry.functions.chunking import pack_paragraphs, pack_subsections
from lexquarry.functions.ids import occurrence_id
from lexquarry.functions.text import token_estimate
from lexquarry.operators.scans import occurrence, running
from lexquarry.operators.structure import attached_blocks, lead_in, subsections

FLAGS = {"has_illustration": "illustration", "has_proviso": "proviso", "has_exception": "exception",
         "has_explanation": "explanation"}


def chunk_sections(sections: DataFrame, group: list[str], max_chars: int = 3200) -> DataFrame:
    """Passages: a section whole, or packed by subsections when it is long and has some."""
    s = sections.withColumn("_kinds", F.transform(attached_blocks(F.col("lines")), lambda b: b["kind"]))
    s = s.withColumn("_subs", subsections(F.col("raw_text")))
    s = s.withColumns({flag: F.array_contains("_kinds", kind) for flag, kind in FLAGS.items()})
    whole = (F.length("raw_text") <= max_chars) | (F.size("_subs") == 0)
    header = F.concat(
        F.lit("["), F.col("act_short"), F.lit(" s."), F.col("section_number"), F.lit(": "), F.col("section_title"),
        F.lit(" | Chapter "), F.col("chapter"), F.lit(": "), F.col("chapter_title"), F.lit("]\n"))
    packed = F.transform(pack_subsections(lead_in(F.col("raw_text")), F.col("_subs"), max_chars), lambda p: F.struct(
        p["subsection"].alias("subsection"), F.concat(header, p["text"]).alias("text")))
    one = F.array(F.struct(F.lit(None).cast("string").alias("subsection"), F.col("raw_text").alias("text")))
    parts = s.select("*", F.posexplode(F.when(whole, one).otherwise(packed)).alias("_i", "_part"))
    prefix = F.concat(F.lower(F.trim("act_short")), F.lit("-s"), F.col("section_number"))
    return parts.select(
        *group, "act", "act_short", "chapter", "chapter_title", "section_number", "section_title",
        F.col("_part.subsection").alias("subsection"), F.lit(None).cast("string").alias("clause"),
        F.lit("substantive_section").alias("chunk_type"), F.col("_part.text").alias("text"), *FLAGS,
        "page_start", "page_end", occurrence_id(prefix, F.col("_i") + 1).alias("chunk_id"), "seq",
        (F.col("_i") + 1).alias("part"))


def chunk_schedule(entries: DataFrame, group: list[str], act: str, act_short: str) -> DataFrame:
    """Schedule rows as passages; a section listed several times gets running ids."""
    numbered = occurrence(entries, [*group, "section_number"], "page", ["seq"], "_n")
    slug = F.lower(F.regexp_replace("section_number", "[^0-9a-zA-Z]", ""))
    text = F.concat(
        F.lit(f"{act} ({act_short}) Section "), F.col("section_number"), F.lit("\nOffence: "), F.col("offence_name"),
        F.lit("\nPunishment: "), F.col("punishment"), F.lit("\nClassification: "), F.col("cognizable_status"),
        F.lit(" | "), F.col("bailable_status"), F.lit("\nTriable by: "), F.col("triable_court"))
    prefix = F.concat(F.lit(f"{act_short.lower()}-sched1-s"), slug)
    return numbered.select(
        *group, F.lit(act).alias("act"), F.lit(act_short).alias("act_short"), F.lit("SCHEDULE_I").alias("chapter"),
        F.lit("THE FIRST SCHEDULE - CLASSIFICATION OF OFFENCES").alias("chapter_title"), "section_number",
        F.col("offence_name").alias("section_title"), F.lit(None).cast("string").alias("subsection"),
        F.lit(None).cast("string").alias("clause"), F.lit("schedule_entry").alias("chunk_type"), text.alias("text"),
        *[F.lit(False).alias(flag) for flag in FLAGS], F.col("page").alias("page_start"),
        F.col("page").alias("page_end"), occurrence_id(prefix, F.col("_n")).alias("chunk_id"), "seq",
        F.lit(1).alias("part"), "offence_name", "punishment", "cognizable_status", "bailable_status", "triable_court")


def all_passages(substantive: DataFrame, schedule: DataFrame) -> DataFrame:
    return substantive.unionByName(schedule, allowMissingColumns=True)


def chunk_pages(
    pages: DataFrame, target: int = 1800, overlap: int = 200, min_chars: int = 1, block_pages: int = 4096,
) -> DataFrame:
    """Chunks of uploaded documents; the index runs on across a document's pages.

    ``pages``: document_id, page_number, text and any columns to carry along.
    Only the chunk counts per page are scanned per document.
    """
    packed = pages.withColumn("_chunks", pack_paragraphs(F.col("text"), target, overlap, min_chars)).drop("text")
    packed = packed.withColumn("_block", F.floor(F.col("page_number") / block_pages))
    counted = running(packed, ["document_id"], "_block", ["page_number"], sums={"_last": F.size("_chunks")})
    first = F.col("_last") - F.size("_chunks")
    out = counted.select("*", first.alias("_first"), F.posexplode("_chunks").alias("_i", "text"))
    index = (F.col("_first") + F.col("_i") + 1).cast("int")
    return out.withColumns({
        "chunk_index": index,
        "chunk_id": F.concat(F.col("document_id"), F.lit("_p"), F.col("page_number").cast("string"), F.lit("_c"),
                             index.cast("string")),
        "page_start": F.col("page_number"), "page_end": F.col("page_number"),
        "token_count": token_estimate(F.col("text")),
    }).drop("_chunks", "_block", "_last", "_first", "_i", "page_number")
