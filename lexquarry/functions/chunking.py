"""Folds that pack text into chunks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lexquarry.functions.text import strip

_ALL = 2147483647


def pack_subsections(lead_in: Column, subs: Column, max_chars: int) -> Column:
    """Array of (subsection, text): subsections packed in order until the next one would not fit.

    ``subs`` holds structs with ``subsection_id`` and ``text``.  The text
    before the first subsection opens the first chunk and is counted in it.
    """
    zero = F.struct(
        F.when(lead_in != "", F.array(lead_in)).otherwise(F.array().cast("array<string>")).alias("parts"),
        F.length(lead_in).alias("size"), F.lit(None).cast("string").alias("last"),
        F.array().cast("array<struct<subsection:string,text:string>>").alias("out"))

    def done(acc: Column) -> Column:
        return F.concat(acc["out"], F.array(F.struct(
            acc["last"].alias("subsection"), F.array_join(acc["parts"], "\n\n").alias("text"))))

    def step(acc: Column, s: Column) -> Column:
        n = F.length(s["text"])
        full = (acc["size"] + n > max_chars) & acc["last"].isNotNull()
        return F.struct(
            F.when(full, F.array(s["text"])).otherwise(F.concat(acc["parts"], F.array(s["text"]))).alias("parts"),
            F.when(full, n).otherwise(acc["size"] + n).alias("size"), s["subsection_id"].alias("last"),
            F.when(full, done(acc)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(subs, zero, step, lambda acc: F.when(acc["last"].isNull(), acc["out"]).otherwise(done(acc)))


def paragraphs(page_text: Column) -> Column:
    """Stripped paragraphs between blank lines."""
    parts = F.transform(F.split(strip(page_text), r"\n\s*\n+", -1), strip)
    return F.filter(parts, lambda p: p != "")


def pack_paragraphs(page_text: Column, target: int = 1800, overlap: int = 200, min_chars: int = 1) -> Column:
    """Array of chunk texts of one page.

    Paragraphs are joined while they fit.  On overflow the buffer is emitted and
    its last ``overlap`` characters open the next one, whatever its size; only a
    long paragraph that meets an empty buffer is cut into overlapping slices.
    """
    zero = F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("out"))

    def slices(p: Column) -> Column:
        starts = F.sequence(F.lit(0), F.length(p) - 1, F.lit(target - overlap))
        cut = F.transform(starts, lambda i: strip(F.substring(p, i + 1, F.lit(target))))
        return F.filter(cut, lambda c: c != "")

    def step(acc: Column, p: Column) -> Column:
        buf = acc["buf"]
        fits = F.length(buf) + F.length(p) + 1 <= target
        held = buf != ""
        tail = F.when(F.length(buf) > overlap, F.right(buf, F.lit(overlap))).otherwise(F.lit(""))
        return F.struct(
            F.when(fits, strip(F.concat(buf, F.lit("\n\n"), p)))
            .when(held, strip(F.concat(tail, F.lit("\n"), p))).otherwise(F.lit("")).alias("buf"),
            F.when(fits, acc["out"]).when(held, F.concat(acc["out"], F.array(buf)))
            .otherwise(F.concat(acc["out"], slices(p))).alias("out"))

    return F.aggregate(paragraphs(page_text), zero, step, lambda acc: F.when(
        (acc["buf"] != "") & (F.length(acc["buf"]) >= min_chars), F.concat(acc["out"], F.array(acc["buf"]))
    ).otherwise(acc["out"]))


def embedding_text(chunk_type: str = "chunk_type") -> Column:
    """Text a passage is embedded and indexed with, from the passage columns."""
    def c(name: str) -> Column:
        return F.col(name)

    def default(name: str, value: str | Column) -> Column:
        filled = F.when(F.coalesce(c(name), F.lit("")) != "", c(name))
        return F.coalesce(filled, F.lit(value) if isinstance(value, str) else value)

    schedule = F.concat(
        F.lit("["), c("act_short"), F.lit("] The First Schedule - Classification of Offences | Section "),
        c("section_number"), F.lit(": "), c("section_title"),
        F.lit("\nOffence: "), default("offence_name", c("section_title")),
        F.lit("\nPunishment: "), default("punishment", "As provided in Sanhita"),
        F.lit("\nClassification: "), default("cognizable_status", "Cognizable"),
        F.lit(" | "), default("bailable_status", "Non-bailable"),
        F.lit("\nTriable by: "), default("triable_court", "Court of Session"))
    header = F.concat(
        F.lit("["), c("act_short"), F.lit("] Chapter "), default("chapter", "I"), F.lit(": "),
        default("chapter_title", "PRELIMINARY"), F.lit(" | Section "), c("section_number"), F.lit(": "),
        c("section_title"))
    headed = F.startswith(c("text"), F.concat(F.lit("["), c("act_short"), F.lit(" s."), c("section_number"), F.lit(":")))
    return (
        F.when(c(chunk_type) == "schedule_entry", schedule).when(headed, c("text"))
        .otherwise(F.concat(header, F.lit("\n"), c("text")))
    )
