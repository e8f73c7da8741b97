"""Rows of the schedule of offences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexquarry.functions.binding import computed
from lexquarry.functions.text import is_boilerplate, strip, strip_chars
from lexquarry.operators.scans import running
from lexquarry.operators.structure import in_range

ROW = r"^(\d+(?:\s*\(\s*[0-9a-zA-Z]+\s*\))*)\s+(.*)$"
# Table heads of the schedule.
HEADS_AT_START = ["Section Offence", "12 3 4 5 6"]
HEADS_ANYWHERE = [
    "THE FIRST SCHEDULE", "CLASSIFICATION OF OFFENCES", "EXPLANATORY NOTES",
    "I.—OFFENCES UNDER THE BHARATIYA NYAYA SANHITA",
]
# Courts in the order they are looked for; the first of the list that occurs wins.
COURTS = [
    "Court of Session", "Magistrate of the first class", "Magistrate of the second class", "Chief Judicial Magistrate",
    "Any Magistrate", "High Court", "Court by which offence abetted is triable", "Court by which offence is triable",
]
# a capital is looked for before the word boundary, which costs more
PENALTY = r"(?=[IDRSF])\b(?:Imprisonment|Death|Rigorous|Simple|Fine|Same\s+as)\b"
_MARKS = " .—,"


def is_table_head(line: Column) -> Column:
    out = is_boilerplate(line)
    for head in HEADS_AT_START:
        out = out | line.startswith(head)
    for head in HEADS_ANYWHERE:
        out = out | line.contains(head)
    return out


def before_penalty(text: Column) -> Column:
    """Text before the first word of a penalty; empty without one."""
    return F.regexp_extract(text, rf"(?s)^(.*?){PENALTY}", 1)


def offence_fields(text: Column, low: Column, before: Column) -> dict[str, Column]:
    """Offence, punishment, classification and court of one row's text.

    ``low`` is the text in lower case, ``before`` its ``before_penalty``.
    """
    def has(word: str) -> Column:
        return low.contains(word) & low.rlike(rf"\b{word}\b")

    court = F.lit("Court of Session")
    for name in reversed(COURTS):
        at = F.locate(name.lower(), low)
        court = F.when(low.contains(name.lower()), strip_chars(F.substring(text, at, F.lit(len(name))), " .")).otherwise(court)
    has_penalty = strip(before) != ""
    return {
        "offence_name": strip_chars(F.when(has_penalty, strip(before)).otherwise(F.substring(text, 1, 60)), _MARKS),
        "punishment": F.when(has_penalty, strip_chars(F.substring(text, F.length(before) + 1, F.length(text)), _MARKS))
        .otherwise(text),
        "cognizable_status": F.when(has("non-cognizable"), "Non-cognizable")
        .when(has("cognizable"), "Cognizable")
        .otherwise("According as offence is cognizable or non-cognizable"),
        "bailable_status": F.when(has("non-bailable"), "Non-bailable")
        .when(has("bailable"), "Bailable")
        .otherwise("According as offence is bailable or non-bailable"),
        "triable_court": court,
    }


def schedule_entries(lines: DataFrame, group: list[str], max_section: int = 356) -> DataFrame:
    """One row per schedule entry; a row starts at a section number from 1 to ``max_section``."""
    rows = computed(lines, text=strip(F.col("text"))).where((F.col("text") != "") & ~is_table_head(F.col("text")))
    # few lines begin with a digit
    number = F.when(F.substring("text", 1, 1).between("0", "9"), F.regexp_replace(F.regexp_extract("text", ROW, 1), r"\s+", "")).otherwise("")
    rows = computed(computed(rows, _number=number), _start=in_range(F.regexp_extract("_number", r"^\d+", 0), max_section))
    rows = rows.withColumn("_piece", F.when(F.col("_start"), F.regexp_extract("text", ROW, 2)).otherwise(F.col("text"))).drop("text")
    # told by line, so that who counts entries moves no text
    rows = rows.withColumn("_filled", strip(F.col("_piece")) != "")
    rows = running(rows, group, "page", ["line_no"], sums={"seq": F.col("_start").cast("int")}).where(F.col("seq") > 0)
    entries = rows.groupBy(*group, "seq").agg(
        F.max(F.when(F.col("_start"), F.col("_number"))).alias("section_number"),
        F.max(F.when(F.col("_start"), F.col("page"))).alias("page"),
        strip(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "line_no", "_piece"))),
                                       lambda x: x["_piece"]), " ")).alias("full_text"), F.bool_or("_filled").alias("_filled"),
    ).where("_filled").drop("_filled")
    entries = entries.withColumns({"_low": F.lower("full_text"), "_before": before_penalty(F.col("full_text"))})
    fields = offence_fields(F.col("full_text"), F.col("_low"), F.col("_before"))
    return entries.withColumns(fields).drop("_low", "_before").withColumn(
        "raw_text", F.concat(F.lit("BNS Section "), F.col("section_number"), F.lit(": "), F.col("full_text")))
