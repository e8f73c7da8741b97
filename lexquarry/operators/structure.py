"""Lines to sections, and sections to their parts.

Lines are rows (group columns, page, line_no, text); scans over them run page
by page, so an act with any number of pages stays parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lexquarry.functions.binding import computed, let
from lexquarry.functions.text import strip
from lexquarry.operators.scans import neighbours, running

# Line grammars of a printed act.
CHAPTER = r"(?i)^\s*CHAPTER\s+([IVXLCDM]+)\s*$"
START = r"^(.*?)(?=\d)(?:^|(?<=\.\s))(\d+)\.\s*[A-Z(].*$"
START_ATTACHED = r"^(\d+)\.[A-Za-z].*$"
SUBSECTION = r"^\((\d+)\)\s*"
MARKERS = {
    "proviso": r"(?i)^Provided\s+(?:further\s+|also\s+)?that\b",
    "exception": r"(?i)^Exception(?:\s+\d+)?\s*[.—]",
    "explanation": r"(?i)^Explanation(?:\s+\d+)?\s*[.—]",
    "illustration": r"(?i)^Illustration(?:\s+[a-z]|\s*\([a-z]\))?\s*[.—]",
}
_CUT = "\u0001"


def page_range(pages: DataFrame, first: int, last: int, page: str = "page") -> DataFrame:
    """Pages ``first`` to ``last``, counted from 1."""
    if first < 1 or last < first:
        raise ValueError(f"bad page range {first}..{last}")
    return pages.where(F.col(page).between(first, last))


def single_page(pages: DataFrame, number: int, page: str = "page") -> DataFrame:
    """One page; a number without a page is an error."""
    found = page_range(pages, number, number, page)
    if found.limit(1).count() == 0:
        raise ValueError(f"no page {number}")
    return found


def section_number(line: Column) -> tuple[Column, Column]:
    """(number or '', prefix before it) of a line that starts a section.

    A digit before a full stop is looked for first, which few lines have.
    """
    likely = line.rlike(r"\d\.")
    number = F.when(likely, F.coalesce(
        F.nullif(F.regexp_extract(line, START, 2), F.lit("")), F.regexp_extract(line, START_ATTACHED, 1))).otherwise("")
    return number, F.when(likely, strip(F.regexp_extract(line, START, 1))).otherwise("")


def in_range(number: Column, top: int) -> Column:
    """Digits that name a number from 1 to ``top``; safe for digit runs of any length."""
    return F.coalesce(number.try_cast("int").between(1, top), F.lit(False))


def detect_sections(
    lines: DataFrame,
    group: list[str],
    max_section: int = 531,
    titles: DataFrame | None = None,
    first_chapter: tuple[str, str] = ("I", "PRELIMINARY"),
) -> DataFrame:
    """One row per section: number, title, chapter at its start, pages, lines and text.

    A chapter header takes up to three following lines of its page as title.
    A start after a full stop in mid-line gives the text before it to the
    section before.  ``titles`` (group, page, section_number, section_title)
    names sections; the others are called by number.
    """
    rows = computed(lines, text=strip(F.col("text"))).where(F.col("text") != "")
    rows = computed(rows, _chapter=F.upper(F.regexp_extract("text", CHAPTER, 1)), _likely=F.col("text").rlike(r"\d\."))
    # a match of START has a number, and one of CHAPTER a numeral
    rows = computed(rows, _inside=F.when(F.col("_likely"), F.regexp_extract("text", START, 2)).otherwise(""))
    rows = rows.select(*lines.columns, "_chapter", ((F.col("_chapter") != "") | (F.col("_inside") != "")).alias("_break"),
        F.when(F.col("_inside") != "", F.col("_inside")).when(F.col("_likely"), F.regexp_extract("text", START_ATTACHED, 1)).otherwise("").alias("_number"),
        F.when(F.col("_inside") != "", strip(F.regexp_extract("text", START, 1))).otherwise("").alias("_prefix"))
    near = {f"_t{i}": ("text", i) for i in (1, 2, 3)} | {f"_b{i}": ("_break", i) for i in (1, 2, 3)}
    near |= {f"_c-{i}": ("_chapter", -i) for i in (1, 2, 3)} | {f"_b-{i}": ("_break", -i) for i in (1, 2)}
    rows = neighbours(rows, group, "page", ["line_no"], near)

    ok1 = ~F.coalesce("_b1", F.lit(True))
    ok2 = ok1 & ~F.coalesce("_b2", F.lit(True))
    ok3 = ok2 & ~F.coalesce("_b3", F.lit(True))
    is_chapter = F.col("_chapter") != ""
    title = F.concat_ws(" ", F.when(ok1, F.col("_t1")), F.when(ok2, F.col("_t2")), F.when(ok3, F.col("_t3")))
    after = [F.coalesce(F.col(f"`_c-{i}`") != "", F.lit(False)) for i in (1, 2, 3)]
    plain = ~F.col("_break")
    taken = plain & (
        after[0] | (after[1] & ~F.col("`_b-1`")) | (after[2] & ~F.col("`_b-1`") & ~F.col("`_b-2`")))
    rows = rows.withColumns({
        "_title": F.when(is_chapter & (title != ""), title), "_chapter": F.when(is_chapter, F.col("_chapter")),
        "_content": ~is_chapter & ~taken,
        "_start": ~is_chapter & ~taken & in_range(F.col("_number"), max_section)})

    whole = F.struct(F.lit(1).alias("part"), F.col("text").alias("text"), F.col("_start").alias("start"))
    split = F.array(
        F.struct(F.lit(0).alias("part"), F.col("_prefix").alias("text"), F.lit(False).alias("start")),
        F.struct(F.lit(1).alias("part"), strip(F.expr("substring(text, length(_prefix) + 1)")).alias("text"),
                 F.lit(True).alias("start")))
    rows = rows.withColumn("_piece", F.explode(
        F.when(F.col("_start") & (F.col("_prefix") != ""), split).otherwise(F.array(whole)))).select(
        *group, "page", "line_no", "_content", "_chapter", "_title", "_number", "_piece.*")

    rows = running(rows, group, "page", ["line_no", "part"],
                   sums={"seq": F.col("start").cast("int")},
                   lasts={"chapter": F.col("_chapter"), "chapter_title": F.col("_title")})
    body = rows.where(F.col("_content") & (F.col("seq") > 0))
    at_start = F.col("start")
    sections = body.groupBy(*group, "seq").agg(
        F.max(F.when(at_start, F.col("_number"))).alias("section_number"),
        F.max(F.when(at_start, F.coalesce("chapter", F.lit(first_chapter[0])))).alias("chapter"),
        F.max(F.when(at_start, F.coalesce("chapter_title", F.lit(first_chapter[1])))).alias("chapter_title"),
        F.max(F.when(at_start, F.col("page"))).alias("page_start"),
        F.max(F.when(F.col("part") == 1, F.col("page"))).alias("page_end"),
        F.transform(F.sort_array(F.collect_list(F.struct("page", "line_no", "part", "text"))),
                    lambda x: x["text"]).alias("lines"))
    sections = sections.withColumns({"raw_text": F.array_join("lines", "\n"), "seq": F.col("seq").cast("long")})
    if titles is None:
        return sections.withColumn("section_title", F.concat(F.lit("Section "), F.col("section_number")))
    named = titles.select(*group, F.col("page").alias("page_start"), "section_number", "section_title")
    return sections.join(named, [*group, "page_start", "section_number"], "left").withColumn(
        "section_title", F.coalesce("section_title", F.concat(F.lit("Section "), F.col("section_number"))))


def chapters(sections: DataFrame, group: list[str]) -> DataFrame:
    """Chapter rows: title and first page of its first section, last page of its last.

    The sections stay rows of their own, so a chapter of any size is one small row.
    """
    return sections.groupBy(*group, "chapter").agg(
        F.min_by("chapter_title", "seq").alias("chapter_title"), F.min_by("page_start", "seq").alias("page_start"),
        F.max_by("page_end", "seq").alias("page_end"), F.count(F.lit(1)).alias("n_sections"),
        F.min_by("section_number", "seq").alias("first_section"), F.max_by("section_number", "seq").alias("last_section"))


def attached_blocks(lines: Column) -> Column:
    """Array of (kind, text) for provisos, exceptions, explanations and illustrations.

    A block runs to the next marker or subsection of its section.
    """
    def kind(line: Column) -> Column:
        out = None
        for name, pattern in MARKERS.items():
            test = line.rlike(pattern)
            out = F.when(test, name) if out is None else out.when(test, name)
        return out.when(line.rlike(SUBSECTION), "subsection")

    kinds = F.filter(
        F.transform(lines, lambda line, i: F.struct((i + 1).alias("at"), kind(line).alias("kind"))),
        lambda m: m["kind"].isNotNull())
    blocks = let(kinds, lambda ks: F.transform(ks, lambda m, i: F.struct(
        m["kind"].alias("kind"),
        F.array_join(F.slice(lines, m["at"], F.coalesce(
            F.try_element_at(ks, i + 2)["at"], F.size(lines) + 1) - m["at"]), "\n").alias("text"))))
    return F.filter(blocks, lambda b: b["kind"] != "subsection")


def _cut(text: Column, at: str) -> Column:
    """Pieces of text; every piece but the first starts where ``at`` matched its group 1."""
    return F.transform(F.split(F.regexp_replace(text, at, f"{_CUT}$1"), _CUT, -1), strip)


def lead_in(text: Column) -> Column:
    """Text before the first numbered subsection."""
    return F.element_at(_cut(text, r"(?:^|\n|(?<=\.\s))(\([0-9]+\))"), 1)


def subsections(text: Column) -> Column:
    """Array of (subsection_id, text, clauses) for ``(1)``, ``(2)``, ... and their ``(a)``, ``(b)``, ..."""
    def clauses(sub: Column) -> Column:
        return F.transform(
            F.filter(_cut(sub, r"(?:^|\n)(\([a-z]+\))"), lambda c: c.rlike(r"^\([a-z]+\)")),
            lambda c: F.struct(F.regexp_extract(c, r"^(\([a-z]+\))", 1).alias("clause_id"), c.alias("text")))

    pieces = _cut(text, r"(?:^|\n|(?<=\.\s))(\([0-9]+\))")
    subs = F.filter(pieces, lambda s, i: (i > 0))
    return F.transform(subs, lambda s: F.struct(
        F.regexp_extract(s, r"^(\([0-9]+\))", 1).alias("subsection_id"), s.alias("text"), clauses(s).alias("clauses")))


# --- page layout ------------------------------------------------------------

def split_columns(elements: DataFrame, boilerplate: Column) -> DataFrame:
    """Mark elements as margin or main text and drop headers, footers and boilerplate.

    Margin notes stand left of x=110 on even pages and right of x=475 on odd ones.
    """
    margin = F.when(F.col("page") % 2 == 0, F.col("x") < 110).otherwise(F.col("x") > 475)
    return elements.where(~boilerplate & F.col("y").between(35, 765)).withColumn("is_margin", margin)


def text_lines(elements: DataFrame, group: list[str]) -> DataFrame:
    """Elements joined to lines by height (steps of two points), left to right."""
    height = F.bround(F.col("y") / 2.0) * 2.0
    pieces = F.sort_array(F.collect_list(F.struct("x", "element", "text")))
    return elements.withColumn("y_line", height).groupBy(*group, "page", "y_line").agg(
        F.trim(F.array_join(F.transform(pieces, lambda e: e["text"]), " ")).alias("text"))


def note_clusters(notes: DataFrame, group: list[str], gap: float, clean) -> DataFrame:
    """Margin elements gathered to notes, top to bottom.

    A note ends at a gap wider than ``gap`` or after a full stop.
    """
    w = W.partitionBy(*group, "page").orderBy(F.col("y").desc(), "element")
    step = F.lag("y").over(w) - F.col("y")
    ended = F.lag(F.endswith(strip(F.col("text")), F.lit("."))).over(w)
    new = F.coalesce((step > gap) | (step < 0) | ended, F.lit(True))
    marked = notes.withColumn("_new", new.cast("int")).withColumn("_cluster", F.sum("_new").over(w))
    pieces = F.sort_array(F.collect_list(F.struct((-F.col("y")).alias("k"), "element", "text")))
    joined = F.array_join(F.transform(pieces, lambda e: e["text"]), " ")
    return marked.groupBy(*group, "page", F.col("_cluster").alias("cluster")).agg(
        F.max("y").alias("y_top"), F.min("y").alias("y_bottom"), clean(joined).alias("title"),
    ).where(F.col("title") != "")


def note_titles(
    lines: DataFrame, clusters: DataFrame, group: list[str], max_section: int, tolerance: float,
    first_page: tuple[str, str] | None = None,
) -> DataFrame:
    """(group, page, section_number, section_title): each section takes the nearest free note.

    Sections choose from the top of the page down; a note is used once.  The
    choice is a fold inside one page.  ``first_page`` fixes number and title
    for page 1, whose note stands apart.
    """
    number, _ = section_number(F.col("text"))
    starts = lines.withColumn("section_number", number).where(in_range(F.col("section_number"), max_section))
    by_page = starts.groupBy(*group, "page").agg(F.sort_array(F.collect_list(
        F.struct((-F.col("y_line")).alias("k"), F.col("y_line").alias("y"), "section_number"))).alias("starts"))
    notes = clusters.groupBy(*group, "page").agg(F.sort_array(F.collect_list(
        F.struct("cluster", "y_top", "title"))).alias("notes"))
    zero = F.struct(
        F.array().cast("array<bigint>").alias("used"),
        F.array().cast("array<struct<section_number:string,section_title:string>>").alias("out"))

    def choose(acc: Column, start: Column) -> Column:
        free = F.filter(F.col("notes"), lambda n: ~F.array_contains(acc["used"], n["cluster"])
                        & (F.abs(n["y_top"] - start["y"]) <= tolerance))
        best = F.array_min(F.transform(free, lambda n: F.struct(
            F.abs(n["y_top"] - start["y"]).alias("d"), n["cluster"].cast("bigint").alias("cluster"), n["title"].alias("title"))))
        pair = F.struct(start["section_number"].alias("section_number"), best["title"].alias("section_title"))
        return F.when(best.isNull(), acc).otherwise(F.struct(
            F.concat(acc["used"], F.array(best["cluster"])).alias("used"), F.concat(acc["out"], F.array(pair)).alias("out")))

    picked = by_page.join(notes, [*group, "page"]).withColumn(
        "pair", F.explode(F.aggregate("starts", zero, choose, lambda acc: acc["out"])))
    out = picked.select(*group, "page", "pair.section_number", "pair.section_title")
    if first_page is None:
        return out
    fixed = by_page.where(F.col("page") == 1).select(
        *group, "page", F.lit(first_page[0]).alias("section_number"), F.lit(first_page[1]).alias("section_title"))
    return out.where(F.col("page") != 1).unionByName(fixed)


def is_act_footnote(line: Column) -> Column:
    return line.rlike(r"(?i)^\d+\s+of\s+\d{4}\.?$")
