"""Structure, schedule, forms, layout, sources and the registry of queries."""

import re

import pytest
from pyspark.sql import functions as F

from lexquarry.catalog import all_queries, all_sql
from lexquarry.functions import forms as P
from lexquarry.operators import forms as M
from lexquarry.operators import structure as S
from lexquarry.operators.chunking import chunk_sections
from lexquarry.operators.schedule import schedule_entries
from lexquarry.sources import store
from lexquarry.config import EngineConfig
from lexquarry.sources.documents import extract_pages, file_problem

STATUTE = [
    (1, "CHAPTER II"), (1, "OF COURTS"), (1, "AND OFFICES"), (1, "1. The courts are these."), (1, "(1) High Courts;"), (1, "(a) one;"), (1, "(b) two."),
    (1, "Provided that none is left."), (2, "and more. 2. Whoever acts."), (2, "Explanation.— A word."), (2, "CHAPTER III"), (2, "OF POWERS"),
    (2, "3.The powers."), (3, "999. Not a section.")]


def statute(spark):
    rows = [("x", p, i, t) for i, (p, t) in enumerate(STATUTE)]
    return S.detect_sections(spark.createDataFrame(rows, "act string, page int, line_no int, text string"), ["act"])


def test_sections(spark):
    got = {r["section_number"]: r for r in statute(spark).collect()}
    assert set(got) == {"1", "2", "3"}
    one, two, three = got["1"], got["2"], got["3"]
    assert (one["chapter"], one["chapter_title"]) == ("II", "OF COURTS AND OFFICES")
    assert one["raw_text"].endswith("and more.") and (one["page_start"], one["page_end"]) == (1, 1)
    assert two["raw_text"] == "2. Whoever acts.\nExplanation.— A word."
    # the chapter is that of the section's start, not of the header that ends it
    assert two["chapter"] == "II" and (three["chapter"], three["chapter_title"]) == ("III", "OF POWERS")
    assert three["raw_text"] == "3.The powers.\n999. Not a section." and three["page_end"] == 3


def test_parts_of_a_section(spark):
    one = statute(spark).where("section_number = '1'")
    row = one.select(S.attached_blocks(F.col("lines")).alias("b"), S.subsections(F.col("raw_text")).alias("s"),
                     S.lead_in(F.col("raw_text")).alias("l")).first()
    assert [(b["kind"], b["text"]) for b in row["b"]] == [("proviso", "Provided that none is left.\nand more.")]
    assert [s["subsection_id"] for s in row["s"]] == ["(1)"] and [c["clause_id"] for c in row["s"][0]["clauses"]] == ["(a)", "(b)"]
    assert row["l"] == "1. The courts are these."


def test_long_sections_are_packed(spark):
    s = statute(spark).withColumns({"act_short": F.lit("BNSS")})
    got = chunk_sections(s, [], 40).where("section_number = '1'").orderBy("part").collect()
    assert [r["chunk_id"] for r in got] == ["bnss-s1-001"] and "The courts are these." in got[0]["text"] and got[0]["has_proviso"]
    assert [r["chunk_id"] for r in chunk_sections(s, [], 4000).where("section_number = '2'").collect()] == ["bnss-s2-001"]


def test_chapters(spark):
    got = {r["chapter"]: (r["page_start"], r["page_end"], r["n_sections"]) for r in S.chapters(statute(spark), ["act"]).collect()}
    assert got == {"II": (1, 2, 2), "III": (2, 3, 1)}


def test_schedule(spark):
    rows = [("x", 158, i, t) for i, t in enumerate([
        "Section Offence Punishment", "58( a) Abetment, Imprisonment for 7 years", "Cognizable Non-bailable Any Magistrate Court of Session", "400 not a row", "12"])]
    (r,) = schedule_entries(spark.createDataFrame(rows, "act string, page int, line_no int, text string"), ["act"]).collect()
    assert (r["section_number"], r["offence_name"], r["cognizable_status"], r["bailable_status"], r["triable_court"]) == (
        "58(a)", "Abetment", "Cognizable", "Non-bailable", "Court of Session")


FORM = ["FORM No. 33", "CHARGES", "[See sections 234, 235 (1) and 236]", "I. Charges with one head", "text ....... [name and address]", "dated ....",
        "(date)", "______ (Signature of the Magistrate)", "(Seal of the Court)"]


def test_forms(spark):
    df = spark.createDataFrame([("x", 222, i, t) for i, t in enumerate(FORM)] + [("x", 224, 0, "last")], "act string, page int, line_no int, text string")
    (r,) = M.parse_forms(df, ["act"]).collect()
    assert (r["form_id"], r["form_title"], r["applicable_sections"]) == ("BNSS_FORM_33", "CHARGES", ["234", "235(1)", "236"])
    assert [(f["label"], f["field_type"]) for f in r["fields"]] == [("name and address", "location_placeholder"), ("date", "date_placeholder")]
    assert [s["seal_required"] for s in r["signatures"]] == [False, True] and r["heads"][0]["head_number"] == "I"
    assert (r["page_start"], r["page_end"]) == (222, 224)
    md = M.parse_forms(df, ["act"]).select(P.render_markdown()).first()[0]
    assert md.startswith("# FORM No. 33\n## CHARGES\n") and "#### Head I: Charges with one head" in md


def test_form_lookup_ladder(spark):
    f = spark.createDataFrame([
        (1, "BNSS_FORM_01", "SUMMONS TO AN ACCUSED PERSON", ["63"]), (2, "BNSS_FORM_02", "WARRANT OF ARREST", ["72"]),
        (3, "BNSS_FORM_03", "WARRANT OF ATTACHMENT", ["72", "85(2)"])], "form_number int, form_id string, form_title string, applicable_sections array<string>")
    asks = ["Form No. 1", "2", "form 99", "section 63", "s. 72", "warrant of arrest", "accused summons", "attachment warrant property", "moon", "u/s 85"]
    q = spark.createDataFrame(list(enumerate(asks)), "query_id int, query_text string")
    got = {asks[r["query_id"]]: (r["step"], r["status"], r["form_number"]) for r in M.lookup(q, f).collect()}
    assert got["Form No. 1"] == ("number", "SUCCESS", 1) and got["2"] == ("number", "SUCCESS", 2)
    assert got["form 99"] == ("number", "NOT_FOUND", None) and got["section 63"] == ("section", "SUCCESS", 1)
    assert got["s. 72"] == ("section", "AMBIGUOUS", None) and got["warrant of arrest"] == ("title", "SUCCESS", 2)
    assert got["accused summons"] == ("similar", "SUCCESS", 1) and got["moon"] == ("none", "NOT_FOUND", None)
    assert got["u/s 85"] == ("section", "SUCCESS", 3)


def test_margin_notes_are_used_once(spark):
    lines = spark.createDataFrame([("x", 2, 700.0, "1. One."), ("x", 2, 690.0, "2. Two."), ("x", 2, 100.0, "3. Far.")], "a string, page int, y_line double, text string")
    notes = spark.createDataFrame([("x", 2, 1, 695.0, "First"), ("x", 2, 2, 660.0, "Second")], "a string, page int, cluster int, y_top double, title string")
    got = {r["section_number"]: r["section_title"] for r in S.note_titles(lines, notes, ["a"], 531, 55.0).collect()}
    assert got == {"1": "First", "2": "Second"}


def test_uploads(spark):
    files = spark.createDataFrame([("a", bytearray(b"%PDF-1 one\ftwo words here")), ("b", bytearray(b"text")), ("c", bytearray(b""))], "path string, content binary")
    assert {r[0]: r[1] for r in files.select("path", file_problem(F.col("content"))).collect()} == {"a": None, "b": "NOT_PDF", "c": "EMPTY"}
    pages = extract_pages(files.where("path = 'a'"), ocr=lambda content, n: "seen" if n == 2 else None).collect()
    assert [(p["page_number"], p["text"], p["is_ocr"]) for p in pages] == [(1, "%PDF-1 one", False), (2, "seen", True)]


def test_manifest_and_golden(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"schedule": "s",\n "forms": [{"form_number": 1, "title": "T"}]}')
    (tmp_path / "g.jsonl").write_text('{"id": "G1", "query": "q", "expected_sections": ["1"], "should_refuse": false}\n')
    entries = store.read_manifest(spark, [str(tmp_path / "none.json"), str(tmp_path / "m.json")])
    assert [(r["form_id"], r["form_title"]) for r in store.forms_of_manifest(entries).collect()] == [("BNSS_FORM_01", "T")]
    assert store.read_manifest(spark, [str(tmp_path / "none.json")]).count() == 0
    assert store.read_golden(spark, str(tmp_path / "g.jsonl")).first()["expected_sections"] == ["1"]


def test_every_sql_belongs_to_a_query():
    assert not all_sql().keys() - all_queries().keys()
    assert all(re.fullmatch(r"[a-z0-9_]+", n) for n in all_queries())


@pytest.mark.parametrize("name", ["bm25_topk", "line_sessions", "verify_citations", "lookup_ladder", "job_states"])
def test_query_equals_sql(spark, name):
    import duckdb

    from lexquarry.sources.tables import TABLES
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = all_queries()[name](spark, folder).toArrow(), con.sql(all_sql()[name]).to_arrow_table()
    names = sorted(want.column_names)
    assert sorted(got.column_names) == names
    rows = [sorted(zip(*[t.column(n).to_pylist() for n in names]), key=repr) for t in (got, want)]
    assert rows[0] == rows[1]


def test_files_are_checked_before_the_reader(spark):
    """The reader fails on every file that a check refuses, so none may reach it."""
    good = b"%PDF-1\n one \f two \f  \f four"
    rows = [("good", good), ("plain", b"text"), ("none", None), ("void", b""), ("locked", b"%PDF-1 trailer /Encrypt 7 0 R"),
            ("talk", b"%PDF-1 about /Encrypt"), ("large", b"%PDF-" + b"x" * 200), ("blank", b"%PDF-\f \f "), ("broken", b"%PDF-!")]

    def reader(content):
        assert content.startswith(b"%PDF-") and b"7 0 R" not in content and len(content) < 100
        if content.endswith(b"!"):
            raise ValueError("no table")
        return content.decode().split("\f")[1:] if content.startswith(b"%PDF-\f") else content.decode()[6:].split("\f")

    files = spark.createDataFrame(rows, "path string, content binary")
    config = EngineConfig(upload_max_bytes=100)
    got = sorted((r.path, r.page_number, r.text, r.problem) for r in extract_pages(files, reader, config=config).collect())
    assert got == sorted([
        ("good", 1, "one", None), ("good", 2, "two", None), ("good", 3, "", None), ("good", 4, "four", None), ("plain", 0, "", "NOT_PDF"),
        ("none", 0, "", "EMPTY"), ("void", 0, "", "EMPTY"), ("locked", 0, "", "ENCRYPTED"), ("talk", 1, "about /Encrypt", None),
        ("large", 0, "", "TOO_LARGE"), ("blank", 0, "", "NO_TEXT"), ("broken", 0, "", "UNREADABLE no table")])
    ranged = extract_pages(files.where("path in ('good', 'talk')"), reader, config=config, pages=(2, 3)).collect()
    assert sorted((r.path, r.page_number, r.problem) for r in ranged) == [("good", 2, None), ("good", 3, None), ("talk", 0, "NO_PAGES")]
    with pytest.raises(ValueError):
        extract_pages(files, reader, pages=(3, 2))


def counted_lines(spark, texts):
    """Lines whose text is made by a function that counts its calls."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def made(text):
        calls.add(1)
        return text

    rows = [("a", i // 5, i % 5, text) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "act_key string, page int, line_no int, text string").withColumn("text", made("text")), calls


def test_lines_are_computed_twice(spark):
    """Once for the totals of the pages and once for the rows, however often the text is tested and read."""
    texts = [f"{i % 7 + 1}. The text {i}" if i % 2 else f"{i + 1} (2) Theft {i} Imprisonment for life." for i in range(40)]
    for build in (lambda rows: S.detect_sections(rows, ["act_key"]), lambda rows: schedule_entries(rows, ["act_key"])):
        lines, calls = counted_lines(spark, texts)
        assert build(lines).collect()
        assert calls.value <= 2 * len(texts)
