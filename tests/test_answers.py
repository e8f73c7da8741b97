"""Form answers, active documents, carried totals, null join keys."""

import random

from pyspark.sql import Window as W, functions as F


def test_form_answers_are_checked_and_asked_for_once_more(spark):
    from lexquarry.models.generation import CalledProvider
    from lexquarry.plans.answering import answer_forms

    forms = spark.createDataFrame([(k, f"Title {k}", ["1"], f"[BNSS Second Schedule, Form {k}]", k, k, "raw") for k in (1, 2, 3)],
                                  "form_number int, form_title string, applicable_sections array<string>, provenance string, page_start int, page_end int, raw_text string")
    part = "array<struct<label:string,field_type:string,placeholder:string>>"
    forms = forms.withColumns({
        "fields": F.array().cast(part), "heads": F.array().cast("array<struct<head_number:string,head_title:string,charge_text:string>>"),
        "signatures": F.array().cast("array<struct<signatory_title:string,seal_required:boolean>>")})
    found = spark.createDataFrame([(1, "what is form 1", 1), (2, "what is form 2", 2), (3, "what is form 3", 3)], "query_id int, query_text string, form_number int")

    def call(system, user):
        again = "<errors>" in user
        if "Form 1]" in user.split("\n")[1]:
            return "It is in [BNSS Second Schedule, Form 1].", 10, 1
        if "Form 2]" in user.split("\n")[1]:
            return ("It is in [Form 2]." if again else "It is in [Form 3]."), 10, 1
        return "It is in [Form 99].", 10, 1

    got = {r.query_id: r for r in answer_forms(found, forms, CalledProvider(call)).collect()}
    assert (got[1].status, got[1].attempts, got[1].prompt_tokens) == ("SUCCESS", 1, 10)
    assert (got[2].status, got[2].attempts, got[2].prompt_tokens) == ("SUCCESS", 2, 20)
    assert (got[3].status, got[3].attempts, got[3].is_refused, got[3].answer) == ("VALIDATION_FAILED", 2, True, None)
    assert "FORM_DOES_NOT_EXIST" in got[3].refusal_reason


def test_active_documents_narrow_the_scope_of_one_query(spark):
    from lexquarry.operators.tenancy import within_active

    scopes = spark.createDataFrame([("s", "u", "a"), ("s", "u", "b"), ("t", "v", "a")], "scope_id string, user_id string, document_id string")
    queries = spark.createDataFrame([(1, "s", ["b", "z", None]), (2, "s", None), (3, "t", []), (4, "t", ["b"])],
                                    "query_id int, scope_id string, active_documents array<string>")
    asked, seen = within_active(queries, scopes)
    sees = {}
    for r in asked.join(seen, "scope_id", "left").collect():
        sees.setdefault(r.query_id, set()).add((r.user_id, r.document_id))
    assert sees == {1: {("u", "b")}, 2: {("u", "a"), ("u", "b")}, 3: {("v", "a")}, 4: {(None, None)}}


def test_totals_are_carried_over_two_levels(spark, monkeypatch):
    from lexquarry.operators import scans

    monkeypatch.setattr(scans, "FAN", 4)
    draw = random.Random(2)
    rows = [(g, draw.randint(0, 60), i, draw.choice([None, 1, 2]), draw.choice([None, None, f"t{i}"])) for g in ("a", "b") for i in range(200)]
    frame = spark.createDataFrame(rows, "g string, page int, line int, n int, t string")
    got = scans.running(frame, ["g"], "page", ["line"], sums={"total": F.col("n")}, lasts={"last": F.col("t")})
    w = W.partitionBy("g").orderBy("page", "line").rowsBetween(W.unboundedPreceding, 0)
    want = frame.select("g", "line", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("total"), F.last("t", ignorenulls=True).over(w).alias("last"))
    plain = {(r.g, r.line): (r.total or 0, r.last) for r in want.collect()}
    assert {(r.g, r.line): (r.total or 0, r["last"]) for r in got.collect()}.keys() == plain.keys()
    assert {k: v[1] for k, v in plain.items()} == {(r.g, r.line): r["last"] for r in got.collect()}


def test_null_keys_of_salted_joins(spark):
    from lexquarry.sizing import skew_join

    left = spark.createDataFrame([(None, i) for i in range(20)] + [("k", i) for i in range(20)] + [("x", 1)], "k string, v int")
    right = spark.createDataFrame([("k", 7), (None, 8)], "k string, w int")
    for hot in (5, 10**6):
        rows = skew_join(left, right, ["k"], "left", hot_rows=hot, salts=4).collect()
        assert len(rows) == 41 and sum(r.w == 7 for r in rows) == 20 and all(r.w is None for r in rows if r.k != "k")
        assert skew_join(left, right, ["k"], "left_anti", hot_rows=hot, salts=4).count() == 21
        assert skew_join(left, right, ["k"], "inner", hot_rows=hot, salts=4).count() == 20


def test_unified_answers_every_question(spark, monkeypatch):
    from lexquarry.catalog import answers as A, corpus as K

    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(A, "unified", lambda queries, *rest, **named: queries.selectExpr(
        "query_id", "'' routed_corpus", "'' status", "false is_refused", "0 attempts"))
    got = sorted(r.query_id for r in A.unified_answers(spark, folder).select("query_id").collect())
    known = [r.query_id for r in A.user_queries(spark, folder).select("query_id").collect()]
    asked = [r.query_id + 2_000_000 for r in K.form_queries(spark, folder).select("query_id").collect()]
    assert got == sorted(known + asked)
