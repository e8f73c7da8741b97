"""Large sides of a join are merged, also where Spark would rather collect one of them in the driver."""

from pyspark.sql import functions as F

from lexquarry.operators.forms import lookup
from lexquarry.plans.answering import answer_forms
from lexquarry.sizing import join_bounded, skew_join


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_beyond_the_bound_nothing_is_broadcast(spark):
    left = spark.range(200).select((F.col("id") % 20).alias("k"), F.col("id").alias("v"))
    right = spark.range(30).select(F.col("id").alias("k"), F.lit("x").alias("w"))
    for how, n in (("inner", 200), ("left", 200), ("left_semi", 200), ("left_anti", 0)):
        joined = join_bounded(left, right, ["k"], how, max_rows=5)
        assert joined.count() == n
        assert "BroadcastHashJoin" not in plan(joined) and "SortMergeJoin" in plan(joined)
    split = skew_join(left, right, ["k"], hot_rows=3, salts=4)
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, left.join(right, "k").collect()))


def test_rows_of_forms_are_not_broadcast(spark):
    none = F.array().cast("array<struct<field_id:string,label:string,field_type:string,raw_text:string,placeholder:string>>")
    forms = spark.range(1, 9).select(
        F.col("id").cast("int").alias("form_number"), F.concat(F.lit("Title "), F.col("id")).alias("form_title"),
        F.array(F.col("id").cast("string")).alias("applicable_sections"), F.lit("text").alias("raw_text"), none.alias("fields"),
        F.array().cast("array<struct<signatory_title:string,seal_required:boolean>>").alias("signatures"),
        F.array().cast("array<struct<head_number:string,head_title:string,charge_text:string>>").alias("heads"),
        F.lit("BNSS_FORM").alias("form_id"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"),
        F.concat(F.lit("[BNSS Second Schedule, Form "), F.col("id"), F.lit("]")).alias("provenance"))
    queries = spark.createDataFrame([(1, "Form No. 3"), (2, "form 99"), (3, None)], "query_id bigint, query_text string")
    hits = lookup(queries, forms)
    assert "BroadcastHashJoin [query_id" not in plan(hits)
    out = answer_forms(hits.where("status = 'SUCCESS'").select("query_id", "query_text", "form_number"), forms)
    assert [(r.query_id, r.status) for r in out.collect()] == [(1, "SUCCESS")]
