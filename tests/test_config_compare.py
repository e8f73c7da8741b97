"""The comparison of configurations has a run with the small-corpus fallback."""

from lexquarry.catalog.corpus import config_compare


def test_fallback_finds_what_negative_weights_hide(spark, tmp_path):
    """Three documents with the same two words: every weight is negative, so only the fallback scores them."""
    spark.createDataFrame([(i, "alpha beta", "en", "s", 10) for i in range(3)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r["config"]: r.asDict() for r in config_compare(spark, str(tmp_path)).collect()}
    assert set(rows) == {"k1=1.5 b=0.75", "k1=1.5 b=0.75 fallback", "k1=1.2 b=0.5", "k1=2 b=0"}
    assert rows["k1=1.5 b=0.75 fallback"]["mrr"] == 1.0 and rows["k1=1.5 b=0.75"]["mrr"] == 0.0
