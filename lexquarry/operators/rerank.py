"""Reranking of candidates by a pair scorer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexquarry.models.scoring import PairScorer, lexical_logit, sigmoid
from lexquarry.operators.topk import top_k
from lexquarry.sizing import BROADCAST_ROWS, fits, skew_join

ORDER_DIGITS = 12


def passage_header() -> Column:
    return F.concat(
        F.lit("["), F.col("act_short"), F.lit("] Chapter "), F.col("chapter"), F.lit(": "), F.col("chapter_title"),
        F.lit(" | Section "), F.col("section_number"), F.lit(": "), F.col("section_title"), F.lit("\n"), F.col("text"))


def attach(hits: DataFrame, passages: DataFrame, doc: str, few_hits: bool, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Bring passage columns to the hits.

    ``few_hits`` says that queries times k was checked to fit a broadcast; then
    the passages are read once and never shuffled.  Otherwise ``hits`` should be
    stored: they are read twice, and only passages that are hit are shuffled.
    """
    if few_hits:
        return passages.join(F.broadcast(hits), doc)
    wanted = hits.select(doc).distinct()
    if fits(wanted, broadcast_rows):
        passages = passages.join(F.broadcast(wanted), doc, "left_semi")
    return skew_join(hits, passages, [doc])


def rerank(
    candidates: DataFrame,
    query: str,
    query_text: str,
    k: int,
    passage: Column | None = None,
    scorer: PairScorer = lexical_logit,
    prior: str = "rank",
    by: list[str] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Best ``k`` candidates per query by the sigmoid of the scorer's logit.

    Equal scores keep their prior order.  Exact hits keep the score 1.  ``keep``
    names the columns to carry on; the others end where the scorer has read them.
    """
    raw = scorer(F.col(query_text), passage_header() if passage is None else passage)
    scored = candidates.withColumnRenamed(prior, "prior_rank").withColumn("_raw", raw)
    scored = scored.withColumn("_norm", sigmoid(F.col("_raw")))
    if keep is not None:
        scored = scored.select(*dict.fromkeys(["prior_rank" if c == prior else c for c in [query, *keep]]), "_raw", "_norm")
    ranked = top_k(scored, [*(by or []), query],
                   [F.round("_norm", ORDER_DIGITS).desc(), F.col("prior_rank").asc()], k)
    exact = F.coalesce(F.col("is_exact_match"), F.lit(False)) if "is_exact_match" in candidates.columns else F.lit(False)
    return ranked.withColumns({
        "score": F.when(exact, 1.0).otherwise(F.round("_norm", 4)), "raw_score": F.round("_raw", 4),
    }).drop("_raw", "_norm")
