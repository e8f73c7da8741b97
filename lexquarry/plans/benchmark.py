"""Benchmarks over a golden set."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from lexquarry.config import EngineConfig
from lexquarry.models.generation import FirstItemProvider, Provider
from lexquarry.operators.evaluation import first_hits, generation_metrics, ranking_metrics, refusal_rates
from lexquarry.functions.text import statute_tokens
from lexquarry.operators.lexical import corpus_counts
from lexquarry.plans.answering import answer
from lexquarry.plans.retrieval import Corpus, retrieve


def _exploded(results: DataFrame, name: str) -> DataFrame:
    return results.select(F.lit(name).alias("config"), "query_id", F.explode("documents").alias("d")).select(
        "config", "query_id", F.col("d.rank").alias("rank"), F.col("d.act_short").alias("act_short"),
        F.col("d.section_number").alias("section_number"))


def compare(golden: DataFrame, queries: DataFrame, corpus: Corpus, modes: list[str], config: EngineConfig, **search) -> DataFrame:
    """Recall, MRR and refusal rates of every mode; ``top_k`` of the config should reach 10."""
    hits, judged = None, None
    if corpus.index is None and corpus.counts is None and {*modes} - {"dense"}:
        # the modes share the statistics
        corpus = replace(corpus, counts=corpus_counts(corpus.passages, "chunk_id", "index_text", search.get("tokenizer", statute_tokens)))
    inside = golden.where(~F.col("should_refuse"))
    for mode in modes:
        results = retrieve(queries, corpus, mode, config, **search)
        rows = _exploded(results, mode)
        hits = rows if hits is None else hits.unionByName(rows)
        verdict = results.select(F.lit(mode).alias("config"), "query_id", (~F.col("is_refused")).alias("accepted"))
        judged = verdict if judged is None else judged.unionByName(verdict)
    first = first_hits(inside, hits, by=["config"], configs=[(m,) for m in modes])
    ranking = ranking_metrics(first, ["config"])
    correct = first.select("config", "query_id", (F.col("first_rank") > 0).alias("correct"))
    marked = judged.join(golden.select("query_id", "should_refuse"), "query_id").join(correct, ["config", "query_id"], "left")
    rates = refusal_rates(marked.withColumn("correct", F.coalesce("correct", F.lit(False))), ["config"])
    return ranking.join(rates, "config", "left")


def generation_benchmark(golden: DataFrame, retrieved: DataFrame, provider: Provider = FirstItemProvider(),
                         config: EngineConfig = EngineConfig()) -> DataFrame:
    """Citation validity inside the scope, refusals and model calls outside it."""
    answered = answer(retrieved, provider, config)
    rows = golden.select("query_id", "should_refuse").join(answered, "query_id").select(
        "should_refuse", (F.col("status") == "SUCCESS").alias("is_valid"), "is_refused", (F.col("attempts") > 0).alias("model_called"))
    return generation_metrics(rows)
