"""Headline queries, timed.

Prints one JSON line.  BENCH_SF_DIR names the tables, BENCH_CPUS the cores.
One small query warms the session up; every headline query then runs once.
"""

from __future__ import annotations

import json
import os
import sys
import time

from lexquarry.catalog import all_queries
from lexquarry.catalog.search import documents, stored_index
from lexquarry.operators.pruned import search
from lexquarry.session import local_session

HEADLINE = [
    "tokenize_docs", "term_idf", "bm25_topk", "bm25_filtered", "dense_topk", "rrf_fuse", "exact_lookup", "section_intent",
    "rerank_topk", "confidence", "retrieve_hybrid", "retrieve_auto", "clean_documents", "user_chunks", "line_sessions",
    "pack_chunks", "schedule_fields", "sentence_split", "verify_citations", "validate_answers", "context_budget", "lookup_ladder",
    "upsert_latest", "ingest_dedup", "corpus_issues", "recall_mrr", "threshold_sweep", "nearest_rank_percentiles", "rate_limit",
    "job_states", "counters",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    queries = all_queries()
    queries["counters"](spark, folder).toArrow()
    took: dict[str, float] = {}
    for name in [n for n in only if n != "bm25_stored_index"] if only else HEADLINE:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    if not only or "bm25_stored_index" in only:
        # the search alone: the index is written before, as a user of a stored index has it
        index = stored_index(documents(spark, folder), "doc_id", "text")
        asked = spark.read.parquet(f"{folder}/benchmark.parquet").withColumnRenamed("text", "asked")
        search(index, asked.limit(1), "doc_id", "item_id", "asked", 25).write.format("noop").mode("overwrite").save()
        start = time.time()
        search(index, asked, "doc_id", "item_id", "asked", 25).write.format("noop").mode("overwrite").save()
        took["bm25_stored_index"] = round(time.time() - start, 3)
    n_queries = spark.read.parquet(f"{folder}/benchmark.parquet").count()
    per_query = {n: round(1000 * took[n] / n_queries, 2) for n in ("bm25_topk", "bm25_stored_index", "dense_topk", "retrieve_hybrid") if n in took}
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cores": cpus, "batch_queries": n_queries, "ms_per_query_in_batch": per_query}))


if __name__ == "__main__":
    main()
