"""Corpus and upload ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexquarry.config import EngineConfig
from lexquarry.functions.binding import computed
from lexquarry.functions.chunking import embedding_text
from lexquarry.functions.ids import chunk_point_id, user_point_id
from lexquarry.functions.refs import cross_references
from lexquarry.functions.text import is_boilerplate
from lexquarry.models.embedding import HashedEmbedding, TrainedEmbedding
from lexquarry.operators.chunking import all_passages, chunk_pages, chunk_schedule, chunk_sections
from lexquarry.operators.schedule import schedule_entries
from lexquarry.operators.structure import attached_blocks, detect_sections, is_act_footnote
from lexquarry.operators.validation import assert_no_errors, corpus_issues
from lexquarry.sources import buckets
from lexquarry.sources.store import LAYOUT

Embedding = HashedEmbedding | TrainedEmbedding


def parse_corpus(
    lines: DataFrame, group: list[str], act: Column, act_short: str, schedule_lines: DataFrame | None = None,
    schedule_act: tuple[str, str] = ("Bharatiya Nyaya Sanhita, 2023", "BNS"), titles: DataFrame | None = None,
    config: EngineConfig = EngineConfig(),
) -> tuple[DataFrame, DataFrame]:
    """(sections, passages) of an act: clean lines to sections, sections and schedule rows to passages."""
    clean = computed(lines, text=F.col("text")).where(~is_boilerplate(F.col("text")) & ~is_act_footnote(F.col("text")))
    sections = detect_sections(clean, group, config.max_section, titles).withColumns({
        "act": act, "act_short": F.lit(act_short), "references": cross_references(F.col("raw_text"), act_short)})
    passages = chunk_sections(sections, group, config.section_max_chars)
    if schedule_lines is not None:
        rows = chunk_schedule(schedule_entries(schedule_lines, group, config.max_schedule_section), group, *schedule_act)
        passages = all_passages(passages, rows)
    else:
        for name in ("offence_name", "punishment", "cognizable_status", "bailable_status", "triable_court"):
            passages = passages.withColumn(name, F.lit(None).cast("string"))
    return sections, passages.withColumns({
        "index_text": embedding_text(), "point_id": chunk_point_id(F.col("chunk_id"))})


def ingest_corpus(sections: DataFrame, passages: DataFrame, model: Embedding, store: str, total_pages: int,
                  config: EngineConfig = EngineConfig(), n_buckets: int = buckets.BUCKETS) -> DataFrame:
    """Validate, embed and lay passages and vectors over the stored ones; an ERROR issue stops the job before anything is written."""
    kinds = sections.select(F.explode(attached_blocks(F.col("lines"))).alias("b")).select("b.kind")
    issues = corpus_issues(sections, passages, total_pages, config.max_section, blocks=kinds)
    assert_no_errors(issues)
    buckets.upsert(passages, f"{store}/passages", ["chunk_id"], buckets=n_buckets, layout=LAYOUT)
    written = buckets.lookup(passages.sparkSession, f"{store}/passages", passages)
    buckets.upsert(written.select("chunk_id", model.documents(F.col("index_text")).alias("embedding")), f"{store}/vectors", ["chunk_id"],
                   buckets=n_buckets)
    return issues


def ingest_uploads(uploads: DataFrame, model: Embedding, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Chunks with vectors and point ids of new uploads.

    ``uploads``: document_id, user_id, session_id, filename, page_number, text,
    is_deduplicated; documents already READY are left alone.
    """
    pages = uploads.where(~F.col("is_deduplicated")).drop("is_deduplicated")
    chunks = chunk_pages(pages, config.chunk_target_chars, config.chunk_overlap_chars, config.chunk_min_chars)
    return chunks.withColumns({
        "embedding": model.documents(F.col("text")),
        "point_id": user_point_id(F.col("user_id"), F.col("document_id"), F.col("chunk_id"))})


# Progress an ingestion job reports after each of its steps.
STAGES = [("extract", 25), ("chunk", 50), ("embed", 75), ("index", 90), ("complete", 100)]


def stage_events(jobs: DataFrame, stage: str, first_seq: int) -> DataFrame:
    """Job events for one step of a batch of jobs; the last step finalises."""
    progress = dict(STAGES)[stage]
    last = stage == STAGES[-1][0]
    return jobs.select(
        "job_id", F.lit(first_seq + [s for s, _ in STAGES].index(stage)).cast("long").alias("seq"),
        F.lit("finalize" if last else "update").alias("kind"), F.lit(None if last else "PROCESSING").cast("string").alias("status"),
        F.lit(progress).alias("progress"), F.lit(stage).alias("stage"))
