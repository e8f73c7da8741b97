"""Whole-plan queries: answers, user documents, unified responses, benchmarks, streams."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexquarry.catalog import corpus as K
from lexquarry.catalog.search import _corpus, english_vocabulary
from lexquarry.catalog.structure import SQL as STRUCTURE_SQL
from lexquarry.catalog.stand_ins import known_items, table, turns
from lexquarry.config import EngineConfig
from lexquarry.functions.text import document_tokens
from lexquarry.models.embedding import HashedEmbedding
from lexquarry.operators.forms import lookup
from lexquarry.operators.jobs import job_states
from lexquarry.plans.answering import answer, answer_forms, combined_evidence, unified
from lexquarry.plans.benchmark import compare, generation_benchmark
from lexquarry.operators.tenancy import within_active
from lexquarry.plans.ingest import STAGES, ingest_corpus, ingest_uploads, parse_corpus
from lexquarry.plans.retrieval import retrieve, retrieve_user
from lexquarry.plans.staged import StagedIngest
from lexquarry.session import checkpoint_folder
from lexquarry.sources import buckets
from lexquarry.streaming.batched import AdmitBatches, JobStateBatches, run_batches
from lexquarry.streaming.jobs import counter_stream, ingest_stream, latest, run_to_folder


def _s(c: Column) -> Column:
    return c.cast("string")


def user_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as chunks of the users of the event table; some have a vector."""
    d = F.col("doc_id")
    docs = table(spark, folder, "documents").select(
        "doc_id", F.concat(F.lit("c"), F.lpad(_s(d), 10, "0")).alias("chunk_id"), F.concat(F.lit("doc"), _s(d % 40)).alias("document_id"),
        _s(d % 20).alias("user_id"), F.lit("notice.pdf").alias("filename"), (d % 200 + 1).cast("int").alias("page_start"),
        (d % 200 + 1).cast("int").alias("page_end"), "text")
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return docs.join(vectors, "doc_id", "left").drop("doc_id")


def scopes(spark: SparkSession, folder: str) -> DataFrame:
    """A user's scope holds all documents of the user."""
    return user_chunks(spark, folder).select(F.concat(F.lit("s"), F.col("user_id")).alias("scope_id"), "user_id", "document_id").distinct()


def user_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Every known item asked by one of the users."""
    return known_items(spark, folder).withColumns({
        "scope_id": F.concat(F.lit("s"), _s(F.col("query_id") % 20)), "active_documents": F.array(F.concat(F.lit("doc"), _s(F.col("query_id") % 20)))})


def retrieve_user_documents(spark: SparkSession, folder: str) -> DataFrame:
    return retrieve_user(user_queries(spark, folder), user_chunks(spark, folder), scopes(spark, folder), scorer=None).select(
        "query_id", "chunk_id", F.col("rank").cast("int").alias("rank"), F.col("dense_rank").cast("int").alias("dense_rank"),
        F.col("bm25_rank").cast("int").alias("bm25_rank"))


def retrieve_user_reranked(spark: SparkSession, folder: str) -> DataFrame:
    return retrieve_user(user_queries(spark, folder), user_chunks(spark, folder), scopes(spark, folder)).select(
        "query_id", "chunk_id", F.col("rank").cast("int").alias("rank"), "score")


def active_scope_search(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of known items among one active document of the user, with the document of each hit."""
    asked, seen = within_active(user_queries(spark, folder), scopes(spark, folder))
    chunks = user_chunks(spark, folder)
    hits = retrieve_user(asked, chunks, seen, scorer=None)
    return hits.join(chunks.select("chunk_id", F.col("document_id").alias("found_in")), "chunk_id").groupBy("query_id", "found_in").agg(
        F.count(F.lit(1)).alias("n_hits"))


def ingest_store(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as sections: validated, embedded and written, written again without a change, some deleted, and read back."""
    p, n = table(spark, folder, "part"), table(spark, folder, "part").count()
    key, page = F.col("p_partkey"), (F.col("p_partkey") % 50 + 1).cast("int")
    text = F.concat(F.lit("The "), F.col("p_name"), F.lit(" of "), F.col("p_brand"), F.lit(" is "), F.col("p_type"), F.lit("."))
    none = F.lit(None).cast("string")
    sections = p.select(_s(key).alias("section_number"), F.lit("1").alias("chapter"), page.alias("page_start"), page.alias("page_end"),
                        F.array(text).alias("lines"))
    passages = p.select(
        F.concat(F.lit("p"), _s(key)).alias("chunk_id"), F.lit("An Act").alias("act"), F.lit("BNS").alias("act_short"), F.lit("1").alias("chapter"),
        F.lit("Of parts").alias("chapter_title"), _s(key).alias("section_number"), F.col("p_name").alias("section_title"), none.alias("subsection"),
        none.alias("clause"), F.lit("substantive_section").alias("chunk_type"), text.alias("text"), page.alias("page_start"), page.alias("page_end"),
        text.alias("index_text"), F.lit(False).alias("has_proviso"))
    store, config, model = f"{_work(spark)}-store", EngineConfig(max_section=n), HashedEmbedding(EngineConfig(embedding_dim=64))
    for _ in range(2):
        ingest_corpus(sections, passages, model, store, 60, config, n_buckets=16)
    stored = buckets.read(spark, f"{store}/passages")
    buckets.delete(stored.where(F.col("section_number").cast("int") % 10 == 0), f"{store}/passages")
    return buckets.read(spark, f"{store}/passages").join(buckets.read(spark, f"{store}/vectors"), "chunk_id").select(
        "chunk_id", "chunk_type", F.md5("index_text").alias("index_md5"), F.size("embedding").cast("long").alias("dim"))


def generate_validate(spark: SparkSession, folder: str) -> DataFrame:
    """Section questions and known items retrieved, gated, answered and validated."""
    queries = known_items(spark, folder).unionByName(turns(spark, folder).select(
        (F.col("query_id") + 1_000_000).alias("query_id"), "query_text", F.lit(None).cast("array<float>").alias("query_vector")))
    found = retrieve(queries, _corpus(spark, folder), "auto", tokenizer=document_tokens)
    return answer(found).select("query_id", "status", "is_refused", "attempts", F.array_join("citations", ",").alias("citations"))


def combined_answers(spark: SparkSession, folder: str) -> DataFrame:
    return combined_evidence(user_queries(spark, folder), _corpus(spark, folder), user_chunks(spark, folder), scopes(spark, folder),
                             tokenizer=document_tokens, words=english_vocabulary(spark, folder)).select(
        "query_id", "routed_corpus", F.round("confidence_score", 4).alias("confidence_score"), "is_refused", F.size("chunks").alias("n_chunks"))


def form_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Form questions of customers: looked up, answered from the form found, and checked for its tag."""
    forms = K.forms(spark, folder)
    hits = lookup(K.form_queries(spark, folder), forms).where("status = 'SUCCESS'").select("query_id", "query_text", "form_number")
    return answer_forms(hits, forms).select("query_id", "status", "is_refused", "attempts", F.array_join("citations", ",").alias("citations"))


def unified_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Known items and all questions of customers in one table; the router settles which of them ask for a form."""
    asks = K.form_queries(spark, folder).select(
        (F.col("query_id") + 2_000_000).alias("query_id"), F.concat(F.lit("get "), F.col("query_text")).alias("query_text"),
        F.lit(None).cast("array<float>").alias("query_vector"), F.lit("s1").alias("scope_id"), F.array(F.lit("doc1")).alias("active_documents"))
    queries = user_queries(spark, folder).select(asks.columns).unionByName(asks)
    return unified(queries, _corpus(spark, folder), user_chunks(spark, folder), scopes(spark, folder), K.forms(spark, folder),
                   tokenizer=document_tokens).select("query_id", "routed_corpus", "status", "is_refused", "attempts")


def mode_compare(spark: SparkSession, folder: str) -> DataFrame:
    """Search modes over the golden items; a document's number stands for its section."""
    base = _corpus(spark, folder)
    numbered = type(base)(base.passages.withColumn("section_number", _s(F.col("doc_id"))), base.vectors)
    config = EngineConfig(top_k=10, candidate_k=25)
    return compare(K.golden(spark, folder), known_items(spark, folder), numbered, ["bm25", "dense", "hybrid"], config,
                   tokenizer=document_tokens)


def generation_rates(spark: SparkSession, folder: str) -> DataFrame:
    found = retrieve(known_items(spark, folder), _corpus(spark, folder), "hybrid", tokenizer=document_tokens)
    return generation_benchmark(K.golden(spark, folder), found)


def embed_documents(spark: SparkSession, folder: str) -> DataFrame:
    model = HashedEmbedding(EngineConfig(embedding_dim=256))
    return table(spark, folder, "documents").select("doc_id", model.documents(F.col("text")).alias("e")).select(
        "doc_id", F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"), F.size("e").alias("dim"))


def ingest_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as uploads: a source is a user's file, a document one of its pages."""
    pages = table(spark, folder, "documents").select(
        F.col("source").alias("document_id"), F.col("lang").alias("session_id"), F.lit("u1").alias("user_id"), F.lit("a.pdf").alias("filename"),
        F.col("doc_id").alias("page_number"), "text", (F.col("source") == "src1").alias("is_deduplicated"))
    return ingest_uploads(pages, HashedEmbedding(EngineConfig(embedding_dim=64))).select(
        "document_id", "chunk_id", "point_id", "token_count", F.size("embedding").alias("dim"))


def parse_statute(spark: SparkSession, folder: str) -> DataFrame:
    """Lines to passages in one plan, with schedule rows and references."""
    from lexquarry.catalog.structure import _schedule_lines, statute_lines

    sections, passages = parse_corpus(statute_lines(spark, folder), ["act_key"], F.col("act_key"), "BNSS",
                                      _schedule_lines(spark, folder))
    return passages.select("act_key", "chunk_id", "point_id", "chunk_type", F.md5("index_text").alias("index_md5"))


# --- streams ------------------------------------------------------------------

def _work(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder that all executors share."""
    return f"{checkpoint_folder(spark).rstrip('/')}/stream-{uuid4().hex}"


def _events(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 8).parquet(folder)


def stream_rate_limit(spark: SparkSession, folder: str) -> DataFrame:
    out = _work(spark)
    step = AdmitBatches(out, "user_id", "ts", "event_id", K.LIMIT, K.WINDOW, n_buckets=16)
    run_batches(_events(spark, folder), out, step)
    return step.decisions(spark).select("event_id", "is_allowed", "retry_after")


def stream_job_states(spark: SparkSession, folder: str) -> DataFrame:
    out = _work(spark)
    step = JobStateBatches(out, n_buckets=16)
    run_batches(K.job_events_of(_events(spark, folder)), out, step)
    return step.states(spark).select("job_id", "status", "progress", "stage", "last_seq")


def stream_counters(spark: SparkSession, folder: str) -> DataFrame:
    out = _work(spark)
    run_to_folder(counter_stream(_events(spark, folder), ["event_type"], "value"), out, "complete")
    return latest(spark, out).select("event_type", "total", F.round("duration_sum", 4).alias("duration_sum"))


def staged_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as an upload job; a fifth of the jobs is cancelled, each before another stage or too late."""
    source = f"{folder}/documents.parquet*"  # one file or a folder of files
    name = F.col("doc_id").cast("string")
    uploads = spark.readStream.schema(table(spark, folder, "documents").schema).option("maxFilesPerTrigger", 8).parquet(source).select(
        F.concat(F.lit("job"), name).alias("job_id"), F.concat(F.lit("doc"), name).alias("document_id"),
        F.concat(F.lit("u"), (F.col("doc_id") % 7).cast("string")).alias("user_id"), F.lit("s1").alias("session_id"), F.lit("a.pdf").alias("filename"),
        F.col("doc_id").alias("page_number"), F.regexp_replace("text", r"\n", "\n\n").alias("text"))
    cancels = table(spark, folder, "documents").where("doc_id % 5 = 0").select(
        F.concat(F.lit("job"), name).alias("job_id"), (F.floor(F.col("doc_id") / 5) % (len(STAGES) + 1)).alias("at"))
    order = [s for s, _ in STAGES]
    work = _work(spark)
    config = EngineConfig(chunk_target_chars=900, chunk_overlap_chars=100, embedding_dim=64)
    staged = StagedIngest(work, HashedEmbedding(config), lambda _, stage: cancels.where(F.col("at") <= order.index(stage)), config, n_buckets=16)
    ingest_stream(uploads, work, staged)
    states, stored = job_states(staged.events(spark)), staged.vectors(spark)
    if stored is None:
        return states.select("job_id", "status", "progress", "stage", F.lit(0).cast("long").alias("n_vectors"))
    held = stored.groupBy("job_id").agg(F.count("embedding").alias("n_vectors"))
    return states.join(held, "job_id", "left").select("job_id", "status", "progress", "stage", F.coalesce("n_vectors", F.lit(0)).alias("n_vectors"))


QUERIES = {f.__name__: f for f in (
    retrieve_user_documents, retrieve_user_reranked, active_scope_search, ingest_store, form_answers, generate_validate, combined_answers, unified_answers, mode_compare,
    generation_rates, embed_documents, ingest_documents, parse_statute, stream_rate_limit, stream_job_states, stream_counters, staged_ingest)}

SQL = {
    # every hit lies in the active document; five of its chunks are found, or all if there are fewer
    "active_scope_search": """SELECT item_id AS query_id, 'doc' || (item_id % 20) AS found_in, least(5, n)::BIGINT AS n_hits
FROM benchmark JOIN (SELECT doc_id % 40 AS d, count(*) AS n FROM documents GROUP BY d) ON d = item_id % 20""",
    "form_answers": f"""SELECT query_id, 'SUCCESS' AS status, false AS is_refused, 1::INT AS attempts,
  '[BNSS Second Schedule, Form ' || form_number || ']' AS citations FROM ({K.SQL["lookup_ladder"]}) WHERE status = 'SUCCESS'""",
    "embed_documents": r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[\p{L}\p{N}_]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm, 256::INT AS dim FROM documents""",
    "ingest_store": """SELECT 'p' || p_partkey AS chunk_id, 'substantive_section' AS chunk_type,
  md5('The ' || p_name || ' of ' || p_brand || ' is ' || p_type || '.') AS index_md5, 64::BIGINT AS dim FROM part WHERE p_partkey % 10 <> 0""",
    "staged_ingest": f"""WITH n AS (SELECT page_start AS doc_id, count(*) AS n FROM ({STRUCTURE_SQL["user_chunks"]}) GROUP BY ALL),
j AS (SELECT doc_id, coalesce(n, 0) AS n, CASE WHEN doc_id % 5 = 0 THEN (doc_id // 5) % 6 ELSE 5 END AS stop_at FROM documents LEFT JOIN n USING (doc_id))
SELECT 'job' || doc_id AS job_id, CASE WHEN n = 0 AND stop_at > 0 THEN 'FAILED' WHEN stop_at < 5 THEN 'CANCELLED' ELSE 'READY' END AS status,
  CASE WHEN n = 0 OR stop_at = 0 THEN NULL ELSE [25, 50, 75, 90, 100][stop_at] END::INT AS progress,
  CASE WHEN n = 0 AND stop_at > 0 THEN 'failed' WHEN stop_at < 5 THEN 'cancelled' ELSE 'complete' END AS stage,
  CASE WHEN stop_at < 5 THEN 0 ELSE n END::BIGINT AS n_vectors FROM j""",
    "stream_rate_limit": K.SQL["rate_limit"],
    "stream_job_states": K.SQL["job_states"].replace("n AS n_events, ", ""),
    "stream_counters": K.SQL["counters"],
}
