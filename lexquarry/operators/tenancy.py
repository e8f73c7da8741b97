"""Tenant scope, deduplication, upserts and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexquarry.functions.ids import document_id
from lexquarry.sizing import join_bounded


def require_scope(df: DataFrame, column: str = "user_id") -> DataFrame:
    """Trimmed user ids; a blank one fails the job."""
    name = F.trim(F.coalesce(F.col(column).cast("string"), F.lit("")))
    return df.withColumn(column, F.when(name != "", F.trim(F.col(column).cast("string"))).otherwise(
        F.raise_error(F.lit("a user id is required"))).cast(df.schema[column].dataType))


def scoped(rows: DataFrame, user: str, documents: list[str] | None = None) -> DataFrame:
    """Rows of one user, and of the named documents when there are any."""
    if not user or not user.strip():
        raise ValueError("a user id is required")
    out = rows.where(F.col("user_id") == user.strip())
    return out.where(F.col("document_id").isin(documents)) if documents else out


def scoped_count(rows: DataFrame, user: str, documents: list[str] | None = None) -> int:
    return scoped(rows, user, documents).count()


def scoped_by(rows: DataFrame, scopes: DataFrame, on: list[str] = ("user_id", "document_id")) -> DataFrame:
    """Rows that some scope row allows; for many scopes at once."""
    return join_bounded(rows, require_scope(scopes).select(*on).distinct(), list(on), "left_semi")


def visible_in_session(status: Column, document_session: Column, session: Column) -> Column:
    """Ready documents of the session; a missing session on either side matches all."""
    return (status == "READY") & (session.isNull() | document_session.isNull() | (document_session == session))


def active_documents(requested: Column, scoped_ids: Column, ready: Column) -> Column:
    """Requested and ready ids; else the scope's ids, ready ones if any are; else all ready."""
    return (
        F.when(requested.isNotNull(), F.array_intersect(requested, ready))
        .when(F.size(F.coalesce(scoped_ids, F.array().cast("array<string>"))) > 0,
              F.when(F.size(ready) == 0, scoped_ids).otherwise(F.array_intersect(scoped_ids, ready)))
        .otherwise(ready)
    )


def within_active(queries: DataFrame, scopes: DataFrame, active: str = "active_documents") -> tuple[DataFrame, DataFrame]:
    """Queries and scopes such that a query with active documents sees those of its scope only.

    Every distinct list of active documents gets a scope of its own; a query without one keeps its scope.
    """
    listed = F.array_sort(F.array_distinct(F.array_compact(F.coalesce(F.col(active), F.array().cast("array<string>")))))
    keyed = queries.withColumn("_active", listed).withColumn("_scope", F.when(
        F.size("_active") > 0, F.concat_ws("|", F.col("scope_id").cast("string"), F.sha2(F.to_json("_active"), 256))).otherwise(
        F.col("scope_id").cast("string")))
    lists = keyed.where(F.size("_active") > 0).select("scope_id", "_scope", "_active").distinct()
    narrow = scopes.join(lists, "scope_id").where(F.array_contains("_active", F.col("document_id")))
    rest = [c for c in scopes.columns if c != "scope_id"]
    every = scopes.select(F.col("scope_id").cast("string").alias("scope_id"), *rest).unionByName(
        narrow.select(F.col("_scope").alias("scope_id"), *rest).distinct())
    return keyed.withColumn("scope_id", F.col("_scope")).drop("_scope", "_active"), every


def latest(rows: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """Last version of every key.  A pre-aggregation, so hot keys stay cheap."""
    rest = [c for c in rows.columns if c not in key]
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_row"))
    return newest.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*rows.columns)


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """Stored rows with the incoming ones laid over them; running it again changes nothing."""
    return latest(stored.unionByName(incoming), key, version)


def delete_scoped(rows: DataFrame, doomed: DataFrame, on: list[str] = ("user_id", "document_id")) -> DataFrame:
    """Rows that no delete key of the same owner names."""
    return join_bounded(rows, require_scope(doomed).select(*on).distinct(), list(on), "left_anti")


def deleted_counts(rows: DataFrame, doomed: DataFrame, on: list[str] = ("user_id", "document_id")) -> DataFrame:
    """How many rows each delete key removes."""
    keys = require_scope(doomed).select(*on).distinct()
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    return keys.join(counts, list(on), "left").select(*on, F.coalesce("_n", F.lit(0)).alias("deleted"))


def new_uploads(uploads: DataFrame, registry: DataFrame, scheme: str = "corpus") -> DataFrame:
    """Uploads with their document id and whether that id is already READY.

    ``uploads``: user_id (string), content, filename.  The id comes from the
    user and the content hash, so the same file of the same user is one document.
    """
    hashed = uploads.withColumn("file_hash", F.sha2(F.col("content"), 256))
    named = hashed.withColumn("document_id", document_id(F.col("user_id"), F.col("file_hash"), scheme))
    ready = registry.where(F.col("status") == "READY").select("document_id", F.lit(True).alias("_ready")).distinct()
    return named.join(ready, "document_id", "left").withColumn(
        "is_deduplicated", F.coalesce("_ready", F.lit(False))).drop("_ready")


SENSITIVE_KEYS = ["text", "raw_text", "content", "file_bytes", "password", "auth_token"]


def redact(entries: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Log entries with sensitive values replaced and user ids hashed."""
    is_user = F.col(key) == "user_id"
    return entries.withColumns({
        value: F.when(F.col(key).isin(SENSITIVE_KEYS), F.lit("<REDACTED_CONTENT>"))
        .when(is_user, F.substring(F.sha2(F.col(value), 256), 1, 12)).otherwise(F.col(value)),
        key: F.when(is_user, F.lit("user_id_hash")).otherwise(F.col(key)),
    })


def owned(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """Registry rows a caller may see; missing and foreign ids both give no row.

    ``wanted``: user_id, document_id.
    """
    return registry.join(require_scope(wanted).distinct(), ["user_id", "document_id"])


def purge(vectors: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Vectors left after cancelled documents were cleaned up."""
    return delete_scoped(vectors, cancelled)
