"""Sliding-window admission of requests per key.

Only admitted requests count, so a decision depends on the decisions before
it; a window function cannot express that.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lexquarry.session import reliable_checkpoint

MICROS = 1_000_000


def micros(rows: DataFrame, time: str) -> Column:
    """Microseconds of a time column; times without a zone do not pass through the session's."""
    c = F.col(time)
    if not isinstance(rows.schema[time].dataType, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    whole = F.unix_date(F.to_date(c)) * F.lit(86_400).cast("bigint") + F.hour(c) * 3600 + F.minute(c) * 60
    return whole * F.lit(MICROS) + (F.extract(F.lit("SECOND"), c) * MICROS).cast("bigint")


def _decide(times: np.ndarray, state: list[int], limit: int, window: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Admission, retry seconds and final state of one key's ordered request times."""
    n = len(times)
    allowed, retry = np.ones(n, dtype=bool), np.zeros(n, dtype="int32")
    seen = np.concatenate([np.asarray(state, dtype="int64"), times])
    # nobody is refused when the request ``limit`` places back is always expired
    if len(seen) <= limit or (seen[limit:] - seen[:-limit] >= window).all():
        last = times[-1] if n else 0
        kept = seen[-limit:]
        return allowed, retry, kept[kept > last - window].tolist() if n else state
    held = deque(state)
    for i, now in enumerate(times.tolist()):
        while held and held[0] <= now - window:
            held.popleft()
        if len(held) >= limit:
            allowed[i] = False
            retry[i] = max(1, int((window - (now - held[0])) / MICROS))
        else:
            held.append(now)
    return allowed, retry, list(held)


def admit(
    requests: DataFrame,
    key: str,
    time: str,
    tie: str,
    limit: int = 60,
    window_seconds: int = 60,
    partitions: int | None = None,
) -> DataFrame:
    """Requests with ``is_allowed`` and ``retry_after``.

    Rows are range-partitioned by (key, time), so a hot key spreads over many
    partitions of equal size, and every partition is decided on its own.  A
    partition that opens in the middle of a key is decided again with the
    admitted times its predecessor ends with, until none of them changes;
    without sustained overload that takes one further round, and never more
    rounds than partitions.  Between rounds only those few times pass through
    the driver.

    A null key is a principal of its own.  A request without a time cannot be
    placed: its decision is null and it counts against nobody.
    """
    n = partitions or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = requests.withColumn("_t", micros(requests, time)).withColumn(
        "_k", F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("")))
    spread = placed.where(F.col("_t").isNotNull()).repartitionByRange(n, "_k", "_t", tie).sortWithinPartitions("_k", "_t", tie)
    # the layout has to be the same in every round
    fixed = reliable_checkpoint(spread.withColumn("_part", F.spark_partition_id()))
    window = window_seconds * MICROS

    def runs(batches: Iterator[pa.RecordBatch], carried: dict[int, list[int]]):
        """Runs of one key in order: batch, first and past the last row, key, decisions, state; a run may begin in an earlier batch."""
        current, state = None, []
        for batch in batches:
            keys, times = batch.column("_k").dictionary_encode(), batch.column("_t").to_numpy()
            codes = keys.indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                value = keys.dictionary[int(codes[lo])].as_py()
                if current is None:
                    state = list(carried.get(batch.column("_part")[0].as_py(), []))
                elif value != current:
                    state = []
                current = value
                allowed, retry, state = _decide(times[lo:hi], state, limit, window)
                yield batch, lo, hi, value, allowed, retry, state

    def summarise(carried: dict[int, list[int]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = last = None
            for batch, lo, _, value, _, _, state in runs(batches, carried):
                if first is None:
                    first = batch.column("_part")[0].as_py(), value, batch.column("_t")[lo].as_py()
                last = value, state
            if first is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([first[0]], pa.int32()), pa.array([first[1]]), pa.array([last[0]]), pa.array([first[2]], pa.int64()),
                     pa.array([last[1]], pa.list_(pa.int64()))], names=["part", "first_key", "last_key", "first_time", "state"])
        return run

    summary = "part int, first_key string, last_key string, first_time bigint, state array<bigint>"
    found = {r["part"]: r for r in fixed.select("_k", "_t", "_part").mapInArrow(summarise({}), summary).collect()}
    order = sorted(found)
    carried: dict[int, list[int]] = {}
    for _ in range(len(order) + 1):
        stale = {}
        for before, part in zip(order, order[1:]):
            if found[before]["last_key"] == found[part]["first_key"]:
                alive = [t for t in found[before]["state"] if t > found[part]["first_time"] - window]
                if alive != carried.get(part, []):
                    stale[part] = alive
        if not stale:
            break
        carried.update(stale)
        again = fixed.where(F.col("_part").isin(list(stale))).select("_k", "_t", "_part")
        found.update({r["part"]: r for r in again.mapInArrow(summarise(dict(carried)), summary).collect()})

    names = requests.columns
    schema = T.StructType([*requests.schema.fields, T.StructField("is_allowed", T.BooleanType()), T.StructField("retry_after", T.IntegerType())])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, _, allowed, retry, _ in runs(batches, carried):
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(lo, hi - lo) for c in names), pa.array(allowed), pa.array(retry, pa.int32())], names=schema.names)

    decided = fixed.mapInArrow(decide, schema)
    timeless = placed.where(F.col("_t").isNull()).select(
        *names, F.lit(None).cast("boolean").alias("is_allowed"), F.lit(None).cast("int").alias("retry_after"))
    return decided.unionByName(timeless)
