"""Counters over small label sets and their text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def counters(rows: DataFrame, labels: list[str], seconds: str | None = None) -> DataFrame:
    """Count, and sum of durations, per label tuple; labels must be few."""
    aggs = [F.count(F.lit(1)).alias("total")]
    if seconds:
        aggs.append(F.sum(seconds).alias("duration_sum"))
    return rows.groupBy(*labels).agg(*aggs)


def token_cost(rows: DataFrame, prompt: str, completion: str, price_in: float, price_out: float,
               by: list[str] | None = None) -> DataFrame:
    """Token totals and their price per thousand."""
    cost = F.col(prompt) / 1000.0 * price_in + F.col(completion) / 1000.0 * price_out
    return rows.groupBy(*(by or [])).agg(
        F.sum(prompt).alias("prompt_tokens"), F.sum(completion).alias("completion_tokens"),
        F.sum(F.col(prompt) + F.col(completion)).alias("total_tokens"), F.sum(cost).alias("estimated_cost"))


def exposition_lines(counted: DataFrame, metric: str, labels: list[str], value: Column, help_text: str,
                     kind: str = "counter") -> DataFrame:
    """(metric, ord, line) rows of the Prometheus text format; two head lines, then one per label tuple.

    Labels are written in alphabetical order.
    """
    parts: list[Column] = []
    for name in sorted(labels):
        parts += [F.lit(f'{name}="'), F.col(name).cast("string"), F.lit('",')]
    inside = F.concat(*parts) if parts else F.lit("")
    tagged = F.when(F.lit(bool(parts)), F.concat(F.lit("{"), F.rtrim(inside, F.lit(",")), F.lit("}"))).otherwise(F.lit(""))
    line = F.concat(F.lit(metric), tagged, F.lit(" "), value)
    body = counted.select(F.lit(metric).alias("metric"), F.lit(2).alias("ord"), line.alias("line"))
    heads = counted.sparkSession.createDataFrame(
        [(metric, 0, f"# HELP {metric} {help_text}"), (metric, 1, f"# TYPE {metric} {kind}")], body.schema)
    return heads.unionByName(body)


def exposition(lines: DataFrame) -> DataFrame:
    """The lines in file order, ready for ``write.text``."""
    return lines.orderBy("metric", "ord", "line").select("line")
