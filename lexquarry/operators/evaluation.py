"""Retrieval metrics, threshold calibration, comparison of configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lexquarry.functions.refs import base_section
from lexquarry.session import reliable_checkpoint

MISS = 0


def first_hits(golden: DataFrame, hits: DataFrame, query: str = "query_id", prefix: bool = False,
               check_act: bool = True, by: list[str] | None = None,
               configs: list[tuple] | None = None) -> DataFrame:
    """(query, rank of the first relevant hit, 0 for none), per configuration in ``by``.

    ``golden``: query, expected_act, expected_sections; ``hits``: query, rank,
    act_short, section_number.  A hit is relevant when its number or base number
    is expected; with ``prefix`` it only has to start with an expected number.
    ``configs`` lists the values of ``by``; it is required with ``by``, so that a
    configuration without a hit still counts its misses.
    """
    by = by or []
    wanted = golden.select(query, "expected_act", F.col("expected_sections").alias("_want"))
    joined = hits.select(*by, query, "rank", "act_short", "section_number").join(wanted, query)
    number = F.col("section_number")
    if prefix:
        match = F.exists("_want", lambda w: F.startswith(number, w))
    else:
        match = F.array_contains("_want", number) | F.array_contains("_want", base_section(number))
    if check_act:
        match = match & (F.col("expected_act").isNull() | (F.col("act_short") == F.col("expected_act")))
    best = joined.where(match).groupBy(*by, query).agg(F.min("rank").alias("first_rank"))
    every = golden.select(query)
    if by:
        if configs is None:
            raise ValueError("name the configurations to compare")
        every = _configs(golden, query, by, configs)
    return every.join(best, [*by, query], "left").select(*by, query, F.coalesce("first_rank", F.lit(MISS)).alias("first_rank"))


def _configs(golden: DataFrame, query: str, by: list[str], names: list[tuple]) -> DataFrame:
    """Every golden query under every configuration named."""
    configs = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(by, name)]) for name in names])
    return golden.select(query, F.explode(configs).alias("_c")).select(query, "_c.*")


def hit_at(k: int, rank: str = "first_rank") -> Column:
    return F.when((F.col(rank) > 0) & (F.col(rank) <= k), 1.0).otherwise(0.0)


def ranking_metrics(first: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Recall at 5 and 10 and mean reciprocal rank, to four digits."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return first.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("queries"),
        F.round(F.sum(hit_at(5)) / n, 4).alias("recall_at_5"), F.round(F.sum(hit_at(10)) / n, 4).alias("recall_at_10"),
        F.round(F.sum(F.when(F.col("first_rank") > 0, 1.0 / F.col("first_rank")).otherwise(0.0)) / n, 4).alias("mrr"))


ACCURACY = 10_000
#: Steps of the sketch that narrows a bracket, and the distinct values that a bracket may hold when they are put in order.
GRID, BRACKET_VALUES = 1_000, 10_000


def nearest_rank(rows: DataFrame, value: str, percentiles: dict[str, float], by: list[str]) -> DataFrame:
    """Percentiles as elements of the sorted values: position int(n * p), from 0.

    Selection by rounds.  Every group has a bracket for each percentile; a round counts the values below it and at its ends and
    sketches those between, for all percentiles in one aggregation, and the sketch gives the next bracket.  That goes on until no
    bracket holds more than ``BRACKET_VALUES`` distinct values; only these are put in order, so no task sorts the values of a group.
    A round leaves about a few ``GRID``-ths of the values; the ends are counted apart, so a value that most rows share does not hold
    it up.  The result is exact.  A null label is a group; a group without values has n = 0 and null percentiles.
    """
    v, names = F.col(value), list(percentiles)
    data = rows.select(*by, value)
    brackets = None
    steps = F.expr("array(" + ", ".join(f"{i / GRID}D" for i in range(GRID + 1)) + ")")
    while True:
        seen = data if brackets is None else _same_group(data, brackets.drop("n"), by)
        counted = [F.count(value).alias("n")]
        for name in names:
            low, high = _ends(rows, value, name, brackets is None)
            between = v if brackets is None else F.when((v > low) & (v < high), v)
            counted += [
                F.first(low).alias(f"_low_{name}"), F.first(high).alias(f"_high_{name}"), F.count_if(v < low).alias(f"_below_{name}"),
                F.count_if(v == low).alias(f"_at_{name}"), F.count(between).alias(f"_open_{name}"),
                F.approx_count_distinct(between).alias(f"_kinds_{name}"),
                F.percentile_approx(between, steps, ACCURACY).alias(f"_edges_{name}")]
        now = reliable_checkpoint(seen.groupBy(*by).agg(*counted))
        if (now.agg(F.max(F.greatest(*(F.col(f"_kinds_{n}") for n in names), F.lit(0)))).first()[0] or 0) <= BRACKET_VALUES:
            break
        brackets = now.select(*by, "n", *(c for name, p in percentiles.items() for c in _narrowed(name, p)))
    return _picked(data, now, value, percentiles, by, whole=brackets is None)


def _ends(rows: DataFrame, value: str, name: str, whole: bool) -> tuple[Column, Column]:
    if whole:
        none = F.lit(None).cast(rows.schema[value].dataType)
        return none, none
    return F.col(f"_low_{name}"), F.col(f"_high_{name}")


def _narrowed(name: str, p: float) -> list[Column]:
    """The next bracket: an end itself, or the steps of the sketch around the position, half a step more than its error."""
    low, high, edges = F.col(f"_low_{name}"), F.col(f"_high_{name}"), F.col(f"_edges_{name}")
    within = F.floor(F.col("n") * F.lit(p)) - F.col(f"_below_{name}")
    after = within - F.col(f"_at_{name}")
    step = F.lit(GRID) / F.greatest(F.col(f"_open_{name}"), F.lit(1))

    def end(edge: Column) -> Column:
        inner = F.get(edges, F.least(F.greatest(edge, F.lit(0)), F.lit(GRID)).cast("int"))
        return F.when(low.isNotNull() & (within < F.col(f"_at_{name}")), low).when(after < F.col(f"_open_{name}"), inner).otherwise(high)

    return [end(F.floor(after * step - 0.5)).alias(f"_low_{name}"), end(F.ceil((after + 1) * step + 0.5)).alias(f"_high_{name}")]


def _picked(data: DataFrame, brackets: DataFrame, value: str, percentiles: dict[str, float], by: list[str], whole: bool) -> DataFrame:
    """The values at the positions, of brackets with few distinct values each."""
    v = F.col(value)
    per_name = F.array(*[F.struct(
        F.lit(name).alias("name"), F.col(f"_low_{name}").alias("low"), F.col(f"_high_{name}").alias("high"),
        (F.floor(F.col("n") * F.lit(p)) - F.col(f"_below_{name}")).alias("at")) for name, p in percentiles.items()])
    wanted = brackets.select(*by, F.explode(per_name).alias("_b")).select(*by, "_b.*")
    near = _same_group(data.where(v.isNotNull()), brackets.select(*by, per_name.alias("_all")), by)
    inside = F.filter("_all", lambda b: F.lit(whole) | v.between(b["low"], b["high"]))
    counts = near.select(*by, value, F.explode(inside).alias("_b")).groupBy(*by, "_b.name", value).agg(F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy(*by, "name").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = _same_group(counts.withColumn("_upto", F.sum("_c").over(w)), wanted.select(*by, "name", "at"), [*by, "name"])
    found = placed.where(F.col("_upto") > F.col("at")).groupBy(*by).agg(
        *[F.min(F.when(F.col("name") == name, v)).alias(name) for name in percentiles])
    return _same_group(brackets.select(*by, "n"), found, by)


def _same_group(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Left join on the labels; null is a label like any other."""
    if not by:
        return left.join(right, how="left")  # one row without labels
    other = right.select(*[F.col(c).alias(f"_of_{c}") for c in by], *[c for c in right.columns if c not in by])
    same = [left[c].eqNullSafe(other[f"_of_{c}"]) for c in by]
    on = same[0]
    for test in same[1:]:
        on = on & test
    return left.join(other, on, "left").drop(*[f"_of_{c}" for c in by])


def refusal_rates(judged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and rates of a judged golden set: should_refuse, accepted, correct."""
    outside, inside = F.col("should_refuse"), ~F.col("should_refuse")
    accepted, correct = F.col("accepted"), F.col("accepted") & F.col("correct")
    n_out, n_in = F.greatest(F.count_if(outside), F.lit(1)), F.greatest(F.count_if(inside), F.lit(1))
    return judged.groupBy(*(by or [])).agg(
        F.count_if(inside).alias("in_scope_total"), F.count_if(inside & accepted).alias("in_scope_accepted"),
        F.count_if(inside & ~accepted).alias("in_scope_refused"),
        F.round(F.count_if(inside & correct) / n_in, 4).alias("in_scope_accuracy"),
        F.round(F.count_if(inside & ~accepted) / n_in, 4).alias("false_refusal_rate"),
        F.count_if(outside).alias("out_of_scope_total"), F.count_if(outside & ~accepted).alias("out_of_scope_refused"),
        F.count_if(outside & accepted).alias("out_of_scope_accepted"),
        F.round(F.count_if(outside & ~accepted) / n_out, 4).alias("out_of_scope_refusal_rate"))


def thresholds(first: int = 2, last: int = 18, step: float = 0.05) -> list[float]:
    return [round(i * step, 2) for i in range(first, last + 1)]


def threshold_sweep(scored: DataFrame, grid: list[float] | None = None) -> DataFrame:
    """Refusal rates of every threshold; ``scored``: should_refuse, confidence_score, correct."""
    theta = F.explode(F.array(*[F.lit(t) for t in grid or thresholds()]))
    judged = scored.withColumn("threshold", theta).withColumn("accepted", F.col("confidence_score") >= F.col("threshold"))
    return refusal_rates(judged, ["threshold"])


def viable(oos: str = "out_of_scope_refusal_rate", false: str = "false_refusal_rate") -> Column:
    return (F.col(oos) >= 0.95) & (F.col(false) <= 0.05)


def best_threshold(sweep: DataFrame, fallback: float = 0.35) -> DataFrame:
    """The lowest viable threshold."""
    return sweep.agg(F.coalesce(F.min(F.when(viable(), F.col("threshold"))), F.lit(fallback)).alias("best_threshold"))


def generation_metrics(results: DataFrame) -> DataFrame:
    """Share of valid citations inside the scope, of refusals outside, and model calls outside."""
    outside = F.col("should_refuse")
    n_out, n_in = F.greatest(F.count_if(outside), F.lit(1)), F.greatest(F.count_if(~outside), F.lit(1))
    return results.agg(
        F.count(F.lit(1)).alias("queries"),
        F.round(F.count_if(~outside & F.coalesce("is_valid", F.lit(False))) / n_in, 4).alias("citation_valid_rate"),
        F.round(F.count_if(outside & F.col("is_refused")) / n_out, 4).alias("refusal_rate"),
        F.count_if(outside & F.col("model_called")).alias("out_of_scope_calls"))
