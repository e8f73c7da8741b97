"""Places of regular expression matches as column expressions.

Positions count code points.  Patterns must not repeat a group: Java's matcher takes a stack frame per repetition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

CHUNK = 256
SPAN = "struct<start:int,end:int,value:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def found(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, value>>, end exclusive.

    The pieces between the matches give the places.  Lengths are added up in chunks, so many matches in one text stay cheap.
    """
    none = F.array().cast(f"array<{SPAN}>")

    def places(steps: Column) -> Column:
        def chunk(c: Column) -> Column:
            before = F.aggregate(F.slice(steps, 1, c * CHUNK), F.lit(0), lambda total, x: total + x["step"])
            first = F.struct(before.alias("at"), none.alias("spans"))
            return F.aggregate(F.slice(steps, c * CHUNK + 1, CHUNK), first, further, lambda acc: acc["spans"])

        last = F.floor((F.size(steps) - 1) / CHUNK).cast("int")
        return F.flatten(F.transform(F.sequence(F.lit(0), last), chunk))

    def further(acc: Column, x: Column) -> Column:
        end = acc["at"] + x["step"]
        span = F.struct((end - F.length(x["value"])).alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def whole(t: Column) -> Column:
        steps = F.zip_with(
            F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)),
            lambda piece, value: F.struct((F.length(piece) + F.length(value)).alias("step"), value.alias("value")))
        return F.when(t.rlike(pattern), let(F.filter(steps, lambda x: x["value"].isNotNull()), places)).otherwise(none)

    return let(text, whole)


def of_kind(spans: Column, kind: str, place: int) -> Column:
    """array<struct<start, place, end, kind>>: sorts by start, then by the kinds' order."""
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span (struct with start, end, kind; sorted by start) replaced by its kind in brackets.

    Of overlapping spans, the first one names the gap.  The text is cut in one pass over the spans.
    """
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    cut = F.aggregate(
        spans, first,
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
            s["end"].cast("int").alias("at"),
            F.when(s["start"] < acc["at"], acc["parts"]).otherwise(F.concat(acc["parts"], F.array(
                F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), s["kind"], F.lit("]"))))).alias("parts"))),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, cut).otherwise(text)
