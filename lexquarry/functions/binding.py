"""Intermediate values that are computed once: inside one expression, and in a column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` written, and computed, once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row.

    A filter on a plain new column is moved below it and computes it again, once for each time that it names the column.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))))
