"""Queries over the test tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

AREAS = ["search", "structure", "evidence", "corpus", "answers"]


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for area in AREAS:
        part = import_module(f"lexquarry.catalog.{area}").QUERIES
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"queries registered twice: {sorted(clash)}")
        out.update(part)
    return out


def all_sql() -> dict[str, str]:
    return {n: q for area in AREAS for n, q in import_module(f"lexquarry.catalog.{area}").SQL.items()}
