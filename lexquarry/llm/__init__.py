"""Operators for training data, their queries and SQL twins.  Nothing else in the library imports this package."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = {
    "op1_secrets": ("op01_secrets", "OP1_SQL"),
    "op2_sharding": ("op02_sharding", None),
    "op3_substring_dedup": ("op03_substring_dedup", "OP3_SQL"),
    "op4_language": ("op04_language", None),
    "op5_pii": ("op05_pii", None),
    "op6_nearest": ("op06_nearest", "OP6_SQL"),
    "op7_hmm": ("op07_hmm", None),
    "op8_decontaminate": ("op08_decontaminate", "OP8_SQL"),
    "op9_packing": ("op09_packing", None),
    "op10_simhash": ("op10_simhash", None),
    "op11_minhash": ("op11_minhash", "OP11_SQL"),
    "op12_phrases": ("op12_phrases", "OP12_SQL"),
    "op13_prefix_trie": ("op13_prefix_trie", "OP13_SQL"),
}


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: getattr(import_module(f"lexquarry.llm.{m}"), n) for n, (m, _) in MODULES.items()}


def all_sql() -> dict[str, str]:
    return {n: getattr(import_module(f"lexquarry.llm.{m}"), s) for n, (m, s) in MODULES.items() if s}
