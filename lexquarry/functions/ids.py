"""Deterministic identifiers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, functions as F

URL_NAMESPACE = str(uuid.NAMESPACE_URL)


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Name-based UUID, version 5, as Python's ``uuid.uuid5`` writes it."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), 1, 16)
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3),
        F.lit("-"), F.call_function("substring", variant, F.pmod(nibble, F.lit(4)) + 1, F.lit(1)),
        F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def chunk_point_id(chunk_id: Column, scheme: str = "corpus") -> Column:
    return uuid5(F.concat(F.lit(f"{scheme}://chunk/"), chunk_id))


def user_point_id(user_id: Column, document_id: Column, chunk_id: Column, scheme: str = "corpus") -> Column:
    return uuid5(F.concat(F.lit(f"{scheme}://user_point/"), user_id, F.lit("/"), document_id, F.lit("/"), chunk_id))


def document_id(user_id: Column, file_hash: Column, scheme: str = "corpus") -> Column:
    return uuid5(F.concat(F.lit(f"{scheme}://doc/"), user_id, F.lit("/"), file_hash))


def occurrence_id(prefix: Column, occurrence: Column) -> Column:
    """``prefix-007``: the running number has at least three digits."""
    digits = occurrence.cast("string")
    return F.concat(prefix, F.lit("-"), F.when(F.length(digits) >= 3, digits).otherwise(F.lpad(digits, 3, "0")))
