import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", ".."))

from pyspark.sql import types as T  # noqa: E402

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(folder):
    import pyarrow.parquet as pq

    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()]


ODD = [
    (1, None), (2, ""), (3, " \t\n "), (None, "a row without an id"), (None, None), (4, "one"), (4, "one"), (5, "é ü ß 漢字 привет"),
    (6, "word " * 20000), (7, "x" * 100000), (8, "Same Text here and there"), (9, "Same Text here and there"), (9, "Same Text here and there"),
    (10, " no split\x85here"), (11, "trailing \n"), (12, "<|endoftext|> it's <|startoftext|>"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, blanks, ties, repeats and a very long text, and columns that clash with results or internals."""
    names = ["size", "shard", "lang", "spans", "score", "start", "length", "n_words", "simhash", "_text"]
    schema = T.StructType([*DOCS.fields, *(T.StructField(n, T.StringType()) for n in names)])
    return spark.createDataFrame([(*r, *[None] * len(names)) for r in ODD], schema)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def spark():
    from lexquarry.session import local_session

    return local_session("llm-tests", "4", 4)
