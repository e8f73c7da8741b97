"""Pair scorers: (query, passage) columns to a logit column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

from lexquarry.functions.text import document_tokens

PairScorer = Callable[[Column, Column], Column]


def lexical_logit(query: Column, passage: Column) -> Column:
    """Share of distinct query tokens found in the passage, on the scale -10.5 to 1.5."""
    return _token_logit(query, document_tokens(passage))


def _token_logit(query: Column, tokens: Column) -> Column:
    asked = F.array_distinct(document_tokens(query))
    share = F.size(F.array_intersect(asked, tokens)) / F.greatest(F.size(asked), F.lit(1))
    return F.lit(-10.5) + F.lit(12.0) * share


# What can be made of a passage before it meets its queries, and the scorer of a query and that.
lexical_logit.prepared = (lambda passage: F.array_distinct(document_tokens(passage)), _token_logit)


def model_logit(load: Callable[[], object]) -> PairScorer:
    """Scorer around an object with ``predict(pairs)``, loaded once per task."""
    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for query, passage in batches:
            yield pd.Series(model.predict(list(zip(query, passage))), dtype="float64")
    return lambda query, passage: score(query, passage)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
