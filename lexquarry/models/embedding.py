"""Embedding models."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lexquarry.config import EngineConfig
from lexquarry.functions.text import document_tokens


class HashedEmbedding:
    """Signed feature hashing of tokens, L2-normalised.

    Tokens are cut and hashed by Spark; only the bucket numbers reach Python.
    """

    def __init__(self, config: EngineConfig = EngineConfig()):
        self.dim = config.embedding_dim
        self.instruction = config.query_instruction

    def documents(self, text: Column) -> Column:
        slots = F.transform(document_tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(2 * self.dim)).cast("int"))
        return _fold(self.dim)(slots)

    def queries(self, text: Column) -> Column:
        """The instruction prefix is for trained models; hashing leaves it out."""
        return self.documents(text)


# Counters a batch of embeddings holds at a time.
FOLD_CELLS = 4_000_000


def _fold(dim: int) -> Callable[[Column], Column]:
    @F.pandas_udf("array<float>")
    def fold(slots: pd.Series) -> pd.Series:
        out: list[np.ndarray] = []
        most = max(1, FOLD_CELLS // (2 * dim))
        for lo in range(0, len(slots), most):
            part = [np.asarray(s, dtype="int64") for s in slots.iloc[lo:lo + most]]
            row = np.repeat(np.arange(len(part)), [len(s) for s in part])
            flat = np.concatenate([np.zeros(0, dtype="int64"), *part])
            counts = np.bincount(row * 2 * dim + flat, minlength=len(part) * 2 * dim).reshape(len(part), 2 * dim).astype("float64")
            v = counts[:, :dim] - counts[:, dim:]
            norm = np.sqrt((v * v).sum(1, keepdims=True))
            out += list((v / np.where(norm > 0, norm, 1)).astype("float32"))
        return pd.Series(out, index=slots.index)
    return fold


class TrainedEmbedding:
    """A model loaded once per Python worker.

    ``load`` returns an object whose ``encode(list[str])`` gives unit vectors.
    """

    def __init__(self, load: Callable[[], object], config: EngineConfig = EngineConfig()):
        self.load, self.instruction = load, config.query_instruction

    def documents(self, text: Column) -> Column:
        load = self.load

        @F.pandas_udf("array<float>")
        def encode(batches: "pd.Series") -> "pd.Series":
            model = _once(load)
            return pd.Series(list(model.encode(batches.fillna("").tolist())))
        return encode(text)

    def queries(self, text: Column) -> Column:
        return self.documents(F.concat(F.lit(self.instruction), text))


_loaded: dict[int, object] = {}


def _once(load: Callable[[], object]) -> object:
    key = hash(load)
    if key not in _loaded:
        _loaded[key] = load()
    return _loaded[key]


def throughput(rows: Column, seconds: Column) -> Column:
    """Rows per second; the duration counts as at least a millisecond."""
    return rows / F.greatest(seconds, F.lit(0.001))


def embed_passages(passages: DataFrame, text: str, model: HashedEmbedding | TrainedEmbedding) -> DataFrame:
    return passages.withColumn("embedding", model.documents(F.col(text)))
