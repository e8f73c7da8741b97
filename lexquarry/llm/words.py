"""Words of text batches as flat arrays, and the frame of operators that work row by row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

#: Text bytes that are held as arrays at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20

#: Lower-cases A-Z and leaves every other byte.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lower-cases A-Z and turns every ASCII byte but letters and digits into a space.
ALPHANUMERIC = bytes(
    LOWER[b] if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass
class Words:
    """Words of several texts: text i has ``codes[starts[i]:starts[i + 1]]``, numbers of ``values``."""

    starts: np.ndarray
    codes: np.ndarray
    values: list[bytes]

    def hashes(self, hash_one: Callable[[bytes], int]) -> np.ndarray:
        """One unsigned 64-bit number per word, computed once per distinct word."""
        per_value = np.fromiter(map(hash_one, self.values), np.uint64, len(self.values))
        return per_value[self.codes]

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def translated(texts: pa.StringArray, table: bytes | None) -> pa.StringArray:
    """Map every byte of the texts; null becomes empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if table is None or len(texts) == 0:
        return texts
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = raw[int(offsets[0]):int(offsets[-1])].to_pybytes() if raw is not None else b""
    return pa.StringArray.from_buffers(
        len(texts), pa.py_buffer(np.ascontiguousarray(offsets - offsets[0])), pa.py_buffer(data.translate(table)))


def split_words(texts: pa.StringArray, table: bytes | None = None) -> Words:
    """Words between ASCII white space, after mapping bytes by ``table``.  Null and blank texts have none."""
    lists = pc.ascii_split_whitespace(translated(texts, table))
    flat, starts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    coded = flat.dictionary_encode()
    codes, values = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.cast(pa.binary()).to_pylist()
    if b"" in values:
        real = codes != values.index(b"")
        starts = np.concatenate([[0], np.cumsum(real)])[starts]
        codes = codes[real]
    return Words(starts, codes, values)


def slices(texts: pa.StringArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield lo, hi
        lo = hi


def windows(hashes: np.ndarray, width: int, factor: int) -> np.ndarray:
    """Polynomial hash of every ``width`` consecutive numbers modulo 2**64, by doubling.

    Windows run over the ends of texts; callers mask those.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, covered = np.zeros(n, np.uint64), 0
    block, size, power = hashes.astype(np.uint64), 1, factor % (1 << 64)
    while True:
        if width & size:
            total *= np.uint64(power)
            total += block[covered:covered + n]
            covered += size
        if covered == width:
            return total
        block = block[:-size] * np.uint64(power) + block[size:]
        power, size = power * power % (1 << 64), size * 2


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of the numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def per_text(
    docs: DataFrame, keep: list[str], text: str, fields: list[tuple[str, T.DataType]],
    make: Callable[[], Callable[[pa.StringArray], list]],
) -> DataFrame:
    """Columns ``keep`` of every row with ``fields`` computed from its text, in slices of bounded size.

    ``make`` runs once in each task and gives the function that turns a slice of texts into one array (or list) per field.
    """
    clash = sorted(set(keep) & {n for n, _ in fields})
    if clash:
        raise ValueError(f"columns {clash} are results of this operator; rename them or leave them out of keep")
    kept = docs.select(*keep).schema.fields
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in fields)])
    n_kept = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        made, out = make(), to_arrow_schema(schema)
        for batch in batches:
            texts = batch.column(n_kept)
            for lo, hi in slices(texts):
                new = made(texts.slice(lo, hi - lo))
                arrays = [batch.column(i).slice(lo, hi - lo) for i in range(n_kept)]
                arrays += [
                    a if isinstance(a, pa.Array) else pa.array(a, out.field(n_kept + i).type) for i, a in enumerate(new)]
                yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    return docs.select(*keep, docs[text].alias("_text")).mapInArrow(run, schema)
