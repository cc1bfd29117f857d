"""Words of whole Arrow string columns as NumPy arrays, without a Python string per word.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. Its 64-bit hash is a
polynomial over random byte codes, taken from prefix sums modulo 2**64, so the
cost is a few array passes per chunk of text whatever the words are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS["n"] < n:
        size = max(n, CHUNK_BYTES + 1)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
        _POWERS["n"] = size
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``size`` bytes of text each, and one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    at, n = 0, batch.num_rows
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte runs, given by their places in ``data``."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


def row_and_text(docs: DataFrame) -> DataFrame:
    """Whole rows as ``_row``, whatever their columns are called, and their texts; a text that is a string goes along once, inside the row."""
    inside = isinstance(docs.schema["text"].dataType, T.StringType)
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), (F.lit(None) if inside else F.col("text")).cast("string").alias("text"))


def with_text(batch: pa.RecordBatch, name: str) -> pa.RecordBatch:
    """A batch whose column ``name`` holds the texts: those inside ``_row`` where all are null outside."""
    if "_row" in batch.schema.names and batch.column(name).null_count == batch.num_rows and pa.types.is_struct(batch.schema.field("_row").type):
        text = pc.struct_field(batch.column("_row"), "text")
        if pa.types.is_string(text.type) or pa.types.is_large_string(text.type):
            return batch.set_column(batch.schema.get_field_index(name), name, text)
    return batch


class Words:
    """Words of the rows of a string column: ``hash`` per word, ``first`` with the rows' word offsets."""

    def __init__(self, col: pa.Array, lower: bool = False):
        data, self.offsets = buffers(col)
        self.data = data = _LOWER[data] if lower else data
        n = len(data)
        solid = ~_SPACE[data]
        inner = self.offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        before = np.empty(n, bool)
        before[1:], before[:1] = solid[:-1], False
        before[inner] = False
        after = np.empty(n, bool)
        after[:-1], after[-1:] = solid[1:], False
        after[inner - 1] = False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)
        self.solid = solid

    def hashes(self) -> np.ndarray:
        return hashes(self.data, self.start, self.end)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


_PLACES = np.random.default_rng(77).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def windows(words: Words, width: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each window of ``width`` words within a row, in order.

    With ``short``, a row of fewer words (but one at least) gives one window over all its words.
    """
    h, rows, total = words.hashes(), words.rows(), len(words.start)
    n = max(0, total - width + 1)
    lin = np.zeros(n, np.uint64)
    for k in range(width):
        lin += h[k : k + n] * _PLACES[k]
    whole = rows[:n] == rows[width - 1 : width - 1 + n]
    out, at = mix(lin[whole]), rows[:n][whole]
    if short:
        few = np.flatnonzero((words.counts > 0) & (words.counts < width))
        if len(few):
            own = [int((h[words.first[r] : words.first[r + 1]] * _PLACES[: words.counts[r]]).sum(dtype=np.uint64)) ^ (int(words.counts[r]) << 56) for r in few]
            out, at = np.concatenate([out, mix(np.array(own, np.uint64))]), np.concatenate([at, few])
            order = np.argsort(at, kind="stable")
            out, at = out[order], at[order]
    return out, at


def row_sets(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row, flat, with the rows' offsets."""
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    flat = hashes.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        flat[a:b].sort()
    fresh = np.ones(len(flat), bool)
    fresh[1:] = (flat[1:] != flat[:-1]) | (rows[1:] != rows[:-1])
    return flat[fresh], np.searchsorted(rows[fresh], np.arange(n_rows + 1))
