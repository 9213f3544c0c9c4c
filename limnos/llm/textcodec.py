"""Vectorised text primitives over Arrow string buffers.

Everything works on the UTF-8 bytes of many documents at once: a chunk is one byte
array plus document offsets. Chunks hold about a megabyte, so memory stays bounded
whatever the batch; only a single longer document makes a longer chunk.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


_held: dict[str, object] = {}


def held(key: str, make):
    """One large table per worker process: asking for another key drops what was held, so stages never add up."""
    if key not in _held:
        _held.clear()
        gc.collect()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Give back what a worker process still holds of earlier stages: its table, and the memory that Arrow's pool and the C library keep free."""
    if _held:
        _held.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_array(column: pa.Array) -> pa.Array:
    """The column as 64-bit-offset strings; anything that is not text counts as empty."""
    return column.cast(pa.large_string()) if not pa.types.is_null(column.type) else pa.nulls(len(column), pa.large_string())


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets starting at 0) of a large_string array; null texts are empty."""
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, name: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Consecutive slices of a batch whose texts total about ``limit`` bytes at most."""
    column = text_array(batch.column(batch.schema.get_field_index(name)))
    _, at = buffer_of(column)
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo), column.slice(lo, hi - lo)
        lo = hi


def row_of(docs: DataFrame, but: str | None = None) -> Column:
    """All columns of a document as one struct named row, so that names of ours never clash with theirs."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != but], *([F.lit(1).alias("_")] if but else [])).alias("row")


def shape_with_row(df: DataFrame, rest: str) -> StructType:
    """The schema of a map that passes the column row through and adds the columns of ``rest``."""
    return StructType([StructField("row", df.schema["row"].dataType), *StructType.fromDDL(rest).fields])


def _class_table(pairs: list[tuple[int, int]]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in pairs:
        table[a : b + 1] = True
    return table


#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after folding A-Z: digits, a-z, all of non-ASCII.
FOLDED_WORD = _class_table([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20
#: Word bytes of `[^\x20\x09-\x0D]+`.
SPACE_WORD = ~_class_table([(0x20, 0x20), (0x09, 0x0D)])


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, _BASE, _U), np.full(n, _INVERSE, _U)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


class RollingHash:
    """64-bit polynomial hashes of any substring of one byte array, by prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        size = 1 << max(12, int(len(data) + 1).bit_length())
        up, self.down = _powers(size)
        self.sums = np.zeros(len(data) + 1, _U)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], dtype=_U, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, pointer): byte ranges of all words, and for each document the first of its words."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = word_bytes[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    cut = offsets[1:-1]
    before[cut] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside[1:]
    last = cut - 1
    after[last[last >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def folded_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, pointer by document) of the case-folded words."""
    data = FOLD[data]
    start, end, pointer = words(data, offsets, FOLDED_WORD)
    return RollingHash(data).of(start, end), pointer


def grams(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of n consecutive word hashes; shorter input gives none."""
    if len(hashes) < n:
        return np.zeros(0, _U)
    out = np.full(len(hashes) - n + 1, salt, _U)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _U(0xC2B2AE3D27D4EB4F) + hashes[k : len(hashes) - n + 1 + k]
    return mix(out)


def doc_of(pointer: np.ndarray) -> np.ndarray:
    """Document index of each word, from the pointer."""
    return np.repeat(np.arange(len(pointer) - 1), np.diff(pointer))
