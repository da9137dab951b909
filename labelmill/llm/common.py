"""Helpers of the operators: staged tables, text in chunks of bounded size, and word hashes computed over whole buffers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.session import shared_dir

CHUNK_BYTES = 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to the shared folder and read back: later readers neither compute them again nor depend on executors that made them."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, parts: int) -> Column:
    """The part of ``parts`` that a document falls into; null for a null id."""
    return F.crc32(doc_id.cast("string")) % parts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finisher)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and where each begins (and the last ends). Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunked(batches: Iterable[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: each holds one row, or texts of at most ``most`` bytes in all."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.nan_to_num(pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        ends, begin = np.cumsum(sizes), 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _base_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each. The longest up to four million are kept."""
    if _powers and len(_powers[0][0]) >= n:
        return _powers[0]
    size = 1 << max(19, int(n).bit_length())

    def powers(base: np.uint64) -> np.ndarray:
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out)

    made = powers(_BASE), powers(_BASE_INVERSE)
    if size <= 1 << 22:
        _powers[:] = [made]
    return made


def word_spans(data: np.ndarray, at: np.ndarray, apart: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word of every text (no word spans two texts), and the number of the first word of each text, closed by the total."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~apart[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    edges = at[(at > 0) & (at < len(data))]
    before[edges] = False
    begins = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return begins, ends, np.searchsorted(begins, at)


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, fold_case: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z as a-z): differences of one running polynomial, mixed."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    power, inverse = _base_powers(len(data))
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((LOWER[data] if fold_case else data).astype(np.uint64) * power[: len(data)] + power[: len(data)], out=running[1:])
    return mix((running[ends] - running[begins]) * inverse[begins] ^ ((ends - begins).astype(np.uint64) << np.uint64(56)))
