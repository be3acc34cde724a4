"""Numpy kernels over the bytes of a batch of texts. They run inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

#: Bytes of text that one kernel call holds; its temporaries take some 100 times as much at most.
SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, size=256, dtype=np.uint64) | _U(1)
_powers = {"up": np.ones(1, _U), "down": np.ones(1, _U)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Separators of words in `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Separators of words in `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing A-Z.
NON_ALNUM = np.ones(256, bool)
NON_ALNUM[0x30:0x3A] = NON_ALNUM[0x61:0x7B] = NON_ALNUM[0x80:] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        factors = np.full(max(n, SLICE_BYTES + 1), _BASE if kind == "up" else _BASE_INV, _U)
        factors[0] = 1
        _powers[kind] = np.multiply.accumulate(factors)
    return _powers[kind][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes, mod 2**64; see span_hash."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(_TABLE[data] * _power("up", len(data)), out=out[1:])
    return out


def sequence_prefix(items: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over hashes, for span_hash()."""
    out = np.zeros(len(items) + 1, _U)
    np.cumsum(items * _power("up", len(items)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end); equal spans have equal hashes."""
    raw = (prefix[end] - prefix[start]) * _power("down", len(prefix))[start]
    return mix(raw + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    first, last = (offsets[0], offsets[-1]) if len(offsets) else (0, 0)
    bytes_ = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return bytes_, offsets - first


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about ``limit`` bytes of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = texts(batch.column(batch.schema.get_field_index(column)))
        low = 0
        while low < batch.num_rows:
            high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
            high = min(max(high, low + 1), batch.num_rows)
            yield batch.slice(low, high - low)
            low = high


def arrow_map(function: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str, limit: int = SLICE_BYTES) -> Callable:
    """For mapInArrow: ``function`` on slices of bounded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, column, limit):
            out = function(part)
            if out is not None and out.num_rows:
                yield out

    return run


def as_row(columns: list[str]) -> Column:
    """Columns of the caller in one, named row, so that none clashes with ours."""
    return F.struct(*[F.col(f"`{c}`").alias(c) for c in columns] or [F.lit(0).alias("none")]).alias("row")


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the index of its first word (one more entry at the end)."""
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each word (or other item), from words()' third result."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sequence_hash(items: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive items (len(items) - k + 1 of them)."""
    n = len(items) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for i in range(k):
        out = out * _U(0x5851F42D4C957F2D) + items[i : i + n]
    return mix(out + _U(k))
