"""Numpy helpers that work on a block of texts inside one task.

A block is the concatenated UTF-8 bytes of some rows (``buf``) and where each
row begins (``offs``, one longer than the rows).  Nulls are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task works on at a time.
BLOCK_BYTES = 4 << 20

_rng = np.random.default_rng(20260101)
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODE_LOWER = _BYTE_CODE[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def utf8_view(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and row offsets of a string column, without copying where possible."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def text_blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Regroup Arrow batches so that each holds about ``limit`` bytes of ``column``."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = utf8_view(batch.column(column))
        at = 0
        while at < batch.num_rows:
            room = max(0, limit - size)
            to = int(np.searchsorted(offs, offs[at] + room, "right")) - 1
            to = min(batch.num_rows, max(to, at + (not held)))
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(offs[to] - offs[at])
                at = to
            if at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


class _Powers:
    """Powers of an odd base modulo 2**64, and of its inverse."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << max(16, int(n - 1).bit_length())
            inverse = pow(_BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                cls.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE, np.uint64)], dtype=np.uint64)
                cls.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, inverse, np.uint64)], dtype=np.uint64)
        return cls.up, cls.down


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, step: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of ascending disjoint byte spans; ``lower`` folds A-Z."""
    table = _BYTE_CODE_LOWER if lower else _BYTE_CODE
    out = np.empty(len(starts), np.uint64)
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + step)))
            base, top = int(starts[lo]), int(ends[hi - 1])
            up, down = _Powers.upto(top - base + 1)
            sums = np.empty(top - base + 1, np.uint64)
            sums[0] = 0
            np.cumsum(table[buf[base:top]] * up[: top - base], out=sums[1:])
            s, e = starts[lo:hi] - base, ends[lo:hi] - base
            out[lo:hi] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
            lo = hi
    return mix64(out)


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs free of ASCII white space, and each row's first word."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    ink = ~_SPACE[buf]
    begins = ink.copy()
    begins[1:] &= ~ink[:-1]
    edges = offs[:-1][offs[:-1] < offs[1:]]
    begins[edges] = ink[edges]
    stops = ink
    stops[:-1] &= ~ink[1:] | begins[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offs)


def ragged(values: np.ndarray, firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``values[f:f+c]`` for each pair of ``firsts`` and ``counts``, end to end."""
    counts = counts.astype(np.int64)
    total = int(counts.sum())
    at = np.cumsum(counts) - counts
    index = np.repeat((firsts - at).astype(np.int32 if len(values) < 2**31 and total < 2**31 else np.int64), counts)
    index += np.arange(total, dtype=index.dtype)
    return values[index]


def runs(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last places of the runs of true values."""
    edge = np.zeros(len(mark) + 2, np.int8)
    edge[1:-1] = mark
    at = np.flatnonzero(np.diff(edge))
    return at[::2], at[1::2]
