"""Vectorised helpers on Arrow batches of texts: bytes, words and their hashes.

A text is seen as UTF-8 bytes; a null text has none. Words are maximal runs of bytes other than space and
``\\t \\n \\v \\f \\r``. Hashes depend on content alone, so equal content has equal hashes in every task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
_POW = _powers(_BASE, _BLOCK)
_INV = _powers(pow(_BASE, -1, 1 << 64), _BLOCK)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a string or binary column, and ``n + 1`` offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset: column.offset + len(column) + 1] if at else np.zeros(1, np.int64)
    if data is None or len(offsets) == 1:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    whole = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]]
    return whole, offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and ``n + 1`` offsets of the texts' first words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    white = WHITE[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, white[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, white[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = True
    after[offsets[1:][full] - 1] = True
    starts = np.flatnonzero(before & ~white)
    ends = np.flatnonzero(after & ~white) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; spans are in order of their starts.

    Works in blocks, so memory does not grow with the text. The length of a span alone decides how it is hashed: half a block
    or more by xxh3, less by a polynomial, wherever it lies.
    """
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        first = starts[i]
        j = int(np.searchsorted(starts, first + _BLOCK // 2, "left"))
        if int(ends[i:j].max()) - first >= _BLOCK:
            for k in range(i, j):
                if ends[k] - starts[k] >= _BLOCK // 2:
                    out[k] = xxhash.xxh3_64_intdigest(data[starts[k]: ends[k]].tobytes())
                else:
                    part = _TABLE[data[starts[k]: ends[k]]]
                    out[k] = (part * _POW[: len(part)]).sum(dtype=U64)
        else:
            last = int(ends[i:j].max())
            part = np.zeros(last - first + 1, U64)
            np.cumsum(_TABLE[data[first:last]] * _POW[: last - first], out=part[1:])
            a, b = starts[i:j] - first, ends[i:j] - first
            out[i:j] = (part[b] - part[a]) * _INV[a]
            for k in i + np.flatnonzero(ends[i:j] - starts[i:j] >= _BLOCK // 2):
                out[k] = xxhash.xxh3_64_intdigest(data[starts[k]: ends[k]].tobytes())
        i = j
    return mix(out + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return data + (upper.view(np.uint8) << 5)


def window_hash(items: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``width`` consecutive items (``len - width + 1`` of them), by doubling."""
    n = len(items) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    power, done, out = mix(items ^ U64(seed)) if seed else items, 0, None
    size = 1
    rest = width
    while rest:
        if rest & 1:
            part = power[done: done + n]
            out = part if out is None else mix(out * U64(0x9FB21C651E98DF25) + part)
            done += size
        rest >>= 1
        if rest:
            power = mix(power[:-size] * U64(0xC2B2AE3D27D4EB4F) + power[size:])
            size *= 2
    return out


def owner(offsets: np.ndarray) -> np.ndarray:
    """Index of the text that each item belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def slices(batch: pa.RecordBatch, text: str, limit: int = 4 << 20):
    """Cut a batch into parts of about ``limit`` bytes of text; one row is never cut."""
    sizes = np.diff(text_bytes(batch.column(text))[1])
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    if batch.num_rows > start:
        yield batch.slice(start)


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == U64 else x.astype(np.int64), pa.int64())
