"""Periodic runs of words, found by block convolution.

A run is a maximal stretch of words with smallest period ``q`` and a length of at least ``max(min_length, powers * q)``.
The scales are the powers of two. A run with a period from ``B`` to ``2B - 1`` holds one of the blocks that start at the multiples of ``B``,
at most ``B`` words after its own start, and a copy of that block ``q`` words later. At each scale a number-theoretic
transform gives, for every block and every distance, the sum of squared differences of the word codes modulo a prime; it is
zero wherever block and copy agree. Zeros are seeds: they are verified word by word over two periods, and joined and extended to
both sides. No distance is left out, so every run is found.

Blocks of more than ``_BLOCK`` words are cut to their first ``_BLOCK``, and the distances of a scale go through windows of
twice that length, so a transform never grows with the text and all windows of a slice of texts are transformed together. Blocks
inside a run already known to reach two of the longest distances further are left out: a longer period there is not the smallest.

A text is one row and no rows are exchanged. Words are compared by 64-bit hashes of their bytes. Defined cases: a null text counts
as empty and has no words, no runs and the hashes of an empty string; a null id never has its words replaced; equal
rows get equal results; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import arrays

U64 = np.uint64
RESULT = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, n_dropped long, runs_sha256 string, collapsed_sha256 string"
)
_BLOCK = 128
_CELLS = 1 << 17
_PRIME = 998244353
_P, _PP = U64(_PRIME), U64(2 * _PRIME)
_MAGIC = U64((1 << 62) // _PRIME)


@dataclass(frozen=True)
class Rules:
    powers: int = 4
    min_length: int = 6


def _reduce(t: np.ndarray) -> np.ndarray:
    """A number below ``4 * P * P`` to the same residue below ``2 * P``."""
    t = t - ((t >> U64(30)) * _MAGIC >> U64(32)) * _P
    return np.minimum(t, t - _PP)


def _tables(inverse: bool) -> dict[int, np.ndarray]:
    out, half = {}, 1
    while half <= _BLOCK:
        root = pow(3, (_PRIME - 1) // (2 * half), _PRIME)
        root = pow(root, -1, _PRIME) if inverse else root
        out[half] = np.array([pow(root, k, _PRIME) for k in range(half)], U64)[None, :, None]
        half *= 2
    return out


_ROOTS, _BACK = _tables(False), _tables(True)


def transform(x: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of every column, in place; the result is in bit-reversed order and below ``2 * P``."""
    half = len(x) // 2
    while half:
        pair = x.reshape(-1, 2, half, x.shape[1])
        a, b = pair[:, 0].copy(), pair[:, 1]
        total, rest = a + b, a + (_PP - b)
        pair[:, 0] = np.minimum(total, total - _PP)
        pair[:, 1] = _reduce(rest * _ROOTS[half])
        half //= 2
    return x


def restore(x: np.ndarray) -> np.ndarray:
    """Inverse of :func:`transform`, in place, residues below ``P``."""
    half = 1
    while half < len(x):
        pair = x.reshape(-1, 2, half, x.shape[1])
        a, b = pair[:, 0].copy(), _reduce(pair[:, 1] * _BACK[half])
        total, rest = a + b, a + (_PP - b)
        pair[:, 0] = np.minimum(total, total - _PP)
        pair[:, 1] = np.minimum(rest, rest - _PP)
        half *= 2
    x = _reduce(x * U64(pow(len(x), -1, _PRIME)))
    return np.minimum(x, x - _P)


def _zeros(codes: np.ndarray, squares: np.ndarray, at: np.ndarray, far: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds: row and distance of the zero mismatches of blocks at ``at`` with copies ``far`` to ``far + block - 1`` further on."""
    size, last = 2 * block, len(codes) - 1
    own, place = np.unique(at, return_inverse=True)
    blocks = np.zeros((size, len(own)), U64)
    blocks[:block] = codes[own + np.arange(block - 1, -1, -1)[:, None]]
    windows = codes[np.minimum(at + far + np.arange(size)[:, None], last)]
    cross = restore(_reduce(transform(windows) * transform(blocks)[:, place]))[block - 1: size - 1]
    begin = np.minimum(at + far + np.arange(block)[:, None], last + 1)
    power = squares[np.minimum(begin + block, last + 1)] - squares[begin] + (squares[at + block] - squares[at])
    shift, row = np.nonzero(power % _P == cross * U64(2) % _P)
    return row, far[row] + shift


def _verified(words: np.ndarray, at: np.ndarray, far: np.ndarray, block: int) -> np.ndarray:
    """Which seeds agree in all of the ``far + block`` words from the block on."""
    ok = (words[at] == words[at + far]) & (words[at + far + block - 1] == words[at + 2 * far + block - 1]) & (words[at + far // 2] == words[at + far // 2 + far])
    live = np.flatnonzero(ok)
    sizes = far[live] + block
    first = 0
    ends = np.cumsum(sizes)
    while first < len(live):
        done = ends[first - 1] if first else 0
        until = max(first + 1, int(np.searchsorted(ends, done + (1 << 20), "right")))
        part = live[first:until]
        size = sizes[first:until]
        start = np.cumsum(size) - size
        place = np.repeat(at[part] - start, size) + np.arange(size.sum())
        ok[part] = np.logical_and.reduceat(words[place] == words[place + np.repeat(far[part], size)], start)
        first = until
    return ok


def _agree(words: np.ndarray, a: int, b: int, limit: int, step: int) -> int:
    """How many words from ``a`` and ``b`` on agree, going by ``step`` (1 or -1), at most ``limit``."""
    done, size = 0, 16
    while done < limit:
        size = min(size, limit - done)
        x, y = a + step * done, b + step * done
        left, right = (words[x: x + size], words[y: y + size]) if step > 0 else (words[x - size + 1: x + 1][::-1], words[y - size + 1: y + 1][::-1])
        same = left == right
        if not same.all():
            return done + int(np.argmin(same))
        done += size
        size *= 4
    return limit


class _Known:
    """Runs found so far; ``reach`` tells how far a run that covers a place goes on."""

    def __init__(self) -> None:
        self.runs: dict[tuple[int, int], int] = {}
        self.starts = self.ends = np.zeros(0, np.int64)

    def add(self, start: int, end: int, period: int) -> None:
        self.runs.setdefault((start, end), period)

    def settle(self) -> None:
        spans = np.array(sorted(self.runs), np.int64).reshape(-1, 2)
        self.starts, self.ends = spans[:, 0], np.maximum.accumulate(spans[:, 1]) if len(spans) else spans[:, 1]

    def reach(self, at: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(len(at), np.int64)
        i = np.searchsorted(self.starts, at, "right")
        return np.where(i > 0, self.ends[np.maximum(i - 1, 0)], 0)


def find_runs(words: np.ndarray, offsets: np.ndarray, rules: Rules = Rules()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs of a slice of texts, by start, then period.

    ``words`` are 64-bit word hashes of all texts, ``offsets`` the ``n + 1`` places of their first words.
    """
    if rules.powers < 4:
        raise ValueError("blocks of a scale only meet every run of four periods or more")
    known = _Known()
    sizes = np.diff(offsets)
    longest = int(sizes.max()) if len(sizes) else 0
    stop, begin = np.repeat(offsets[1:], sizes), np.repeat(offsets[:-1], sizes)
    codes = words % _P
    squares = np.zeros(len(words) + 1, U64)
    np.cumsum(codes * codes % _P, out=squares[1:])
    scale = 1
    while rules.powers * scale <= longest:
        block = min(scale, _BLOCK)
        at = np.arange(0, len(words), scale)
        at = at[(at + block + 2 * scale <= stop[at]) & (known.reach(at) < at + 4 * scale)]
        shift = np.arange(scale, 2 * scale, block)
        seeds = []
        rows = max(1, _CELLS // (2 * block))
        group = max(1, rows // len(shift))
        for i in range(0, len(at), group):
            block_at = np.repeat(at[i: i + group], len(shift))
            far = np.tile(shift, len(at[i: i + group]))
            fits = block_at + block + 2 * far <= stop[block_at]
            block_at, far = block_at[fits], far[fits]
            for j in range(0, len(far), rows):
                row, distance = _zeros(codes, squares, block_at[j: j + rows], far[j: j + rows], block)
                seed_at = block_at[j: j + rows][row]
                new = (seed_at + block + 2 * distance <= stop[seed_at]) & (known.reach(seed_at) < seed_at + 2 * distance)
                seed_at, distance = seed_at[new], distance[new]
                ok = _verified(words, seed_at, distance, block)
                seeds.append((seed_at[ok], distance[ok]))
        if seeds:
            _extend(words, np.concatenate([s[0] for s in seeds]), np.concatenate([s[1] for s in seeds]), block, begin, stop, rules, known)
        scale *= 2
    found = np.array(sorted((s, q, e) for (s, e), q in known.runs.items()), np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 2], found[:, 1]


def _extend(words, at, far, block, begin, stop, rules: Rules, known: _Known) -> None:
    """Seeds of one distance that overlap by a period are one stretch; each is extended as far as the period holds."""
    if not len(at):
        return
    order = np.lexsort((at, far))
    at, far = at[order], far[order]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (far[1:] != far[:-1]) | (at[1:] > at[:-1] + block + far[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(at)) - 1
    past = -1, -1
    for start, end, q in zip(at[first].tolist(), (at[last] + block + 2 * far[last]).tolist(), far[first].tolist()):
        if past[0] == q and end <= past[1]:
            continue
        low, high = int(begin[start]), int(stop[start])
        start -= _agree(words, start - 1, start - 1 + q, start - low, -1)
        end += _agree(words, end - q, end, high - end, 1)
        past = q, end
        if end - start >= max(rules.min_length, rules.powers * q):
            known.add(start, end, q)
    known.settle()


def _periodic(ids: list, offsets: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """The word that stands at each place after the words of some texts are replaced by a repeated stretch."""
    source = np.arange(offsets[-1])
    for i, key in enumerate(ids):
        n = int(n_words[i])
        h = zlib.crc32(str(key).encode()) if key is not None else 1
        if h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        source[offsets[i] + a: offsets[i + 1]] = offsets[i] + a + np.arange(n - a) % p
    return source


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of greatest length over period; the first of equals in the given order."""
    top = runs[0]
    for run in runs[1:]:
        if run[1] * top[2] > top[1] * run[2]:
            top = run
    return top


def _joined(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> str:
    digest = hashlib.sha256()
    for i in range(0, len(starts), 1 << 16):
        if i:
            digest.update(b" ")
        digest.update(b" ".join([raw[s:e] for s, e in zip(starts[i: i + (1 << 16)].tolist(), ends[i: i + (1 << 16)].tolist())]))
    return digest.hexdigest()


def _batches(rules: Rules, planted: bool):
    names = [c.split(" ")[0] for c in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrays.slices(whole, "text"):
                ids = batch.column("doc_id").to_pylist()
                data, offsets = arrays.text_bytes(batch.column("text"))
                starts, ends, first = arrays.word_bounds(data, offsets)
                hashes = arrays.span_hash(data, starts, ends)
                if planted:
                    source = _periodic(ids, first, np.diff(first))
                    starts, ends, hashes = starts[source], ends[source], hashes[source]
                run_start, run_end, period = find_runs(hashes, first, rules)
                edge = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(edge, run_start + period, 1)
                np.add.at(edge, run_end, -1)
                kept = np.cumsum(edge[:-1]) == 0
                bounds = np.searchsorted(run_start, first)
                raw = data.tobytes()
                rows = []
                for i, key in enumerate(ids):
                    a, b = first[i], first[i + 1]
                    own = slice(bounds[i], bounds[i + 1])
                    runs = list(zip((run_start[own] - a).tolist(), (run_end[own] - run_start[own]).tolist(), period[own].tolist()))
                    stay = kept[a:b]
                    top = _best(runs) if runs else (None, None, None)
                    rows.append((
                        key, int(b - a), len(runs), *top, 1000 * top[1] // top[2] if runs else None, int((~stay).sum()),
                        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), _joined(raw, starts[a:b][stay], ends[a:b][stay])))
                types = [pa.int64()] * 8 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def periodic_runs(docs: DataFrame, rules: Rules = Rules(), planted: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of every whole text: their number, the one of greatest exponent, digests of all runs and of the text without repeats.

    A word is dropped if a run contains it after that run's first period. ``planted`` first replaces the words of one text in ten, chosen by
    its id, from some place on by repetitions of a stretch of the text, as the registered query asks.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_batches(rules, planted), RESULT)


def runs_table(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per run: doc_id, start, length, period (in words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrays.slices(whole, "text"):
                data, offsets = arrays.text_bytes(batch.column("text"))
                starts, ends, first = arrays.word_bounds(data, offsets)
                start, end, period = find_runs(arrays.span_hash(data, starts, ends), first, rules)
                row = np.searchsorted(first, start, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row)), arrays.as_long(start - first[row]), arrays.as_long(end - start), arrays.as_long(period)],
                    names=["doc_id", "start", "length", "period"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, start long, length long, period long")
