"""Removal of repeated word passages by recompression.

A text's words become symbols. First runs of one word, then, round by round, pairs of a left and a right symbol get new names;
which symbols are left or right is drawn by name and round. Names are 64-bit hashes of what they stand for, so a pair has the
same name wherever it occurs and no dictionary is exchanged. A name depends on its words and on a few around them (its
context); equal passages therefore share the names whose context they contain.

Each window of ``width`` words picks, among the highest-level names whose context it contains, the one of least hash: a choice that
depends on the window's words alone. Names picked by several windows make one row, about one for a dozen words. Spark
counts these rows by name: a name that occurs once ends there. Places of equal name whose whole stretch is equal
are repeats at once; the rest is decided window by window, by name and window hash (128 bits together).

Counts are aggregated before they are exchanged and joined back to the places with Spark's skew handling, so a passage in a
third of all documents is split. Defined cases: a null or empty text has no words; documents with equal id and text are
treated as separate places of the same words; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import arrays
from strandloom.llm.storage import Tables

_PLACES = "doc_id long, hash int, first int, last int, name long, stretch long"
_WINDOWS = "doc_id long, hash int, at int, name long, window long"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
U64 = np.uint64


class Level:
    """Names of one round: symbol, first word, and the words that the name depends on (end exclusive)."""

    def __init__(self, symbol, start, text, left, right):
        self.symbol, self.start, self.text, self.left, self.right = symbol, start, text, left, right


def _runs(hashes: np.ndarray, text: np.ndarray, offsets: np.ndarray) -> Level:
    """Runs of one word become one name; a name must see the words beside it."""
    n = len(hashes)
    new = np.ones(n, bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    symbol = np.where(size == 1, hashes[start], arrays.mix(hashes[start] + size.astype(U64) * U64(0xA0761D6478BD642F)))
    # A text's edge counts as unseen: the place before its first word and the one after its last lie outside any window.
    return Level(symbol, start, text[start], start - 1, start + size + 1)


def _pairs(level: Level, seed: int, offsets: np.ndarray) -> Level:
    """Merge every left symbol with a right symbol after it."""
    sym, text = level.symbol, level.text
    n = len(sym)
    is_left = (arrays.mix(sym ^ U64(seed * 0x9E3779B9 + 1)) & U64(1)).astype(bool)
    inside = text[1:] == text[:-1]
    merge = np.zeros(n, bool)
    merge[:-1] = is_left[:-1] & ~is_left[1:] & inside
    taken = np.zeros(n, bool)
    taken[1:] = merge[:-1]
    left, right = level.left.copy(), level.right.copy()
    # A lone left symbol saw what follows it, a lone right symbol what precedes it; merged ones see each other.
    look = is_left & ~merge
    has = np.zeros(n, bool)
    has[:-1] = inside
    after = np.append(level.right[1:], 0)
    right = np.where(look, np.where(has, np.maximum(right, after), offsets[text + 1] + 1), right)
    right[:-1] = np.where(merge[:-1], level.right[1:], right[:-1])
    has = np.zeros(n, bool)
    has[1:] = inside
    before = np.append(0, level.left[:-1])
    left = np.where(~is_left & ~taken, np.where(has, np.minimum(left, before), offsets[text] - 1), left)
    joined = arrays.mix(sym[:-1] * U64(0xE7037ED1A0B428DB) + arrays.mix(sym[1:] + U64(seed)))
    symbol = sym.copy()
    symbol[:-1] = np.where(merge[:-1], joined, symbol[:-1])
    keep = ~taken
    return Level(symbol[keep], level.start[keep], text[keep], left[keep], right[keep])


def levels(hashes: np.ndarray, offsets: np.ndarray, rounds: int) -> list[Level]:
    """Names after the run round and after each pair round."""
    text = arrays.owner(offsets)
    out = [_runs(hashes, text, offsets)]
    for t in range(rounds):
        out.append(_pairs(out[-1], t + 1, offsets))
    return out


class Spans:
    """Hashes of any span of words, from hashes of spans of a power of two."""

    def __init__(self, hashes: np.ndarray, longest: int):
        self.table = [arrays.mix(hashes)]
        while 2 ** len(self.table) <= longest:
            half = 2 ** (len(self.table) - 1)
            last = self.table[-1]
            grown = np.zeros(len(hashes), U64)
            if len(hashes) > half:
                grown[:-half] = arrays.mix(last[:-half] * U64(0xC2B2AE3D27D4EB4F) + last[half:])
            self.table.append(grown)

    def hash(self, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
        size = end - start
        out = np.empty(len(start), U64)
        power = np.frexp(size.astype(float))[1] - 1
        for k in np.unique(power):
            own = np.flatnonzero(power == k)
            row = self.table[k]
            out[own] = row[start[own]] * U64(0x9FB21C651E98DF25) + arrays.mix(row[end[own] - 2**int(k)] + U64(seed))
        return arrays.mix(out + size.astype(U64))


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the least value in each range lo..hi (inclusive); the first of equal ones."""
    bits = max(1, int(len(values)).bit_length())
    packed = (values >> U64(bits) << U64(bits)) | np.arange(len(values), dtype=U64)
    table = [packed]
    size = hi - lo + 1
    while 2 ** len(table) <= int(size.max(initial=1)):
        half = 2 ** (len(table) - 1)
        grown = table[-1].copy()
        grown[:-half] = np.minimum(table[-1][:-half], table[-1][half:])
        table.append(grown)
    power = np.frexp(size.astype(float))[1] - 1
    out = np.empty(len(lo), U64)
    for k in np.unique(power):
        own = np.flatnonzero(power == k)
        out[own] = np.minimum(table[k][lo[own]], table[k][hi[own] - 2**int(k) + 1])
    return (out & U64((1 << bits) - 1)).astype(np.int64)


def places(hashes: np.ndarray, offsets: np.ndarray, width: int, rounds: int) -> tuple[np.ndarray, ...]:
    """Text, first and last window, name and stretch hash of every run of windows that picked one name."""
    text = arrays.owner(offsets)
    n = max(0, len(hashes) - width + 1)
    window = np.flatnonzero(text[:n] == text[width - 1: width - 1 + n]) if n else np.zeros(0, np.int64)
    if not len(window):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(U64), none.astype(U64)
    spans = Spans(hashes, 2 * width)
    name = np.zeros(len(window), U64)
    pick = np.full(len(window), -1, np.int64)
    for t, level in reversed(list(enumerate(levels(hashes, offsets, rounds)))):
        open_ = np.flatnonzero(pick < 0)
        if not len(open_):
            break
        lo = np.searchsorted(level.left, window[open_])
        hi = np.searchsorted(level.right, window[open_] + width, "right") - 1
        some = lo <= hi
        open_, lo, hi = open_[some], lo[some], hi[some]
        if not len(open_):
            continue
        first, last = int(lo.min()), int(hi.max()) + 1
        known = np.zeros(last - first, U64)
        short = np.flatnonzero((level.right[first:last] - level.left[first:last]) <= width)
        short = short[(level.left[first:last][short] >= 0) & (level.right[first:last][short] <= len(hashes))]
        known[short] = spans.hash(level.left[first:last][short], level.right[first:last][short], t)
        known = arrays.mix(known ^ level.symbol[first:last])
        best = _least(known, lo - first, hi - first)
        name[open_] = known[best]
        pick[open_] = (np.int64(t) << 40) + best + first
    # A window that no name fits (it lies in one long run) stands for itself.
    rest = np.flatnonzero(pick < 0)
    name[rest] = spans.hash(window[rest], window[rest] + width, 77)
    pick[rest] = -1 - window[rest]
    new = np.ones(len(window), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (window[1:] != window[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(window)) - 1
    first, last = window[begin], window[end]
    # Windows that share a name start within ``width`` words, so a stretch has fewer than 2 * width.
    return text[first], first, last, name[begin], spans.hash(first, last + width, 1)


def _find_places(width: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrays.slices(whole, "text", 2 << 20):
                data, offsets = arrays.text_bytes(batch.column("text"))
                starts, ends, words = arrays.word_bounds(data, offsets)
                text, first, last, name, stretch = places(arrays.span_hash(data, starts, ends), words, width, rounds)
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(at), batch.column("hash").take(at), pa.array((first - words[text]).astype(np.int32)),
                    pa.array((last - words[text]).astype(np.int32)), arrays.as_long(name), arrays.as_long(stretch)],
                    names=["doc_id", "hash", "first", "last", "name", "stretch"])

    return run


def _find_windows(width: int):
    """Window hashes of the listed stretches of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrays.slices(whole, "text", 2 << 20):
                data, offsets = arrays.text_bytes(batch.column("text"))
                starts, ends, words = arrays.word_bounds(data, offsets)
                hashed = arrays.window_hash(arrays.span_hash(data, starts, ends), width, 5)
                lists = batch.column("ranges")
                row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                first, last, name = (lists.flatten().field(k).to_numpy() for k in ("first", "last", "name"))
                size = (last - first + 1).astype(np.int64)
                at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
                row, name = np.repeat(row, size), np.repeat(name, size)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(take), batch.column("hash").take(take), pa.array(at.astype(np.int32)), pa.array(name),
                    arrays.as_long(hashed[words[row] + at])], names=["doc_id", "hash", "at", "name", "window"])

    return run


def _remove(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrays.slices(whole, "text", 2 << 20):
                n_words, removed, digest = [], [], []
                for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                    words = (text or "").encode().split()
                    kept = words
                    if ranges:
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, [r["first"] for r in ranges], 1)
                        np.add.at(edge, [r["last"] + width for r in ranges], -1)
                        kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                    n_words.append(len(words)), removed.append(len(words) - len(kept))
                    digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def repeated_windows(texts: DataFrame, width: int, rounds: int) -> DataFrame:
    """Stretches (first and last window) that occur elsewhere, by key and hash of the document.

    ``texts`` has _key, hash, doc_id and text. A name's rows meet only as counts and as a join with skew handling.
    """
    tables = Tables(texts.sparkSession)
    slim = texts.select(F.col("_key").alias("doc_id"), "hash", "text")
    spots = tables.store(slim.mapInArrow(_find_places(width, rounds), _PLACES), "places")
    shared = spots.groupBy("name").agg(F.count("*").alias("n"), F.min("stretch").alias("low"), F.max("stretch").alias("high")).where("n > 1").drop("n")
    spots = tables.store(spots.join(tables.store(shared, "names"), "name"), "shared")
    tables.drop("places", "names")
    alike = spots.where("low = high").select("doc_id", "hash", "first", "last")
    mixed = spots.where("low <> high").select("name", "stretch", "doc_id", "hash", "first", "last")
    variants = tables.store(mixed.groupBy("name", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "hash", "first", "last")).alias("one")), "variants")
    again = mixed.join(variants.where("n > 1").select("name", "stretch"), ["name", "stretch"]).select("doc_id", "hash", "first", "last")
    # Of equal stretches one stands for all; its windows meet those of the other stretches of that name.
    ones = variants.select("one.*", "name", "n")
    lists = ones.groupBy("doc_id", "hash").agg(F.collect_list(F.struct("first", "last", "name")).alias("ranges"))
    windows = slim.join(lists, ["doc_id", "hash"]).mapInArrow(_find_windows(width), _WINDOWS)
    twice = windows.groupBy("name", "window").agg(F.count("*").alias("n")).where("n > 1").select("name", "window")
    single = windows.join(twice, ["name", "window"]).select("doc_id", "hash", F.col("at").alias("first"), F.col("at").alias("last"))
    return alike.unionByName(again).unionByName(tables.store(single, "windows"))


def remove_repeats(docs: DataFrame, width: int = 35, rounds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the words left after removing every word of a window that also starts elsewhere."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_key"), F.hash(text).alias("hash"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    found = repeated_windows(texts, width, rounds).groupBy(F.col("doc_id").alias("_key"), "hash").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    return texts.join(found, ["_key", "hash"], "left").select("doc_id", "text", "ranges").mapInArrow(_remove(width), RESULT)
