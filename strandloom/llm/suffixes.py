"""Removal of repeated byte strings by a sampled, hash-compared suffix sort.

Every window of ``width`` bytes picks one suffix: the start of its least-hashed gram, so equal windows pick alike and about one
byte in twenty starts a sampled suffix. Suffixes meet by their gram. Where all stretches around one gram are equal, the
least id decides. The others are sorted: within a gram and offset, the suffixes that start at the windows are put in order by
a mergesort whose comparisons find the common extension of two suffixes by binary search over prefix polynomial
hashes, in logarithmic time. Most comparisons end at the first eight bytes. Neighbours that agree in ``width`` bytes are compared byte by byte,
and the least id of such a run of equal suffixes keeps its bytes. What does not go through the sort (a gram with equal stretches only, later copies of a
stretch, and very common grams) rests on 64-bit hashes of gram and stretch together, or on two hashes of the window.

Rows are combined before they are exchanged: of the equal grams of one slice of documents one row goes by its gram and the
others go anywhere. A gram with more than ``hot`` different stretches is not sorted in one task but decided by window
hashes that Spark aggregates. Defined cases: a null text counts as empty; a null id counts as the smallest; documents
with equal ids do not remove from each other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm import arrays
from strandloom.llm.storage import Tables

U64 = np.uint64
GRAM = 16
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_PLACES = "gram long, stretch long, id long, hash int, pos long"
_MARKS = "id long, hash int, first int, last int"

# A place in one long: first window, windows after it, offset of the gram from the first window, and how it travels.
ALONE, LEADER, FOLLOWER = 0, 1, 2


def pack(first, span, offset, state):
    return (first.astype(np.int64) << 16) | (span.astype(np.int64) << 9) | (offset.astype(np.int64) << 2) | state


def window_range() -> tuple[Column, Column]:
    """First and last window of a packed place."""
    return F.shiftright("pos", 16).cast("int").alias("first"), (F.shiftright("pos", 16) + F.shiftright("pos", 9).bitwiseAND(127)).cast("int").alias("last")


def grams(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes at each place, from prefix polynomial hashes."""
    n = len(data) - width + 1
    out = np.empty(max(n, 0), U64)
    step = arrays._BLOCK - width
    for a in range(0, max(n, 0), step):
        part = data[a: a + step + width - 1]
        total = np.zeros(len(part) + 1, U64)
        np.cumsum(arrays._TABLE[part] * arrays._POW[: len(part)], out=total[1:])
        m = len(part) - width + 1
        out[a: a + m] = (total[width: width + m] - total[:m]) * arrays._INV[:m]
    return arrays.mix(out)


def picks(hashes: np.ndarray, reach: int) -> np.ndarray:
    """Place of the least hash (the first of equal ones) among each run of ``reach`` places."""
    bits = max(1, int(len(hashes)).bit_length())
    least = (hashes >> U64(bits) << U64(bits)) | np.arange(len(hashes), dtype=U64)
    size = 1
    while size < reach:
        more = min(size, reach - size)
        least = np.minimum(least[:-more], least[more:])
        size += more
    return (least & U64((1 << bits) - 1)).astype(np.int64)


def sample(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Text, first window, last window, gram start and gram hash of every run of windows that picked one suffix."""
    n = len(data) - width + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(U64)
    hashes = grams(data, GRAM)
    chosen = picks(hashes, width - GRAM + 1)
    sizes = np.maximum(np.diff(offsets) - width + 1, 0)
    text = np.repeat(np.arange(len(sizes)), sizes)
    window = np.arange(int(sizes.sum())) + np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    if not len(window):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(U64)
    pick = chosen[window]
    new = np.ones(len(window), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(window)) - 1
    return text[begin], window[begin], window[end], pick[begin], hashes[pick[begin]]


def _find_places(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrays.slices(whole, "text", 2 << 20):
                data, offsets = arrays.text_bytes(batch.column("text"))
                text, first, last, pick, gram = sample(data, offsets, width)
                stretch = arrays.span_hash(data, first, last + width)
                ids = batch.column("id").to_numpy()[text]
                # Equal grams of different documents in this slice are known to be shared: one of them leads.
                order = np.lexsort((ids, gram))
                new = np.ones(len(order), bool)
                new[1:] = gram[order][1:] != gram[order][:-1]
                group = np.cumsum(new) - 1
                start = np.flatnonzero(new)
                low, high = ids[order][start], ids[order][np.append(start[1:], len(order)) - 1] if len(order) else ids[order]
                state = np.full(len(order), ALONE)
                state[order] = np.where(low[group] == high[group], ALONE, np.where(new, LEADER, FOLLOWER)) if len(order) else state
                yield pa.RecordBatch.from_arrays([
                    arrays.as_long(gram), arrays.as_long(stretch), pa.array(ids), batch.column("hash").take(pa.array(text)),
                    pa.array(pack(first - offsets[text], last - first, pick - first, state))], names=["gram", "stretch", "id", "hash", "pos"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by gram, those whose gram is found under several ids.

    The open last gram of a batch is carried on; once it is known to be shared, its rows go out at once.
    """
    carry: pa.Table | None = None
    known: int | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if carry is not None:
            table = pa.concat_tables([carry, table]).combine_chunks()
        if not table.num_rows:
            continue
        gram, ids = table.column("gram").to_numpy(), table.column("id").to_numpy()
        state = table.column("pos").to_numpy() & 3
        start = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        size = np.diff(np.append(start, len(gram)))
        shared = np.minimum.reduceat(ids, start) < np.maximum.reduceat(ids, start)
        shared |= np.maximum.reduceat(state, start) > 0
        if known is not None and gram[0] == known:
            shared[0] = True
        known = int(gram[-1]) if shared[-1] else None
        carry = None if shared[-1] else table.slice(int(start[-1]))
        out = table.take(pa.array(np.flatnonzero(np.repeat(shared, size))))
        yield from out.combine_chunks().to_batches()


def _cut(width: int):
    """Bytes of the listed stretches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrays.slices(whole, "text", 2 << 20):
                data, offsets = arrays.text_bytes(batch.column("text"))
                lists = batch.column("places")
                row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                gram, pos = (lists.flatten().field(k) for k in ("gram", "pos"))
                at = pos.to_numpy()
                first = offsets[row] + (at >> 16)
                size = (at >> 9 & 127) + width
                ends = np.concatenate([[0], np.cumsum(size)])
                index = np.repeat(first - ends[:-1], size) + np.arange(ends[-1])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([
                    gram, batch.column("id").take(take), batch.column("hash").take(take), pos,
                    pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(data[index])]).cast(pa.binary())],
                    names=["gram", "id", "hash", "pos", "bytes"])

    return run


class SuffixSort:
    """Suffixes of concatenated stretches; ``prefix`` has the polynomial hash up to each byte of its stretch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int):
        self.data, self.width = data, width
        relative = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
        self.relative = np.append(relative, 0)
        self.prefix = np.zeros(len(data) + 1, U64)
        np.cumsum(arrays._TABLE[data] * arrays._POW[relative], out=self.prefix[1:])
        # The first eight bytes of each suffix as a number; most comparisons end there.
        self.head = np.zeros(len(data) + 1, U64)
        for i in range(min(8, len(data))):
            self.head[: len(data) - i] |= data[i:].astype(U64) << U64(56 - 8 * i)

        self.full = np.zeros(len(data) + 1, U64)

    def prepare(self, at: np.ndarray) -> None:
        """Hash the ``width`` bytes of the suffixes that will be compared."""
        self.full[at] = self._hash(at, np.full(len(at), self.width))

    def _hash(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.prefix[at + size] - self.prefix[at]) * arrays._INV[self.relative[at]]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of prepared suffixes, up to ``width``, by binary search; equal ones take one step."""
        n = np.full(len(a), self.width)
        rest = np.flatnonzero(self.full[a] != self.full[b])
        a, b = a[rest], b[rest]
        lo, hi = np.zeros(len(rest), np.int64), np.full(len(rest), self.width - 1)
        for _ in range(int(self.width).bit_length() if len(rest) else 0):
            mid = (lo + hi + 1) >> 1
            same = self._hash(a, mid) == self._hash(b, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, np.maximum(mid - 1, lo))
        n[rest] = lo
        return n

    def less(self, a: np.ndarray, b: np.ndarray, equal: np.ndarray) -> np.ndarray:
        """Whether suffix a comes before b; ``equal`` says what holds for suffixes that agree."""
        mine, other = self.head[a], self.head[b]
        out = mine < other
        tied = np.flatnonzero(mine == other)
        a, b = a[tied], b[tied]
        n = self.common(a, b)
        at = np.minimum(n, self.width - 1)
        out[tied] = np.where(n >= self.width, equal[tied], self.data[a + at] < self.data[b + at])
        return out

    def sort(self, at: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Bottom-up mergesort of the suffixes ``at`` within each group ``start``, ``size``; all groups advance together."""
        at = at.copy()
        self.prepare(at)
        begin, count = np.repeat(start, size), np.repeat(size, size)
        place = np.arange(len(at)) - begin
        run = 1
        while run < int(size.max(initial=0)):
            block = place // run
            other = (block ^ 1) * run
            own = np.flatnonzero((count > run) & (other < count))
            mine, base = at[own], begin[own] + other[own]
            right = (block[own] & 1).astype(bool)
            lo, hi = np.zeros(len(own), np.int64), np.minimum(run, count[own] - other[own])
            for _ in range(int(run).bit_length()):
                active = np.flatnonzero(lo < hi)
                if not len(active):
                    break
                mid = (lo[active] + hi[active]) >> 1
                before = self.less(at[base[active] + mid], mine[active], right[active])
                lo[active] = np.where(before, mid + 1, lo[active])
                hi[active] = np.where(before, hi[active], mid)
            merged = at.copy()
            merged[begin[own] + (block[own] >> 1) * 2 * run + place[own] % run + lo] = mine
            at = merged
            run *= 2
        return at

    def equal_bytes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), bool)
        inside = np.arange(self.width)
        for i in range(0, len(a), 50_000):
            out[i: i + 50_000] = (self.data[a[i: i + 50_000, None] + inside] == self.data[b[i: i + 50_000, None] + inside]).all(axis=1)
        return out


def repeated(gram: np.ndarray, ids: np.ndarray, pos: np.ndarray, data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretch and window (within it) of every suffix that also starts under a smaller id."""
    span = (pos >> 9 & 127) + 1
    stretch = np.repeat(np.arange(len(pos)), span)
    window = np.arange(len(stretch)) - np.repeat(np.concatenate([[0], np.cumsum(span)[:-1]]), span)
    # Equal windows picked the same gram at the same offset.
    offset = np.repeat(pos >> 2 & 127, span) - window
    order = np.lexsort((offset, np.repeat(gram, span)))
    stretch, window, offset = stretch[order], window[order], offset[order]
    new = np.ones(len(order), bool)
    new[1:] = (gram[stretch][1:] != gram[stretch][:-1]) | (offset[1:] != offset[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(order)))
    several = np.repeat(size > 1, size)
    stretch, window = stretch[several], window[several]
    size = size[size > 1]
    start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    if not len(size):
        return stretch, window
    suffixes = SuffixSort(data, offsets, width)
    at = offsets[stretch] + window
    owner = np.zeros(len(data) + 1, np.int64)
    owner[at] = np.arange(len(at))
    ordered = suffixes.sort(at, start, size)
    first = np.zeros(len(at), bool)
    first[start] = True
    near = np.flatnonzero(~first)
    agree = suffixes.common(ordered[near - 1], ordered[near]) >= width
    agree[agree] = suffixes.equal_bytes(ordered[near - 1][agree], ordered[near][agree])
    fresh = np.ones(len(at), bool)
    fresh[near[agree]] = False
    who = owner[ordered]
    id_of = ids[stretch[who]]
    begin = np.flatnonzero(fresh)
    least = np.repeat(np.minimum.reduceat(id_of, begin), np.diff(np.append(begin, len(at))))
    hit = who[id_of > least]
    return stretch[hit], window[hit]


def _marks(ids, hashes, pos, stretch, window) -> pa.RecordBatch:
    """Runs of removed windows as first and last window of the document."""
    key = np.sort(stretch.astype(np.int64) << 8 | window)
    begin = np.flatnonzero(np.append(True, np.diff(key) != 1)) if len(key) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(key)) - 1 if len(key) else begin
    row = key[begin] >> 8
    first = pos[row] >> 16
    return pa.RecordBatch.from_arrays([
        pa.array(ids[row]), pa.array(hashes[row]), pa.array((first + (key[begin] & 255)).astype(np.int32)), pa.array((first + (key[end] & 255)).astype(np.int32))],
        names=["id", "hash", "first", "last"])


def _sort_groups(width: int, limit: int = 20_000):
    """Suffix sort over rows sorted by gram, some thousand stretches at a time and never half a gram."""
    def solve(table: pa.Table) -> pa.RecordBatch:
        gram, ids, hashes, pos = (table.column(c).to_numpy() for c in ("gram", "id", "hash", "pos"))
        data, offsets = arrays.text_bytes(table.column("bytes"))
        return _marks(ids, hashes, pos, *repeated(gram, ids, pos, data, offsets, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= limit:
                table = pa.concat_tables(held).combine_chunks()
                gram = table.column("gram").to_numpy()
                cut = int(np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))[-1])
                if cut:
                    yield solve(table.slice(0, cut).combine_chunks())
                held, rows = [table.slice(cut)], table.num_rows - cut
        if rows:
            yield solve(pa.concat_tables(held).combine_chunks())

    return run


def _hash_windows(width: int):
    """Two hashes of every window of the stretches; for grams with very many stretches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrays.text_bytes(batch.column("bytes"))
            pos = batch.column("pos").to_numpy()
            span = (pos >> 9 & 127) + 1
            row = np.repeat(np.arange(len(pos)), span)
            window = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(span)[:-1]]), span)
            at = offsets[row] + window
            first = arrays.span_hash(data, at, at + width)
            second = arrays.window_hash(arrays.mix(data.astype(U64)), width, 9)[at]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([
                arrays.as_long(first), arrays.as_long(second), batch.column("id").take(take), batch.column("hash").take(take),
                pa.array(((pos[row] >> 16) + window).astype(np.int32))], names=["one", "two", "id", "hash", "at"])

    return run


def _remove(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrays.slices(whole, "text", 4 << 20):
                out: tuple[list, ...] = ([], [], [], [])
                lists = batch.column("ranges")
                values = lists.flatten()
                firsts, lasts = values.field("first").to_numpy(), values.field("last").to_numpy()
                counts = lists.value_lengths().fill_null(0).to_numpy()
                at = 0
                for text, n in zip(batch.column("text").to_pylist(), counts.tolist()):
                    data = (text or "").encode()
                    removed = spans = 0
                    kept = data
                    if n:
                        edge = np.zeros(len(data) + 1, np.int32)
                        np.add.at(edge, firsts[at: at + n], 1)
                        np.add.at(edge, lasts[at: at + n] + width, -1)
                        at += n
                        gone = np.cumsum(edge[:-1]) > 0
                        removed = int(gone.sum())
                        spans = int((np.diff(gone.view(np.int8), prepend=0) == 1).sum())
                        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    for column, value in zip(out, (len(data), removed, spans, hashlib.sha256(kept).hexdigest())):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], names=[c.split(" ")[0] for c in RESULT.split(", ")])

    return run


def removed_ranges(texts: DataFrame, width: int, hot: int) -> DataFrame:
    """Runs of windows (first, last) that start under a smaller id as well; ``texts`` has id, hash, text."""
    tables = Tables(texts.sparkSession)
    slim = texts.select("id", "hash", "text")
    found = slim.mapInArrow(_find_places(width), _PLACES)
    anywhere = F.when(F.col("pos").bitwiseAND(3) == FOLLOWER, F.xxhash64("gram", "id", "pos")).otherwise(F.col("gram"))
    shared = tables.store(found.repartition(anywhere).sortWithinPartitions("gram").mapInArrow(_shared, _PLACES), "shared")
    grams_ = tables.store(shared.groupBy("gram").agg(F.min("stretch").alias("low"), F.max("stretch").alias("high"), F.min("id").alias("least")), "grams")
    joined = shared.join(grams_, "gram").where("low <> high or id > least").select("gram", "stretch", "id", "hash", "pos", (F.col("low") == F.col("high")).alias("alike"))
    joined = tables.store(joined, "joined")
    tables.drop("shared", "grams")
    mixed = joined.where("not alike").drop("alike")
    variants = tables.store(mixed.groupBy("gram", "stretch").agg(F.min("id").alias("least")), "variants")
    mixed = tables.store(mixed.join(variants, ["gram", "stretch"]).select("gram", "id", "hash", "pos", (F.col("id") == F.col("least")).alias("open")), "mixed")
    many = tables.store(variants.groupBy("gram").count().where(F.col("count") > hot).select("gram"), "many")
    lists = mixed.where("open").groupBy("id", "hash").agg(F.collect_list(F.struct("gram", "pos")).alias("places"))
    stretches = tables.store(slim.join(lists, ["id", "hash"]).mapInArrow(_cut(width), "gram long, id long, hash int, pos long, bytes binary"), "stretches")
    few = stretches.join(many, "gram", "left_anti").repartition("gram").sortWithinPartitions("gram").mapInArrow(_sort_groups(width), _MARKS)
    windows = stretches.join(many, "gram", "left_semi").mapInArrow(_hash_windows(width), "one long, two long, id long, hash int, at int")
    least = windows.groupBy("one", "two").agg(F.min("id").alias("least"))
    rest = windows.join(least, ["one", "two"]).where("id > least").select("id", "hash", F.col("at").alias("first"), F.col("at").alias("last"))
    sorted_ = tables.store(few.unionByName(rest), "sorted")
    tables.drop("stretches", "variants", "many")
    whole = joined.where("alike").select("id", "hash", *window_range())
    later = mixed.where("not open").select("id", "hash", *window_range())
    return whole.unionByName(later).unionByName(sorted_)


def remove_repeats(docs: DataFrame, width: int = 50, hot: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document what is left after removing every byte of a string of ``width`` bytes that also starts under a smaller id."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.hash(text).alias("hash"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    ranges = removed_ranges(texts, width, hot).groupBy("id", "hash").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    return texts.join(ranges, ["id", "hash"], "left").select("doc_id", "text", "ranges").mapInArrow(_remove(width), RESULT)
