"""Similarity join on word n-grams with signature trees, and the components of its links.

Documents with equal n-gram sets are one node. A node's n-grams are put in one order for all nodes: those that a bounded sample of the
documents shows to be frequent come last, by rising frequency, the others before them by hash. Two sets that reach the threshold
share one of the first ``floor((1 - t) n) + 1`` (its prefix), so nodes meet by prefix n-gram and no link is lost,
whatever the order; with this one, few of them meet by a frequent n-gram.

Links are found by a signature tree over the nodes of each shared n-gram: leaves are bitmaps of
their n-grams, inner entries hold OR-combined bitmaps and size ranges. A dual traversal from the root drops pairs of
entries that are of one component, too different in size, or whose largest possible overlap is below the
threshold. Pairs of leaves that remain are compared exactly.

A shortcut comes before the trees for n-grams with more than ``crowd`` nodes, which may be that many copies: every node is compared with the least
node of it, and what this links is one component, within which a tree gives no pairs. Then, in rounds while links are found,
the tree of such an n-gram gives each node's most similar one of another component only, so that a large group of
near copies grows together from one pair a node and round. A round with few links is the last. All pairs still open after that are compared. Components are whole;
``links`` holds the links that join them, not every link inside one.

Comparisons are exact, on whole n-gram sets. An n-gram with more than ``hot`` nodes is cut
into blocks, and each pair of blocks is a task of its own. The n-gram of a passage in many documents of one slice travels as
one row per node, and rows whose n-gram is known to be shared go anywhere.

Defined cases: null and empty texts have no n-grams, link with nothing and are their own component; a text with fewer than
``n`` words is one n-gram, its words; rows of equal id count as one document; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import arrays
from strandloom.llm.storage import Tables, stored
from strandloom.operators.components import connected_components

U64 = np.uint64
_ROWS = "key long, one long, two long, id long, state int"
ALONE, LEADER, FOLLOWER, NODE = 0, 1, 2, 3


def ngram_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, and offsets."""
    data, offsets = arrays.text_bytes(column)
    starts, ends, words = arrays.word_bounds(data, offsets)
    hashes = arrays.span_hash(arrays.lower_ascii(data), starts, ends)
    text = arrays.owner(words)
    grams = arrays.window_hash(hashes, n, 3)
    inside = np.flatnonzero(text[: len(grams)] == text[n - 1:]) if len(grams) else np.zeros(0, np.int64)
    grams, own = grams[inside], text[inside]
    size = np.diff(words)
    for short in range(1, n):
        few = np.flatnonzero(size == short)
        if len(few):
            grams = np.concatenate([grams, arrays.window_hash(hashes, short, 100 + short)[words[:-1][few]]])
            own = np.concatenate([own, few])
    order = np.lexsort((grams, own))
    grams, own = grams[order], own[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (own[1:] != own[:-1])
    grams, own = grams[new], own[new]
    return grams, np.searchsorted(own, np.arange(len(size) + 1))


def _identity(grams: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set's name: a 64-bit sum of mixed hashes, and 32 more bits with its size below them."""
    total = np.zeros((2, len(grams) + 1), U64)
    for k, seed in enumerate((0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47)):
        np.cumsum(arrays.mix(grams ^ U64(seed)), out=total[k, 1:])
    sums = total[:, offsets[1:]] - total[:, offsets[:-1]]
    size = np.diff(offsets).astype(U64)
    return sums[0], (sums[1] & U64(0xFFFFFFFF00000000)) | size


def _frequent(texts: DataFrame, n: int, sample: int, top: int) -> np.ndarray:
    """The ``top`` n-grams that most of about ``sample`` documents hold, by rising number; those of a single one are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrays.slices(whole, "text", 4 << 20):
                grams, count = np.unique(ngram_sets(batch.column("text"), n)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([arrays.as_long(grams), pa.array(count, pa.int64())], names=["gram", "n"])

    share = min(1.0, sample / max(texts.count(), 1))
    some = texts.where(F.pmod(F.xxhash64("id"), F.lit(1 << 53)) < int(share * (1 << 53))).select("text")
    found = some.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "gram").limit(top).collect()
    return np.array([r.gram for r in reversed(found)], np.int64).view(U64)


def _ranks(grams: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """0 for n-grams outside ``frequent``, else their place in it from 1."""
    if not len(frequent):
        return np.zeros(len(grams), np.int64)
    order = np.argsort(frequent)
    at = np.minimum(np.searchsorted(frequent[order], grams), len(frequent) - 1)
    return np.where(frequent[order][at] == grams, order[at] + 1, 0)


def _prefixes(n: int, percent: int, frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrays.slices(whole, "text", 4 << 20):
                grams, offsets = ngram_sets(batch.column("text"), n)
                one, two = _identity(grams, offsets)
                size = np.diff(offsets)
                grams = grams[np.lexsort((grams, _ranks(grams, frequent), arrays.owner(offsets)))]
                yield pa.RecordBatch.from_arrays([
                    arrays.as_long(one), arrays.as_long(one), arrays.as_long(two), batch.column("id"), pa.array(np.full(len(size), NODE, np.int32))],
                    names=["key", "one", "two", "id", "state"])
                # Equal sets of this slice send their prefix once.
                _, first = np.unique(np.stack([one, two]), axis=1, return_index=True)
                first = first[size[first] > 0]
                length = (size[first] * (100 - percent)) // 100 + 1
                row = np.repeat(first, length)
                at = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length).astype(np.int64)
                key = grams[offsets[row] + at] if len(row) else np.zeros(0, U64)
                order = np.lexsort((row, key))
                ordered = key[order]
                new = np.ones(len(key), bool)
                new[1:] = ordered[1:] != ordered[:-1]
                many = np.zeros(len(key), bool)
                many[:-1] = ~new[1:]
                state = np.empty(len(key), np.int32)
                state[order] = np.where(new, np.where(many, LEADER, ALONE), FOLLOWER)
                yield pa.RecordBatch.from_arrays([
                    arrays.as_long(key), arrays.as_long(one[row]), arrays.as_long(two[row]), pa.nulls(len(key), pa.int64()), pa.array(state)],
                    names=["key", "one", "two", "id", "state"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node rows, and of the rows sorted by key those whose key more than one node has."""
    carry: pa.Table | None = None
    known: int | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if carry is not None:
            table = pa.concat_tables([carry, table]).combine_chunks()
        if not table.num_rows:
            continue
        key, one, state = (table.column(c).to_numpy() for c in ("key", "one", "state"))
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(start, len(key)))
        node = state == NODE
        plain = np.where(node, np.iinfo(np.int64).max, one), np.where(node, np.iinfo(np.int64).min, one)
        shared = np.minimum.reduceat(plain[0], start) < np.maximum.reduceat(plain[1], start)
        shared |= np.maximum.reduceat(np.where(node, 0, state), start) > 0
        if known is not None and key[0] == known:
            shared[0] = True
        known = int(key[-1]) if shared[-1] else None
        carry = None if shared[-1] else table.slice(int(start[-1]))
        out = np.repeat(shared, size) | node
        if carry is not None:
            out[int(start[-1]):] = False
        yield from table.take(pa.array(np.flatnonzero(out))).combine_chunks().to_batches()
    if carry is not None:
        yield from carry.filter(pa.array(carry.column("state").to_numpy() == NODE)).combine_chunks().to_batches()


def _as_binary(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


def _set_rows(n: int):
    """Sorted n-gram hashes of each text as bytes, with the other columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrays.slices(whole, "text", 2 << 20):
                grams, offsets = ngram_sets(batch.column("text"), n)
                sets = _as_binary([grams[offsets[i]: offsets[i + 1]] for i in range(batch.num_rows)])
                yield pa.RecordBatch.from_arrays([*batch.select(["a", "b"]).columns, sets], names=["a", "b", "grams"])

    return run


def _verify(n: int, percent: int):
    """Pairs whose sets reach the threshold; ``grams`` is the set of a, ``text`` that of b."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrays.slices(whole, "text", 2 << 20):
                grams, offsets = ngram_sets(batch.column("text"), n)
                keep = []
                for i, raw in enumerate(batch.column("grams").to_pylist()):
                    mine, other = np.frombuffer(raw, U64), grams[offsets[i]: offsets[i + 1]]
                    at = np.searchsorted(other, mine)
                    both = int((other[np.minimum(at, len(other) - 1)] == mine).sum()) if len(other) else 0
                    keep.append(100 * both >= percent * (len(mine) + len(other) - both) and both > 0)
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _bitmaps(n: int, limit: int):
    """A bitmap of each set, of the least power of two from eight bits an n-gram up to ``limit``; few n-grams share a bit, so few pairs pass that do not link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrays.slices(whole, "text", 2 << 20):
                grams, offsets = ngram_sets(batch.column("text"), n)
                out = []
                for i in range(batch.num_rows):
                    own = grams[offsets[i]: offsets[i + 1]]
                    bits = min(limit, max(64, 1 << (8 * len(own) - 1).bit_length()))
                    flags = np.zeros(bits, np.uint8)
                    flags[(arrays.mix(own) & U64(bits - 1)).astype(np.int64)] = 1
                    out.append(np.packbits(flags, bitorder="little"))
                yield pa.RecordBatch.from_arrays([batch.column("id"), _as_binary(out)], names=["id", "bits"])

    return run


def _common(bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that rows ``a`` and ``b`` have in common, a bounded part at a time."""
    out = np.empty(len(a), np.int64)
    step = max(1, (1 << 21) // bits.shape[1])
    for i in range(0, len(a), step):
        out[i: i + step] = np.bitwise_count(bits[a[i: i + step]] & bits[b[i: i + step]]).sum(axis=1)
    return out


class Tree:
    """Signature tree over nodes in order of component and size; an entry covers ``fan`` entries of the level below.

    ``spare`` is the number of n-grams that share a bit with another one of their set: two sets have at most their
    common bits and the smaller spare in common.
    """

    def __init__(self, bits: np.ndarray, size: np.ndarray, label: np.ndarray, fan: int = 8):
        spare = size - np.bitwise_count(bits).sum(axis=1)
        self.fan = fan
        self.levels = [(bits, size, size, spare, label)]
        while len(self.levels[-1][1]) > fan:
            bits, low, high, spare, label = self.levels[-1]
            start = np.arange(0, len(low), fan)
            same = np.minimum.reduceat(label, start) == np.maximum.reduceat(label, start)
            self.levels.append((
                np.bitwise_or.reduceat(bits, start), np.minimum.reduceat(low, start), np.maximum.reduceat(high, start),
                np.maximum.reduceat(spare, start), np.where(same, label[start], np.iinfo(np.int64).min)))

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        bits, low, high, spare, label = self.levels[level]
        ok = (label[a] != label[b]) | (label[a] == np.iinfo(np.int64).min)
        ok &= (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
        at = np.flatnonzero(ok)
        x, y = a[at], b[at]
        most = _common(bits, x, y) + np.minimum(spare[x], spare[y])
        most = np.minimum(most, np.minimum(high[x], high[y]))
        # 100 * overlap >= percent * union, with the least possible union.
        ok[at] = (100 + percent) * most >= percent * (low[x] + low[y])
        return ok

    def join(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves of different components that may reach the threshold."""
        top = len(self.levels) - 1
        n = len(self.levels[top][1])
        a, b = np.triu_indices(n)
        work = [(top, a, b)]
        while work:
            level, a, b = work.pop()
            if level == 0:
                a, b = a[a < b], b[a < b]
            ok = self._possible(level, a, b, percent)
            a, b = a[ok], b[ok]
            if level == 0:
                if len(a):
                    yield a, b
                continue
            below = len(self.levels[level - 1][1])
            step = 20_000
            for i in range(0, len(a), step):
                grid = np.arange(self.fan)
                x = (a[i: i + step, None, None] * self.fan + grid[:, None]).repeat(self.fan, axis=2).reshape(-1)
                y = (b[i: i + step, None, None] * self.fan + grid[None, :]).repeat(self.fan, axis=1).reshape(-1)
                keep = (x < below) & (y < below) & (x <= y)
                work.append((level - 1, x[keep], y[keep]))


def fold(bits: bytes, size: int) -> np.ndarray:
    """A bitmap folded to ``size`` 64-bit words."""
    return np.bitwise_or.reduce(np.frombuffer(bits, U64).reshape(-1, size), axis=0)


def group_pairs(
    ids: np.ndarray, size: np.ndarray, label: np.ndarray, bits: list[bytes], block: np.ndarray, percent: int, best: bool = False,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of one group. ``block`` is 0 or 1: with both present only pairs across them count.

    Linked sets differ in size by less than two, so their bitmaps have equal width or one is twice the other.
    ``best``: of the pairs of each node only the one whose bitmaps are most alike.
    """
    width = np.array([len(x) // 8 for x in bits])
    across = block.min() != block.max()
    alike, other = np.zeros(len(ids)), np.full(len(ids), -1)
    for w in np.unique(width):
        own = np.flatnonzero((width == w) | (width == 2 * w))
        if len(own) < 2:
            continue
        order = own[np.lexsort((size[own], label[own]))]
        tree = Tree(np.stack([fold(bits[i], w) for i in order]), size[order], label[order])
        for x, y in tree.join(percent):
            a, b = order[x], order[y]
            keep = (width[a] == w) | (width[b] == w)
            if across:
                keep &= block[a] != block[b]
            a, b = a[keep], b[keep]
            if not best:
                yield np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
                continue
            both = _common(tree.levels[0][0], x[keep], y[keep])
            share = both / np.maximum(size[a] + size[b] - both, 1)
            one, two, share = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([share, share])
            rank = np.lexsort((share, one))
            last = rank[np.append(one[rank][1:] != one[rank][:-1], True)] if len(rank) else rank
            last = last[share[last] > alike[one[last]]]
            alike[one[last]], other[one[last]] = share[last], two[last]
    found = np.flatnonzero(other >= 0)
    if len(found):
        yield np.minimum(ids[found], ids[other[found]]), np.maximum(ids[found], ids[other[found]])


def _trees(percent: int, best: bool = False):
    """Trees over the rows of each group; rows come sorted by group. Pairs leave in parts, so many of them are never held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
            ids, size, label, block = (table.column(c).to_numpy() for c in ("id", "n", "label", "block"))
            bits = table.column("bits").to_pylist()
            groups = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")])
            start = np.flatnonzero(np.append(True, (groups[:, 1:] != groups[:, :-1]).any(axis=0)))
            found: list[tuple[np.ndarray, np.ndarray]] = []
            held = 0

            def ready() -> pa.RecordBatch:
                pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*found)]), axis=1)
                found.clear()
                return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

            for s, e in zip(start.tolist(), np.append(start[1:], len(ids)).tolist()):
                if e - s > 1 and label[s:e].min() != label[s:e].max():
                    for pair in group_pairs(ids[s:e], size[s:e], label[s:e], bits[s:e], block[s:e], percent, best):
                        found.append(pair)
                        held += len(pair[0])
                        if held >= 200_000:
                            yield ready()
                            held = 0
            if held:
                yield ready()

        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= 20_000:
                table = pa.concat_tables(held).combine_chunks()
                groups = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")])
                cut = int(np.flatnonzero(np.append(True, (groups[:, 1:] != groups[:, :-1]).any(axis=0)))[-1])
                if cut:
                    yield from solve(table.slice(0, cut).combine_chunks())
                held, rows = [table.slice(cut)], table.num_rows - cut
        if rows:
            yield from solve(pa.concat_tables(held).combine_chunks())

    return run


def _compare(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Exact links among ``pairs`` (a, b); both sides read their whole texts."""
    left = pairs.join(texts.withColumnRenamed("id", "a"), "a").select("a", "b", "text").mapInArrow(_set_rows(n), "a long, b long, grams binary")
    return left.join(texts.withColumnRenamed("id", "b"), "b").select("a", "b", "grams", "text").mapInArrow(_verify(n, percent), "a long, b long")


def _merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """``labels`` (id, component) once the links ``more`` (a, b) have joined components; only the links between components are contracted."""
    for side in ("a", "b"):
        more = more.join(labels.select(F.col("id").alias(side), "component"), side, "left").withColumn(side, F.coalesce("component", side)).drop("component")
    moved = connected_components(more, "a", "b")
    known = labels.join(moved.select(F.col("vertex").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    fresh = moved.select(F.col("vertex").alias("id"), "component").join(labels, "id", "left_anti")
    return known.unionByName(fresh)


def _comparable(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` (key, id, n, label) without the nodes to which no node of another component in their n-gram is alike enough in size.

    Sizes are put in classes so wide that two which can link lie in one or in neighbouring ones. An n-gram's classes are
    all that is looked at, so a frequent one does not gather in a task.
    """
    width = max(math.log(100 / percent), 1e-3) * 1.001
    classed = rows.withColumn("class", F.floor(F.log("n") / width))
    held = classed.groupBy("key", "class").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    around = held.withColumn("class", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)))
    mixed = around.groupBy("key", "class").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high")
    return classed.join(mixed.select("key", "class"), ["key", "class"]).select(*rows.columns)


def links(
    docs: DataFrame, n: int = 4, percent: int = 85, hot: int = 4000, bits: int = 1 << 14, id_col: str = "doc_id", text_col: str = "text",
    crowd: int | None = 32, sample: int = 5_000, top: int = 50_000, few: int = 200,
) -> tuple[DataFrame, DataFrame]:
    """Nodes (one, two, rep: the least id of a set, n) by document, and components of the exact links between sets.

    The components hold the representatives that link with another set. ``crowd``: nodes of an n-gram beyond which its least node is tried first (None:
    never). ``few``: links up to which a round is the last, because nodes that link with another component found one. ``sample`` and ``top`` bound the documents and
    n-grams from which the order is taken. These change the work, not the result.
    """
    tables = Tables(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    anywhere = F.when(F.col("state").isin(ALONE, LEADER), F.col("key")).otherwise(F.xxhash64("key", "one", "two", "id"))
    rows = tables.store(texts.mapInArrow(_prefixes(n, percent, _frequent(texts, n, sample, top)), _ROWS).repartition(anywhere).sortWithinPartitions("key").mapInArrow(_shared, _ROWS), "rows")
    members = rows.where(F.col("state") == NODE).select("id", "one", "two", F.col("two").bitwiseAND(0xFFFFFFFF).alias("n"))
    nodes = tables.store(members.where("n > 0 and id is not null").groupBy("one", "two", "n").agg(F.min("id").alias("id")), "nodes")
    spots = tables.store(rows.where(F.col("state") != NODE).select("key", "one", "two").distinct().join(nodes, ["one", "two"]).select("key", "id", "n"), "spots")

    least = spots.groupBy("key").agg(F.min(F.struct("id", "n")).alias("least"), F.count("*").alias("size")).where(F.col("size") > (crowd or 0) if crowd is not None else F.lit(False))
    near = spots.join(tables.store(least, "least"), "key").where("id <> least.id")
    near = near.where(f"100 * least(n, least.n) >= {percent} * greatest(n, least.n)").select(F.col("least.id").alias("a"), F.col("id").alias("b")).distinct()
    first = tables.store(_compare(tables.store(near, "near"), texts, n, percent), "first")
    labels = tables.store(connected_components(first, "a", "b").select(F.col("vertex").alias("id"), "component"), "labels")

    def opened(rows: DataFrame, labels: DataFrame) -> DataFrame:
        """``key, id, n, label, size`` of n-grams with nodes of several components; of n-grams that hold the very same nodes one is enough."""
        rows = _comparable(rows.join(labels, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("label")), percent)
        same = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"same{k}") for k in range(2)]
        several = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"), *same).where("low <> high")
        return rows.join(several.groupBy("size", "same0", "same1").agg(F.min("key").alias("key")).select("key", "size"), "key")

    def candidates(rows: DataFrame, best: bool) -> DataFrame:
        """Pairs of trees. A node of a hot n-gram goes with each block, once; i and j are the two blocks, block tells the node's side."""
        blocks = F.ceil(F.col("size") / hot).cast("int")
        own = F.pmod(F.xxhash64("id"), blocks).cast("int")
        spread = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        spread = spread.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("block"), "id", "n", "label")
        spread = spread.join(drawn, "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        return spread.mapInArrow(_trees(percent, best), "a long, b long").distinct()

    rows = tables.store(opened(spots, labels), "open")
    drawn = tables.store(texts.join(rows.select("id").distinct(), "id").select("id", "text").mapInArrow(_bitmaps(n, bits), "id long, bits binary"), "drawn")
    # Each round joins a component to its most similar one, so their number at least halves where links are; it ends when there are few.
    for turn in count(1) if crowd is not None else ():
        many = rows.where(F.col("size") > crowd)
        if many.isEmpty():
            break
        more = tables.store(_compare(tables.store(candidates(many, True), f"best{turn}"), texts, n, percent), f"more{turn}")
        found = more.count()
        if not found:
            break
        labels = tables.store(_merged(labels, more), f"labels{turn}")
        rows = tables.store(opened(rows.select("key", "id", "n"), labels), f"open{turn}")
        if found <= few:
            break
    pairs = tables.store(candidates(rows, False), "pairs")
    second = tables.store(_compare(pairs, texts, n, percent), "second")
    tables.drop("spots", "least", "near", "open", "drawn", "pairs")
    groups = _merged(labels, second)
    return members.join(nodes.select("one", "two", F.col("id").alias("rep")), ["one", "two"], "left"), groups


def similar_components(
    docs: DataFrame, n: int = 4, percent: int = 85, hot: int = 4000, id_col: str = "doc_id", text_col: str = "text", crowd: int | None = 32,
) -> DataFrame:
    """Per document the size of its n-gram set and the least id reachable by links."""
    members, groups = links(docs, n, percent, hot, id_col=id_col, text_col=text_col, crowd=crowd)
    return members.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of linked or equal texts: the one of least id, a null id being the greatest.

    A row is its id and text, so rows of one id with texts that are not linked all stay, and of equal rows one does.
    Texts without words link with nothing and stay once per id.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    number = F.col(id_col).cast("long")
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), number.alias("_id"), text.alias("_text"), F.xxhash64(F.coalesce(number.cast("string"), F.lit("null")), text).alias("_key"))
    found = similar_components(rows.select("_key", "_text"), n, percent, id_col="_key", text_col="_text").select("_key", "component_id").distinct()
    found = found.join(rows.select("_key", "_id").distinct(), "_key")
    best = found.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_key")).alias("best"), F.count("*").alias("size")).where("size > 1")
    gone = stored(found.join(best, "component_id").where("_key <> best._key").select("_key"), "duplicates")
    return rows.select("_key", "_row").join(gone, "_key", "left_anti").dropDuplicates(["_key"]).select("_row.*")
