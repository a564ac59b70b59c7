"""Spelling variants grouped through the nodes of a forward and a backward trie.

Words that differ by one code point share a prefix and a suffix around it. The nodes of the trie of all words, and
of all reversed words, are numbered, so a pair of numbers (node of the prefix, node of the suffix) stands for both. A word
has a *skip* pair at each of its code points and a *split* pair at each of its gaps. Two words with one skip pair differ by a replaced
code point; a skip pair of one that is a split pair of the other differs by an inserted one. Nothing has to be verified: equal
numbers are equal strings.

The tries are never built. Words are sorted by Spark over range partitions; each partition numbers the nodes that a word adds
to those of the word before it. A node whose words reach over partition bounds gets one number in each of them; these are the
prefixes that the last word of a partition shares with the first of the next, and a table of them (at most one word a
partition) gives the number that counts. Nodes of a single word meet nothing and are not numbered.

All words of a skip pair have different code points at one place, so a pair has at most as many words as the alphabet has letters, and one
split word: its list is bounded (91 for this alphabet). Pairs of words are not emitted; each word gets the size of its neighbourhood
and the best member.

Defined cases: a null text has no words; a null id never has a code point deleted; equal rows count separately; an empty table gives
no rows; extra columns are ignored; a run of letters of any length is one word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import arrays
from strandloom.llm.storage import Tables

_SHIFT = 40
_PIECE = 4 << 20
_SHORT = 64


@dataclass(frozen=True)
class Rules:
    min_length: int = 7
    min_count: int = 2
    #: A form occurs at least so many times as often as the word.
    ratio: int = 10
    #: A run whose hash is divisible by it loses a code point before it is counted; None: no run does.
    deletion: int | None = None


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _crc(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """crc32 of each span, continued from ``first``; short spans are advanced together, byte by byte."""
    sizes = ends - starts
    order = np.argsort(-np.minimum(sizes, _SHORT + 1), kind="stable")
    order = order[int((sizes > _SHORT).sum()):]
    state, at, size = ~first[order].astype(np.uint32), starts[order], sizes[order]
    for j in range(int(size.max()) if len(size) else 0):
        live = int(np.searchsorted(-size, -j, "left"))
        state[:live] = _CRC[(state[:live] ^ data[at[:live] + j]) & 0xFF] ^ (state[:live] >> np.uint32(8))
    out = np.zeros(len(starts), np.uint32)
    out[order] = ~state
    for k in np.flatnonzero(sizes > _SHORT):
        out[k] = zlib.crc32(data[starts[k]: ends[k]].tobytes(), int(first[k]))
    return out


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the runs of A-Z, a-z and U+00C0 to U+00FF (bytes C3 80 to C3 BF), and ``n + 1`` offsets of the texts' first runs."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) | (data == 0xC3)
    letter[1:] |= data[:-1] == 0xC3
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = letter.copy()
    starts[1:] &= ~letter[:-1] | first[1:-1]
    ends = letter.copy()
    ends[:-1] &= ~letter[1:] | first[1:-1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    if len(starts) == 1:
        return pa.array([data[starts[0]: ends[0]].tobytes().decode()], pa.large_string())
    sizes = ends - starts
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    flat = data[np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(flat))


def _count_words(rules: Rules):
    """Words of a slice of texts with their number in it."""
    def counted(words: pa.Array) -> pa.RecordBatch:
        found = words.value_counts()
        return pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts").cast(pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrays.slices(whole, "text"):
                data, offsets = arrays.text_bytes(batch.column("text"))
                starts, ends, first = letter_runs(data, offsets)
                data = arrays.lower_ascii(data)
                wide = np.zeros(len(data) + 1, np.int64)
                np.cumsum(data == 0xC3, out=wide[1:])
                points = ends - starts - (wide[ends] - wide[starts])
                long = points >= rules.min_length
                text = arrays.owner(first)[long]
                starts, ends, points = starts[long], ends[long], points[long]
                cut = np.zeros(len(starts), bool)
                if rules.deletion:
                    ids = batch.column("doc_id").to_pylist()
                    heads = np.array([0 if i is None else zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
                    h = _crc(data, starts, ends, heads[text])
                    cut = (h % rules.deletion == 0) & np.array([i is not None for i in ids], bool)[text]
                    shorter = []
                    for k in np.flatnonzero(cut & (points > rules.min_length)).tolist():
                        word = data[starts[k]: ends[k]].tobytes().decode()
                        p = int(h[k]) % len(word)
                        shorter.append(word[:p] + word[p + 1:])
                    if shorter:
                        yield counted(pa.array(shorter, pa.large_string()))
                starts, ends = starts[~cut], ends[~cut]
                piece = (np.cumsum(ends - starts) // _PIECE).astype(np.int64)
                edges = np.flatnonzero(np.diff(piece, prepend=-1, append=-2)) if len(piece) else []
                for a, b in zip(edges[:-1], edges[1:]):
                    yield counted(_strings(data, starts[a:b], ends[a:b]))

    return run


def word_counts(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words that are long and frequent enough: word, n."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_count_words(rules), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rules.min_count)


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    i = 0
    while a[i] == b[i]:
        i += 1
    return i


def _number(name: str, back: bool, keep: list[str]):
    """Number the trie nodes of one sorted partition.

    Adds to the columns ``keep``: ``{name}_at`` (partition and place), ``{name}_edge`` (1: first word of the partition, 2:
    last, 3: both), ``{name}_deep`` (longest prefix shared with a word beside it) and ``{name}_nodes``, the numbers of the
    prefixes of length 0, 1, ... up to that one, of the whole word where it is at an edge.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << _SHIFT
        place, fresh, before, nodes, held = 0, part, None, [], None

        def row(word: str, shared: int, behind: int, last: bool):
            nonlocal fresh, nodes, place
            edge = (1 if place == 0 else 0) + (2 if last else 0)
            deep = max(shared, behind)
            own = nodes[: shared + 1]
            more = (len(word) if edge else deep) + 1 - len(own)
            own = own + list(range(fresh, fresh + more))
            fresh += max(more, 0)
            nodes = own
            place += 1
            return part + place - 1, edge, deep, own

        def batch_of(rest, rows):
            at, edge, deep, own = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(at, pa.int64()), pa.array(edge, pa.int32()), pa.array(deep, pa.int32()), pa.array(own, pa.list_(pa.int64()))],
                names=[*keep, f"{name}_at", f"{name}_edge", f"{name}_deep", f"{name}_nodes"])

        # Each batch waits for the next one, whose first word decides on its last.
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column("word").to_pylist()
            if back:
                words = [w[::-1] for w in words]
            if held is not None:
                rest, own, shared = held
                rows = [row(own[k], shared[k], shared[k + 1] if k + 1 < len(own) else _common(own[k], words[0]), False) for k in range(len(own))]
                yield batch_of(rest, rows)
            lead = [0 if before is None else _common(before, words[0])] + [_common(a, b) for a, b in zip(words, words[1:])]
            before, held = words[-1], (batch.select(keep), words, lead)
        if held is not None:
            rest, own, shared = held
            yield batch_of(rest, [row(own[k], shared[k], shared[k + 1] if k + 1 < len(own) else 0, k + 1 == len(own)) for k in range(len(own))])

    return run


def _bounds(table: DataFrame, name: str, back: bool) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Numbers to replace (sorted), their replacements, and how deep the first and last words of partitions share.

    Two rows a partition reach the driver.
    """
    rows = table.where(f"{name}_edge > 0").select("word", f"{name}_at", f"{name}_edge", f"{name}_nodes").orderBy(f"{name}_at").collect()
    renamed: dict[int, int] = {}
    deeper: dict[int, int] = {}
    last = None
    for word, at, edge, nodes in rows:
        word = word[::-1] if back else word
        if edge & 1 and last is not None:
            shared = _common(last[0], word)
            for i in range(shared + 1):
                renamed[nodes[i]] = renamed.get(last[2][i], last[2][i])
            for key in (last[1], at):
                deeper[key] = max(deeper.get(key, 0), shared)
        if edge & 2:
            last = word, at, nodes
    old = np.array(sorted(renamed), np.int64)
    return old, np.array([renamed[k] for k in old.tolist()], np.int64), deeper


def _pairs(forward, backward):
    """Skip and split pairs of every word whose prefix and suffix both belong to other words too."""
    def lists(batch: pa.RecordBatch, name: str, bounds):
        old, new, deeper = bounds
        column = batch.column(f"{name}_nodes")
        values = column.flatten().to_numpy(zero_copy_only=False).copy()
        if len(old):
            i = np.minimum(np.searchsorted(old, values), len(old) - 1)
            values = np.where(old[i] == values, new[i], values)
        sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        deep = batch.column(f"{name}_deep").to_numpy(zero_copy_only=False).astype(np.int64)
        if deeper:
            at = batch.column(f"{name}_at").to_pylist()
            for k in np.flatnonzero(batch.column(f"{name}_edge").to_numpy(zero_copy_only=False)):
                deep[k] = max(deep[k], deeper.get(at[k], 0))
        return values, np.cumsum(sizes) - sizes, deep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            head, head_at, head_deep = lists(batch, "f", forward)
            tail, tail_at, tail_deep = lists(batch, "b", backward)
            word = batch.column("word")
            size = pc.utf8_length(word).to_numpy(zero_copy_only=False).astype(np.int64)
            points = np.frombuffer("".join(word.to_pylist()).encode("utf-32-le"), np.uint32)
            text_at = np.cumsum(size) - size
            again = np.zeros(len(points), bool)
            again[1:] = points[1:] == points[:-1]
            again[text_at] = False
            for split in (0, 1):
                # Places i with a prefix of i and a suffix of the remaining code points, less the one skipped.
                rest = size - 1 + split
                low, high = np.maximum(rest - tail_deep, 0), np.minimum(head_deep, rest)
                count = np.maximum(high - low + 1, 0)
                row = np.repeat(np.arange(len(size)), count)
                i = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[row]
                skip_once = np.ones(len(i), bool) if split else ~again[text_at[row] + i]
                ids, n = batch.column("f_at").take(pa.array(row)), batch.column("n").take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [arrays.as_long(head[head_at[row] + i]), arrays.as_long(tail[tail_at[row] + rest[row] - i]), ids, n, pa.array(np.full(len(i), split == 1)), pa.array(skip_once)],
                    names=["p", "s", "id", "n", "split", "once"])

    return run


def _roots(tables: Tables, forms: DataFrame) -> DataFrame:
    """``root`` of each row of ``forms`` (id, form): the end of its chain, by pointer doubling.

    A form is more frequent than its word, so chains end; each step multiplies the count, so a few rounds do.
    """
    links = tables.store(forms.select("id", F.col("form").alias("root")), "chain-0")
    step = 0
    while links.alias("a").join(links.alias("b"), F.col("a.root") == F.col("b.id"), "left_semi").limit(1).count():
        step += 1
        on = links.select(F.col("id").alias("root"), F.col("root").alias("next"))
        links = tables.store(links.join(on, "root", "left").select("id", F.coalesce("next", "root").alias("root")), f"chain-{step}")
        tables.drop(f"chain-{step - 1}")
    return links


def spelling_variants(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every word with its near words' number, its form (its most frequent near word, if that is ``ratio`` times as frequent) and root."""
    tables = Tables(docs.sparkSession)
    counted = word_counts(docs, rules, id_col, text_col)
    words = tables.store(counted, "counts")
    head = "f_at long, f_edge int, f_deep int, f_nodes array<long>"
    ahead = tables.store(
        words.repartitionByRange("word").sortWithinPartitions("word").mapInArrow(_number("f", False, ["word", "n"]), f"word string, n long, {head}"), "forward")
    forward = _bounds(ahead, "f", False)
    turned = ahead.withColumn("turned", F.reverse("word")).repartitionByRange("turned").sortWithinPartitions("turned").drop("turned")
    both = tables.store(
        turned.mapInArrow(_number("b", True, ["word", "n", "f_at", "f_edge", "f_deep", "f_nodes"]), f"word string, n long, {head}, {head.replace('f_', 'b_')}"), "backward")
    backward = _bounds(both, "b", True)
    pairs = both.mapInArrow(_pairs(forward, backward), "p long, s long, id long, n long, split boolean, once boolean")
    lists = pairs.repartition("p", "s").groupBy("p", "s").agg(F.sort_array(F.collect_list(F.struct("n", (-F.col("id")).alias("back"), "split", "once")), asc=False).alias("m"))
    beside = """transform(m, x -> named_struct('id', -x.back, 'near', filter(m, y -> x.back <> y.back and not (x.split and y.split)
        and (x.split = y.split or (if(x.split, y.once, x.once))))))"""
    near = lists.where("size(m) > 1").select(F.explode(F.expr(beside)).alias("x")).where("size(x.near) > 0")
    near = near.select("x.id", F.size("x.near").alias("c"), F.expr("named_struct('n', x.near[0].n, 'back', x.near[0].back)").alias("best"))
    near = tables.store(near.groupBy("id").agg(F.sum("c").alias("n_near"), F.max("best").alias("best")), "near")

    slim = both.select(F.col("f_at").alias("id"), "word", "n")
    joined = slim.join(near, "id", "left").withColumn("_has", F.coalesce(F.col("best.n") >= rules.ratio * F.col("n"), F.lit(False)))
    joined = tables.store(
        joined.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("_has"), -F.col("best.back")).alias("form"), F.when(F.col("_has"), F.col("best.n")).alias("form_n")),
        "joined")
    tables.drop("counts", "forward", "backward", "near")
    forms = joined.where("form is not null").select("id", "form")
    named = joined.select(F.col("id").alias("key"), F.col("word").alias("name"))
    roots = _roots(tables, forms).join(named, F.col("root") == F.col("key")).select("id", F.col("name").alias("root"))
    forms = forms.join(named, F.col("form") == F.col("key")).select("id", F.col("name").alias("form")).join(roots, "id")
    return joined.drop("form").join(forms, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
