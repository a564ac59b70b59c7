"""Language-model scores: corpus word statistics and a subword lattice.

A word's probability sums over all its segmentations into pieces of an existing vocabulary, by a forward recursion in log
space; piece probabilities come from the training documents. A text is its words and then an end.

Counts cover all documents. One pass turns each chunk of documents into one row per distinct word, with the documents
that hold it, so a word of every document is a row per chunk and not a row per document. Counting and scoring meet on the
word; scores go back to their chunk, where they are summed by document.

Defined cases: a null or empty text has the end alone; a null id counts as remainder -1, so it trains; equal rows are
scored alike, each on its own; without training documents N = V = 0 and pieces are equally likely; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import arrays
from strandloom.llm.storage import stored

START = "▁".encode()
# A row is a word of a chunk (its texts as places in the chunk, one for each time), or a text (key is its chunk plus its place).
_OCCURS = "word binary, train long, chunk long, places array<int>, key long, doc_id long, held_out boolean, n_words long"


def _chunk_rows(words: list[pa.Array], owners: list[np.ndarray], train: np.ndarray, chunk: int) -> Iterator[pa.RecordBatch]:
    coded = pa.chunked_array(words).combine_chunks().dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    n = len(train)
    pair, tf = np.unique(code * n + np.concatenate(owners), return_counts=True)
    code, doc = pair // n, pair % n
    first = np.searchsorted(code, np.arange(len(coded.dictionary) + 1))
    held = np.bincount(code, tf * train[doc], len(coded.dictionary)).astype(np.int64)
    times = np.concatenate([[0], np.cumsum(tf)])
    step = 20_000
    for a in range(0, len(coded.dictionary), step):
        b = min(a + step, len(coded.dictionary))
        at = pa.array(times[first[a: b + 1]] - times[first[a]], pa.int32())
        i, j = first[a], first[b]
        none = pa.nulls(b - a)
        yield pa.RecordBatch.from_arrays([
            coded.dictionary.slice(a, b - a).cast(pa.binary()), pa.array(held[a:b]), pa.array(np.full(b - a, chunk)),
            pa.ListArray.from_arrays(at, pa.array(np.repeat(doc[i:j], tf[i:j]), pa.int32())), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.bool_()), none.cast(pa.int64()),
        ], names=[c.split(" ")[0] for c in _OCCURS.split(", ")])


def _occurrences(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        key = task.partitionId() << 33
        words, owners, train, total, docs = [], [], [], 0, 0
        for whole in batches:
            for batch in arrays.slices(whole, "text"):
                data, offsets = arrays.text_bytes(batch.column("text"))
                data = arrays.lower_ascii(data)
                starts, ends, first = arrays.word_bounds(data, offsets)
                own = np.arange(key, key + batch.num_rows)
                key += batch.num_rows
                held = batch.column("held_out").to_numpy(zero_copy_only=False)
                none = pa.nulls(batch.num_rows, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([
                    pa.nulls(batch.num_rows, pa.binary()), *[pa.nulls(batch.num_rows, pa.int64())] * 2, none, pa.array(own), batch.column("doc_id"),
                    batch.column("held_out"), arrays.as_long(np.diff(first)),
                ], names=[c.split(" ")[0] for c in _OCCURS.split(", ")])
                body = data[~arrays.WHITE[data]]
                ats = np.zeros(len(starts) + 1, np.int64)
                np.cumsum(ends - starts, out=ats[1:])
                words.append(pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ats), pa.py_buffer(body)]))
                owners.append(arrays.owner(first) + docs)
                train.append(~held)
                docs += batch.num_rows
                total += len(starts)
                if total >= limit:
                    yield from _chunk_rows(words, owners, np.concatenate(train), key - docs)
                    words, owners, train, total, docs = [], [], [], 0, 0
        if total:
            yield from _chunk_rows(words, owners, np.concatenate(train), key - docs)

    return run


def _count_pieces(model_file: str):
    """Pieces of the training words under the vocabulary's own segmentation, times the words' counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        coder = sentencepiece.SentencePieceProcessor(model_file=model_file)
        total = np.zeros(coder.get_piece_size(), np.int64)
        for batch in batches:
            ids = coder.encode([w.decode() for w in batch.column("word").to_pylist()], num_threads=1)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for own in ids for i in own), np.int64, int(sizes.sum()))
            total += np.bincount(flat, np.repeat(batch.column("c").to_numpy(), sizes), len(total)).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["piece", "n"])

    return run


def vocabulary(model_file: str) -> list[bytes | None]:
    """Bytes of each piece; byte-fallback pieces are single bytes, control pieces None."""
    import sentencepiece

    coder = sentencepiece.SentencePieceProcessor(model_file=model_file)
    out: list[bytes | None] = []
    for i in range(coder.get_piece_size()):
        if coder.is_control(i) or coder.is_unknown(i):
            out.append(None)
        elif coder.is_byte(i):
            out.append(bytes([int(coder.id_to_piece(i)[3:5], 16)]))
        else:
            out.append(coder.id_to_piece(i).encode())
    return out


class Lattice:
    """Log probabilities of words over all segmentations; ``logs`` are natural logs by piece bytes."""

    def __init__(self, logs: dict[bytes, float]):
        self.logs = logs
        self.longest = max(map(len, logs))
        pieces = list(logs)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        hashes = arrays.span_hash(flat, np.concatenate([[0], ends[:-1]]), ends)
        self.bits = max(4, (4 * len(pieces)).bit_length())
        size = 1 << self.bits
        self.slot_hash, self.slot_log = np.zeros(size, np.uint64), np.full(size, -np.inf)
        for h, p in zip(hashes.tolist(), pieces):
            at = h & (size - 1)
            while self.slot_hash[at]:
                at = (at + 1) & (size - 1)
            self.slot_hash[at], self.slot_log[at] = h, logs[p]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Log probability of the pieces with these hashes, -inf where there is none."""
        mask = np.uint64((1 << self.bits) - 1)
        at = hashes & mask
        out = np.full(len(hashes), -np.inf)
        open_ = np.arange(len(hashes))
        while len(open_):
            slot = self.slot_hash[at[open_]]
            hit = slot == hashes[open_]
            out[open_[hit]] = self.slot_log[at[open_[hit]]]
            open_ = open_[~hit & (slot != 0)]
            at[open_] = at[open_] + np.uint64(1) & mask
        return out

    def word(self, word: bytes) -> float:
        """One word, by plain recursion; for long words and tests."""
        text = START + word
        alpha = [0.0] + [-math.inf] * len(text)
        for j in range(1, len(text) + 1):
            terms = [alpha[i] + p for i in range(max(0, j - self.longest), j) if (p := self.logs.get(text[i:j])) is not None]
            top = max(terms, default=-math.inf)
            if top > -math.inf:
                alpha[j] = top + math.log(sum(math.exp(t - top) for t in terms))
        return alpha[-1]

    def words(self, words: list[bytes], long: int = 64) -> np.ndarray:
        out = np.empty(len(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(sizes > long).tolist():
            out[i] = self.word(words[i])
        order = np.flatnonzero(sizes <= long)
        order = order[np.argsort(-sizes[order], kind="stable")]
        for a in range(0, len(order), 2048):
            own = order[a: a + 2048]
            out[own] = self._forward([START + words[i] for i in own.tolist()])
        return out

    def _forward(self, texts: list[bytes]) -> np.ndarray:
        """Texts in order of falling length; position by position over all of them."""
        sizes = np.array([len(t) for t in texts])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        data = np.frombuffer(b"".join(texts), np.uint8)
        alpha = np.full((len(texts), int(sizes[0]) + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, int(sizes[0]) + 1):
            n = int(np.searchsorted(-sizes, -j, "right"))
            widths = range(1, min(j, self.longest) + 1)
            begin = np.concatenate([starts[:n] + j - w for w in widths])
            order = np.argsort(begin, kind="stable")
            end = np.concatenate([starts[:n] + j] * len(widths))
            hashes = np.empty(len(begin), np.uint64)
            hashes[order] = arrays.span_hash(data, begin[order], end[order])
            logs = self._find(hashes).reshape(len(widths), n)
            terms = logs + np.stack([alpha[:n, j - w] for w in widths])
            top = terms.max(axis=0)
            safe = np.where(top > -np.inf, top, 0)
            with np.errstate(divide="ignore"):
                alpha[:n, j] = safe + np.log(np.exp(terms - safe).sum(axis=0))
        return alpha[np.arange(len(texts)), sizes]


def _word_scores(logs: dict[bytes, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(logs)
        for batch in batches:
            found = lattice.words(batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "logp"])

    return run


def _sums(limit: int):
    """Known tokens, base sum over counts and lattice sum of every text; all rows of a chunk are in one partition."""
    def total(parts: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
        key, *values = (np.concatenate(x) for x in zip(*parts))
        own, at = np.unique(key, return_inverse=True)
        return [(own, *(np.bincount(at, x, len(own)) for x in values))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            lists = batch.column("places")
            each = np.diff(lists.offsets.to_numpy())
            count = batch.column("c").to_numpy()
            key = lists.flatten().to_numpy() + np.repeat(batch.column("chunk").to_numpy(), each)
            values = (count > 0).astype(float), np.log10(count + 0.5), batch.column("logp").to_numpy()
            parts.append((key, *(np.repeat(v, each) for v in values)))
            size += len(key)
            if size >= limit:
                parts, size = total(parts), 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in total(parts)[0]], names=["key", "known", "base", "model"])

    return run


def lm_scores(docs: DataFrame, model_file: str, held_out, id_col: str = "doc_id", text_col: str = "text", chunk_words: int = 2_000_000) -> DataFrame:
    """Base and lattice scores of every document; ``held_out`` is a column that marks what must not train.

    ``chunk_words`` bounds the words gathered in a task before their rows go out.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    rows = stored(slim.mapInArrow(_occurrences(chunk_words), _OCCURS), "occurrences")
    texts = rows.where(F.col("key").isNotNull()).select("key", "doc_id", "held_out", "n_words")
    occurs = rows.where(F.col("key").isNull()).select("word", "train", "chunk", "places")

    counts = stored(occurs.groupBy("word").agg(F.sum("train").alias("c")), "words")
    ends = texts.where(~F.col("held_out")).count()
    sums = counts.where("c > 0").agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    n, v = sums["n"] + ends, sums["v"] + (ends > 0)

    pieces = vocabulary(model_file)
    found = {r["piece"]: r["n"] for r in counts.where("c > 0").mapInArrow(_count_pieces(model_file), "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    weights: dict[bytes, float] = {}
    for i, piece in enumerate(pieces):
        if piece:
            weights[piece] = weights.get(piece, 0.0) + found.get(i, 0) + 0.5
    total = math.log(sum(weights.values()))
    logs = {p: math.log(w) - total for p, w in weights.items()}

    scored = counts.mapInArrow(_word_scores(logs), "word binary, c long, logp double")
    parts = occurs.drop("train").join(scored, "word").select("chunk", "places", "c", "logp").repartition("chunk")
    sums = parts.mapInArrow(_sums(chunk_words), "key long, known double, base double, model double")
    stop = (ends + 0.5) / (n + 1.0)
    zero = F.lit(0.0)
    return texts.join(sums, "key", "left").select(
        "doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"),
        (F.coalesce("known", zero) + F.lit(int(ends > 0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.coalesce("base", zero) + F.lit(math.log10(ends + 0.5)) - (F.col("n_words") + 1) * F.lit(math.log10(n + 0.5 * (v + 1)))).alias("base_score"),
        (F.coalesce("model", zero) / F.lit(math.log(10)) + F.col("n_words") * F.lit(math.log10(1 - stop)) + F.lit(math.log10(stop))).alias("score"))
