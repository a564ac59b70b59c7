"""Quality classifier: a factorisation machine over hashed words, structure statistics and size metadata.

Fitting sums log-loss gradients over the partitions of a bounded sample of the labelled rows, one Spark job a round, and
updates the weights (a table of fixed size) by Adam on the driver. Scoring is one narrow pass over all texts: with weights w and factors V, the pairwise part of a text x is
``0.5 * sum_f ((sum_i V_if x_i)^2 - sum_i V_if^2 x_i^2)``, linear in the number of its non-zero features.

Inputs of a score come from the text alone. Defined cases: a null text counts as empty and gets the score of a text
without words; several labels of one document are averaged (0.5 counts as 1), null labels are left out; with no
labelled row, or with a single class, every score is the share of label 1 (0.5 without any label).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import arrays

N_STATS = 16


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 12
    factors: int = 4
    rounds: int = 60
    step: float = 0.08
    regularisation: float = 1e-4
    seed: int = 7
    #: Partitions of the bounded sample while fitting.
    parts: int = 12
    #: Labelled rows to fit on, about; the rows with the smallest id hashes are taken.
    sample_rows: int = 20_000
    threshold: float = 0.3


@dataclass(frozen=True)
class Model:
    settings: Settings
    intercept: float
    linear: np.ndarray | None
    factors: np.ndarray | None


def _stats(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Structure statistics and size metadata of each text, all between 0 and about 1."""
    def per_text(flags):
        total = np.zeros(len(flags) + 1, np.float64)
        np.cumsum(flags, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    def per_word(values):
        total = np.zeros(len(values) + 1, np.float64)
        np.cumsum(values, out=total[1:])
        return total[words[1:]] - total[words[:-1]]

    n_bytes = np.maximum(np.diff(offsets), 1).astype(float)
    n_words = np.maximum(np.diff(words), 1).astype(float)
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    symbol = np.isin(data, np.frombuffer(b"#*$%&|<>{}[]\\^~_=+@", np.uint8))
    mark = np.isin(data, np.frombuffer(b".,;:!?\"'()-", np.uint8))
    text = arrays.owner(words)
    length = (ends - starts).astype(float)
    same = np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    order = np.lexsort((hashes, text))
    fresh = np.ones(len(hashes), bool)
    if len(hashes) > 1:
        fresh[order[1:]] = (hashes[order][1:] != hashes[order][:-1]) | (text[order][1:] != text[order][:-1])
    pairs = arrays.window_hash(hashes, 3)
    inside = np.flatnonzero(text[: len(pairs)] == text[2:]) if len(pairs) else np.zeros(0, np.int64)
    old = np.zeros(len(hashes))
    if len(inside):
        key, at = pairs[inside], text[inside]
        order = np.lexsort((key, at))
        old[inside[order[1:]]] = (key[order][1:] == key[order][:-1]) & (at[order][1:] == at[order][:-1])
    mean_len = per_word(length) / n_words
    out = np.stack([
        per_text(letter) / n_bytes, per_text(upper) / n_bytes, np.minimum(1, 8 * per_text(digit) / n_bytes),
        np.minimum(1, 8 * per_text(symbol) / n_bytes), np.minimum(1, 8 * per_text(mark) / n_bytes),
        per_word(same) / n_words, per_word(fresh) / n_words, per_word(old) / n_words,
        np.minimum(1, mean_len / 12), np.minimum(1, np.sqrt(np.maximum(0, per_word(length**2) / n_words - mean_len**2)) / 8),
        np.log1p(np.diff(words)) / 12, np.log1p(np.diff(offsets)) / 14, np.minimum(1, 30 * per_text(data == 10) / n_bytes),
        np.minimum(1, 20 * per_text(data == 33) / n_bytes), (np.diff(words) < 20).astype(float), np.minimum(1, per_word(length > 24) / n_words * 10),
    ], axis=1)
    return out


def features(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: offsets, feature numbers and values. Words come first, then the statistics."""
    data, offsets = arrays.text_bytes(column)
    starts, ends, words = arrays.word_bounds(data, offsets)
    hashes = arrays.span_hash(arrays.lower_ascii(data), starts, ends)
    stats = _stats(data, offsets, starts, ends, words, hashes)
    n = len(offsets) - 1
    flat = arrays.owner(words) * buckets + (hashes & np.uint64(buckets - 1)).astype(np.int64)
    key, count = np.unique(flat, return_counts=True)
    row, number = key // buckets, key % buckets
    value = 1 + np.log(count)
    norm = np.sqrt(np.bincount(row, value**2, n))
    value = value / norm[row] if len(row) else value
    row = np.concatenate([row, np.repeat(np.arange(n), N_STATS)])
    number = np.concatenate([number, np.tile(buckets + np.arange(N_STATS), n)])
    value = np.concatenate([value, stats.reshape(-1)])
    order = np.lexsort((number, row))
    return np.searchsorted(row[order], np.arange(n + 1)), number[order], value[order]


def score(model: Model, offsets: np.ndarray, number: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Probability of label 1 by the sum-of-squares identity."""
    n = len(offsets) - 1
    raw = np.full(n, model.intercept)
    if model.linear is not None and n:
        row = np.repeat(np.arange(n), np.diff(offsets))
        raw += np.bincount(row, model.linear[number] * value, n)
        for f in range(model.factors.shape[1]):
            part = model.factors[number, f] * value
            raw += 0.5 * (np.bincount(row, part, n) ** 2 - np.bincount(row, part**2, n))
    return 1 / (1 + np.exp(-np.clip(raw, -60, 60)))


def _extract(buckets: int, text_col: str):
    """Labels and sparse features of a slice of rows, as the bytes of flat arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrays.slices(whole, text_col):
                offsets, number, value = features(batch.column(text_col), buckets)
                parts = batch.column("label").to_numpy(), offsets.astype(np.int64), number.astype(np.int32), value.astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["label", "at", "number", "value"])

    return run


def _gradient(linear: np.ndarray, factors: np.ndarray, intercept: float):
    """Sums over a partition: gradient of the intercept, of the linear weights and of the factors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(linear)
        total = np.zeros(1 + size * (1 + factors.shape[1]))
        for batch in batches:
            for label, at, number, value in zip(*(c.to_pylist() for c in batch.columns)):
                label, at, number, value = (np.frombuffer(x, t) for x, t in ((label, np.float64), (at, np.int64), (number, np.int32), (value, np.float32)))
                n = len(label)
                row = np.repeat(np.arange(n), np.diff(at))
                raw = intercept + np.bincount(row, linear[number] * value, n)
                sums = []
                for f in range(factors.shape[1]):
                    part = factors[number, f] * value
                    sums.append(np.bincount(row, part, n))
                    raw += 0.5 * (sums[-1] ** 2 - np.bincount(row, part**2, n))
                off = 1 / (1 + np.exp(-np.clip(raw, -60, 60))) - label
                push = off[row] * value
                total[0] += off.sum()
                total[1: 1 + size] += np.bincount(number, push, size)
                for f, own in enumerate(sums):
                    total[1 + size * (f + 1): 1 + size * (f + 2)] += np.bincount(number, push * (own[row] - factors[number, f] * value), size)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    return run


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on labelled rows of ``docs``; the caller leaves out what must stay unseen, in ``labels`` too.

    ``sample_rows`` bounds the fitted rows, and so the broadcast ids: the share of labels kept is that bound over
    their count, by a hash of the id. Everything else of the library's statistics covers all rows.
    """
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg((F.avg(label_col) >= 0.5).cast("double").alias("label"))
    total = known.count()
    share = min(1.0, settings.sample_rows / max(total, 1))
    bucket = F.pmod(F.xxhash64("_id", F.lit(settings.seed)), F.lit(1 << 53))
    known = known.where(bucket < int(share * (1 << 53)))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias(text_col))
    rows = rows.join(F.broadcast(known), "_id").select("label", text_col)
    rows = rows.mapInArrow(_extract(settings.buckets, text_col), "label binary, at binary, number binary, value binary")
    counts = known.groupBy("label").count().collect()
    seen = {r["label"]: r["count"] for r in counts}
    n, ones = sum(seen.values()), seen.get(1.0, 0)
    start = float(np.log((ones + 0.5) / (n - ones + 0.5)))
    if len(seen) < 2:
        return Model(settings, start, None, None)
    rows = rows.repartition(settings.parts).persist()
    size = settings.buckets + N_STATS
    weights = np.concatenate([[start], np.zeros(size), np.random.default_rng(settings.seed).normal(0, 0.05, size * settings.factors)])
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, settings.rounds + 1):
        step = _gradient(weights[1: 1 + size], weights[1 + size:].reshape(settings.factors, size).T, weights[0])
        slope = sum(np.frombuffer(r["total"]) for r in rows.mapInArrow(step, "total binary").collect()) / n
        slope[1:] += settings.regularisation * weights[1:]
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        weights = weights - settings.step * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    rows.unpersist()
    return Model(settings, float(weights[0]), weights[1: 1 + size], weights[1 + size:].reshape(settings.factors, size).T)


def score_all(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` id and ``score`` for every row; a narrow pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrays.slices(whole, text_col):
                found = score(model, *features(batch.column(text_col), model.settings.buckets))
                yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(found, pa.float64())], names=[id_col, "score"])

    slim = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return slim.mapInArrow(run, f"{id_col} long, score double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, whose score reaches the threshold; a narrow pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrays.slices(whole, text_col):
                found = score(model, *features(batch.column(text_col), model.settings.buckets))
                yield batch.filter(pa.array(found >= model.settings.threshold))

    return docs.mapInArrow(run, docs.schema)


def fold(id_col: str, folds: int = 5):
    """Remainder of crc32 over the id as text."""
    return F.crc32(F.col(id_col).cast("long").cast("string")) % folds


def fit_outside(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), held: int = 0) -> Model:
    """Fit without the documents and the labels of the fold ``held``: they reach no count, sample or weight."""
    return fit(docs.where(fold("doc_id") != held), labels.where(fold("doc_id") != held), settings)


def quality(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; fitted without the fold 0."""
    model = fit_outside(docs, labels, settings)
    return score_all(docs, model).select(
        "doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= settings.threshold).cast("int").alias("predicted"))
