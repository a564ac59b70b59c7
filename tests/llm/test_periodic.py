"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from llm_helpers import ascii_words
from strandloom.llm import arrays, periodic, queries


def _plain(words):
    """Every maximal stretch of each period, shortest period first; equal stretches keep the first."""
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    codes = np.array([number[w] for w in words], np.int64)
    found = {}
    for q in range(1, len(words) // 4 + 1):
        same = np.concatenate([[False], codes[:-q] == codes[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for s, e in edges.reshape(-1, 2).tolist():
            if e + q - s >= max(6, 4 * q):
                found.setdefault((s, e + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def _result(doc_id, text, planted):
    words = ascii_words(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = _plain(words)
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    return (len(runs), *top, 1000 * top[1] // top[2] if runs else None, hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest())


def _row(r):
    return r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256


def _codes(items):
    return arrays.mix(np.array(items, np.uint64) + np.uint64(1))


def test_transform_multiplies_polynomials():
    rng = np.random.default_rng(3)
    for size in (2, 8, 256):
        a, b = rng.integers(0, periodic._PRIME, (2, size, 3)).astype(np.uint64)
        want = [[sum(int(a[i, k]) * int(b[(t - i) % size, k]) for i in range(size)) % periodic._PRIME for k in range(3)] for t in range(size)]
        got = periodic.restore(periodic._reduce(periodic.transform(a.copy()) * periodic.transform(b.copy())))
        assert got.tolist() == want


def test_random_texts_of_repeats():
    rng = random.Random(1)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 5)):
            letters, out = rng.choice([1, 2, 3, 50]), []
            for _ in range(rng.randint(0, 4)):
                stretch = [rng.randrange(letters) for _ in range(rng.randint(1, rng.choice([1, 2, 5, 17, 40, 130, 300])))]
                out += (stretch * 10)[: int(len(stretch) * rng.uniform(1, 9))]
            texts.append(out)
        offsets = np.cumsum([0] + [len(t) for t in texts])
        start, end, period = periodic.find_runs(_codes([w for t in texts for w in t]), offsets)
        want = [(s + o, s + o + size, q) for t, o in zip(texts, offsets.tolist()) for s, size, q in _plain(t)]
        assert list(zip(start.tolist(), end.tolist(), period.tolist())) == want


def test_long_uniform_and_long_period():
    for text, want in (([1] * 200_000, [(0, 200_000, 1)]), ([1, 2] * 100_000 + [3] + [2, 1] * 50_000, [(0, 200_000, 2), (200_001, 300_001, 2)])):
        start, end, period = periodic.find_runs(_codes(text), np.array([0, len(text)]))
        assert list(zip(start.tolist(), end.tolist(), period.tolist())) == want
    part = list(range(10_007))
    start, end, period = periodic.find_runs(_codes([9_999_999] + part * 4 + [5]), np.array([0, 4 * 10_007 + 2]))
    assert (start.tolist(), end.tolist(), period.tolist()) == ([1], [4 * 10_007 + 1], [10_007])
    with pytest.raises(ValueError):
        periodic.find_runs(_codes([1]), np.array([0, 1]), periodic.Rules(powers=3))


def test_tricky_rows(tricky, tricky_rows, nothing, spark):
    texts = {r[0]: r[1] for r in tricky_rows}
    for planted in (False, True):
        found = periodic.periodic_runs(tricky, planted=planted).collect()
        assert len(found) == len(tricky_rows)
        for r in found:
            assert _row(r) == _result(r.doc_id, texts[r.doc_id], planted)
    assert periodic.periodic_runs(nothing).count() == 0
    none = spark.createDataFrame([(None, "a " * 50), (None, None)], "doc_id long, text string")
    assert sorted(_row(r)[0] for r in periodic.periodic_runs(none, planted=True).collect()) == [0, 1]


def test_ties_take_the_smallest_start(spark):
    text = "a a a a a a x b b b b b b y " + "c d " * 6 + "z"
    row = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert _row(row) == _result(1, text, False) and (row.start, row.length, row.period) == (0, 6, 1)
    listed = sorted((r.start, r.length, r.period) for r in periodic.runs_table(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect())
    assert listed == _plain(ascii_words(text))


def test_query_matches_brute_force(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = queries.QUERIES["op12_periodic_runs"](spark, folder).collect()
    assert len(found) == len(texts) and sum(r.n_runs > 0 for r in found) > 5
    for r in found:
        assert _row(r) == _result(r.doc_id, texts[r.doc_id], True)
