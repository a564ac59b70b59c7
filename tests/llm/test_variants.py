"""Spelling variants against a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from llm_helpers import prose
from strandloom.llm import queries, variants

RULES = variants.Rules(deletion=31)


def _words(rows, deletion):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if deletion and doc_id is not None and h % deletion == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def _plain(counts):
    forms, near = {}, {}
    words = sorted(counts)
    for w in words:
        beside = [v for v in words if _near(w, v)]
        near[w] = len(beside)
        top = min(beside, key=lambda v: (-counts[v], v), default=None)
        forms[w] = top if top is not None and counts[top] >= 10 * counts[w] else None
    out = []
    for w in words:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, counts[w], near[w], counts[forms[w]] if forms[w] else None))
    return out


def _rows(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def _corpus(rng, size):
    """Few stems with many variants: hot letter places, doubled letters, letters outside ASCII, chains of forms."""
    stems = ["aaaaaaab", "abcdefgh", "Ébcdéfgÿ", "mississippi", "colourful", "x" * 80]
    out = []
    for stem in stems:
        for _ in range(size):
            w = stem
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                i, c = rng.randrange(len(w)), rng.choice("abcdxyzÀé")
                w = rng.choice([w[:i] + c + w[i + 1:], w[:i] + c + w[i:], w[:i] + w[i + 1:]])
            out.append(w)
    out += ["abcdefgx"] * 900 + ["abcdefxx"] * 60 + ["abcdexxx"] * 3
    rng.shuffle(out)
    return [(i, " ".join(out[i::40])) for i in range(40)]


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_all_pairs(spark, parts):
    rng = random.Random(parts)
    rows = _corpus(rng, 120)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        want = _plain(_words(rows, 31))
        assert _rows(variants.spelling_variants(docs, RULES)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] and r[1] is not None for r in want) and max(r[4] for r in want) > 8


def test_tricky_rows(spark, tricky, tricky_rows, nothing):
    assert _rows(variants.spelling_variants(tricky, RULES)) == _plain(_words([(r[0], r[1]) for r in tricky_rows], 31))
    assert _rows(variants.spelling_variants(tricky)) == _plain(_words([(r[0], r[1]) for r in tricky_rows], None))
    assert variants.spelling_variants(nothing, RULES).count() == 0
    none = spark.createDataFrame([(None, "abcdefgh abcdefgh " * 9), (None, None)], "doc_id long, text string")
    assert _rows(variants.spelling_variants(none, RULES)) == [("abcdefgh", None, "abcdefgh", 18, 0, None)]


def test_crc_of_spans():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcé", k=rng.choice([7, 8, 20, 63, 64, 65, 300]))).encode() for _ in range(200)]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    heads = [zlib.crc32(f"{i}:".encode()) for i in range(len(words))]
    got = variants._crc(data, ends - [len(w) for w in words], ends, np.array(heads, np.uint32))
    assert got.tolist() == [zlib.crc32(f"{i}:".encode() + w) for i, w in enumerate(words)]


def test_query_counts(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    counts = _words(rows, 31)
    found = queries.QUERIES["op11_spelling_variants"](spark, folder).collect()
    assert {r.word: r.n for r in found} == counts and len(found) == len(counts)
    rng = random.Random(2)
    names = sorted(counts)
    for r in rng.sample(found, 60):
        beside = [v for v in names if _near(r.word, v)]
        top = min(beside, key=lambda v: (-counts[v], v), default=None)
        form = top if top is not None and counts[top] >= 10 * r.n else None
        assert (r.n_near, r.form, r.form_n) == (len(beside), form, counts[form] if form else None)
