"""Per-text operators against plain Python."""

import base64
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_helpers import ascii_words, prose
from strandloom.llm import arrays, bands, fm, lattice, longest_match, packing, queries


def test_words_and_hashes(tricky_rows):
    column = pa.array([r[1] for r in tricky_rows])
    data, offsets = arrays.text_bytes(column)
    starts, ends, first = arrays.word_bounds(data, offsets)
    words = [data[s:e].tobytes() for s, e in zip(starts, ends)]
    assert [words[a:b] for a, b in zip(first, first[1:])] == [ascii_words(r[1]) for r in tricky_rows]
    hashes = arrays.span_hash(data, starts, ends).tolist()
    assert len(set(zip(words, hashes))) == len(set(words)) == len(set(hashes))


def test_long_spans_hash_by_content():
    data = np.frombuffer(b"y" * 600_000 + b" ab " + b"y" * 600_000 + b" ab", np.uint8)
    starts, ends, _ = arrays.word_bounds(data, np.array([0, len(data)]))
    h = arrays.span_hash(data, starts, ends)
    assert h[0] == h[2] != h[1] == h[3]


@pytest.mark.parametrize("size", [130_000, 131_071, 131_072, 200_000, 262_143, 262_144, 270_000])
def test_spans_of_a_block_hash_alike_everywhere(size):
    word = np.random.default_rng(size).integers(97, 123, size).astype(np.uint8).tobytes()
    other = np.random.default_rng(7).integers(97, 123, size).astype(np.uint8).tobytes()
    hashes = set()
    for before in (0, 5, 60_000, 100_000, 131_060, 140_000, 200_000):
        text = b"ab " * (before // 3) + word + b" tail " + other
        data = np.frombuffer(text, np.uint8)
        starts, ends, _ = arrays.word_bounds(data, np.array([0, len(data)]))
        h = arrays.span_hash(data, starts, ends)
        assert ends[-3] - starts[-3] == size
        hashes.add((int(h[-3]), int(h[-1])))
    assert len(hashes) == 1 and len(set(hashes.pop())) == 2


def _bands(text):
    words = ascii_words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += line in seen
        if ascii_words(line):
            seen.add(line)
    windows = Counter(tuple(words[i: i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i: i + 8])] > 1 for k in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered), failed


def test_bands(tricky, tricky_rows, nothing):
    found = bands.compression_bands(tricky).collect()
    assert len(found) == len(tricky_rows)
    texts = {r[0]: r[1] for r in tricky_rows}
    for r in found:
        want = _bands(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.kept and r.base_failed) and r.kept == (not r.base_failed and r.verdict == "kept")
    by_id = {r.doc_id: r for r in found}
    assert by_id[5].kept and by_id[15].kept and by_id[11].verdict == "repetitive" and by_id[0].verdict == "empty"
    assert bands.compression_bands(nothing).count() == 0


def test_bands_reject_noise(spark):
    rng = np.random.default_rng(1)
    noise = " ".join("".join(chr(c) for c in rng.integers(33, 20000, 12)) for _ in range(300))
    assert bands.compression_bands(spark.createDataFrame([(1, noise)], "doc_id long, text string")).first().verdict.startswith("incompressible")


def test_bands_reject_noise_within_long_prose(spark):
    rng = random.Random(9)
    rows = []
    for i in range(4):
        text = prose(rng, 4000)[:12_000 + 700 * i]
        blob = base64.b64encode(rng.randbytes(3000)).decode()
        at = 4000 + 513 * i
        rows += [(10 * i, text), (10 * i + 1, text[:at] + blob[:2048] + text[at:]), (10 * i + 2, text + blob[:2040])]
        rows += [(10 * i + 3, text[:at] + "ab" * 2800 + text[at:])]
    found = {r.doc_id: r.verdict for r in bands.compression_bands(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = ["kept", "incompressible chunk", "incompressible chunk", "repetitive chunks"]
    assert found == {10 * i + k: v for i in range(4) for k, v in enumerate(want)}


def test_chunks_cover_every_byte():
    for size in (1, 2047, 2048, 2049, 3071, 3072, 3073, 4096, 10_001):
        starts = bands.chunk_starts(size, 2048)
        assert (starts == []) == (size < 2048)
        assert not starts or starts[0] == 0 and starts[-1] == size - 2048 and all(0 < b - a <= 1024 for a, b in zip(starts, starts[1:]))


def test_bands_query_matches_brute_force(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in queries.QUERIES["op2_quality_rules"](spark, folder).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == _bands(texts[r.doc_id])


def test_sum_of_squares_identity():
    rng = np.random.default_rng(2)
    number, value = np.array([1, 4, 7, 2]), rng.normal(size=4)
    model = fm.Model(fm.Settings(), 0.3, rng.normal(size=9), rng.normal(size=(9, 3)))
    got = fm.score(model, np.array([0, 3, 3, 4]), number, value)
    for i, own in enumerate(([0, 1, 2], [], [3])):
        raw = 0.3 + sum(model.linear[number[k]] * value[k] for k in own)
        raw += sum(model.factors[number[a]] @ model.factors[number[b]] * value[a] * value[b] for x, a in enumerate(own) for b in own[x + 1:])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-raw)))


def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.QUERIES["op1_quality_classifier"](spark, folder).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(found) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    held = [(r.score, labels[r.doc_id]) for r in found if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.9
    assert np.mean([(s >= 0.3) == (y == 1) for s, y in held]) > 0.9


def test_held_out_labels_reach_no_score(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(fm.fold("doc_id") == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert labels.exceptAll(flipped).count() > 5
    few = fm.Settings(rounds=3)
    scores = [{r.doc_id: r.score for r in fm.quality(docs, rows, few).collect()} for rows in (labels, flipped, labels.where(fm.fold("doc_id") != 0))]
    assert scores[0] == scores[1] == scores[2]


def test_classifier_features_and_scores_by_hand(spark):
    texts = {1: "One two two", 2: None, 3: "a b c d e f g", 4: "x " * 40}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    settings = fm.Settings(buckets=64)
    size = settings.buckets + fm.N_STATS
    rng = np.random.default_rng(5)
    model = fm.Model(settings, -0.2, rng.normal(size=size), rng.normal(size=(size, settings.factors)))
    got = {r.doc_id: r.score for r in fm.score_all(docs, model).collect()}
    for key, text in texts.items():
        _, number, value = fm.features(pa.array([text]), settings.buckets)
        x = np.zeros(size)
        np.add.at(x, number, value)
        raw = model.intercept + x @ model.linear + sum(model.factors[a] @ model.factors[b] * x[a] * x[b] for a in range(size) for b in range(a))
        assert got[key] == pytest.approx(1 / (1 + math.exp(-raw)))
        counts = Counter(ascii_words(text, True))
        weights = sorted(1 + math.log(n) for n in counts.values())
        norm = math.sqrt(sum(w * w for w in weights)) or 1.0
        found = value[number < settings.buckets]
        if len(found) == len(counts):
            assert sorted(found) == pytest.approx([w / norm for w in weights])


def test_classifier_edges(spark, tricky, nothing):
    few = fm.Settings(rounds=3)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in fm.quality(tricky, none, few).collect()} == {0.5}
    ones = spark.createDataFrame([(5, 1), (6, 1), (7, None)], "doc_id long, quality int")
    assert {r.predicted for r in fm.quality(tricky, ones, few).collect()} == {1}
    both = spark.createDataFrame([(i, int(i % 2)) for i in range(24)] + [(3, 0)], "doc_id long, quality int")
    found = fm.quality(tricky, both, few).collect()
    assert len(found) == tricky.count() and len({r.score for r in found if r.doc_id in (0, 1)}) == 1
    assert fm.quality(nothing, both, few).count() == 0


def test_automaton_equals_greedy(tricky, tricky_rows, nothing):
    path = queries.vocabulary("byte_bpe_50k.tiktoken")
    pieces = set(longest_match.read_ranks(path))
    longest = max(map(len, pieces))

    def greedy(word):
        word, n = b" " + word, 0
        while word:
            word, n = word[max(k for k in range(1, min(longest, len(word)) + 1) if word[:k] in pieces):], n + 1
        return n

    texts = {r[0]: r[1] for r in tricky_rows}
    found = longest_match.token_counts(tricky, path).collect()
    for r in found:
        words = ascii_words(texts[r.doc_id])
        assert (r.n_words, r.n_bytes, r.n_unknown) == (len(words), len((texts[r.doc_id] or "").encode()), 0)
        if r.doc_id != 15:
            assert r.n_tokens == sum(map(greedy, words))
    assert longest_match.token_counts(nothing, path).count() == 0


def test_automaton_with_gaps():
    a = longest_match.Automaton([b" a", b" abcd", b"b", b"bc", b"cx", b" "])
    assert [a.count(w) for w in (b"a", b"abc", b"abcd", b"abcx", b"abb", b"q", b"abq")] == [1, 2, 1, -1, 3, -1, -1]


def test_token_query_covers_all(spark, folder):
    assert queries.QUERIES["op7_token_counts"](spark, folder).count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def _check_packing(rows, texts, capacity, copies):
    import tokenizers

    coder = tokenizers.Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    want = Counter()
    for doc, text in texts:
        ids = np.array(coder.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), capacity):
            want[doc, k // capacity, k, len(ids[k: k + capacity]), zlib.crc32(ids[k: k + capacity].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r.length for r in rows) // capacity)


def test_packing(tricky, tricky_rows, nothing):
    path = queries.vocabulary("word_bpe_49k.json")
    for capacity in (2048, 50):
        bins, least = _check_packing(packing.best_fit_packing(tricky, path, capacity).collect(), [r[:2] for r in tricky_rows], capacity, 1)
        assert bins <= least + 1
    assert packing.best_fit_packing(nothing, path).count() == 0


def test_packing_query(spark, folder):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    bins, least = _check_packing(queries.QUERIES["op6_best_fit_packing"](spark, folder).collect(), texts, 2048, 1)
    assert bins <= least + 1


def test_fullest_is_exhaustive():
    import itertools
    import random

    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        used = packing.fullest(dict(counts), 30)
        assert all(k <= counts[x] for x, k in used.items()) and max(counts) in used
        lengths = list(counts)
        best = max(
            t for ks in itertools.product(*(range(counts[x] + 1) for x in lengths))
            if ks[lengths.index(max(counts))] and (t := sum(k * x for k, x in zip(ks, lengths))) <= 30)
        assert sum(k * x for x, k in used.items()) == best


def _base(texts):
    """Texts as (id, text); the documented base score and counts."""
    train = [(i, ascii_words(t, True)) for i, t in texts if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for _, ws in train for w in ws)
    total, kinds = sum(counts.values()) + len(train), len(counts) + 1
    out = {}
    for i, t in texts:
        words = ascii_words(t, True)
        tokens = [counts.get(w, 0) for w in words] + [len(train)]
        out[i] = (len(tokens), sum(c > 0 for c in tokens), total, sum(math.log10((c + 0.5) / (total + 0.5 * (kinds + 1))) for c in tokens))
    return out


def _check_scores(found, texts):
    want = _base(texts)
    for r in found:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.base_score == pytest.approx(base, abs=1e-6)
        assert r.score < 0 and math.isfinite(r.score)


def test_language_model(spark, folder, tricky, tricky_rows, nothing):
    path = queries.vocabulary("piece_bpe_32k.model")
    held = fm.fold("doc_id") == 1
    found = lattice.lm_scores(tricky, path, held, chunk_words=500).collect()
    assert len(found) == len(tricky_rows)
    _check_scores(found, [r[:2] for r in tricky_rows])
    again = {(r.doc_id, round(r.score, 6)) for r in lattice.lm_scores(tricky, path, held).collect()}
    assert again == {(r.doc_id, round(r.score, 6)) for r in found}
    assert lattice.lm_scores(nothing, path, held).count() == 0
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    _check_scores(queries.QUERIES["op10_lm_scoring"](spark, folder).collect(), texts)


def test_lattice_sums_all_segmentations():
    pieces = {"▁".encode(): 0.1, "▁a".encode(): 0.2, b"a": 0.15, b"b": 0.1, b"ab": 0.2, b"bb": 0.05, b"abb": 0.2}
    model = lattice.Lattice({k: math.log(v) for k, v in pieces.items()})

    def brute(text):
        return 1.0 if not text else sum(p * brute(text[len(k):]) for k, p in pieces.items() if text.startswith(k))

    words = [b"a", b"ab", b"abb", b"b", b"aabbabb", b"", b"abbaabbaabba" * 9]
    got = model.words(words)
    for w, g in zip(words[:-1], got):
        assert g == pytest.approx(math.log(brute("▁".encode() + w))) and model.word(w) == pytest.approx(g)
    assert got[-1] == pytest.approx(model.words(words, long=1000)[-1])
    assert model.words([b"zz"])[0] == -math.inf
