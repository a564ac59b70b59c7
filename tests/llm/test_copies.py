"""Operators over pairs and passages against brute force, and the pipeline."""

import hashlib
import itertools
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

import parity
from llm_helpers import ascii_words, prose
from strandloom.llm import queries, recompress, secrets, sigtree, spaced, suffixes


def _documents(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def _passages(texts, width):
    """(n_words, n_removed, digest) of each (id, text), by counting all windows."""
    words = [ascii_words(t) for _, t in texts]
    count = Counter(tuple(w[i: i + width]) for w in words for i in range(len(w) - width + 1))
    out = Counter()
    for (doc, _), w in zip(texts, words):
        gone = {k for i in range(len(w) - width + 1) if count[tuple(w[i: i + width])] > 1 for k in range(i, i + width)}
        out[doc, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()] += 1
    return out


def _as_counter(found):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found.collect())


def test_passages(tricky, tricky_rows, nothing):
    for width in (35, 7):
        assert _as_counter(recompress.remove_repeats(tricky, width)) == _passages([r[:2] for r in tricky_rows], width)
    assert recompress.remove_repeats(nothing).count() == 0


def test_passage_query(spark, folder):
    assert _as_counter(queries.QUERIES["op5_substring_dedup"](spark, folder)) == _passages(_documents(spark, folder), 35)


def test_equal_windows_pick_equal_names():
    rng = np.random.default_rng(4)
    inner = rng.integers(0, 5, 60).astype(np.uint64)
    rows = [np.concatenate([rng.integers(0, 5, 40).astype(np.uint64), inner, rng.integers(0, 5, 40).astype(np.uint64)]) for _ in range(30)]
    names = []
    for row in rows:
        _, first, last, name, _ = recompress.places(row, np.array([0, len(row)]), 35, 5)
        by_window = {w: n for a, b, n in zip(first, last, name.tolist()) for w in range(a, b + 1)}
        assert sorted(by_window) == list(range(len(row) - 34))
        names.append([by_window[w] for w in range(40, 40 + 26)])
    assert all(n == names[0] for n in names)


def _strings(texts, width):
    first: dict[bytes, int] = {}
    data = [(doc if doc is not None else -(1 << 63), doc, (t or "").encode()) for doc, t in texts]
    for key, _, x in data:
        for i in range(len(x) - width + 1):
            first[x[i: i + width]] = min(key, first.get(x[i: i + width], key))
    out = Counter()
    for key, doc, x in data:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - width + 1):
            if first[x[i: i + width]] < key:
                gone[i: i + width] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[doc, len(x), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot", [1, 20_000])
def test_strings(tricky, tricky_rows, nothing, hot):
    found = suffixes.remove_repeats(tricky, 50, hot).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == _strings([r[:2] for r in tricky_rows], 50)
    assert suffixes.remove_repeats(nothing).count() == 0


def test_string_query(spark, folder):
    found = queries.QUERIES["op9_suffix_array_dedup"](spark, folder).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == _strings(_documents(spark, folder), 50)


def test_suffix_mergesort_equals_sorting_bytes():
    rng = random.Random(8)
    parts = [bytes(rng.choices(b"ab", k=rng.randint(12, 90))) for _ in range(40)]
    data = np.frombuffer(b"".join(parts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    at = np.concatenate([np.arange(offsets[i], offsets[i + 1] - 9) for i in range(len(parts))])
    suffix = suffixes.SuffixSort(data, offsets, 10)
    size = np.array([len(at) // 3, 1, len(at) - len(at) // 3 - 1])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    got = suffix.sort(at, start, size)
    key = lambda i: data[i: i + 10].tobytes()
    for s, n in zip(start, size):
        assert [key(i) for i in got[s: s + n]] == sorted(key(i) for i in at[s: s + n])
        assert sorted(got[s: s + n]) == sorted(at[s: s + n])
    assert suffix.common(at[:-1], at[1:]).tolist() == [next((k for k in range(10) if key(a)[k] != key(b)[k]), 10) for a, b in zip(at, at[1:])]


def _components(texts, n, percent):
    sets = []
    for _, t in texts:
        w = ascii_words(t, True)
        sets.append({tuple(w[i: i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if texts[a][0] == texts[b][0] or both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[top(a)] = top(b)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(texts):
        least[top(i)] = min(doc, least.get(top(i), doc))
    return Counter((doc, len(sets[i]), least[top(i)]) for i, (doc, _) in enumerate(texts))


@pytest.mark.parametrize("hot", [2, 4000])
def test_components(tricky, tricky_rows, nothing, hot):
    for n, percent in ((4, 85), (5, 80)):
        found = sigtree.similar_components(tricky, n, percent, hot).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == _components([r[:2] for r in tricky_rows], n, percent)
    assert sigtree.similar_components(nothing).count() == 0


def test_near_copies_do_not_meet_in_all_pairs(spark, monkeypatch):
    """Copies of one text with up to nine words changed: the pairs compared grow with the copies, not with their square."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(400):
        words = base[:]
        for at in rng.sample(range(150), 1 + i % 9):
            words[at] = f"x{i}_{at}"
        texts.append((i, " ".join(words)))
    compared = []
    real = sigtree._compare

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(sigtree, "_compare", counted)
    found = {r.doc_id: r.component_id for r in sigtree.similar_components(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert Counter((i, len({tuple(t.split()[k: k + 4]) for k in range(147)}), found[i]) for i, t in texts) == _components(texts, 4, 85)
    assert sum(compared) < 10 * len(texts)


def test_pairs_leave_the_trees_in_parts():
    """A group of equal bitmaps and different components: no batch holds all of its pairs."""
    import pyarrow as pa

    n = 2500
    raw = np.full(16, (1 << 64) - 1, np.uint64).tobytes()
    zero = pa.array(np.zeros(n, np.int64))
    rows = pa.RecordBatch.from_arrays([zero, pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(np.arange(n)), pa.array(np.full(n, 60)), pa.array(np.arange(n)), pa.array([raw] * n)], names=["key", "i", "j", "block", "id", "n", "label", "bits"])
    out = list(sigtree._trees(85)(iter([rows])))
    assert sum(b.num_rows for b in out) == n * (n - 1) // 2 and len(out) > 1
    best = list(sigtree._trees(85, True)(iter([rows])))
    assert sum(b.num_rows for b in best) <= n


def test_links_come_through_the_trees(spark, tricky, tricky_rows, folder):
    """Without the shortcut, and with it for every n-gram, the components are the same; links come out either way."""
    rows = _documents(spark, folder)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = _components(rows, 4, 85)
    for crowd in (None, 1):
        found = sigtree.similar_components(docs, crowd=crowd).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == want
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in sigtree.similar_components(tricky, crowd=crowd).collect()) == _components([r[:2] for r in tricky_rows], 4, 85)
    rng = random.Random(3)
    near = [prose(rng, 300).split() for _ in range(3)]
    texts = [(i, " ".join(near[i % 3][: 300 - i // 3] + [f"tail{i}"])) for i in range(18)]
    _, groups = sigtree.links(spark.createDataFrame(texts, "doc_id long, text string"), crowd=None)
    assert {(r.id, r.component) for r in groups.collect()} == {(i, i % 3) for i in range(18)}


def test_links_join_components_by_name(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (7, 7), (9, 7), (30, 30), (31, 30)], "id long, component long")
    more = spark.createDataFrame([(2, 9), (20, 21), (9, 21), (40, 41), (30, 31)], "a long, b long")
    got = sorted((r.id, r.component) for r in sigtree._merged(labels, more).collect())
    assert got == [(1, 1), (2, 1), (7, 1), (9, 1), (20, 1), (21, 1), (30, 30), (31, 30), (40, 40), (41, 40)]


def test_one_of_each_goes_by_id_and_text(spark):
    rng = random.Random(8)
    a, b = prose(rng, 120), prose(rng, 120)
    rows = [(5, a, "x"), (5, b, "x"), (7, a + " end", "x"), (None, b, "x"), (None, a, "y"), (5, a, "x"), (None, None, "x"), (9, None, "x"), (9, "", "x"), (None, "lone text", "x"), (None, "lone text", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string")
    kept = sigtree.one_of_each(docs)
    assert kept.columns == docs.columns
    found = Counter((r.doc_id, r.text or None) for r in kept.collect())
    assert found == Counter([(5, a), (5, b), (None, None), (9, None), (None, "lone text")])
    only_null = spark.createDataFrame([(None, a, "x"), (None, a + " more", "x")], docs.schema)
    assert sigtree.one_of_each(only_null).count() == 1


def test_frequent_grams_come_last():
    grams, frequent = np.array([3, 5, 8, 9], np.uint64), np.array([9, 3], np.uint64)
    assert sigtree._ranks(grams, frequent).tolist() == [2, 0, 0, 1] and sigtree._ranks(grams, frequent[:0]).tolist() == [0] * 4


def test_chains_of_links(spark):
    """Each text is close to the next only, and a hub text to many that are not close to each other."""
    rng = random.Random(11)
    words = prose(rng, 200).split()
    texts = []
    for i in range(12):
        texts.append((100 - i, " ".join(words)))
        for k in rng.sample(range(200), 2):
            words[k] = f"new{i}_{k}"
    hub = prose(rng, 150).split()
    texts.append((50, " ".join(hub)))
    for i in range(14):
        own = list(hub)
        for k in rng.sample(range(150), 2):
            own[k] = f"own{i}_{k}"
        texts.append((200 + i, " ".join(own)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for hot in (3, 4000):
        found = sigtree.similar_components(docs, hot=hot).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == _components(texts, 4, 85)


def test_component_query(spark, folder):
    found = queries.QUERIES["op8_ngram_jaccard_join"](spark, folder).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == _components(_documents(spark, folder), 4, 85)


def test_tree_keeps_every_close_pair():
    rng = np.random.default_rng(6)
    base = [set(rng.integers(0, 1 << 60, 120).tolist()) for _ in range(6)]
    sets = []
    for i in range(90):
        own = sorted(base[i % 6])
        drop = rng.integers(0, 30)
        sets.append(set(own[drop:]) | set(rng.integers(0, 1 << 60, drop // 2).tolist()))
    bits = []
    for s in sets:
        flags = np.zeros(512, np.uint8)
        flags[[x % 512 for x in s]] = 1
        bits.append(np.packbits(flags, bitorder="little").tobytes())
    size, ids = np.array([len(s) for s in sets]), np.arange(90)
    found = {p for a, b in sigtree.group_pairs(ids, size, ids, bits, np.zeros(90, int), 85) for p in zip(a.tolist(), b.tolist())}
    close = {(a, b) for a in range(90) for b in range(a + 1, 90) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert close <= found and len(found) < 90 * 89 / 2 / 4
    label = ids % 6
    across = {p for a, b in sigtree.group_pairs(ids, size, label, bits, np.zeros(90, int), 85) for p in zip(a.tolist(), b.tolist())}
    assert all(label[a] != label[b] for a, b in across)


@pytest.mark.parametrize("name", ["op3_secret_scans", "op4_benchmark_decontamination"])
def test_sql_checks(name, spark, folder, duck):
    assert parity.difference(queries.QUERIES[name](spark, folder), duck, queries.CHECKS[name]) is None


def test_secret_spans(spark, tricky, tricky_rows, nothing):
    found = {r.doc_id: r for r in secrets.secret_spans(tricky).collect()}
    assert secrets.secret_spans(tricky).count() == len(tricky_rows)
    assert found[0].spans == found[1].spans == "" and found[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    text = {r[0]: r[1] for r in tricky_rows}
    assert found[17].spans == "assign:0:41,hex:9:41,access:43:63"
    # A short value is dropped and its text is used up; the second match follows it.
    start = text[18].index("password")
    assert found[18].spans == f"assign:{start}:{start + len('password: hunter22')}"
    assert found[19].spans == "mixed:0:27" and found[19].n_live == 1
    assert secrets.secret_spans(nothing).count() == 0


def test_copied_examples_are_told_apart(spark):
    value = "Zz9Zz8Yy7Xx6Ww5Vv4Uu3Tt2Ss1"
    rows = [(i, f"see {value} and token = abcdef0123456789x", f"s{i}") for i in range(5)] + [(9, "only Qq1Ww2Ee3Rr4Tt5Yy6Uu7Ii8Oo9", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r for r in secrets.secret_spans(docs).collect()}
    assert found[0].n_copied == 1 and found[0].n_live == 0 and "mixed" not in found[0].spans and found[9].n_live == 1
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert clean[0] == f"see {value} and [example]" and clean[9] == "only [secret]"


def test_many_repositories_of_one_owner_are_copies(spark):
    value = "abcdef0123456789"
    rows = [(i, f"token = {value}", "one") for i in range(11)] + [(100 + i, "token = fedcba9876543210", "one") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: (r.n_live, r.n_copied) for r in secrets.secret_spans(docs).collect()}
    assert found[0] == (0, 1) and found[100] == (1, 0)


def test_clashing_names(spark):
    names = ["_id", "_hash", "_owner", "_key", "_spans", "_merged", "_row", "_own_id", "_text", "start"]
    schema = "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(1, "password: hunter2290 x", "s", *names), (None, None, None, *names)], schema)
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text, r._id, r._spans) for r in clean.collect()) == [(0, None, "_id", "_spans"), (1, "[secret] x", "_id", "_spans")]
    assert secrets.secret_spans(docs).count() == 2


def test_redaction_keeps_the_rest(tricky, tricky_rows, nothing):
    found = secrets.redact(tricky)
    assert found.columns == tricky.columns
    text = Counter(r.text for r in found.collect())
    assert sum(text.values()) == len(tricky_rows)
    kept = [r[1] for r in tricky_rows if r[0] not in (17, 18, 19)]
    assert not Counter(kept) - text
    assert any(t and t.startswith('[secret]" [secret] ') for t in text)
    assert secrets.redact(nothing).count() == 0


def test_planted_benchmark_passages(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, 25)) for i in range(6)] + [(7, None), (8, "short item"), (9, "")]
    docs = []
    for i in range(6):
        words = items[i][1].upper().split() if i == 0 else items[i][1].split()
        if i >= 3:
            for k in (4, 13, 21):
                words[k] = "other"
        docs.append((i, prose(rng, 50) + " " + " ".join(words) + " " + prose(rng, 30)))
    docs += [(10 + i, prose(rng, 120)) for i in range(20)] + [(40, None), (41, ""), (42, items[2][1]), (42, items[2][1])]
    found = spaced.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i) for i in range(6)} | {(42, 2)}
    assert {r.doc_id: (r.compared, r.equal) for r in found}[3] == (25, 22)
    few = spaced.Seeds(broadcast_seeds=0)
    again = spaced.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), few).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


def _overlaps(docs, items, width=13):
    """(diagonal, compared, equal, best) of each pair that passes, by trying all diagonals."""
    out = {}
    for doc, text in docs:
        d = text.split()
        for item, words in items:
            b = words.split()
            w, found = min(len(b), width), []
            for diagonal in range(1 - len(b), len(d)):
                start = max(diagonal, 0)
                same = [x == y for x, y in zip(d[start:], b[start - diagonal:])]
                best = max((sum(same[i: i + w]) for i in range(len(same) - w + 1)), default=-1)
                if 10 * best >= 8 * w:
                    found.append((sum(same), len(same), -diagonal, best))
            if found:
                equal, compared, back, best = max(found)
                out[doc, item] = (-back, compared, equal, best)
    return out


def test_every_accepted_overlap_has_a_seed(spark):
    docs, items = [], []
    for n in range(1, 14):
        words = [f"n{n}w{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        for gone in itertools.combinations(range(n), n - -(-8 * n // 10)):
            docs.append((len(docs), " ".join(["x", "y"] + ["other" if k in gone else w for k, w in enumerate(words)] + ["z"])))
    items.append((20, " ".join(f"long{k}" for k in range(40))))
    for phase in range(5):
        docs.append((len(docs), " ".join("other" if k % 5 == phase else f"long{k}" for k in range(40))))
    count = len(docs)
    rng = random.Random(12)
    items += [(30 + i, " ".join(rng.choices("abcd", k=rng.randint(1, 16)))) for i in range(12)]
    docs += [(len(docs) + i, " ".join(rng.choices("abcd", k=rng.randint(1, 40)))) for i in range(40)]
    want = _overlaps(docs, items)
    assert {d for d, _ in want} >= set(range(count))
    found = spaced.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.diagonal, r.compared, r.equal, r.best) for r in found} == want and len(found) == len(want)


def test_short_items_by_sql(spark):
    """The masks for short items, operator against SQL: items of 1 to 14 tokens, whole, cut and with one token replaced."""
    rng = random.Random(21)
    items = [(n, " ".join(f"t{n}w{k}" for k in range(n))) for n in range(1, 15)]
    docs = []
    for n, text in items:
        words = text.split()
        docs.append((len(docs), f"{prose(rng, 6)} {text} {prose(rng, 5)}"))
        for k in {0, n // 2, n - 1}:
            docs.append((len(docs), f"{prose(rng, 3)} {' '.join(words[:k] + ['other'] + words[k + 1:])} {prose(rng, 3)}"))
    con = duckdb.connect()
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    found = spaced.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert parity.difference(found, con, spaced.oracle()) is None
    assert {r.item_id for r in found.collect()} == set(range(1, 15))


def test_benchmark_edges(spark, tricky, nothing):
    items = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    assert spaced.contaminated(tricky, items).count() == 0
    assert spaced.contaminated(nothing, items).count() == 0
    own = tricky.selectExpr("doc_id as item_id", "text", "lang").where("doc_id = 8")
    assert {r.doc_id for r in spaced.contaminated(tricky, own).collect()} == {8, 9, 10}


def test_pipeline(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, folder).cache()
        assert after.columns == docs.columns
        if name == "ngram_jaccard_join":
            groups = _components([(r.doc_id, r.text) for r in before.collect()], 5, 80)
            assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, _, c in groups if d == c)
        elif name == "benchmark_decontamination":
            bad = {r.doc_id for r in spaced.contaminated(before, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
            assert bad and sorted(r.doc_id for r in after.collect()) == sorted({r.doc_id for r in before.collect()} - bad)
        elif name == "secret_scans":
            assert after.count() == before.count() and after.where("n_chars <> length(text)").count() == 0
        before = after
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in before.collect()}


def test_pipeline_stages_on_odd_rows(spark, folder, tricky, nothing):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, nothing, folder).count() == 0
        assert stage(spark, tricky, folder).count() > 0
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, tricky, folder).collect()]
    assert sorted(kept) == sorted(set(kept)) and {0, 1, 2, 5}.issubset(kept) and not {6, 7, 14} & set(kept)


def test_nodes_without_another_of_like_size_are_not_compared(spark):
    """Only nodes that could link by their size reach the trees; every pair that could link stays, exact bounds included."""
    r = random.Random(3)
    rows = [(r.randint(1, 12), k, r.choice([1, 17, 20, 85, 100, 300, r.randint(1, 2000)]), r.randint(1, 4)) for k in range(400)]
    rows += [(99, 1000, 85, 1), (99, 1001, 100, 2), (99, 1002, 5000, 3), (98, 1003, 10, 1), (98, 1004, 10, 1)]
    for percent in (85, 100):
        kept = {(x.key, x.id) for x in sigtree._comparable(spark.createDataFrame(rows, "key long, id long, n long, label long"), percent).collect()}
        needed = {(k, i) for k, i, n, own in rows for k2, _, n2, other in rows if k == k2 and own != other and 100 * min(n, n2) >= percent * max(n, n2)}
        assert needed <= kept and (99, 1002) not in kept and not {(98, 1003), (98, 1004)} & kept
    assert ((99, 1000) in needed) is False and len(kept) < len(rows)
