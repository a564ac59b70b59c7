"""Results do not depend on slices, and the files of a slice go before the next one comes."""

from __future__ import annotations

import os
import random

from pyspark.sql import functions as F

from strandloom import session
from strandloom.model import SRC_STEPS, STEPS
from strandloom.operators import complete, extract, growth, overlap, transfer
from strandloom.sources import text


def _overlaps(pairs, reads, feats):
    """Plain loops: every pair with every read row of its key."""
    out = []
    for key, name in pairs:
        for read, path in reads:
            if key is None or read != key:
                continue
            last = {s[0]: s for s in path or []}
            same = total = 0
            for other, fpath in feats:
                for n, d, ln, h, t in {s[0]: s for s in fpath}.values() if other is not None and other == name else []:
                    if n in last:
                        _, rd, rl, rh, rt = last[n]
                        w = max(0, min(rl - rt, ln - t) - max(rh, h))
                        same, total = same + (w if rd * d * -1 >= 0 else 0), total + w
            out.append((key, name, same, total))
    return sorted(out, key=str)


def _overlap_rows():
    rng = random.Random(8)

    def path():
        return [(rng.randrange(6), rng.choice([-1, 1]), 50, rng.randrange(20), rng.randrange(20)) for _ in range(rng.randrange(1, 4))]

    shared = path()
    reads = [(i, shared if i % 3 else path()) for i in range(30)] + [(4, path()), (4, shared), (31, None), (None, path())]
    feats = [(f"f{i}", path()) for i in range(6)] + [("f0", path()), (None, path())]
    pairs = [(rng.randrange(33), f"f{rng.randrange(8)}") for _ in range(60)] + [(4, "f1"), (4, "f1"), (31, "f2"), (None, "f1"), (5, None)]
    return pairs, reads, feats


def test_overlap_of_slices(spark):
    """Repeated and absent keys, reads without a path and pairs that share no node: the same rows in one slice and in many."""
    pairs, reads, feats = _overlap_rows()
    frames = (
        spark.createDataFrame(pairs, "read long, feature string"), spark.createDataFrame(reads, f"read long, path {STEPS}"),
        spark.createDataFrame(feats, f"feature string, path {STEPS}"),
    )
    for rows in (None, 7):
        got = overlap.path_overlap(*frames, -1, slice_rows=rows)
        assert sorted((tuple(r) for r in got.collect()), key=str) == _overlaps(pairs, reads, feats)


def test_overlap_sends_a_path_twice_at_most(spark):
    """Pairs of a read and a feature do not carry the path through exchanges: the row of the read does."""
    pairs, reads, feats = _overlap_rows()
    df = overlap.path_overlap(
        spark.createDataFrame(pairs, "read long, feature string"), spark.createDataFrame(reads, f"read long, path {STEPS}"),
        spark.createDataFrame(feats, f"feature string, path {STEPS}"), -1,
    )
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 8
    assert "hashpartitioning(_h" not in plan and "hashpartitioning(feature" not in plan


def test_slices_leave_no_shuffle_files(spark, monkeypatch):
    """Every key falls into one slice, a NULL one too, and what a slice shuffled is gone when it ends."""
    rows = spark.createDataFrame([(i % 50 if i % 7 else None, i) for i in range(400)], "k long, v long")
    seen = []

    def build(mine):
        part = mine(rows).groupBy("k").agg(F.sum("v").alias("v"))
        seen.append(part)
        return part

    monkeypatch.setattr(session, "SLICE_ROWS", 100)
    got = session.sliced(400, "k", build)
    assert len(seen) == 4 and sorted(got.collect(), key=str) == sorted(rows.groupBy("k").agg(F.sum("v").alias("v")).collect(), key=str)
    assert all(0 < part.count() < 51 for part in seen)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def _growth_rows(spark):
    rng = random.Random(5)
    features = [(f, 100.0, [(10 * (f // 2) + k, 1, 100, 0, 0) for k in range(3)]) for f in range(6)]
    reads, cand = [], []
    for a in range(90):
        node = rng.randrange(35)
        path = [(node, rng.choice([-1, -1, 1]), 100, rng.randrange(60), 0, 1), (node + 1, -1, 100, 0, rng.randrange(60), 1)]
        reads.append((a, f"r{a}", f"s{a % 3}", 1, 0, 0, 0, "", path))
        cand += [(f, a) for f in range(6) if abs(10 * (f // 2) + 1 - node) < 9] * (1 + a % 2)
    return (
        spark.createDataFrame(cand, "feature long, alignment long"),
        spark.createDataFrame(reads, f"alignment long, read string, sample string, score long, frag long, mm_total long, mm_index long, lin string, path {SRC_STEPS}"),
        spark.createDataFrame(features, f"feature long, flen double, path {STEPS}"),
    )


def test_range_growth_of_slices(spark):
    """The same claims in one slice and in many, though candidates come twice."""
    cand, reads, features = _growth_rows(spark)
    once = sorted(tuple(r) for r in growth.range_growth(cand, reads, features, exclusive=False).collect())
    assert once == sorted(tuple(r) for r in growth.range_growth(cand.distinct(), reads, features, exclusive=False, slice_rows=40).collect())
    assert {r[2] for r in once} == {0, 1}


def test_region_growth_of_slices(spark):
    """The same assignment in one slice and in many, with a flank; no rows stay cached."""
    cand, reads, features = _growth_rows(spark)
    body, flank = cand.filter("alignment % 3 > 0"), cand.filter("alignment % 3 = 0")
    before = set(spark.sparkContext._jsc.getPersistentRDDs())
    once, many = (sorted(tuple(r) for r in growth.grow_assign(body, flank, reads, features, "r", 2, slice_rows=n).collect()) for n in (None, 40))
    assert once == many and {r[9] for r in once} == {0, 1}
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_lifted_regions_of_slices(spark):
    """The same regions in one slice and in many; what is merged was dealt by query once."""
    rng = random.Random(3)
    asked = spark.createDataFrame([(i % 25, ":".join(str(rng.randrange(30)) for _ in range(4))) for i in range(40)] + [(None, "1:2")], "name long, ids string")
    regions = spark.createDataFrame(
        [(str(i), "NA" if i % 7 == 0 else f"c{i % 2}:{i * 700}-{i * 700 + 300}:+;c1:{i * 90}-{i * 90 + 50}:-") for i in range(30)], "id string, places string"
    )
    once = transfer.lift_ids(asked, regions)
    plan = once._jdf.queryExecution().executedPlan().toString()
    rows = sorted((tuple(r) for r in once.collect()), key=str)
    assert rows == sorted((tuple(r) for r in transfer.lift_ids(asked, regions, slice_rows=10).collect()), key=str) and rows
    assert plan.count("Exchange hashpartitioning(name") == 1


def _gaf(spark):
    rng = random.Random(6)
    lines = []
    for pair in range(40):
        n = rng.randrange(1, 9)
        for mate, path in enumerate((f">{n}>{n + 1}", "*" if pair % 6 == 0 else f"<{n + 2}<{n + 1}")):
            fields = [f"r{pair % 9}", "100", "0", "100", "+", path, "104", "2", "99", "90", "100", "60", f"AS:i:{rng.randrange(12)}", "cs:Z::100", "dv:f:0.01"]
            lines.append((pair * 2 + mate, "\t".join(fields)))
    gaf = text.parse_gaf(spark.createDataFrame(lines, "ordinal long, value string"), ["ordinal"])
    return gaf, spark.createDataFrame([(i, 50 + i) for i in range(1, 9)], "node long, len long")


def test_extracted_pairs_of_slices(spark):
    """The same pairs in one slice and in many: the best score of a read needs all its pairs."""
    gaf, lengths = _gaf(spark)
    once, many = (sorted(map(str, extract.extract_pairs(gaf, lengths, slice_rows=n).collect())) for n in (None, 9))
    assert once == many and len(once) > 10


def test_completion_leaves_no_checkpoints(spark):
    """Steps of the completion are tables: the shuffle files of their jobs go, and no row is kept as a checkpoint."""
    gaf, lengths = _gaf(spark)
    places = spark.createDataFrame([(i, "c", i * 60, i * 60 + 60) for i in range(1, 12)], "node long, chrom string, start long, end long")
    l2g = places.select("chrom", "start", "end", "node", F.lit(1).alias("dir"), F.lit(60).cast("long").alias("len"))
    edges = spark.createDataFrame([(i, 1, i + 1) for i in range(1, 11)], "node long, side int, nbr long")
    folder = session.ensure_checkpoint_dir(spark).removeprefix("file:")
    before = {x for x in os.listdir(folder) if x.startswith("rdd-")}
    keep, _, _ = complete.complete_pairs(extract.extract_pairs(gaf, lengths), edges, places, l2g, lengths, "s", 0.7)
    assert keep.count() > 5
    assert {x for x in os.listdir(folder) if x.startswith("rdd-")} <= before
