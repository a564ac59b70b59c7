"""Scans and intervals against plain loops, with one key holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import intervals as iv
from strandloom.operators import scan
from strandloom.operators.scan import numbered, prefix_scan, tile_of


def _hot_intervals(seed, n=400):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if r.random() < 0.6 else r.randint(1, 4)
        s = r.randint(0, 900)
        rows.append((i, key, s, s + r.choice([1, 3, 10, 40, 200])))
    return rows


@pytest.mark.parametrize("width", [1, 7, 64, 100000])
def test_prefix_scan(spark, width):
    rows = [(k, v, x) for _, k, v, x in _hot_intervals(1)]
    rows = sorted(set(rows))
    df = spark.createDataFrame(rows, "k long, o long, x long")
    out = prefix_scan(
        df, ["k"], ["o", "x"], tile_of("o", width),
        {"sm": ("sum", "x"), "ct": ("count", "x"), "mx": ("max", "x"), "pv": ("previous", "x")},
    )
    got = {(r.k, r.o, r.x): (r.sm, r.ct, r.mx, r.pv) for r in out.collect()}
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k]
        for i, r in enumerate(mine):
            before = [b[2] for b in mine[:i]]
            want = (sum(before), len(before), max(before) if before else None, before[-1] if before else None)
            assert got[r] == want


def test_numbered_without_keys(spark):
    df = spark.createDataFrame([(v,) for v in random.Random(2).sample(range(1000), 200)], "v long")
    got = numbered(df, [], ["v"], tile_of("v", 50)).orderBy("v").collect()
    assert [r.n for r in got] == list(range(1, 201))


@pytest.mark.parametrize("gap,width", [(0, 16), (5, 64), (-1, 8), (0, None)])
def test_islands(spark, gap, width):
    rows = _hot_intervals(3)
    df = spark.createDataFrame(rows, "id long, k long, s long, e long")
    got = {
        (r.k, r.island_start, r.island_end, r.members)
        for r in iv.merged_spans(df, ["k"], "s", "e", gap, width).collect()
    }
    want = set()
    for k in {r[1] for r in rows}:
        cur = None
        for _, _, s, e in sorted((r for r in rows if r[1] == k), key=lambda r: r[2:]):
            if cur is None or s > cur[1] + gap:
                if cur:
                    want.add((k, *cur))
                cur = [s, e, 1]
            else:
                cur[1], cur[2] = max(cur[1], e), cur[2] + 1
        want.add((k, *cur))
    assert got == want


def test_depth(spark):
    rows = _hot_intervals(4)
    df = spark.createDataFrame(rows, "id long, k long, s long, e long")
    depth = {}
    for _, k, s, e in rows:
        for p in range(s, e):
            depth[k, p] = depth.get((k, p), 0) + 1
    cap = 12
    got = {r.id: r.too_deep for r in iv.over_depth(df, ["k"], "s", "e", cap, tile_width=32).collect()}
    for i, k, s, e in rows:
        assert got[i] == any(depth[k, p] > cap for p in range(s, e))
    for r in iv.pileup_totals(df, ["k"], "s", "e").collect():
        mine = [d for (k, _), d in depth.items() if k == r.k]
        assert (r.covered, r.total_depth, r.peak_depth) == (len(mine), sum(mine), max(mine))


def test_depth_cap_of_two(spark):
    df = spark.createDataFrame([(1, 0, 10), (2, 5, 15), (3, 9, 12), (4, 20, 30)], "id long, s long, e long")
    got = {r.id: r.too_deep for r in iv.over_depth(df.withColumn("k", F.lit(1)), ["k"], "s", "e", 2).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_range_join(spark, how):
    r = random.Random(5)
    left = _hot_intervals(6, 300) + [(1000, 0, 0, 100000)]
    right = [(i, r.randint(0, 2), s, s + r.choice([1, 2, 50, 3000])) for i, s in enumerate(r.choices(range(1200), k=120))]
    a = spark.createDataFrame(left, "id long, k long, s long, e long")
    b = spark.createDataFrame(right, "fid long, k long, fs long, fe long")
    out = iv.range_join(a, b, ["k"], ("s", "e"), ("fs", "fe"), how, ["id"])
    got = sorted((x.id, x.fid if x.fid is not None else -1) for x in out.collect())
    want = []
    for i, k, s, e in left:
        hits = [f for f, fk, fs, fe in right if fk == k and s < fe and fs < e]
        want += [(i, f) for f in hits] or ([(i, -1)] if how == "left" else [])
    assert got == sorted(want)


def test_range_join_plan_has_no_nested_loop(spark):
    a = spark.range(100).selectExpr("id", "id * 3 AS s", "id * 3 + 5 AS e")
    b = spark.range(100).selectExpr("id AS f", "id * 7 AS fs", "id * 7 + 2 AS fe")
    plan = iv.range_join(a, b, [], ("s", "e"), ("fs", "fe"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_breaks_and_ranges(spark):
    df = spark.createDataFrame([(0, 10), (3, 5), (9, 12), (20, 22)], "s long, e long").withColumn("k", F.lit(1))
    run = [(r.break_from, r.break_to) for r in iv.uncovered_breaks(df, ["k"], "s", "e").collect()]
    assert run == [(12, 21)]
    prev = sorted((r.break_from, r.break_to) for r in iv.uncovered_breaks(df, ["k"], "s", "e", running=False).collect())
    assert prev == [(5, 10), (12, 21)]
    ids = spark.createDataFrame([(1, 5), (1, 14), (1, 24), (1, 5)], "k long, v long")
    got = sorted((r.range_start, r.range_end) for r in iv.id_ranges(ids, ["k"], "v", 10).collect())
    assert got == [(4, 14), (23, 24)]


def test_quantiles_by_rank(spark):
    import statistics

    r = random.Random(4)
    rows = [(k, r.choice([None, *range(9)])) for k in ["a"] * 500 + ["b"] * 7 + [None] * 4] + [("one", 5), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v long")
    got = {x.k: (x.q1, x.mid, x.up) for x in scan.quantiles(df, ["k"], "v", {"q1": 0.25, "mid": 0.5, "up": None}, tile_rows=3).collect()}
    for key in {k for k, _ in rows}:
        values = sorted(v for k, v in rows if k == key and v is not None)
        if not values:
            assert got[key] == (None, None, None)
            continue
        q1 = statistics.quantiles(values, n=4, method="inclusive")[0] if len(values) > 1 else values[0]
        assert got[key] == (pytest.approx(q1), pytest.approx(statistics.median(values)), values[len(values) // 2])


def test_places_over_the_whole_input(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("id", "id % 10 AS g")
    rows = sorted(scan.placed(df, ["g", "id"], "n").collect(), key=lambda x: x.n)
    assert [x.n for x in rows] == list(range(1, 1001)) and [(x.g, x.id) for x in rows] == sorted((x.g, x.id) for x in rows)
    assert scan.placed(df.limit(0), ["g", "id"], "n").count() == 0


def test_scan_sorts_rows_once(spark):
    """The windows of a scan and the join with the tiles before share one sort, and the last position of a tile is a plain maximum."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([("a", i, i + 5) for i in range(50)], "k string, s long, e long")
        plan = iv.depth_segments(df, ["k"], "s", "e", 16)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "SortAggregate" not in plan
    assert sum("Sort [" in line and "pos#" not in line for line in plan.splitlines()) <= 2
