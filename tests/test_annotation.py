"""Chaining of repeats in rounds against the order of one element after the other, and seeded choices."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import annotation, sampling

ELEMENT = "chrom string, start long, end long, name string, element long, label string, strand string"
FAMILIES = [(a, b) for f, ltrs in (("F1", "LTR0 LTR1"), ("F2", "LTR1 LTR2")) for ltr in ltrs.split() for a, b in ((f, ltr), (ltr, f))]


def _one_by_one(rows, max_gap=500):
    left = {r[4]: r for r in sorted(rows, key=lambda r: r[4])}
    kept = []
    for chrom, low, high, name, element, label, _ in list(left.values()):
        if element not in left or label == "PART":
            continue
        del left[element]
        for sign in (-1, 1):
            around = [r for r in left.values() if r[0] == chrom and (r[4] - element) * sign > 0]
            for other in sorted(around, key=lambda r: r[4] * sign):
                gap = low - other[2] if sign < 0 else other[1] - high
                if gap < 0 or gap > max_gap:
                    break
                if any(p in other[3] for n, p in FAMILIES if n == name):
                    low, high = (other[1], high) if sign < 0 else (low, other[2])
                    del left[other[4]]
        kept.append((chrom, low, high, element))
    return sorted(kept)


def _chained(spark, rows, **options):
    df = spark.createDataFrame(rows, ELEMENT).repartition(5)
    fam = spark.createDataFrame(FAMILIES, "name string, partner string")
    return sorted((r.chrom, r.start, r.end, r.element) for r in annotation.chain_repeats(df, fam, **options).collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rounds_equal_the_sequential_order(spark, seed):
    r = random.Random(seed)
    rows, at = [], {"c0": 0, "c1": 0, "c2": 0}
    step = (250, 500, 800)[seed - 1]
    for k in range(250):
        chrom = r.choice(["c0", "c0", "c1", "c2"])
        at[chrom] += r.randint(1, step)
        name = r.choice(["F1", "F2", "LTR0", "LTR1", "LTR2", "LTR10", "X"])
        rows.append((chrom, at[chrom], at[chrom] + r.randint(10, step // 2 + 10), name, k, r.choice(["STR", "LEN", "PART", "PART"]), "+"))
    want = _one_by_one(rows)
    assert _chained(spark, rows) == want
    assert _chained(spark, rows, window=1) == want


def test_long_chain_and_crowd(spark):
    """One element takes a hundred others, which takes several widenings; a row of rivals settles one after the other."""
    row = [("c", 100 * k, 100 * k + 60, "F1" if k == 50 else "LTR1", k, "STR" if k >= 50 else "PART", "+") for k in range(101)]
    assert _chained(spark, row) == _one_by_one(row) == [("c", 0, 10_060, 50)]
    rivals = [("c", 100 * k, 100 * k + 60 + (80 if k % 2 else 0), ("F1", "LTR1")[k % 2], k, "STR", "+") for k in range(12)]
    assert _chained(spark, rivals) == _one_by_one(rivals)
    assert _chained(spark, []) == []


def test_extension_depends_on_the_seed_only(spark):
    rows = [("c", 1000 * k + 500, 1000 * k + 900, "F1", k, "STR", "+") for k in range(40)]
    spans = []
    for parts, seed in ((1, 1), (7, 1), (1, 2)):
        df = annotation.extended(spark.createDataFrame(rows, ELEMENT).repartition(parts), 300, seed)
        spans.append({r.element: (r.start, r.end) for r in df.collect()})
    assert spans[0] == spans[1] != spans[2]
    assert all(200 < a - 1000 * k <= 500 and 900 <= b - 1000 * k < 1200 for k, (a, b) in spans[0].items())


def test_weighted_choice(spark):
    rows = [(g, i, float(w)) for g in range(3000) for i, w in ((1, 6), (2, 3), (3, 1), (4, 0))]
    rows += [(-1, 5, 0.0), (-1, 4, -2.0), (-2, 9, None), (-3, 7, 0.0), (-3, 8, 0.5)]
    df = spark.createDataFrame(rows, "g long, item long, w double")
    found = {r.g: (r.item, r.choices, r.total) for r in sampling.weighted_choice(df.repartition(7), ["g"], "item", "w", seed=3).collect()}
    assert found == {r.g: (r.item, r.choices, r.total) for r in sampling.weighted_choice(df.coalesce(1), ["g"], "item", "w", seed=3).collect()}
    assert found[-1] == (4, 2, 0.0) and found[-2] == (9, 1, 0.0) and found[-3] == (8, 2, 0.5)
    shares = [sum(found[g][0] == i for g in range(3000)) / 3000 for i in (1, 2, 3, 4)]
    assert abs(shares[0] - 0.6) < 0.04 and abs(shares[1] - 0.3) < 0.04 and abs(shares[2] - 0.1) < 0.03 and shares[3] == 0


def test_neighbours_come_by_blocks(spark):
    """Each acting element meets exactly the places within its own window, and its rows need no shuffle of their own."""
    rows = [("c0" if k < 70 else "c1", k if k < 70 else k - 70, k, "F1", 10 * k, 10 * k + 5) for k in range(100)]
    elements = spark.createDataFrame(rows, "chrom string, place long, element long, name string, start long, end long")
    wide = {k: (1, 4, 16)[k % 3] for k in range(0, 100, 2)}
    acting = elements.join(spark.createDataFrame(list(wide.items()), "element long, window int"), "element")
    others = elements.withColumn("taker", F.lit(None).cast("long"))
    met = annotation._beside(acting, others, [1, 4, 16])
    got = sorted((r.element, r.other_element, r.step) for r in met.collect())
    want = sorted((a[2], b[2], b[1] - a[1]) for a in rows if a[2] in wide for b in rows if a[0] == b[0] and abs(a[1] - b[1]) <= wide[a[2]])
    assert got == want
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        flags = {"free": F.lit(True), "fits": F.lit(True)}
        met = annotation._beside(acting, others, [1, 4, 16])
        taken = annotation._taken(met.withColumns(flags), 500, ["chrom", "window", "_block", "element"])
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (met, taken)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plans[0].count("Exchange") == plans[1].count("Exchange")


def test_repeated_ids_are_taken_together(spark):
    """Elements that share an id act as one, on whichever block or chromosome they are; ids that come once are not affected."""
    plain = [("c0", 100 * k, 100 * k + 60, ("F1", "LTR1", "X")[k % 3], k, "STR" if k % 3 == 0 else "PART", "+") for k in range(40)]
    far = [("c9", 100 * k, 100 * k + 60, "F1", k, "STR", "+") for k in (1000, 1000, 1007)]
    assert [r for r in _chained(spark, plain + far) if r[0] == "c0"] == _chained(spark, plain) == _one_by_one(plain)
