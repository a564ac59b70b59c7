"""Region and key layouts: the same rows as a full scan, from a small part of the files."""

import random

import pytest

from strandloom.sources import regions, sinks


def _scan(df):
    """Files and rows that the scans of a query read."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    found = plan.collectLeaves()
    leaves = [found.apply(i) for i in range(found.size())]
    leaves = [leaf.executedPlan() if "AdaptiveSparkPlan" in leaf.getClass().getName() else leaf for leaf in leaves]
    metric = lambda leaf, name: leaf.metrics().apply(name).value()
    return sum(metric(leaf, "numFiles") for leaf in leaves), sum(metric(leaf, "numOutputRows") for leaf in leaves)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    r = random.Random(8)
    rows = []
    for i in range(20_000):
        start = r.randint(-2_000, 1_000_000)
        rows.append((r.choice(["c1", "c1", "c1", "c2"]), start, start + r.choice([0, 1, 4, 30, 150, 151]), i))
    rows += [("c1", 10, 900_000, -1), ("c1", 400_000, 480_000, -2), ("c2", None, 7, -3), (None, 500_000, 500_100, -4)]
    df = spark.createDataFrame(rows, "chrom string, s long, e long, id long")
    path = str(tmp_path_factory.mktemp("regions"))
    regions.write_regions(df, ["chrom"], "s", "e", path, bin_width=50_000, partitions=8)
    return regions.read_regions(spark, path), [r for r in rows if r[0] and r[1] is not None], path


def test_lookup_equals_full_scan(table):
    found, rows, _ = table
    r = random.Random(9)
    spots = [(r.choice(["c1", "c2", "c3"]), a, a + r.choice([1, 10, 5_000, 400_000])) for a in (r.randint(-3_000, 1_010_000) for _ in range(25))]
    for chrom, a, b in [*spots, ("c1", 10, 11), ("c1", 899_999, 900_000), ("c1", 900_000, 900_001), ("c2", 5, 5)]:
        want = sorted(x[3] for x in rows if x[0] == chrom and x[1] < b and x[2] > a and a < b)
        assert sorted(x.id for x in found.lookup((chrom, a, b)).collect()) == want
    both = found.lookup(("c1", 100, 5_000), ("c1", 4_000, 9_000), ("c2", 0, 10)).collect()
    assert len(both) == len({x.id for x in both}) and {x.chrom for x in both} == {"c1", "c2"}
    assert found.lookup().count() == 0
    with pytest.raises(ValueError):
        found.lookup((1, 2))


def test_lookup_reads_few_files_and_rows(table, spark):
    found, rows, path = table
    files, read = _scan(spark.read.parquet(f"{path}/rows"))
    part, some = _scan(found.lookup(("c1", 300_000, 301_000)))
    assert read == len(rows) + 1 and files > 60
    assert part <= files / 5 and some <= read / 5


def test_empty_table(spark, tmp_path):
    regions.write_regions(spark.createDataFrame([], "chrom string, s long, e long"), ["chrom"], "s", "e", str(tmp_path))
    assert regions.read_regions(spark, str(tmp_path)).lookup(("c", 0, 10)).count() == 0


def test_long_rows_keep_the_short_ones_prunable(spark, tmp_path):
    df = spark.range(50_000).selectExpr("id * 100 as s", "id * 100 + 50 as e", "id").union(spark.range(40).selectExpr("id * 7 as s", "4900000 + id as e", "-id"))
    regions.write_regions(df, [], "s", "e", str(tmp_path), bin_width=100_000, partitions=6)
    hit = regions.read_regions(spark, str(tmp_path)).lookup((2_000_000, 2_000_100))
    files, read = _scan(hit)
    assert hit.count() == 41 and files <= 3 and read < 5_000


def test_keyed_tables(spark, tmp_path):
    df = spark.range(60_000).selectExpr("id * 37 % 60000 as node", "id as value")
    regions.write_keyed(df, "node", str(tmp_path / "k"), 12)
    assert regions.read_keyed(spark, str(tmp_path / "k"), "node").count() == 60_000
    some = regions.read_keyed(spark, str(tmp_path / "k"), "node", [5, 17, 70_000])
    assert sorted(r.node for r in some.collect()) == [5, 17]
    assert _scan(some)[1] <= 12_000
    table = spark.createDataFrame([(3,), (59_999,), (-1,)], "node long")
    assert sorted(r.node for r in regions.read_keyed(spark, str(tmp_path / "k"), "node", table).collect()) == [3, 59_999]


def test_sorted_files_do_not_overlap(spark, tmp_path):
    df = spark.range(5_000).selectExpr("id * 31 % 977 as a", "id as b")
    sinks.write_sorted(df, ["a", "b"], str(tmp_path / "s"), 6)
    from pyspark.sql import functions as F

    back = spark.read.parquet(str(tmp_path / "s"))
    ends = sorted((tuple(r.low), tuple(r.high)) for r in back.groupBy(F.input_file_name()).agg(F.min(F.struct("a", "b")).alias("low"), F.max(F.struct("a", "b")).alias("high")).collect())
    assert back.count() == 5_000 and len(ends) == 6 and all(x[1] < y[0] for x, y in zip(ends, ends[1:]))
