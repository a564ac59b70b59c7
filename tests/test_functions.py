"""Column functions on literals."""

import pytest
from pyspark.sql import functions as F

from strandloom.functions import evidence as ev
from strandloom.functions import paths as pt
from strandloom.model import STEPS


def one(spark, column, **values):
    df = spark.range(1)
    for name, v in values.items():
        df = df.withColumn(name, F.lit(v))
    return df.select(column.alias("v")).first().v


def longs(*v):
    return F.array(*[F.lit(x).cast("long") for x in v]) if v else F.array().cast("array<long>")


@pytest.mark.parametrize(
    "a,b,want",
    [((1, 2, 3), (2, 3, 4), 2), ((3, 2, 3), (3, 9), 1), ((1, 2), (3,), 0), ((1, 1), (1, 1), 2), ((1,), (), 0), ((5, 1, 2, 1, 2), (1, 2, 1, 2), 4)],
)
def test_suffix_prefix(spark, a, b, want):
    assert one(spark, pt.suffix_prefix(longs(*a), longs(*b))) == want


def test_nodes(spark):
    assert one(spark, pt.signed_nodes(F.lit(">12<13>5"))) == [12, -13, 5]
    assert one(spark, pt.signed_nodes(F.lit("*"))) == []
    assert one(spark, pt.opposite_strand(longs(1, -2))) == [2, -1]
    assert tuple(one(spark, pt.node_span(longs(-9, 4), longs(20)))) == (3, 20)


@pytest.mark.parametrize("ids,want", [((1, 100), [(0, 100)]), ((1, 101), [(0, 1), (100, 101)]), ((-7, 7), [(6, 7)]), ((), [])])
def test_chunks(spark, ids, want):
    assert [tuple(c) for c in one(spark, pt.id_chunks(longs(*ids), 100))] == want


@pytest.mark.parametrize("mark,total,index", [("0", 0, 0), ("3", 3, 3), ("3-1-1", 3, 1)])
def test_marks(spark, mark, total, index):
    assert one(spark, ev.mark_total(F.lit(mark))) == total
    assert one(spark, ev.mark_index(F.lit(mark))) == index


def test_coverage_weight(spark):
    assert one(spark, ev.coverage_weight(F.lit(0), F.lit(0))) == 1.0
    assert one(spark, ev.coverage_weight(F.lit(4), F.lit(2))) == 0.25


@pytest.mark.parametrize("value,want", [(0, None), (1, 1), (50, 1), (51, 2)])
def test_bins(spark, value, want):
    assert one(spark, ev.fixed_bin(F.lit(value), 50)) == want


def test_tags(spark):
    tags = F.split(F.lit("AS:i:100|cs:Z::60*at:39|AS:i:7"), r"\|")
    assert one(spark, ev.tag_map(tags)) == {"AS": "7", "cs": ":60*at:39"}
    assert one(spark, ev.matched_bases(F.lit(":60*at:39+gg:1"))) == 100
    assert one(spark, ev.identity(F.lit(None).cast("string"), F.lit(100))) == 0


@pytest.mark.parametrize(
    "unmapped,proper,cs,dv,want",
    [
        (True, None, ":1", 0.0, True), (False, 0, ":1", 0.0, True), (False, 1, "+" + "a" * 21 + ":5", 0.0, True),
        (False, 1, "+aa:5", 0.9, False), (False, None, ":5+" + "c" * 30, None, True), (False, None, ":5", None, True),
        (False, None, ":5", 0.21, True), (False, None, ":5", 0.2, False),
    ],
)
def test_discordance_first_branch_wins(spark, unmapped, proper, cs, dv, want):
    c = ev.discordant(F.lit(unmapped), F.lit(proper).cast("int"), F.lit(cs), F.lit(dv).cast("double"))
    assert one(spark, c) is want


def test_scaled_weight(spark):
    import math

    w = one(spark, ev.scaled_weight(F.lit(97.0), F.lit(100.0)))
    assert w == pytest.approx((math.exp(97) - 1) / (math.exp(100) - 1), rel=1e-9)
    assert one(spark, ev.scaled_weight(F.lit(100.0), F.lit(100.0))) == pytest.approx(1.0)


def test_paths_round_trip_and_last_node(spark):
    text = "12,10,0,3;-13,5,1,0"
    assert one(spark, pt.render_steps(pt.parse_steps(F.lit(text)))) == text
    assert one(spark, pt.parse_steps(F.lit("*"))) is None
    done = "12,1,10,0,3,1;13,-1,5,1,0,"
    assert one(spark, pt.render_completed(pt.parse_completed(F.lit(done)))) == done + "0"
    kept = one(spark, pt.last_per_node(pt.parse_steps(F.lit("1,5,0,0;2,5,0,0;-1,5,1,1"))))
    assert [(s.node, s.dir) for s in kept] == [(2, 1), (1, -1)]


def test_feature_text(spark):
    nodes = one(spark, pt.parse_feature_nodes(F.lit("+1,9,0,2;=2,5,1,0;-3,4,0,0")))
    assert [(n.node, n.dir) for n in nodes] == [(1, 1), (2, 0), (3, -1)]
    haps = one(spark, pt.parse_haplotypes(F.lit("a#1:5-9#-;broken;b:1-2#+")))
    assert [tuple(h) for h in haps] == [("a#1", 5, 9, -1), ("b", 1, 2, 1)]


def test_merge_takes_smaller_ends(spark):
    a = pt.parse_steps(F.lit("1,50,4,0;2,60,0,20"))
    b = pt.parse_steps(F.lit("2,60,5,0;3,30,0,10"))
    merged = one(spark, pt.join_overlapping_mates(a, b, F.lit(1)))
    assert [tuple(s) for s in merged] == [(1, 1, 50, 4, 0, 1), (2, 1, 60, 0, 0, 3), (3, 1, 30, 0, 10, 2)]
    all_shared = one(spark, pt.join_overlapping_mates(a, a, F.lit(2)))
    assert [s.src for s in all_shared] == [3, 3]


def test_linear_projection_both_strands(spark):
    assert tuple(one(spark, pt.project_to_linear(F.lit(100), F.lit(150), F.lit(3), F.lit(5)))) == (104, 145)
    assert tuple(one(spark, pt.project_to_linear(F.lit(150), F.lit(100), F.lit(3), F.lit(5)))) == (146, 105)


def test_units(spark):
    step = F.from_json(F.lit('{"node":7,"dir":-1,"len":65,"head":3,"tail":2}'), STEPS[6:-1])
    assert one(spark, pt.unit_ids(step)) == ["-7:3", "-7:2", "-7:1", "-7:0"]


def test_near_in_text(spark):
    c = ev.near_in_text(F.col("t"), "abc", "xyz", 3)
    assert one(spark, c, t="..xyz..abc..") == "xyz..abc"
    assert one(spark, c, t="abc....xyz") is None
