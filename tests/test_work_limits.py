"""Work that must not grow past what the results need."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from strandloom.operators import paths_search


def _chain(spark, n):
    edges = spark.createDataFrame([(i, i + 1, 1) for i in range(1, n)], "src long, dst long, weight long")
    return edges, spark.createDataFrame([(i, 1) for i in range(1, n + 1)], "node long, len long")


def _levels(monkeypatch):
    seen, kept = [], paths_search.written

    def counted(df, name="rows"):
        seen.append(name)
        return kept(df, name)

    monkeypatch.setattr(paths_search, "written", counted)
    return lambda: seen.count("level")


def test_search_ends_when_every_pair_is_reached(spark, monkeypatch):
    """A budget that reaches far does not send the search past the ends that are wanted."""
    edges, lengths = _chain(spark, 40)
    targets = spark.createDataFrame([(1, 3, 900), (1, 4, 500), (20, 22, 900)], "src long, dst long, budget long")
    levels = _levels(monkeypatch)
    got = {(r.src, r.dst): (r.hops, r.cost, r.inner) for r in paths_search.bounded_paths(targets, edges, lengths, fewest=True).collect()}
    assert got == {(1, 3): (2, 1, [2]), (1, 4): (3, 2, [2, 3]), (20, 22): (2, 1, [21])}
    assert levels() <= 4
    plain = _levels(monkeypatch)
    assert {(r.src, r.dst): (r.hops, r.cost, r.inner) for r in paths_search.bounded_paths(targets, edges, lengths).collect()} == got
    assert plain() <= 5


def test_fewest_hops_within_every_budget(spark):
    """Pairs of the same ends with different budgets get the row that the whole search gives them."""
    rng = random.Random(4)
    edges = spark.createDataFrame([(a, b, rng.randrange(5)) for a in range(30) for b in rng.sample(range(30), 3) if a != b], "src long, dst long, weight long")
    lengths = spark.createDataFrame([(i, rng.randrange(1, 30)) for i in range(30)], "node long, len long")
    targets = spark.createDataFrame([(rng.randrange(30), rng.randrange(30), rng.randrange(0, 90)) for _ in range(60)], "src long, dst long, budget long")

    def first(fewest):
        fits = targets.join(paths_search.bounded_paths(targets, edges, lengths, fewest=fewest), ["src", "dst"]).filter("cost <= budget")
        rows = fits.groupBy("src", "dst", "budget").agg(F.min_by(F.struct("hops", "cost", "depth", "inner"), "hops").alias("r"))
        return sorted((r.src, r.dst, r.budget, *r.r) for r in rows.collect())

    assert first(True) == first(False) and len(first(True)) > 10


def test_a_path_is_read_once(spark):
    """The steps of a path are parsed once per row, whatever is asked of them."""
    from strandloom.functions import paths as pt

    df = spark.createDataFrame([("5,10,0,0;-6,10,1,2;5,12,3,4",), ("7,9,0,1",), ("*",), (None,)], "path string")
    once = df.select(pt.last_per_node(pt.parse_steps(F.col("path"))).alias("steps"))
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") <= 2
    got = [None if r.steps is None else [tuple(s) for s in r.steps] for r in once.collect()]
    assert got == [[(6, -1, 10, 1, 2), (5, 1, 12, 3, 4)], [(7, 1, 9, 0, 1)], None, None]


def test_lines_are_numbered_with_one_writing(spark, tmp_path, monkeypatch):
    """The sorted lines are kept as they were dealt; their places come from one offset per partition."""
    from strandloom.plans import inputs

    monkeypatch.setattr(inputs, "_numbered", {})
    made, kept = [], inputs.stored
    monkeypatch.setattr(inputs, "stored", lambda df, name="rows": made.append((name, df.columns)) or kept(df, name))
    rows = [(float(p % 5), o, 1, o % 7, o % 3, 1.0, 0.0, 0.0, "N", "O") for o, p in enumerate(random.Random(2).sample(range(300), 300))]
    rows += rows[:20]
    names = "l_extendedprice double, l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, names).withColumn("l_shipdate", F.timestamp_seconds("l_orderkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = inputs.Inputs(spark, str(tmp_path))["ranked"].orderBy("ord").collect()
    assert [r.ord for r in got] == list(range(320))
    assert [(r.l_extendedprice, r.l_orderkey) for r in got] == sorted((r[0], r[1]) for r in rows)
    assert ["l_orderkey" in columns for _, columns in made] == [True, False]


def _plain_components(edges):
    name = {v: v for e in edges for v in e}
    while True:
        before = dict(name)
        for u, v in edges:
            name[u] = name[v] = min(name[u], name[v])
        if name == before:
            return name


def test_components_shrink_with_every_round(spark, monkeypatch):
    """Paths, stars, loops and repeats; the edges of all rounds together stay a few times the input."""
    from strandloom.operators import components

    rng = random.Random(9)
    order = rng.sample(range(1000), 1000)
    edges = [*zip(order[:600], order[1:600]), *((order[600], v) for v in order[601:800]), *((v, v) for v in order[800:810])]
    edges += [(rng.choice(order[820:]), rng.choice(order[820:])) for _ in range(120)] + [(order[3], order[2])] * 3
    sizes, kept = [], components.written

    def counted(df, name="rows"):
        out = kept(df, name)
        if name == "edges":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(components, "written", counted)
    rows = components.connected_components(spark.createDataFrame([*edges, (None, 5), (None, None)], "a long, b long"), "a", "b").collect()
    assert len(rows) == len({r.vertex for r in rows})
    assert {r.vertex: r.component for r in rows} == _plain_components(edges)
    assert sum(sizes) < 3 * len(edges)


def test_read_groups_have_no_vertex_for_a_read(spark, monkeypatch):
    from strandloom.operators import components

    seen, kept = [], components.connected_components
    monkeypatch.setattr(components, "connected_components", lambda edges, a, b: seen.append(edges.count()) or kept(edges, a, b))
    rows = [("f1", 1), ("f2", 1), ("f2", 2), ("f3", 2), ("f3", 2), ("g1", 3), ("h10", 4), ("h9", 4), (None, 5), ("k", None)]
    got = components.read_feature_groups(spark.createDataFrame(rows, "feature string, read long")).collect()
    assert {(r.feature, r.component) for r in got} == {("f1", "f1"), ("f2", "f1"), ("f3", "f1"), ("g1", "g1"), ("h10", "h10"), ("h9", "h10")}
    assert len(got) == 6 and seen == [7]


def test_closure_meets_islands_once(spark, monkeypatch):
    """Intervals find their island by their start; only distinct ids per island go into the range join."""
    from strandloom.operators import growth, intervals

    rows = [(10, 14, [31]), (12, 18, [31]), (13, 18, [31]), (18, 20, []), (30, 33, [52]), (50, 55, []), (70, 71, [200]), (90, 90, [31]), (None, 4, [31]), (95, 99, None)]
    joined, kept = [], intervals.range_join
    monkeypatch.setattr(intervals, "range_join", lambda left, *args, **kw: joined.append(left.count()) or kept(left, *args, **kw))
    got = growth.interval_closure(spark.createDataFrame(rows, "s long, e long, branches array<long>"), "s", "e", "branches")
    found = {(r.region_set, r.region_start, r.region_end, r.members) for r in got.filter("region_start IS NOT NULL").collect()}
    assert found == {(10, 10, 20, 4), (10, 30, 33, 1), (10, 50, 55, 1), (70, 70, 71, 1), (90, 90, 90, 1), (95, 95, 99, 1)}
    assert joined == [3]


def test_range_join_without_levels_that_meet_nothing(spark):
    """Points emit rows only at the levels of the spans; pairs stay those of the plain condition."""
    from strandloom.operators import intervals

    rng = random.Random(1)
    points = [(i, p, p + 1) for i, p in enumerate(rng.sample(range(2000), 200))]
    spans = [(i, s, s + rng.choice([20, 30, 300])) for i, s in enumerate(rng.sample(range(2000), 60))]
    left, right = spark.createDataFrame(points, "p int, a long, b long"), spark.createDataFrame(spans, "q int, s long, e long")
    got = sorted((r.p, r.q) for r in intervals.range_join(left, right, [], ("a", "b"), ("s", "e")).select("p", "q").collect())
    assert got == sorted((p, q) for p, a, b in points for q, s, e in spans if a < e and s < b)
    assert intervals._binned(left, "a", "b", [3, 5]).count() == 2 * len(points)


def test_abundance_rounds_move_no_members(spark):
    """The state of the model is small and known to be; the members stay dealt by read in every round."""
    from strandloom.operators import em

    rows = [(f"f{(r * 7 + k) % 40}", f"r{r}", float(5 + (r + k) % 3)) for r in range(400) for k in range(3)]
    scores = spark.createDataFrame(rows, "feature string, read string, score double")
    plans, kept = [], em.written

    def noted(df, name="rows"):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return kept(df, name)

    em.written, result = noted, None
    try:
        result = em.em_counts(scores, max_rounds=2)
    finally:
        em.written = kept
    assert len(plans) == 3 and all("BroadcastHashJoin [feature" in p for p in plans[1:])
    assert abs(sum(r.abundance for r in result.counts.collect()) - 400) < 1e-6


def test_mixture_moments_are_products_of_two_matrices(monkeypatch):
    """The sums of a partition equal those of a plain loop, without a product over three arrays at once."""
    import numpy as np
    import pyarrow as pa

    from strandloom.operators import mixture

    rng = np.random.default_rng(3)
    x, probs, means = rng.normal(size=(50, 2)) * 5, np.array([0.3, 0.7]), np.array([[0.0, 1.0], [2.0, -1.0]])
    covs = np.array([[[20.0, 2.0], [2.0, 30.0]], [[25.0, 0.0], [0.0, 9.0]]])
    wide, kept = [], np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, *args, **kw: wide.append(len(args)) or kept(how, *args, **kw))
    batch = pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], names=["block"])
    out = np.frombuffer(next(iter(mixture._moments(probs, means, covs)(iter([batch])))).column(0)[0].as_py())
    want = np.zeros(1 + 2 + 4 + 8)
    for row in x:
        parts = [p * np.exp(-0.5 * (row - m) @ np.linalg.inv(c) @ (row - m)) / (2 * np.pi * np.sqrt(np.linalg.det(c))) for p, m, c in zip(probs, means, covs)]
        want[0] += np.log(sum(parts))
        for k in range(2):
            r = parts[k] / sum(parts)
            want[1 + k] += r
            want[3 + 2 * k: 5 + 2 * k] += r * row
            want[7 + 4 * k: 11 + 4 * k] += r * np.outer(row, row).reshape(-1)
    assert np.allclose(out, want, rtol=1e-10) and max(wide, default=0) <= 2


def test_small_components_take_few_tasks(spark, monkeypatch):
    """With many shuffle partitions and few edges a round writes one file, and a star around its least vertex takes one round."""
    from strandloom.operators import components

    files, kept = [], components.written

    def noted(df, name="rows"):
        out = kept(df, name)
        files.append((name, len(out.inputFiles())))
        return out

    monkeypatch.setattr(components, "written", noted)
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        edges = [(v, 1) for v in range(2, 200)] + [(500, 501)]
        rows = components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.vertex: r.component for r in rows} == {v: 1 for v in range(1, 200)} | {500: 500, 501: 500}
    assert [n for name, n in files if name in ("moves", "components")] == [1, 1]
