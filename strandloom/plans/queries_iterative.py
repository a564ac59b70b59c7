"""Queries for iterative, graph and kernel operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import evidence as ev
from strandloom.functions import paths as pt
from strandloom.model import SRC_STEPS, STEPS
from strandloom.operators import clusters, complete, em, evaluate, extract, graphprep, growth, mixture, paths_search
from strandloom.plans.queries_relational import (
    COLOCATED, FEATURE_STEPS, READ_STEPS, _candidates, _feature_paths, _read_paths, _supplier_spans, _walks, WALK_STEPS,
)
from strandloom.plans.registry import query
from strandloom.sources import text

# --------------------------------------------------------------------------- EM


def _em_check(rounds: int, select: str) -> str:
    """The rounds of the abundance model written out one after the other."""
    parts = [
        """w AS (SELECT read, feature, SUM((exp(100.0 * (score / best - 1)) - exp(-100.0)) / (1 - exp(-100.0))) AS weight
             FROM (SELECT *, MAX(score) OVER (PARTITION BY read) AS best FROM {scores}) b GROUP BY read, feature)""",
        "c AS MATERIALIZED (SELECT *, COUNT(*) OVER (PARTITION BY read) AS nf FROM w)",
        "u AS (SELECT feature, SUM(CASE WHEN nf = 1 THEN 1.0 ELSE 0.0 END) AS uniq FROM c GROUP BY feature)",
        "s0 AS (SELECT feature, uniq, (SELECT COUNT(DISTINCT read) FROM c) * 1.0 / (SELECT COUNT(*) FROM u) AS total, CAST(1.0 AS DOUBLE) AS shared FROM u)",
    ]
    for i in range(rounds):
        parts.append(
            f"""z{i} AS (SELECT read, feature, z / SUM(z) OVER (PARTITION BY read) AS part FROM
                (SELECT c.read, c.feature, c.weight * total * shared AS z FROM c JOIN s{i} USING (feature) WHERE nf > 1) y)"""
        )
        parts.append(
            f"""s{i + 1} AS MATERIALIZED (SELECT feature, uniq, uniq + coalesce(p, 0) AS total, coalesce(p, 0) AS shared FROM s{i}
                LEFT JOIN (SELECT feature, SUM(part) AS p FROM z{i} GROUP BY feature) q USING (feature))"""
        )
    return "WITH " + ", ".join(parts) + f" SELECT {select} FROM s{rounds}"


@query("a01_em_abundance", _em_check(3, "feature, round(total, 4) AS abundance"))
def em_abundance(t):
    """Three rounds of the multi-mapping EM over all lines."""
    return em.em_counts(t["scores"], max_rounds=3).counts.select("feature", F.round("abundance", 4).alias("abundance"))


@query("a01_em_counts", _em_check(12, "feature, CAST(round_even(total, 0) AS BIGINT) AS count"))
def em_final_counts(t):
    """Twelve rounds, rounded to counts (half to even)."""
    return em.em_counts(t["scores"], max_rounds=12).counts.select("feature", "count")


_SETTLED = """WITH RECURSIVE w AS (SELECT read, feature, SUM((exp(100.0 * (score / best - 1)) - exp(-100.0)) / (1 - exp(-100.0))) AS weight
        FROM (SELECT *, MAX(score) OVER (PARTITION BY read) AS best FROM {scores}) b GROUP BY read, feature),
    c AS MATERIALIZED (SELECT *, COUNT(*) OVER (PARTITION BY read) AS nf FROM w), m AS MATERIALIZED (SELECT read, feature, weight FROM c WHERE nf > 1),
    k AS MATERIALIZED (SELECT COUNT(DISTINCT read) AS reads, COUNT(DISTINCT feature) AS k FROM c),
    r AS (SELECT 0 AS it, feature, CAST(COUNT(CASE WHEN nf = 1 THEN 1 END) AS DOUBLE) AS uniq, CAST(any_value(reads) AS DOUBLE) / any_value(k) AS total, CAST(1 AS DOUBLE) AS shared, CAST(1 AS DOUBLE) AS moved FROM c, k GROUP BY feature
      UNION ALL SELECT it, feature, uniq, total, shared, SUM(abs(total - old)) OVER () * k.k / k.reads FROM (
        SELECT r.it + 1 AS it, r.feature, r.uniq, r.uniq + coalesce(q.p, 0) AS total, coalesce(q.p, 0) AS shared, r.total AS old FROM r LEFT JOIN (
          SELECT feature, SUM(part) AS p FROM (SELECT read, feature, z / SUM(z) OVER (PARTITION BY read) AS part FROM (
            SELECT m.read, m.feature, m.weight * r.total * r.shared AS z FROM m JOIN r USING (feature)) y) x GROUP BY feature) q ON q.feature = r.feature
        WHERE r.moved >= 0.000001 AND r.it < 100) n, k)
    SELECT feature, round(total, 4) AS abundance, CAST(round_even(total, 0) AS BIGINT) AS count FROM r WHERE it = (SELECT MAX(it) FROM r)"""


@query("a01_em_settled", _SETTLED)
def em_settled(t):
    """Abundances and counts when the model has settled (1e-6) or after 100 rounds."""
    return em.em_counts(t["scores"]).counts.select("feature", F.round("abundance", 4).alias("abundance"), "count")


def _mixture_check(rounds: int) -> str:
    parts = ["p0 AS (SELECT 0.5 AS q1, 0.5 AS q2, 10.0 AS m1, 40.0 AS m2, 60.0 AS v1, 60.0 AS v2)"]
    for i in range(rounds):
        dens = [f"q{k} * exp(-(x - m{k}) * (x - m{k}) / (2 * v{k})) / sqrt(2 * pi() * v{k})" for k in (1, 2)]
        parts.append(f"d{i} AS (SELECT l_quantity AS x, {dens[0]} AS a, {dens[1]} AS b FROM (SELECT l_quantity, l_quantity AS x FROM {{lineitem}}) l, p{i})")
        parts.append(
            f"""r{i} AS (SELECT COUNT(*) AS n, SUM(a / (a + b)) AS w1, SUM(b / (a + b)) AS w2, SUM(a / (a + b) * x) AS s1, SUM(b / (a + b) * x) AS s2,
                SUM(a / (a + b) * x * x) AS t1, SUM(b / (a + b) * x * x) AS t2 FROM d{i})"""
        )
        parts.append(
            f"""p{i + 1} AS MATERIALIZED (SELECT w1 / n AS q1, w2 / n AS q2, s1 / w1 AS m1, s2 / w2 AS m2, t1 / w1 - (s1 / w1) * (s1 / w1) AS v1, t2 / w2 - (s2 / w2) * (s2 / w2) AS v2 FROM r{i})"""
        )
    dens = [f"q{k} * exp(-(l_quantity - m{k}) * (l_quantity - m{k}) / (2 * v{k})) / sqrt(v{k})" for k in (1, 2)]
    return (
        "WITH " + ", ".join(parts)
        + f""" SELECT component, COUNT(*) AS n, round(MAX(CASE WHEN component = 1 THEN m1 ELSE m2 END), 4) AS mean, round(MAX(CASE WHEN component = 1 THEN v1 ELSE v2 END), 4) AS variance
            FROM (SELECT *, CASE WHEN {dens[0]} > {dens[1]} THEN 1 ELSE 2 END AS component FROM {{lineitem}}, p{rounds}) y GROUP BY component"""
    )


def _univariate(li, **limits):
    fit = mixture.univariate_mixture(li, "l_quantity", [10, 40], [60, 60], [0.5, 0.5], **limits)
    labelled = mixture.univariate_labels(li, "l_quantity", fit)
    first = F.col("component") == 1
    rows = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n")).select(
        "component", "n",
        F.round(F.when(first, fit.means[0]).otherwise(fit.means[1]), 4).alias("mean"),
        F.round(F.when(first, fit.variances[0]).otherwise(fit.variances[1]), 4).alias("variance"),
    )
    return rows if limits else rows.withColumns({"rounds": F.lit(fit.rounds), "converged": F.lit(fit.converged)})


@query("a25_univariate_mixture", _mixture_check(4))
def univariate_mixture(t):
    """Four rounds."""
    return _univariate(t["lineitem"], tol=0.0, max_rounds=4)


_SETTLED_DENSITY = [f"q{k} * exp(-(x - m{k}) * (x - m{k}) / (2 * v{k})) / sqrt(2 * pi() * v{k})" for k in (1, 2)]
UNIVARIATE = f"""WITH RECURSIVE l AS MATERIALIZED (SELECT l_quantity AS x, COUNT(*) AS c FROM {{lineitem}} GROUP BY l_quantity),
    r AS (SELECT 0 AS it, CAST(1 AS DOUBLE) AS moved, CAST(0.5 AS DOUBLE) AS q1, CAST(0.5 AS DOUBLE) AS q2, CAST(10 AS DOUBLE) AS m1, CAST(40 AS DOUBLE) AS m2, CAST(60 AS DOUBLE) AS v1, CAST(60 AS DOUBLE) AS v2
      UNION ALL SELECT it + 1, greatest(abs(w1 / n - q1), abs(w2 / n - q2), abs(s1 / w1 - m1), abs(s2 / w2 - m2), abs(t1 / w1 - (s1 / w1) * (s1 / w1) - v1), abs(t2 / w2 - (s2 / w2) * (s2 / w2) - v2)),
          w1 / n, w2 / n, s1 / w1, s2 / w2, t1 / w1 - (s1 / w1) * (s1 / w1), t2 / w2 - (s2 / w2) * (s2 / w2)
        FROM (SELECT it, q1, q2, m1, m2, v1, v2, SUM(c) AS n, SUM(c * a / (a + b)) AS w1, SUM(c * b / (a + b)) AS w2, SUM(c * a / (a + b) * x) AS s1, SUM(c * b / (a + b) * x) AS s2,
            SUM(c * a / (a + b) * x * x) AS t1, SUM(c * b / (a + b) * x * x) AS t2
          FROM (SELECT r.*, x, c, {_SETTLED_DENSITY[0]} AS a, {_SETTLED_DENSITY[1]} AS b FROM r, l WHERE moved > 0.00001 AND it < 100) d GROUP BY ALL) y),
    f AS (SELECT * FROM r ORDER BY it DESC LIMIT 1)
    SELECT component, COUNT(*) AS n, round(MAX(CASE WHEN component = 1 THEN m1 ELSE m2 END), 4) AS mean, round(MAX(CASE WHEN component = 1 THEN v1 ELSE v2 END), 4) AS variance, MAX(it) AS rounds, bool_and(moved <= 0.00001) AS converged
    FROM (SELECT f.*, CASE WHEN {_SETTLED_DENSITY[0]} > {_SETTLED_DENSITY[1]} THEN 1 ELSE 2 END AS component FROM (SELECT l_quantity AS x FROM {{lineitem}}) li, f) y GROUP BY component"""


@query("a25_univariate_settled", UNIVARIATE)
def univariate_settled(t):
    """Until no parameter moves by more than 1e-5 or after 100 rounds, and whether it has settled."""
    return _univariate(t["lineitem"])


def _multivariate_check() -> str:
    """Plain rounds of two components in two dimensions; inverse and determinant of a 2 x 2 matrix are closed forms."""
    ks = (1, 2)
    det = {k: f"(a{k} * c{k} - b{k} * b{k})" for k in ks}
    form = {k: f"(c{k} * (x - m{k}) * (x - m{k}) - 2 * b{k} * (x - m{k}) * (y - n{k}) + a{k} * (y - n{k}) * (y - n{k})) / {det[k]}" for k in ks}
    dens = {k: f"q{k} * exp(-0.5 * {form[k]}) / (2 * pi() * sqrt({det[k]}))" for k in ks}
    names = ["q", "m", "n", "a", "b", "c"]
    state = ", ".join(f"{x}{k}" for k in ks for x in names)
    start = {1: (0.5, 15, 20, 150, 0, 400), 2: (0.5, 35, 60, 150, 0, 400)}
    first = ", ".join(f"CAST({v} AS DOUBLE) AS {x}{k}" for k in ks for x, v in zip(names, start[k]))
    sums = ", ".join(f"SUM(r{k}) AS w{k}, SUM(r{k} * x) AS sx{k}, SUM(r{k} * y) AS sy{k}, SUM(r{k} * x * x) AS xx{k}, SUM(r{k} * x * y) AS xy{k}, SUM(r{k} * y * y) AS yy{k}" for k in ks)
    new = ", ".join(
        f"w{k} / cnt AS q{k}, sx{k} / w{k} AS m{k}, sy{k} / w{k} AS n{k}, xx{k} / w{k} - (sx{k} / w{k}) * (sx{k} / w{k}) AS a{k}, xy{k} / w{k} - (sx{k} / w{k}) * (sy{k} / w{k}) AS b{k}, yy{k} / w{k} - (sy{k} / w{k}) * (sy{k} / w{k}) AS c{k}"
        for k in ks)
    like = " + ".join(f"-0.5 * w{k} * (-ln(2 * pi()) - 0.5 * ln({det[k]}) - 1)" for k in ks)
    return f"""WITH RECURSIVE l AS MATERIALIZED (SELECT l_quantity AS x, l_extendedprice / 1000 AS y FROM {{lineitem}}),
      r AS (SELECT 0 AS it, CAST(1 AS DOUBLE) AS moved, CAST(0 AS DOUBLE) AS likelihood, {first}
        UNION ALL SELECT it + 1, least(abs({like} - old), abs(q1 - p1), abs(q2 - p2)), {like}, {state} FROM (
          SELECT it, likelihood AS old, w1, w2, q1 AS p1, q2 AS p2, {new} FROM (
            SELECT it, likelihood, q1, q2, COUNT(*) AS cnt, {sums} FROM (
              SELECT it, likelihood, q1, q2, x, y, d1 / (d1 + d2) AS r1, d2 / (d1 + d2) AS r2 FROM (
                SELECT r.*, x, y, {dens[1]} AS d1, {dens[2]} AS d2 FROM r, l WHERE moved > 1e-12 AND it < 8000) e) f GROUP BY it, likelihood, q1, q2) g) h),
      f AS (SELECT * FROM r ORDER BY it DESC LIMIT 1)
      SELECT (SELECT COUNT(*) FROM l) AS n, round(q1, 4) AS p0, round(q2, 4) AS p1, round(m1, 4) AS m0, round(m2, 4) AS m1, moved <= 1e-12 AS converged FROM f"""


@query("a25_multivariate_mixture", _multivariate_check())
def multivariate_mixture(t):
    """Two components in two dimensions, to the stopping rule."""
    rows = t["lineitem"].withColumn("price", F.col("l_extendedprice") / 1000)
    fit = mixture.multivariate_mixture(
        rows, ["l_quantity", "price"], [[15, 20], [35, 60]], [[[150, 0], [0, 400]], [[150, 0], [0, 400]]], [0.5, 0.5], accelerate=True
    )
    score = [
        F.round(F.lit(p), 4).alias(f"p{i}") for i, p in enumerate(fit.probs)
    ] + [F.round(F.lit(m[0]), 4).alias(f"m{i}") for i, m in enumerate(fit.means)]
    return rows.agg(F.count(F.lit(1)).alias("n")).select("n", *score, F.lit(fit.converged).alias("converged"))


_UNIFORM = "CAST('0x' || substr(md5(transcript || ':4:{}'), 1, 10) AS BIGINT) / 1099511627776.0"


@query(
    "src13_simulated_counts",
    f"""WITH p AS (SELECT CAST(p_partkey AS STRING) AS transcript FROM {{part}}),
        b AS (SELECT transcript, CAST(floor(1 + 299 * ({_UNIFORM.format('count')})) AS BIGINT) AS base, {_UNIFORM.format('fold')} AS draw FROM p),
        g AS (SELECT transcript, base, 'control' AS grp, 1.0 AS fold FROM b UNION ALL SELECT transcript, base, 'treated', CASE WHEN draw < 0.05 THEN 0.5 WHEN draw < 0.95 THEN 1.0 ELSE 2.0 END FROM b)
        SELECT transcript, grp AS "group", replicate, base, CAST(fold AS DOUBLE) AS fold, CAST(floor(base * fold) AS BIGINT) AS count FROM g, (SELECT 1 AS replicate UNION ALL SELECT 2) r""",
)
def simulated_counts(t):
    return evaluate.simulated_counts(t["part"].select(F.col("p_partkey").cast("string").alias("transcript"))).select(
        "transcript", "group", "replicate", "base", "fold", "count"
    )


# ------------------------------------------------------------------------ graph


@query(
    "g01_signed_graph",
    f"""WITH w AS ({WALK_STEPS}), o AS (SELECT a AS src, b AS dst FROM w UNION ALL SELECT -b, -a FROM w), e AS (
          SELECT DISTINCT src, dst FROM o UNION SELECT p_partkey + 5, p_partkey + 6 FROM {{part}})
        SELECT e.src, e.dst, COUNT(o.src) AS weight FROM e LEFT JOIN o ON e.src = o.src AND e.dst = o.dst GROUP BY e.src, e.dst""",
)
def signed_graph(t):
    known = t["part"].select(
        (F.col("p_partkey") + 5).alias("node"), F.lit(1).alias("side"), (F.col("p_partkey") + 6).alias("nbr")
    )
    return graphprep.signed_graph(graphprep.observed_edges(_walks(t)), known)


EDGES = """SELECT p_partkey + 1 AS src, p_partkey + 2 AS dst, CAST(p_size AS BIGINT) AS weight FROM {part}
    UNION ALL SELECT p_partkey + 1, p_partkey + 3 + p_size % 3, CAST(p_size % 4 AS BIGINT) FROM {part}"""
TARGETS = "SELECT alignment AS pair, n - 4 AS src, n - 4 + 1 + score % 6 AS dst, CAST(60 + ln * 10 AS BIGINT) AS budget FROM {alignments}"
ROUTES = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT x.src, x.dst, x.weight, coalesce(len, 1) AS to_len FROM ({EDGES}) x LEFT JOIN {{node_len}} ON x.dst = node),
    tg AS MATERIALIZED ({TARGETS}), lim AS (SELECT src, MAX(budget) AS lim FROM tg GROUP BY src),
    r AS (SELECT src, src AS at, CAST(0 AS BIGINT) AS cost, CAST(0 AS BIGINT) AS through, CAST(0 AS BIGINT) AS depth, 0 AS hops, CAST([] AS BIGINT[]) AS done, CAST([] AS BIGINT[]) AS inner_ids FROM lim
      UNION ALL SELECT r.src, e.dst, r.through, r.through + e.to_len, r.depth + e.weight, r.hops + 1, list_append(r.done, e.dst), r.done
        FROM r JOIN e ON r.at = e.src JOIN lim ON lim.src = r.src WHERE r.through <= lim.lim)"""


@query(
    "g02_bounded_shortest_path",
    ROUTES + """ SELECT pair, MIN(cost) AS cost FROM tg JOIN r ON r.src = tg.src AND r.at = tg.dst AND hops > 0 WHERE cost <= budget GROUP BY pair""",
)
def bounded_shortest_path(t):
    """Pairs whose ends a path within budget connects, with the cheapest inner length."""
    want = t.sql(TARGETS)
    paths = paths_search.bounded_paths(want.select("src", "dst", "budget"), t.sql(EDGES), t["node_len"])
    best = paths_search.shortest_inner(paths)
    return want.join(best, ["src", "dst"]).filter("cost <= budget").select("pair", "cost")


@query(
    "g06_fewest_hops_fill",
    ROUTES + """, o AS (SELECT pair, hops, cost, depth, inner_ids, row_number() OVER (PARTITION BY pair ORDER BY hops, cost, depth DESC, inner_ids) AS k
        FROM tg JOIN r ON r.src = tg.src AND r.at = tg.dst AND hops > 0 WHERE cost <= budget)
      SELECT pair, hops, cost, depth, list_aggregate(inner_ids, 'string_agg', ',') AS inner_ids FROM o WHERE k = 1""",
)
def fewest_hops_fill(t):
    """The first path found when widening hop by hop, per pair and its own budget."""
    want = t.sql(TARGETS)
    paths = paths_search.bounded_paths(want.select("src", "dst", "budget"), t.sql(EDGES), t["node_len"], fewest=True)
    fits = want.join(paths, ["src", "dst"]).filter("cost <= budget")
    first = fits.groupBy("pair").agg(F.min_by(F.struct("hops", "cost", "depth", "inner"), "hops").alias("r")).select("pair", "r.*")
    ids = F.nullif(F.array_join(F.transform("inner", lambda n: n.cast("string")), ","), F.lit(""))
    return first.select("pair", "hops", "cost", "depth", ids.alias("inner_ids"))


# A chain of places: between two backbone nodes lie two short alleles and a long one; every fifth short one leads further on.
BUBBLE_LEN = """SELECT p_partkey * 4 AS node, CAST(12 + p_size % 9 AS BIGINT) AS len FROM {part} UNION ALL SELECT p_partkey * 4 + 1, CAST(1 + p_size % 10 AS BIGINT) FROM {part}
    UNION ALL SELECT p_partkey * 4 + 2, CAST(1 + p_size % 7 AS BIGINT) FROM {part} UNION ALL SELECT p_partkey * 4 + 3, CAST(11 + p_size % 3 AS BIGINT) FROM {part}"""
BUBBLES = """SELECT p_partkey * 4 AS src, p_partkey * 4 + 1 AS dst, CAST(p_size % 6 AS BIGINT) AS weight FROM {part} UNION ALL SELECT p_partkey * 4, p_partkey * 4 + 2, CAST(p_size % 4 AS BIGINT) FROM {part}
    UNION ALL SELECT p_partkey * 4, p_partkey * 4 + 3, CAST(p_size % 3 AS BIGINT) FROM {part} UNION ALL SELECT p_partkey * 4 + 1, p_partkey * 4 + 4, CAST(1 AS BIGINT) FROM {part}
    UNION ALL SELECT p_partkey * 4 + 2, CASE WHEN p_size % 5 = 0 THEN p_partkey * 4 + 8 ELSE p_partkey * 4 + 4 END, CAST(2 AS BIGINT) FROM {part} UNION ALL SELECT p_partkey * 4 + 3, p_partkey * 4 + 4, CAST(0 AS BIGINT) FROM {part}"""
BUBBLE_ENDS = "SELECT alignment AS pair, (n - 4) * 4 AS src, (n - 4) * 4 + 1 + score % 11 AS dst, CAST(20 + ln * 12 AS BIGINT) AS budget FROM {alignments}"


@query(
    "g06_bubble_fill",
    f"""WITH RECURSIVE x AS ({BUBBLES}), ln AS ({BUBBLE_LEN}), tg AS MATERIALIZED ({BUBBLE_ENDS}), lim AS (SELECT src, MAX(budget) AS lim FROM tg GROUP BY src),
      ahead AS (SELECT src AS dst, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS nexts FROM x GROUP BY src),
      sized AS (SELECT x.*, coalesce(len, 1) AS to_len, coalesce(nexts, '') AS nexts FROM x LEFT JOIN ln ON x.dst = node LEFT JOIN ahead ON ahead.dst = x.dst),
      alleles AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY src, nexts ORDER BY weight DESC, dst) AS k, SUM(weight) OVER (PARTITION BY src, nexts) AS total FROM sized WHERE to_len <= 10),
      e AS MATERIALIZED (SELECT src, dst, weight, to_len, true AS passes FROM sized WHERE to_len > 10 UNION ALL SELECT src, dst, CASE WHEN k = 1 THEN total ELSE weight END, to_len, k = 1 FROM alleles),
      r AS (SELECT src, src AS at, CAST(0 AS BIGINT) AS cost, CAST(0 AS BIGINT) AS through, CAST(0 AS HUGEINT) AS depth, 0 AS hops, true AS passes, CAST([] AS BIGINT[]) AS done, CAST([] AS BIGINT[]) AS inner_ids FROM lim
        UNION ALL SELECT r.src, e.dst, r.through, r.through + e.to_len, r.depth + e.weight, r.hops + 1, e.passes, list_append(r.done, e.dst), r.done
          FROM r JOIN e ON r.at = e.src JOIN lim ON lim.src = r.src WHERE r.through <= lim.lim AND r.passes),
      o AS (SELECT pair, hops, cost, depth, inner_ids, row_number() OVER (PARTITION BY pair ORDER BY hops, cost, depth DESC, inner_ids) AS k
        FROM tg JOIN r ON r.src = tg.src AND r.at = tg.dst AND hops > 0 WHERE cost <= budget)
      SELECT pair, hops, cost, CAST(depth AS BIGINT) AS depth, list_aggregate(inner_ids, 'string_agg', ',') AS inner_ids FROM o WHERE k = 1""",
)
def bubble_fill(t):
    """Paths through parallel alleles: at each place the allele seen most often, then the smallest node."""
    want, lengths = t.sql(BUBBLE_ENDS), t.sql(BUBBLE_LEN)
    graph = paths_search.contract_bubbles(t.sql(BUBBLES), lengths)
    paths = paths_search.bounded_paths(want.select("src", "dst", "budget"), graph, lengths, fewest=True)
    fits = want.join(paths, ["src", "dst"]).filter("cost <= budget")
    first = fits.groupBy("pair").agg(F.min_by(F.struct("hops", "cost", "depth", "inner"), "hops").alias("r")).select("pair", "r.*")
    ids = F.nullif(F.array_join(F.transform("inner", lambda n: n.cast("string")), ","), F.lit(""))
    return first.select("pair", "hops", "cost", "depth", ids.alias("inner_ids"))


@query(
    "g05_reference_fill",
    """WITH x AS (SELECT alignment, n * 30 + 10 AS lo, n * 30 + 10 + score * 8 AS hi, dir FROM {alignments}), s AS (SELECT p_partkey AS node, p_partkey * 30 AS s0, p_partkey * 30 + 30 AS s1 FROM {part})
       SELECT alignment AS pair, string_agg(CAST(node AS STRING), ',' ORDER BY s0 * dir) AS filled, MIN(hi - lo) + 200 AS frag FROM x LEFT JOIN s ON s0 >= lo AND s1 < hi GROUP BY alignment""",
)
def reference_fill(t):
    one = F.array(_src_step(F.col("n"), 1))
    reaches = t["alignments"].select(
        F.col("alignment").alias("pair"), F.lit("c").alias("lin_chrom"), (F.col("n") * 30 + 10).alias("edge_lo"),
        (F.col("n") * 30 + 10 + F.col("score") * 8).alias("edge_hi"), F.col("dir").alias("reach_dir"), F.lit(200).alias("kept_len"),
        one.cast(SRC_STEPS).alias("part1"), one.cast(SRC_STEPS).alias("part2"), F.array().cast(STEPS).alias("path1"), F.array().cast(STEPS).alias("path2"),
    )
    l2g = t["part"].select(
        F.lit("c").alias("chrom"), (F.col("p_partkey") * 30).alias("start"), (F.col("p_partkey") * 30 + 30).alias("end"),
        F.col("p_partkey").alias("node"), F.lit(1).alias("dir"), F.lit(30).cast("long").alias("len"),
    )
    done = complete.fill_from_reference(reaches, l2g)
    filled = F.transform(F.filter("path", lambda s: s["src"] == 4), lambda s: s["node"].cast("string"))
    return done.select("pair", F.nullif(F.array_join(filled, ","), F.lit("")).alias("filled"), "frag")


def _src_step(node, src):
    zero = F.lit(0).cast("long")
    return F.struct(
        node.cast("long").alias("node"), F.lit(1).alias("dir"), F.lit(30).cast("long").alias("len"), zero.alias("head"), zero.alias("tail"),
        F.lit(src).alias("src"),
    )


# ----------------------------------------------------------------------- growth


def _growth_rows(t):
    """Every read path next to the features whose nodes it touches or borders."""
    reads, feats = _read_paths(t), _feature_paths(t)
    wide = reads.withColumn("path", F.concat("path", F.array(_bare_step(F.col("n") - 1), _bare_step(F.col("n") + 2))))
    cand = _candidates(wide.select("alignment", F.col("path").cast(STEPS).alias("path")), feats)
    rows = reads.select(
        "alignment", "read", F.col("rf").alias("sample"), "score", F.lit(0).alias("frag"), F.lit(0).alias("mm_total"),
        F.lit(0).alias("mm_index"), F.lit(None).cast("string").alias("lin"),
        F.transform("path", lambda s: s.withField("src", F.lit(1))).cast(SRC_STEPS).alias("path"),
    )
    return cand, rows, feats.withColumn("flen", F.lit(100.0))


def _bare_step(node):
    zero = F.lit(0).cast("long")
    return F.struct(node.cast("long").alias("node"), F.lit(1).alias("dir"), F.lit(60).cast("long").alias("len"), zero.alias("head"), zero.alias("tail"))


GROW_CAND = f"""SELECT DISTINCT a.alignment, f.feature FROM (SELECT alignment, n + d AS node FROM {{alignments}}, (SELECT -1 AS d UNION ALL SELECT 0 UNION ALL SELECT 1 UNION ALL SELECT 2) k) a
    JOIN ({FEATURE_STEPS}) f ON a.node = f.node"""


def _grow_check(rounds: int, support: int) -> str:
    """Region growth written out round by round (unstranded reads, body only); rounds after the last gain change nothing."""
    merge = """SELECT feature, node, dir, MIN(s) AS s, MAX(e) AS e FROM (SELECT *, SUM(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY feature, node, dir ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g
        FROM (SELECT *, MAX(e) OVER (PARTITION BY feature, node, dir ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src}) a) b GROUP BY feature, node, dir, g"""
    parts = [
        f"cand AS MATERIALIZED ({GROW_CAND})",
        f"st AS MATERIALIZED (SELECT feature, r.alignment, node, dir, s, e, (e - s) / 60.0 AS c FROM cand JOIN ({READ_STEPS}) r ON cand.alignment = r.alignment)",
        "smp AS (SELECT alignment, rf FROM {alignments})",
        f"reg0 AS (SELECT feature, node, fdir AS dir, fs AS s, fe AS e FROM ({FEATURE_STEPS}) f)",
        "taken0 AS (SELECT feature, alignment FROM st WHERE FALSE)",
    ]
    for i in range(rounds):
        parts += [
            f"""ov{i} AS (SELECT st.feature, st.alignment, SUM(greatest(0, least(st.e, g.e) - greatest(st.s, g.s))) AS shared FROM st JOIN reg{i} g ON st.feature = g.feature AND st.node = g.node
                  AND st.dir * g.dir * -1 >= 0 WHERE NOT EXISTS (SELECT 1 FROM taken{i} k WHERE k.feature = st.feature AND k.alignment = st.alignment) GROUP BY ALL HAVING shared > 30)""",
            f"ok{i} AS (SELECT feature FROM ov{i} JOIN smp USING (alignment) GROUP BY feature HAVING COUNT(*) >= {2 * support} AND COUNT(DISTINCT rf) >= {support})",
            f"fresh{i} AS MATERIALIZED (SELECT feature, alignment FROM ov{i} WHERE feature IN (SELECT feature FROM ok{i}))",
            f"taken{i + 1} AS MATERIALIZED (SELECT * FROM taken{i} UNION ALL SELECT * FROM fresh{i})",
            f"new{i} AS (SELECT st.* FROM st JOIN fresh{i} USING (feature, alignment))",
            f"""vote{i} AS (SELECT feature, node, CASE WHEN rev IS NULL THEN 1 WHEN fwd IS NULL THEN -1 WHEN rev > 2 * fwd THEN -1 WHEN fwd > 2 * rev THEN 1 ELSE 0 END AS v FROM (
                  SELECT feature, node, round(SUM(CASE WHEN dir > 0 THEN c END), 9) AS fwd, round(SUM(CASE WHEN dir < 0 THEN c END), 9) AS rev FROM new{i} n WHERE NOT EXISTS (SELECT 1 FROM reg{i} g WHERE g.feature = n.feature AND g.node = n.node) GROUP BY ALL) q)""",
            f"""all{i} AS (SELECT feature, node, dir, s, e FROM reg{i} UNION ALL SELECT n.feature, n.node, g.dir, n.s, n.e FROM new{i} n JOIN (SELECT DISTINCT feature, node, dir FROM reg{i}) g
                  ON n.feature = g.feature AND n.node = g.node AND n.dir * g.dir * -1 >= 0 WHERE n.s < n.e
                  UNION ALL SELECT n.feature, n.node, v, n.s, n.e FROM new{i} n JOIN vote{i} x ON n.feature = x.feature AND n.node = x.node WHERE (v = 0 OR n.dir = v) AND n.s < n.e)""",
            f"reg{i + 1} AS MATERIALIZED (" + merge.replace("{src}", f"all{i}") + ")",
        ]
    return "WITH " + ", ".join(parts) + f" SELECT feature, alignment FROM taken{rounds}"


@query("g08_region_growth", _grow_check(8, 2))
def region_growth(t):
    """Growth to the fixed point over all features at once; A-03, A-12 and A-13 inside. The check has rounds to spare."""
    cand, rows, feats = _growth_rows(t)
    return growth.grow_assign(cand, None, rows, feats, "r", 2, "sample", 30).select("feature", "alignment")


RANGE_GROWTH = f"""WITH cand AS MATERIALIZED ({GROW_CAND}), st AS MATERIALIZED (SELECT feature, r.alignment, node, dir, s, e, (e - s) / 60.0 AS c FROM cand JOIN ({READ_STEPS}) r ON cand.alignment = r.alignment),
        f AS ({FEATURE_STEPS}), smp AS (SELECT alignment, rf FROM {{alignments}}),
        h AS (SELECT st.feature, st.alignment, SUM(CASE WHEN dir * fdir * -1 >= 0 THEN greatest(0, least(e, fe) - greatest(s, fs)) ELSE 0 END) AS same, SUM(greatest(0, least(e, fe) - greatest(s, fs))) AS total
              FROM st JOIN f ON st.feature = f.feature AND st.node = f.node GROUP BY ALL),
        h1 AS (SELECT feature, alignment FROM h WHERE same > 20 AND same > 0.8 * total),
        first AS MATERIALIZED (SELECT * FROM h1 WHERE feature IN (SELECT feature FROM h1 JOIN smp USING (alignment) GROUP BY feature HAVING COUNT(DISTINCT rf) >= 3)),
        seed AS MATERIALIZED (SELECT st.* FROM st JOIN first USING (feature, alignment)), sc AS (SELECT feature, node, dir, round(SUM(c * (e - s)), 9) AS score FROM seed GROUP BY ALL),
        best AS (SELECT feature, node, dir FROM (SELECT *, row_number() OVER (PARTITION BY feature, node ORDER BY score DESC, dir DESC) AS k FROM sc) q WHERE k = 1),
        sp AS (SELECT DISTINCT seed.feature, seed.node, seed.dir, s, e FROM seed JOIN best ON seed.feature = best.feature AND seed.node = best.node AND seed.dir = best.dir WHERE s < e),
        reg AS MATERIALIZED (SELECT feature, node, dir AS gdir, MIN(s) AS gs, MAX(e) AS ge FROM (SELECT *, SUM(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY feature, node, dir ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g
              FROM (SELECT *, MAX(e) OVER (PARTITION BY feature, node, dir ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp) a) b GROUP BY feature, node, dir, g),
        h2 AS (SELECT st.feature, st.alignment, SUM(CASE WHEN dir * gdir * -1 >= 0 THEN greatest(0, least(e, ge) - greatest(s, gs)) ELSE 0 END) AS same, SUM(greatest(0, least(e, ge) - greatest(s, gs))) AS total
              FROM st JOIN reg ON st.feature = reg.feature AND st.node = reg.node GROUP BY ALL)"""


@query(
    "g09_range_growth",
    f"""{RANGE_GROWTH}
       SELECT feature, alignment, 0 AS step FROM first UNION ALL SELECT feature, alignment, 1 FROM h2 WHERE same > 20 AND same > 0.8 * total AND (feature, alignment) NOT IN (SELECT feature, alignment FROM first)""",
)
def range_growth(t):
    """Features on their own: a read may grow several of them."""
    cand, rows, feats = _growth_rows(t)
    return growth.range_growth(cand, rows, feats, "r", 3, exclusive=False)


@query(
    "g09_exclusive_growth",
    f"""{RANGE_GROWTH},
       second AS MATERIALIZED (SELECT feature, alignment FROM h2 WHERE same > 20 AND same > 0.8 * total AND (feature, alignment) NOT IN (SELECT feature, alignment FROM first)),
       claims AS (SELECT feature, alignment, 0 AS step FROM first UNION ALL SELECT feature, alignment, 1 FROM second)
       SELECT feature, alignment, step FROM claims c WHERE step = 0 OR NOT EXISTS (SELECT 1 FROM claims o WHERE o.alignment = c.alignment AND o.feature < c.feature)""",
)
def exclusive_growth(t):
    """Features one after the other: a read grows the first that accepts it."""
    cand, rows, feats = _growth_rows(t)
    return growth.range_growth(cand, rows, feats, "r", 3)


CLOSURE = """SELECT alignment, n * 40 AS s, n * 40 + 3 + ln AS e, n * 40 + 40 * 50 + score AS branch FROM {alignments}"""


@query(
    "g11_interval_closure",
    f"""WITH RECURSIVE x AS ({CLOSURE}), i AS (SELECT *, SUM(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (ORDER BY s, e, alignment ROWS UNBOUNDED PRECEDING) AS g FROM (
          SELECT *, MAX(e) OVER (ORDER BY s, e, alignment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x) y),
        sp AS MATERIALIZED (SELECT g, MIN(s) AS s, MAX(e) AS e, COUNT(*) AS members FROM i GROUP BY g),
        lk AS (SELECT DISTINCT o.s AS u, d.s AS v FROM i JOIN sp o ON i.g = o.g JOIN sp d ON i.branch > d.s AND i.branch <= d.e),
        b AS MATERIALIZED (SELECT u, v FROM lk UNION SELECT v, u FROM lk UNION SELECT s, s FROM sp), r AS (SELECT u AS vertex, u AS c FROM b UNION SELECT b.v, r.c FROM r JOIN b ON r.vertex = b.u)
       SELECT (SELECT MIN(c) FROM r WHERE r.vertex = sp.s) AS region_set, s AS region_start, e AS region_end, members FROM sp""",
)
def interval_closure(t):
    rows = t.sql(CLOSURE).select("s", "e", F.array("branch").alias("branches"))
    return growth.interval_closure(rows, "s", "e", "branches")


# --------------------------------------------------------------------- clusters

SUPPORT = """SELECT DISTINCT a.feature AS f1, b.feature AS f2 FROM {supplier_spans} a JOIN {supplier_spans} b ON a.hap = b.hap AND a.dir = b.dir AND a.feature < b.feature
    AND a.start <= b.stop + 2000 AND b.start <= a.stop + 2000"""


@query(
    "p17_expression_support",
    f"""WITH c AS ({SUPPORT}), m AS (SELECT DISTINCT feature, sample, read, mm_total, mm_index FROM {{assign}}),
        l AS (SELECT DISTINCT f1, f2, x.sample FROM c JOIN m x ON x.feature = f1 JOIN m y ON y.feature = f2 AND x.sample = y.sample AND x.read = y.read AND x.mm_total = y.mm_total AND x.mm_index = y.mm_index),
        v AS (SELECT feature, sample, SUM(CASE WHEN mm_total = 0 AND mm_index = 0 THEN 1.0 ELSE 1.0 / mm_total END / flen) AS coverage FROM {{assign}} WHERE stage = 0 GROUP BY feature, sample),
        j AS (SELECT f1, f2, log2(coalesce(a.coverage, 0) + 1) AS l1, log2(coalesce(b.coverage, 0) + 1) AS l2 FROM l LEFT JOIN v a ON a.feature = f1 AND a.sample = l.sample LEFT JOIN v b ON b.feature = f2 AND b.sample = l.sample)
       SELECT f1, f2, COUNT(*) FILTER (l1 > 0 AND l2 > 0 AND abs(l1 - l2) < 0.1) AS samples,
         round(coalesce(SUM(l1 + l2) FILTER (l1 > 0 AND l2 > 0 AND abs(l1 - l2) < 0.1), 0) / SUM(l1 + l2), 6) AS share FROM j GROUP BY f1, f2""",
)
def expression_support(t):
    from strandloom.operators.transfer import feature_coverage

    near = clusters.colocated_pairs(_supplier_spans(t), 2000, 1e18)
    links = clusters.pair_support(t["assign"], near)
    out = clusters.expression_support(links, feature_coverage(t["assign"]), 0.1)
    return out.withColumn("share", F.round("share", 6))


@query("g10_feature_clusters")
def feature_clusters(t):
    """Greedy growth seed by seed has no SQL form; tested against a sequential loop. Includes J-09, J-12, P-17, S-02."""
    members, _, lengths = clusters.cluster_features(t["assign"], _supplier_spans(t), min_haps=1, min_samples=1)
    return members.join(lengths, "seed").select("seed", "feature", "length")


# ---------------------------------------------------------------- pair pipeline


def _g2l(t):
    c = F.col("p_partkey")
    return t["part"].filter("p_size % 4 <> 0").select(
        c.alias("node"), F.lit("chr1").alias("chrom"), (c * 60).alias("start"), (c * 60 + 60).alias("end")
    )


@query(
    "j08_extract_pairs",
    """WITH m AS (SELECT *, 2 * score + ln AS total, MAX(2 * score + ln) OVER (PARTITION BY read) AS best FROM {gaf_pairs} WHERE path2 <> '*'), g AS (SELECT *, COUNT(*) OVER (PARTITION BY read) AS n_best FROM m WHERE total >= best - 10)
       SELECT pair, read, total AS score, CASE WHEN ln <= 2 THEN 2 WHEN ln <= 4 THEN 1 ELSE 0 END AS overlap, CASE WHEN dir = 1 THEN n - 1 WHEN ln <= 4 THEN n - 2 ELSE n - 4 END AS start0,
         CASE WHEN dir = -1 THEN n + 1 WHEN ln <= 4 THEN n + 2 ELSE n + 4 END AS stop, n_best,
         CASE WHEN dir = 1 THEN CAST(n AS STRING) || ',' || CAST(coalesce(a.len, 1) AS STRING) || ',' || CAST(start1 AS STRING) || ',0;' || CAST(n + 1 AS STRING) || ',' || CAST(coalesce(b.len, 1) AS STRING) || ',0,' || CAST(104 - end1 AS STRING)
           ELSE CAST(-n - 1 AS STRING) || ',' || CAST(coalesce(b.len, 1) AS STRING) || ',0,' || CAST(start1 AS STRING) || ';' || CAST(-n AS STRING) || ',' || CAST(coalesce(a.len, 1) AS STRING) || ',' || CAST(104 - end1 AS STRING) || ',0' END AS path1
       FROM g LEFT JOIN {node_len} a ON a.node = n LEFT JOIN {node_len} b ON b.node = n + 1""",
)
def extract_pairs(t):
    """Alignment lines to pair rows: J-08, P-03, P-08, P-09, P-11 and G-03 chained."""
    pairs = extract.extract_pairs(text.parse_gaf(t["gaf_lines"], ["ordinal"]), t["node_len"])
    return pairs.select(
        "pair", "read", "score", "overlap", "start0", F.col("end").alias("stop"), "n_best", pt.render_steps(F.col("path1")).alias("path1")
    )


@query("g04_complete_pairs")
def complete_sample_pairs(t):
    """The whole completion flow on lines of one sample; its stages are checked one by one above."""
    pairs = extract.extract_pairs(text.parse_gaf(t["gaf_lines"], ["ordinal"]), t["node_len"])
    edges = t["part"].select(
        F.col("p_partkey").alias("node"), F.lit(1).alias("side"), (F.col("p_partkey") + 1).alias("nbr")
    )
    l2g = _g2l(t).select("chrom", "start", "end", "node", F.lit(1).alias("dir"), F.lit(60).cast("long").alias("len"))
    keep, _, _ = complete.complete_pairs(pairs, edges, _g2l(t), l2g, t["node_len"], "s1", 0.7)
    return keep.select("pair", "read", "decision", "frag", "start0", "end", "chunk", "chunks", "mm_total", "mm_index")
