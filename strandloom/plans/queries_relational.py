"""Queries for joins, aggregations, order-dependent operators and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandloom.functions import evidence as ev
from strandloom.model import STEPS
from strandloom.operators import (
    annotation, clusters, complete, components, dedupe, evaluate, extract, graphprep, growth, intervals, overlap, sampling, transfer,
)
from strandloom.operators.scan import placed, prefix_scan, quantiles, tile_of
from strandloom.plans.registry import query
from strandloom.session import ensure_checkpoint_dir, sliced
from strandloom.sources import regions, sinks, text

# ------------------------------------------------------------------------ joins

WINDOWS = "SELECT chrom, CAST(FLOOR(s / 90) AS BIGINT) AS feature, MIN(s) AS fs, MIN(s) + 20 AS fe FROM {spans} GROUP BY chrom, FLOOR(s / 90)"


@query(
    "j01_interval_overlap_left",
    f"""WITH w AS ({WINDOWS}) SELECT rid, spans.chrom, s, e, feature, fs, fe FROM {{spans}} LEFT JOIN w ON spans.chrom = w.chrom AND s < fe AND fs < e""",
)
def interval_overlap_left(t):
    return intervals.range_join(t["spans"], t.sql(WINDOWS), ["chrom"], ("s", "e"), ("fs", "fe"), "left", ["rid"])


@query(
    "src04_region_lookup",
    """SELECT pair, p_partkey AS feature FROM (SELECT pair, n - 1 AS a, n + score AS b FROM {gaf_pairs}) g JOIN {part} ON a < p_partkey * 3 + 9 AND p_partkey * 3 < b""",
)
def region_lookup(t):
    """J-17: node windows of reads against node ranges of features."""
    reads = t["gaf_pairs"].select("pair", (F.col("n") - 1).alias("a"), (F.col("n") + F.col("score")).alias("b"))
    feats = t["part"].select(
        F.col("p_partkey").alias("feature"), (F.col("p_partkey") * 3).alias("c"), (F.col("p_partkey") * 3 + 9).alias("d")
    )
    return intervals.range_join(reads, feats, [], ("a", "b"), ("c", "d")).select("pair", "feature")


def _stored(t, name):
    """A fresh folder in the shared storage of the session."""
    return f"{ensure_checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "src04_region_layout",
    "SELECT rid, chrom, s, e FROM {spans} WHERE (chrom = 3 AND s < 520 AND e > 500) OR (chrom = 7 AND s < 1401 AND e > 1400) OR (chrom = 7 AND s < 1450 AND e > 1390) OR (chrom = 1 AND s < 2000 AND e > 30)",
)
def region_layout(t):
    """SNK-03, SRC-04: all spans written by length class, bin and start; literal regions looked up in the files."""
    path = _stored(t, "regions")
    regions.write_regions(t["spans"], ["chrom"], "s", "e", path, bin_width=256)
    return regions.read_regions(t.spark, path).lookup((3, 500, 520), (7, 1400, 1401), (7, 1390, 1450), (1, 30, 2000)).select("rid", "chrom", "s", "e")


@query("src06_keyed_table", "SELECT node, len FROM {node_len} WHERE node IN (3, 50, 51, 117, 199, 1000000) UNION ALL SELECT node, len FROM {node_len} WHERE node IN (SELECT s_suppkey * 3 FROM {supplier})")
def keyed_table(t):
    """Node lengths stored by key and loaded by literal keys and by a table of keys."""
    path = _stored(t, "keyed")
    regions.write_keyed(t["node_len"], "node", path)
    wanted = t["supplier"].select((F.col("s_suppkey") * 3).alias("node"))
    return regions.read_keyed(t.spark, path, "node", [3, 50, 51, 117, 199, 1000000]).unionByName(regions.read_keyed(t.spark, path, "node", wanted))


@query(
    "snk03_sorted_files",
    """SELECT CAST(COUNT(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS overlaps, MIN(chrom) AS first_chrom, MAX(chrom) AS last_chrom FROM {spans}""",
)
def sorted_files(t):
    """Globally sorted files, read back: rows, and files that reach into the next one."""
    path = _stored(t, "sorted")
    sinks.write_sorted(t["spans"], ["chrom", "s", "e", "rid"], path)
    key = F.struct("chrom", "s", "e", "rid")
    files = t.spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("low"), F.max(key).alias("high"))
    follows = F.lead("low").over(Window.orderBy("low"))
    # One row per file.
    files = files.withColumn("over", (F.col("high") > follows).cast("long"))
    return files.agg(F.sum("rows").alias("n"), F.coalesce(F.sum("over"), F.lit(0)).alias("overlaps"), F.min("low.chrom").alias("first_chrom"), F.max("high.chrom").alias("last_chrom"))


READ_STEPS = """SELECT alignment, n AS node, dir, ln AS s, 60 AS e FROM {alignments} UNION ALL
    SELECT alignment, n + 1, dir, 0, 60 - score % 30 FROM {alignments}"""
FEATURE_STEPS = """SELECT p_partkey AS feature, p_partkey + 5 AS node, CASE WHEN p_size % 3 = 0 THEN 0 WHEN p_size % 3 = 1 THEN 1 ELSE -1 END AS fdir,
    p_size % 10 AS fs, 58 AS fe FROM {part} UNION ALL SELECT p_partkey, p_partkey + 6, CASE WHEN p_size % 2 = 1 THEN 1 ELSE -1 END, 3, 60 - p_size % 20 FROM {part}"""


def _step(node, direction, length, head, tail):
    return F.struct(
        node.cast("long").alias("node"), direction.cast("int").alias("dir"), length.cast("long").alias("len"),
        head.cast("long").alias("head"), tail.cast("long").alias("tail"),
    )


def _read_paths(t):
    c = F.col
    sixty, zero = F.lit(60), F.lit(0)
    path = F.array(
        _step(c("n"), c("dir"), sixty, c("ln"), zero), _step(c("n") + 1, c("dir"), sixty, zero, c("score") % 30)
    )
    return t["alignments"].select("alignment", path.cast(STEPS).alias("path"), "n", "read", "rf", "score")


def _feature_paths(t):
    c = F.col
    size = c("p_size")
    d1 = F.when(size % 3 == 0, 0).when(size % 3 == 1, 1).otherwise(-1)
    d2 = F.when(size % 2 == 1, 1).otherwise(-1)
    path = F.array(
        _step(c("p_partkey") + 5, d1, F.lit(60), size % 10, F.lit(2)),
        _step(c("p_partkey") + 6, d2, F.lit(60), F.lit(3), size % 20),
    )
    return t["part"].select(c("p_partkey").alias("feature"), path.cast(STEPS).alias("path"))


def _candidates(reads, feats):
    """Features with a node of the read's path. They are looked up once per list of nodes; alignments are numbered, so no pair comes twice."""
    a = reads.select("alignment", overlap.node_list("path").alias("_nodes"))
    b = feats.select("feature", F.explode(F.transform("path", lambda s: s["node"])).alias("node"))
    lists = a.select("_nodes").distinct().select("_nodes", F.explode("_nodes").alias("node"))
    near = lists.join(b, "node").groupBy("_nodes").agg(F.collect_set("feature").alias("_near"))
    return a.join(near, "_nodes").select("alignment", F.explode("_near").alias("feature"))


@query(
    "j02_path_overlap",
    f"""WITH r AS ({READ_STEPS}), f AS ({FEATURE_STEPS})
        SELECT alignment, feature, SUM(CASE WHEN dir * fdir * -1 >= 0 THEN greatest(0, least(e, fe) - greatest(s, fs)) ELSE 0 END) AS same,
          SUM(greatest(0, least(e, fe) - greatest(s, fs))) AS total FROM r JOIN f ON r.node = f.node GROUP BY alignment, feature""",
    longs=("total", "same"),
)
def path_overlap(t):
    reads, feats = _read_paths(t), _feature_paths(t)
    return overlap.path_overlap(_candidates(reads, feats), reads.select("alignment", "path"), feats, -1, "alignment", "feature")


@query(
    "snk01_overlap_routing",
    f"""WITH r AS ({READ_STEPS}), f AS ({FEATURE_STEPS}), o AS (
        SELECT alignment, feature, SUM(CASE WHEN dir * fdir * -1 >= 0 THEN greatest(0, least(e, fe) - greatest(s, fs)) ELSE 0 END) AS same
        FROM r JOIN f ON r.node = f.node GROUP BY alignment, feature)
        SELECT CASE WHEN o.feature IS NULL THEN 'M' WHEN same < 30 THEN 'A' ELSE 'O' END AS code, COUNT(*) AS n
        FROM {{alignments}} LEFT JOIN o ON alignments.alignment = o.alignment GROUP BY 1""",
)
def overlap_routing(t):
    reads, feats = _read_paths(t), _feature_paths(t)

    def counted(mine):
        # A slice of reads is one slice of the overlap, and only its counts are kept.
        own = mine(reads)
        scored = overlap.path_overlap(_candidates(own, feats), own.select("alignment", "path"), feats, -1, "alignment", "feature", slice_rows=0)
        routed = overlap.route(mine(t["alignments"].select("alignment")).join(scored, "alignment", "left"))
        return routed.groupBy("code").agg(F.count(F.lit(1)).alias("n"))

    return sliced(t["alignments"].count(), "alignment", counted, "routed").groupBy("code").agg(F.sum("n").alias("n"))


@query("j03_length_default", "SELECT alignment, n AS node, coalesce(len, 1) AS len FROM {alignments} LEFT JOIN {node_len} ON n = node")
def length_default(t):
    return graphprep.with_length(t["alignments"].select("alignment", F.col("n").alias("node")), t["node_len"])


@query(
    "j04_link_report",
    """SELECT 'c' || CAST(n_regionkey AS STRING) AS chrom, s_suppkey AS start, s_suppkey + 50 AS stop, s_name AS id, count FROM {supplier}
       JOIN {nation} ON s_nationkey = n_nationkey JOIN (SELECT l_suppkey, COUNT(*) AS count FROM {lineitem} GROUP BY l_suppkey) r ON s_suppkey = l_suppkey""",
)
def link_report(t):
    """SRC-08 and P-24: report rows matched to the gene_id attribute of GTF lines."""
    report = text.parse_report(
        t.sql(
            """SELECT s_name || chr(9) || 'x' || chr(9) || CAST(c AS STRING) AS value FROM {supplier} JOIN
               (SELECT l_suppkey, COUNT(*) AS c FROM {lineitem} GROUP BY l_suppkey) r ON s_suppkey = l_suppkey
               UNION ALL SELECT '__no_feature' || chr(9) || 'x' || chr(9) || '5' FROM {region}"""
        )
    )
    gtf = text.parse_gtf(
        t.sql(
            """SELECT 'c' || CAST(n_regionkey AS STRING) || chr(9) || 'a' || chr(9) || 'gene' || chr(9) || CAST(s_suppkey AS STRING) || chr(9) ||
               CAST(s_suppkey + 50 AS STRING) || chr(9) || '.' || chr(9) || '+' || chr(9) || '.' || chr(9) || 'gene_id "' || s_name || '"; locus "x";' AS value
               FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"""
        )
    )
    return transfer.link_report(report, gtf).withColumnRenamed("end", "stop")


PLACES = """SELECT CAST(p_partkey AS STRING) AS id, CASE WHEN p_size % 7 = 0 THEN 'NA' ELSE 'chr' || CAST(p_size % 3 AS STRING) || ':' ||
    CAST(p_partkey * 700 AS STRING) || '-' || CAST(p_partkey * 700 + p_size * 10 AS STRING) || ':+;chr1:' || CAST(p_partkey * 900 AS STRING) || '-' ||
    CAST(p_partkey * 900 + 100 AS STRING) || ':-' END AS places FROM {part}"""


@query(
    "j05_lift_ids",
    """WITH q AS (SELECT ord, l_partkey AS id FROM {ranked} UNION ALL SELECT ord, l_partkey + 1 FROM {ranked} UNION ALL SELECT ord, l_suppkey FROM {ranked}),
       p AS (SELECT p_partkey AS id, 'chr' || CAST(p_size % 3 AS STRING) AS chrom, p_partkey * 700 AS s, p_partkey * 700 + p_size * 10 AS e FROM {part} WHERE p_size % 7 <> 0
         UNION ALL SELECT p_partkey, 'chr1', p_partkey * 900, p_partkey * 900 + 100 FROM {part} WHERE p_size % 7 <> 0),
       x AS (SELECT ord, chrom, s, e, MAX(e) OVER (PARTITION BY ord, chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM q JOIN p ON q.id = p.id),
       y AS (SELECT *, SUM(CASE WHEN reach IS NULL OR s - reach > 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY ord, chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM x)
       SELECT ord, chrom, MIN(s) AS start, MAX(e) AS stop FROM y GROUP BY ord, chrom, g""",
)
def lift_ids(t):
    """A-06: ids to regions, merged where gaps are at most 1000."""
    asked = t.sql(
        "SELECT ord, CAST(l_partkey AS STRING) || ':' || CAST(l_partkey + 1 AS STRING) || ':' || CAST(l_suppkey AS STRING) AS ids FROM {ranked}"
    )
    return transfer.lift_ids(asked, t.sql(PLACES)).select("ord", "chrom", "start", F.col("end").alias("stop"))


LINKS = "SELECT 'S|' || CAST(s_suppkey AS STRING) || ':S|' || CAST(s_suppkey + 1 AS STRING) AS cluster, s_acctbal + 10000 AS length FROM {supplier} WHERE s_suppkey % 4 = 0"


@query(
    "j06_rename_by_cluster",
    """WITH m AS (SELECT 'S|' || CAST(s_suppkey AS STRING) AS member, 'S|' || CAST(s_suppkey AS STRING) || '.J' AS name, s_acctbal + 10000 AS len FROM {supplier} WHERE s_suppkey % 4 = 0
         UNION ALL SELECT 'S|' || CAST(s_suppkey + 1 AS STRING), 'S|' || CAST(s_suppkey AS STRING) || '.J', s_acctbal + 10000 FROM {supplier} WHERE s_suppkey % 4 = 0)
       SELECT coalesce(name, feature) AS feature, coalesce(len, flen) AS flen, lin FROM {assign} LEFT JOIN m ON member = feature""",
)
def rename_by_cluster(t):
    return transfer.rename_by_cluster(t["assign"], t.sql(LINKS)).select("feature", "flen", "lin")


@query(
    "j07_residual_alignments",
    """WITH b AS (SELECT read FROM {assign} WHERE mm_total >= 2 AND stage = 0 GROUP BY read HAVING COUNT(DISTINCT mm_index) < MAX(mm_total))
       SELECT lin, read, mm_index FROM {assign} WHERE read IN (SELECT read FROM b)""",
)
def residual_alignments(t):
    body = t["assign"].filter("stage = 0")
    return transfer.residual_alignments(t["assign"], body).select("lin", "read", "mm_index")


@query(
    "j07_residual_missing_only",
    """WITH b AS (SELECT read FROM {assign} WHERE mm_total >= 2 AND stage = 0 GROUP BY read HAVING COUNT(DISTINCT mm_index) < MAX(mm_total))
       SELECT lin, read, mm_index FROM {assign} a WHERE read IN (SELECT read FROM b) AND NOT EXISTS
         (SELECT 1 FROM {assign} d WHERE d.stage = 0 AND d.read = a.read AND d.mm_index = a.mm_index)""",
)
def residual_missing_only(t):
    body = t["assign"].filter("stage = 0")
    return transfer.residual_alignments(t["assign"], body, only_missing=True).select("lin", "read", "mm_index")


@query("j08_mate_pairs", "SELECT pair, read, path1, path2 FROM {gaf_pairs}")
def mate_pairs(t):
    gaf = text.parse_gaf(t["gaf_lines"], ["ordinal"])
    return extract.pair_lines(gaf).select("pair", F.col("read1").alias("read"), "path1", "path2")


@query(
    "j09_pair_support",
    """WITH c AS (SELECT DISTINCT a.feature AS f1, b.feature AS f2 FROM {supplier_spans} a JOIN {supplier_spans} b ON a.hap = b.hap AND a.dir = b.dir AND a.feature < b.feature
           AND a.start <= b.stop + 2000 AND b.start <= a.stop + 2000),
         m AS (SELECT DISTINCT feature, sample, read, mm_total, mm_index FROM {assign})
       SELECT f1, f2, x.sample, COUNT(*) AS reads FROM c JOIN m x ON x.feature = f1 JOIN m y ON y.feature = f2 AND x.sample = y.sample AND x.read = y.read
         AND x.mm_total = y.mm_total AND x.mm_index = y.mm_index GROUP BY f1, f2, x.sample""",
)
def pair_support(t):
    near = clusters.colocated_pairs(_supplier_spans(t), 2000, 1e18)
    return clusters.pair_support(t["assign"], near)


def _supplier_spans(t):
    return t["supplier_spans"].select("feature", "hap", "start", F.col("stop").alias("end"), "dir")


COLOCATED = """SELECT a.feature AS f1, b.feature AS f2, a.hap, CASE WHEN a.stop < b.start THEN b.start - a.stop WHEN b.stop < a.start THEN a.start - b.stop ELSE 1 END AS dist,
    a.stop - a.start + 1 AS g1, b.stop - b.start + 1 AS g2 FROM {supplier_spans} a JOIN {supplier_spans} b ON a.hap = b.hap AND a.dir = b.dir AND a.feature < b.feature"""


@query(
    "j12_colocated_pairs",
    f"SELECT f1, f2, hap, dist FROM ({COLOCATED}) x WHERE dist <= 2000 AND NOT (dist * 1.0 / g1 > 5 AND dist * 1.0 / g2 > 5)",
)
def colocated_pairs(t):
    return clusters.colocated_pairs(_supplier_spans(t)).select("f1", "f2", "hap", "dist")


@query(
    "a11_colocation_median",
    f"""SELECT f1, f2, COUNT(DISTINCT hap) AS haps, list_sort(list(dist))[len(list(dist)) // 2 + 1] AS median_dist FROM ({COLOCATED}) x
        WHERE dist <= 2000 AND NOT (dist * 1.0 / g1 > 5 AND dist * 1.0 / g2 > 5) GROUP BY f1, f2""",
)
def colocation_median(t):
    return clusters.colocation_support(clusters.colocated_pairs(_supplier_spans(t)))


@query(
    "j10_full_outer",
    """WITH a AS (SELECT l_suppkey AS transcript, l_returnflag AS sample, COUNT(*) AS truth FROM {lineitem} WHERE l_linestatus = 'O' GROUP BY ALL),
         b AS (SELECT l_suppkey AS transcript, l_returnflag AS sample, SUM(l_linenumber) AS estimate FROM {lineitem} WHERE l_linestatus = 'F' GROUP BY ALL)
       SELECT coalesce(a.transcript, b.transcript) AS transcript, coalesce(a.sample, b.sample) AS sample, coalesce(truth, 0) AS truth, coalesce(estimate, 0) AS estimate
       FROM a FULL JOIN b ON a.transcript = b.transcript AND a.sample = b.sample""",
    longs=("estimate",),
)
def full_outer(t):
    """P-22: missing counts become zero."""
    li = t["lineitem"].select(F.col("l_suppkey").alias("transcript"), F.col("l_returnflag").alias("sample"), "*")
    a = li.filter("l_linestatus = 'O'").groupBy("transcript", "sample").agg(F.count(F.lit(1)).alias("truth"))
    b = li.filter("l_linestatus = 'F'").groupBy("transcript", "sample").agg(F.sum("l_linenumber").alias("estimate"))
    return evaluate.compare(a, b, ["transcript", "sample"])


@query(
    "j11_flank_fetch",
    """SELECT ord, l_suppkey AS feature, s_name FROM {ranked} JOIN {supplier} ON l_suppkey = s_suppkey""",
)
def flank_fetch(t):
    """P-13: flank rows carry a composite id whose ordinal names the feature they belong to."""
    flank = t["ranked"].select(
        "ord", F.concat_ws("|", F.lit("S"), F.lit("x"), "l_suppkey").alias("gene")
    )
    keyed = flank.select("ord", ev.feature_parts(F.col("gene"))["ordinal"].alias("feature"))
    named = t["supplier"].select(F.col("s_suppkey").alias("feature"), "s_name")
    return keyed.join(named, "feature")


DUP_BASE = "SELECT alignment AS aln, read, score, ln, n FROM {alignments}"


@query(
    "j13_duplicates",
    """WITH RECURSIVE a AS (SELECT aln, read, score, ln, row_number() OVER (PARTITION BY read ORDER BY score DESC, aln) AS rk FROM (SELECT alignment AS aln, read, score, ln FROM {alignments}) z),
        d AS (SELECT x.read, x.rk, list(y.rk) AS better FROM a x JOIN a y ON x.read = y.read AND y.rk < x.rk AND x.ln = y.ln
              AND (60 - greatest(x.score, y.score)) + 40 > 80 GROUP BY x.read, x.rk),
        k AS (SELECT read, CAST(1 AS BIGINT) AS rk, [CAST(1 AS BIGINT)] AS kept FROM a WHERE rk = 1
              UNION ALL SELECT k.read, k.rk + 1, CASE WHEN d.better IS NOT NULL AND list_has_any(k.kept, d.better) THEN k.kept ELSE list_append(k.kept, k.rk + 1) END
              FROM k JOIN a ON a.read = k.read AND a.rk = k.rk + 1 LEFT JOIN d ON d.read = k.read AND d.rk = k.rk + 1),
        f AS (SELECT read, arg_max(kept, rk) AS kept FROM k GROUP BY read)
       SELECT a.aln, a.read, NOT list_contains(f.kept, a.rk) AS duplicate FROM a JOIN f ON a.read = f.read""",
)
def duplicates(t):
    c = F.col
    one, length = F.lit(1), F.lit(60)
    p1 = F.array(
        _step(c("ln"), one, length, c("score"), F.lit(0)), _step(c("ln") + 20, one, length, F.lit(0), F.lit(20))
    )
    p2 = F.array(_step(c("ln") + 40, one, F.lit(100), F.lit(0), c("score") % 5))
    a = t.sql(DUP_BASE).select(
        "aln", "read", "score", p1.cast(STEPS).alias("path1"), p2.cast(STEPS).alias("path2"),
        F.lit(100).alias("len1"), F.lit(100).alias("len2"),
    )
    return dedupe.mark_duplicates(a).select("aln", "read", "duplicate")


@query(
    "j14_family_expansion",
    """WITH f AS (SELECT r_name AS name, n_name AS partner FROM {region} JOIN {nation} ON r_regionkey = n_regionkey
          UNION SELECT r_name, n_name || 'b' FROM {region} JOIN {nation} ON r_regionkey = n_regionkey)
       SELECT name, partner FROM f UNION SELECT partner, name FROM f""",
)
def family_expansion(t):
    fam = text.parse_families(
        t.sql(
            """SELECT '1' || chr(9) || r_name || '-int' || chr(9) || n_name || ',' || n_name || 'b' AS value FROM {region} JOIN {nation} ON r_regionkey = n_regionkey
               UNION ALL SELECT '#' || r_name || chr(9) || 'x-int' || chr(9) || 'y' FROM {region}"""
        )
    )
    return annotation.family_pairs(fam)


@query(
    "j15_gap_bridge",
    """WITH g AS (SELECT DISTINCT p_partkey AS j, p_partkey + p_size * 20 AS land FROM {part}), p AS (SELECT alignment AS pair, n AS lo, n + score * 15 AS hi FROM {alignments})
       SELECT pair, hi - lo < 100 OR EXISTS (SELECT 1 FROM g WHERE j > lo - 100 AND j - lo <= 100 AND abs(land - hi) + j - lo < 100) AS bridged FROM p""",
)
def gap_bridge(t):
    pairs = t["alignments"].select(
        F.col("alignment").alias("pair"), F.col("n").alias("tip1"), (F.col("n") + F.col("score") * 15).alias("tip2")
    )
    gaps = t["part"].select(F.col("p_partkey").alias("from"), (F.col("p_partkey") + F.col("p_size") * 20).alias("to"))
    return extract.bridged(pairs, gaps).select("pair", "bridged")


# ----------------------------------------------------------------- aggregations


@query(
    "a02_weighted_coverage",
    """SELECT feature, sample, round(SUM(CASE WHEN mm_total = 0 AND mm_index = 0 THEN 1.0 ELSE 1.0 / mm_total END / flen), 12) AS coverage
       FROM {assign} WHERE stage = 0 GROUP BY feature, sample""",
)
def weighted_coverage(t):
    """Twelve digits: sums such as 41 / 128 are ties of the sixth, where the order of summation would decide."""
    return transfer.feature_coverage(t["assign"]).withColumn("coverage", F.round("coverage", 12))


@query(
    "a02_plain_coverage",
    "SELECT feature, sample, round(SUM(1.0 / flen), 12) AS coverage FROM {assign} WHERE stage = 0 GROUP BY feature, sample",
)
def plain_coverage(t):
    return transfer.feature_coverage(t["assign"], weighted=False).withColumn("coverage", F.round("coverage", 12))


@query(
    "a03_support_filter",
    """SELECT l_partkey AS feature FROM {lineitem} GROUP BY l_partkey HAVING COUNT(*) >= 20 AND COUNT(DISTINCT l_discount) >= 10""",
)
def support_filter(t):
    rows = t["lineitem"].select(F.col("l_partkey").alias("feature"), "l_discount")
    return growth.supported(rows, "feature", "l_discount", 10)


MOVES = """SELECT l_partkey * 10 + l_linenumber AS source, 'T' || CAST(l_suppkey AS STRING) AS target, (l_partkey * 10 + l_linenumber) % 9 AS count,
    CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS overlap FROM {lineitem}"""


@query(
    "a04_first_target",
    f"""WITH b AS (SELECT source, MIN(CASE WHEN coalesce(overlap, 0) <> 0 THEN target END) AS target, MAX(count) AS count FROM ({MOVES}) m GROUP BY source)
        SELECT coalesce(target, '__' || CAST(source AS STRING)) AS target, SUM(count) AS count, COUNT(*) AS sources FROM b GROUP BY 1 HAVING SUM(count) <> 0 OR starts_with(coalesce(MIN(target), '__'), '__')""",
    longs=("count",),
)
def first_target(t):
    return transfer.target_counts(transfer.first_target(t.sql(MOVES)))


@query(
    "a05_largest_target",
    f"""WITH r AS (SELECT source, target, count, row_number() OVER (PARTITION BY source ORDER BY coalesce(overlap, 0) DESC, target) AS k FROM ({MOVES}) m WHERE count <> 0)
        SELECT target, SUM(count) AS count, COUNT(*) AS sources FROM r WHERE k = 1 GROUP BY target""",
    longs=("count",),
)
def largest_target(t):
    """S-06: the best target by overlap."""
    return transfer.target_counts(transfer.largest_target(t.sql(MOVES)))


ISLANDS = """SELECT *, SUM(CASE WHEN reach IS NULL OR s > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e, rid ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, MAX(e) OVER (PARTITION BY chrom ORDER BY s, e, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans) x"""


@query(
    "a06_merge_regions",
    f"SELECT chrom, MIN(s) AS island_start, MAX(e) AS island_end, COUNT(*) AS members FROM ({ISLANDS.replace('{gap}', '3').replace('spans', '{spans}')}) y GROUP BY chrom, g",
)
def merge_regions(t):
    return intervals.merged_spans(t["spans"], ["chrom"], "s", "e", 3, tile_width=256)


@query(
    "w06_islands",
    f"""SELECT rid, chrom, MIN(s) OVER (PARTITION BY chrom, g) AS island_start FROM ({ISLANDS.replace('{gap}', '0').replace('spans', '{spans}')}) y""",
)
def islands(t):
    return intervals.with_islands(t["spans"], ["chrom"], "s", "e", 0, tile_width=256).select("rid", "chrom", "island_start")


@query(
    "a07_id_ranges",
    """WITH d AS (SELECT DISTINCT l_suppkey, l_partkey FROM {lineitem}), x AS (SELECT *, l_partkey - lag(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS step FROM d),
        y AS (SELECT *, SUM(CASE WHEN step IS NULL OR step >= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS g FROM x)
       SELECT l_suppkey, MIN(l_partkey) - 1 AS range_start, MAX(l_partkey) AS range_end FROM y GROUP BY l_suppkey, g""",
)
def id_ranges(t):
    return intervals.id_ranges(t["lineitem"], ["l_suppkey"], "l_partkey", 10, tile_width=256)


DEPTH = """SELECT chrom, pos AS a, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS b, SUM(d) OVER (PARTITION BY chrom ORDER BY pos) AS depth FROM (
    SELECT chrom, pos, SUM(d) AS d FROM (SELECT chrom, s AS pos, 1 AS d FROM {spans} UNION ALL SELECT chrom, e, -1 FROM {spans}) v GROUP BY chrom, pos) w"""


@query(
    "a09_pileup",
    f"""SELECT chrom, SUM(CASE WHEN depth > 0 THEN b - a ELSE 0 END) AS covered, SUM((b - a) * depth) AS total_depth, MAX(depth) AS peak_depth
        FROM ({DEPTH}) x WHERE b IS NOT NULL GROUP BY chrom""",
    longs=("total_depth", "peak_depth", "covered"),
)
def pileup(t):
    return intervals.pileup_totals(t["spans"], ["chrom"], "s", "e")


@query(
    "a09_feature_pileup",
    f"""WITH w AS ({WINDOWS}), m AS (SELECT CAST(w.chrom AS STRING) || '-' || CAST(feature AS STRING) AS fid, rid, greatest(s, fs) AS a, least(e, fe) AS b FROM {{spans}} JOIN w ON spans.chrom = w.chrom AND s < fe AND fs < e),
        ev AS (SELECT fid, pos, SUM(d) AS d FROM (SELECT fid, a AS pos, 1 AS d FROM m UNION ALL SELECT fid, b, -1 FROM m) v GROUP BY fid, pos),
        sg AS (SELECT fid, lead(pos) OVER (PARTITION BY fid ORDER BY pos) - pos AS len, SUM(d) OVER (PARTITION BY fid ORDER BY pos) AS depth FROM ev)
        SELECT x.fid, covered, total_depth, peak_depth, reads FROM (SELECT fid, SUM(CASE WHEN depth > 0 THEN len ELSE 0 END) AS covered, SUM(len * depth) AS total_depth, MAX(depth) AS peak_depth
          FROM sg WHERE len IS NOT NULL GROUP BY fid) x JOIN (SELECT fid, COUNT(DISTINCT rid) AS reads FROM m GROUP BY fid) y ON x.fid = y.fid""",
    longs=("total_depth", "peak_depth", "covered"),
)
def feature_pileup(t):
    feats = t.sql(WINDOWS).withColumn("fid", F.concat_ws("-", "chrom", "feature"))
    return intervals.feature_pileup(t["spans"], feats, ["chrom"], ("s", "e"), ("fs", "fe"), "rid", "fid")


@query(
    "a10_depth_cap",
    f"""WITH x AS ({DEPTH}) SELECT rid, EXISTS (SELECT 1 FROM x WHERE x.chrom = spans.chrom AND depth > 12 AND a < e AND s < b) AS too_deep FROM {{spans}}""",
)
def depth_cap(t):
    return intervals.over_depth(t["spans"], ["chrom"], "s", "e", 12, tile_width=256).select("rid", "too_deep")


@query(
    "a11_medians",
    """SELECT l_suppkey, median(l_extendedprice) AS mid, list_sort(list(l_extendedprice))[len(list(l_extendedprice)) // 2 + 1] AS upper_mid FROM {lineitem} GROUP BY l_suppkey""",
)
def medians(t):
    return quantiles(t["lineitem"], ["l_suppkey"], "l_extendedprice", {"mid": 0.5, "upper_mid": None})


@query(
    "a12_interval_union",
    f"SELECT chrom, MIN(s) AS s, MAX(e) AS e FROM ({ISLANDS.replace('{gap}', '0').replace('spans', '{spans}')}) y GROUP BY chrom, g",
)
def interval_union(t):
    return growth.union_spans(t["spans"], ["chrom"])


@query(
    "a13_direction_vote",
    """SELECT n, CASE WHEN rev IS NULL THEN 1 WHEN fwd IS NULL THEN -1 WHEN rev > 2 * fwd THEN -1 WHEN fwd > 2 * rev THEN 1 ELSE 0 END AS vote FROM (
       SELECT n, SUM(CASE WHEN dir > 0 THEN score END) AS fwd, SUM(CASE WHEN dir < 0 THEN score END) AS rev FROM {alignments} GROUP BY n) v""",
)
def direction_vote(t):
    return growth.direction_vote(t["alignments"].select("n", "dir", F.col("score").alias("c")), ["n"])


@query(
    "a14_multimap_numbers",
    """SELECT pair, CASE WHEN total > 1 THEN total ELSE 0 END AS mm_total, CASE WHEN total > 1 THEN total - k + 1 ELSE 0 END AS mm_index,
        CASE WHEN total > 1 THEN CAST(total AS STRING) || repeat('-1', CAST(k - 1 AS INT)) ELSE '0' END AS mark
       FROM (SELECT alignment AS pair, COUNT(*) OVER (PARTITION BY read) AS total, row_number() OVER (PARTITION BY read ORDER BY alignment) AS k FROM {alignments}) x""",
)
def multimap_numbers(t):
    """W-05 and W-08: ordinals and marks of the alignments of a read."""
    rows = t["alignments"].select(F.col("alignment").alias("pair"), "read")
    return complete.numbered_alignments(rows).select("pair", "mm_total", "mm_index", complete.mark_text().alias("mark"))


WALK_STEPS = """SELECT CAST(n * dir AS BIGINT) AS a, CAST((n + score) * dir * (CASE WHEN ln = 3 THEN -1 ELSE 1 END) AS BIGINT) AS b FROM {alignments}
    UNION ALL SELECT (n + score) * dir * (CASE WHEN ln = 3 THEN -1 ELSE 1 END), CAST(n + ln AS BIGINT) FROM {alignments}"""


def _walks(t):
    c = F.col
    middle = (c("n") + c("score")) * c("dir") * F.when(c("ln") == 3, -1).otherwise(1)
    return t["alignments"].select(
        c("rf").alias("hap"),
        F.array((c("n") * c("dir")).cast("long"), middle.cast("long"), (c("n") + c("ln")).cast("long")).alias("path"),
    )


@query(
    "a15_neighbour_sets",
    f"""WITH w AS ({WALK_STEPS}), x AS (SELECT abs(a) AS node, sign(a) AS side, b * sign(a) AS nbr FROM w UNION SELECT abs(b), -sign(b), a * sign(b) FROM w)
        SELECT node, string_agg(CASE WHEN side = -1 THEN CAST(CAST(nbr AS BIGINT) AS STRING) END, ';' ORDER BY abs(nbr), nbr) AS before,
          string_agg(CASE WHEN side = 1 THEN CAST(CAST(nbr AS BIGINT) AS STRING) END, ';' ORDER BY abs(nbr), nbr) AS after, MAX(coalesce(len, 1)) AS len
        FROM x LEFT JOIN {{node_len}} USING (node) GROUP BY node""",
)
def neighbour_sets(t):
    """W-01: previous and next node of every walk step, as distinct signed sets."""
    edges = graphprep.neighbours(graphprep.walk_steps(_walks(t), []))
    return graphprep.neighbour_lists(edges, t["node_len"]).select("node", "before", "after", "len")


@query(
    "a17_pearson",
    """SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, COUNT(*) AS n FROM {lineitem} GROUP BY l_returnflag""",
)
def pearson(t):
    return evaluate.pearson(t["lineitem"], "l_quantity", "l_extendedprice", ["l_returnflag"]).withColumn("r", F.round("r", 6))


@query(
    "a18_wide",
    """SELECT l_suppkey, MAX(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS "A", MAX(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS "N",
        MAX(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS "R" FROM {lineitem} GROUP BY l_suppkey""",
)
def wide(t):
    return evaluate.wide_by(t["lineitem"], "l_suppkey", "l_returnflag", "l_quantity", ["A", "N", "R"])


@query(
    "a18_long",
    """SELECT o_orderkey, 'price' AS name, o_totalprice AS value FROM {orders} UNION ALL SELECT o_orderkey, 'customer', CAST(o_custkey AS DOUBLE) FROM {orders}""",
)
def long_form(t):
    rows = t["orders"].select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("customer"))
    return evaluate.long_by(rows, ["o_orderkey"], ["price", "customer"], "name", "value")


@query(
    "a19_box_stats",
    """SELECT bin, MIN(estimate) AS low, round(quantile_cont(estimate, 0.25), 6) AS q1, round(quantile_cont(estimate, 0.5), 6) AS q2, round(quantile_cont(estimate, 0.75), 6) AS q3,
        MAX(estimate) AS high, COUNT(estimate) AS n FROM (SELECT CASE WHEN l_quantity > 0 THEN CAST(ceil(l_quantity / 8) AS BIGINT) END AS bin, l_extendedprice AS estimate FROM {lineitem}) x GROUP BY bin""",
)
def box_stats(t):
    out = evaluate.binned_box_stats(t["lineitem"], "l_quantity", "l_extendedprice", 8.0)
    return out.withColumns({q: F.round(q, 6) for q in ("q1", "q2", "q3")})


@query(
    "a19_histogram",
    """WITH e AS (SELECT MIN(o_custkey) AS lo, MAX(o_custkey) AS hi FROM {orders})
       SELECT CAST(least(floor((o_custkey - lo) / ((hi - lo) / 100.0)), 99) AS BIGINT) + 1 AS bin, COUNT(*) AS n FROM {orders}, e GROUP BY 1""",
)
def histogram(t):
    return evaluate.histogram(t["orders"], "o_custkey", 100)


@query(
    "a19_null_table",
    """SELECT quality IS NULL AS missing, COUNT(*) AS n FROM {documents} LEFT JOIN {labels} USING (doc_id) GROUP BY 1""",
)
def null_table(t):
    return evaluate.null_table(t["documents"].select("doc_id").join(t["labels"], "doc_id", "left"), "quality")


RUNS = "SELECT event_id, CAST(FLOOR(event_id / 23) AS BIGINT) AS stretch, user_id, event_type FROM {events}"


@query(
    "a20_run_cap",
    f"""WITH b AS (SELECT *, CASE WHEN lag(stretch) OVER (ORDER BY event_id) = stretch THEN 0 ELSE 1 END AS opens FROM ({RUNS}) r),
        c AS (SELECT *, SUM(opens) OVER (ORDER BY event_id) AS run FROM b),
        d AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY run, event_type ORDER BY event_id) = 1 THEN 1 ELSE 0 END AS debut FROM c),
        f AS (SELECT *, coalesce(SUM(debut) OVER (PARTITION BY run ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM d)
       SELECT event_id, event_type FROM f WHERE seen < 4""",
)
def run_cap(t):
    rows = t.sql(RUNS)
    return overlap.cap_runs(rows, ["event_id"], "stretch", "event_type", tile_of("event_id", 512)).select("event_id", "event_type")


def _reach(edges: str) -> str:
    return f"""WITH RECURSIVE e AS ({edges}), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r AS (SELECT u AS vertex, u AS c FROM b UNION SELECT b.v, r.c FROM r JOIN b ON r.vertex = b.u)
        SELECT vertex, MIN(c) AS component FROM r GROUP BY vertex"""


@query(
    "a21_repeated_links",
    _reach("SELECT least(l_suppkey, 5000 + l_partkey) AS u, greatest(l_suppkey, 5000 + l_partkey) AS v FROM {lineitem} GROUP BY 1, 2 HAVING COUNT(*) >= 3"),
)
def repeated_links(t):
    links = t["lineitem"].select(F.col("l_suppkey").alias("a"), (5000 + F.col("l_partkey")).alias("b"))
    return components.repeated_link_components(links, "a", "b", 3)


@query(
    "g07_components",
    _reach(f"SELECT DISTINCT f1 AS u, f2 AS v FROM ({COLOCATED}) x WHERE dist <= 300 AND NOT (dist * 1.0 / g1 > 5 AND dist * 1.0 / g2 > 5)"),
)
def supplier_components(t):
    near = clusters.colocated_pairs(_supplier_spans(t), 300)
    return components.connected_components(near, "f1", "f2")


@query(
    "g12_read_feature_groups",
    """WITH RECURSIVE a AS (SELECT DISTINCT 3 * CAST(floor(l_orderkey / 3.0) AS BIGINT) * 10 + l_linenumber AS feature, l_orderkey AS read FROM {lineitem}),
        e AS (SELECT DISTINCT x.feature AS u, y.feature AS v FROM a x JOIN a y USING (read)),
        r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
       SELECT u AS feature, CAST(MIN(CAST(v AS VARCHAR)) AS BIGINT) AS component FROM r GROUP BY u""",
)
def read_feature_groups(t):
    """Features joined by shared reads and the least name of their group."""
    rows = t["lineitem"].select(
        (3 * F.floor(F.col("l_orderkey") / 3) * 10 + F.col("l_linenumber")).alias("feature"), F.col("l_orderkey").alias("read")
    )
    return components.read_feature_groups(rows).select(F.col("feature").cast("long").alias("feature"), F.col("component").cast("long").alias("component"))


MEMBERS = "SELECT s_nationkey AS seed, s_suppkey AS feature FROM {supplier}"
FEATURE_NODES = "SELECT DISTINCT l_suppkey AS feature, l_partkey AS node, l_partkey % 7 AS head, l_partkey % 5 AS tail FROM {lineitem}"
NODE_HAPS = """SELECT p_partkey AS node, p_brand AS hap, p_partkey * 100 AS start, CASE WHEN p_size % 2 = 0 THEN p_partkey * 100 + 80 ELSE p_partkey * 100 - 80 END AS stop FROM {part}"""


@query(
    "a22_node_lengths",
    f"""WITH m AS ({MEMBERS}), f AS ({FEATURE_NODES}), h AS ({NODE_HAPS}), n AS (SELECT DISTINCT seed, node, head, tail FROM m JOIN f ON m.feature = f.feature),
        p AS (SELECT seed, hap, CASE WHEN stop > start THEN start + head ELSE start - head END AS a, CASE WHEN stop > start THEN stop - tail ELSE stop + tail END AS b FROM n JOIN h ON n.node = h.node),
        x AS (SELECT seed, hap, MAX(greatest(a, b)) - MIN(least(a, b)) AS extent FROM p GROUP BY seed, hap)
       SELECT seed, CAST(list_sort(list(extent))[len(list(extent)) // 2 + 1] AS DOUBLE) AS length FROM x GROUP BY seed""",
)
def node_lengths(t):
    haps = t.sql(NODE_HAPS).withColumnRenamed("stop", "end")
    return clusters.node_lengths(t.sql(MEMBERS), t.sql(FEATURE_NODES), haps)


# One cluster a row: features that wait, haplotypes in use and placed features; each step places the next one.
_SPAN = "STRUCT(h VARCHAR, s BIGINT, e BIGINT, d BIGINT)"
FRAMES = f"""WITH RECURSIVE fe AS (SELECT CAST(s_nationkey AS VARCHAR) AS seed, feature, list({{'h': hap, 's': start, 'e': stop, 'd': dir}}::{_SPAN} ORDER BY hap) AS sp, list(hap ORDER BY hap) AS haps
      FROM {{supplier_spans}} JOIN {{supplier}} ON feature = 'S|' || CAST(s_suppkey AS VARCHAR) GROUP BY ALL),
    r AS (SELECT seed, list({{'f': feature, 'haps': haps, 'sp': sp}} ORDER BY feature) AS waiting, []::VARCHAR[] AS touched, []::STRUCT(low BIGINT, high BIGINT, way BIGINT, sp {_SPAN}[])[] AS frame FROM fe GROUP BY seed
      UNION ALL SELECT seed, list_filter(waiting, lambda x: x.f <> ch.f), list_distinct(list_concat(touched, ch.haps)),
          CASE WHEN len(frame) = 0 THEN [{{'low': 0, 'high': list_sort(list_transform(ch.sp, lambda q: q.e - q.s))[len(ch.sp) // 2 + 1], 'way': 1, 'sp': ch.sp}}]
            WHEN len(props) = 0 THEN frame
            ELSE list_append(frame, {{'low': list_sort(list_transform(props, lambda q: least(q.x, q.y)))[len(props) // 2 + 1], 'high': list_sort(list_transform(props, lambda q: greatest(q.x, q.y)))[len(props) // 2 + 1],
              'way': list_sort(list_transform(props, lambda q: q.w))[len(props) // 2 + 1], 'sp': ch.sp}}) END
        FROM (SELECT *, flatten(list_transform(frame, lambda y: list_transform(list_filter(y.sp, lambda b: list_contains(ch.haps, b.h)), lambda b:
              {{'x': y.low + b.d * y.way * (b.s - list_filter(ch.sp, lambda q: q.h = b.h)[1].s), 'y': y.high + b.d * y.way * (b.e - list_filter(ch.sp, lambda q: q.h = b.h)[1].e),
                'w': b.d * y.way * list_filter(ch.sp, lambda q: q.h = b.h)[1].d}}))) AS props
          FROM (SELECT r.*, list_filter(waiting, lambda x: x.f = list_sort(list_transform(waiting, lambda z: {{'c': -len(list_intersect(z.haps, touched)), 'h': -len(z.haps), 'f': z.f}}))[1].f)[1] AS ch
            FROM r WHERE len(waiting) > 0) a) c)
    SELECT seed, CAST(list_max(list_transform(frame, lambda q: q.high)) - list_min(list_transform(frame, lambda q: q.low)) + 1 AS DOUBLE) AS length FROM r WHERE len(waiting) = 0"""


@query("a23_frame_lengths", FRAMES)
def frame_lengths(t):
    """Features of a cluster placed one after the other in a common frame."""
    spans = _supplier_spans(t)
    members = t["supplier"].select(
        F.col("s_nationkey").cast("string").alias("seed"), F.concat(F.lit("S|"), F.col("s_suppkey")).alias("feature")
    )
    return clusters.frame_lengths(members.join(spans, "feature"))


BED = """SELECT ord AS ordinal, 'c' || CAST(l_suppkey % 5 AS STRING) AS chrom, l_partkey * 40 AS s, l_partkey * 40 + CAST(l_quantity AS BIGINT) * 20 AS e,
    CASE WHEN l_returnflag = 'N' THEN 'grp|F' || CAST(l_linenumber AS STRING) || '-int#x' WHEN l_returnflag = 'A' THEN 'LTR' || CAST(l_linenumber AS STRING) ELSE 'G' || CAST(l_linenumber AS STRING) END AS name,
    CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, CASE WHEN l_linenumber = 7 THEN 'L1' ELSE 'LTR/ERVK' END AS class, l_partkey AS element FROM {ranked}"""


@query(
    "a24_repeat_elements",
    f"""WITH r AS (SELECT *, CASE WHEN name LIKE '%-int%' THEN 'INT' WHEN name LIKE '%LTR%' THEN 'LTR' ELSE 'Other' END AS kind,
          replace(replace(replace(name, 'grp|', ''), '#x', ''), '-int', '') AS base FROM ({BED}) b WHERE class LIKE '%ERVK%')
        SELECT element, coalesce(arg_max(base, ordinal) FILTER (kind = 'INT'), arg_min(base, ordinal)) AS name, SUM(e - s) AS length, arg_max(chrom, ordinal) AS chrom, arg_min(s, ordinal) AS start,
          arg_max(e, ordinal) AS stop, arg_max(strand, ordinal) AS strand, CASE WHEN COUNT(*) FILTER (kind = 'INT') > 0 AND COUNT(*) FILTER (kind = 'LTR') > 0 THEN 'STR' WHEN SUM(e - s) > 1000 THEN 'LEN' ELSE 'PART' END AS label
        FROM r GROUP BY element""",
    longs=("length",),
)
def repeat_elements(t):
    """SRC-10: whitespace BED lines rolled up to elements."""
    return _elements(t).select("element", "name", "length", "chrom", "start", F.col("end").alias("stop"), "strand", "label")


def _elements(t):
    lines = t.sql(
        f"""SELECT ordinal, chrom || ' ' || CAST(s AS STRING) || '  ' || CAST(e AS STRING) || ' ' || name || ' . ' || strand || ' grp ' || class || ' z ' || CAST(element AS STRING) AS value FROM ({BED}) b"""
    )
    return annotation.repeat_elements(text.parse_repeat_bed(lines, ["ordinal"]))


# Elements with short gaps and overlaps: insides (F) with the outsides (LTR) that belong to them, others in between.
ELEMENTS = """SELECT 'c' || CAST(p_partkey % 3 AS STRING) AS chrom, p_partkey * 150 + p_size * 4 AS start, p_partkey * 150 + p_size * 4 + 20 + p_partkey * 37 % 400 AS stop,
    CASE WHEN p_partkey % 7 IN (0, 3, 5) THEN 'F' || CAST(p_partkey % 2 AS STRING) ELSE 'LTR' || CAST(p_size % 4 AS STRING) END AS name, p_partkey AS element,
    CASE WHEN p_partkey % 7 IN (0, 3) THEN 'STR' WHEN p_partkey % 7 = 1 THEN 'LEN' ELSE 'PART' END AS label, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand FROM {part}"""
FAMILIES = """SELECT DISTINCT 'F' || CAST(p_partkey % 2 AS STRING) AS name, 'LTR' || CAST(p_partkey % 2 + p_size % 2 AS STRING) AS partner FROM {part}"""
# One element after the other: ``free`` holds those of a chromosome that are left, folded to both sides of the one that acts.
_SIDE = """list_reduce({rows}, lambda a, x: CASE WHEN NOT a.ok OR {gap} < 0 OR {gap} > 500 THEN {{'ok': false, 'edge': a.edge, 'got': a.got}}
    WHEN len(list_filter(ps, lambda p: contains(x.name, p))) > 0 THEN {{'ok': true, 'edge': {far}, 'got': list_append(a.got, x.rn)}} ELSE a END, {{'ok': true, 'edge': {own}, 'got': []::BIGINT[]}})"""
_LEFT = _SIDE.format(rows="list_reverse(list_filter(free, lambda x: x.rn < k))", gap="(a.edge - x.e)", far="x.s", own="start")
_RIGHT = _SIDE.format(rows="list_filter(free, lambda x: x.rn > k)", gap="(x.s - a.edge)", far="x.e", own="stop")
CHAINED = f"""WITH RECURSIVE fam AS ({FAMILIES}), el AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chrom ORDER BY element) AS rn FROM ({ELEMENTS}) p),
      pt AS (SELECT name, list(DISTINCT partner) AS ps FROM (SELECT * FROM fam UNION SELECT partner, name FROM fam) f GROUP BY name),
      e2 AS (SELECT el.*, coalesce(ps, []) AS ps FROM el LEFT JOIN pt USING (name)),
      r AS (SELECT chrom, CAST(0 AS BIGINT) AS k, list({{'rn': rn, 's': start, 'e': stop, 'name': name}} ORDER BY rn) AS free, false AS acts, CAST(0 AS BIGINT) AS low, CAST(0 AS BIGINT) AS high FROM el GROUP BY chrom
        UNION ALL SELECT chrom, k, CASE WHEN acts THEN list_filter(free, lambda x: x.rn <> k AND NOT list_contains(l.got, x.rn) AND NOT list_contains(g.got, x.rn)) ELSE free END, acts, l.edge, g.edge FROM (
          SELECT *, {_LEFT} AS l, {_RIGHT} AS g FROM (SELECT r.chrom, r.k + 1 AS k, free, start, stop, ps, label <> 'PART' AND len(list_filter(free, lambda x: x.rn = r.k + 1)) > 0 AS acts
            FROM r JOIN e2 ON e2.chrom = r.chrom AND e2.rn = r.k + 1) q) z),
      chained AS (SELECT r.chrom, low AS start, high AS stop, name, element, label, strand FROM r JOIN e2 ON e2.chrom = r.chrom AND e2.rn = r.k WHERE acts)"""
_DRAWN = "CAST('0x' || substr(md5(CAST(element AS VARCHAR) || ':12345:{side}'), 1, 8) AS BIGINT) % 300"
WIDENED = f"""{CHAINED}, w AS (SELECT chrom, greatest(0, start - {_DRAWN.format(side='left')}) AS start, stop + {_DRAWN.format(side='right')} AS stop, name || ':' || CAST(element AS VARCHAR) || ':' || label AS name, strand FROM chained)"""


def _chained(t):
    both = t.sql(FAMILIES)
    both = both.union(both.select("partner", "name"))
    return annotation.chain_repeats(t.sql(ELEMENTS).withColumnRenamed("stop", "end"), both)


@query("g13_chain_repeats", f"{CHAINED} SELECT * FROM chained")
def chain_repeats(t):
    """Elements chained with compatible ones beside them, by rising id."""
    return _chained(t).withColumnRenamed("end", "stop")


@query("snk08_bed", f"{WIDENED} SELECT chrom, start, stop, name, '.' AS score, strand FROM w")
def annotation_bed(t):
    """P-26: chained elements widened by a seeded random length, as BED rows."""
    return annotation.as_bed(annotation.extended(_chained(t))).withColumnRenamed("end", "stop")


@query(
    "snk08_gtf",
    f"""{WIDENED} SELECT chrom, 'simulate' AS source, 'gene' AS feature, start, stop, '.' AS score, strand, '.' AS frame, 'gene_id "' || name || '"; locus "' || name || '"' AS attributes FROM w""",
)
def annotation_gtf(t):
    """The same elements as GTF rows."""
    return annotation.as_gtf(annotation.extended(_chained(t))).withColumnRenamed("end", "stop")


@query(
    "p26_weighted_choice",
    """WITH d AS (SELECT n, allele, SUM(depth) AS depth FROM (SELECT l_partkey AS n, l_suppkey AS allele, CASE WHEN l_partkey % 9 = 0 THEN 0 ELSE GREATEST(l_quantity - 10, 0) END AS depth FROM {lineitem}) x GROUP BY n, allele),
      u AS (SELECT *, (CAST('0x' || substr(md5('11|' || CAST(n AS VARCHAR) || '|' || CAST(allele AS VARCHAR)), 1, 8) AS BIGINT) + 0.5) / 4294967296.0 AS u FROM d),
      k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY n ORDER BY CASE WHEN depth > 0 THEN 0 ELSE 1 END, CASE WHEN depth > 0 THEN -ln(u) / depth END, allele) AS k, COUNT(*) OVER (PARTITION BY n) AS choices, SUM(depth) OVER (PARTITION BY n) AS total FROM u)
      SELECT n, allele, choices, CAST(total AS DOUBLE) AS total FROM k WHERE k = 1""",
)
def weighted_choice(t):
    """One allele per node, drawn in proportion to its depth; nodes without depth take the first."""
    depth = t.sql("SELECT l_partkey AS n, l_suppkey AS allele, SUM(CASE WHEN l_partkey % 9 = 0 THEN 0 ELSE GREATEST(l_quantity - 10, 0) END) AS depth FROM {lineitem} GROUP BY l_partkey, l_suppkey")
    return sampling.weighted_choice(depth, ["n"], "allele", "depth", seed=11)


@query(
    "a26_absorb_between",
    """WITH m AS (SELECT s_nationkey AS seed, 'S|' || CAST(s_suppkey AS STRING) AS feature FROM {supplier}), p AS (SELECT seed, hap, start, stop FROM m JOIN {supplier_spans} USING (feature)),
        x AS (SELECT *, MAX(stop) OVER (PARTITION BY seed, hap ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p),
        g AS (SELECT seed, hap, reach AS g0, start AS g1 FROM x WHERE start - reach > 50)
       SELECT seed, feature FROM m UNION SELECT seed, s.feature FROM g JOIN {supplier_spans} s ON g.hap = s.hap AND s.start <= g1 AND s.stop >= g0""",
)
def absorb_between(t):
    members = t["supplier"].select(F.col("s_nationkey").alias("seed"), F.concat(F.lit("S|"), F.col("s_suppkey")).alias("feature"))
    return clusters.absorb_between(members, _supplier_spans(t).drop("dir"))


# -------------------------------------------------------------- order-dependent


@query(
    "w02_walk_jumps",
    """SELECT rf AS hap, abs(abs(a) - abs(b)) AS dist, abs(a) AS "from", abs(b) AS "to" FROM (SELECT rf, n AS a, n + score AS b FROM {alignments} UNION ALL SELECT rf, n + score, n + ln FROM {alignments}) w
       WHERE abs(abs(a) - abs(b)) > 20""",
)
def walk_jumps(t):
    return graphprep.walk_gaps(_walks(t))


@query(
    "w03_triple_jumps",
    """WITH x AS (SELECT n AS p, n + score AS c, n + ln AS y, dir * (CASE WHEN ln = 3 THEN -1 ELSE 1 END) AS d FROM {alignments})
       SELECT c * d AS node, y AS jump FROM x WHERE y <> c + d UNION SELECT -c * d, p FROM x WHERE p <> c - d""",
)
def triple_jumps(t):
    return graphprep.triple_jumps(_walks(t))


@query(
    "w04_breaks_running",
    """SELECT chrom, reach AS break_from, s + 1 AS break_to FROM (SELECT chrom, s, MAX(e) OVER (PARTITION BY chrom ORDER BY s, e, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {spans}) x WHERE s + 1 > reach""",
)
def breaks_running(t):
    return intervals.uncovered_breaks(t["spans"], ["chrom"], "s", "e", tile_width=256)


@query(
    "w04_breaks_previous",
    """SELECT chrom, prev AS break_from, s + 1 AS break_to FROM (SELECT chrom, s, lag(e) OVER (PARTITION BY chrom ORDER BY s, e) AS prev FROM {spans}) x WHERE s + 1 > prev""",
)
def breaks_previous(t):
    return intervals.uncovered_breaks(t["spans"], ["chrom"], "s", "e", running=False, tile_width=256)


@query(
    "w09_first_assignment",
    """SELECT lin, read, mm_total, mm_index, feature FROM (SELECT *, row_number() OVER (PARTITION BY read, mm_total, mm_index ORDER BY stage, lin) AS k FROM {assign}) x WHERE k = 1""",
)
def first_assignment(t):
    return transfer.first_assignment(t["assign"], ["stage", "lin"]).select("lin", "read", "mm_total", "mm_index", "feature")


@query(
    "w10_next_read",
    """SELECT alignment, read, coalesce(lead(read) OVER (ORDER BY alignment) = read, FALSE) AS continued FROM {alignments}""",
)
def next_read(t):
    """Look-ahead: whether the next line belongs to the same read."""
    rows = t["alignments"].select("alignment", "read", (-F.col("alignment")).alias("back"))
    ahead = prefix_scan(rows, [], ["back"], tile_of("back", 1 << 14), {"next": ("previous", "read")})
    return ahead.select("alignment", "read", F.coalesce(F.col("next") == F.col("read"), F.lit(False)).alias("continued"))


@query(
    "w11_differences",
    """WITH a AS (SELECT l_suppkey AS transcript, COUNT(*) AS ecount FROM {lineitem} WHERE l_linestatus = 'O' GROUP BY 1), b AS (SELECT l_suppkey AS transcript, COUNT(*) AS ecount FROM {lineitem} WHERE l_linestatus = 'F' GROUP BY 1)
       SELECT coalesce(a.transcript, b.transcript) AS transcript, a.ecount AS ecount_x, b.ecount AS ecount_y, a.ecount - b.ecount AS diff FROM a FULL JOIN b ON a.transcript = b.transcript""",
)
def differences(t):
    li = t["lineitem"].withColumnRenamed("l_suppkey", "transcript")
    a = li.filter("l_linestatus = 'O'").groupBy("transcript").agg(F.count(F.lit(1)).alias("ecount"))
    b = li.filter("l_linestatus = 'F'").groupBy("transcript").agg(F.count(F.lit(1)).alias("ecount"))
    return evaluate.differences(a, b, ["transcript"], "ecount").orderBy(F.desc("diff"))


@query(
    "s01_sorted_head",
    "SELECT alignment, n, score FROM {alignments} ORDER BY n, ln, score DESC, alignment LIMIT 500",
)
def sorted_head(t):
    """S-05: the first rows of a mixed-direction sort."""
    return t["alignments"].orderBy("n", "ln", F.desc("score"), "alignment").limit(500).select("alignment", "n", "score")


@query(
    "s01_sorted",
    "SELECT alignment, n, score, row_number() OVER (ORDER BY n, ln, score DESC, alignment) AS place FROM {alignments}",
)
def sorted_rows(t):
    """S-01: the place of every row in a mixed-direction sort."""
    return placed(t["alignments"], ["n", "ln", F.desc("score"), "alignment"], "place").select("alignment", "n", "score", "place")


@query(
    "s03_features_by_coverage",
    """SELECT feature, round(total, 6) AS total, row_number() OVER (ORDER BY round(total, 9) DESC, CAST(substr(feature, 3) AS BIGINT)) AS place FROM (SELECT feature, SUM(1.0 / flen) AS total FROM {assign} WHERE stage = 0 GROUP BY feature) x""",
)
def features_by_coverage(t):
    """S-03, S-04: features by total coverage, ties by the number in the id."""
    total = transfer.feature_coverage(t["assign"], weighted=False).groupBy("feature").agg(F.sum("coverage").alias("total"))
    number = ev.feature_parts(F.col("feature"))["ordinal"]
    rows = total.select("feature", "total", (-F.round("total", 9)).alias("down"), number.alias("number"))
    return placed(rows, ["down", "number"], "place").select("feature", F.round("total", 6).alias("total"), "place")


@query(
    "u02_distinct_first",
    """SELECT l_suppkey, l_partkey, MIN(ord) AS ord FROM {ranked} GROUP BY l_suppkey, l_partkey""",
)
def distinct_first(t):
    rows = t["ranked"].select("l_suppkey", "l_partkey", "ord")
    return rows.groupBy("l_suppkey", "l_partkey").agg(F.min("ord").alias("ord"))


@query(
    "u06_later_value_wins",
    """SELECT l_suppkey, hap, arg_max(node, ord) AS node FROM (SELECT l_suppkey, l_returnflag || l_linestatus AS hap, l_partkey AS node, ord FROM {ranked}) x GROUP BY l_suppkey, hap""",
)
def later_value_wins(t):
    """U-06: maps of haplotype to node merged per feature; of values for one haplotype the later stays."""
    rows = t["ranked"].select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("hap"), F.col("l_partkey").alias("node"), "ord")
    return text.latest_by_key(rows, ["l_suppkey", "hap"], "ord").select("l_suppkey", "hap", "node")


@query(
    "u03_shared_haplotypes",
    """SELECT alignment, greatest(0, 3 - abs(ln - 3)) AS shared, ln BETWEEN 1 AND 5 AS touch FROM {alignments}""",
)
def shared_haplotypes(t):
    """U-03 and U-04: size of a set intersection and any-of membership."""
    ln = F.col("ln").cast("int")
    a, b = F.array(ln, ln + 1, ln + 2), F.array(F.lit(3), F.lit(4), F.lit(5))
    return t["alignments"].select(
        "alignment", F.size(F.array_intersect(a, b)).alias("shared"), F.arrays_overlap(a, b).alias("touch")
    )


HAP_ROWS = "SELECT l_partkey AS node, l_returnflag || l_linestatus || CAST(l_linenumber AS STRING) AS hap FROM {lineitem} WHERE l_quantity > 25"


@query(
    "u03_haplotype_sets",
    f"""WITH h AS (SELECT node, list(DISTINCT hap) AS haps FROM ({HAP_ROWS}) x GROUP BY node), p AS (SELECT p_partkey AS a, p_partkey + 1 AS b FROM {{part}}),
      j AS (SELECT a, b, coalesce(x.haps, []) AS x, coalesce(y.haps, []) AS y FROM p LEFT JOIN h x ON x.node = a LEFT JOIN h y ON y.node = b)
      SELECT a, b, CAST(len(list_intersect(x, y)) AS INT) AS shared, CAST(len(list_distinct(list_concat(x, y))) AS INT) AS either, list_has_any(x, y) AS touch FROM j""",
)
def haplotype_sets(t):
    """U-03, U-04: haplotypes that a node shares with the next one."""
    sets = graphprep.haplotype_sets(t.sql(HAP_ROWS), "node", "hap")
    pairs = t["part"].select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"))
    return graphprep.shared_haplotypes(pairs, sets, "a", "b", "node")


@query(
    "snk05_file_groups",
    """WITH i AS (SELECT *, SUM(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (ORDER BY s, e, rid ROWS UNBOUNDED PRECEDING) AS g FROM (
          SELECT rid, s, e, MAX(e) OVER (ORDER BY s, e, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT rid, (rid * 37) % 9973 * 40 AS s, (rid * 37) % 9973 * 40 + 25 AS e FROM {spans}) z) x),
        b AS (SELECT g, MIN(s) AS s, MAX(e) AS e, COUNT(*) AS n FROM i GROUP BY g), c AS (SELECT *, lag(e) OVER (ORDER BY g) AS prev, coalesce(SUM(n) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
        d AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM {part} WHERE p_partkey * 113 > prev AND p_partkey * 113 <= s) THEN CAST(floor(before / 500.0) AS BIGINT) END AS blk FROM c),
        f AS (SELECT *, coalesce(MAX(blk) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM d),
        h AS (SELECT g, 1 + SUM(CASE WHEN blk > seen THEN 1 ELSE 0 END) OVER (ORDER BY g) AS file_group FROM f)
       SELECT rid, file_group FROM i JOIN h ON i.g = h.g""",
    longs=("file_group",),
)
def file_groups(t):
    rows = t.sql("SELECT rid, (rid * 37) % 9973 * 40 AS s, (rid * 37) % 9973 * 40 + 25 AS e FROM {spans}")
    spacers = t["part"].select((F.col("p_partkey") * 113).alias("id"))
    return sinks.file_groups(rows, "s", "e", spacers, 500, tile_width=4096).select("rid", "file_group")
