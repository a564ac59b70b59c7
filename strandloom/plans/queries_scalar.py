"""Queries for sources, projections, predicates and per-row path functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import evidence as ev
from strandloom.functions import paths as pt
from strandloom.operators import em, extract, graphprep
from strandloom.plans.registry import query
from strandloom.sources import sinks, text

# --------------------------------------------------------------------- sources


@query(
    "src01_gaf_scan",
    """SELECT pair * 2 AS ordinal, read, 100 AS read_len, path1 AS path, CAST(score AS STRING) AS as_tag,
         ':' || CAST(match1 - 30 AS STRING) || '*at:30' AS cs_tag, '0.0' || CAST(ln AS STRING) AS dv_tag FROM {gaf_pairs}
       UNION ALL SELECT pair * 2 + 1, read, 100, path2, CAST(score + ln AS STRING),
         ':' || CAST(match2 - 20 AS STRING) || '-ac:20', NULL FROM {gaf_pairs}""",
    longs=("read_len",),
)
def gaf_scan(t):
    rows = text.parse_gaf(t["gaf_lines"], ["ordinal"])
    return rows.select(
        "ordinal", "read", "read_len", "path", rows["tags"]["AS"].alias("as_tag"),
        rows["tags"]["cs"].alias("cs_tag"), rows["tags"]["dv"].alias("dv_tag"),
    )


GFA_LINES = """SELECT 'S' || chr(9) || CAST(p_partkey AS STRING) || chr(9) || repeat('A', p_size) AS value FROM {part}
    UNION ALL SELECT 'W' || chr(9) || 'smp' || CAST(read % 5 AS STRING) || chr(9) || CAST(ln AS STRING) || chr(9) || 'chr1' || chr(9) || '0' || chr(9) ||
      CAST(score AS STRING) || chr(9) || path1 || path2 FROM (SELECT alignment, read, ln, score, g.path1, g.path2
        FROM {alignments} JOIN (SELECT pair, path1, path2 FROM {gaf_pairs}) g ON alignment = pair) w"""


@query(
    "src02_gfa_segments",
    "SELECT p_partkey AS node, CAST(p_size AS BIGINT) AS len FROM {part} WHERE p_size > 1",
)
def gfa_segments(t):
    return graphprep.node_lengths(text.parse_segments(t.sql(GFA_LINES)))


@query(
    "src02_gfa_walks",
    """SELECT 'smp' || CAST(read % 5 AS STRING) AS sample, CAST(ln AS STRING) AS hap, CAST(score AS BIGINT) AS stop,
         replace(replace(substr(replace(g.path1 || replace(g.path2, '*', ''), '<', ',-'), 1), '>', ','), '|', '') AS walk
       FROM {alignments} JOIN {gaf_pairs} g ON alignment = pair""".replace("g.pair", "pair").replace("read % 5", "alignments.read % 5")
    .replace("CAST(ln", "CAST(alignments.ln").replace("CAST(score", "CAST(alignments.score"),
)
def gfa_walks(t):
    walks = text.parse_walks(t.sql(GFA_LINES))
    return walks.select(
        "sample", "hap", F.col("end").alias("stop"),
        F.concat(F.lit(","), F.array_join(F.transform("path", lambda n: n.cast("string")), ",")).alias("walk"),
    )


INTERVAL_LINES = """SELECT 'c' || CAST(chrom AS STRING) || chr(9) || CAST(s AS STRING) || chr(9) || CAST(e AS STRING) || chr(9) || 'x' || chr(9) ||
    CASE WHEN s % 3 = 0 THEN '.' ELSE 'f' || CAST(rid AS STRING) END AS value FROM {spans}"""


@query(
    "src03_interval_scan",
    """SELECT 'c' || CAST(chrom AS STRING) AS chrom, s AS start, e AS stop,
       CASE WHEN s % 3 = 0 THEN NULL ELSE 'f' || CAST(rid AS STRING) END AS feature FROM {spans}""",
)
def interval_scan(t):
    rows = text.parse_intervals(t.sql(INTERVAL_LINES))
    return rows.select(
        "chrom", "start", F.col("end").alias("stop"), F.nullif(F.element_at("rest", -1), F.lit(".")).alias("feature")
    )


SHEET_LINES = """SELECT CASE WHEN n_regionkey = 0 THEN '#' ELSE '' END || n_name || chr(9) || CAST(n_nationkey * 10 + 300 AS STRING) AS value FROM {nation}
    UNION ALL SELECT '#' || c_name || chr(9) || '0' FROM {customer}"""


@query(
    "src05_sample_sheet",
    "SELECT n_name AS sample, CAST(n_nationkey * 10 + 300 AS BIGINT) AS fragment_len FROM {nation} WHERE n_regionkey <> 0",
)
def sample_sheet(t):
    return text.parse_samples(t.sql(SHEET_LINES))


@query(
    "src07_latest_by_key",
    """SELECT l_partkey AS node, arg_max(l_orderkey, ord) AS nbr FROM {ranked} GROUP BY l_partkey""",
)
def latest_by_key(t):
    rows = t["ranked"].select(F.col("l_partkey").alias("node"), F.col("l_orderkey").alias("nbr"), "ord")
    return text.latest_by_key(rows, ["node"], "ord").select("node", "nbr")


@query(
    "src09_sam_clean",
    """SELECT 'r' || CAST(read AS STRING) || chr(9) || 'chr' || CAST(ln AS STRING) || CASE WHEN rf = 'A' THEN '' ELSE chr(9) || 'AS:i:' || CAST(score AS STRING) END AS line
       FROM {alignments} WHERE rf <> 'A' AND ls <> 'F'""",
)
def sam_clean(t):
    raw = t.sql(
        """SELECT 'r' || CAST(read AS STRING) || chr(9) || CASE WHEN ls = 'F' THEN 'CHM13#0#' ELSE 'GRCh38#0#' END || 'chr' || CAST(ln AS STRING) ||
           CASE WHEN rf = 'A' THEN '' ELSE chr(9) || 'AS:i:' || CAST(score AS STRING) END AS value FROM {alignments}"""
    )
    return text.clean_sam(raw).select(F.col("value").alias("line"))


@query(
    "src11_tagged_union",
    """SELECT 'Batch' || l_returnflag || '.' || l_linestatus AS sample, CAST(l_suppkey AS STRING) AS transcript, SUM(l_quantity) AS ecount
       FROM {lineitem} GROUP BY l_returnflag, l_linestatus, l_suppkey HAVING SUM(l_quantity) > 0""",
)
def tagged_union(t):
    """Per-batch counts labelled with their sample, in one aggregate."""
    sample = F.concat(F.lit("Batch"), "l_returnflag", F.lit("."), "l_linestatus").alias("sample")
    transcript = F.col("l_suppkey").cast("string").alias("transcript")
    return t["lineitem"].groupBy(sample, transcript).agg(F.sum("l_quantity").alias("ecount")).filter("ecount > 0")


@query(
    "src12_matrix_column",
    "SELECT c_custkey AS id, c_mktsegment AS places FROM {customer}",
)
def matrix_column(t):
    return text.matrix_column(t["customer"], "segment:4")


# ----------------------------------------------------------------------- sinks


@query(
    "snk01_two_way_route",
    """SELECT chrom, s, e, CASE WHEN s % 3 = 0 THEN 'miss' ELSE 'hit' END AS side FROM {spans}""",
)
def two_way_route(t):
    rows = t.sql("SELECT chrom, s, e, CASE WHEN s % 3 = 0 THEN '.' ELSE CAST(rid + 1 AS STRING) END AS last FROM {spans}")
    return rows.select("chrom", "s", "e", F.when(sinks.has_annotation("last"), "hit").otherwise("miss").alias("side"))


@query(
    "snk02_known_samples",
    """SELECT o_orderkey, o_orderpriority AS sample FROM {orders} WHERE o_custkey IN
       (SELECT c_custkey FROM {customer} WHERE c_acctbal > 0)""",
)
def known_samples(t):
    listed = t["customer"].filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("sample"))
    rows = t["orders"].select("o_orderkey", F.col("o_custkey").cast("string").alias("sample"), "o_orderpriority")
    return sinks.known_samples(rows, listed).select("o_orderkey", F.col("o_orderpriority").alias("sample"))


@query(
    "snk04_reject_reasons",
    """SELECT pair, CASE WHEN path2 = '*' THEN '(2:U)'
         WHEN 104.0 / (100 + ln * 3) < 0.9 AND 112.0 / 100 < 0.9 THEN '(1:T)(2:T)' WHEN 104.0 / (100 + ln * 3) < 0.9 THEN '(1:T)'
         ELSE CASE WHEN match1 * 1.0 / (100 + ln * 3) < 0.8 THEN '(1:D)' ELSE '' END || CASE WHEN match2 / 100.0 < 0.8 THEN '(2:D)' ELSE '' END END AS reasons
       FROM {gaf_pairs}""",
)
def reject_reasons(t):
    both = t.sql(
        """SELECT pair, path1, path2, 104 AS path_len1, 112 AS path_len2, 100 + ln * 3 AS read_len1, 100 AS read_len2,
           ':' || CAST(match1 - 30 AS STRING) || '*at:30' AS cs1, ':' || CAST(match2 - 20 AS STRING) || '-ac:20' AS cs2 FROM {gaf_pairs}"""
    )
    return extract.mate_reasons(both).select("pair", F.array_join("reasons", "").alias("reasons"))


@query(
    "snk07_decision_counts",
    """SELECT decision, COUNT(*) AS n FROM (SELECT CASE WHEN path2 = '*' OR match1 < 90 THEN 'D' WHEN ln <= 4 THEN 'O' ELSE 'G' END AS decision FROM {gaf_pairs}) d
       GROUP BY decision""",
)
def decision_counts(t):
    g = t["gaf_pairs"]
    decided = g.withColumn(
        "decision",
        F.when((F.col("path2") == "*") | (F.col("match1") < 90), "D").when(
            pt.suffix_prefix(pt.signed_nodes(F.col("path1")), pt.opposite_strand(pt.signed_nodes(F.col("path2")))) > 0, "O"
        ).otherwise("G"),
    )
    return sinks.decision_counts(decided)


# ------------------------------------------------------- projections, predicates


@query("p01_mapped_rows", "SELECT pair, path2 FROM {gaf_pairs} WHERE path2 <> '*'")
def mapped_rows(t):
    return t["gaf_pairs"].filter(ev.is_mapped(F.col("path2"))).select("pair", "path2")


@query(
    "p03_near_best",
    """SELECT alignment, read, score FROM (SELECT *, MAX(score) OVER (PARTITION BY read) AS best FROM {alignments}) b WHERE score >= best - 10""",
)
def near_best(t):
    return extract.near_best(t["alignments"], 10).select("alignment", "read", "score")


@query(
    "p03_near_first",
    """SELECT alignment, read, score FROM (SELECT *, first_value(score) OVER (PARTITION BY read ORDER BY alignment) AS lead FROM {alignments}) b WHERE score >= lead - 10""",
)
def near_first(t):
    return extract.near_first(t["alignments"], ["alignment"], 10).select("alignment", "read", "score")


@query(
    "p04_identity",
    "SELECT pair, match1 AS matched, round(match1 / 100.0, 6) AS identity, match1 / 100.0 < 0.9 AS low FROM {gaf_pairs}",
    longs=("matched",),
)
def identity(t):
    g = t.sql("SELECT pair, ':' || CAST(match1 - 30 AS STRING) || '*at:30' AS cs, 100 AS len FROM {gaf_pairs}")
    ident = ev.identity(F.col("cs"), F.col("len"))
    return g.select(
        "pair", ev.matched_bases(F.col("cs")).alias("matched"), F.round(ident, 6).alias("identity"), (ident < 0.9).alias("low")
    )


@query(
    "p05_fragment_bound",
    """SELECT pair, CASE WHEN ln > 4 THEN score * 10 + ln + match1 * 5 + match2 * 5 > 1000 WHEN ln IN (3, 4) THEN score * 10 + ln - 40 + match1 * 5 + match2 * 5 > 1000 ELSE FALSE END AS too_long FROM {gaf_pairs}""",
)
def fragment_bound(t):
    g = t.sql(
        """SELECT pair, CASE WHEN ln > 4 THEN 0 WHEN ln > 2 THEN 1 ELSE 2 END AS ov, score * 10 AS r1, ln AS r2, 40 AS node_len,
           match1 * 5 AS l1, match2 * 5 AS l2 FROM {gaf_pairs}"""
    )
    c = F.col
    return g.select("pair", ev.too_long_fragment(c("ov"), c("r1"), c("r2"), c("node_len"), c("l1"), c("l2"), 1000).alias("too_long"))


@query(
    "p06_short_target",
    "SELECT pair, round(score * 3.0 / 100, 6) AS share, score * 3.0 / 100 < 0.9 AS short FROM {gaf_pairs}",
)
def short_target(t):
    g = t["gaf_pairs"].withColumn("target", F.col("score") * 3)
    return g.select(
        "pair", F.round(F.col("target") / 100, 6).alias("share"), ev.short_target(F.col("target"), F.lit(100)).alias("short")
    )


DISC = """SELECT alignment, rf = 'N' AND ls = 'F' AS unmapped, CASE WHEN ln = 1 THEN 0 WHEN ln = 2 THEN 1 END AS proper,
    CASE WHEN ln = 3 THEN '+' || repeat('a', score) || ':50' WHEN ln = 4 THEN ':50+' || repeat('g', score) ELSE ':50' END AS cs,
    CASE WHEN ln <> 5 THEN score / 200.0 END AS dv, score, ln FROM {alignments}"""


@query(
    "p07_discordant",
    f"""SELECT alignment, CASE WHEN unmapped THEN TRUE WHEN proper = 0 THEN TRUE WHEN ln IN (3, 4) THEN score > 20
        WHEN dv IS NULL THEN TRUE ELSE dv > 0.2 END AS discordant FROM ({DISC}) d""",
)
def discordant(t):
    d = t.sql(DISC)
    c = F.col
    return d.select("alignment", ev.discordant(c("unmapped"), c("proper"), c("cs"), c("dv").cast("double")).alias("discordant"))


@query(
    "p08_path_tokens",
    """SELECT pair, CASE WHEN dir = 1 THEN CAST(n AS STRING) || ',' || CAST(n + 1 AS STRING) ELSE CAST(-n - 1 AS STRING) || ',' || CAST(-n AS STRING) END AS nodes1,
        CASE WHEN path2 = '*' THEN ''
         WHEN dir = 1 AND ln <= 2 THEN CAST(n AS STRING) || ',' || CAST(n + 1 AS STRING) || ',' || CAST(n + 2 AS STRING)
         WHEN dir = 1 AND ln <= 4 THEN CAST(n + 1 AS STRING) || ',' || CAST(n + 2 AS STRING)
         WHEN dir = 1 THEN CAST(n + 3 AS STRING) || ',' || CAST(n + 4 AS STRING)
         WHEN ln <= 2 THEN CAST(-n - 1 AS STRING) || ',' || CAST(-n AS STRING) || ',' || CAST(-n + 1 AS STRING)
         WHEN ln <= 4 THEN CAST(-n AS STRING) || ',' || CAST(-n + 1 AS STRING)
         ELSE CAST(-n + 2 AS STRING) || ',' || CAST(-n + 3 AS STRING) END AS nodes2 FROM {gaf_pairs}""",
)
def path_tokens(t):
    def joined(c):
        return F.array_join(F.transform(c, lambda n: n.cast("string")), ",")

    g = t["gaf_pairs"]
    return g.select(
        "pair", joined(pt.signed_nodes(F.col("path1"))).alias("nodes1"),
        joined(pt.opposite_strand(pt.signed_nodes(F.col("path2")))).alias("nodes2"),
    )


@query(
    "p09_formatted_path",
    """SELECT pair, CASE WHEN dir = 1 THEN CAST(n AS STRING) || ',' || CAST(coalesce(a.len, 1) AS STRING) || ',' || CAST(start1 AS STRING) || ',0;' ||
           CAST(n + 1 AS STRING) || ',' || CAST(coalesce(b.len, 1) AS STRING) || ',0,' || CAST(104 - end1 AS STRING)
         ELSE CAST(-n - 1 AS STRING) || ',' || CAST(coalesce(b.len, 1) AS STRING) || ',0,' || CAST(start1 AS STRING) || ';' ||
           CAST(-n AS STRING) || ',' || CAST(coalesce(a.len, 1) AS STRING) || ',' || CAST(104 - end1 AS STRING) || ',0' END AS path
       FROM {gaf_pairs} LEFT JOIN {node_len} a ON a.node = n LEFT JOIN {node_len} b ON b.node = n + 1""",
)
def formatted_path(t):
    g = t["gaf_pairs"].select(
        "pair", pt.signed_nodes(F.col("path1")).alias("nodes"), F.col("start1").alias("h"), (104 - F.col("end1")).alias("x")
    )
    done = extract.formatted_paths(g, t["node_len"], "pair", {"steps": ("nodes", "h", "x")})
    return done.select("pair", pt.render_steps(F.col("steps")).alias("path"))


PATH_TEXT = """SELECT alignment, CAST(n * dir AS STRING) || ',' || CAST(20 + ln AS STRING) || ',' || CAST(ln AS STRING) || ',1;' ||
    CAST(-(n + 1) AS STRING) || ',30,2,' || CAST(ln AS STRING) || ';' || CAST(n AS STRING) || ',25,0,3' AS path, n, ln, dir FROM {alignments}"""


@query(
    "p10_path_parse",
    f"""SELECT alignment, n AS node, 1 AS dir, 25 AS len, 0 AS head, 3 AS tail FROM ({PATH_TEXT}) p
        UNION ALL SELECT alignment, n + 1, -1, 30, 2, ln FROM ({PATH_TEXT}) q""",
    longs=("len", "head", "tail"),
)
def path_parse(t):
    steps = pt.last_per_node(pt.parse_steps(F.col("path")))
    return t.sql(PATH_TEXT).select("alignment", F.inline(steps))


@query(
    "p11_node_range",
    """SELECT pair, CASE WHEN dir = 1 THEN n - 1 WHEN ln <= 4 THEN n - 2 ELSE n - 4 END AS start0,
        CASE WHEN dir = -1 THEN n + 1 WHEN ln <= 4 THEN n + 2 ELSE n + 4 END AS stop FROM {gaf_pairs} WHERE path2 <> '*'""",
)
def node_range(t):
    g = t["gaf_pairs"].filter("path2 <> '*'")
    span = pt.node_span(pt.signed_nodes(F.col("path1")), pt.signed_nodes(F.col("path2")))
    return g.select("pair", span["start0"].alias("start0"), span["end"].alias("stop"))


@query(
    "p12_strand_filter",
    """SELECT alignment, dir FROM {alignments} WHERE dir * (CASE WHEN ls = 'O' THEN 1 ELSE -1 END) * -1 >= 0""",
)
def strand_filter(t):
    a = t["alignments"].withColumn("fdir", F.when(F.col("ls") == "O", 1).otherwise(-1))
    return a.filter(ev.same_strand(F.col("dir"), F.col("fdir"), -1)).select("alignment", "dir")


@query(
    "p13_feature_parts",
    """SELECT p_partkey, p_type AS type, p_brand AS name, p_partkey AS ordinal, p_partkey - 1 AS ordinal0 FROM {part}""",
)
def feature_parts(t):
    ids = t["part"].select("p_partkey", F.concat_ws("|", "p_type", "p_brand", "p_partkey").alias("id"))
    f = ev.feature_parts(F.col("id"))
    return ids.select(
        "p_partkey", f["type"].alias("type"), f["name"].alias("name"), f["ordinal"].alias("ordinal"), (f["ordinal"] - 1).alias("ordinal0")
    )


@query(
    "p14_mark_arithmetic",
    "SELECT alignment, CAST(score AS BIGINT) AS total, CAST(score - CASE WHEN ln > 3 THEN 2 WHEN ln > 1 THEN 1 ELSE 0 END AS BIGINT) AS idx FROM {alignments}",
)
def mark_arithmetic(t):
    m = t.sql(
        "SELECT alignment, CAST(score AS STRING) || CASE WHEN ln > 3 THEN '-1-1' WHEN ln > 1 THEN '-1' ELSE '' END AS mark FROM {alignments}"
    )
    return m.select("alignment", ev.mark_total(F.col("mark")).alias("total"), ev.mark_index(F.col("mark")).alias("idx"))


@query(
    "p15_region_ratio",
    """SELECT CAST(l_suppkey AS STRING) || ':' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) AS region,
        round((l_partkey - l_linenumber) / l_quantity, 6) AS share FROM {lineitem}""",
)
def region_ratio(t):
    return t["lineitem"].select(
        F.concat(F.col("l_suppkey"), F.lit(":"), F.col("l_linenumber"), F.lit("-"), F.col("l_partkey")).alias("region"),
        F.round((F.col("l_partkey") - F.col("l_linenumber")) / F.col("l_quantity"), 6).alias("share"),
    )


@query(
    "p16_bounded_text",
    """SELECT doc_id, coalesce(nullif(regexp_extract(text, '(the.{0,200}and)', 1), ''), nullif(regexp_extract(text, '(and.{0,200}the)', 1), '')) AS hit
       FROM {documents} WHERE coalesce(nullif(regexp_extract(text, '(the.{0,200}and)', 1), ''), nullif(regexp_extract(text, '(and.{0,200}the)', 1), '')) IS NOT NULL""",
)
def bounded_text(t):
    hit = ev.near_in_text(F.col("text"), "the", "and", 200)
    return t["documents"].select("doc_id", hit.alias("hit")).filter("hit IS NOT NULL")


@query(
    "p18_softmax_scaled",
    """SELECT feature, read, round(SUM((exp(100.0 * (score / best - 1)) - exp(-100.0)) / (1 - exp(-100.0))), 6) AS weight
       FROM (SELECT *, MAX(score) OVER (PARTITION BY read) AS best FROM {scores}) b GROUP BY feature, read""",
)
def softmax_scaled(t):
    return em.read_weights(t["scores"]).select("feature", "read", F.round("weight", 6).alias("weight"))


@query(
    "p18_softmax_plain",
    """SELECT feature, read, score, round(exp(score - best) / SUM(exp(score - best)) OVER (PARTITION BY read), 6) AS softmax
       FROM (SELECT *, MAX(score) OVER (PARTITION BY read) AS best FROM {scores}) b""",
)
def softmax_plain(t):
    return em.softmax(t["scores"], "read", "score").withColumn("softmax", F.round("softmax", 6))


@query(
    "p19_linear_projection",
    """SELECT alignment, CASE WHEN dir = 1 THEN n * 100 + ln + 1 ELSE n * 100 + 50 - (ln + 1) END AS head_pos,
        CASE WHEN dir = 1 THEN n * 100 + 50 - score ELSE n * 100 + score END AS tail_pos FROM {alignments}""",
)
def linear_projection(t):
    a = t.sql(
        """SELECT alignment, CASE WHEN dir = 1 THEN n * 100 ELSE n * 100 + 50 END AS ls, CASE WHEN dir = 1 THEN n * 100 + 50 ELSE n * 100 END AS le,
           ln, score FROM {alignments}"""
    )
    p = pt.project_to_linear(F.col("ls"), F.col("le"), F.col("ln"), F.col("score"))
    return a.select("alignment", p["head_pos"].alias("head_pos"), p["tail_pos"].alias("tail_pos"))


@query(
    "p20_span_overlap",
    """SELECT alignment, greatest(0, least(60 - score, 60 - ln) - greatest(ln, 50 - score)) AS shared FROM {alignments}""",
)
def span_overlap(t):
    c = F.col
    return t["alignments"].select(
        "alignment", pt.span_overlap(F.lit(60), c("ln"), c("score"), 50 - c("score"), c("ln")).alias("shared")
    )


@query(
    "p21_count_bins",
    """SELECT bin, COUNT(*) AS n FROM (SELECT CASE WHEN score - 10 > 0 THEN CAST(ceil((score - 10) / 20.0) AS BIGINT) END AS bin FROM {alignments}) b GROUP BY bin""",
)
def count_bins(t):
    return t["alignments"].groupBy(ev.fixed_bin(F.col("score") - 10, 20.0).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p23_name_patterns",
    """SELECT c_custkey, 'Customer' AS stem, replace(c_name, 'Customer#', 'Sample') AS sample, 'Batch' || CAST(c_nationkey AS STRING) || '.Sample' || lpad(CAST(c_nationkey % 4 AS STRING), 2, '0') AS label FROM {customer}""",
)
def name_patterns(t):
    return t["customer"].select(
        "c_custkey", F.regexp_extract("c_name", "(.+)#", 1).alias("stem"),
        F.regexp_replace("c_name", "^Customer#", "Sample").alias("sample"),
        F.format_string("Batch%d.Sample%02d", F.col("c_nationkey"), F.col("c_nationkey") % 4).alias("label"),
    )


@query(
    "p25_unit_ids",
    """SELECT alignment, CAST(len AS BIGINT) AS len, CASE WHEN len <= 10 THEN 0 WHEN len <= 20 THEN 1
        ELSE greatest(0, CAST(floor((len - (floor(ln / 20.0) - 1) * 20 - 2) / 20.0) AS BIGINT)) END AS units,
        CASE WHEN len <= 10 THEN '' WHEN len <= 20 THEN CAST(n * dir AS STRING)
          WHEN dir = 1 THEN CAST(n AS STRING) || ':0' ELSE CAST(-n AS STRING) || ':' || CAST(CAST(floor((len + 20 - 2) / 20.0) AS BIGINT) - 1 AS STRING) END AS first_unit
       FROM (SELECT *, score + 8 AS len FROM {alignments}) a""",
)
def unit_ids(t):
    a = t["alignments"].withColumn("len", F.col("score") + 8)
    step = F.struct(
        F.col("n").alias("node"), "dir", "len", F.col("ln").cast("long").alias("head"), F.lit(2).cast("long").alias("tail")
    )
    units = pt.unit_ids(step)
    return a.select("alignment", "len", F.size(units).cast("long").alias("units"), F.coalesce(F.get(units, F.lit(0)), F.lit("")).alias("first_unit"))


@query(
    "g03_suffix_prefix",
    """SELECT pair, CASE WHEN path2 = '*' THEN 0 WHEN ln <= 2 THEN 2 WHEN ln <= 4 THEN 1 ELSE 0 END AS shared FROM {gaf_pairs}""",
)
def suffix_prefix(t):
    n1 = pt.signed_nodes(F.col("path1"))
    n2 = pt.opposite_strand(pt.signed_nodes(F.col("path2")))
    return t["gaf_pairs"].select("pair", pt.suffix_prefix(n1, n2).alias("shared"))


MATES = """SELECT alignment, CAST(n AS STRING) || ',40,' || CAST(ln AS STRING) || ',0;' || CAST(n + 1 AS STRING) || ',50,0,' || CAST(score % 20 AS STRING) AS p1,
    CAST(n + 1 AS STRING) || ',50,' || CAST(ln AS STRING) || ',0;' || CAST(n + 2 AS STRING) || ',60,0,' || CAST(ln + 3 AS STRING) AS p2, n, ln, score FROM {alignments}"""


@query(
    "g04_merge_mates",
    f"""SELECT alignment, CAST(n AS STRING) || ',1,40,' || CAST(ln AS STRING) || ',0,1;' || CAST(n + 1 AS STRING) || ',1,50,0,0,3;' ||
         CAST(n + 2 AS STRING) || ',1,60,0,' || CAST(ln + 3 AS STRING) || ',2' AS path, 40 - ln + 50 + 60 - ln - 3 AS frag FROM ({MATES}) m""",
    longs=("frag",),
)
def merge_mates(t):
    m = t.sql(MATES).select("alignment", pt.parse_steps(F.col("p1")).alias("a"), pt.parse_steps(F.col("p2")).alias("b"))
    m = m.withColumn("path", pt.join_overlapping_mates(F.col("a"), F.col("b"), F.lit(1)))
    return m.select("alignment", pt.render_completed(F.col("path")).alias("path"), pt.covered_bases(F.col("path")).alias("frag"))


@query(
    "j16_nearest_ids",
    """SELECT pair, CASE WHEN ln <= 4 THEN 0 WHEN dir = 1 THEN 2 ELSE 2 END AS nearest FROM {gaf_pairs} WHERE path2 <> '*'""",
    longs=("nearest",),
)
def nearest_ids(t):
    def ids(c):
        return F.transform(pt.signed_nodes(F.col(c)), F.abs)

    return t["gaf_pairs"].filter("path2 <> '*'").select("pair", extract.nearest_ids(ids("path1"), ids("path2")).alias("nearest"))


@query(
    "u05_chunks_of_path",
    """SELECT alignment, m AS chunk, CAST(CASE WHEN gap < 100 THEN 1 ELSE 2 END AS INT) AS chunks,
        CASE WHEN gap < 100 THEN n - 1 WHEN m = 1 THEN n - 1 ELSE n + gap - 1 END AS start0,
        CASE WHEN gap < 100 THEN n + gap WHEN m = 1 THEN n ELSE n + gap END AS stop,
        CASE WHEN gap < 100 THEN NULL WHEN m = 1 THEN CAST(n + gap - 1 AS STRING) || ',' || CAST(n + gap AS STRING) ELSE CAST(n - 1 AS STRING) || ',' || CAST(n AS STRING) END AS others
       FROM (SELECT *, score * 4 AS gap FROM {alignments}) a, (SELECT 1 AS m UNION ALL SELECT 2) k WHERE m = 1 OR gap >= 100""",
)
def chunks_of_path(t):
    """A-08 and W-07: cut a path where ids jump, number the pieces and list the siblings."""
    a = t["alignments"].select("alignment", F.array(F.col("n") + F.col("score") * 4, -F.col("n"), F.col("n")).alias("ids"))
    a = a.withColumn("c", pt.id_chunks(F.col("ids"), 100)).select("alignment", "c", F.posexplode("c").alias("i", "x"))
    return a.select(
        "alignment", (F.col("i") + 1).alias("chunk"), F.size("c").alias("chunks"), F.col("x.start0").alias("start0"),
        F.col("x.end").alias("stop"), pt.other_chunks(F.col("c"), F.col("i")).alias("others"),
    )
