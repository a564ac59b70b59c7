"""Pair completion, quality control, file sources, sinks and streaming filters."""

import gzip
import os
import random

from pyspark.sql import functions as F

from strandloom.model import STEPS
from strandloom.operators import complete, extract, graphprep, overlap
from strandloom.operators.scan import tile_of
from strandloom.plans import stages
from strandloom.sources import sinks, text
from strandloom.streaming import filters

GAF = "{r}\t100\t0\t100\t+\t{p}\t{l}\t{s}\t{e}\t90\t100\t60\tAS:i:{a}\tcs:Z::{m}\tdv:f:0.01"


def _line(r, p, l=110, s=10, e=110, a=100, m=95):
    return GAF.format(r=r, p=p, l=l, s=s, e=e, a=a, m=m)


def _pairs(spark):
    """Five pairs: overlapping, reference gap, graph gap, unbridgeable, copy of the first."""
    L = [
        ("r1", ">1>2", "<3<2"), ("r2", ">11", "<13"), ("r3", ">21", "<23"), ("r4", ">31", "<90"), ("r1", ">1>2", "<3<2"),
    ]
    lines = []
    for i, (r, a, b) in enumerate(L):
        lines.append((2 * i, _line(r, a, a=100 - 5 * (i == 4))))
        lines.append((2 * i + 1, _line(r, b, a=100)))
    return spark.createDataFrame(lines, "ordinal long, value string")


def _tables(spark):
    lengths = spark.createDataFrame([(n, 110) for n in (1, 2, 3, 11, 13, 21, 23, 31, 90)] + [(12, 20), (22, 20)], "node long, len long")
    edges = spark.createDataFrame([(21, 1, 22), (22, 1, 23)], "node long, side int, nbr long")
    g2l = spark.createDataFrame([(11, "c", 0, 110), (13, "c", 130, 240)], "node long, chrom string, start long, end long")
    l2g = spark.createDataFrame(
        [("c", 0, 110, 11, 1, 110), ("c", 110, 130, 12, 1, 20), ("c", 130, 240, 13, 1, 110)],
        "chrom string, start long, end long, node long, dir int, len long",
    )
    return lengths, edges, g2l, l2g


def test_extract_and_complete(spark):
    lengths, edges, g2l, l2g = _tables(spark)
    pairs = extract.extract_pairs(text.parse_gaf(_pairs(spark), ["ordinal"]), lengths)
    rows = {r.pair: r for r in pairs.collect()}
    assert len(rows) == 5 and rows[0].n_best == 2 and rows[0].overlap == 1 and rows[1].overlap == 0
    assert (rows[0].start0, rows[0].end, rows[0].score) == (0, 3, 200)
    assert [(s.node, s.dir, s.head, s.tail) for s in rows[1].path2] == [(13, 1, 0, 10)]
    keep, reject, stats = complete.complete_pairs(pairs, edges, g2l, l2g, lengths, "s")
    kept = {r.read: r for r in keep.collect()}
    assert {k: v.decision for k, v in kept.items()} == {"r1": "O", "r2": "R", "r3": "W"}
    assert [s.node for s in kept["r1"].path] == [1, 2, 3] and [s.src for s in kept["r1"].path] == [1, 3, 2]
    assert [(s.node, s.src) for s in kept["r2"].path] == [(11, 1), (12, 4), (13, 2)]
    assert [(s.node, s.src) for s in kept["r3"].path] == [(21, 1), (22, 0), (23, 2)]
    # mate 1 covers 10..110 of its node, mate 2 0..100: the gap adds the inner node
    assert kept["r3"].frag == 100 + 20 + 100
    assert (kept["r2"].lin_chrom, kept["r2"].lin_start, kept["r2"].lin_end) == ("c", 11, 230)
    assert all(r.mm_total == 0 for r in kept.values())
    assert {r.read: r.reasons for r in reject.collect()} == {"r4": ["GAP"], "r1": ["DUP"]}
    assert {r.decision: r.pairs for r in stats.collect()} == {"O": 1, "R": 1, "W": 1, "D": 1, "G": 1}


def test_reference_fill_without_rows_per_segment(spark):
    """Spans of mixed lengths, some without edges, against segments some of which are empty or turned; one join, no row per segment."""
    r = random.Random(5)
    segments = [(r.choice(["c", "d"]), s, s + r.choice([30, 30, 30, 7, 0, -5]), n, r.choice([1, -1]), 30) for n, s in enumerate(range(-900, 9000, 15))]
    segments += [("c", None, 5, 5000, 1, 30), ("c", 5, None, 5001, 1, 30), segments[100]]
    spans = []
    for pair in range(300):
        lo = r.randint(-1000, 9000)
        spans.append((pair, r.choice(["c", "d", "e"]), lo, lo + r.choice([-3, 0, 1, 40, 255, 256, 257, 400, 6000]), r.choice([1, -1])))
    spans += [(300, "c", None, 50, 1), (301, "c", 10, None, 1), (302, None, 10, 500, 1)]
    part = "array<struct<node:bigint,dir:int,len:bigint,head:bigint,tail:bigint,src:int>>"
    reaches = spark.createDataFrame(spans, "pair long, lin_chrom string, edge_lo long, edge_hi long, reach_dir int").selectExpr(
        "*", "0L AS kept_len", *(f"CAST(array() AS {part}) AS {name}" for name in ("part1", "part2", "path1", "path2"))
    )
    done = complete.fill_from_reference(reaches, spark.createDataFrame(segments, "chrom string, start long, end long, node long, dir int, len long"))
    assert done._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    got = {x.pair: [(s.node, s.dir) for s in x.path] for x in done.collect()}
    for pair, chrom, lo, hi, turn in spans:
        known = [] if lo is None or hi is None else sorted(
            (s0, n, d) for c, s0, s1, n, d, _ in segments
            if c == chrom and s0 is not None and s1 is not None and s0 >= lo and s1 < hi and s1 > lo and s0 < hi
        )
        assert got[pair] == [(n, turn * d) for _, n, d in known][::turn]
    assert sum(map(len, got.values())) > 1000 and len(got) == len(spans)


def test_reverse_reference_gap(spark):
    """The fragment runs down the chromosome: the filling is reversed and turned."""
    lengths, edges, g2l, l2g = _tables(spark)
    lines = [(0, _line("r", "<13")), (1, _line("r", ">11"))]
    pairs = extract.extract_pairs(text.parse_gaf(spark.createDataFrame(lines, "ordinal long, value string"), ["ordinal"]), lengths)
    keep, _, _ = complete.complete_pairs(pairs, edges, g2l, l2g, lengths, "s")
    row = keep.first()
    assert row.decision == "R" and [(s.node, s.dir, s.src) for s in row.path] == [(13, -1, 1), (12, -1, 4), (11, -1, 2)]


def test_marks_and_chunks(spark):
    done = spark.createDataFrame([(1, "a", [1, 150]), (2, "a", [5]), (3, "b", [7])], "pair long, read string, ids array<long>")
    rows = {r.pair: r for r in complete.numbered_alignments(done).withColumn("mark", complete.mark_text()).collect()}
    assert [(rows[p].mm_total, rows[p].mm_index, rows[p].mark) for p in (1, 2, 3)] == [(2, 2, "2"), (2, 1, "2-1"), (0, 0, "0")]
    chunks = sorted((r.pair, r.chunk, r.chunks, r.start0, r.end, r.others) for r in complete.chunk_rows(done).collect())
    assert chunks == [(1, 1, 2, 0, 1, "149,150"), (1, 2, 2, 149, 150, "0,1"), (2, 1, 1, 4, 5, None), (3, 1, 1, 6, 7, None)]


def test_qc_filter_splits_everything(spark):
    step = [(1, 1, 50, 0, 0)]
    rows = [(i, step, [(2, 1, 50, 0, 0)], ":95", ":95", 100, 100, 0) for i in range(4)]
    rows += [(9, [(5, 1, 50, 0, 0)], step[:0] or [(6, 1, 50, 0, 0)], ":10", ":95", 100, 100, 0), (10, [(7, 1, 50, 0, 0)], [(8, 1, 50, 0, 0)], ":95", ":95", 100, 100, 0)]
    df = spark.createDataFrame(rows, f"pair long, path1 {STEPS}, path2 {STEPS}, cs1 string, cs2 string, len1 long, len2 long, overlap int")
    keep, bad = extract.qc_filter(df, 0.8, 3)
    assert [r.pair for r in keep.collect()] == [10]
    assert {r.pair: r.reasons for r in bad.collect()} == {0: ["HiDup"], 1: ["HiDup"], 2: ["HiDup"], 3: ["HiDup"], 9: ["cs1"]}


def test_overlap_threshold_and_strand(spark):
    reads = spark.createDataFrame(
        [(i, [(1, d, 100, 0, 100 - n)]) for i, (n, d) in enumerate([(29, -1), (30, -1), (31, -1), (31, 1)])], f"read long, path {STEPS}"
    )
    feats = spark.createDataFrame([("f", [(1, 1, 100, 0, 0)]), ("u", [(1, 0, 100, 0, 0)])], f"feature string, path {STEPS}")
    cand = spark.createDataFrame([(i, f) for i in range(4) for f in "fu"], "read long, feature string")
    got = {(r.read, r.feature): r.code for r in overlap.route(overlap.path_overlap(cand, reads, feats, -1)).collect()}
    assert [got[i, "f"] for i in range(4)] == ["A", "O", "O", "A"]
    assert [got[i, "u"] for i in range(4)] == ["A", "O", "O", "O"]


def test_run_cap_drops_later_rows_of_known_reads(spark):
    rows = [(i, "k", r) for i, r in enumerate(["a", "b", "a", "c", "d", "a", "b"])] + [(7, "x", "a"), (8, "k", "a")]
    df = spark.createDataFrame(rows, "i long, key string, read string")
    got = sorted(r.i for r in overlap.cap_runs(df, ["i"], "key", "read", tile_of("i", 2)).collect())
    assert got == [0, 1, 2, 3, 4, 7, 8]


def test_graph_from_gfa(spark, tmp_path):
    gfa = tmp_path / "g.gfa"
    gfa.write_text("H\tx\nS\t1\tACGT\nS\t2\tA\nS\t3\t\nW\ts\t1\tc\t0\t9\t>1>2<40\nW\tt\t1\tc\t0\t9\t<40\n")
    segments, walks = text.read_gfa(spark, str(gfa))
    lengths, edges = stages.build_graph(segments, walks)
    assert [tuple(r) for r in lengths.collect()] == [(1, 4)]
    lists = {r.node: (r.before, r.after, r.len) for r in graphprep.neighbour_lists(edges, lengths).collect()}
    assert lists == {1: (None, "2", 4), 2: ("1", "-40", 1), 40: (None, "-2", 1)}
    assert [tuple(r) for r in graphprep.walk_gaps(walks).collect()] == [("1", 38, 2, 40)]
    assert text.parse_walks(spark.read.text(str(gfa)), "t", "1").count() == 1


def test_lines_number_across_splits_and_gzip(spark, tmp_path):
    plain = tmp_path / "a.gaf"
    plain.write_text("".join(_line(f"r{i // 2}", ">1") + "\n" for i in range(4000)))
    with gzip.open(tmp_path / "b.gaf.gz", "wt") as h:
        h.write("".join(_line(f"z{i}", ">2") + "\n" for i in range(50)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        rows = text.read_gaf(spark, str(plain)).select("ordinal", "read").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.ordinal, r.read) for r in rows) == [(i, f"r{i // 2}") for i in range(4000)]
    assert [r.ordinal for r in text.read_gaf(spark, str(tmp_path / "b.gaf.gz")).orderBy("ordinal").collect()] == list(range(50))


def test_lookup_tables(spark):
    def df(*lines):
        return spark.createDataFrame([(x,) for x in lines], "value string")

    assert [tuple(r) for r in text.parse_g2l(df("G\t4\t5\tGRCh38#0#chr1:10-20")).collect()] == [(5, "chr1", 10, 20)]
    assert [tuple(r) for r in text.parse_l2g(df("chr1\t10\t20\t5<10")).collect()] == [("chr1", 10, 20, 5, -1, 10)]
    assert len(text.parse_node_haplotypes(df("G\t4\t5\th1#1#c:1-9,h2#1#c:9-1")).collect()) == 2
    got = sorted(tuple(r) for r in text.parse_neighbours(df("G\t4\t5\tNA\t6;-7\t12")).collect())
    assert got == [(5, 1, -7, 12), (5, 1, 6, 12)]
    assert [tuple(r) for r in text.parse_gap_rows(df("h\t30\t1\t31")).collect()] == [("h", 30, 1, 31)]
    f = text.parse_features(df("L\t0\t1\tL|n|1\th:1-9#+\t+5,9,0,0\t9\tx")).first()
    assert f.feature == "L|n|1" and f.path[0].node == 5 and f.haps[0].hap == "h" and f.flen == 9


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "sample string, v long")
    sinks.write_per_sample(df, spark.createDataFrame([("a",), ("c",)], "sample string"), str(tmp_path / "s"))
    assert sorted(d for d in os.listdir(tmp_path / "s") if d.startswith("sample=")) == ["sample=a", "sample=c"]
    sinks.route_two_ways(df, F.col("v") > 1, str(tmp_path / "hit"), str(tmp_path / "miss"))
    assert spark.read.parquet(str(tmp_path / "hit")).count() == 2 and spark.read.parquet(str(tmp_path / "miss")).count() == 1
    sinks.write_sorted(df, [F.col("v").desc()], str(tmp_path / "o"), 2)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 3


def test_file_groups_lose_nothing(spark, tmp_path):
    rows = [(i, s, s + 4) for i, s in enumerate([0, 2, 10, 12, 20, 30, 40, 41])]
    df = spark.createDataFrame(rows, "id long, s long, e long")
    got = {r.id: r.file_group for r in sinks.file_groups(df, "s", "e", spark.createDataFrame([(8,), (35,)], "id long"), 2, 8).collect()}
    # spacer 8 lies in the gap 6..10 and 35 in 34..40; 16..20 and 24..30 hold none
    assert got == {0: 1, 1: 1, 2: 2, 3: 2, 4: 2, 5: 2, 6: 3, 7: 3}


def test_streaming_filter(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.gaf").write_text(_line("r1", ">1") + "\n" + _line("r2", "*") + "\n")
    (src / "b.gaf").write_text(_line("r3", "<9") + "\n")
    stream = filters.mapped_lines(filters.line_stream(spark, str(src), 1))
    filters.write_lines(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = sorted(r.value.split("\t")[0] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert got == ["r1", "r3"]


def test_same_result_under_other_partition_counts(spark):
    lengths, edges, g2l, l2g = _tables(spark)
    seen = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        pairs = extract.extract_pairs(text.parse_gaf(_pairs(spark), ["ordinal"]), lengths)
        keep, _, _ = complete.complete_pairs(pairs, edges, g2l, l2g, lengths, "s")
        seen.append(sorted(map(str, keep.collect())))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen[0] == seen[1]


def test_whole_run(spark):
    """Lines of two samples to clustered counts: two features side by side on one haplotype."""
    lengths = spark.createDataFrame([(n, 110) for n in (1, 2, 3, 11, 12)], "node long, len long")
    edges = spark.createDataFrame([(1, 1, 2), (2, 1, 3)], "node long, side int, nbr long")
    g2l = spark.createDataFrame([(1, "c", 0, 110)], "node long, chrom string, start long, end long")
    l2g = spark.createDataFrame([("c", 0, 110, 1, 1, 110)], "chrom string, start long, end long, node long, dir int, len long")
    keeps = None
    for sample in ("s1", "s2"):
        lines = []
        for i in range(6):
            lines += [(4 * i, _line(f"{sample}r{i}", ">1>2")), (4 * i + 1, _line(f"{sample}r{i}", "<3<2"))]
            lines += [(4 * i + 2, _line(f"{sample}q{i}", ">11")), (4 * i + 3, _line(f"{sample}q{i}", "<11"))]
        gaf = text.parse_gaf(spark.createDataFrame(lines, "ordinal long, value string"), ["ordinal"])
        keep, _, _ = stages.complete_sample(gaf, lengths, edges, g2l, l2g, sample, max_depth=50)
        keeps = keep if keeps is None else keeps.union(keep)
    feats = spark.createDataFrame(
        [("T|a|1", 110.0, [(1, -1, 110, 0, 0)]), ("T|b|2", 110.0, [(3, -1, 110, 0, 0)]), ("T|c|3", 110.0, [(11, 1, 110, 0, 0)])],
        f"feature string, flen double, path {STEPS}",
    )
    ranges = spark.createDataFrame([("T|a|1", 0, 1), ("T|b|2", 2, 3), ("T|c|3", 10, 11)], "feature string, start0 long, end long")
    routed = stages.overlap_features(keeps, ranges, feats, "r", thin=False)
    codes = sorted((r.feature, r.code) for r in routed.select("feature", "code").distinct().collect())
    assert codes == [("T|a|1", "O"), ("T|b|2", "O"), ("T|c|3", "A")]
    # every alignment looks the same, so only four reads of the run pass
    assert stages.overlap_features(keeps, ranges, feats, "r").filter("feature = 'T|a|1'").count() == 12
    thinned = stages.overlap_features(keeps, ranges, feats, "r", thin=True)
    assert thinned.filter("feature = 'T|a|1'").count() == 4
    body = routed.filter("code = 'O'").select("feature", "alignment")
    alignments = keeps.select(
        F.concat_ws(":", "sample", "pair").alias("alignment"), "read", "sample", "score", "frag", "mm_total", "mm_index",
        F.col("lin_chrom").alias("lin"), "path",
    ).dropDuplicates(["alignment"])
    spans = spark.createDataFrame([("T|a|1", "h1", 100, 209, 1), ("T|b|2", "h1", 400, 509, 1)], "feature string, hap string, start long, end long, dir int")
    first, residual, counts = stages.assign_clusters_counts(
        body, None, alignments, feats, spans, keeps.select("read", "mm_index", "pair"), "r", 2, 1, 1
    )
    assert residual.count() == 0
    assert {(r.feature, r["count"]) for r in counts.counts.collect()} == {("T|a|1.J", 12)}
    # the frame spans both features: 409 bases from the first start to the last end
    assert {r.flen for r in first.select("flen").collect()} == {410.0}


def test_tips_at_one_place_look_up_jumps_once(spark, monkeypatch):
    """Half-open stretches agree with the rule for every tip; many pairs at one place are one row of the range join."""
    from strandloom.operators import extract, intervals

    sides, real = [], intervals.range_join

    def seen(left, *rest):
        sides.append(left.count())
        return real(left, *rest)

    monkeypatch.setattr(intervals, "range_join", seen)
    tips = [(i, 1000 + i % 3 * 90, 1000 + i % 3 * 90 + i) for i in range(900)] + [(900, 1500, 1000), (901, None, 5), (902, None, None)]
    jumps = [(901, 1400), (1000, 1300), (1090, 1555), (1099, 1700), (1100, 1600), (1180, 1180), (1000, 1300)]
    got = extract.bridged(spark.createDataFrame(tips, "pair long, tip1 long, tip2 long"), spark.createDataFrame(jumps, "from long, to long"))

    def rule(a, b):
        known = [x for x in (a, b) if x is not None]
        if not known:
            return None
        lo, hi = min(known), max(known)
        return hi - lo < 100 or any(-100 < j - lo <= 100 and abs(land - hi) + j - lo < 100 for j, land in jumps)

    assert {r.pair: r.bridged for r in got.collect()} == {p: rule(a, b) for p, a, b in tips}
    assert sides == [3]


def test_numbering_leaves_only_the_numbered_lines(spark, folder, monkeypatch):
    """No unpacked checkpoint of the lines, and no second table of them."""
    import os

    from strandloom.plans import inputs
    from strandloom.session import ensure_checkpoint_dir

    monkeypatch.setattr(inputs, "_numbered", {})
    at = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(at))
    rows = inputs.Inputs(spark, folder)["ranked"]
    assert sorted(r.ord for r in rows.select("ord").collect()) == list(range(rows.count()))
    made = set(os.listdir(at)) - before
    assert len(made) == 1 and made.pop().startswith("ranked-")
