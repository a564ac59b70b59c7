"""The stages of a quantification run chained together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.model import STRAND
from strandloom.operators.clusters import cluster_features
from strandloom.operators.complete import complete_pairs
from strandloom.operators.em import EmCounts, em_counts
from strandloom.operators.extract import extract_pairs, qc_filter
from strandloom.operators.graphprep import neighbours, node_lengths, walk_steps
from strandloom.operators.growth import grow_assign
from strandloom.operators.intervals import range_join
from strandloom.operators.overlap import cap_runs, path_overlap, route, run_key
from strandloom.operators.scan import tile_of
from strandloom.operators.transfer import apply_clusters
from strandloom.session import cut_lineage


def build_graph(segments: DataFrame, walks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node lengths and neighbour edges of a graph."""
    return node_lengths(segments), neighbours(walk_steps(walks, []))


def complete_sample(
    gaf: DataFrame, lengths: DataFrame, edges: DataFrame, g2l: DataFrame, l2g: DataFrame, sample: str,
    score_window: float = 10, max_depth: int | None = None, min_identity: float = 0.9, max_frag: int = 1000,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Alignment lines of one sample to completed, chunked fragments."""
    pairs = extract_pairs(gaf, lengths, score_window)
    kept, rejected = qc_filter(pairs, 0.8, max_depth) if max_depth else (pairs, None)
    keep, reject, stats = complete_pairs(cut_lineage(kept), edges, g2l, l2g, lengths, sample, min_identity, max_frag)
    if rejected is not None:
        reject = reject.unionByName(rejected.select(*reject.columns))
    return keep, reject, stats


def overlap_features(
    keep: DataFrame, feature_ranges: DataFrame, features: DataFrame, strand: str, min_overlap: int = 30, thin: bool = False
) -> DataFrame:
    """Chunks against features by node range, then by exact bases: adds ``feature, same, code``.

    ``feature_ranges``: feature, start0, end in node ids; ``features``: feature, path.
    ``thin`` drops rows: it lets at most four reads of a run of identical alignments through, in
    coordinate order.
    """
    rows = keep.withColumn("alignment", F.concat_ws(":", "sample", "pair"))
    if thin:
        order = ["start0", "end", "frag", "_key", "read", "alignment", "chunk"]
        keyed = cut_lineage(rows.withColumn("_key", run_key(F.col("path"), F.col("frag"))))
        tile = tile_of("start0", 1 << 12)
        rows = cut_lineage(cap_runs(keyed, order, "_key", "read", tile, sorted_by=order[:4]).drop("_key"))
    ranges = feature_ranges.select("feature", F.col("start0").alias("f0"), F.col("end").alias("f1"))
    near = range_join(rows, ranges, [], ("start0", "end"), ("f0", "f1"), "left", ["alignment", "chunk"]).drop("f0", "f1")
    steps = rows.select("alignment", F.transform("path", lambda s: s.dropFields("src")).alias("path")).dropDuplicates(["alignment"])
    hits = near.filter("feature IS NOT NULL").select("alignment", "feature").distinct()
    scored = path_overlap(hits, steps, features, STRAND[strand], "alignment", "feature")
    return route(near.join(scored, ["alignment", "feature"], "left"), min_overlap)


def assign_clusters_counts(
    body: DataFrame, flank: DataFrame | None, alignments: DataFrame, features: DataFrame, spans: DataFrame, keep: DataFrame,
    strand: str = "r", support: int = 10, min_haps: int = 10, min_samples: int = 10,
    feature_nodes: DataFrame | None = None, node_haps: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, EmCounts]:
    """Assignment, clustering and counting: ``(assigned, residual, counts)``."""
    assign = cut_lineage(grow_assign(body, flank, alignments, features, strand, support))
    members, _, lengths = cluster_features(assign, spans, feature_nodes, node_haps, min_haps, min_samples)
    names = members.groupBy("seed").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_set(F.struct(F.element_at(F.split("feature", r"\|"), -1).try_cast("long").alias("n"), "feature"))),
                lambda s: s["feature"],
            ), ":",
        ).alias("cluster")
    )
    links = names.join(lengths, "seed").select("cluster", "length")
    first, residual = apply_clusters(keep, assign, links, ["stage", "feature"])
    counts = em_counts(first.select("feature", F.col("read"), F.col("score").cast("double").alias("score")))
    return first, residual, counts
