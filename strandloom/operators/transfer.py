"""Moving counts and labels between features, regions, clusters and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.evidence import coverage_weight, gtf_attribute
from strandloom.operators.intervals import merged_spans
from strandloom.session import sliced


def first_target(rows: DataFrame) -> DataFrame:
    """``source, target, count``: each source goes to the smallest target it touches.

    Input ``source, target, count, overlap``; an absent or zero overlap is no contact,
    and a source without contact has a NULL target.
    """
    touching = F.when(F.coalesce(F.col("overlap"), F.lit(0)) != 0, F.col("target"))
    return rows.groupBy("source").agg(F.min(touching).alias("target"), F.max("count").alias("count"))


def largest_target(rows: DataFrame) -> DataFrame:
    """``source, target, count``: each source goes to the target of largest overlap.

    Rows without a count are ignored, an absent overlap counts as 0; equal overlaps go to the smallest target.
    """
    counted = rows.filter(F.coalesce(F.col("count"), F.lit(0)) != 0)
    return counted.groupBy("source").agg(
        F.min(F.struct((-F.coalesce(F.col("overlap"), F.lit(0))).alias("o"), F.col("target").alias("t")))["t"].alias("target"),
        F.max("count").alias("count"),
    )


def target_counts(assigned: DataFrame) -> DataFrame:
    """``target, count, sources`` with nonzero counts; leftovers are listed as ``__source``."""
    name = F.coalesce(F.col("target").cast("string"), F.concat(F.lit("__"), F.col("source").cast("string")))
    summed = assigned.groupBy(name.alias("target")).agg(
        F.sum("count").alias("count"), F.count(F.lit(1)).alias("sources")
    )
    return summed.filter((F.col("count") != 0) | F.col("target").startswith("__"))


def link_report(report: DataFrame, annotation: DataFrame, zero_based: bool = False) -> DataFrame:
    """Attach nonzero report counts to annotation rows by their ``gene_id`` attribute.

    ``report``: id, count. ``annotation``: chrom, start, end, attributes. Starts stay
    one-based unless ``zero_based``.
    """
    used = report.filter(
        ~F.col("id").startswith("#")
        & ~F.col("id").startswith("transcript")
        & ~F.col("id").startswith("__no_feature")
        & (F.col("count") != 0)
    )
    named = annotation.withColumn("id", gtf_attribute(F.col("attributes")))
    start = F.col("start") - 1 if zero_based else F.col("start")
    return named.join(used, "id").select("chrom", start.alias("start"), "end", "id", "count")


def lift_ids(
    queries: DataFrame,
    regions: DataFrame,
    ids: str = "ids",
    max_gap: int = 1000,
    stranded: bool = False,
    slice_rows: int | None = None,
) -> DataFrame:
    """Turn ``a:b:c`` id lists into merged linear regions.

    ``regions`` has ``id`` and ``places`` (``chr:s-e:+;...`` or ``NA``). Every other
    column of ``queries`` identifies a query and is kept. Queries go through in slices of ``slice_rows``.
    """
    kept = [c for c in queries.columns if c != ids]
    # Places are taken apart once per id, not once per query that names it.
    pattern = r"^(\w+):(\d+)-(\d+):([+-])$"
    places = regions.filter("places <> 'NA'").select("id", F.explode(F.split("places", ";")).alias("_p")).select(
        "id",
        F.regexp_extract("_p", pattern, 1).alias("_chrom"),
        F.regexp_extract("_p", pattern, 2).alias("_from"),
        F.regexp_extract("_p", pattern, 3).alias("_to"),
        (F.regexp_extract("_p", pattern, 4) if stranded else F.lit(".")).alias("_strand"),
    )

    def lifted(mine) -> DataFrame:
        asked = mine(queries).select(*kept, F.explode(F.split(ids, ":")).alias("id"))
        parsed = asked.join(places, "id").select(
            *kept, F.col("_chrom").alias("chrom"), F.col("_from").cast("long").alias("start"), F.col("_to").cast("long").alias("end"),
            F.col("_strand").alias("strand"),
        )
        # All regions of a query come from the id list in one input row. They are dealt by query once; merging sends them no further.
        dealt = parsed.repartition(*kept) if kept else parsed
        spans = merged_spans(dealt, [*kept, "chrom", "strand"], "start", "end", max_gap, tile_width=None)
        return spans.select(
            *kept, "chrom", F.col("island_start").alias("start"), F.col("island_end").alias("end"), "strand"
        )

    return sliced(queries.count() if kept else 0, kept, lifted, "lifted", slice_rows)


def rename_by_cluster(assign: DataFrame, links: DataFrame) -> DataFrame:
    """Replace feature and length by those of the cluster; ``links``: cluster (``a:b:c``), length."""
    members = links.select(
        F.explode(F.split("cluster", ":")).alias("feature"),
        F.concat(F.split("cluster", ":")[0], F.lit(".J")).alias("_name"),
        F.col("length").alias("_length"),
    )
    return assign.join(members, "feature", "left").select(
        F.coalesce("_name", "feature").alias("feature"),
        F.coalesce(F.col("_length").cast("double"), F.col("flen").cast("double")).alias("flen"),
        *[c for c in assign.columns if c not in ("feature", "flen")],
    )


def first_assignment(assign: DataFrame, order: list[str]) -> DataFrame:
    """Keep the first row per alignment (read, mm_total, mm_index) along ``order``."""
    keys = ["read", "mm_total", "mm_index"]
    rest = [c for c in assign.columns if c not in keys]
    firsts = assign.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return firsts.select(*keys, "_row.*").select(*assign.columns)


def incomplete_reads(assign: DataFrame) -> DataFrame:
    """Multi-mapped reads of which not every alignment index has been assigned."""
    seen = assign.filter("mm_total >= 2").groupBy("read").agg(
        F.max("mm_total").alias("_total"), F.count_distinct("mm_index").alias("_seen")
    )
    return seen.filter("_seen < _total").select("read")


def residual_alignments(keep: DataFrame, assign: DataFrame, only_missing: bool = False) -> DataFrame:
    """Alignments of incompletely assigned reads: all of them, or only those not assigned."""
    rest = keep.join(incomplete_reads(assign), "read", "left_semi")
    if only_missing:
        done = assign.select("read", "mm_index").distinct()
        rest = rest.join(done, ["read", "mm_index"], "left_anti")
    return rest


def apply_clusters(
    keep: DataFrame, assign: DataFrame, links: DataFrame, order: list[str], only_missing: bool = False
) -> tuple[DataFrame, DataFrame]:
    """First assignment per alignment renamed to clusters, and the residual alignments."""
    first = first_assignment(assign, order)
    return rename_by_cluster(first, links), residual_alignments(keep, first, only_missing)


def feature_coverage(assign: DataFrame, weighted: bool = True) -> DataFrame:
    """Length-normalised coverage per feature and sample over body-stage rows."""
    weight: Column = coverage_weight(F.col("mm_total"), F.col("mm_index")) if weighted else F.lit(1.0)
    body = assign.filter("stage = 0")
    return body.groupBy("feature", "sample").agg(F.sum(weight / F.col("flen")).alias("coverage"))
