"""Writers: routing, per-sample output, sorted files, splits at gaps, BED and GTF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.intervals import with_islands
from strandloom.operators.scan import prefix_scan, tile_of
from strandloom.session import cut_lineage


def route_two_ways(df: DataFrame, predicate: Column, hit_path: str, miss_path: str, fmt: str = "parquet") -> None:
    """Write rows that satisfy ``predicate`` and all others to two places."""
    hit = F.coalesce(predicate, F.lit(False))
    df.filter(hit).write.mode("overwrite").format(fmt).save(hit_path)
    df.filter(~hit).write.mode("overwrite").format(fmt).save(miss_path)


def has_annotation(last_field: str) -> Column:
    """The last field of an intersect row says whether anything was hit."""
    return F.col(last_field).isNotNull() & ~F.col(last_field).cast("string").isin(".", "0")


def known_samples(df: DataFrame, samples: DataFrame) -> DataFrame:
    """Rows of listed samples."""
    return df.join(samples.select("sample"), "sample", "left_semi")


def write_per_sample(df: DataFrame, samples: DataFrame, path: str) -> None:
    """One folder per listed sample; rows of other samples are dropped."""
    known_samples(df, samples).write.mode("overwrite").partitionBy("sample").parquet(path)


def write_sorted(df: DataFrame, order: list, path: str, partitions: int | None = None, fmt: str = "parquet") -> None:
    """Globally sorted files: range partitions, each sorted, compressed by the writer."""
    parts = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    parts.sortWithinPartitions(*order).write.mode("overwrite").option("compression", "gzip").format(fmt).save(path)


def file_groups(
    df: DataFrame, start: str, end: str, spacers: DataFrame, batch_rows: int = 1_000_000, tile_width: int = 1 << 16
) -> DataFrame:
    """Number the files of a coordinate-sorted split: add ``file_group`` from 1.

    A file may only end at a coordinate gap that contains a spacer id, and a new one
    is opened where the rows so far reach another multiple of ``batch_rows``. No row
    is lost or repeated.
    """
    islands = with_islands(df, [], start, end, 0, tile_width)
    sizes = cut_lineage(islands.groupBy("island_start").agg(F.count(F.lit(1)).alias("_n"), F.max(end).alias("_end")))
    tile = tile_of("island_start", tile_width)
    gaps = prefix_scan(sizes, [], ["island_start"], tile, {"_prev_end": ("previous", "_end"), "_before": ("sum", "_n")})
    points = spacers.select(F.col("id").cast("long").alias("_pos"), F.lit(1).alias("_is")).distinct()
    # A spacer lies in the gap before an island exactly when more spacers precede the
    # island's first id than its predecessor's last id.
    marks = points.unionByName(sizes.select((F.col("island_start") + 1).alias("_pos"), F.lit(0).alias("_is")))
    marks = marks.unionByName(sizes.select((F.col("_end") + 1).alias("_pos"), F.lit(0).alias("_is")))
    counted = marks.groupBy("_pos").agg(F.sum("_is").alias("_is"))
    ranks = prefix_scan(counted, [], ["_pos"], tile_of("_pos", tile_width), {"_rank": ("sum", "_is")}).select("_pos", "_rank")
    at_start = ranks.select((F.col("_pos") - 1).alias("island_start"), F.col("_rank").alias("_r1"))
    at_end = ranks.select((F.col("_pos") - 1).alias("_prev_end"), F.col("_rank").alias("_r0"))
    cuts = cut_lineage(gaps).join(at_start, "island_start", "left").join(at_end, "_prev_end", "left")
    cuttable = F.coalesce(F.col("_r1") > F.col("_r0"), F.lit(False))
    block = F.floor(F.col("_before") / batch_rows)
    cuts = cuts.withColumn("_cut_block", F.when(cuttable, block).cast("long"))
    seen = prefix_scan(cut_lineage(cuts), [], ["island_start"], tile, {"_max": ("max", "_cut_block")})
    fresh = (F.col("_cut_block") > F.coalesce("_max", F.lit(0))).cast("int")
    opened = seen.withColumn("_open", F.coalesce(fresh, F.lit(0)))
    groups = prefix_scan(opened, [], ["island_start"], tile, {"_sofar": ("sum", "_open")})
    numbered = groups.select("island_start", (F.col("_sofar") + F.col("_open") + 1).cast("long").alias("file_group"))
    return islands.join(numbered, "island_start").select(*df.columns, "file_group")


def write_split(df: DataFrame, start: str, end: str, spacers: DataFrame, path: str, batch_rows: int = 1_000_000) -> None:
    file_groups(df, start, end, spacers, batch_rows).write.mode("overwrite").partitionBy("file_group").parquet(path)


def decision_counts(df: DataFrame, decision: str = "decision") -> DataFrame:
    return df.groupBy(decision).agg(F.count(F.lit(1)).alias("n"))
