"""Expectation-maximisation of multi-mapped reads (model of feature abundance)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.evidence import scaled_weight
from strandloom.session import discard, written


@dataclass
class EmCounts:
    """Result of :func:`em_counts`."""

    counts: DataFrame
    rounds: int
    converged: bool


def read_weights(scores: DataFrame, scale: float = 100.0) -> DataFrame:
    """``read, feature, weight``: summed scaled weights of a read on a feature.

    Copies of a row are counted before anything is shuffled by read. Scores must be positive.
    """
    rows = scores.groupBy("read", "feature", "score").agg(F.count(F.lit(1)).alias("copies"))
    spread = rows.filter("read IS NOT NULL").repartition(int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions")), "read")
    best = F.max("score").over(Window.partitionBy("read"))
    weighed = spread.withColumn("best", best).withColumn("q", scaled_weight(F.col("score"), F.col("best"), scale))
    return weighed.groupBy("read", "feature").agg(F.sum(F.col("copies") * F.col("q")).alias("weight"))


def read_classes(weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Collapse reads whose features and weights are identical.

    Returns ``(unique, members)``: reads with a single feature counted per feature,
    and one row per class and feature with the number of reads it stands for. The
    signature of a read is two independent 64-bit hashes combined with xor, its
    feature count and its smallest feature, so no read is gathered into a list.
    """
    per_read = weights.groupBy("read").agg(
        F.count(F.lit(1)).alias("features"),
        F.min("feature").alias("first"),
        F.bit_xor(F.xxhash64("feature", "weight")).alias("h1"),
        F.bit_xor(F.xxhash64("weight", F.lit("#"), "feature")).alias("h2"),
    )
    unique = (
        per_read.filter("features = 1")
        .groupBy(F.col("first").alias("feature"))
        .agg(F.count(F.lit(1)).alias("unique_reads"))
    )
    classes = (
        per_read.filter("features > 1")
        .groupBy("features", "first", "h1", "h2")
        .agg(F.min("read").alias("read"), F.count(F.lit(1)).alias("reads"))
        .select("read", "reads")
    )
    members = weights.join(classes, "read").withColumnRenamed("read", "read_class")
    return unique, members


def em_counts(
    scores: DataFrame,
    max_rounds: int = 100,
    tol: float = 1e-6,
    scale: float = 100.0,
) -> EmCounts:
    """Abundance of every feature from ``feature, read, score`` rows.

    A read with several features is shared in proportion to
    ``abundance * ambiguous share * weight``; a read with one feature counts fully.
    The pseudo-count 2000 the model adds to the ambiguous share is relative to a
    read weight of about 2.7e43 and therefore vanishes; it is left out.

    Per round: a join of the class members with the feature state, a sum within
    a class (at most one row per feature) and one aggregate by feature. Whether the
    state is broadcast is left to the planner, which knows its size.
    """
    weights = read_weights(scores, scale).persist()
    unique, members = read_classes(weights)
    # The join leaves the rows dealt by read, so a round needs no other dealing by class.
    members = members.sortWithinPartitions("read_class").persist()
    features = weights.select("feature").distinct().join(unique, "feature", "left").select(
        "feature", F.coalesce("unique_reads", F.lit(0)).cast("double").alias("unique_reads")
    )
    k = features.count()
    reads = weights.select("read").distinct().count()
    start = reads / k if k else 0.0
    # A stored table has a size that the planner knows; of a checkpoint it knows none, and would move the members by feature and back.
    state = written(features.withColumns({"total": F.lit(start), "shared": F.lit(1.0), "moved": F.lit(0.0)}), "state")
    if k == 0:
        return EmCounts(state.select("feature", F.lit(0).cast("long").alias("count"), F.col("total").alias("abundance")), 0, True)

    in_class = Window.partitionBy("read_class")
    rounds, converged = 0, False
    while rounds < max_rounds and not converged:
        rounds += 1
        priors = state.select("feature", "total", "shared")
        z = members.join(priors, "feature").withColumn(
            "z", F.col("weight") * F.col("total") * F.col("shared")
        )
        share = (
            z.withColumn("part", F.col("z") / F.sum("z").over(in_class))
            .groupBy("feature")
            .agg(F.sum(F.col("reads") * F.col("part")).alias("new_shared"))
        )
        nxt = state.join(share, "feature", "left").select(
            "feature",
            "unique_reads",
            (F.col("unique_reads") + F.coalesce("new_shared", F.lit(0.0))).alias("total"),
            F.coalesce("new_shared", F.lit(0.0)).alias("shared"),
            F.col("total").alias("_old"),
        )
        before, state = state, written(nxt.withColumn("moved", F.abs(F.col("total") - F.col("_old"))).drop("_old"), "state")
        discard(before)
        moved = state.agg(F.sum("moved")).first()[0] or 0.0
        converged = moved * k / reads < tol
    members.unpersist()
    weights.unpersist()
    counts = state.select("feature", F.rint("total").cast("long").alias("count"), F.col("total").alias("abundance"))
    return EmCounts(counts, rounds, converged)


def softmax(df: DataFrame, group: str, value: str, name: str = "softmax") -> DataFrame:
    """Plain softmax of ``value`` within ``group``, shifted by the maximum for stability."""
    best = df.groupBy(group).agg(F.max(value).alias("_best"))
    shifted = df.join(best, group).withColumn("_x", F.exp(F.col(value) - F.col("_best")))
    total = shifted.groupBy(group).agg(F.sum("_x").alias("_total"))
    return shifted.join(total, group).withColumn(name, F.col("_x") / F.col("_total")).select(*df.columns, name)
