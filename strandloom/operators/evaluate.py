"""Accuracy evaluation against simulated truth, and the simulation of that truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.evidence import fixed_bin
from strandloom.operators.scan import quantiles


def compare(truth: DataFrame, estimate: DataFrame, keys: list[str], how: str = "full", fill: bool = True) -> DataFrame:
    """Join truth and estimates on explicit keys; missing counts become 0 with ``fill``."""
    joined = truth.join(estimate, keys, how)
    if fill:
        counts = [c for c in joined.columns if c not in keys]
        joined = joined.fillna(0, subset=counts)
    return joined


def differences(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two estimates side by side with suffixes and their difference."""
    left = a.select(*keys, F.col(value).alias(f"{value}_x"))
    right = b.select(*keys, F.col(value).alias(f"{value}_y"))
    return left.join(right, keys, "full").withColumn("diff", F.col(f"{value}_x") - F.col(f"{value}_y"))


def pearson(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Pearson correlation over complete cases."""
    full = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return full.groupBy(*(by or [])).agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Box-plot numbers per group: minimum, quartiles, maximum and size."""
    ends = df.groupBy(F.struct(*by).alias("_key")).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))
    quarters = quantiles(df, by, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75}).withColumn("_key", F.struct(*by)).drop(*by)
    return ends.join(quarters, "_key").select(*(F.col(f"_key.{k}").alias(k) for k in by), "low", "q1", "q2", "q3", "high", "n")


def binned_box_stats(df: DataFrame, truth: str, estimate: str, width: float) -> DataFrame:
    return box_stats(df.withColumn("bin", fixed_bin(F.col(truth), width)), estimate, ["bin"])


def histogram(df: DataFrame, value: str, bins: int = 100) -> DataFrame:
    """Equal-width histogram over the observed range; the largest value falls in the last bin."""
    edges = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).first()
    if edges.lo is None:
        return df.select(F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("n")).filter(F.lit(False))
    width = (edges.hi - edges.lo) / bins or 1.0
    b = F.least(F.floor((F.col(value) - edges.lo) / width), F.lit(bins - 1)).cast("long") + 1
    return df.filter(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def null_table(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(F.col(value).isNull().alias("missing")).agg(F.count(F.lit(1)).alias("n"))


def wide_by(df: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """Wide form keeping the largest value per cell; ``columns`` names the wide columns."""
    return df.groupBy(row).pivot(column, columns).agg(F.max(value))


def long_by(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, values, name, value)


def simulated_counts(
    transcripts: DataFrame,
    replicates: int = 2,
    low: int = 1,
    high: int = 300,
    beta: float | None = None,
    folds: tuple[tuple[float, float], ...] = ((0.5, 0.05), (1.0, 0.9), (2.0, 0.05)),
    seed: int = 4,
) -> DataFrame:
    """Truth table ``transcript, group, replicate, base, fold, count`` for a two-group experiment.

    Counts are uniform on ``low..high``, or follow Beta(1, beta), whose quantile is
    ``1 - (1 - u)^(1/beta)``. The treated group multiplies by a categorical fold
    change. Values depend on the transcript and seed only, not on partitioning.
    """
    def uniform(tag):
        digest = F.md5(F.concat_ws(":", "transcript", F.lit(seed), F.lit(tag)))
        return F.conv(F.substring(digest, 1, 10), 16, 10).cast("long") / float(1 << 40)

    u = uniform("count")
    share = u if beta is None else 1 - F.pow(1 - u, F.lit(1.0 / beta))
    base = F.floor(low + (high - low) * share).cast("long")
    draw = uniform("fold")
    total = sum(p for _, p in folds)
    edge, fold = 0.0, F.lit(folds[-1][0])
    steps = []
    for value, p in folds[:-1]:
        edge += p / total
        steps.append((edge, value))
    for edge, value in reversed(steps):
        fold = F.when(draw < edge, F.lit(value)).otherwise(fold)
    groups = F.explode(
        F.array(F.struct(F.lit("control").alias("group"), F.lit(1.0).alias("f")),
                F.struct(F.lit("treated").alias("group"), fold.alias("f")))
    )
    reps = F.explode(F.sequence(F.lit(1), F.lit(replicates)))
    return (
        transcripts.select("transcript", base.alias("base"), groups.alias("g"))
        .select("transcript", "base", F.col("g.group").alias("group"), F.col("g.f").alias("fold"))
        .withColumn("replicate", reps)
        .withColumn("count", F.floor(F.col("base") * F.col("fold")).cast("long"))
    )
