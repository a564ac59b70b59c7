"""Random choices that come from a hash of the rows, so they depend on neither partitioning nor order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(columns: Sequence[str], seed: int) -> Column:
    """A number above 0 and below 1 from the md5 of the seed and the columns as text."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def weighted_choice(rows: DataFrame, keys: Sequence[str], item: str, weight: str, order: str | None = None, seed: int = 0) -> DataFrame:
    """One ``item`` per group of ``keys``, with a probability in proportion to its weight.

    Every item draws an exponential number with its weight as rate; the smallest one wins, which needs no running sum and
    combines before the exchange. Items of weight 0 or less, or NULL, are never drawn. A group without positive weight takes
    its first item by ``order`` (default: by item). Equal draws go to the smaller item.
    """
    draw = -F.log(uniform([*keys, item], seed)) / F.col(weight)
    positive = F.col(weight) > 0
    return rows.groupBy(*keys).agg(
        F.coalesce(F.min_by(item, F.when(positive, F.struct(draw.alias("draw"), F.col(item).alias("item")))), F.min_by(item, F.struct(F.col(order or item), F.col(item)))).alias(item),
        F.count(F.lit(1)).alias("choices"), F.coalesce(F.sum(F.when(positive, F.col(weight))), F.lit(0)).cast("double").alias("total"),
    )
