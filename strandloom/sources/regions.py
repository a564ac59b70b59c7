"""Prepared tables for lookups of regions and keys: range-clustered parquet that a literal lookup reads a small part of.

Intervals are filed by length class (powers of four, so at most 32) and, within a class, by bin of their start. Rows are dealt by range over
class, keys and start, so no class, chromosome or bin is one task, and sorted inside the files. A lookup of ``[a, b)`` knows for each class how far before
``a`` an interval of that class may start: it names the bins (folders that are not listed are not opened) and bounds the start on both
sides (row groups out of bounds are not read). One very long interval therefore does not spoil the pruning of the short ones.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CLASS, BIN = "length_class", "start_bin"


def _class_of(start: str, end: str) -> Column:
    width = F.greatest(F.col(end) - F.col(start), F.lit(1))
    return F.ceil(F.log2(width.cast("double")) / 2).cast("int")


def _width(bin_width: int, level: int) -> int:
    """Bins of a class are never narrower than its intervals, so an interval starts at most one bin before those it reaches."""
    return max(bin_width, 4 ** level)


def write_regions(
    df: DataFrame, keys: Sequence[str], start: str, end: str, path: str, bin_width: int = 1 << 24, partitions: int | None = None, rows_per_file: int = 0,
) -> None:
    """Write half-open intervals with integer coordinates; rows without a start or end cannot be found by region and are left out.

    ``bin_width``: span of one folder of the short classes. ``rows_per_file``: upper bound of rows in a file (0: none).
    """
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn(CLASS, _class_of(start, end))
    own = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(CLASS) * 2)
    rows = rows.withColumn(BIN, F.floor(F.col(start) / F.greatest(F.lit(bin_width).cast("long"), own)))
    order = [CLASS, *keys, start, end]
    dealt = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    # Folders first: the writer then keeps one file open at a time and need not sort again.
    sorted_ = dealt.sortWithinPartitions(CLASS, BIN, *keys, start, end)
    sorted_.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(CLASS, BIN).parquet(f"{path}/rows")
    spark = df.sparkSession
    levels = spark.read.schema(rows.schema).parquet(f"{path}/rows").select(CLASS).distinct()
    layout = levels.groupBy().agg(F.sort_array(F.collect_set(CLASS)).alias("classes")).select(
        "classes", F.lit(bin_width).cast("long").alias("bin_width"), F.array(*(F.lit(k) for k in keys)).cast("array<string>").alias("keys"),
        F.lit(start).alias("start"), F.lit(end).alias("end"), F.lit(rows.schema.json()).alias("schema"))
    layout.coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")


@dataclass(frozen=True)
class Regions:
    """A table written by :func:`write_regions`."""

    rows: DataFrame
    keys: tuple[str, ...]
    start: str
    end: str
    bin_width: int
    classes: tuple[int, ...]

    def _meets(self, key_values: Sequence, a: int, b: int) -> Column:
        start = F.col(self.start)
        found = F.lit(False)
        for level in self.classes:
            width, longest = _width(self.bin_width, level), 4 ** level
            low = a - longest
            found = found | (
                (F.col(CLASS) == level) & F.col(BIN).between(low // width, (b - 1) // width) & (start > low) & (start < b))
        own = F.lit(True)
        for name, value in zip(self.keys, key_values):
            own = own & (F.col(name) == F.lit(value))
        return own & found & (F.col(self.end) > a) & (start < b)

    def lookup(self, *regions: tuple) -> DataFrame:
        """Rows that meet any of the regions ``(*key values, from, to)``, each row once."""
        if not regions:
            return self.rows.where(F.lit(False)).drop(CLASS, BIN)
        found = F.lit(False)
        for *key_values, a, b in regions:
            if len(key_values) != len(self.keys):
                raise ValueError(f"a region has the keys {self.keys}")
            found = found | self._meets(key_values, a, b) if a < b else found
        return self.rows.where(found).drop(CLASS, BIN)


def read_regions(spark: SparkSession, path: str) -> Regions:
    layout = spark.read.parquet(f"{path}/layout").first()
    rows = spark.read.schema(StructType.fromJson(json.loads(layout.schema))).parquet(f"{path}/rows")
    return Regions(rows, tuple(layout["keys"]), layout.start, layout.end, layout.bin_width, tuple(layout.classes))


def write_keyed(df: DataFrame, key: str, path: str, partitions: int | None = None) -> None:
    """A table of values by key: dealt by range of the key and sorted, so that a file holds one stretch of keys."""
    dealt = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
    dealt.sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def read_keyed(spark: SparkSession, path: str, key: str, wanted: Sequence | DataFrame | None = None) -> DataFrame:
    """All rows, those of some literal keys (only the row groups that may hold them are read), or those whose key is in a table."""
    rows = spark.read.parquet(path)
    if wanted is None:
        return rows
    if isinstance(wanted, DataFrame):
        return rows.join(wanted.select(key), key, "left_semi")
    return rows.where(F.col(key).isin(list(wanted)))
