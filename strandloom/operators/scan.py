"""Prefix aggregates that stay parallel when one key holds most of the rows.

A window over ``partitionBy(key)`` sends each key to a single task. The scans
here cut every key into tiles along the order, run the window inside a tile and
carry one summary row per tile across tiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import written

TILE = "_tile"

# Tiles that share one row of the level above when a scan has no key.
_FAN = 4096


def tile_of(column: str, width: int) -> Column:
    """Tile number of an integer coordinate; it never decreases along the coordinate."""
    return F.floor(F.col(column) / F.lit(width))


def _carry(summary: DataFrame, keys: list[str], kinds: dict[str, str], level: int = 0) -> DataFrame:
    """``_c_name`` of each tile: what the tiles before it add up to (``_t_name`` per tile).

    Without a key there is one row per tile in the whole input, so tiles are summed up twice more, ``_FAN`` to
    one, before a window sees all that is left.
    """
    def over(window: Window) -> list[Column]:
        before = window.rowsBetween(Window.unboundedPreceding, -1)
        same = {"sum": F.sum, "count": F.sum, "max": F.max}
        return [
            (F.last(f"_t_{name}", ignorenulls=True) if kind == "previous" else same[kind](f"_t_{name}")).over(before).alias(f"_c_{name}")
            for name, kind in kinds.items()
        ]

    if keys or level == 2:
        window = Window.partitionBy(*keys).orderBy(TILE) if keys else Window.orderBy(TILE)
        return summary.select(*keys, TILE, *over(window))
    rows = summary.withColumn("_above", F.floor(F.col(TILE) / _FAN))
    groups = rows.groupBy(F.col("_above").alias(TILE)).agg(*(
        (F.max_by(f"_t_{name}", TILE) if kind == "previous" else (F.max if kind == "max" else F.sum)(f"_t_{name}")).alias(f"_t_{name}")
        for name, kind in kinds.items()
    ))
    far = _carry(groups, keys, kinds, level + 1).select(F.col(TILE).alias("_above"), *(F.col(f"_c_{n}").alias(f"_f_{n}") for n in kinds))
    near = rows.select("_above", TILE, *over(Window.partitionBy("_above").orderBy(TILE)))
    joined = near.join(far, "_above")

    def both(name: str, kind: str) -> Column:
        own, other = F.col(f"_c_{name}"), F.col(f"_f_{name}")
        if kind == "max":
            return F.greatest(own, other)
        if kind == "previous":
            return F.coalesce(own, other)
        return F.coalesce(own + other, own, other)

    return joined.select(TILE, *(both(n, k).alias(f"_c_{n}") for n, k in kinds.items()))


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    tile: Column,
    outputs: dict[str, tuple[str, str]],
) -> DataFrame:
    """Add, per row, aggregates over the rows before it within its key.

    ``outputs`` maps a new column to ``(kind, column)`` where kind is one of
    ``sum``, ``count``, ``max`` or ``previous`` (the value of the row before).
    ``tile`` must not decrease along ``order``. The prefix is empty for the
    first row: sum and count give 0, max and previous give NULL.
    """
    keys, order = list(keys), list(order)
    rows = df.withColumn(TILE, tile)
    inside = Window.partitionBy(*keys, TILE).orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    totals, locals_, merged = [], {}, {}
    for name, (kind, column) in outputs.items():
        t, c, v = f"_t_{name}", f"_c_{name}", f"_v_{name}"
        if kind in ("sum", "count"):
            agg = F.sum(column) if kind == "sum" else F.count(column)
            local = (F.sum(column) if kind == "sum" else F.count(column)).over(before)
            totals.append(agg.alias(t))
            merged[name] = F.coalesce(F.col(v), F.lit(0)) + F.coalesce(F.col(c), F.lit(0))
        elif kind == "max":
            local = F.max(column).over(before)
            totals.append(F.max(column).alias(t))
            merged[name] = F.greatest(F.col(v), F.col(c))
        elif kind == "previous":
            local = F.lag(F.struct(column)).over(inside)
            # The last of the values by which rows are ordered is the largest one: a plain maximum needs no sort.
            last = F.struct(F.max(column).alias(column)) if order == [column] else F.max_by(F.struct(column), F.struct(*order))
            totals.append(last.alias(t))
            merged[name] = F.coalesce(F.col(v), F.col(c))[column]
        else:
            raise ValueError(f"unknown prefix aggregate {kind!r}")
        locals_[v] = local

    summary = rows.groupBy(*keys, TILE).agg(*totals)
    kinds = {name: kind for name, (kind, _) in outputs.items()}
    carry = _carry(summary, keys, kinds)
    # The windows come first: their rows are sorted by key and tile, so the join does not sort them once more.
    scanned = rows.withColumns(locals_).join(carry, [*keys, TILE], "left")
    return scanned.withColumns(merged).select(*df.columns, *outputs)


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], tile: Column, name: str = "n"
) -> DataFrame:
    """Row number (from 1) within ``keys`` along a total ``order``."""
    counted = prefix_scan(df.withColumn("_one", F.lit(1)), keys, order, tile, {name: ("count", "_one")})
    return counted.withColumn(name, (F.col(name) + 1).cast("long")).drop("_one")


def placing(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``df`` sorted along a total ``order`` with ``_at``, the partition and the row's number in it; to be stored before use."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())


def part_offsets(rows: DataFrame) -> DataFrame:
    """Rows before each partition of :func:`placing`: at most as many rows as the sort had tasks."""
    sizes = rows.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))


def joined_places(rows: DataFrame, offsets: DataFrame, name: str = "n") -> DataFrame:
    """Rows of :func:`placing` with their number from 1 in the whole input."""
    numbered_ = rows.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(offsets), "_part")
    return numbered_.select(*(c for c in rows.columns if c != "_at"), (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).alias(name))


def placed(df: DataFrame, order: Sequence[Column | str], name: str = "n") -> DataFrame:
    """Row number (from 1) along a total ``order`` over the whole input.

    Rows are dealt by range and numbered in their partition; one row per partition carries the offsets.
    """
    rows = written(placing(df, order), "placed")
    return joined_places(rows, part_offsets(rows), name)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float | None], tile_rows: int = 4096) -> DataFrame:
    """Quantiles of ``value`` per key by rank; no key's values gather in one buffer.

    ``wanted`` maps a column to a fraction (interpolated between neighbours) or to None, the element ``n div 2`` of the
    sorted values. Equal values are counted first; their running counts come from a scan over tiles of ``tile_rows``.
    A key without values has NULLs.
    """
    # A struct of the keys is never NULL itself, so a NULL key is a group like any other.
    rows = df.select(F.struct(*keys).alias("_key"), F.col(value).alias("_value"))
    counted = placed(rows.where(F.col("_value").isNotNull()).groupBy("_key", "_value").agg(F.count(F.lit(1)).alias("_size")), ["_key", "_value"], "_place")
    running = prefix_scan(counted, ["_key"], ["_place"], F.floor(F.col("_place") / tile_rows), {"_before": ("sum", "_size")})
    sizes = rows.groupBy("_key").agg(F.count("_value").alias("_n"))
    at = running.join(sizes, "_key")

    def element(rank: Column) -> Column:
        return F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_size")), F.col("_value")))

    columns = []
    for name, fraction in wanted.items():
        if fraction is None:
            columns.append(element(F.floor(F.col("_n") / 2)).alias(name))
            continue
        exact = F.lit(float(fraction)) * (F.col("_n") - 1)
        low, high = element(F.floor(exact)), element(F.ceil(exact))
        columns.append((low + F.max(exact - F.floor(exact)) * (high - low)).alias(name))
    found = at.groupBy("_key").agg(*columns)
    return sizes.join(found, "_key", "left").select(*(F.col(f"_key.{k}").alias(k) for k in keys), *wanted)
