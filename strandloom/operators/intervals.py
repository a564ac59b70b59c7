"""Interval operators: islands, breaks, id ranges, depth and range joins.

Intervals are half-open ``[start, end)`` on integer coordinates unless stated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.scan import prefix_scan, tile_of
from strandloom.session import cut_lineage

DEFAULT_TILE = 1 << 16


def _starts(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """One row per distinct start, so that piled-up intervals collapse before the shuffle."""
    return df.groupBy(*keys, F.col(start).alias("_s")).agg(
        F.max(end).alias("_e"), F.count(F.lit(1)).alias("_n")
    )


def _flagged_starts(df, keys, start, end, gap, tile_width):
    starts = _starts(df, keys, start, end)
    if tile_width is None:
        before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        reach = F.max("_e").over(before)
        opens = reach.isNull() | (F.col("_s") > reach + gap)
        return starts.withColumn("_open", F.when(opens, F.col("_s")))
    scanned = prefix_scan(starts, keys, ["_s"], tile_of("_s", tile_width), {"_reach": ("max", "_e")})
    opens = F.col("_reach").isNull() | (F.col("_s") > F.col("_reach") + gap)
    return scanned.withColumn("_open", F.when(opens, F.col("_s")))


def _labelled_starts(df, keys, start, end, gap, tile_width):
    flagged = _flagged_starts(df, keys, start, end, gap, tile_width)
    if tile_width is None:
        upto = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
        return flagged.withColumn("island_start", F.max("_open").over(upto))
    scanned = prefix_scan(flagged, keys, ["_s"], tile_of("_s", tile_width), {"_prior": ("max", "_open")})
    return scanned.withColumn("island_start", F.coalesce("_open", "_prior"))


def labelled_starts(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: int = 0, tile_width: int | None = DEFAULT_TILE) -> DataFrame:
    """One row per distinct start (``keys, _s, _e, _n, island_start``): furthest end, rows, and the start of its island."""
    return _labelled_starts(df, keys, start, end, gap, tile_width).select(*keys, "_s", "_e", "_n", "island_start")


def merged_spans(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    gap: int = 0,
    tile_width: int | None = DEFAULT_TILE,
) -> DataFrame:
    """Merge intervals whose start lies at most ``gap`` after everything before them.

    Returns ``keys, island_start, island_end, members``. ``tile_width=None`` uses a
    plain window; choose it only where the coordinate itself is short, such as
    positions inside one node, because equal starts are collapsed first.
    """
    labelled = _labelled_starts(df, keys, start, end, gap, tile_width)
    return labelled.groupBy(*keys, "island_start").agg(
        F.max("_e").alias("island_end"), F.sum("_n").alias("members")
    )


def with_islands(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    gap: int = 0,
    tile_width: int = DEFAULT_TILE,
) -> DataFrame:
    """Label every row with the start of the island it belongs to."""
    labels = _labelled_starts(df, keys, start, end, gap, tile_width).select(
        *keys, F.col("_s").alias(start), "island_start"
    )
    return df.join(labels, [*keys, start], "left")


def uncovered_breaks(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    running: bool = True,
    tile_width: int = DEFAULT_TILE,
) -> DataFrame:
    """Stretches between intervals sorted by start that no interval covers.

    Coordinates follow the ``(start, end]`` id convention: a break exists when
    ``start + 1`` passes the previous end. ``running`` compares with the largest
    end so far; otherwise with the end of the row just before.
    """
    if running:
        scanned = prefix_scan(
            _starts(df, keys, start, end), keys, ["_s"], tile_of("_s", tile_width),
            {"break_from": ("max", "_e")},
        )
    else:
        # Equal intervals cannot open a break after each other.
        rows = df.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e")).distinct()
        scanned = prefix_scan(
            rows, keys, ["_s", "_e"], tile_of("_s", tile_width), {"break_from": ("previous", "_e")}
        )
    return scanned.filter(F.col("_s") + 1 > F.col("break_from")).select(
        *keys, "break_from", (F.col("_s") + 1).alias("break_to")
    )


def id_ranges(
    df: DataFrame, keys: Sequence[str], id_col: str, step: int = 10, tile_width: int = DEFAULT_TILE
) -> DataFrame:
    """Group ids into ranges while neighbours differ by less than ``step``: (min - 1, max)."""
    point = df.select(*keys, F.col(id_col).alias("_id"))
    spans = merged_spans(point.withColumn("_to", F.col("_id")), keys, "_id", "_to", step - 1, tile_width)
    return spans.select(
        *keys,
        (F.col("island_start") - 1).alias("range_start"),
        F.col("island_end").alias("range_end"),
    )


# --------------------------------------------------------------------------- depth


def _depth_steps(df, keys, start, end):
    """Net depth change per position, combined map-side."""
    edges = df.filter(F.col(start) < F.col(end)).select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col(start).alias("pos"), F.lit(1).cast("long").alias("delta")),
                F.struct(F.col(end).alias("pos"), F.lit(-1).cast("long").alias("delta")),
            )
        ),
    )
    return edges.groupBy(*keys, "pos").agg(F.sum("delta").alias("delta"))


def depth_segments(
    df: DataFrame, keys: Sequence[str], start: str, end: str, tile_width: int = DEFAULT_TILE
) -> DataFrame:
    """Piecewise constant depth: ``keys, seg_start, seg_end, depth`` including zero-depth gaps.

    At a breakpoint the sum of all earlier changes is the depth of the stretch that
    ends there, so one scan yields both ends and the depth.
    """
    steps = _depth_steps(df, keys, start, end)
    scanned = prefix_scan(
        steps, keys, ["pos"], tile_of("pos", tile_width), {"depth": ("sum", "delta"), "seg_start": ("previous", "pos")}
    )
    return scanned.filter(F.col("seg_start").isNotNull()).select(
        *keys, "seg_start", F.col("pos").alias("seg_end"), "depth"
    )


def pileup_totals(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Covered positions, summed depth and peak depth per key."""
    seg = depth_segments(df, keys, start, end).withColumn("w", F.col("seg_end") - F.col("seg_start"))
    return seg.groupBy(*keys).agg(
        F.sum(F.when(F.col("depth") > 0, F.col("w")).otherwise(0)).alias("covered"),
        F.sum(F.col("w") * F.col("depth")).alias("total_depth"),
        F.max("depth").alias("peak_depth"),
    )


def _excess_upto(df, keys, start, end, max_depth, tile_width):
    """Per breakpoint, the number of positions before it deeper than ``max_depth``."""
    steps = _depth_steps(df, keys, start, end)
    tile = tile_of("pos", tile_width)
    scanned = prefix_scan(steps, keys, ["pos"], tile, {"depth": ("sum", "delta"), "from": ("previous", "pos")})
    deep = F.when(F.col("depth") > max_depth, F.col("pos") - F.col("from")).otherwise(0)
    marked = scanned.select(*keys, "pos", deep.alias("deep"))
    summed = prefix_scan(marked, keys, ["pos"], tile, {"excess": ("sum", "deep")})
    return summed.select(*keys, "pos", (F.col("excess") + F.col("deep")).alias("excess"))


def over_depth(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    max_depth: int,
    tile_width: int = DEFAULT_TILE,
    flag: str = "too_deep",
) -> DataFrame:
    """Flag every interval that touches a position deeper than ``max_depth``.

    Both ends of an interval are breakpoints of the depth profile, so two equality
    lookups of the running excess answer the question; no interval is compared
    with any other.
    """
    excess = _excess_upto(df, keys, start, end, max_depth, tile_width)
    at_start = excess.select(*keys, F.col("pos").alias(start), F.col("excess").alias("_x0"))
    at_end = excess.select(*keys, F.col("pos").alias(end), F.col("excess").alias("_x1"))
    return (
        df.join(at_start, [*keys, start], "left")
        .join(at_end, [*keys, end], "left")
        .withColumn(flag, F.coalesce(F.col("_x1") > F.col("_x0"), F.lit(False)))
        .select(*df.columns, flag)
    )


# ---------------------------------------------------------------------- range join


def _level(start: str, end: str) -> Column:
    """Bins of a level are at least as wide as the interval (widths are powers of four)."""
    width = F.greatest(F.col(end) - F.col(start), F.lit(1))
    return F.ceil(F.log2(width.cast("double")) / 2).cast("int")


def _bin_width(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), level * 2)


def _binned(df, start, end, other_levels):
    own = df.withColumn("_own", _level(start, end))
    wanted = F.array(*[F.lit(v) for v in other_levels]) if other_levels else F.array().cast("array<int>")
    # The own level serves to meet intervals that are no longer; without such on the other side it meets nothing.
    longer = F.filter(wanted, lambda v: v > F.col("_own"))
    least = min(other_levels, default=None)
    levels = longer if least is None else F.when(F.col("_own") >= least, F.concat(F.array("_own"), longer)).otherwise(longer)
    spread = own.withColumn("_lvl", F.explode(levels))
    size = _bin_width(F.col("_lvl"))
    bins = F.sequence(
        F.floor(F.col(start) / size), F.floor((F.greatest(F.col(end), F.col(start) + 1) - 1) / size)
    )
    return spread.withColumn("_bin", F.explode(bins))


def _levels_in_use(left, left_span, right, right_span):
    """Distinct bin levels of both sides; at most 32 values each, whatever the row count."""
    sides = left.select(F.lit("l").alias("side"), _level(*left_span).alias("v")).union(
        right.select(F.lit("r").alias("side"), _level(*right_span).alias("v"))
    )
    rows = sides.distinct().collect()
    return [sorted(r.v for r in rows if r.side == side) for side in ("l", "r")]


def range_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    how: str = "inner",
    left_id: Sequence[str] | None = None,
) -> DataFrame:
    """Join intervals that overlap within equal ``keys``.

    Every interval sits in bins as wide as itself, and two intervals meet at the
    level of the longer one, so neither long intervals nor mixed lengths
    multiply rows: each side is emitted at most twice per level in use. The pair
    is kept only in the first bin both share, hence exactly once.
    ``how='left'`` needs ``left_id``, columns that identify a left row.
    """
    keys = list(keys)
    (ls, le), (rs, re_) = left_span, right_span
    l_levels, r_levels = _levels_in_use(left, left_span, right, right_span)
    a = _binned(left, ls, le, r_levels).withColumnRenamed("_own", "_lown")
    b = _binned(right, rs, re_, l_levels).withColumnRenamed("_own", "_rown")
    hit = (
        (F.col(ls) < F.col(re_))
        & (F.col(rs) < F.col(le))
        & (F.col("_lvl") == F.greatest("_lown", "_rown"))
        & (F.col("_bin") == F.floor(F.greatest(F.col(ls), F.col(rs)) / _bin_width(F.col("_lvl"))))
    )
    value_cols = [c for c in right.columns if c not in keys]
    pairs = a.join(b, [*keys, "_lvl", "_bin"]).filter(hit).select(*left.columns, *value_cols)
    if how == "inner":
        return pairs
    if how != "left" or not left_id:
        raise ValueError("how must be 'inner', or 'left' with left_id")
    # Kept, so that the misses do not compute the pairs a second time.
    pairs = cut_lineage(pairs)
    missed = left.join(pairs.select(*left_id), list(left_id), "left_anti")
    return pairs.unionByName(missed, allowMissingColumns=True)


def feature_pileup(
    reads: DataFrame,
    features: DataFrame,
    keys: Sequence[str],
    read_span: tuple[str, str],
    feature_span: tuple[str, str],
    read: str,
    feature: str,
) -> DataFrame:
    """Depth of reads inside every feature's span, and how many reads contribute."""
    (s, e), (fs, fe) = read_span, feature_span
    met = range_join(
        reads.select(*keys, s, e, read), features.select(*keys, fs, fe, feature), keys, read_span, feature_span
    ).select(feature, read, F.greatest(s, fs).alias("_from"), F.least(e, fe).alias("_to"))
    totals = pileup_totals(met, [feature], "_from", "_to")
    return totals.join(met.groupBy(feature).agg(F.count_distinct(read).alias("reads")), feature)
