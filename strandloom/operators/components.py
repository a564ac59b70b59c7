"""Connected components by contraction in random orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.session import discard, few_tasks, written


def _moves(edges: DataFrame, turn: int) -> DataFrame:
    """``u, to``: the vertex that comes first among each vertex and its neighbours, in an order drawn from ``turn``.

    The first turn goes by the vertices themselves, since links often lead to the least vertex of a group.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def drawn(vertex: str) -> Column:
        return F.struct((F.xxhash64(vertex, F.lit(turn)) if turn else F.lit(0).cast("long")).alias("h"), F.col(vertex).alias("x"))

    return both.groupBy("u").agg(F.min(drawn("v")).alias("d")).select("u", F.least("d", drawn("u"))["x"].alias("to"))


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``vertex, component`` for every vertex of an undirected edge list.

    The component is its smallest vertex. In a round every vertex moves to the one that comes first among itself and its
    neighbours, in an order drawn anew; edges move along, and equal edges become one. After the first round, which goes by the
    vertices, what is left shrinks by a constant factor a round, whatever the diameter, so all rounds together move a few times the edges. No vertex gathers its
    neighbours: hubs are only ever reduced by ``min``. The names come back from the last round to the first.
    """
    named = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    loops = named.filter("u = v").select("u").distinct()
    current = written(named.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    moves, most = [], []
    for turn in range(max_rounds):
        left = current.count()
        if not left:
            break
        # An edge has two vertices, so what follows is bounded: late rounds are small and need few tasks.
        most.append(2 * left)
        move = written(few_tasks(_moves(current, turn), 2 * left), "moves")
        moves.append(move)
        moved = current.join(move.withColumnRenamed("to", "_u"), "u").join(move.select(F.col("u").alias("v"), F.col("to").alias("_v")), "v")
        rest = moved.filter("_u <> _v").select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")).distinct()
        following = written(few_tasks(rest, left), "edges")
        discard(current)
        current = following
    else:
        raise RuntimeError("components did not settle")
    discard(current)
    alone = loops.select(F.col("u").alias("vertex"), F.col("u").alias("component"))
    if not moves:
        return alone
    # Where a vertex of each round ends up; the first round last, with the smallest vertex as the name.
    ends = None
    for move, rows in zip(reversed(moves[1:]), reversed(most[1:])):
        ends = move if ends is None else written(few_tasks(_followed(move, ends), rows), "ends")
    first = moves[0].groupBy("to").agg(F.min("u").alias("least"))
    roots = first.select(F.col("to").alias("u"), "to", "least")
    if ends is not None:
        roots = _followed(roots, ends)
    names = roots.groupBy("to").agg(F.min("least").alias("component"))
    known = moves[0].join(roots.join(names, "to").select(F.col("u").alias("to"), "component"), "to").select(F.col("u").alias("vertex"), "component")
    known = written(few_tasks(known, most[0]), "components")
    discard(*moves)
    return known.union(alone.join(known, "vertex", "left_anti"))


def _followed(move: DataFrame, ends: DataFrame) -> DataFrame:
    """``move`` with each ``to`` replaced by where that vertex ends up, if it went on."""
    onward = ends.select(F.col("u").alias("to"), F.col("to").alias("_end"))
    joined = move.join(onward, "to", "left")
    return joined.select(*(F.coalesce("_end", "to").alias("to") if c == "to" else c for c in move.columns))


def repeated_link_components(links: DataFrame, a: str, b: str, threshold: int = 3) -> DataFrame:
    """Components over pairs linked at least ``threshold`` times, in either order."""
    pair = links.filter(F.col(a) != F.col(b)).select(
        F.least(a, b).alias("u"), F.greatest(a, b).alias("v")
    )
    strong = pair.groupBy("u", "v").count().filter(F.col("count") >= threshold)
    return connected_components(strong, "u", "v")


def read_feature_groups(assign: DataFrame) -> DataFrame:
    """Features tied together by shared reads: ``feature, component``.

    Each feature of a read is linked to the read's least feature, so a read is neither a vertex nor expanded into pairs of features.
    """
    rows = assign.select(F.col("feature").cast("string").alias("feature"), F.col("read").cast("string").alias("read")).filter("feature IS NOT NULL AND read IS NOT NULL")
    links = rows.join(rows.groupBy("read").agg(F.min("feature").alias("least")), "read").select("feature", "least").distinct()
    return connected_components(written(links, "links"), "feature", "least").withColumnRenamed("vertex", "feature")
