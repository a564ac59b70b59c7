"""Column functions on graph paths. All are JVM expressions; none shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.model import SRC_BOTH, SRC_MATE1, SRC_MATE2, SRC_STEPS, STEPS


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Inside a higher-order function an expression from outside is evaluated again for
    every element; bound to a variable it is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def signed_nodes(path: Column) -> Column:
    """``>12<13`` -> ``[12, -13]``."""
    tokens = F.regexp_extract_all(path, F.lit("([<>])([0-9]+)"), F.lit(0))
    return F.transform(
        tokens,
        lambda t: F.when(F.substring(t, 1, 1) == ">", F.substring(t, 2, 20).cast("long")).otherwise(
            -F.substring(t, 2, 20).cast("long")
        ),
    )


def opposite_strand(nodes: Column) -> Column:
    """The same walk read from its other end."""
    return F.reverse(F.transform(nodes, lambda n: -n))


def node_span(*paths: Column) -> Column:
    """``struct(start0, end)``: smallest node id minus one, and largest node id."""
    ids = F.transform(F.concat(*paths), F.abs)
    return F.struct(
        (F.array_min(ids) - 1).alias("start0"), F.array_max(ids).alias("end")
    )


def suffix_prefix(a: Column, b: Column) -> Column:
    """Length of the longest suffix of ``a`` that is a prefix of ``b`` (0 when none)."""

    def longest(p):
        x, y = p["a"], p["b"]
        shorter = F.least(F.size(x), F.size(y))
        sizes = F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>"))
        fits = F.filter(sizes, lambda k: F.slice(x, F.size(x) - k + 1, k) == F.slice(y, F.lit(1), k))
        return F.coalesce(F.array_max(fits), F.lit(0))

    return let(F.struct(a.alias("a"), b.alias("b")), longest)


def parse_steps(text: Column) -> Column:
    """``id,len,head,tail;...`` with signed ids -> array of steps; ``*`` and NULL give NULL."""
    items = F.transform(F.split(text, ";"), lambda p: F.split(p, ","))
    steps = F.transform(
        items,
        lambda p: F.struct(
            F.abs(p[0].cast("long")).alias("node"),
            F.when(p[0].cast("long") > 0, 1).otherwise(-1).alias("dir"),
            p[1].cast("long").alias("len"),
            p[2].cast("long").alias("head"),
            p[3].cast("long").alias("tail"),
        ),
    )
    return F.when(text.isNotNull() & (text != "*"), steps).cast(STEPS)


def parse_completed(text: Column) -> Column:
    """``id,dir,len,head,tail,src;...`` -> array of steps with source; an empty source is 0."""
    items = F.transform(F.split(text, ";"), lambda p: F.split(p, ","))
    steps = F.transform(
        items,
        lambda p: F.struct(
            p[0].cast("long").alias("node"),
            p[1].cast("int").alias("dir"),
            p[2].cast("long").alias("len"),
            p[3].cast("long").alias("head"),
            p[4].cast("long").alias("tail"),
            F.when(p[5] == "", 0).otherwise(p[5].cast("int")).alias("src"),
        ),
    )
    return steps.cast(SRC_STEPS)


def parse_feature_nodes(text: Column) -> Column:
    """``(=|+|-)id,len,start,end;...`` -> array of steps; ``=`` is undirected (dir 0)."""
    items = F.transform(F.split(text, ";"), lambda p: F.split(p, ","))
    steps = F.transform(
        items,
        lambda p: F.struct(
            F.substring(p[0], 2, 20).cast("long").alias("node"),
            F.when(F.substring(p[0], 1, 1) == "+", 1)
            .when(F.substring(p[0], 1, 1) == "-", -1)
            .otherwise(0)
            .alias("dir"),
            p[1].cast("long").alias("len"),
            p[2].cast("long").alias("head"),
            p[3].cast("long").alias("tail"),
        ),
    )
    return steps.cast(STEPS)


def parse_haplotypes(text: Column) -> Column:
    """``hap:start-end#dir;...`` -> array of spans; unreadable items are dropped."""
    pattern = r"^(.+):(\d+)-(\d+)#([-+])"
    parts = F.transform(
        F.split(text, ";"),
        lambda h: F.struct(
            F.regexp_extract(h, pattern, 1).alias("hap"),
            F.regexp_extract(h, pattern, 2).try_cast("long").alias("start"),
            F.regexp_extract(h, pattern, 3).try_cast("long").alias("end"),
            F.when(F.regexp_extract(h, pattern, 4) == "+", 1).otherwise(-1).alias("dir"),
        ),
    )
    return F.filter(parts, lambda s: s["start"].isNotNull())


def render_steps(steps: Column) -> Column:
    """Inverse of :func:`parse_steps`."""
    return F.array_join(
        F.transform(
            steps,
            lambda s: F.concat_ws(",", (s["node"] * s["dir"]).cast("string"), s["len"], s["head"], s["tail"]),
        ),
        ";",
    )


def render_completed(steps: Column) -> Column:
    """Inverse of :func:`parse_completed`."""
    return F.array_join(
        F.transform(
            steps,
            lambda s: F.concat_ws(",", s["node"], s["dir"], s["len"], s["head"], s["tail"], s["src"]),
        ),
        ";",
    )


def last_per_node(steps: Column) -> Column:
    """Keep the last step of every node, as a map keyed by node would."""

    def kept(every):
        def latest(nodes):
            last = F.filter(every, lambda s, i: ~F.array_contains(F.slice(nodes, i + 2, F.size(nodes)), s["node"]))
            return F.when(F.size(F.array_distinct(nodes)) < F.size(nodes), last).otherwise(every)

        return let(F.transform(every, lambda s: s["node"]), latest)

    return let(steps, kept)


def span_overlap(length: Column, head_a: Column, tail_a: Column, head_b: Column, tail_b: Column) -> Column:
    """Shared bases of two ``[head, len - tail)`` spans on one node."""
    return F.greatest(
        F.lit(0).cast("long"),
        F.least(length - tail_a, length - tail_b) - F.greatest(head_a, head_b),
    )


def covered_bases(steps: Column) -> Column:
    """Bases a path covers."""
    return F.aggregate(
        steps, F.lit(0).cast("long"), lambda acc, s: acc + s["len"] - s["head"] - s["tail"]
    )


def tag_source(steps: Column, src: int) -> Column:
    return F.transform(steps, lambda s: s.withField("src", F.lit(src))).cast(SRC_STEPS)


def join_overlapping_mates(mate1: Column, mate2: Column, overlap: Column) -> Column:
    """Merge two mates that share their last/first ``overlap`` nodes.

    On a shared node the smaller uncovered head and tail win. Returns the merged steps.
    """
    n1 = F.size(mate1)
    alone1 = F.slice(mate1, F.lit(1), F.greatest(n1 - overlap, F.lit(0)))
    tail1 = F.slice(mate1, F.greatest(n1 - overlap, F.lit(0)) + 1, overlap)
    head2 = F.slice(mate2, F.lit(1), overlap)
    rest2 = F.slice(mate2, overlap + 1, F.size(mate2))
    shared = F.zip_with(
        tail1,
        head2,
        lambda a, b: F.struct(
            a["node"].alias("node"),
            a["dir"].alias("dir"),
            a["len"].alias("len"),
            F.least(a["head"], b["head"]).alias("head"),
            F.least(a["tail"], b["tail"]).alias("tail"),
            F.lit(SRC_BOTH).alias("src"),
        ),
    ).cast(SRC_STEPS)
    return F.concat(tag_source(alone1, SRC_MATE1), shared, tag_source(rest2, SRC_MATE2))


def id_chunks(ids: Column, step: int = 100) -> Column:
    """Cut the sorted distinct ids of one path where neighbours differ by ``step`` or more.

    Returns ``array<struct<start0,end>>`` with start0 = first id - 1.
    """
    kind = "struct<done:array<struct<start0:bigint,end:bigint>>,start0:bigint,end:bigint>"
    ordered = F.array_sort(F.array_distinct(F.transform(ids, F.abs)))
    empty = F.array().cast("array<struct<start0:bigint,end:bigint>>")

    def closed(acc):
        return F.concat(acc["done"], F.array(F.struct(acc["start0"].alias("start0"), acc["end"].alias("end"))))

    def grow(acc, x):
        fresh = F.struct(empty.alias("done"), (x - 1).alias("start0"), x.alias("end")).cast(kind)
        longer = F.struct(acc["done"].alias("done"), acc["start0"].alias("start0"), x.alias("end")).cast(kind)
        cut = F.struct(closed(acc).alias("done"), (x - 1).alias("start0"), x.alias("end")).cast(kind)
        return F.when(acc["end"].isNull(), fresh).when(x - acc["end"] < step, longer).otherwise(cut)

    start = F.struct(
        empty.alias("done"), F.lit(None).cast("long").alias("start0"), F.lit(None).cast("long").alias("end")
    ).cast(kind)
    return F.aggregate(
        ordered, start, grow, lambda acc: F.when(acc["end"].isNull(), empty).otherwise(closed(acc))
    )


def other_chunks(chunks: Column, index: Column) -> Column:
    """Every chunk but the one at ``index`` (from 0), as ``s,e;s,e``; NULL when there is no other."""
    rest = F.filter(
        F.transform(chunks, lambda c, i: F.when(i != index, F.concat_ws(",", c["start0"], c["end"]))),
        lambda s: s.isNotNull(),
    )
    return F.when(F.size(rest) > 0, F.array_join(rest, ";"))


def project_to_linear(lin_start: Column, lin_end: Column, head: Column, tail: Column) -> Column:
    """One-based linear positions of the covered head and tail of a node.

    ``lin_start > lin_end`` means the node lies on the reverse strand of the chromosome.
    """
    sign = F.when(lin_start < lin_end, 1).otherwise(-1)
    return F.struct(
        (lin_start + sign * (head + 1)).alias("head_pos"), (lin_end - sign * tail).alias("tail_pos")
    )


def unit_ids(step: Column, width: int = 20) -> Column:
    """Cut the covered part of a node into units of ``width`` bases: ``node:index``.

    Nodes of 11..width bases are one unit; shorter nodes give none. Units follow
    the direction of the walk.
    """
    first = F.floor(step["head"] / width).cast("long")
    count = F.floor((step["len"] - (first - 1) * width - step["tail"]) / width).cast("long")
    signed = step["node"] * step["dir"]
    many = F.transform(
        F.when(count > 0, F.sequence(first, first + count - 1)).otherwise(F.array().cast("array<bigint>")),
        lambda i: F.concat_ws(":", signed, i),
    )
    many = F.when(step["dir"] < 0, F.reverse(many)).otherwise(many)
    none = F.array().cast("array<string>")
    return (
        F.when(step["len"] > width, many)
        .when(step["len"] > 10, F.array(signed.cast("string")))
        .otherwise(none)
    )
