"""Building a feature annotation by chaining repeat fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.scan import numbered, tile_of
from strandloom.session import discard, written

CHAIN = ["chrom", "start", "end", "name", "element", "label", "strand"]


def family_pairs(families: DataFrame) -> DataFrame:
    """``name, partner`` in both directions from ``int_name`` (``X-int``) and ``ltrs`` (comma list)."""
    rows = families.select(
        F.regexp_extract("int_name", "(.+)-int", 1).alias("name"), F.explode(F.split("ltrs", ",")).alias("partner")
    )
    return rows.union(rows.select(F.col("partner").alias("name"), F.col("name").alias("partner"))).distinct()


def repeat_elements(bed: DataFrame) -> DataFrame:
    """Roll fragments up to elements: name, part counts, total length, span, strand and label.

    ``bed``: ordinal, chrom, start, end, name, strand, group, class, element. STR has
    internal and LTR parts, LEN is longer than 1000 bases, PART is the rest.
    """
    ervk = bed.filter(F.col("class").contains("ERVK"))
    cleaned = F.regexp_replace("name", "#.+", "")
    cleaned = F.replace(cleaned, F.concat(F.col("group"), F.lit("|")), F.lit(""))
    rows = ervk.withColumn("clean", cleaned).withColumn(
        "kind",
        F.when(F.col("clean").rlike("(.+)-int"), "INT").when(F.col("clean").contains("LTR"), "LTR").otherwise("Other"),
    )
    rows = rows.withColumn(
        "base", F.when(F.col("kind") == "INT", F.regexp_extract("clean", "(.+)-int", 1)).otherwise(F.col("clean"))
    )
    at = F.col("ordinal")
    rolled = rows.groupBy("element").agg(
        F.coalesce(
            F.max_by("base", F.when(F.col("kind") == "INT", at)), F.min_by("base", at)
        ).alias("name"),
        F.count(F.when(F.col("kind") == "INT", 1)).alias("ints"),
        F.count(F.when(F.col("kind") == "LTR", 1)).alias("ltrs"),
        F.count(F.when(F.col("kind") == "Other", 1)).alias("others"),
        F.sum(F.col("end") - F.col("start")).alias("length"),
        F.max_by("chrom", at).alias("chrom"),
        F.min_by("start", at).alias("start"),
        F.max_by("end", at).alias("end"),
        F.max_by("strand", at).alias("strand"),
    )
    return rolled.withColumn(
        "label",
        F.when((F.col("ints") > 0) & (F.col("ltrs") > 0), "STR").when(F.col("length") > 1000, "LEN").otherwise("PART"),
    )


def _fitting(elements: DataFrame, families: DataFrame) -> DataFrame:
    """``name, other, fits``: which names hold a partner of ``name``; names are few, elements many."""
    names = elements.select("name").distinct()
    pairs = names.join(families, "name").join(names.select(F.col("name").alias("other")), F.expr("contains(other, partner)"))
    return pairs.select("name", "other").distinct().withColumn("fits", F.lit(True))


def _beside(acting: DataFrame, elements: DataFrame, windows: list[int]) -> DataFrame:
    """Each acting element with itself (step 0) and the ``window`` elements before and after it on the chromosome.

    Places are dealt in blocks of four windows. An acting element goes to its own block only, the others to the one or two
    blocks that they are in reach of, for each of the ``windows`` in use; so rows travel once or twice and not once per place looked at,
    and what stands beside an element is in one task.
    """
    block = 4 * F.col("window")
    own = [c for c in ("chrom", "place", "element", "name", "start", "end", "window", "several") if c in acting.columns]
    wanted = acting.select(*own, F.floor(F.col("place") / block).alias("_block"))
    other = elements.select(
        "chrom", F.col("place").alias("_near"), F.col("element").alias("other_element"), F.col("name").alias("other"),
        F.col("start").alias("other_start"), F.col("end").alias("other_end"), "taker", F.explode(F.array(*map(F.lit, windows))).alias("window"),
    )
    reached = F.sequence(F.floor((F.col("_near") - F.col("window")) / block), F.floor((F.col("_near") + F.col("window")) / block))
    met = wanted.join(other.withColumn("_block", F.explode(reached)), ["chrom", "window", "_block"])
    return met.withColumn("step", F.col("_near") - F.col("place")).where(F.abs("step") <= F.col("window"))


def _taken(rows: DataFrame, max_gap: int, keys: list[str]) -> DataFrame:
    """The rows of ``_beside`` that each acting element takes in, itself included; ``more`` marks a side that goes on.

    ``rows`` has ``free`` and ``fits``; ``keys`` tell the acting elements apart. The gap before a neighbour runs from the far edge of the last one taken in
    (the element's own edge at first); a free neighbour with a gap that is negative or too wide ends the side.
    """
    side = F.signum("step")
    order = Window.partitionBy(*keys, side).orderBy(F.abs("step"))
    right = F.col("step") > 0
    near = F.when(right, F.col("other_start")).otherwise(-F.col("other_end"))
    far = F.when(right, F.col("other_end")).otherwise(-F.col("other_start"))
    own = F.when(right, F.col("end")).otherwise(-F.col("start"))
    joins = F.col("free") & F.col("fits")
    edge = F.last(F.when(joins, far), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = near - F.coalesce(edge, own)
    rows = rows.withColumn("_ends", F.col("free") & (F.col("step") != 0) & ((gap < 0) | (gap > max_gap)))
    rows = rows.withColumn("_open", ~F.max("_ends").over(order))
    return rows.select(
        "element", "other_element", "other_start", "other_end", ((F.col("step") == 0) | (F.col("_open") & joins)).alias("taken"),
        (F.col("_open") & (F.abs("step") == F.col("window"))).alias("more"),
    ).where("taken or more")


def chain_repeats(elements: DataFrame, families: DataFrame, max_gap: int = 500, window: int = 4) -> DataFrame:
    """Chain elements of compatible families at most ``max_gap`` bases apart.

    ``families``: name, partner. By rising ``element``, each labelled element that is left takes in fitting neighbours on
    both sides; what it takes is gone for later ones.

    The order is settled in rounds over all chromosomes at once. In a round, every labelled element acts on what those of smaller
    id left it in the round before. A decision depends on smaller ids only: the first round settles the smallest of
    each crowd, the next one what depends on those alone, and when a round changes nothing the result is that of the sequential order.
    An element looks at ``window`` places on either side, and at four times as many where a side does not end within
    them, so rows grow with what is taken in and not with the square of a crowd. Elements without a name or chromosome
    fit nothing and keep to themselves.
    """
    known = written(numbered(elements.select(*CHAIN), ["chrom"], ["element"], tile_of("element", 1 << 16), "place"), "elements")
    # An id that comes once has all its rows in its block, where they stay; those of a repeated id are brought together.
    repeated = known.groupBy("element").count().where("count > 1 OR element IS NULL").select(F.col("element").alias("_id"), F.lit(True).alias("several"))
    apart = not repeated.isEmpty()
    if apart:
        known = known.join(repeated, F.col("element").eqNullSafe(F.col("_id")), "left").drop("_id")
        known = written(known.withColumn("several", F.coalesce("several", F.lit(False))), "elements")
    fits = written(_fitting(known, families), "fits")
    labelled = known.where("label <> 'PART'").withColumn("window", F.lit(window))
    windows, before, wide = [window], None, False
    while True:
        if before is None:
            acting, others = labelled, known.withColumn("taker", F.lit(None).cast("long"))
        else:
            if wide:
                wider = before.where("more").select("element", F.lit(True).alias("_wider")).distinct()
                grown = labelled.join(wider, "element", "left").withColumn("window", F.when(F.col("_wider"), F.col("window") * 4).otherwise(F.col("window")))
                labelled = written(grown.drop("_wider"), "labelled")
                windows = [r["window"] for r in labelled.select("window").distinct().collect()]
            takers = before.where("taken").groupBy(F.col("other_element").alias("element")).agg(F.min("element").alias("taker"))
            others = known.join(takers, "element", "left")
            acting = labelled.join(takers, "element", "left").where(F.coalesce(F.col("taker") >= F.col("element"), F.lit(True)))
        rows = _beside(acting, others, windows).join(fits, ["name", "other"], "left")
        rows = rows.withColumns({"fits": F.coalesce("fits", F.lit(False)), "free": F.coalesce(F.col("taker") >= F.col("element"), F.lit(True))})
        single = _taken(rows.where("NOT several") if apart else rows, max_gap, ["chrom", "window", "_block", "element"])
        now = written(single.union(_taken(rows.where("several"), max_gap, ["element"])) if apart else single, "taken")
        wide = not now.where("more").isEmpty()
        if before is not None:
            key = ["element", "other_element"]
            old, new = before.where("taken").select(*key), now.where("taken").select(*key)
            if not wide and old.count() == new.count() and new.join(old, key, "left_anti").isEmpty():
                break
            discard(before)
        before = now
    spans = now.where("taken").groupBy("element").agg(F.min("other_start").alias("start"), F.max("other_end").alias("end"))
    return known.select("chrom", "name", "element", "label", "strand").join(spans, "element").select(*CHAIN)


def _drawn(side: str, extension: int, seed: int):
    """A number below ``extension`` from the md5 of element, seed and side."""
    text = F.concat_ws(":", F.col("element").cast("string"), F.lit(str(seed)), F.lit(side))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % extension


def extended(chains: DataFrame, extension: int = 300, seed: int = 12345) -> DataFrame:
    """Widen both sides by a pseudo-random length below ``extension``, fixed by seed and element."""
    left, right = _drawn("left", extension, seed), _drawn("right", extension, seed)
    return chains.withColumns(
        {"start": F.greatest(F.lit(0), F.col("start") - left), "end": F.col("end") + right}
    )


def annotation_id():
    return F.concat_ws(":", "name", "element", "label")


def as_bed(chains: DataFrame, strip: str = "GRCh38#0#") -> DataFrame:
    return chains.select(
        F.replace("chrom", F.lit(strip), F.lit("")).alias("chrom"), "start", "end",
        annotation_id().alias("name"), F.lit(".").alias("score"), "strand",
    )


def as_gtf(chains: DataFrame, strip: str = "GRCh38#0#") -> DataFrame:
    ident = annotation_id()
    return chains.select(
        F.replace("chrom", F.lit(strip), F.lit("")).alias("chrom"), F.lit("simulate").alias("source"),
        F.lit("gene").alias("feature"), "start", "end", F.lit(".").alias("score"), "strand",
        F.lit(".").alias("frame"), F.format_string('gene_id "%s"; locus "%s"', ident, ident).alias("attributes"),
    )
