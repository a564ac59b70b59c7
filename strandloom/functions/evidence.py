"""Alignment evidence: tags, identity, discordance, fragment bounds and score transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions.paths import let


def tag_map(tags: Column) -> Column:
    """``['AS:i:100', ...]`` -> map of tag name to value; the last duplicate wins."""
    names = F.transform(tags, lambda t: F.substring_index(t, ":", 1))
    direct = F.str_to_map(F.array_join(tags, "\t"), F.lit("\t"), F.lit(r":\w:"))

    def last_wins(p):
        rest = p["names"]
        kept = F.filter(p["tags"], lambda t, i: ~F.array_contains(F.slice(rest, i + 2, F.size(rest)), F.get(rest, i)))
        return F.str_to_map(F.array_join(kept, "\t"), F.lit("\t"), F.lit(r":\w:"))

    repeated = F.size(F.array_distinct(names)) < F.size(names)
    slow = let(F.struct(tags.alias("tags"), names.alias("names")), last_wins)
    return F.when(repeated, slow).otherwise(direct)


def matched_bases(cs: Column) -> Column:
    """Sum of the match lengths in a difference string (every ``:`` followed by digits)."""
    runs = F.regexp_extract_all(cs, F.lit(":([0-9]+)"), F.lit(1))
    return F.aggregate(runs, F.lit(0).cast("long"), lambda acc, r: acc + r.cast("long"))


def identity(cs: Column, read_len: Column) -> Column:
    return F.coalesce(matched_bases(cs), F.lit(0)) / read_len


def is_mapped(path: Column) -> Column:
    return path.rlike("[<>]")


def discordant(unmapped: Column, proper: Column, cs: Column, dv: Column) -> Column:
    """Discordance of one alignment; the first branch that applies decides.

    ``proper`` is the properly-paired tag (NULL when absent), ``dv`` the divergence tag.
    """
    lead = F.regexp_extract(cs, r"^\+([ATCGatcg]+)", 1)
    trail = F.regexp_extract(cs, r"\+([ATCGatcg]+)$", 1)
    return (
        F.when(unmapped, True)
        .when(F.coalesce(proper == 0, F.lit(False)), True)
        .when(lead != "", F.length(lead) > 20)
        .when(trail != "", F.length(trail) > 20)
        .when(dv.isNull(), True)
        .otherwise(dv > 0.2)
    )


def short_target(target_len: Column, read_len: Column, min_share: float = 0.9) -> Column:
    return target_len / read_len < min_share


def too_long_fragment(
    overlap: Column, rest1: Column, rest2: Column, node_len: Column, len1: Column, len2: Column, max_frag: int
) -> Column:
    """Whether the mates cannot come from one fragment of at most ``max_frag`` bases.

    ``rest`` is what the last/first node leaves uncovered between the mates; when
    both mates end on one node (overlap 1) that node is counted once. Longer
    overlaps are always acceptable.
    """
    reads = len1 + len2
    return (
        F.when(overlap == 1, rest1 + rest2 - node_len + reads > max_frag)
        .when(overlap == 0, rest1 + rest2 + reads > max_frag)
        .otherwise(False)
    )


def same_strand(a: Column, b: Column, library: int) -> Column:
    """Directions agree under a library type: 1 forward, -1 reverse, 0 unstranded."""
    return a * b * library >= 0


def mark_total(mark: Column) -> Column:
    """Number of alignments of the read: the leading integer of ``3-1-1``."""
    return F.split(mark, "-")[0].cast("long")


def mark_index(mark: Column) -> Column:
    """Value of the subtraction ``3-1-1``, from left to right."""
    parts = F.transform(F.split(mark, "-"), lambda p: p.cast("long"))
    return F.aggregate(
        F.slice(parts, F.lit(2), F.size(parts)), F.element_at(parts, 1), lambda acc, x: acc - x
    )


def coverage_weight(total: Column, index: Column) -> Column:
    """Share of a multi-mapped alignment: 1 for the mark 0-0, otherwise 1/total."""
    return F.when((total == 0) & (index == 0), F.lit(1.0)).otherwise(F.lit(1.0) / F.nullif(total, F.lit(0)))


def scaled_weight(score: Column, best: Column, scale: float = 100.0) -> Column:
    """``(exp(scale * score / best) - 1) / (exp(scale) - 1)`` without overflow.

    Dividing by the best weight of the read leaves the result between 0 and 1.
    """
    floor = F.exp(F.lit(-scale))
    return (F.exp(scale * (score / best - 1.0)) - floor) / (1.0 - floor)


def fixed_bin(value: Column, width: float) -> Column:
    """Right-closed bin number; 0 falls outside the lowest edge and gives NULL."""
    return F.when(value > 0, F.ceil(value / width).cast("long"))


def gtf_attribute(attributes: Column, name: str = "gene_id") -> Column:
    return F.nullif(F.regexp_extract(attributes, name + r' "(.+?)";', 1), F.lit(""))


def near_in_text(text: Column, first: str, second: str, window: int) -> Column:
    """First stretch where the two words lie at most ``window`` characters apart, in either order."""
    there = F.regexp_extract(text, f"({first}.{{0,{window}}}{second})", 1)
    back = F.regexp_extract(text, f"({second}.{{0,{window}}}{first})", 1)
    return F.coalesce(F.nullif(there, F.lit("")), F.nullif(back, F.lit("")))


def feature_parts(feature: Column) -> Column:
    """``type|name|ordinal`` -> struct."""
    p = F.split(feature, r"\|")
    return F.struct(
        p[0].alias("type"), p[1].alias("name"), F.element_at(p, -1).try_cast("long").alias("ordinal")
    )


def failed_tests(*tests: tuple[str, Column]) -> Column:
    """Names of the tests that hold, as an array; empty when none does."""
    found = F.array(*[F.when(test, F.lit(tag)) for tag, test in tests])
    return F.filter(found, lambda r: r.isNotNull())
