"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Every match of the base patterns is a span. The same value may be a credential of one owner, or an example that many
have copied: values are hashed and counted by distinct repositories (documents) and owners (sources), and one beyond the limit of
either is an example. Distinct pairs are counted first, so a value found everywhere is pre-aggregated and never a group. Long mixed strings outside the base spans become
spans of the kind ``mixed`` only if they look random and belong to few owners.

Positions are code points. They come from the lengths of the parts between matches, summed along the text; only rows with a
match are exchanged, never the texts.

Defined cases: a null text counts as empty and has no span; a null id or owner is a value like any other; equal rows get the
same spans and count as one repository; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.storage import stored

# Fixed patterns of the base rule.
ASSIGN = (
    r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    r"""["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
)
# A run that is too short holds no longer match, so the least lengths of these two stand in the patterns.
ACCESS = "()(AKIA[A-Z0-9]{16,})"
HEX = "()([0-9a-f]{24,})"
MIXED = "()([A-Za-z0-9+/_-]{24,})"

#: Kinds in their order within a list of spans: pattern, least length of the value, cheap test of a text.
KINDS = (
    ("assign", ASSIGN, 6, "(?i)(?:password|passwd|secret|token|api_?key)"),
    ("access", ACCESS, 20, "AKIA[A-Z0-9]{16}"),
    ("hex", HEX, 24, "[0-9a-f]{24}"),
    ("mixed", MIXED, 24, "[A-Za-z0-9+/_-]{24}"),
)
BASE = ("assign", "access", "hex")


@dataclass(frozen=True)
class Ownership:
    #: A value held by more owners than this is a copied example,
    max_owners: int = 2
    #: and so is one in more repositories, even of one owner.
    max_repositories: int = 10
    #: A live-looking value has at least so many different characters.
    min_characters: int = 8
    #: An added span needs more of them, and both a letter and a digit.
    min_mixed_characters: int = 12


def _matches(docs: DataFrame, order: int) -> DataFrame:
    """Every match of one kind: its place in the text's list of matches, length before it, own length and value."""
    kind, pattern, _, test = KINDS[order]
    text = F.col("_text")
    rows = docs.where(text.rlike(test)).select(
        "_id", "_hash", "_owner",
        F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("value"))
    rows = rows.select(
        "_id", "_hash", "_owner",
        F.posexplode(F.arrays_zip(
            F.transform(F.slice("parts", F.lit(1), F.size("found")), F.length).alias("before"), F.transform("found", F.length).alias("whole"), F.col("value"))).alias("at", "m"))
    return rows.select("_id", "_hash", "_owner", F.lit(order).alias("kind"), "at", "m.before", "m.whole", "m.value")


def find_spans(docs: DataFrame, rules: Ownership = Ownership(), id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """All spans: _id, _hash (of the text), kind, start, end, value, owners, repositories, copied, added.

    ``added`` spans are those of the method; the others are the base rule's.
    """
    slim = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), F.col(owner_col).cast("string").alias("_owner"),
    ).withColumn("_hash", F.xxhash64("_text"))
    matches = _matches(slim, 0)
    for order in range(1, len(KINDS)):
        matches = matches.unionByName(_matches(slim, order))
    matches = matches.dropDuplicates(["_id", "_hash", "_owner", "kind", "at"])
    along = Window.partitionBy("_id", "_hash", "_owner", "kind").orderBy("at")
    spans = matches.withColumn("_end", F.sum(F.col("before") + F.col("whole")).over(along).cast("long"))
    least = F.element_at(F.array(*(F.lit(k[2]) for k in KINDS)), F.col("kind") + 1)
    spans = spans.where(F.length("value") >= least).select(
        "_id", "_hash", "_owner", "kind", (F.col("_end") - F.col("whole")).alias("start"), F.col("_end").alias("end"), "value",
        F.sha2("value", 256).alias("_secret"), F.size(F.array_distinct(F.split("value", ""))).alias("_characters"))

    held = spans.select("_secret", "_owner", "_id").distinct()
    held = held.groupBy("_secret", "_owner").agg(F.count("*").alias("n")).groupBy("_secret").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    spans = spans.join(held, "_secret")
    spans = spans.withColumn("copied", (F.col("owners") > rules.max_owners) | (F.col("repositories") > rules.max_repositories) | (F.col("_characters") < rules.min_characters))

    base = F.col("kind") < len(BASE)
    text = Window.partitionBy("_id", "_hash", "_owner").orderBy("start", "kind")
    before = F.max(F.when(base, F.col("end"))).over(text.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(text.rowsBetween(1, Window.unboundedFollowing))
    clear = (F.coalesce(before, F.lit(-1)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    mixed = ~F.col("copied") & (F.col("_characters") >= rules.min_mixed_characters) & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    spans = spans.withColumn("added", ~base).withColumn("_clear", clear)
    return spans.where(base | (mixed & F.col("_clear"))).select("_id", "_hash", "_owner", "kind", "start", "end", "value", "owners", "repositories", "copied", "added")


def _listed(spans: str, condition: str) -> str:
    names = "array(" + ", ".join(f"'{k[0]}'" for k in KINDS) + ")"
    return f"array_join(transform(filter({spans}, s -> {condition}), s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')"


def _with_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    """Rows of ``docs`` as the struct ``_row``, so that no name of theirs can clash, with the ordered array ``_spans``.

    The array is null where a text has no span. Joined on id, text hash and owner.
    """
    lists = spans.groupBy("_id", "_hash", "_owner").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "copied", "added"))).alias("_spans"))
    lists = stored(lists, "secret-lists")
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(id_col).alias("_own_id"), F.col(owner_col).cast("string").alias("_own_owner"),
        F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_own_hash"))
    same = rows["_own_id"].eqNullSafe(lists["_id"]) & (rows["_own_hash"] == lists["_hash"]) & rows["_own_owner"].eqNullSafe(lists["_owner"])
    return rows.join(lists, same, "left").select("_row", "_spans")


def secret_spans(docs: DataFrame, rules: Ownership = Ownership(), id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """Counts and span lists of every document."""
    spans = find_spans(docs, rules, id_col, text_col, owner_col)
    none = "cast(array() as array<struct<start:bigint,kind:int,end:bigint,copied:boolean,added:boolean>>)"
    rows = _with_spans(docs, spans, id_col, text_col, owner_col).select(F.col("_row")[id_col].alias(id_col), F.coalesce("_spans", F.expr(none)).alias("_spans"))
    count = lambda condition: F.expr(f"cast(size(filter(_spans, s -> {condition})) as bigint)")
    return rows.select(
        id_col, count("s.kind = 0").alias("n_assign"), count("s.kind = 1").alias("n_access"), count("s.kind = 2").alias("n_hex"),
        F.sha2(F.expr(_listed("_spans", "not s.added")), 256).alias("base_sha256"), F.expr(_listed("_spans", "true")).alias("spans"),
        count("not s.copied").alias("n_live"), count("s.copied").alias("n_copied"))


def redact(docs: DataFrame, rules: Ownership = Ownership(), id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", live: str = "[secret]", copied: str = "[example]") -> DataFrame:
    """``docs`` with every span's text replaced by a mark that tells credentials from copied examples."""
    rows = _with_spans(docs, find_spans(docs, rules, id_col, text_col, owner_col), id_col, text_col, owner_col)
    # Overlapping spans become one; it is live if any of them is.
    merged = """aggregate(_spans, cast(array() as array<struct<start:bigint,end:bigint,copied:boolean>>), (acc, s) ->
        if(size(acc) > 0 and element_at(acc, -1).end > s.start,
           concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).start as start, greatest(element_at(acc, -1).end, s.end) as end,
                                                             element_at(acc, -1).copied and s.copied as copied))),
           concat(acc, array(struct(s.start as start, s.end as end, s.copied as copied)))))"""
    name = f"_row.`{text_col}`"
    text = f"""concat(array_join(transform(_merged, (s, i) -> concat(
        substring({name}, cast(if(i = 0, 0, _merged[i - 1].end) as int) + 1, cast(s.start - if(i = 0, 0, _merged[i - 1].end) as int)),
        if(s.copied, '{copied}', '{live}'))), ''), substring({name}, cast(element_at(_merged, -1).end as int) + 1))"""
    rows = rows.withColumn("_merged", F.expr(merged))
    new = F.when(F.col("_spans").isNull(), F.expr(name)).otherwise(F.expr(text))
    return rows.select(*(new.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns))


def _oracle_kind(order: int) -> str:
    kind, pattern, _, _ = KINDS[order]
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, source, {order} AS kind, unnest(range(1, len(f) + 1)) AS i, f, v,
        [length(x) FOR x IN string_split_regex(text, '{quoted}')] AS p
      FROM (SELECT doc_id, source, text, regexp_extract_all(text, '{quoted}', 0) AS f, regexp_extract_all(text, '{quoted}', 2) AS v FROM d)"""


def oracle() -> str:
    """DuckDB SQL for :func:`secret_spans` with the default rules."""
    rules = Ownership()
    names = "[" + ", ".join(f"'{k[0]}'" for k in KINDS) + "]"
    least = "[" + ", ".join(str(k[2]) for k in KINDS) + "]"
    listed = f"string_agg({names}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind)"
    return f"""
    WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
    m AS ({" UNION ALL ".join(_oracle_kind(k) for k in range(len(KINDS)))}),
    a AS (SELECT doc_id, source, kind, v[i] AS value,
            CAST(list_sum(p[1:i]) + coalesce(list_sum([length(x) FOR x IN f[1:i - 1]]), 0) AS BIGINT) AS s, CAST(length(f[i]) AS BIGINT) AS n FROM m),
    b AS (SELECT doc_id, source, kind, value, s, s + n AS e, len(list_distinct(string_split(value, ''))) AS chars FROM a WHERE length(value) >= ({least})[kind + 1]),
    h AS (SELECT value, count(DISTINCT source) AS owners, count(DISTINCT doc_id) AS repositories FROM b GROUP BY value),
    c AS (SELECT b.*, owners > {rules.max_owners} OR repositories > {rules.max_repositories} OR chars < {rules.min_characters} AS copied FROM b JOIN h USING (value)),
    k AS (SELECT *, kind >= {len(BASE)} AS added FROM c WHERE kind < {len(BASE)} OR (NOT copied AND chars >= {rules.min_mixed_characters}
            AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
            AND NOT EXISTS (SELECT 1 FROM c AS o WHERE o.doc_id = c.doc_id AND o.kind < {len(BASE)} AND o.s < c.e AND c.s < o.e)))
    SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
      sha256(coalesce({listed} FILTER (NOT added), '')) AS base_sha256, coalesce({listed}, '') AS spans,
      count(*) FILTER (NOT copied) AS n_live, count(*) FILTER (copied) AS n_copied
    FROM d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id"""
