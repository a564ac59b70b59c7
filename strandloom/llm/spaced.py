"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A mask picks some positions of a short token window; equal picked tokens give a hit even where the others differ. All
windows of all documents and of all benchmark items are hashed under every mask and joined. Around each hit the item is laid on
the document at the same diagonal, and tokens are compared one by one: a pair stands if some window of
``verify`` aligned tokens (or the whole item, if shorter) agrees in at least ``identity`` of them.

With the default settings no pair that passes this comparison is without a hit: the masks for each length of an item leave
free every choice of tokens that may differ (12 tokens or more share four masks, shorter items have their own, those of at
most four tokens must be equal and are hashed whole). Masks of short items are only used if such items are there.

Rows of documents are exploded and probed in one pass when the benchmark's hashes fit the broadcast bound, which is
checked by counting them; beyond it both sides are exchanged by hash. Texts are only exchanged to verify, once.

Defined cases: null and empty texts have no tokens and no hit; windows are cut at the text's end, so a text with fewer
tokens than an item of up to ``verify`` tokens does not hold it; equal documents and equal items each give their own row; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.storage import stored


@dataclass(frozen=True)
class Seeds:
    #: Fixed masks: offsets of the tokens that are hashed.
    masks: tuple[tuple[int, ...], ...] = ((0, 1, 2, 3, 4, 5), (0, 1, 3, 4, 7, 8), (0, 2, 3, 6, 7, 9))
    #: With this one, every way to replace two of 12 or 13 tokens leaves some mask whole.
    fourth: tuple[int, ...] = (0, 1, 2, 4, 6, 7)
    #: Masks for items of 1, 2, ... 11 tokens.
    short: tuple[tuple[tuple[int, ...], ...], ...] = (
        ((0,),), ((0, 1),), ((0, 1, 2),), ((0, 1, 2, 3),), ((0, 1, 2), (0, 1, 3)), ((0, 1, 2, 3), (0, 1, 3, 4)),
        ((0, 1, 2, 3, 4), (0, 1, 2, 3, 5), (0, 1, 3, 4, 5)), ((0, 1, 2, 3, 4, 5), (0, 1, 2, 3, 5, 6), (0, 1, 3, 4, 5, 6)),
        ((0, 1, 2, 3, 4, 5), (0, 1, 2, 4, 5, 6)), ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 6, 7)), ((0, 1, 2, 3, 5), (0, 1, 4, 7, 8)),
    )
    verify: int = 13
    identity: float = 0.8
    #: Seeds of the benchmark up to which they are broadcast (about 40 bytes each).
    broadcast_seeds: int = 500_000

    def by_length(self) -> list[tuple[int, tuple[int, ...]]]:
        """Every mask with the length of the items that it is for; ``len(short) + 1`` stands for all longer ones."""
        long = [*self.masks, self.fourth]
        return [(n, m) for n, masks in enumerate([*self.short, long], 1) for m in masks]


def _tokens(text) -> object:
    trimmed = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _seeds(rows: DataFrame, keep: list[str], masks: list[tuple[int, tuple[int, ...]]], length: str | None = None) -> DataFrame:
    """One row per window and mask: ``keep`` columns, ``at`` and ``seed``. ``rows`` has ``tokens``.

    Shifted copies of the hashed tokens are zipped, so a window is one flat row and its hashes are compiled code; cells
    past the end are null, and a mask that would pick one gives no row. With ``length``, a column of ``keep``, only the masks for
    that length are used.
    """
    hashed = rows.select(*keep, F.transform("tokens", lambda t: F.xxhash64(t)).alias("h"))
    used = sorted({o for _, m in masks for o in m})
    shifted = [F.slice("h", F.lit(o + 1), F.size("h")).alias(f"t{o}") if o else F.col("h").alias("t0") for o in used]
    windows = hashed.select(*keep, F.posexplode(F.arrays_zip(*shifted)).alias("at", "w")).select(*keep, "at", *(F.col(f"w.t{o}").alias(f"t{o}") for o in used))
    each = []
    for i, (n, m) in enumerate(masks):
        there = F.col(f"t{m[-1]}").isNotNull()
        each.append(F.when(there & (F.col(length) == n) if length else there, F.xxhash64(F.lit(i), *(F.col(f"t{o}") for o in m))))
    return windows.select(*keep, "at", F.explode(F.array(*each)).alias("seed")).where(F.col("seed").isNotNull())


def contaminated(
    docs: DataFrame, benchmark: DataFrame, seeds: Seeds = Seeds(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Pairs of document and item with a verified overlap: diagonal, tokens compared, tokens equal, best window.

    ``diagonal`` is the document position of the item's first token. Several diagonals of a pair give the best one.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    items = stored(benchmark.select(F.col(item_col).alias("_item"), _tokens(F.col(item_text)).alias("tokens")).select("_item", "tokens", F.xxhash64("tokens").alias("_key")), "items")
    sized = items.withColumn("_n", F.least(F.size("tokens"), F.lit(len(seeds.short) + 1)))
    there = {r[0] for r in sized.select("_n").distinct().collect()}
    # Without any token in the benchmark one mask stands for all; it finds nothing.
    masks = [(n, m) for n, m in seeds.by_length() if n in there] or seeds.by_length()[:1]
    small = _seeds(sized, ["_item", "_key", "_n"], masks, "_n")
    bounded = small.count() <= seeds.broadcast_seeds
    # Every place of an item that must be equal gives the same figures, so its first one is enough.
    whole = (F.col("_n") <= min(len(seeds.short), seeds.verify)) & (F.ceil(F.col("_n") * seeds.identity) == F.col("_n"))
    small = small.groupBy("seed").agg(F.collect_list(F.struct("_item", "_key", "at", whole.alias("whole"))).alias("places"))
    windows = _seeds(texts.select("_id", F.xxhash64("_text").alias("_hash"), _tokens(F.col("_text")).alias("tokens")), ["_id", "_hash"], masks)
    hits = windows.join(F.broadcast(small) if bounded else small, "seed").select("_id", "_hash", "at", F.explode("places").alias("p"))
    hits = hits.select("_id", "_hash", F.col("p._item").alias("_item"), F.col("p._key").alias("_key"), (F.col("at") - F.col("p.at")).alias("diagonal"), F.col("p.whole").alias("_whole"))
    hits = hits.groupBy("_id", "_hash", "_item", "_key", F.when(~F.col("_whole"), F.col("diagonal")).alias("_own")).agg(F.min("diagonal").alias("diagonal"))
    hits = stored(hits.drop("_own"), "hits")

    laid = hits.join(F.broadcast(items.distinct()) if bounded else items.distinct(), (hits["_item"].eqNullSafe(items["_item"])) & (hits["_key"] == items["_key"]))
    laid = laid.select(hits["_id"].alias("_doc"), "_hash", hits["_item"], "diagonal", F.col("tokens").alias("item"))
    texts = texts.withColumn("_own", F.xxhash64("_text"))
    pairs = texts.join(laid, texts["_id"].eqNullSafe(laid["_doc"]) & (texts["_own"] == laid["_hash"]))
    # Exploding an array of one keeps Spark from copying the expression into every place that uses it.
    pairs = pairs.select("_id", "_item", "diagonal", "item", F.explode(F.array(_tokens(F.col("_text")))).alias("tokens"))
    start = F.greatest(F.col("diagonal"), F.lit(0))
    size = F.least(F.size("tokens") - start, F.size("item") - (start - F.col("diagonal")))
    pairs = pairs.withColumn("_start", start).withColumn("_size", size)
    same = F.zip_with(
        F.slice("tokens", F.col("_start") + 1, F.col("_size")), F.slice("item", F.col("_start") - F.col("diagonal") + 1, F.col("_size")), lambda a, b: (a == b).cast("int"))
    pairs = pairs.select("_id", "_item", "diagonal", "item", "_size", F.explode(F.array(same)).alias("same"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    width = F.least(F.size("item"), F.lit(seeds.verify))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.col("_size") - width + 1), lambda i: total(F.slice("same", i, width))))
    pairs = pairs.select("_id", "_item", "diagonal", F.col("_size").alias("compared"), total(F.col("same")).alias("equal"), width.alias("width"), F.when(F.col("_size") >= width, best).alias("best"))
    pairs = pairs.where(F.col("best") >= F.ceil(F.col("width") * seeds.identity))
    top = pairs.groupBy("_id", "_item").agg(F.max(F.struct("equal", "compared", (-F.col("diagonal")).alias("back"), "best")).alias("m"))
    return top.select(
        F.col("_id").alias(id_col), F.col("_item").alias(item_col), (-F.col("m.back")).alias("diagonal"), F.col("m.compared").alias("compared"),
        F.col("m.equal").alias("equal"), F.col("m.best").alias("best"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, seeds: Seeds = Seeds(), id_col: str = "doc_id") -> DataFrame:
    """``docs`` without those that hold a benchmark item; a null id never leaves."""
    found = stored(contaminated(docs, benchmark, seeds, id_col).select(F.col(id_col).alias("_id")).distinct(), "contaminated")
    return docs.join(found, docs[id_col] == found["_id"], "left_anti")


def oracle() -> str:
    """DuckDB SQL for :func:`contaminated` with the default seeds."""
    seeds = Seeds()
    blank = r"[\x20\x09-\x0D]+"

    def tokens(text):
        trimmed = f"regexp_replace(lower(coalesce({text}, '')), '^{blank}|{blank}$', '', 'g')"
        return f"CASE WHEN {trimmed} = '' THEN [] ELSE string_split_regex({trimmed}, '{blank}') END"

    def picks(table, own):
        """Every window under every mask; an item is only looked up under the masks for its length."""
        last = len(seeds.short) + 1
        return " UNION ALL ".join(
            f"SELECT id, i - 1 AS at, {k} AS mask, concat_ws(' ', {', '.join(f't[i + {o}]' for o in m)}) AS seed FROM {table}, unnest(range(1, len(t) - {m[-1] - 1})) AS r(i)" + (f" WHERE least(len(t), {last}) = {n}" if own else "")
            for k, (n, m) in enumerate(seeds.by_length()))

    return f"""
    WITH d AS (SELECT doc_id AS id, {tokens('text')} AS t FROM documents),
    b AS (SELECT item_id AS id, {tokens('text')} AS t FROM benchmark),
    h AS (SELECT DISTINCT x.id AS doc_id, y.id AS item_id, x.at - y.at AS diagonal FROM ({picks('d', False)}) x JOIN ({picks('b', True)}) y ON x.mask = y.mask AND x.seed = y.seed),
    p AS (SELECT doc_id, item_id, diagonal, d.t AS dt, b.t AS bt, greatest(diagonal, 0) AS s FROM h JOIN d ON d.id = doc_id JOIN b ON b.id = item_id),
    q AS (SELECT *, least(len(dt) - s, len(bt) - (s - diagonal)) AS n, least(len(bt), {seeds.verify}) AS w FROM p),
    e AS (SELECT *, [CAST(dt[s + i] = bt[s - diagonal + i] AS INT) FOR i IN range(1, n + 1)] AS same FROM q),
    v AS (SELECT doc_id, item_id, diagonal, n AS compared, coalesce(list_sum(same), 0) AS equal, w,
            list_max([list_sum(same[i:i + w - 1]) FOR i IN range(1, n - w + 2)]) AS best FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY equal DESC, compared DESC, diagonal) AS k FROM v WHERE best >= ceil(w * {seeds.identity}))
    SELECT doc_id, item_id, CAST(diagonal AS INT) AS diagonal, CAST(compared AS INT) AS compared, CAST(equal AS INT) AS equal, CAST(best AS INT) AS best FROM r WHERE k = 1"""
