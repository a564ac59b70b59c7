"""Domain-shaped inputs derived from the driver tables.

Each view is one SQL text that Spark and the checking engine both read, so the two
sides start from the same rows; the operators under test are written separately.
Roles: an order is a read, a line is one alignment, a supplier is a feature, a part
is a graph node, an order priority is a sample.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.scan import joined_places, part_offsets, placing
from strandloom.session import stored

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

ROW_ORDER = [
    "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]

VIEWS: dict[str, str] = {
    # file position of a line; Spark numbers the rows by range partition and offset
    "ranked": f"SELECT *, ROW_NUMBER() OVER (ORDER BY {', '.join(ROW_ORDER)}) - 1 AS ord FROM {{lineitem}}",
    "scores": """SELECT CAST(l_suppkey AS STRING) AS feature, CAST(l_orderkey AS STRING) AS read,
        l_quantity AS score FROM {lineitem}""",
    "node_len": "SELECT p_partkey AS node, CAST(p_size + 10 AS BIGINT) AS len FROM {part}",
    # one alignment per line, walking node n and its successor
    "alignments": """SELECT ord AS alignment, l_orderkey AS read, l_suppkey AS feature,
        CAST(l_quantity AS BIGINT) AS score, l_partkey + 5 AS n, l_linenumber AS ln, l_shipdate,
        l_returnflag AS rf, l_linestatus AS ls, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS dir
        FROM {ranked}""",
    "gaf_pairs": """SELECT alignment AS pair, 'r' || CAST(read AS STRING) AS read,
        CASE WHEN dir = 1 THEN '>' || CAST(n AS STRING) || '>' || CAST(n + 1 AS STRING)
             ELSE '<' || CAST(n + 1 AS STRING) || '<' || CAST(n AS STRING) END AS path1,
        CASE WHEN rf = 'N' AND ls = 'F' THEN '*'
             WHEN dir = 1 AND ln <= 2 THEN '<' || CAST(n + 2 AS STRING) || '<' || CAST(n + 1 AS STRING) || '<' || CAST(n AS STRING)
             WHEN dir = 1 AND ln <= 4 THEN '<' || CAST(n + 2 AS STRING) || '<' || CAST(n + 1 AS STRING)
             WHEN dir = 1 THEN '<' || CAST(n + 4 AS STRING) || '<' || CAST(n + 3 AS STRING)
             WHEN ln <= 2 THEN '>' || CAST(n - 1 AS STRING) || '>' || CAST(n AS STRING) || '>' || CAST(n + 1 AS STRING)
             WHEN ln <= 4 THEN '>' || CAST(n - 1 AS STRING) || '>' || CAST(n AS STRING)
             ELSE '>' || CAST(n - 3 AS STRING) || '>' || CAST(n - 2 AS STRING) END AS path2,
        score, ln, n, dir, 70 + 4 * ln AS match1, 96 - ln AS match2, ln AS start1, 100 - ln AS end1, 2 * ln AS start2, 110 - ln AS end2,
        rf, ls FROM {alignments}""",
    "gaf_lines": """SELECT pair * 2 AS ordinal, read || chr(9) || '100' || chr(9) || '0' || chr(9) || '100' || chr(9) || '+' || chr(9) ||
          path1 || chr(9) || '104' || chr(9) || CAST(start1 AS STRING) || chr(9) || CAST(end1 AS STRING) || chr(9) ||
          '90' || chr(9) || '100' || chr(9) || '60' || chr(9) || 'AS:i:' || CAST(score AS STRING) || chr(9) ||
          'cs:Z::' || CAST(match1 - 30 AS STRING) || '*at:30' || chr(9) || 'dv:f:0.0' || CAST(ln AS STRING) AS value FROM {gaf_pairs}
        UNION ALL
        SELECT pair * 2 + 1 AS ordinal, read || chr(9) || '100' || chr(9) || '0' || chr(9) || '100' || chr(9) || '+' || chr(9) ||
          path2 || chr(9) || '112' || chr(9) || CAST(start2 AS STRING) || chr(9) || CAST(end2 AS STRING) || chr(9) ||
          '90' || chr(9) || '100' || chr(9) || '60' || chr(9) || 'AS:i:' || CAST(score + ln AS STRING) || chr(9) ||
          'cs:Z::' || CAST(match2 - 20 AS STRING) || '-ac:20' || chr(9) || 'pd:A:1' AS value FROM {gaf_pairs}""",
    "assign": """SELECT 'S|' || CAST(l_suppkey AS STRING) AS feature, CAST(100 + l_suppkey AS DOUBLE) AS flen,
        l_orderkey AS read, CAST(l_quantity AS BIGINT) AS score, CAST(FLOOR(l_extendedprice) AS BIGINT) AS frag,
        CASE WHEN l_linenumber = 7 THEN 0 ELSE 3 END AS mm_total,
        CASE WHEN l_linenumber = 7 THEN 0 ELSE 1 + l_linenumber % 3 END AS mm_index,
        l_returnflag AS sample, ord AS lin, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS stage FROM {ranked}""",
    # intervals in days on the calendar of a supplier
    "spans": """SELECT l_suppkey AS chrom, datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS s,
        datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) AS e, ord AS rid FROM {ranked}""",
    # a supplier sits on three haplotypes, eight suppliers to a stretch of 30000, so density does not grow with the table
    "supplier_spans": """SELECT 'S|' || CAST(s_suppkey AS STRING) AS feature, hap, start + shift AS start,
        start + shift + 300 + s_suppkey % 97 * 10 AS stop, dir FROM (
          SELECT s_suppkey, CAST(FLOOR(s_suppkey / 8.0) AS BIGINT) * 30000 + CAST(FLOOR(abs(s_acctbal) * 4) AS BIGINT) % 6000 + 10000 AS start, CASE WHEN s_nationkey % 2 = 0 THEN 1 ELSE -1 END AS dir,
            'h1' AS hap, 0 AS shift FROM {supplier}
          UNION ALL SELECT s_suppkey, CAST(FLOOR(s_suppkey / 8.0) AS BIGINT) * 30000 + CAST(FLOOR(abs(s_acctbal) * 4) AS BIGINT) % 6000 + 10000, 1, 'h2', s_suppkey % 7 * 100 FROM {supplier}
          UNION ALL SELECT s_suppkey, CAST(FLOOR(s_suppkey / 8.0) AS BIGINT) * 30000 + CAST(FLOOR(abs(s_acctbal) * 2) AS BIGINT) % 6000 + 10000, -1, 'h3', s_suppkey % 5 * 50 FROM {supplier}) x""",
}
# The date difference is spelled differently by the two engines.
SPARK_SPANS = VIEWS["spans"].replace(
    "datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))",
    "CAST(datediff(CAST(l_shipdate AS DATE), DATE '1992-01-01') AS BIGINT)",
)

_NAME = re.compile(r"\{(\w+)\}")


# Where the numbered lines of a folder lie, by application, file and its state.
_numbered: dict[tuple, tuple[str, str]] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """Length and time of a file or folder, so that changed data is numbered anew."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    status, content = files.getFileStatus(where), files.getContentSummary(where)
    return status.getModificationTime(), content.getLength(), content.getFileCount()


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


class Inputs:
    """Tables and views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._made = spark, folder, {}
        self.prefix = "in_" + hashlib.md5(folder.encode()).hexdigest()[:10]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def _make(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name == "ranked":
            return self._ranked()
        return self.sql(SPARK_SPANS if name == "spans" else VIEWS[name])

    def _ranked(self) -> DataFrame:
        """Lines with their place in the order of all lines.

        Numbering sorts the table, so it is done once per application and kept in the shared folder, as the sorted lines and one
        offset per partition; the queries then read the columns that they need.
        """
        source = f"{self.folder}/lineitem.parquet"
        key = (self.spark.sparkContext.applicationId, source, _state(self.spark, source))
        paths = _numbered.get(key)
        if paths is None or not all(_exists(self.spark, f"{path}/_SUCCESS") for path in paths):
            name = f"ranked-{uuid.uuid4().hex}"
            rows = stored(placing(self["lineitem"], ROW_ORDER), f"{name}/lines")
            paths = _numbered[key] = rows, stored(part_offsets(self.spark.read.parquet(rows)), f"{name}/offsets")
        lines, offsets = (self.spark.read.parquet(path) for path in paths)
        return joined_places(lines, offsets, "ord").withColumn("ord", F.col("ord") - 1)

    def sql(self, text: str) -> DataFrame:
        """Run SQL over tables and views written ``{name}``."""
        for name in dict.fromkeys(_NAME.findall(text)):
            self[name].createOrReplaceTempView(f"{self.prefix}_{name}")
        return self.spark.sql(_NAME.sub(rf"{self.prefix}_\1", text))


def _needed(text: str, seen: dict[str, str]) -> None:
    for name in dict.fromkeys(_NAME.findall(text)):
        if name in VIEWS and name not in seen:
            _needed(VIEWS[name], seen)
            seen[name] = VIEWS[name]


def check_sql(text: str, recursive: bool = False) -> str:
    """The checking query with the views it names as common table expressions.

    ``text`` may start with its own ``WITH``; view names are written ``{name}``.
    """
    seen: dict[str, str] = {}
    _needed(text, seen)
    plain = _NAME.sub(r"\1", text).strip()
    ctes = [f"{n} AS ({_NAME.sub(r'\1', q)})" for n, q in seen.items()]
    if not ctes:
        return plain
    head = "WITH RECURSIVE " if recursive or plain.upper().startswith("WITH RECURSIVE") else "WITH "
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", plain, re.I)
    if own:
        return head + ", ".join(ctes) + ", " + plain[own.end():]
    return head + ", ".join(ctes) + " " + plain
