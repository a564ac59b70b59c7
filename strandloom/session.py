"""Session helpers: local session for tests and lineage cutting for iterative jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = 8, app: str = "strandloom") -> SparkSession:
    """A session for tests and the bench; a cluster job brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named in ``spark.checkpoint.dir``.

    A temporary folder is only chosen when the setting is absent and the master
    is local, where driver and executors share one disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        shared = tempfile.mkdtemp(prefix="strandloom-checkpoint-")
    sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its plan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str = "rows") -> str:
    """The folder of ``df``, written as a table in the shared checkpoint folder; the shuffle files of its job go when it ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return path


#: Rows for which a task of its own is worth starting.
TASK_ROWS = 50_000


def few_tasks(df: DataFrame, most: int) -> DataFrame:
    """``df``, which has at most ``most`` rows, in no more tasks than these need, whatever the number of shuffle partitions."""
    return df.coalesce(max(1, -(-most // TASK_ROWS)))


def written(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` as a table in the shared checkpoint folder, read back.

    Smaller than a checkpoint, whose rows are not packed, and the shuffle files of its job go when it ends. Order and
    partitioning are lost, and a column needs a type that Parquet has.
    """
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, name))


#: Rows of the input that one slice of :func:`sliced` takes.
SLICE_ROWS = 1 << 25


def sliced(
    rows: int, key: str | list[str], build: Callable[[Callable[[DataFrame], DataFrame]], DataFrame], name: str = "slice",
    slice_rows: int | None = None, keep: bool = False,
) -> DataFrame:
    """What ``build`` makes of the whole input, worked out slice by slice of ``key``, so that shuffle files of one slice only lie on disk at a time.

    ``build`` gets a function that takes the rows of a table that belong to the slice; it has to apply it to every table
    whose rows it counts, and rows of different keys must not depend on each other. Every key falls into one slice, a NULL one too.
    Slices are stored; a single one only with ``keep``.
    """
    parts = max(1, -(-rows // (slice_rows or SLICE_ROWS)))
    if parts == 1:
        whole = build(lambda table: table)
        return written(whole, name) if keep else whole
    keys = [key] if isinstance(key, str) else key

    def within(part: int) -> Callable[[DataFrame], DataFrame]:
        # Not the seed of exchanges, or the rows of a slice would go to a few of their partitions.
        return lambda table: table.filter(F.pmod(F.xxhash64(F.lit(17), *keys), F.lit(parts)) == part)

    return reduce(DataFrame.union, [written(build(within(part)), name) for part in range(parts)])


def discard(*tables: DataFrame) -> None:
    """Delete the files of :func:`written` tables that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
