"""Line filters as Structured Streaming jobs.

The row filters of the toolkit read lines one by one and keep no state, so the batch
functions run unchanged on a stream. Sorted-run operators need the end of the
input and stay batch jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandloom.functions.evidence import failed_tests, identity, is_mapped
from strandloom.sources.text import clean_sam, parse_gaf


def line_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def mapped_lines(text: DataFrame) -> DataFrame:
    """GAF lines whose path names at least one node."""
    return text.filter(is_mapped(F.split("value", "\t")[5]))


def cleaned_sam(text: DataFrame, strip: str = "GRCh38#0#", drop: str = "CHM13") -> DataFrame:
    return clean_sam(text, strip, drop)


def tagged_alignments(text: DataFrame, min_identity: float = 0.8) -> DataFrame:
    """Parsed alignments with reject reasons of the single line."""
    rows = parse_gaf(text)
    low = identity(rows["tags"]["cs"], F.col("read_len")) < min_identity
    return rows.withColumn("reasons", failed_tests(("U", F.col("path") == "*"), ("D", low)))


def write_lines(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run until the available files are consumed; the checkpoint makes a restart exact."""
    return (
        stream.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
