"""The training-text pipeline: good documents, one of each group of near copies, no benchmark items, no secrets, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import fm, packing, secrets, sigtree, spaced
from strandloom.llm.queries import ship, vocabulary
from strandloom.llm.storage import Tables


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it never learns from the held-out fold."""
    ship(spark)
    return fm.keep_good(docs, fm.fit_outside(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingle similarity of 0.8 or more."""
    ship(spark)
    return sigtree.one_of_each(docs, 5, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return spaced.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by marks; lengths follow."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    ship(spark)
    return packing.best_fit_packing(docs, vocabulary("word_bpe_49k.json"), 2048)


STAGES = [
    ("quality_classifier", quality), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_scan), ("best_fit_packing", pack),
]

#: The classifier and the tokenizer have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    tables = Tables(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = tables.store(docs, name)
    return docs
