"""Registered queries of this subpackage and the SQL that checks them, where SQL can express the operator."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers whose path lacks it; once per application."""
    sc: SparkContext = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="strandloom-"), "strandloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def query(name: str, check: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return fn(spark, folder)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if check is not None:
            CHECKS[name] = check
        return fn

    return wrap


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query("op1_quality_classifier")
def op1(spark, folder):
    """Score of every document by a factorisation machine fitted outside the held-out fold."""
    from strandloom.llm import fm

    return fm.quality(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


@query("op2_quality_rules")
def op2(spark, folder):
    """Base counts and compression-band verdict of every document."""
    from strandloom.llm import bands

    return bands.compression_bands(documents(spark, folder))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op6_best_fit_packing")
def op6(spark, folder):
    """All documents packed into sequences of 2048 tokens."""
    from strandloom.llm import packing

    return packing.best_fit_packing(documents(spark, folder), vocabulary("word_bpe_49k.json"), 2048)


@query("op7_token_counts")
def op7(spark, folder):
    """Greedy longest-match token counts of every document."""
    from strandloom.llm import longest_match

    return longest_match.token_counts(documents(spark, folder), vocabulary("byte_bpe_50k.tiktoken"))


@query("op10_lm_scoring")
def op10(spark, folder):
    """Unigram base score and subword lattice score of every document."""
    from strandloom.llm import fm, lattice

    return lattice.lm_scores(documents(spark, folder), vocabulary("piece_bpe_32k.model"), fm.fold("doc_id") == 1)


def _secrets_check() -> str:
    from strandloom.llm import secrets

    return secrets.oracle()


@query("op3_secret_scans", _secrets_check())
def op3(spark, folder):
    """Secret spans of every document; added ones belong to few owners."""
    from strandloom.llm import secrets

    return secrets.secret_spans(documents(spark, folder))


def _spaced_check() -> str:
    from strandloom.llm import spaced

    return spaced.oracle()


@query("op4_benchmark_decontamination", _spaced_check())
def op4(spark, folder):
    """Documents and the benchmark items they hold, up to substituted tokens."""
    from strandloom.llm import spaced

    return spaced.contaminated(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


@query("op5_substring_dedup")
def op5(spark, folder):
    """Every document without the words of passages of 35 words that also occur elsewhere."""
    from strandloom.llm import recompress

    return recompress.remove_repeats(documents(spark, folder))


@query("op9_suffix_array_dedup")
def op9(spark, folder):
    """Every document without the bytes of 50-byte strings that also start in a document of smaller id."""
    from strandloom.llm import suffixes

    return suffixes.remove_repeats(documents(spark, folder))


@query("op8_ngram_jaccard_join")
def op8(spark, folder):
    """Components of documents whose sets of four-word shingles reach a Jaccard similarity of 0.85."""
    from strandloom.llm import sigtree

    return sigtree.similar_components(documents(spark, folder))


@query("op12_periodic_runs")
def op12(spark, folder):
    """Periodic runs of words of every document, some of whose words are first replaced by repetitions."""
    from strandloom.llm import periodic

    return periodic.periodic_runs(documents(spark, folder), planted=True)


@query("op11_spelling_variants")
def op11(spark, folder):
    """Words of all documents, some with a deleted letter, with their near words' number, form and root."""
    from strandloom.llm import variants

    return variants.spelling_variants(documents(spark, folder), variants.Rules(deletion=31))


def _licences_check() -> str:
    from strandloom.llm import licences

    return licences.oracle()


@query("op13_license_scans", _licences_check())
def op13(spark, folder):
    """License labels of every document by ordered signature rules."""
    from strandloom.llm import licences

    return licences.license_scan(documents(spark, folder))
