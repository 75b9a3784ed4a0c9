"""A corpus pipeline of five stages; see ``millrace.llm`` for the operators.

``run`` writes what each stage returns as Parquet in the shared folder and reads it again as the next one's
documents. All stages but the last return the columns of ``documents``; nulls, empty tables and extra columns are
defined by the operators' modules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import mixing, packing, paritysketch, quality, secrets
from millrace.llm.common import frugal, read, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or that the trained regression rejects, go."""
    frugal(spark)
    return quality.keep(docs, read(spark, sf_dir, "labels"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose five-word shingles are similar to 0.8 or more, the one with the least doc_id stays."""
    frugal(spark)
    return paritysketch.keep_first(docs, k=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; no document goes."""
    frugal(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target weight asks: none, once or twice."""
    frugal(spark)
    return mixing.mix_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; a document that the mix has twice is packed twice."""
    frugal(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: Trained models and lexical packing are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
