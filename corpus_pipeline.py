"""A training corpus from the documents table, in five stages.

Quality classifier, line deduplication, near-duplicate removal, benchmark decontamination, and
packing. Each stage reads what the one before has written. All but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, line_dedup, near_duplicates, packing, quality
from tidemark.llm.queries import byte_bpe
from tidemark.session import discard, materialised
from tidemark.sources.tables import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted to the labels of documents here."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, and documents that consist of nothing else."""
    return line_dedup.deduplicate_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, by shingles of five words
    (exact Jaccard similarity 0.8 or more)."""
    return near_duplicates.deduplicate_similar(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (or a shorter item) go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def vector_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each remaining document lies in sequences of 1024 tokens."""
    return packing.pack_documents(docs, *byte_bpe())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_deduplication", line_deduplication),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("vector_packing", vector_packing),
]

#: No stage but decontamination can be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; each one's result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        out = materialised(stage(spark, docs, sf_dir))
        discard(docs)
        docs = out
    return docs
