"""A training corpus from ``documents``, in five stages.

Each stage works on all rows that its predecessor kept, which are written as Parquet and read
again. All but the last return the columns of ``documents``. Every stage takes null, empty and
very long texts, null and repeated ids, and empty tables: see the operator that it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import decontaminate, near_copies, packing, quality, secrets
from tidewire.llm.common import fold, materialise, read


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier scores under 0.3; fit to the labels outside its held-out fold.

    Without a usable label every score is 0.5, and all rows stay.
    """
    weights = quality.fit(docs, read(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return quality.keep_good(docs, weights)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, that of the smallest id, of each component of texts with a 5-word Jaccard similarity of 0.8 or more.

    Texts without a word are one component.
    """
    return near_copies.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that repeat part of a benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; no document goes, null texts stay null."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of 2048 tokens: a row for each piece, at least one a document."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scan", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the classifier, fingerprints, alignment or packing; tests hold the rows
#: against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents`` and returns the packed pieces."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
