"""A training corpus from ``documents``: quality, exact and near duplicates, benchmark leaks, packed sequences.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept and returns a DataFrame; ``run`` writes
it to the cluster's shared folder and reads it again as the next stage's docs.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortframe.llm import decontam, dedup, jaccard, packing, quality
from cohortframe.llm.common import stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (10), fitted on the labelled ones, rejects go."""
    return quality.good(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (5) the one with the smallest doc_id stays."""
    return dedup.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by 75 % Jaccard of 5-word shingles (3) the one with the smallest doc_id stays."""
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold three quarters of a benchmark item's 5-word shingles (4) go."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens (8), by workers that remember less than alone: others share their machine."""
    return packing.packed(docs, remembered=100_000)


STAGES = [("quality_classifier", quality_classifier), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("best_fit_packing", best_fit_packing)]

# the classifier, the connected components and the packing have no SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
