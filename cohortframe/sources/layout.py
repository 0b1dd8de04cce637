"""Stored layout of the long genotype table.

Per-variant work (statistics, verdict joins, imputation, scaling) all keys on
``var_id``.  Written in buckets of that column, those joins and aggregates read
their bucket and need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def save_bucketed(geno: DataFrame, table: str, path: str, buckets: int, mode: str = "errorifexists") -> DataFrame:
    """Write the cells bucketed and sorted by variant; returns the table.

    Rows are first brought together by bucket, so each bucket is one file per
    writing task rather than one per task and bucket.  Choose ``buckets`` so that
    one holds a few hundred megabytes.
    """
    (geno.repartition(buckets, "var_id").write.mode(mode).option("path", path)
         .bucketBy(buckets, "var_id").sortBy("var_id").saveAsTable(table))
    return geno.sparkSession.table(table)


def open_bucketed(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)
