"""Exact dedup by skew-safe combining (operator 5), DataFrame functions only.

Texts are grouped by digest *and* full content at every stage, so equal digests alone never merge two rows:

1. each task combines its own rows per (digest, text) - the salt is the task's number modulo ``salts``,
2. salted groups are merged: a group of copies that holds a third of all rows arrives as one row per task, spread over
   ``salts`` reducers,
3. the winners of the salts are combined per digest and text.

Rows then meet their group by digest.  That is exact because stage 3 has seen every text of a digest: should one ever
hold two texts the job fails with a message instead of merging them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortframe.llm.common import cut_lineage, normal_text, sized

SALTS = 8


def _digested(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", normal_text().alias("norm")).withColumn("text_sha256", F.sha2("norm", 256))


def copy_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct normalised text: ``text_sha256, keep_id, group_size``.

    Null texts count as empty.  ``keep_id`` is the smallest non-null doc_id (null if there is none).  An empty table
    gives an empty table.
    """
    rows = _digested(docs).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = rows.groupBy("text_sha256", "norm", "salt").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    merged = (salted.repartition("text_sha256").groupBy("text_sha256", "norm")
              .agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n")))
    one = merged.groupBy("text_sha256").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"),
                                            F.count(F.lit(1)).alias("texts"))
    return one.select("text_sha256", F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("long"))
                      .otherwise(F.col("keep_id")).alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``kept`` marks the rows whose doc_id is the group's smallest; rows that repeat both id and text are all marked (they
    are one document), and a group whose ids are all null marks them all.  Extra columns are ignored.
    """
    rows = _digested(docs).select("doc_id", "text_sha256")
    return (rows.join(copy_groups(docs, salts), "text_sha256")
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def keep_first(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one per distinct text, repeated rows included once.

    Only the ids and digests of the rows that go meet the texts again; a table of them that is small when counted is
    broadcast, so the kept texts are not shuffled.
    """
    def rows(table: DataFrame, kind: str) -> DataFrame:
        key = docs["doc_id"].eqNullSafe(table["_id"]) & (F.sha2(normal_text(docs["text"]), 256) == table["_digest"])
        return docs.join(table, key, kind)

    named = _digested(docs).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest"))
    groups = copy_groups(docs, salts).select(F.col("text_sha256").alias("_digest"), "keep_id", "group_size").where("group_size > 1")
    judged = named.join(groups, "_digest").groupBy("_id", "_digest").agg(
        F.bool_and(F.col("_id").eqNullSafe(F.col("keep_id"))).alias("first"), F.count(F.lit(1)).alias("n"))
    # rows that are not their group's first go; first rows that repeat id and text are put aside
    aside = cut_lineage(judged.where("NOT first OR n > 1").select("_id", "_digest", "first"))
    kept = rows(sized(aside.select("_id", "_digest")), "left_anti")
    again = aside.where("first").select("_id", "_digest")
    if again.isEmpty():
        return kept
    whole = rows(sized(again), "left_semi").select(F.struct("*").alias("_row"))
    same = W.partitionBy("_row.doc_id", F.sha2(normal_text(F.col("_row.text")), 256)).orderBy(F.xxhash64("_row"))
    return kept.unionByName(whole.withColumn("_n", F.row_number().over(same)).where("_n = 1").select("_row.*"))


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text_sha256,
                  regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""
