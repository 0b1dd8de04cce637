"""The sample x variant grid, grown without a cross join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortframe.session import cut_lineage

BLOCK = 2048      # variants per block
FILL_BLOCK = 64   # variants whose known cells travel together


def _numbers(n: int):
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))


def _sides(samples: DataFrame, variants: DataFrame, size: int) -> tuple[DataFrame, DataFrame, int]:
    """(samples per variant block, variants per sample slice, blocks), to be joined on block and slice."""
    parts = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    variants = cut_lineage(variants)            # counted here, read again below
    blocks = max(1, math.ceil(variants.count() / size))
    slices = max(1, math.ceil(4 * parts / blocks))
    v = variants.withColumn("_b", F.pmod(F.xxhash64("var_id"), F.lit(blocks))).withColumn("_s", _numbers(slices))
    ids = samples.withColumn("_s", F.pmod(F.xxhash64("sample_id"), F.lit(slices))).withColumn("_b", _numbers(blocks))
    return ids, v, blocks


def grid(samples: DataFrame, variants: DataFrame) -> DataFrame:
    """Every row of ``samples`` with every row of ``variants``.

    Variants are hashed into blocks of about 2048.  A sample is written once per
    block, and variants once per slice of the samples, so that there are at least
    as many (block, slice) groups as shuffle partitions; the two meet by an
    equi-join.  No side is broadcast unless the optimizer measures it as small.
    """
    ids, v, _ = _sides(samples, variants, BLOCK)
    return ids.join(v, ["_b", "_s"]).drop("_b", "_s")


def filled_grid(samples: DataFrame, variants: DataFrame, cells: DataFrame, fill: Column) -> DataFrame:
    """(sample_id, var_id, dosage) of the whole grid, ``fill`` where ``cells`` has no value.

    A sample's known cells travel as one small map per block of about 64 variants and meet the
    sample before it meets the variants, so the dense rows are made after the last shuffle.  A
    cell that is there twice counts with its largest value.
    """
    ids, v, blocks = _sides(samples.select("sample_id"), variants.select("var_id"), FILL_BLOCK)
    known = cells.where(F.col("dosage").isNotNull()).select("sample_id", "var_id", "dosage", F.pmod(F.xxhash64("var_id"), F.lit(blocks)).alias("_b"))
    known = known.repartition("sample_id", "_b")        # one shuffle serves both groupings and the join
    maps = known.groupBy("sample_id", "_b", "var_id").agg(F.max("dosage").alias("dosage")).groupBy("sample_id", "_b").agg(
        F.map_from_entries(F.collect_list(F.struct("var_id", "dosage"))).alias("_m"))
    rows = ids.join(maps, ["sample_id", "_b"], "left").join(v, ["_b", "_s"])
    return rows.select("sample_id", "var_id", F.coalesce(F.try_element_at("_m", F.col("var_id")), fill).alias("dosage"))
