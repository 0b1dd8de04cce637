"""Augmented training run and metrics report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.operators import align, modeling, popgen, runs
from cohortframe.operators.runs import fold_summary


def normalization_report(real: DataFrame, synth: DataFrame, real_y: DataFrame, synth_y: DataFrame) -> DataFrame:
    """One row: MAF drift, target overlap, repeated ids and ids without a partner."""
    drift = popgen.maf_drift(real, synth)
    overlap = popgen.histogram_overlap(real_y, synth_y)
    ids = align.overlap_audit({"x": synth, "y": synth_y}).select(F.col("not_in_all").alias("id_mismatches"))
    dup = align.duplicate_ids({"y": synth_y}).select("n_duplicates")
    base = real.sparkSession.range(1)
    cols = []
    for df in (drift, overlap, ids, dup):
        row = df.select(F.struct(*df.columns)).scalar()
        cols += [row.getField(c).alias(c) for c in df.columns]
    return base.select(*cols)


def augmented_run(real: DataFrame, real_y: DataFrame, synth: DataFrame, synth_y: DataFrame,
                  kinds: Mapping[str, Mapping[str, Sequence]], k: int = 50, outer: int = 5, inner: int = 3,
                  seed: int = 42) -> DataFrame:
    """Nested validation of each regressor with and without the synthetic rows, as run records."""
    shared = align.shared_variants(real, synth)
    cols = ["sample_id", "var_id", "dosage"]
    both = (real.select(*cols).unionByName(synth.select(*cols))).join(shared, "var_id", "left_semi")
    y = real_y.select("sample_id", "y").unionByName(synth_y.select("sample_id", "y"))
    only = real_y.select("sample_id", F.lit("real").alias("origin"))
    more = only.unionByName(synth_y.select("sample_id", F.lit("synthetic").alias("origin")))
    out = None
    for kind, params in kinds.items():
        for mode, samples in (("original", only), ("augmented", more)):
            res = modeling.nested_cv(both, y, samples, kind, params, k, outer, inner, seed=seed)
            cv, held = fold_summary(res.folds), res.holdout.select(
                F.col("r2").alias("holdout_r2"), F.col("rmse").alias("holdout_rmse"), F.col("mae").alias("holdout_mae"))
            row = real.sparkSession.range(1).select(
                F.lit(kind).alias("model"), F.lit(mode).alias("mode"),
                cv.select(F.struct(*cv.columns)).scalar().alias("cv"),
                held.select(F.struct(*held.columns)).scalar().alias("holdout"))
            out = row if out is None else out.unionByName(row)
    return out.select("model", "mode", "cv.*", "holdout.*")


def comparison(records: DataFrame) -> DataFrame:
    """Original against augmented scores per model."""
    def side(mode):
        return records.where(F.col("mode") == mode).select(
            "model", F.col("r2_mean").alias("r2"), F.col("rmse_mean").alias("rmse"), F.col("mae_mean").alias("mae"))
    return runs.original_vs_augmented(side("original"), side("augmented"))


def metrics_report(table: DataFrame, k: int, sigma: float, models: Sequence[str], min_runs: int = 1) -> DataFrame:
    """Multi-seed means with stability notes and ranks."""
    return runs.stability(runs.multi_seed(table, k, sigma, models, min_runs))
