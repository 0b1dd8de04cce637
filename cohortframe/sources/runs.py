"""Run-metric JSON in its several dialects, and the guarded writer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortframe.functions.encoding import model_name_by_part

RUN_SCHEMA = """
model_name string, run_id string, timestamp string, model struct<name:string>,
cv_r2_mean double, cv_r2_std double, cv_rmse_mean double, cv_mae_mean double,
holdout_r2 double, holdout_rmse double, holdout_mae double,
cv struct<r2_mean:double, r2_std:double>, average_scores struct<r2:double, rmse:double, mae:double>,
outer_scores array<struct<r2:double, rmse:double, mae:double, best_params:struct<max_features:int>>>,
holdout struct<r2:double, r2_score:double>, holdout_metrics struct<r2:double, r2_score:double>,
selected_k int, sigma_resid_factor double, augment_seed int, augment_file string, augment_mode string,
fold_metrics struct<r2:array<double>, rmse:array<double>, mae:array<double>>,
final_best_params map<string,string>
"""


def read_runs(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """One row per run with the metrics found wherever the dialect keeps them.

    The schema is fixed, so no pass over the files is spent on inferring it.
    """
    raw = spark.read.schema(RUN_SCHEMA).option("multiLine", multi_line).json(path)
    return normalize_runs(raw.withColumn("_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)))


def normalize_runs(raw: DataFrame) -> DataFrame:
    r2s = F.transform("outer_scores", lambda s: s["r2"])
    n = F.size(r2s)
    mean = F.aggregate(r2s, F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0))
    spread = F.sqrt(F.aggregate(r2s, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.nullif(n, F.lit(0)))
    own = F.coalesce("cv_r2_mean", "cv.r2_mean")
    ks = F.filter(F.transform("outer_scores", lambda s: s["best_params"]["max_features"]), lambda k: k.isNotNull())
    std = F.coalesce("cv_r2_std", "cv.r2_std", F.when(own.isNull() & F.col("average_scores").isNotNull(), spread))
    named = F.coalesce("model_name", "model.name")
    if "_file" in raw.columns:
        known = model_name_by_part("_file")
        named = F.coalesce(named, F.when(known != F.lower("_file"), known))
    return raw.select(
        model_name_by_part(named).alias("model"), F.coalesce("run_id", "timestamp").alias("run_id"),
        F.coalesce(own, "average_scores.r2").alias("cv_r2_mean"), std.alias("cv_r2_std"),
        F.coalesce("holdout_r2", "holdout.r2", "holdout_metrics.r2", "holdout.r2_score",
                   "holdout_metrics.r2_score").alias("holdout_r2"),
        F.coalesce("selected_k", F.get(ks, 0)).alias("selected_k"),
        F.col("sigma_resid_factor").alias("sigma"), F.col("augment_seed").alias("seed"), "augment_file", "augment_mode")


def append_new_runs(runs: DataFrame, path: str, keys: Sequence[str] = ("model", "run_id"),
                    overwrite: bool = False) -> DataFrame:
    """Append the runs the table does not have yet; returns the rows written.

    The committer makes each write all or nothing.  ``overwrite`` replaces the
    whole table with the given runs.
    """
    spark = runs.sparkSession
    if overwrite:
        runs.write.mode("overwrite").parquet(path)
        return runs
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    new = runs
    if there:
        new = runs.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
    new.write.mode("append").parquet(path)
    return new
