"""Tables of training runs: summaries, rankings, comparisons and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortframe.functions.encoding import context_name, delta_marker, model_name_by_alias
from cohortframe.functions.expr import first_by, one_row

# Fields every run record must carry.
REQUIRED_FIELDS = (
    "model_name", "run_id", "timestamp", "cv_r2_mean", "cv_rmse_mean", "cv_mae_mean",
    "holdout_r2", "holdout_rmse", "holdout_mae", "selected_k", "use_synthetic", "synthetic_only",
    "augment_mode", "augment_file", "augment_size", "augment_size_effective", "augment_seed",
    "fallback_percent", "sigma_resid_factor", "features_count",
)

METRICS = ("cv_r2", "holdout_r2", "rmse", "mae")


def summary_by_context(runs: DataFrame) -> DataFrame:
    """Mean metrics per (source, context, model) and the size of the earliest run."""
    std = runs.withColumn("context_std", context_name("context"))
    return std.groupBy("source", "context_std", "model").agg(
        F.avg("holdout_r2").alias("holdout_r2"), F.avg("rmse").alias("rmse"),
        F.avg("cv_r2").alias("cv_r2"), F.min_by("n_samples", "seq").alias("n_samples"))


def best_per_source(runs: DataFrame) -> DataFrame:
    """Best run per source by holdout R2; the earliest on ties."""
    valid = runs.where(F.col("holdout_r2").isNotNull())
    return first_by(valid.select("source", "seq", "model", "context", "holdout_r2", "rmse", "cv_r2", "n_samples"),
                    ["source"], [-F.col("holdout_r2"), F.col("seq")])


def comparison_matrix(runs: DataFrame, models: Sequence[str]) -> DataFrame:
    """Source x model table of the best holdout R2."""
    return runs.groupBy("source").pivot("model", list(models)).agg(F.max("holdout_r2"))


def context_matrix(runs: DataFrame) -> DataFrame:
    """Source x context table of the best holdout R2."""
    names = ["baseline", *[f"context_{c}" for c in "ABCDE"]]
    return (runs.withColumn("c", context_name("context")).groupBy("source")
            .pivot("c", names).agg(F.max("holdout_r2")))


def k_matrix(runs: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Model x k table of the mean holdout R2."""
    out = runs.groupBy("model").pivot("k", list(ks)).agg(F.avg("holdout_r2"))
    return out.select("model", *[F.col(str(k)).alias(f"k{k}") for k in ks])


def multi_seed(runs: DataFrame, k: int, sigma: float, models: Sequence[str], min_runs: int = 1) -> DataFrame:
    """Mean and sample sd per model over its complete runs of one (k, sigma).

    One run gives sd 0.  Distinct run ids come out sorted and joined by '|'.
    """
    complete = None
    for m in METRICS:
        cond = F.col(m).isNotNull()
        complete = cond if complete is None else complete & cond
    picked = (runs.withColumn("model", model_name_by_alias("raw_model"))
              .where((F.col("k") == k) & (F.col("sigma") == sigma)
                     & F.col("model").isin(*models) & complete))
    aggs: list[Column] = []
    for m in METRICS:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_sd")]
    return (picked.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_runs"), *aggs,
        F.array_join(F.sort_array(F.collect_set("run_id")), "|").alias("run_ids"))
        .where(F.col("n_runs") >= min_runs))


def stability(summary: DataFrame) -> DataFrame:
    """Rank by mean holdout R2 and a note on its spread (one row per model)."""
    top = F.max("holdout_r2_sd").over(W.partitionBy())
    sd = F.col("holdout_r2_sd")
    first = F.row_number().over(W.orderBy(F.desc("holdout_r2_sd"), "model")) == 1
    note = (F.when(first & (top > 0), "Highest variance").when(sd < 0.005, "Stable")
            .when(sd < 0.015, "Slightly variable").otherwise("Variable"))
    rank = F.row_number().over(W.orderBy(F.desc("holdout_r2_mean"), "model"))
    return summary.withColumn("note", note).withColumn("rank", rank)


def group_aggregates(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and population sd of CV and holdout R2 with the run count."""
    return runs.groupBy(*by).agg(
        F.avg("cv_r2").alias("cv_mean"), F.stddev_pop("cv_r2").alias("cv_sd"),
        F.avg("holdout_r2").alias("holdout_mean"), F.stddev_pop("holdout_r2").alias("holdout_sd"),
        F.count(F.lit(1)).alias("n_runs"))


def cross_source_deltas(runs: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Per model the holdout mean of each source and the pairwise differences."""
    wide = runs.groupBy("model").pivot("source", list(sources)).agg(F.avg("holdout_r2"))
    base = wide.select("model", *[F.coalesce(s, F.lit(0.0)).alias(f"{s}_mean") for s in sources])
    pairs = [(a, b) for i, a in enumerate(sources) for b in sources[i + 1:]]
    return base.withColumns({f"delta_{a}_{b}": F.col(f"{a}_mean") - F.col(f"{b}_mean") for a, b in pairs})


def global_ranking(runs: DataFrame) -> DataFrame:
    """Models ranked by mean holdout R2 over all sources (one row per model)."""
    out = runs.groupBy("model").agg(F.avg("holdout_r2").alias("holdout_mean"))
    return out.withColumn("rank", F.row_number().over(W.orderBy(F.desc("holdout_mean"), "model")))


def sweep_table(runs: DataFrame, model: str, baseline: float | Column) -> DataFrame:
    """Runs of one model with the delta to a baseline and the best row marked.

    ``rate_order`` puts missing rates last (9999).  Row order is a matter of
    the final ``orderBy(rate_order, seed)``, which a reader may apply.
    """
    rows = runs.where(F.col("model") == model)
    best = one_row(rows.agg(F.max_by("seq", F.struct(F.coalesce("holdout_r2", F.lit(float("-inf"))),
                                                     -F.coalesce("rate", F.lit(9999)), -F.col("seed"),
                                                     -F.col("seq"))).alias("seq"))).getField("seq")
    base = baseline if isinstance(baseline, Column) else F.lit(baseline)
    return rows.select("seq", "rate", "seed", "k", "cv_r2", "holdout_r2",
                       F.coalesce("rate", F.lit(9999)).alias("rate_order"),
                       (F.col("holdout_r2") - base).alias("delta_holdout"),
                       (F.col("seq") == best).alias("is_best"))


def metric_curve(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean CV and holdout R2 along a parameter such as sigma or (k, rate)."""
    return runs.groupBy(*by).agg(F.avg("cv_r2").alias("cv_r2"), F.avg("holdout_r2").alias("holdout_r2"),
                                 F.count(F.lit(1)).alias("n"))


def original_vs_augmented(original: DataFrame, augmented: DataFrame) -> DataFrame:
    """Full outer comparison by model name: (model, r2, rmse, mae) on both sides."""
    o = original.select("model", *[F.col(m).alias(f"{m}_orig") for m in ("r2", "rmse", "mae")])
    a = augmented.select("model", *[F.col(m).alias(f"{m}_aug") for m in ("r2", "rmse", "mae")])
    out = o.join(a, "model", "full")
    for m in ("r2", "rmse", "mae"):
        new, old = F.col(f"{m}_aug"), F.col(f"{m}_orig")
        out = (out.withColumn(f"{m}_delta", new - old)
               .withColumn(f"{m}_mark", delta_marker(new, old, higher_is_better=m == "r2")))
    return out


def augmentation_gain(runs: DataFrame, baseline: DataFrame) -> DataFrame:
    """Holdout mean of the augmented runs minus the baseline CV mean (0 when unknown)."""
    a = runs.groupBy("model").agg(F.avg("holdout_r2").alias("holdout_mean"))
    b = baseline.groupBy("model").agg(F.avg("cv_r2").alias("baseline_cv"))
    return a.join(b, "model", "left").withColumn(
        "gain", F.col("holdout_mean") - F.coalesce("baseline_cv", F.lit(0.0)))


def schema_audit(records: DataFrame, required: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    """Per required field: absent from the schema, or null in how many records."""
    known = [c for c in required if c in records.columns]
    counted = records.agg(F.count(F.lit(1)).alias("_rows"),
                          *[F.count_if(F.col(c).isNull()).alias(c) for c in known],
                          *[F.count(F.lit(1)).alias(c) for c in required if c not in known])
    long = counted.unpivot(["_rows"], list(required), "field", "n_missing")
    return long.select("field", "n_missing", (F.col("n_missing") < F.col("_rows")).alias("present"))


def backfill(per_model: DataFrame, aggregated: DataFrame, keys: Sequence[str] = ("model", "run_id")) -> DataFrame:
    """Per-model rows plus those rebuilt from the aggregate where none exists."""
    missing = aggregated.join(per_model.select(*keys), list(keys), "left_anti")
    return (per_model.withColumn("backfilled", F.lit(False))
            .unionByName(missing.withColumn("backfilled", F.lit(True)), allowMissingColumns=True))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The run with the largest run id per model; the last record on ties."""
    rest = [c for c in runs.columns if c != "model"]
    row = F.max_by(F.struct(*rest), F.struct("run_id", "seq"))
    return runs.groupBy("model").agg(row.alias("r")).select("model", "r.*")


def regression_metrics(pred: DataFrame, by: Sequence[str] = (), label: str = "y",
                       prediction: str = "prediction") -> DataFrame:
    """R2, RMSE and MAE in one aggregate over predictions."""
    y, e = F.col(label), F.col(label) - F.col(prediction)
    n = F.count(label)
    sse, sst = F.sum(e * e), F.var_pop(y) * n
    out = pred.groupBy(*by) if by else pred.groupBy()
    return out.agg(n.alias("n"), (1.0 - sse / F.nullif(sst, F.lit(0.0))).alias("r2"),
                   F.sqrt(sse / n).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def fold_summary(per_fold: DataFrame) -> DataFrame:
    """Mean and population sd of the metrics over folds."""
    aggs = []
    for m in ("r2", "rmse", "mae"):
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_sd")]
    return per_fold.agg(F.count(F.lit(1)).alias("n_folds"), *aggs)


def r2_weighted_ensemble(pred: DataFrame, scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Predictions of several models averaged with weights max(.001, R2) / sum."""
    w = scores.select("model", F.greatest(F.lit(0.001), F.col("r2")).alias("w"))
    return (pred.join(w, "model").groupBy(*keys)
            .agg((F.sum(F.col("prediction") * F.col("w")) / F.sum("w")).alias("prediction")))


def leakage_audit(splits: DataFrame) -> DataFrame:
    """Real and synthetic counts per fold and role, with a checksum of the synthetic ones."""
    real, syn = F.count_if(F.col("origin") == "real"), F.count_if(F.col("origin") != "real")
    return splits.groupBy("run_id", "fold", "role").agg(
        real.alias("n_real"), syn.alias("n_synthetic"))


def audit_checksum(audit: DataFrame) -> DataFrame:
    """One SHA-1 per run over the synthetic counts in validation and holdout."""
    held = audit.where(F.col("role").isin("validation", "holdout"))
    counts = F.sort_array(F.collect_list(F.struct("role", "fold", "n_synthetic")))
    text = F.to_json(F.struct(F.col("run_id"), F.col("counts")))
    return (held.groupBy("run_id").agg(counts.alias("counts"), F.sum("n_synthetic").alias("n_leaked"))
            .select("run_id", "n_leaked", F.sha1(text.cast("binary")).alias("checksum")))
