"""Run tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortframe.catalog import query
from cohortframe.functions.expr import one_row, round_columns
from cohortframe.operators import runs as R

MODELS = ["lightgbm", "randomforest", "ridge", "svr", "xgboost"]

CONTEXT = """CASE WHEN context IS NULL OR context = 'baseline' THEN 'baseline' WHEN context LIKE '%prompt_A%' THEN 'context_A'
  WHEN context LIKE '%context_B%' THEN 'context_B' WHEN context LIKE '%context_C%' THEN 'context_C'
  WHEN context LIKE '%prompt_E%' THEN 'context_E' ELSE context END"""


@query("ag11_summary_by_context", f"""
SELECT source, {CONTEXT} AS context_std, model, round(avg(holdout_r2), 6) AS holdout_r2, round(avg(rmse), 6) AS rmse,
  round(avg(cv_r2), 6) AS cv_r2, arg_min(n_samples, seq) AS n_samples FROM runs GROUP BY 1, 2, 3""")
def _(t):
    return round_columns(R.summary_by_context(t.runs), ["holdout_r2", "rmse", "cv_r2"])


@query("ag12_best_per_source", """
SELECT source, seq, model, context, round(holdout_r2, 6) AS holdout_r2 FROM
 (SELECT *, row_number() OVER (PARTITION BY source ORDER BY holdout_r2 DESC, seq) AS r FROM runs WHERE holdout_r2 IS NOT NULL) z WHERE r = 1""")
def _(t):
    return round_columns(R.best_per_source(t.runs).select("source", "seq", "model", "context", "holdout_r2"),
                         ["holdout_r2"])


def _pivot(col: str, names: list[str], agg: str, alias: str = "") -> str:
    return ", ".join(f"round({agg}(holdout_r2) FILTER ({col} = '{n}'), 6) AS {alias}{n}" for n in names)


@query("ag13_comparison_matrix", f"SELECT source, {_pivot('model', MODELS, 'max')} FROM runs GROUP BY source")
def _(t):
    return round_columns(R.comparison_matrix(t.runs, MODELS), MODELS)


CTX = ["baseline", "context_A", "context_B", "context_C", "context_D", "context_E"]


@query("ag13_context_matrix", f"""
WITH c AS (SELECT source, holdout_r2, {CONTEXT} AS c FROM runs) SELECT source, {_pivot('c', CTX, 'max')} FROM c GROUP BY source""")
def _(t):
    return round_columns(R.context_matrix(t.runs), CTX)


@query("ag13_k_matrix", f"SELECT model, {_pivot('k', ['1000', '2000', '3000'], 'avg', 'k')} FROM runs GROUP BY model")
def _(t):
    return round_columns(R.k_matrix(t.runs, [1000, 2000, 3000]), ["k1000", "k2000", "k3000"])


SEED = """
ms AS (SELECT model, count(*) AS n_runs, avg(cv_r2) AS cv_r2_mean, coalesce(stddev_samp(cv_r2), 0) AS cv_r2_sd,
  avg(holdout_r2) AS holdout_r2_mean, coalesce(stddev_samp(holdout_r2), 0) AS holdout_r2_sd, avg(rmse) AS rmse_mean,
  coalesce(stddev_samp(rmse), 0) AS rmse_sd, avg(mae) AS mae_mean, coalesce(stddev_samp(mae), 0) AS mae_sd,
  array_to_string(list_sort(list(DISTINCT run_id)), '|') AS run_ids
  FROM runs WHERE k = 2000 AND sigma = 1e0 AND model IN ('lightgbm', 'randomforest', 'svr', 'xgboost') AND holdout_r2 IS NOT NULL
  GROUP BY model HAVING count(*) >= 2)
"""
MS = ["cv_r2_mean", "cv_r2_sd", "holdout_r2_mean", "holdout_r2_sd", "rmse_mean", "rmse_sd", "mae_mean", "mae_sd"]


def multi(t):
    return R.multi_seed(t.runs, 2000, 1.0, ["lightgbm", "randomforest", "svr", "xgboost"], 2)


@query("ag14_multi_seed", f"WITH {SEED} SELECT model, n_runs, run_ids, {', '.join(f'round({c}, 6) AS {c}' for c in MS)} FROM ms")
def _(t):
    return round_columns(multi(t), MS)


@query("ag15_stability", f"""
WITH {SEED} SELECT model, round(holdout_r2_sd, 6) AS holdout_r2_sd,
  CASE WHEN row_number() OVER (ORDER BY holdout_r2_sd DESC, model) = 1 AND max(holdout_r2_sd) OVER () > 0 THEN 'Highest variance'
       WHEN holdout_r2_sd < 5e-3 THEN 'Stable' WHEN holdout_r2_sd < 15e-3 THEN 'Slightly variable' ELSE 'Variable' END AS note,
  CAST(row_number() OVER (ORDER BY holdout_r2_mean DESC, model) AS INTEGER) AS rank FROM ms""")
def _(t):
    return round_columns(R.stability(multi(t)).select("model", "holdout_r2_sd", "note", "rank"), ["holdout_r2_sd"])


@query("ag16_group_aggregates", """
SELECT source, model, round(avg(cv_r2), 6) AS cv_mean, round(stddev_pop(cv_r2), 6) AS cv_sd, round(avg(holdout_r2), 6) AS holdout_mean,
  round(stddev_pop(holdout_r2), 6) AS holdout_sd, count(*) AS n_runs FROM runs GROUP BY 1, 2""")
def _(t):
    return round_columns(R.group_aggregates(t.runs, ["source", "model"]),
                         ["cv_mean", "cv_sd", "holdout_mean", "holdout_sd"])


@query("ag16_cross_source_deltas", """
WITH m AS (SELECT model, coalesce(avg(holdout_r2) FILTER (source = 'alpha'), 0) AS a,
  coalesce(avg(holdout_r2) FILTER (source = 'beta'), 0) AS b, coalesce(avg(holdout_r2) FILTER (source = 'gamma'), 0) AS c FROM runs GROUP BY 1)
SELECT model, round(a, 6) AS alpha_mean, round(b, 6) AS beta_mean, round(c, 6) AS gamma_mean, round(a - b, 6) + 0.0 AS delta_alpha_beta,
  round(a - c, 6) + 0.0 AS delta_alpha_gamma, round(b - c, 6) + 0.0 AS delta_beta_gamma FROM m""")
def _(t):
    out = R.cross_source_deltas(t.runs, ["alpha", "beta", "gamma"])
    return round_columns(out, [c for c in out.columns if c != "model"])


@query("ag16_global_ranking", """
SELECT model, round(avg(holdout_r2), 6) AS holdout_mean, CAST(row_number() OVER (ORDER BY avg(holdout_r2) DESC, model) AS INTEGER) AS rank FROM runs GROUP BY 1""")
def _(t):
    return round_columns(R.global_ranking(t.runs), ["holdout_mean"])


@query("ag17_sweep_table", """
WITH m AS (SELECT * FROM runs WHERE model = 'randomforest'), b AS (SELECT avg(cv_r2) AS base FROM runs WHERE context = 'baseline'),
w AS (SELECT seq FROM m ORDER BY holdout_r2 DESC NULLS LAST, coalesce(rate, 9999), seed, seq LIMIT 1)
SELECT seq, rate, seed, k, round(cv_r2, 6) AS cv_r2, round(holdout_r2, 6) AS holdout_r2, coalesce(rate, 9999) AS rate_order,
  round(holdout_r2 - base, 6) + 0.0 AS delta_holdout, seq = (SELECT seq FROM w) AS is_best FROM m, b""")
def _(t):
    base = one_row(t.runs.where("context = 'baseline'").agg(F.avg("cv_r2").alias("b"))).getField("b")
    return round_columns(R.sweep_table(t.runs, "randomforest", base), ["cv_r2", "holdout_r2", "delta_holdout"])


@query("ag18_sigma_curve", """
SELECT sigma, round(avg(cv_r2), 6) AS cv_r2, round(avg(holdout_r2), 6) AS holdout_r2, count(*) AS n FROM runs GROUP BY 1""")
def _(t):
    return round_columns(R.metric_curve(t.runs, ["sigma"]), ["cv_r2", "holdout_r2"])


@query("ag18_rate_curve", """
SELECT k, rate, round(avg(cv_r2), 6) AS cv_r2, round(avg(holdout_r2), 6) AS holdout_r2, count(*) AS n FROM runs GROUP BY 1, 2""")
def _(t):
    return round_columns(R.metric_curve(t.runs, ["k", "rate"]), ["cv_r2", "holdout_r2"])


@query("ag19_original_vs_augmented", """
WITH o AS (SELECT model, avg(cv_r2) AS r2, avg(rmse) AS rmse, avg(mae) AS mae FROM runs WHERE context = 'baseline' AND model <> 'ridge' GROUP BY 1),
a AS (SELECT model, avg(holdout_r2) AS r2, avg(rmse) AS rmse, avg(mae) AS mae FROM runs WHERE context <> 'baseline' AND model <> 'svr' GROUP BY 1),
j AS (SELECT coalesce(o.model, a.model) AS model, o.r2 AS r2_orig, a.r2 AS r2_aug, a.r2 - o.r2 AS r2_delta, a.rmse - o.rmse AS rmse_delta,
  a.mae - o.mae AS mae_delta FROM o FULL JOIN a ON o.model = a.model)
SELECT model, round(r2_orig, 6) AS r2_orig, round(r2_aug, 6) AS r2_aug, round(r2_delta, 6) + 0.0 AS r2_delta, round(rmse_delta, 6) + 0.0 AS rmse_delta,
  round(mae_delta, 6) + 0.0 AS mae_delta,
  CASE WHEN r2_delta IS NULL THEN 'N/A' WHEN r2_delta > 1e-2 THEN 'up' WHEN r2_delta < -1e-2 THEN 'down' ELSE '' END AS r2_mark,
  CASE WHEN rmse_delta IS NULL THEN 'N/A' WHEN rmse_delta < -1e-2 THEN 'up' WHEN rmse_delta > 1e-2 THEN 'down' ELSE '' END AS rmse_mark
FROM j""")
def _(t):
    def side(df, r2):
        return df.groupBy("model").agg(F.avg(r2).alias("r2"), F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"))
    out = R.original_vs_augmented(side(t.runs.where("context = 'baseline' AND model <> 'ridge'"), "cv_r2"),
                                  side(t.runs.where("context <> 'baseline' AND model <> 'svr'"), "holdout_r2"))
    return round_columns(out.select("model", "r2_orig", "r2_aug", "r2_delta", "rmse_delta", "mae_delta", "r2_mark", "rmse_mark"),
                         ["r2_orig", "r2_aug", "r2_delta", "rmse_delta", "mae_delta"])


@query("ag20_augmentation_gain", """
WITH a AS (SELECT model, avg(holdout_r2) AS h FROM runs WHERE context <> 'baseline' GROUP BY 1),
b AS (SELECT model, avg(cv_r2) AS c FROM runs WHERE context = 'baseline' AND model <> 'svr' GROUP BY 1)
SELECT model, round(h, 6) AS holdout_mean, round(c, 6) AS baseline_cv, round(h - coalesce(c, 0), 6) + 0.0 AS gain FROM a LEFT JOIN b USING (model)""")
def _(t):
    out = R.augmentation_gain(t.runs.where("context <> 'baseline'"),
                              t.runs.where("context = 'baseline' AND model <> 'svr'"))
    return round_columns(out, ["holdout_mean", "baseline_cv", "gain"])


FIELDS = ["model", "run_id", "holdout_r2", "rate", "context", "timestamp"]


@query("ag21_schema_audit", """
SELECT 'model' AS field, count(*) - count(model) AS n_missing, true AS present FROM runs UNION ALL SELECT 'run_id', count(*) - count(run_id), true FROM runs
UNION ALL SELECT 'holdout_r2', count(*) - count(holdout_r2), true FROM runs UNION ALL SELECT 'rate', count(*) - count(rate), true FROM runs
UNION ALL SELECT 'context', count(*) - count(context), true FROM runs UNION ALL SELECT 'timestamp', count(*), false FROM runs""")
def _(t):
    return R.schema_audit(t.runs, FIELDS)


@query("ag21_backfill", """
WITH a AS (SELECT model, run_id, count(*) AS n, round(max(cv_r2), 6) AS cv_r2 FROM runs GROUP BY 1, 2),
p AS (SELECT * FROM a WHERE n > 2)
SELECT model, run_id, cv_r2, (SELECT count(*) FROM p WHERE p.model = a.model AND p.run_id = a.run_id) = 0 AS backfilled FROM a""")
def _(t):
    agg = round_columns(t.runs.groupBy("model", "run_id").agg(F.count(F.lit(1)).alias("n"), F.max("cv_r2").alias("cv_r2")), ["cv_r2"])
    return R.backfill(agg.where("n > 2"), agg).select("model", "run_id", "cv_r2", "backfilled")


@query("ag22_latest_runs", """
SELECT model, run_id, seq, round(cv_r2, 6) AS cv_r2 FROM
 (SELECT *, row_number() OVER (PARTITION BY model ORDER BY run_id DESC, seq DESC) AS r FROM runs) z WHERE r = 1""")
def _(t):
    return round_columns(R.latest_runs(t.runs).select("model", "run_id", "seq", "cv_r2"), ["cv_r2"])
