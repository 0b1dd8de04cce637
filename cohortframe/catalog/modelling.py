"""Splits, regressors and their scoring."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from cohortframe.catalog import query
from cohortframe.functions.expr import one_row, round_columns, rounded
from cohortframe.operators import modeling as M
from cohortframe.operators import popgen as G
from cohortframe.operators import runs as R
from cohortframe.operators import trees as T
from cohortframe.session import cut_lineage, measured


def u(*parts: str) -> str:
    """The hashed uniform in checking SQL."""
    return f"((('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT * 1e0 + 5e-1) / 4503599627370496e0)"


SAMPLES = """
sp AS (SELECT sample_id, 'real' AS origin FROM pheno UNION ALL SELECT sample_id, 'synthetic' FROM synth_pheno)"""

FOLDS = SAMPLES + f""",
fo AS (SELECT sample_id, origin, CASE WHEN origin = 'real' THEN CASE WHEN {u("'42'", "'holdout'", 'sample_id')} < 2e-1 THEN -1
       ELSE CAST(floor({u("'42'", "'fold'", 'sample_id')} * 5) AS INTEGER) END END AS own FROM sp)"""

SPLITS = FOLDS + """,
sl AS (SELECT CAST(f.fold AS INTEGER) AS fold, CASE WHEN own = f.fold THEN 'validation' ELSE 'train' END AS role, sample_id, origin
       FROM fo, (SELECT unnest([0, 1, 2, 3, 4]) AS fold) f WHERE own IS NULL OR own >= 0
       UNION ALL SELECT -1, 'holdout', sample_id, origin FROM fo WHERE own = -1)"""


def samples(t):
    return t.pheno.select("sample_id", F.lit("real").alias("origin")).unionByName(
        t.synth_pheno.select("sample_id", F.lit("synthetic").alias("origin")))


@query("ml1_leak_guarded_splits", f"WITH {SPLITS} SELECT fold, role, sample_id, origin FROM sl")
def _(t):
    return M.leak_guarded_splits(samples(t))


@query("ml1_synthetic_only_splits", f"WITH {SPLITS} SELECT fold, role, sample_id, origin FROM sl WHERE NOT (origin = 'real' AND role = 'train')")
def _(t):
    return M.leak_guarded_splits(samples(t), synthetic_only=True)


@query("ml1_evaluation_leaks", f"""
WITH {SPLITS} SELECT count(*) FILTER (role <> 'train' AND origin <> 'real') AS n_synthetic_evaluated,
  (SELECT count(*) FROM (SELECT fold, sample_id FROM sl GROUP BY 1, 2 HAVING count(DISTINCT role) > 1) z) AS n_two_roles FROM sl""")
def _(t):
    found = M.evaluation_leaks(M.leak_guarded_splits(samples(t)))
    return found.agg(F.count_if(F.col("problem") == "synthetic_evaluated").alias("n_synthetic_evaluated"),
                     F.count_if(F.col("problem") == "two_roles").alias("n_two_roles"))


@query("ml2_plain_split", f"""
SELECT sample_id, CASE WHEN {u("'42'", "'split'", 'sample_id')} < 7e-1 THEN 'train' WHEN {u("'42'", "'split'", 'sample_id')} < 85e-2 THEN 'validation' ELSE 'test' END AS part FROM pheno""")
def _(t):
    return M.plain_split(t.pheno, {"train": 0.7, "validation": 0.15, "test": 0.15})


@query("ml8_mean_baseline", f"""
WITH {FOLDS}, k AS (SELECT p.sample_id, y, own FROM pheno p JOIN fo USING (sample_id) WHERE y IS NOT NULL)
SELECT sample_id, y, round((SELECT avg(y) FROM k WHERE own >= 0), 6) AS prediction FROM k WHERE own = -1""")
def _(t):
    rows = M.assign_folds(samples(t)).join(t.pheno.where("y IS NOT NULL"), "sample_id")
    return round_columns(M.mean_baseline(rows.where("fold >= 0"), rows.where("fold = -1")), ["prediction"])


PRED = """
pr AS (SELECT seq, model, seed AS fold, source, rmse AS y, cv_r2 + rmse * 5e-1 AS prediction FROM runs),
m AS (SELECT model, fold, count(y) AS n, 1 - sum((y - prediction) * (y - prediction)) / nullif(var_pop(y) * count(y), 0) AS r2,
  sqrt(avg((y - prediction) * (y - prediction))) AS rmse, avg(abs(y - prediction)) AS mae FROM pr GROUP BY 1, 2)"""


def predictions(t):
    return t.runs.select("seq", "model", F.col("seed").alias("fold"), F.col("rmse").alias("y"),
                         (F.col("cv_r2") + F.col("rmse") * 0.5).alias("prediction"))


@query("ml10_metrics", f"WITH {PRED} SELECT model, fold, n, round(r2, 6) AS r2, round(rmse, 6) AS rmse, round(mae, 6) AS mae FROM m")
def _(t):
    return round_columns(R.regression_metrics(predictions(t), ["model", "fold"]), ["r2", "rmse", "mae"])


FS = ["r2_mean", "r2_sd", "rmse_mean", "rmse_sd", "mae_mean", "mae_sd"]


@query("ml10_fold_summary", f"""
WITH {PRED} SELECT count(*) AS n_folds, round(avg(r2), 6) AS r2_mean, round(stddev_pop(r2), 6) AS r2_sd, round(avg(rmse), 6) AS rmse_mean,
  round(stddev_pop(rmse), 6) AS rmse_sd, round(avg(mae), 6) AS mae_mean, round(stddev_pop(mae), 6) AS mae_sd FROM m""")
def _(t):
    return round_columns(R.fold_summary(R.regression_metrics(predictions(t), ["model", "fold"])), FS)


@query("ml12_r2_ensemble", """
WITH s AS (SELECT model, greatest(1e-3, avg(cv_r2)) AS w FROM runs GROUP BY 1)
SELECT k, seed, round(sum(rmse * w) / sum(w), 6) AS prediction FROM runs JOIN s USING (model) GROUP BY 1, 2""")
def _(t):
    pred = t.runs.select("k", "seed", "model", F.col("rmse").alias("prediction"))
    scores = t.runs.groupBy("model").agg(F.avg("cv_r2").alias("r2"))
    return round_columns(R.r2_weighted_ensemble(pred, scores, ["k", "seed"]), ["prediction"])


AUDIT = SPLITS + """,
au AS (SELECT 'r1' AS run_id, fold, role, count(*) FILTER (origin = 'real') AS n_real, count(*) FILTER (origin <> 'real') AS n_synthetic FROM sl GROUP BY 2, 3)"""


@query("ml13_leakage_audit", f"WITH {AUDIT} SELECT * FROM au")
def _(t):
    return R.leakage_audit(M.leak_guarded_splits(samples(t)).withColumn("run_id", F.lit("r1")))


@query("ml13_audit_checksum", f"""
WITH {AUDIT} SELECT run_id, CAST(sum(n_synthetic) AS BIGINT) AS n_leaked, sha1(concat('{{"run_id":"', run_id, '","counts":[',
  string_agg(concat('{{"role":"', role, '","fold":', fold, ',"n_synthetic":', n_synthetic, '}}'), ',' ORDER BY role, fold), ']}}')) AS checksum
FROM au WHERE role <> 'train' GROUP BY run_id""")
def _(t):
    return R.audit_checksum(R.leakage_audit(M.leak_guarded_splits(samples(t)).withColumn("run_id", F.lit("r1"))))


@query("ml16_linear_importance", """
WITH w AS (SELECT var_id, covar_pop(dosage, y) / nullif(stddev_pop(dosage) * stddev_pop(y), 0) AS weight
  FROM geno JOIN pheno USING (sample_id) WHERE dosage IS NOT NULL AND y IS NOT NULL GROUP BY 1),
m AS (SELECT var_id, avg(dosage) AS m FROM geno GROUP BY 1),
i AS (SELECT var_id, avg(abs(weight * (dosage - m))) AS importance FROM geno JOIN w USING (var_id) JOIN m USING (var_id) GROUP BY 1)
SELECT var_id, round(importance, 6) AS importance FROM i ORDER BY round(importance, 9) DESC NULLS LAST, var_id LIMIT 20""")
def _(t):
    w = G.target_correlation(t.geno, t.pheno).select("var_id", F.col("r").alias("weight"))
    return round_columns(M.linear_importance(t.geno, w), ["importance"])


@query("ml16_importance_counts", """
WITH w AS (SELECT var_id, covar_pop(dosage, y) / nullif(stddev_pop(dosage) * stddev_pop(y), 0) AS weight
  FROM geno JOIN pheno USING (sample_id) WHERE dosage IS NOT NULL AND y IS NOT NULL GROUP BY 1),
m AS (SELECT var_id, avg(dosage) AS m FROM geno GROUP BY 1),
i AS (SELECT var_id, avg(abs(weight * (dosage - m))) AS importance FROM geno JOIN w USING (var_id) JOIN m USING (var_id) GROUP BY 1)
SELECT count(*) AS n, count(*) FILTER (importance > 1e-2) AS above_0, count(*) FILTER (importance > 5e-2) AS above_1, count(*) FILTER (importance > 1e-1) AS above_2 FROM i""")
def _(t):
    w = G.target_correlation(t.geno, t.pheno).select("var_id", F.col("r").alias("weight"))
    return M.importance_counts(M.linear_importance(t.geno, w, k=None), [0.01, 0.05, 0.1])


@query("ml18_sequence_windows", """
WITH r AS (SELECT o_orderkey, floor(o_totalprice) AS y, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position FROM orders),
w AS (SELECT position, list(y) OVER (ORDER BY position ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS win, y FROM r)
SELECT position, list_sum(win) AS window_sum, win[1] AS first_y, y AS target FROM w WHERE position >= 10""")
def _(t):
    rows = t.orders.select("o_orderdate", "o_orderkey", F.floor("o_totalprice").cast("double").alias("y"))
    out = M.sequence_windows(rows, ["o_orderdate", "o_orderkey"])
    return out.select("position", F.aggregate("window", F.lit(0.0), lambda a, x: a + x).alias("window_sum"),
                      F.col("window")[0].alias("first_y"), "target")


XY = """
xy AS (SELECT seq, rmse AS x, cv_r2 * 3e0 + seed AS y FROM runs),
c AS (SELECT avg(x) AS mx, avg(y) AS my, covar_pop(x, y) * count(*) AS sxy, var_pop(x) * count(*) AS sxx FROM xy)"""


def _one_feature(t):
    return t.runs.select(F.col("seq").alias("sample_id"), array_to_vector(F.array("rmse")).alias("features"),
                         (F.col("cv_r2") * 3.0 + F.col("seed")).alias("y"))


@query("ml3_ridge_one_marker", f"WITH {XY} SELECT seq AS sample_id, round(my + sxy / (sxx + 500) * (x - mx), 6) + 0.0 AS prediction FROM xy, c")
def _(t):
    rows = _one_feature(t)
    return round_columns(M.predict(M.fit("ridge", {"alpha": 500.0}, rows), rows).select("sample_id", "prediction"), ["prediction"])


# the 2 x 2 system of two markers, written out
@query("ml3_marker_ridge_two", """
WITH k AS (SELECT sample_id, y - avg(y) OVER () AS y FROM pheno WHERE y IS NOT NULL),
g AS (SELECT sample_id, var_id, dosage - avg(dosage) OVER (PARTITION BY var_id) AS z FROM geno JOIN k USING (sample_id) WHERE dosage IS NOT NULL AND var_id IN ('V0003', 'V0042')),
s AS (SELECT sample_id, y, coalesce(max(z) FILTER (var_id = 'V0003'), 0) AS a, coalesce(max(z) FILTER (var_id = 'V0042'), 0) AS b FROM k LEFT JOIN g USING (sample_id) GROUP BY 1, 2),
m AS (SELECT alpha, sum(a * a) + alpha AS aa, sum(a * b) AS ab, sum(b * b) + alpha AS bb, sum(a * y) AS ay, sum(b * y) AS y2 FROM s CROSS JOIN (VALUES (1e0), (1e1)) AS v(alpha) GROUP BY alpha)
SELECT 'V0003' AS var_id, alpha, round((bb * ay - ab * y2) / (aa * bb - ab * ab), 5) + 0.0 AS weight FROM m
UNION ALL SELECT 'V0042', alpha, round((aa * y2 - ab * ay) / (aa * bb - ab * ab), 5) + 0.0 FROM m""")
def _(t):
    z = centred(t).where(F.col("var_id").isin("V0003", "V0042"))
    return round_columns(M.marker_ridge(z, t.pheno, [1.0, 10.0])[0], ["weight"], 5)


def centred(t):
    known = t.pheno.where("y IS NOT NULL").select("sample_id")
    cells = t.geno.where("dosage IS NOT NULL").join(known, "sample_id")
    means = cells.groupBy("var_id").agg(F.avg("dosage").alias("m"))
    return cells.join(means, "var_id").select("sample_id", "var_id", (F.col("dosage") - F.col("m")).alias("z"))


# every marker and ten penalties: at the solution Z'(y - Z w) = alpha w for each marker
@query("ml3_marker_ridge", """
WITH g AS (SELECT DISTINCT var_id FROM geno JOIN pheno USING (sample_id) WHERE dosage IS NOT NULL AND y IS NOT NULL)
SELECT i AS penalty, (SELECT count(*) FROM g) AS n_variants, 0e0 AS largest_gap FROM (SELECT unnest(generate_series(0, 9)) AS i) z""")
def _(t):
    z = cut_lineage(centred(t).repartition("sample_id"))
    alphas = [10 ** (-3 + 6 * i / 9) for i in range(10)]
    weights, mean = M.marker_ridge(z, t.pheno, alphas, tol=1e-4)
    # a sample's residuals of all penalties in one row: a cell is multiplied by each and never written once per penalty
    told = M.marker_predictions(z, weights, mean).groupBy("sample_id").agg(*[F.max(F.when(F.col("alpha") == a, F.col("prediction"))).alias(f"p{i}") for i, a in enumerate(alphas)])
    left = told.join(t.pheno.where("y IS NOT NULL"), "sample_id").select("sample_id", (F.col("y") - mean).alias("y"), *[(F.col("y") - F.col(f"p{i}")).alias(f"e{i}") for i in range(len(alphas))])
    sums = cut_lineage(z.join(measured(cut_lineage(left)), "sample_id").groupBy("var_id").agg(F.sum(F.col("z") * F.col("y")).alias("s"), *[F.sum(F.col("z") * F.col(f"e{i}")).alias(f"s{i}") for i in range(len(alphas))]))
    at_zero = sums.agg(F.max(F.abs("s")).alias("s"))
    each = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.col(f"s{i}").alias("s")) for i, a in enumerate(alphas)]))
    slope = sums.select("var_id", each.alias("_e")).select("var_id", "_e.*").join(weights, ["alpha", "var_id"])
    gap = F.max(F.abs(F.col("s") - F.col("alpha") * F.col("weight"))) / one_row(at_zero).getField("s")      # against the slope at zero weights
    penalty = F.round((F.log10("alpha") + 3.0) * 1.5).cast("long").alias("penalty")
    return slope.groupBy("alpha").agg(F.count(F.lit(1)).alias("n_variants"), gap.alias("gap")).select(penalty, "n_variants", rounded("gap", 2).alias("largest_gap"))


@query("ml4_ols_one_marker", f"WITH {XY} SELECT seq AS sample_id, round(my + sxy / sxx * (x - mx), 6) + 0.0 AS prediction FROM xy, c")
def _(t):
    rows = _one_feature(t)
    return round_columns(M.predict(M.fit("ols", {}, rows), rows).select("sample_id", "prediction"), ["prediction"])


@query("ml4_lasso_one_marker", f"""
WITH {XY} SELECT seq AS sample_id, round(my + sign(sxy) * greatest(0, abs(sxy) - 2e-2 * (SELECT count(*) FROM xy)) / sxx * (x - mx), 5) + 0.0 AS prediction FROM xy, c""")
def _(t):
    rows = _one_feature(t)
    return round_columns(M.predict(M.fit("lasso", {"alpha": 0.02}, rows), rows).select("sample_id", "prediction"), ["prediction"], 5)


# ---- fitted models: rows and invariants ---------------------------------------

def all_geno(t):
    real = t.geno.where("dosage IS NOT NULL").select("sample_id", "var_id", F.col("dosage").cast("double").alias("dosage"))
    return real.unionByName(t.synth.where("dosage IN (0, 1, 2)").select("sample_id", "var_id", "dosage"))


def all_y(t):
    return t.pheno.select("sample_id", "y").unionByName(t.synth_pheno.select("sample_id", "y"))


def embedded(t):
    """Embedding vectors as features, label as target."""
    return t.vectors.select("sample_id", "origin", array_to_vector(F.col("features").cast("array<double>")).alias("features"),
                            (F.col("y") + F.col("features")[0] * 3).alias("y"))


def _scored(t, kind, params):
    rows = embedded(t)
    folds = M.assign_folds(rows.select("sample_id", F.lit("real").alias("origin")))
    both = rows.join(folds.select("sample_id", "fold"), "sample_id")
    pred = M.predict(M.fit(kind, params, both.where("fold >= 0")), both.where("fold = -1"))
    return round_columns(pred, ["y", "prediction"])


# the normal equations X'(Xw + c) + alpha w = X'y, feature by feature, and for the intercept (feature -1)
NORMAL = """
WITH f AS (SELECT CAST(features AS DOUBLE[]) AS f, y + features[1] * 3 AS y FROM vectors),
u AS (SELECT y, unnest(f) AS x, generate_subscripts(f, 1) - 1 AS feature FROM f)
SELECT CAST(feature AS INT) AS feature, round(sum(x * y), 3) + 0.0 AS product FROM u GROUP BY 1 UNION ALL SELECT -1, round(sum(y), 3) + 0.0 FROM f"""


def _normal(t, kind, alpha):
    rows = embedded(t).drop("origin")
    model = M.fit(kind, {"alpha": alpha}, rows)
    pred = M.predict(model, rows).join(rows.select("sample_id", vector_to_array("features").alias("x")), "sample_id")
    weights = F.array(*[F.lit(float(w)) for w in model.coefficients])
    sums = pred.select(F.posexplode("x").alias("feature", "x"), "prediction").groupBy("feature").agg(F.sum(F.col("x") * F.col("prediction")).alias("s"))
    out = sums.select("feature", (F.col("s") + alpha * F.element_at(weights, F.col("feature") + 1)).alias("product"))
    whole = pred.agg(F.lit(-1).alias("feature"), F.sum("prediction").alias("product"))
    return out.unionByName(whole).select("feature", (rounded("product", 3) + 0.0).alias("product"))


@query("ml3_ridge_normal_equations", NORMAL)
def _(t):
    return _normal(t, "ridge", 1.0)


@query("ml4_ols_normal_equations", NORMAL)
def _(t):
    return _normal(t, "ols", 0.0)


@query("ml3_ridge")
def _(t):
    return _scored(t, "ridge", {"alpha": 1.0})


@query("ml4_ols")
def _(t):
    return _scored(t, "ols", {})


@query("ml4_lasso")
def _(t):
    return _scored(t, "lasso", {"alpha": 0.01})


@query("ml4_elasticnet")
def _(t):
    return _scored(t, "elasticnet", {"alpha": 0.01, "l1_ratio": 0.5})


@query("ml5_random_forest")
def _(t):
    return _scored(t, "randomforest", {"n_estimators": 75, "max_depth": 15})


@query("ml6_boosted_trees")
def _(t):
    return _scored(t, "boosting", {"n_estimators": 20, "max_depth": 4})


@query("ml7_pca_ridge")
def _(t):
    folds = M.assign_folds(t.pheno.select("sample_id", F.lit("real").alias("origin")))
    pred = M.pca_regression(t.geno, t.pheno, folds.where("fold >= 0"), folds.where("fold = -1"), 16)
    return round_columns(pred, ["y", "prediction"])


@query("ml9_nested_cv")
def _(t):
    out = M.nested_cv(all_geno(t), all_y(t), samples(t), "ridge", {"alpha": [1.0, 100.0]}, k=40, outer=3, inner=2)
    folds = out.folds.select(F.col("fold").cast("int").alias("fold"), "n", "r2", "rmse", "mae")
    held = out.holdout.select(F.lit(-1).alias("fold"), "n", "r2", "rmse", "mae")
    return round_columns(folds.unionByName(held), ["r2", "rmse", "mae"])


KINDS = {"ridge": {"alpha": 1.0}, "randomforest": {"n_estimators": 10, "max_depth": 5}}


def _oof(t):
    rows = embedded(t)
    folds = rows.select("sample_id", M.u01(42, F.lit("fold"), "sample_id").alias("u")).select(
        "sample_id", F.floor(F.col("u") * 3).cast("int").alias("fold"))
    return M.out_of_fold(rows.drop("origin"), folds, KINDS, 3)


@query("ml11_stacking")
def _(t):
    return round_columns(M.stacked_prediction(_oof(t), list(KINDS)), ["y", "prediction"])


HELD = f"""
SELECT concat(CASE WHEN label % 2 = 0 THEN 'R' ELSE 'SYNTHETIC_' END, CAST(vec_id AS STRING)) AS sample_id FROM embeddings WHERE label % 2 = 0"""


@query("ml11_stack_holdout", f"WITH r AS ({HELD}) SELECT sample_id, true AS scored FROM r WHERE {u("'42'", "'holdout'", 'sample_id')} < 2e-1")
def _(t):
    rows = embedded(t)
    folds = M.assign_folds(rows.select("sample_id", "origin"), k=3)
    out = M.stacked_holdout(rows.drop("origin"), folds, KINDS, 3)
    lo, hi = (one_row(rows.where("origin = 'real'").agg(f("y").alias("v"))).getField("v") for f in (F.min, F.max))
    inside = F.col("prediction").between(lo - (hi - lo), hi + (hi - lo))
    return out.select("sample_id", inside.alias("scored"))


@query("ml12_oof_ensemble")
def _(t):
    return round_columns(M.ensemble(_oof(t)), ["y", "prediction"])


@query("ml14_few_shot_curve")
def _(t):
    rows = embedded(t)
    folds = M.assign_folds(rows.select("sample_id", "origin"))
    return round_columns(M.few_shot_curve(rows.drop("origin"), folds), ["r2", "rmse", "mae"])


@query("ml15_scenario_benchmark")
def _(t):
    rows = embedded(t)
    folds = M.assign_folds(rows.select("sample_id", "origin"))
    both = rows.drop("origin").join(folds, "sample_id")
    real, syn = both.where("origin = 'real' AND fold >= 0"), both.where("origin <> 'real'")
    sets = {"baseline": real, "hybrid": real.unionByName(syn), "synthetic_only": syn}
    out = M.scenario_benchmark(sets, both.where("fold = -1"), params={"n_estimators": 20, "max_depth": 5})
    return round_columns(out.orderBy("rmse"), ["r2", "rmse", "mae"])


# ---- lasso and elastic net on all markers

# two markers: of the nine sign patterns the one that satisfies the optimality conditions
@query("ml4_marker_net_two", """
WITH k AS (SELECT sample_id, y - avg(y) OVER () AS y FROM pheno WHERE y IS NOT NULL),
g AS (SELECT sample_id, var_id, dosage - avg(dosage) OVER (PARTITION BY var_id) AS z FROM geno JOIN k USING (sample_id) WHERE dosage IS NOT NULL AND var_id IN ('V0003', 'V0042')),
s AS (SELECT sample_id, y, coalesce(max(z) FILTER (var_id = 'V0003'), 0) AS a, coalesce(max(z) FILTER (var_id = 'V0042'), 0) AS b FROM k LEFT JOIN g USING (sample_id) GROUP BY 1, 2),
m AS (SELECT kind, l1, sum(a * a) / count(*) + l2 AS aa, sum(a * b) / count(*) AS ab, sum(b * b) / count(*) + l2 AS bb, sum(a * y) / count(*) AS ay, sum(b * y) / count(*) AS y2
      FROM s CROSS JOIN (VALUES ('lasso', 2e-2, 0e0), ('net', 1e-2, 1e-2)) AS v(kind, l1, l2) GROUP BY kind, l1, l2),
w AS (SELECT *, CASE WHEN i = 0 THEN 0 WHEN j = 0 THEN (ay - l1 * i) / aa ELSE (bb * (ay - l1 * i) - ab * (y2 - l1 * j)) / (aa * bb - ab * ab) END AS wa,
             CASE WHEN j = 0 THEN 0 WHEN i = 0 THEN (y2 - l1 * j) / bb ELSE (aa * (y2 - l1 * j) - ab * (ay - l1 * i)) / (aa * bb - ab * ab) END AS wb
      FROM m, (SELECT unnest([-1, 0, 1]) AS i) p, (SELECT unnest([-1, 0, 1]) AS j) q),
o AS (SELECT * FROM w WHERE sign(wa) = i AND sign(wb) = j AND (i <> 0 OR abs(ay - ab * wb) <= l1) AND (j <> 0 OR abs(y2 - ab * wa) <= l1))
SELECT kind, 'V0003' AS var_id, round(wa, 5) + 0.0 AS weight FROM o WHERE i <> 0 UNION ALL SELECT kind, 'V0042', round(wb, 5) + 0.0 FROM o WHERE j <> 0""")
def _(t):
    z = centred(t).where(F.col("var_id").isin("V0003", "V0042"))
    parts = [M.marker_lasso(z, t.pheno, 0.02, ratio)[0].select(F.lit(kind).alias("kind"), "var_id", "weight") for kind, ratio in (("lasso", 1.0), ("net", 0.5))]
    return round_columns(parts[0].unionByName(parts[1]), ["weight"], 5)


def _net_gaps(t, alpha, ratio):
    """Over every marker: by how much the optimality conditions are missed, against the slope at zero weights."""
    z, known = cut_lineage(centred(t).repartition("sample_id")), t.pheno.where("y IS NOT NULL").select("sample_id", "y")
    weights, mean = M.marker_lasso(z, t.pheno, alpha, ratio)
    told = M.marker_predictions(z, weights, mean).drop("alpha")
    left = known.join(told, "sample_id", "left").select("sample_id", (F.col("y") - F.coalesce("prediction", F.lit(mean))).alias("e"), (F.col("y") - mean).alias("y"))
    n = one_row(known.agg(F.count(F.lit(1)).alias("n"))).getField("n")
    slope = z.join(measured(cut_lineage(left)), "sample_id").groupBy("var_id").agg((F.sum(F.col("z") * F.col("e")) / n).alias("g"), (F.sum(F.col("z") * F.col("y")) / n).alias("g0"))
    both = slope.join(weights, "var_id", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    pull = F.col("g") - alpha * (1.0 - ratio) * F.col("weight")
    gap = F.when(F.col("weight") == 0, F.greatest(F.lit(0.0), F.abs("g") - alpha * ratio)).otherwise(F.abs(pull - alpha * ratio * F.signum("weight")))
    return both.agg(F.count(F.lit(1)).alias("n_variants"), (F.count_if(F.col("weight") != 0) > 0).alias("some"), (F.max(gap) / F.max(F.abs("g0"))).alias("gap"))


NET_GAPS = "SELECT count(DISTINCT var_id) AS n_variants, true AS some, 0e0 AS largest_gap FROM geno JOIN pheno USING (sample_id) WHERE dosage IS NOT NULL AND y IS NOT NULL"


@query("ml4_marker_lasso", NET_GAPS)
def _(t):
    return _net_gaps(t, 0.02, 1.0).select("n_variants", "some", rounded("gap", 4).alias("largest_gap"))


@query("ml4_marker_elasticnet", NET_GAPS)
def _(t):
    return _net_gaps(t, 0.02, 0.5).select("n_variants", "some", rounded("gap", 4).alias("largest_gap"))


# ---- trees on all markers, level by level, written out in SQL

def _tree_sql(source: str, name: str, depth: int, min_leaf: int, share: float | None = None) -> str:
    """CTEs that grow ``source (tree, sample_id, y, w, node)``: ``<name>w<level>`` has a level's splits, ``<name>s`` the rows in their leaves."""
    parts, now = [], source
    drawn = u("'42'", "'feature'", "tree", "node", "var_id")
    pick = f"AND {drawn} < {share}" if share else ""
    for level in range(depth):
        own = f"{name}w{level}"
        parts.append(f"""
{name}t{level} AS (SELECT tree, node, sum(w) AS n, sum(w * y) AS s FROM {now} WHERE node >= {1 << level} GROUP BY 1, 2),
{name}h{level} AS (SELECT tree, node, var_id, unnest([0, 1]) AS cut, unnest([sum(w), sum(CASE WHEN dosage = 2 THEN w ELSE 0 END)]) AS nr,
  unnest([sum(w * y), sum(CASE WHEN dosage = 2 THEN w * y ELSE 0 END)]) AS sr
  FROM {now} JOIN tcells USING (sample_id) WHERE node >= {1 << level} {pick} GROUP BY 1, 2, 3),
{name}g{level} AS (SELECT tree, node, var_id, cut, (s - sr) * (s - sr) / (n - nr) + sr * sr / nr - s * s / n AS gain
  FROM {name}h{level} JOIN {name}t{level} USING (tree, node) WHERE nr >= {min_leaf} AND n - nr >= {min_leaf}),
{own} AS (SELECT tree, node, var_id, cut, gain FROM {name}g{level} WHERE gain > 1e-6
  QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY round(gain, 6) DESC, var_id, cut) = 1),
{name}r{level} AS ({_walked(now, own, "x.y, x.w")})""")
        now = f"{name}r{level}"
    parts.append(f"""
{name}s AS (SELECT * FROM {now}), {name}v AS (SELECT tree, node, sum(w * y) / sum(w) AS value FROM {now} GROUP BY 1, 2)""")
    return ",".join(parts)


def _walked(rows: str, splits: str, more: str = "0 AS y") -> str:
    return f"""SELECT x.tree, x.sample_id, {more}, CASE WHEN s.cut IS NULL THEN x.node ELSE x.node * 2 + CASE WHEN coalesce(dosage, 0) > s.cut THEN 1 ELSE 0 END END AS node
  FROM {rows} x LEFT JOIN {splits} s ON s.tree = x.tree AND s.node = x.node LEFT JOIN tcells c ON c.sample_id = x.sample_id AND c.var_id = s.var_id"""


CELLS = """
tcells AS (SELECT sample_id, var_id, dosage FROM geno WHERE dosage > 0),
tknown AS (SELECT sample_id, y FROM pheno WHERE y IS NOT NULL)"""
DRAWS = u("'42'", "'draw'", "tree", "sample_id")
DRAWN = " + ".join(f"CASE WHEN {DRAWS} >= {p!r} THEN 1e0 ELSE 0e0 END" for p in T.POISSON)
FOREST_TREES, FOREST_DEPTH, BOOST_ROUNDS, BOOST_DEPTH = 12, 3, 4, 2
FOREST = f"""{CELLS},
f0 AS (SELECT * FROM (SELECT tree, sample_id, y, {DRAWN} AS w, 1 AS node FROM tknown, (SELECT unnest(range({FOREST_TREES})) AS tree) z) q WHERE w > 0),{_tree_sql("f0", "f", FOREST_DEPTH, 2, 0.5)}"""
WALK = ", ".join(f"p{i + 1} AS ({_walked(f'p{i}', f'fw{i}')})" for i in range(FOREST_DEPTH))
SPLIT = " UNION ALL ".join(f"SELECT var_id, gain FROM fw{i}" for i in range(FOREST_DEPTH))


def _boosted_sql() -> str:
    parts = [CELLS, "m AS (SELECT avg(y) AS m FROM tknown)", "q0 AS (SELECT 0 AS tree, sample_id, y - m AS y, 1e0 AS w, 1 AS node FROM tknown, m)"]
    for k in range(BOOST_ROUNDS):
        parts.append(_tree_sql(f"q{k}", f"k{k}", BOOST_DEPTH, 2))
        parts.append(f"q{k + 1} AS (SELECT {k + 1} AS tree, sample_id, y - value * 1e-1 AS y, 1e0 AS w, 1 AS node FROM k{k}s JOIN k{k}v USING (tree, node))")
    # what is left after all rounds tells the prediction of a training row
    return f"WITH {', '.join(parts)} SELECT sample_id, round(tknown.y, 6) AS y, round(tknown.y - q.y, 5) + 0.0 AS prediction FROM q{BOOST_ROUNDS} q JOIN tknown USING (sample_id)"


@query("ml5_first_level_gains", f"""
WITH {CELLS}, f0 AS (SELECT 0 AS tree, sample_id, y, 1e0 AS w, 1 AS node FROM tknown),{_tree_sql("f0", "f", 1, 1)}
SELECT var_id, CAST(cut AS INTEGER) AS cut, round(gain, 6) + 0.0 AS gain FROM fg0""")
def _(t):
    state = t.pheno.where("y IS NOT NULL").select(F.lit(0).alias("tree"), "sample_id", "y", F.lit(1.0).alias("w"), F.lit(1).cast("long").alias("node"))
    return round_columns(T.split_gains(t.geno, state).select("var_id", "cut", "gain"), ["gain"])


def _forest(t):
    return T.fit_forest(t.geno, t.pheno, FOREST_TREES, FOREST_DEPTH, 0.5, 2.0)


# every row of the table walks all trees, drawn or not
@query("ml5_marker_forest", f"""
WITH {FOREST}, p0 AS (SELECT DISTINCT tree, sample_id, 1 AS node FROM pheno, (SELECT DISTINCT tree FROM f0) z), {WALK}
SELECT sample_id, round(sum(value) / {FOREST_TREES}, 6) + 0.0 AS prediction FROM p{FOREST_DEPTH} JOIN fv USING (tree, node) GROUP BY 1""")
def _(t):
    return round_columns(T.predict_trees(_forest(t), t.geno, t.pheno), ["prediction"])


@query("ml6_marker_boosting", _boosted_sql())
def _(t):
    model = T.fit_boosting(t.geno, t.pheno, BOOST_ROUNDS, BOOST_DEPTH, 0.1, min_leaf=2.0)
    known = t.pheno.where("y IS NOT NULL")
    return T.predict_trees(model, t.geno, known).join(known, "sample_id").select("sample_id", rounded("y").alias("y"), rounded("prediction", 5).alias("prediction"))


@query("ml16_forest_importance", f"""
WITH {FOREST}, w AS ({SPLIT})
SELECT var_id, round(sum(gain) / (SELECT sum(gain) FROM w), 6) + 0.0 AS importance FROM w GROUP BY 1""")
def _(t):
    return round_columns(T.tree_importance(_forest(t)), ["importance"])


@query("ml17_baseline_signal")
def _(t):
    return round_columns(M.baseline_signal(t.geno, t.pheno), ["baseline_r2"])
