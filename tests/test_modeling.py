import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cohortframe.operators import modeling as M
from cohortframe.operators import runs as R


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(120, 6))
    y = x @ np.array([2.0, -1, 0.5, 0, 0, 1]) + 4 + rng.normal(size=120) * 0.3
    rows = [(f"s{i:03d}", Vectors.dense(x[i]), float(y[i])) for i in range(120)]
    return x, y, spark.createDataFrame(rows, ["sample_id", "features", "y"]).cache()


@pytest.mark.parametrize("alpha", [0.5, 25.0])
def test_ridge_is_the_closed_form(data, alpha, monkeypatch):
    x, y, df = data
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + alpha * np.eye(6), xc.T @ yc)
    got = M.fit("ridge", {"alpha": alpha}, df)
    assert np.allclose(got.coefficients.toArray(), want, atol=1e-6)
    monkeypatch.setattr(M, "MAX_NORMAL_FEATURES", 2)
    with pytest.raises(ValueError, match="marker_ridge"):
        M.fit("ridge", {"alpha": alpha}, df)


def test_marker_ridge_is_the_closed_form_with_more_markers_than_samples(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(12, 30)), rng.normal(size=12)
    x -= x.mean(0)
    z = spark.createDataFrame([(f"s{i}", f"v{j:02d}", float(x[i, j])) for i in range(12) for j in range(30)], "sample_id string, var_id string, z double")
    pheno = spark.createDataFrame([(f"s{i}", float(y[i])) for i in range(12)] + [("none", None)], "sample_id string, y double")
    weights, mean = M.marker_ridge(z, pheno, [0.5, 50.0], tol=1e-9)
    got = weights.toPandas().pivot(index="var_id", columns="alpha", values="weight")
    assert abs(mean - y.mean()) < 1e-12
    for alpha in (0.5, 50.0):
        want = np.linalg.solve(x.T @ x + alpha * np.eye(30), x.T @ (y - y.mean()))
        assert np.allclose(got[alpha].to_numpy(), want, atol=1e-6)
    with pytest.raises(RuntimeError, match="not converged"):
        M.marker_ridge(z, pheno, [0.5], tol=1e-12, rounds=1)
    with pytest.raises(ValueError, match="depth"):
        M.estimator("randomforest", {"max_depth": 31}, M.Shape(10, 2))


def test_marker_ridge_of_few_markers_needs_no_rounds(spark, monkeypatch):
    from cohortframe.operators import tiles
    monkeypatch.setattr(tiles, "COLS", 7)
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(40, 5)), rng.normal(size=40)
    x = np.column_stack([x - x.mean(0), x[:, 0] - x[:, 0].mean()])       # the last marker repeats the first
    z = spark.createDataFrame([(f"s{i}", f"v{j}", float(x[i, j])) for i in range(40) for j in range(6)], "sample_id string, var_id string, z double")
    pheno = spark.createDataFrame([(f"s{i}", float(y[i])) for i in range(40)], "sample_id string, y double")
    weights, mean = M.marker_ridge(z, pheno, [0.5, 50.0], rounds=0)
    got = weights.toPandas().pivot(index="var_id", columns="alpha", values="weight")
    told = M.marker_predictions(z, weights, mean).toPandas().pivot(index="sample_id", columns="alpha", values="prediction")
    for alpha in (0.5, 50.0):
        want = np.linalg.solve(x.T @ x + alpha * np.eye(6), x.T @ (y - y.mean()))
        assert np.allclose(got[alpha].to_numpy(), want, atol=1e-9)
        assert np.allclose(told[alpha].reindex([f"s{i}" for i in range(40)]).to_numpy(), x @ want + y.mean(), atol=1e-9)


def test_baseline_signal_of_few_markers(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 3, (120, 4))
    geno = spark.createDataFrame([(f"s{i:03d}", f"v{j}", int(x[i, j])) for i in range(120) for j in range(4)] + [("s000", "null", None)], "sample_id string, var_id string, dosage int")
    pheno = spark.createDataFrame([(f"s{i:03d}", float(x[i, 0] - 2 * x[i, 1])) for i in range(120)], "sample_id string, y double")
    got = M.baseline_signal(geno, pheno).first()
    part = {r["sample_id"]: r["part"] for r in M.plain_split(pheno, {"train": 0.8, "test": 0.2}, 42).collect()}
    train = np.array([part[f"s{i:03d}"] == "train" for i in range(120)])
    y = (x[:, 0] - 2 * x[:, 1]).astype(float)
    z = (x - x[train].mean(0)) / x[train].std(0)
    w = np.linalg.solve(z[train].T @ z[train] + np.eye(4), z[train].T @ (y[train] - y[train].mean()))
    told = z[~train] @ w + y[train].mean()
    assert got["n"] == 120 and abs(got["baseline_r2"] - (1 - ((y[~train] - told) ** 2).sum() / ((y[~train] - y[~train].mean()) ** 2).sum())) < 1e-6


@pytest.mark.parametrize("ratio", [0.3, 1.0])
def test_elastic_net_meets_its_optimality_conditions(data, ratio):
    x, y, df = data
    alpha = 0.3
    kind, params = ("lasso", {"alpha": alpha}) if ratio == 1.0 else ("elasticnet", {"alpha": alpha, "l1_ratio": ratio})
    w = M.fit(kind, params, df).coefficients.toArray()
    xc, yc = x - x.mean(0), y - y.mean()
    grad = xc.T @ (yc - xc @ w) / len(y) - alpha * (1 - ratio) * w
    on = w != 0
    assert 0 < on.sum() < 6 or ratio < 1
    assert np.allclose(grad[on], alpha * ratio * np.sign(w[on]), atol=1e-5)
    assert (np.abs(grad[~on]) <= alpha * ratio + 1e-5).all()


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.0)], "y double, prediction double")
    out = R.regression_metrics(df).first()
    assert abs(out.r2 - (1 - 1.25 / 2)) < 1e-12 and abs(out.rmse - (1.25 / 3) ** 0.5) < 1e-12 and out.mae == 0.5
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, prediction double")
    assert R.regression_metrics(flat).first().r2 is None


def samples(spark):
    return spark.range(200).select(F.format_string("s%04d", "id").alias("sample_id"),
                                   F.when(F.col("id") < 120, "real").otherwise("synthetic").alias("origin"))


def test_splits_guard(spark):
    s = M.leak_guarded_splits(samples(spark), k=4)
    assert M.evaluation_leaks(s).count() == 0
    held = {r.sample_id for r in s.where("role = 'holdout'").collect()}
    assert 10 <= len(held) <= 40
    for f in range(4):
        mine = s.where(F.col("fold") == f)
        train = {r.sample_id for r in mine.where("role = 'train'").collect()}
        val = {r.sample_id for r in mine.where("role = 'validation'").collect()}
        assert not train & val and not (train | val) & held and len(train | val) == 200 - len(held)
    only = M.leak_guarded_splits(samples(spark), k=4, synthetic_only=True)
    assert only.where("role = 'train' AND origin = 'real'").count() == 0


def test_leaks_are_found(spark):
    bad = spark.createDataFrame([(0, "validation", "a", "synthetic"), (0, "train", "b", "real"), (0, "validation", "b", "real")],
                                "fold int, role string, sample_id string, origin string")
    assert sorted(r.problem for r in M.evaluation_leaks(bad).collect()) == ["synthetic_evaluated", "two_roles"]


def test_splits_do_not_depend_on_partitions(spark):
    a = sorted(M.assign_folds(samples(spark)).collect())
    assert sorted(M.assign_folds(samples(spark).repartition(7)).collect()) == a


def test_small_sets_get_fewer_folds():
    assert M.fold_counts(100, 5, 3) == (5, 3) and M.fold_counts(14, 5, 3) == (2, 2)


def test_nested_cv_on_a_known_signal(spark):
    rng = np.random.default_rng(2)
    g = rng.integers(0, 3, size=(90, 12))
    y = 3.0 * g[:, 2] - 2.0 * g[:, 5] + rng.normal(size=90) * 0.2
    cells = spark.createDataFrame([(f"s{i:02d}", f"v{j:02d}", float(g[i, j])) for i in range(90) for j in range(12)],
                                  "sample_id string, var_id string, dosage double")
    pheno = spark.createDataFrame([(f"s{i:02d}", float(y[i])) for i in range(90)], "sample_id string, y double")
    who = spark.createDataFrame([(f"s{i:02d}", "real" if i < 70 else "synthetic") for i in range(90)], "sample_id string, origin string")
    out = M.nested_cv(cells, pheno, who, "ridge", {"alpha": [0.1, 1000.0]}, k=4, outer=2, inner=2)
    assert all(r.r2 > 0.95 for r in out.folds.collect()) and out.holdout.first().r2 > 0.95
    assert all(b["alpha"] == 0.1 for b in out.best)
    real = {f"s{i:02d}" for i in range(70)}
    assert {r.sample_id for r in out.predictions.collect()} <= real


def test_stacking_and_ensemble(spark, data):
    _, _, df = data
    folds = df.select("sample_id", (F.substring("sample_id", 2, 3).cast("int") % 3).alias("fold"))
    oof = M.out_of_fold(df, folds, {"ridge": {"alpha": 1.0}, "randomforest": {"n_estimators": 5, "max_depth": 3}}, 3)
    assert oof.count() == 240 and oof.select("sample_id", "model").distinct().count() == 240
    assert R.regression_metrics(M.stacked_prediction(oof, ["ridge", "randomforest"])).first().r2 > 0.9
    assert M.ensemble(oof).count() == 120


def test_windows(spark):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(12)], "o int, y double")
    out = {r.position: (r.window, r.target) for r in M.sequence_windows(df, ["o"], 10).collect()}
    assert sorted(out) == [10, 11, 12]
    assert out[11] == ([float(i * i) for i in range(1, 11)], 100.0)


def test_one_run_has_zero_sd(spark):
    r = spark.createDataFrame([("rf", "r1", 1000, 0.5, 0.1, 0.2, 0.3, 0.4)],
                              "raw_model string, run_id string, k int, sigma double, cv_r2 double, holdout_r2 double, rmse double, mae double")
    out = R.multi_seed(r, 1000, 0.5, ["randomforest"]).first()
    assert out.cv_r2_sd == 0.0 and out.run_ids == "r1" and R.multi_seed(r, 1000, 0.5, ["randomforest"], 2).count() == 0


def test_best_row_tie_keeps_the_first(spark):
    r = spark.createDataFrame([("s", i, "m", "c", 0.5, 0.1, 0.2, 10) for i in (3, 1, 2)],
                              "source string, seq long, model string, context string, holdout_r2 double, rmse double, cv_r2 double, n_samples int")
    assert R.best_per_source(r).first().seq == 1


def test_selection_from_sums_equals_selection_from_cells(spark):
    from cohortframe.operators import popgen as G
    rng = np.random.default_rng(8)
    cells = spark.createDataFrame([(f"s{i:02d}", f"v{j:02d}", int(rng.integers(0, 3))) for i in range(60) for j in range(15)],
                                  "sample_id string, var_id string, dosage int")
    pheno = spark.createDataFrame([(f"s{i:02d}", float(rng.normal())) for i in range(60)], "sample_id string, y double")
    who = spark.createDataFrame([(f"s{i:02d}", "real" if i < 45 else "synthetic") for i in range(60)], "sample_id string, origin string")
    own = M.assign_folds(who, 3)
    sums = G.fold_sums(cells, pheno, own)
    for f in (-1, 0, 1, 2):
        train = own.where((F.col("origin") != "real") | ((F.col("fold") != f) & (F.col("fold") != -1)))
        want = {r.var_id for r in G.select_k_best(cells, pheno, 5, train).collect()}
        assert {r.var_id for r in G.select_k_without(sums, f, 5).collect()} == want
