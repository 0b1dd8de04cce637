import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortframe.operators import modeling, trees


def table(spark, x, y):
    cells = [(f"s{i}", f"v{j}", int(d)) for i, row in enumerate(x) for j, d in enumerate(row) if d >= 0]
    return spark.createDataFrame(cells, "sample_id string, var_id string, dosage int").repartition(3), spark.createDataFrame(
        [(f"s{i}", None if v is None else float(v)) for i, v in enumerate(y)], "sample_id string, y double")


def stump(x, y):
    best = (0.0, None, None)
    for j in range(x.shape[1]):
        for cut in (0, 1):
            r = x[:, j] > cut
            if r.any() and (~r).any():
                gain = y.var() * len(y) - sum(y[s].var() * s.sum() for s in (r, ~r))
                if gain > best[0] + 1e-6:
                    best = (gain, f"v{j}", cut)
    return best


def grown(x, y, depth):
    """Predictions of a greedy tree on its own rows."""
    gain, name, cut = stump(x, y)
    if depth == 0 or name is None or gain <= 1e-6:
        return np.full(len(y), y.mean())
    out, right = np.empty(len(y)), x[:, int(name[1:])] > cut
    for s in (right, ~right):
        out[s] = grown(x[s], y[s], depth - 1)
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (60, 12))
    return x, 2.0 * (x[:, 4] > 0) - 1.5 * (x[:, 7] > 1) * (x[:, 2] > 0) + rng.normal(0, 0.1, 60)


def test_first_split_and_boosting_equal_brute_force(spark, data):
    x, y = data
    cells, pheno = table(spark, x, y)
    model = trees.fit_boosting(cells, pheno, rounds=2, depth=2, rate=0.5)
    first = model.nodes.where("tree = 0 AND node = 1").first()
    gain, name, cut = stump(x, y - y.mean())
    assert (first.var_id, first.cut) == (name, cut) and abs(first.gain - gain) < 1e-8
    want = np.full(60, y.mean())
    for _ in range(2):
        want += 0.5 * grown(x, y - want, 2)
    got = {r.sample_id: r.prediction for r in trees.predict_trees(model, cells, pheno).collect()}
    assert np.allclose([got[f"s{i}"] for i in range(60)], want)


def test_forest_learns_and_its_importance_names_the_causes(spark, data):
    x, y = data
    cells, pheno = table(spark, x, y)
    model = trees.fit_forest(cells, pheno, trees=8, depth=4, share=0.7)
    got = {r.sample_id: r.prediction for r in trees.predict_trees(model, cells, pheno).collect()}
    p = np.array([got[f"s{i}"] for i in range(60)])
    assert 1 - ((p - y) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.8
    weight = {r.var_id: r.importance for r in trees.tree_importance(model).collect()}
    assert abs(sum(weight.values()) - 1) < 1e-9 and max(weight, key=weight.get) == "v4"


def test_absent_cells_null_targets_and_constant_targets(spark):
    x = np.array([[0, 2], [0, -1], [2, 0], [2, -1], [1, 1]])
    cells, pheno = table(spark, x, [1.0, 1.0, 3.0, 3.0, None])
    model = trees.fit_boosting(cells, pheno, rounds=1, depth=3, rate=1.0)
    got = {r.sample_id: r.prediction for r in trees.predict_trees(model, cells, pheno.union(spark.createDataFrame([("new", None)], pheno.schema))).collect()}
    assert got == {"s0": 1.0, "s1": 1.0, "s2": 3.0, "s3": 3.0, "s4": 3.0, "new": 1.0}       # a sample without cells has dosage 0 throughout
    flat = trees.fit_boosting(cells, pheno.withColumn("y", F.lit(2.0)), rounds=1, depth=3)
    assert flat.nodes.count() == 1 and flat.nodes.first()["cut"] is None


def test_least_leaf(spark):
    x = np.array([[0], [0], [0], [2]])
    cells, pheno = table(spark, x, [0.0, 0.0, 0.0, 9.0])
    assert trees.fit_boosting(cells, pheno, rounds=1, depth=1, min_leaf=2.0).nodes.count() == 1


def test_marker_lasso_meets_its_conditions_in_several_rounds(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (40, 90)).astype(float)
    z = x - x.mean(0)
    y = z[:, 3] - 0.7 * z[:, 50] + rng.normal(0, 0.3, 40)
    cells = spark.createDataFrame([(f"s{i}", f"v{j}", float(z[i, j])) for i in range(40) for j in range(90)], "sample_id string, var_id string, z double")
    pheno = spark.createDataFrame([(f"s{i}", float(v)) for i, v in enumerate(y)], "sample_id string, y double")
    for ratio in (1.0, 0.5):
        weights, mean = modeling.marker_lasso(cells, pheno, 0.05, ratio, step=4)
        w = np.zeros(90)
        for r in weights.collect():
            w[int(r.var_id[1:])] = r.weight
        g = z.T @ (y - mean - z @ w) / 40 - 0.05 * (1 - ratio) * w
        on = w != 0
        assert 2 <= on.sum() < 40 and np.allclose(g[on], 0.05 * ratio * np.sign(w[on]), atol=1e-4) and (np.abs(g[~on]) <= 0.05 * ratio + 1e-4).all()
    with pytest.raises(ValueError, match="larger alpha"):
        modeling.marker_lasso(cells, pheno, 0.001, most=5, step=4)
    none, mean = modeling.marker_lasso(cells, pheno, 100.0)
    assert none.count() == 0 and abs(mean - y.mean()) < 1e-12


def test_marker_lasso_writes_no_row_per_pair_of_markers(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 3, (60, 8)).astype(float)
    z = x - x.mean(0)
    y = z @ rng.normal(size=8)
    cells = spark.createDataFrame([(f"s{i}", f"v{j}", float(z[i, j])) for i in range(60) for j in range(8)], "sample_id string, var_id string, z double")
    pheno = spark.createDataFrame([(f"s{i}", float(v)) for i, v in enumerate(y)], "sample_id string, y double")
    asked, products = [], modeling.marker_products

    def told(own, p, n):
        asked.append((own.count(), p, n))
        return products(own, p, n)
    monkeypatch.setattr(modeling, "marker_products", told)
    weights, _ = modeling.marker_lasso(cells, pheno, 0.001, step=3)
    assert weights.count() == 8 and asked == [(180, 3, 60), (360, 6, 60), (480, 8, 60)]
