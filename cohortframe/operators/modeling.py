"""Splits that keep synthetic rows out of evaluation, regressors and their scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.functions.expr import one_row, u01
from cohortframe.operators.impute import standardize
from cohortframe.operators.latent import MAX_LOCAL_FEATURES, dense_rows, pca, project, selection_index, sparse_rows, standard_cells
from cohortframe.operators.popgen import fold_sums, select_k_without
from cohortframe.operators.ranking import ranked
from cohortframe.operators.runs import r2_weighted_ensemble, regression_metrics
from cohortframe.operators.tiles import marker_products
from cohortframe.session import MAX_BROADCAST_ROWS, cut_lineage, measured

# Hyper-parameter grids of the regressors.
GRIDS: dict[str, dict[str, list]] = {
    "ridge": {"alpha": [1e-6, 1e-4, 1e-2, 1.0, 10.0, 100.0]},
    "lasso": {"alpha": [1e-6, 1e-4, 1e-2, 1.0, 10.0, 100.0]},
    "elasticnet": {"alpha": [1e-6, 1e-4, 1e-2, 1.0, 10.0], "l1_ratio": [0.1, 0.5, 0.9]},
    "randomforest": {"n_estimators": [100, 200], "max_depth": [30, 10, 20], "max_features": ["all", "sqrt"]},
    "boosting": {"max_depth": [3, 4, 6], "learning_rate": [0.05, 0.1], "n_estimators": [100, 200],
                 "subsample": [0.8, 1.0]},
}


# ---- splits --------------------------------------------------------------------

def assign_folds(samples: DataFrame, k: int = 5, holdout: float = 0.2, seed: int = 42) -> DataFrame:
    """Fold number per real sample, -1 for the holdout, null for synthetic ones.

    ``samples(sample_id, origin)``.  Both draws are hashes of the id, so a sample
    keeps its place when the table grows or is re-read.
    """
    held = u01(seed, F.lit("holdout"), "sample_id") < holdout
    fold = F.floor(u01(seed, F.lit("fold"), "sample_id") * k).cast("int")
    return samples.select("sample_id", "origin", F.when(
        F.col("origin") == "real", F.when(held, F.lit(-1)).otherwise(fold)).alias("fold"))


def leak_guarded_splits(samples: DataFrame, k: int = 5, holdout: float = 0.2, seed: int = 42,
                        synthetic_only: bool = False) -> DataFrame:
    """(fold, role, sample_id, origin) rows: train, validation per fold, and the holdout once.

    Synthetic samples train in every fold and are never evaluated on.  With
    ``synthetic_only`` the real ones never train.
    """
    own = assign_folds(samples, k, holdout, seed).withColumnRenamed("fold", "own")
    real = F.col("origin") == "real"
    each = own.where(~real | (F.col("own") >= 0)).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    role = F.when(real & (F.col("own") == F.col("fold")), "validation").otherwise("train")
    rows = each.withColumn("role", role)
    if synthetic_only:
        rows = rows.where(~real | (F.col("role") == "validation"))
    held = own.where(real & (F.col("own") == -1)).select(
        F.lit(-1).alias("fold"), F.lit("holdout").alias("role"), "sample_id", "origin")
    return rows.select("fold", "role", "sample_id", "origin").unionByName(held)


def plain_split(samples: DataFrame, shares: Mapping[str, float], seed: int = 42) -> DataFrame:
    """(sample_id, part): hashed split into named shares, such as 70/15/15."""
    u = u01(seed, F.lit("split"), "sample_id")
    edge, part = 0.0, None
    names = list(shares)
    for name in names[:-1]:
        edge += shares[name]
        part = F.when(u < edge, name) if part is None else part.when(u < edge, name)
    return samples.select("sample_id", (part.otherwise(names[-1]) if part is not None else F.lit(names[-1])).alias("part"))


def evaluation_leaks(splits: DataFrame) -> DataFrame:
    """Rows that break the guard: synthetic in evaluation, or one sample in two roles of a fold."""
    syn = splits.where((F.col("role") != "train") & (F.col("origin") != "real")) \
        .select("fold", "sample_id", F.lit("synthetic_evaluated").alias("problem"))
    twice = splits.groupBy("fold", "sample_id").agg(F.count_distinct("role").alias("n")).where("n > 1") \
        .select("fold", "sample_id", F.lit("two_roles").alias("problem"))
    return syn.unionByName(twice)


# ---- regressors ------------------------------------------------------------------

MAX_NORMAL_FEATURES = 4096      # Spark solves normal equations up to this width; ``marker_ridge`` has no such bound


@dataclass
class Shape:
    """What the penalty conversion needs to know about a training table."""

    n: int
    p: int
    sd_samp: float = 1.0
    sd_pop: float = 1.0


def ridge(alpha: float, shape: Shape) -> LinearRegression:
    """Ridge with the usual penalty alpha * |w|^2 against the summed squared error.

    Spark divides the error by n and the squared penalty by the label's population
    sd; both are undone here, and features are not rescaled.  Vectors are bounded
    by Spark's direct solver; whole genomes are for ``marker_ridge``.
    """
    if shape.p > MAX_NORMAL_FEATURES:
        raise ValueError(f"{shape.p} features; ridge on vectors takes {MAX_NORMAL_FEATURES}, use marker_ridge on the long cells")
    return LinearRegression(regParam=alpha / max(shape.n, 1) * shape.sd_pop, elasticNetParam=0.0, standardization=False,
                            solver="normal", featuresCol="features", labelCol="y")


def elastic_net(alpha: float, l1_ratio: float, shape: Shape) -> LinearRegression:
    """Error / 2n + alpha (l1_ratio |w| + (1 - l1_ratio) w^2 / 2), whatever the label's scale."""
    lam = alpha * (l1_ratio + (1.0 - l1_ratio) * shape.sd_samp)
    mix = alpha * l1_ratio / lam if lam else 1.0
    return LinearRegression(regParam=lam, elasticNetParam=mix, standardization=False, solver="l-bfgs", tol=1e-9,
                            maxIter=500, featuresCol="features", labelCol="y")


def vector_size(column: str):
    return F.size(vector_to_array(column))


def estimator(kind: str, params: Mapping, shape: Shape):
    """A Spark ML regressor for a grid entry; unknown kinds are an error."""
    if kind == "ols":
        return LinearRegression(featuresCol="features", labelCol="y", regParam=0.0)
    if kind == "ridge":
        return ridge(float(params.get("alpha", 1.0)), shape)
    if kind in ("lasso", "elasticnet"):
        ratio = 1.0 if kind == "lasso" else float(params.get("l1_ratio", 0.5))
        return elastic_net(float(params.get("alpha", 1.0)), ratio, shape)
    if kind == "randomforest":
        if int(params.get("max_depth", 15)) > 30:
            raise ValueError("Spark's trees have a depth of 30 at most")
        return RandomForestRegressor(featuresCol="features", labelCol="y", seed=42,
                                     numTrees=int(params.get("n_estimators", 75)),
                                     maxDepth=int(params.get("max_depth", 15)),
                                     featureSubsetStrategy=str(params.get("max_features", "auto")))
    if kind == "boosting":
        return GBTRegressor(featuresCol="features", labelCol="y", seed=42,
                            maxIter=int(params.get("n_estimators", 100)), maxDepth=int(params.get("max_depth", 4)),
                            stepSize=float(params.get("learning_rate", 0.1)),
                            subsamplingRate=float(params.get("subsample", 1.0)))
    raise ValueError(f"unknown regressor {kind!r}")


def vectors(geno: DataFrame, chosen: DataFrame, pheno: DataFrame | None = None) -> DataFrame:
    """(sample_id, features[, y]): one vector per sample over the chosen variants.

    The vector is as long as the selection, never as the genome; missing calls
    are 0, which is the mean once the cells are standardized.
    """
    index, p = selection_index(chosen)
    value = "z" if "z" in geno.columns else "dosage"
    rows = dense_rows(sparse_rows(geno, index, value), p)
    out = rows.select("sample_id", array_to_vector("vec").alias("features"))
    return out if pheno is None else out.join(pheno.where(F.col("y").isNotNull()).select("sample_id", "y"), "sample_id")


def fit(kind: str, params: Mapping, train: DataFrame):
    head = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("y").alias("ss"), F.stddev_pop("y").alias("sp"),
                     F.max(vector_size("features")).alias("p")).first()
    return estimator(kind, params, Shape(head.n, head.p or 0, head.ss or 1.0, head.sp or 1.0)).fit(train)


def predict(model, rows: DataFrame) -> DataFrame:
    keep = [c for c in ("sample_id", "y") if c in rows.columns]
    return model.transform(rows).select(*keep, "prediction")


def mean_baseline(train: DataFrame, test: DataFrame) -> DataFrame:
    """The training mean as the prediction of every test row."""
    m = one_row(train.agg(F.avg("y").alias("m"))).getField("m")
    return test.select("sample_id", "y", m.alias("prediction"))


def grid(params: Mapping[str, Sequence]) -> list[dict]:
    names = list(params)
    return [dict(zip(names, values)) for values in product(*params.values())]


@dataclass
class FoldData:
    """One fold's vectors, selected and scaled on its training rows only."""

    train: DataFrame
    test: DataFrame


def fold_data(geno: DataFrame, pheno: DataFrame, train_ids: DataFrame, test_ids: DataFrame, chosen: DataFrame) -> FoldData:
    """Scale the chosen variants on the training samples, then vectorise both sides."""
    rows = geno.join(chosen, "var_id", "left_semi").where(F.col("dosage").isNotNull())
    z = standardize(rows, fit=rows.join(train_ids.select("sample_id"), "sample_id", "left_semi"))
    both = cut_lineage(vectors(z.select("sample_id", "var_id", "z"), chosen, pheno))
    return FoldData(both.join(train_ids.select("sample_id"), "sample_id", "left_semi"),
                    both.join(test_ids.select("sample_id"), "sample_id", "left_semi"))


@dataclass
class NestedResult:
    folds: DataFrame                    # fold, n, r2, rmse, mae
    predictions: DataFrame              # fold, sample_id, y, prediction
    holdout: DataFrame                  # one row of metrics
    best: list[dict] = field(default_factory=list)
    outer: int = 0                      # folds used
    inner: int = 0


def _mse(pred: DataFrame) -> float:
    row = pred.agg(F.avg((F.col("y") - F.col("prediction")) * (F.col("y") - F.col("prediction"))).alias("m")).first()
    return float("inf") if row.m is None else float(row.m)


def tune(kind: str, params: Mapping[str, Sequence], train: DataFrame, origin: DataFrame, inner: int, seed: int) -> dict:
    """Best grid entry by mean squared error on inner folds of the real training rows."""
    options = grid(params) or [{}]
    if len(options) == 1:
        return options[0]
    rows = cut_lineage(train.join(origin, "sample_id").withColumn(
        "inner", F.floor(u01(seed, F.lit("inner"), "sample_id") * inner).cast("int")))
    real = F.col("origin") == "real"
    scores = [0.0] * len(options)
    for f in range(inner):
        tr, te = rows.where(~real | (F.col("inner") != f)), rows.where(real & (F.col("inner") == f))
        for i, option in enumerate(options):
            scores[i] += _mse(predict(fit(kind, option, tr), te))
    return options[min(range(len(options)), key=scores.__getitem__)]


def fold_counts(n_real: int, outer: int, inner: int, small: int = 20) -> tuple[int, int]:
    """Fewer folds when there are fewer than ``small`` real samples."""
    return (outer, inner) if n_real >= small else (max(2, min(outer, n_real // 5)), max(2, min(inner, n_real // 7)))


def nested_cv(geno: DataFrame, pheno: DataFrame, samples: DataFrame, kind: str = "ridge",
              params: Mapping[str, Sequence] | None = None, k: int = 50, outer: int = 5, inner: int = 3,
              holdout: float = 0.2, seed: int = 42, small: int | None = None) -> NestedResult:
    """Outer folds and a holdout of real samples; selection, scaling and tuning inside each fold.

    Two passes over the cells serve all folds: one for the sums that rank the
    variants without each fold, one to take out the cells of the variants any fold
    chose.  The loop runs over folds and grid entries, never over data.  The final
    model takes the parameters of the fold with the smallest validation error.
    With ``small``, tables of fewer real samples get fewer folds; the result says how many.
    """
    params = GRIDS[kind] if params is None else params
    known = samples.join(pheno.where(F.col("y").isNotNull()).select("sample_id"), "sample_id", "left_semi")
    known = cut_lineage(known)
    if small is not None:
        outer, inner = fold_counts(known.where("origin = 'real'").count(), outer, inner, small)
    own = cut_lineage(assign_folds(known, outer, holdout, seed))
    sums = cut_lineage(fold_sums(geno, pheno, own))
    chosen = {f: cut_lineage(select_k_without(sums, f, k)) for f in (*range(outer), -1)}
    wanted = reduce(DataFrame.unionByName, chosen.values()).distinct()       # at most (outer + 1) k ids
    cells = cut_lineage(geno.join(F.broadcast(wanted) if (outer + 1) * k <= MAX_BROADCAST_ROWS else wanted, "var_id", "left_semi")
                        .select("sample_id", "var_id", "dosage"))
    real, fold = F.col("origin") == "real", F.col("fold")

    def sides(f):
        train = own.where(~real | ((fold != f) & (fold != -1)))
        return fold_data(cells, pheno, train, own.where(real & (fold == f)), chosen[f])

    parts, best, errors = [], [], []
    for f in range(outer):
        data = sides(f)
        option = tune(kind, params, data.train, known, inner, seed)
        pred = cut_lineage(predict(fit(kind, option, data.train), data.test).withColumn("fold", F.lit(f)))
        parts.append(pred)
        best.append(option)
        errors.append(_mse(pred))
    data = sides(-1)
    option = best[min(range(outer), key=errors.__getitem__)]
    final = predict(fit(kind, option, data.train), data.test)
    preds = reduce(DataFrame.unionByName, parts)
    return NestedResult(regression_metrics(preds, ["fold"]), preds, regression_metrics(final), best, outer, inner)


def out_of_fold(data: DataFrame, folds: DataFrame, kinds: Mapping[str, Mapping], k: int) -> DataFrame:
    """(sample_id, y, model, prediction): each row predicted by models that never saw it.

    ``data(sample_id, features, y)``, ``folds(sample_id, fold)``.
    """
    rows = cut_lineage(data.join(folds, "sample_id"))
    parts = []
    for f in range(k):
        tr, te = rows.where(F.col("fold") != f), rows.where(F.col("fold") == f)
        for kind, params in kinds.items():
            parts.append(predict(fit(kind, params, tr), te).withColumn("model", F.lit(kind)))
    return cut_lineage(reduce(DataFrame.unionByName, parts))


def stack(oof: DataFrame, kinds: Sequence[str], alpha: float = 1.0):
    """Ridge on the out-of-fold predictions; returns the model and its input table."""
    wide = oof.groupBy("sample_id", "y").pivot("model", list(kinds)).agg(F.first("prediction"))
    rows = VectorAssembler(inputCols=list(kinds), outputCol="features").transform(wide)
    rows = cut_lineage(rows.select("sample_id", "y", "features"))
    return fit("ridge", {"alpha": alpha}, rows), rows


def stacked_prediction(oof: DataFrame, kinds: Sequence[str], alpha: float = 1.0) -> DataFrame:
    model, rows = stack(oof, kinds, alpha)
    return predict(model, rows)


def ensemble(oof: DataFrame) -> DataFrame:
    """Out-of-fold predictions weighted by each model's R2."""
    scores = regression_metrics(oof, ["model"]).select("model", "r2")
    return r2_weighted_ensemble(oof, scores, ["sample_id", "y"])


def stacked_holdout(data: DataFrame, folds: DataFrame, kinds: Mapping[str, Mapping], k: int, alpha: float = 1.0) -> DataFrame:
    """(sample_id, y, prediction) of a stack on real rows that none of its models has seen.

    ``folds(sample_id, origin, fold)``: -1 the holdout, null synthetic.  The meta model learns from out-of-fold
    predictions of the training rows; the base models are then fitted on all of them and applied to the holdout.
    """
    rows = cut_lineage(data.join(folds, "sample_id"))
    real = rows.where("origin = 'real' AND fold >= 0").select("sample_id", "features", "y")
    meta, _ = stack(out_of_fold(real, folds.select("sample_id", "fold"), kinds, k), list(kinds), alpha)
    train = rows.where("fold IS NULL OR fold >= 0")
    held = rows.where("origin = 'real' AND fold = -1").select("sample_id", "features", "y")
    each = [predict(fit(kind, params, train), held).withColumn("model", F.lit(kind)) for kind, params in kinds.items()]
    wide = reduce(DataFrame.unionByName, each).groupBy("sample_id", "y").pivot("model", list(kinds)).agg(F.first("prediction"))
    return predict(meta, VectorAssembler(inputCols=list(kinds), outputCol="features").transform(wide))


# ---- ridge on all markers --------------------------------------------------------

def _dots(table: DataFrame, pairs: Sequence[tuple[str, str]]) -> list[float]:
    row = table.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"d{i}") for i, (a, b) in enumerate(pairs)]).first()
    return [float(v or 0.0) for v in row]


def _slopes(z: DataFrame, at: DataFrame, column: str, names: Sequence[str]) -> np.ndarray:
    """Z'r for the named markers."""
    found = {r["var_id"]: r["g"] for r in z.join(measured(at), "sample_id").groupBy("var_id").agg(F.sum(F.col("z") * F.col(column)).alias("g")).collect()}
    return np.array([found.get(v) or 0.0 for v in names])


def marker_ridge(z: DataFrame, y: DataFrame, alphas: Sequence[float] = (1.0,), tol: float = 1e-6,
                 rounds: int = 500) -> tuple[DataFrame, float]:
    """Ridge weights of every marker for each penalty, and the intercept.

    ``z(sample_id, var_id, z)`` holds centred cells (absent ones count as 0) of any number of variants, ``y(sample_id,
    y)`` the targets.  Fewer markers than samples, ``MAX_LOCAL_FEATURES`` at most, are solved from their products (Z'Z +
    alpha) w = Z'(y - mean), which one pass over the cells adds up.  Otherwise the dual (Z Z' + alpha) a = y - mean is
    solved by conjugate gradients, all penalties at once: a round is two join-and-sum passes over the cells and one small
    aggregate, and nothing but scalars reaches the driver.  The weights are Z'a.  Raises when ``tol`` (of the residual's
    length) is not reached.
    """
    k = range(len(alphas))
    known = y.where(F.col("y").isNotNull())
    mean = known.agg(F.avg("y").alias("m")).first().m or 0.0
    z = cut_lineage(z.join(measured(known.select("sample_id")), "sample_id", "left_semi").select("sample_id", "var_id", "z"))
    at = known.select("sample_id", (F.col("y") - mean).alias("_y"))
    n, once = known.agg(F.count(F.lit(1)), F.count_distinct("sample_id")).first()
    p = z.select("var_id").distinct().count()
    if p <= min(n, MAX_LOCAL_FEATURES) and n == once:
        names, gram = marker_products(z, p, n)
        values, vectors = np.linalg.eigh(gram)
        slope = vectors.T @ _slopes(z, at, "_y", names)
        floor = max(values[-1], 0.0) * p * np.finfo(float).eps if p else 0.0
        solved = [(float(a), v, float(w)) for a in alphas for v, w in zip(names, vectors @ np.divide(
            slope, values + a, out=np.zeros(len(slope)), where=values + a > floor))]
        return z.sparkSession.createDataFrame(solved, "alpha double, var_id string, weight double").select("var_id", "alpha", "weight"), float(mean)
    state = cut_lineage(at.select("sample_id", *[c for i in k for c in (F.lit(0.0).alias(f"x{i}"), F.col("_y").alias(f"r{i}"), F.col("_y").alias(f"p{i}"))]))
    size = _dots(state, [(f"r{i}", f"r{i}") for i in k])
    goal = [tol * tol * s for s in size]
    for _ in range(rounds):
        if all(s <= g for s, g in zip(size, goal)):
            break
        w = z.join(state.select("sample_id", *[f"p{i}" for i in k]), "sample_id").groupBy("var_id").agg(*[F.sum(F.col("z") * F.col(f"p{i}")).alias(f"w{i}") for i in k])
        q = z.join(w, "var_id").groupBy("sample_id").agg(*[F.sum(F.col("z") * F.col(f"w{i}")).alias(f"_q{i}") for i in k])
        both = state.join(q, "sample_id", "left").select("*", *[(F.coalesce(f"_q{i}", F.lit(0.0)) + F.col(f"p{i}") * float(alphas[i])).alias(f"q{i}") for i in k])
        both = cut_lineage(both.drop(*[f"_q{i}" for i in k]))
        curve = _dots(both, [(f"p{i}", f"q{i}") for i in k])
        step = [s / c if c > 0 and s > g else 0.0 for s, c, g in zip(size, curve, goal)]       # a penalty that is done rests
        moved = both.select("sample_id", *[c for i in k for c in (
            (F.col(f"x{i}") + F.col(f"p{i}") * step[i]).alias(f"x{i}"), (F.col(f"r{i}") - F.col(f"q{i}") * step[i]).alias(f"r{i}"), F.col(f"p{i}"))])
        new = _dots(moved, [(f"r{i}", f"r{i}") for i in k])
        turn = [n / s if s > 0 else 0.0 for n, s in zip(new, size)]
        state = moved.select("sample_id", *[c for i in k for c in (F.col(f"x{i}"), F.col(f"r{i}"), (F.col(f"r{i}") + F.col(f"p{i}") * turn[i]).alias(f"p{i}"))])
        size = new
    if any(s > g for s, g in zip(size, goal)):
        raise RuntimeError(f"conjugate gradients: not converged in {rounds} rounds")
    sums = z.join(state.select("sample_id", *[f"x{i}" for i in k]), "sample_id").groupBy("var_id").agg(*[F.sum(F.col("z") * F.col(f"x{i}")).alias(f"b{i}") for i in k])
    each = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.col(f"b{i}").alias("weight")) for i, a in enumerate(alphas)]))
    return cut_lineage(sums.select("var_id", each.alias("_e")).select("var_id", "_e.*")), float(mean)


def _soft_threshold(gram: np.ndarray, slope: np.ndarray, l1: float, l2: float, w: np.ndarray, tol: float, sweeps: int = 100_000) -> np.ndarray:
    """Coordinate descent for w'Gw / 2 - slope'w + l1 |w| + l2 w^2 / 2."""
    w, left = w.copy(), slope - gram @ w
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(w)):
            if gram[j, j] <= 0:
                continue
            pull = left[j] + gram[j, j] * w[j]
            new = np.sign(pull) * max(0.0, abs(pull) - l1) / (gram[j, j] + l2)
            if new != w[j]:
                left -= gram[:, j] * (new - w[j])
                most = max(most, abs(new - w[j]) * np.sqrt(gram[j, j]))
                w[j] = new
        if most <= tol:
            return w
    raise RuntimeError(f"coordinate descent: not converged in {sweeps} sweeps")


MOST_ACTIVE = 2048              # markers with a weight, at most: their products are k x k numbers on the driver


def marker_lasso(z: DataFrame, y: DataFrame, alpha: float, l1_ratio: float = 1.0, tol: float = 1e-6, most: int = MOST_ACTIVE,
                 step: int = 256, rounds: int = 100) -> tuple[DataFrame, float]:
    """Lasso or elastic net over every marker: the weights that are not 0 (``alpha, var_id, weight``) and the intercept.

    Error / 2n + alpha (l1_ratio |w| + (1 - l1_ratio) w^2 / 2), for ``z(sample_id, var_id, z)`` with centred cells (absent ones
    count as 0) of any number of markers.  Screening by a working set: a round takes the slope of every marker against what
    is left (two join-and-sum passes over the cells), lets those in that break the optimality conditions, the ``step`` worst
    first, and solves the set alone by soft thresholding on its products.  It ends when no marker of the table breaks them
    by more than ``tol`` of the largest slope; a solution with more than ``most`` weights is an error, not another result.
    """
    known = y.where(F.col("y").isNotNull())
    stats = known.agg(F.avg("y").alias("m"), F.count(F.lit(1)).alias("n")).first()
    mean, n = float(stats["m"] or 0.0), max(int(stats["n"]), 1)
    l1, l2 = alpha * l1_ratio, alpha * (1.0 - l1_ratio)
    z = cut_lineage(z.join(measured(known.select("sample_id")), "sample_id", "left_semi").select("sample_id", "var_id", "z"))
    at = cut_lineage(known.select("sample_id", (F.col("y") - mean).alias("r")))
    spark, names, weights, slack = z.sparkSession, [], np.zeros(0), None

    def table() -> DataFrame:
        return F.broadcast(spark.createDataFrame(list(zip(names, weights.tolist())), "var_id string, weight double"))       # ``most`` rows at most

    for _ in range(rounds):
        left = at
        if names:
            told = z.join(table(), "var_id").groupBy("sample_id").agg(F.sum(F.col("z") * F.col("weight")).alias("_p"))
            left = cut_lineage(at.join(told, "sample_id", "left").select("sample_id", (F.col("r") - F.coalesce("_p", F.lit(0.0))).alias("r")))
        slopes = cut_lineage(z.join(measured(left), "sample_id").groupBy("var_id").agg((F.sum(F.col("z") * F.col("r")) / n).alias("g")))
        if slack is None:
            slack = tol * float(slopes.agg(F.max(F.abs("g")).alias("g")).first()["g"] or 0.0)
        outside = slopes.join(table().select("var_id"), "var_id", "left_anti") if names else slopes
        bad = outside.where(F.abs("g") > l1 + slack).orderBy(F.desc(F.abs("g")), "var_id").limit(step).collect()
        if not bad:
            break
        if len(names) + len(bad) > most:
            raise ValueError(f"more than {most} markers have a weight; take a larger alpha or marker_ridge")
        # products of all members: tiles of the cells, no row per sample and pair of markers
        names, weights = names + [r["var_id"] for r in bad], np.concatenate([weights, np.zeros(len(bad))])
        place = {v: i for i, v in enumerate(names)}
        own = z.join(table().select("var_id"), "var_id")
        found, products = marker_products(own, len(names), n)
        at_found = [place[v] for v in found]
        gram = np.zeros((len(names), len(names)))
        gram[np.ix_(at_found, at_found)] = products / n
        slope = _slopes(own, at, "r", names) / n
        weights = _soft_threshold(gram, slope, l1, l2, weights, slack * 0.1)
    else:
        raise RuntimeError(f"screening: markers still break the conditions after {rounds} rounds")
    kept = [(float(alpha), v, float(w)) for v, w in zip(names, weights) if w]
    return spark.createDataFrame(kept, "alpha double, var_id string, weight double"), mean


def marker_predictions(z: DataFrame, weights: DataFrame, intercept: float) -> DataFrame:
    """(alpha, sample_id, prediction) for samples whose cells are centred as the training cells were.

    A cell meets the weights of all penalties in one row, so that no cell is written once per penalty.
    """
    alphas = sorted(r["alpha"] for r in weights.select("alpha").distinct().collect())       # a number per penalty
    if not alphas:
        return z.limit(0).select(F.lit(0.0).alias("alpha"), "sample_id", F.lit(0.0).alias("prediction"))
    wide = weights.groupBy("var_id").agg(*[F.sum(F.when(F.col("alpha") == a, F.col("weight"))).alias(f"_w{i}") for i, a in enumerate(alphas)])
    sums = z.join(wide, "var_id").groupBy("sample_id").agg(*[F.sum(F.coalesce("z", F.lit(0.0)) * F.col(f"_w{i}")).alias(f"_p{i}") for i in range(len(alphas))])
    each = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("alpha"), (F.col(f"_p{i}") + intercept).alias("prediction")) for i, a in enumerate(alphas)]))
    return sums.select("sample_id", each.alias("_e")).select("_e.alpha", "sample_id", "_e.prediction").where("prediction IS NOT NULL")


def pca_regression(geno: DataFrame, pheno: DataFrame, train_ids: DataFrame, test_ids: DataFrame, latent: int = 16,
                   kind: str = "ridge", params: Mapping | None = None) -> DataFrame:
    """Regression on the leading components of the training samples."""
    train = geno.join(train_ids.select("sample_id"), "sample_id", "left_semi")
    test = geno.join(test_ids.select("sample_id"), "sample_id", "left_semi")
    parts = pca(standard_cells(train), latent)
    y = pheno.where(F.col("y").isNotNull()).select("sample_id", "y")

    def rows(df):
        return df.select("sample_id", array_to_vector("pc").alias("features")).join(y, "sample_id")

    model = fit(kind, params or {"alpha": 1.0}, cut_lineage(rows(parts.scores)))
    return predict(model, rows(project(test, train, parts)))


# ---- experiments -------------------------------------------------------------------

def hashed_prefix(samples: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """A hashed share of the samples; smaller shares are inside larger ones."""
    return samples if share >= 1 else samples.where(u01(seed, F.lit("few"), "sample_id") < share)


def few_shot_curve(data: DataFrame, splits: DataFrame, shares: Sequence[float] = (0.1, 0.25, 0.5, 1.0),
                   kind: str = "ridge", params: Mapping | None = None) -> DataFrame:
    """R2, RMSE and MAE on the real holdout for growing real training shares, with and without synthetic rows.

    ``data(sample_id, features, y)``; ``splits(sample_id, origin, fold)`` with fold -1 = holdout.
    """
    rows = cut_lineage(data.join(splits, "sample_id"))
    held = rows.where(F.col("fold") == -1)
    real, syn = rows.where("origin = 'real' AND fold >= 0"), rows.where("origin <> 'real'")
    parts = []
    for share in shares:
        few = hashed_prefix(real, share)
        for mode, train in (("real_only", few), ("augmented", few.unionByName(syn))):
            n = train.agg(F.count(F.lit(1)).alias("n")).first().n
            if n >= 3:
                scores = regression_metrics(predict(fit(kind, params or {"alpha": 1.0}, train), held))
            else:           # too few rows for a model: a point without scores
                scores = regression_metrics(held.select("sample_id", "y", F.lit(None).cast("double").alias("prediction"))) \
                    .withColumns({c: F.lit(None).cast("double") for c in ("r2", "rmse", "mae")})
            parts.append(scores.withColumn("n_train", F.lit(n).cast("long")).withColumn("share", F.lit(float(share))).withColumn("mode", F.lit(mode)))
    return reduce(DataFrame.unionByName, parts)


def scenario_benchmark(sets: Mapping[str, DataFrame], test: DataFrame, kind: str = "randomforest",
                       params: Mapping | None = None) -> DataFrame:
    """Scores of one model trained on each named set, on the same real test rows."""
    parts = []
    for name, train in sets.items():
        pred = predict(fit(kind, params or {}, train), test)
        n = train.agg(F.count(F.lit(1)).alias("n"))
        parts.append(regression_metrics(pred).withColumnRenamed("n", "n_test")
                     .withColumn("scenario", F.lit(name)).withColumn("n_train", one_row(n).getField("n")))
    return reduce(DataFrame.unionByName, parts)


def linear_importance(cells: DataFrame, weights: DataFrame, k: int | None = 20) -> DataFrame:
    """mean |w (x - mean)| per variant: the Shapley value of a linear model; the ``k`` largest first, or all."""
    stats = cells.groupBy("var_id").agg(F.avg("dosage").alias("_m"))
    per = (cells.where(F.col("dosage").isNotNull()).join(stats, "var_id").join(weights, "var_id")
           .groupBy("var_id").agg(F.avg(F.abs(F.col("weight") * (F.col("dosage") - F.col("_m")))).alias("importance")))
    return per if k is None else per.orderBy(F.desc(F.round("importance", 9)), "var_id").limit(k)


def importance_counts(importance: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    cols = [F.count_if(F.col("importance") > th).alias(f"above_{i}") for i, th in enumerate(thresholds)]
    return importance.agg(F.count(F.lit(1)).alias("n"), *cols)


def baseline_signal(geno: DataFrame, pheno: DataFrame, max_features: int | None = None, min_samples: int = 20,
                    alpha: float = 1.0, seed: int = 42) -> DataFrame:
    """Holdout R2 of a plain ridge on all variants of variance > 1e-6, mean fill, 80/20.

    ``max_features`` asks for a hashed choice of so many variants instead.  Null when there are too few samples.
    """
    from cohortframe.operators.popgen import variable_variants
    known = pheno.where(F.col("y").isNotNull()).select("sample_id", "y")
    rows = geno.where(F.col("dosage").isNotNull()).join(measured(known.select("sample_id")), "sample_id", "left_semi")
    rows = cut_lineage(rows.select("sample_id", "var_id", "dosage").repartition("sample_id"))
    good = variable_variants(rows, 1e-6).select("var_id")
    if max_features is not None:
        good = good.orderBy(u01(seed, F.lit("feature"), "var_id"), "var_id").limit(max_features)
    cells = rows.join(good, "var_id", "left_semi")
    both = cut_lineage(known.join(cells.select("sample_id").distinct(), "sample_id", "left_semi"))
    n = both.count()
    if n < min_samples:
        return both.sparkSession.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(None).cast("double").alias("baseline_r2"))
    parts = cut_lineage(both.join(plain_split(both, {"train": 0.8, "test": 0.2}, seed), "sample_id"))
    train = parts.where("part = 'train'").select("sample_id", "y")
    z = standardize(cells, fit=cells.join(train.select("sample_id"), "sample_id", "left_semi")).select("sample_id", "var_id", "z")
    weights, mean = marker_ridge(z, train, [alpha])
    pred = parts.where("part = 'test'").select("sample_id", "y").join(marker_predictions(z, weights, mean), "sample_id", "left") \
        .withColumn("prediction", F.coalesce("prediction", F.lit(mean)))
    return regression_metrics(pred).select(F.lit(n).cast("long").alias("n"), F.col("r2").alias("baseline_r2"))


def sequence_windows(values: DataFrame, order: Sequence[str], length: int = 10) -> DataFrame:
    """(position, window, target): every run of ``length`` rows, target = y of its last row.

    Each ranked row is handed to the windows it belongs to, so a window gathers
    ``length`` rows and no task walks the whole sequence.
    """
    r = ranked(values.select(*dict.fromkeys([*order, "y"])), list(order), name="_i", total="_n")
    ends = F.explode(F.sequence(F.col("_i"), F.least(F.col("_i") + length - 1, F.col("_n"))))
    rows = r.select("_i", "y", ends.alias("position")).where(F.col("position") >= length)
    win = F.sort_array(F.collect_list(F.struct("_i", "y")))
    return rows.groupBy("position").agg(win.alias("_w")).select(
        "position", F.col("_w.y").alias("window"), F.element_at(F.col("_w.y"), -1).alias("target"))


