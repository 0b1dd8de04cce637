"""Principal components, neighbour distances and KNN imputation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from cohortframe.functions.expr import one_row, safe_div, std_normal
from cohortframe.operators.grid import grid
from cohortframe.operators.planes import knn_search, nearest_mismatch
from cohortframe.operators.ranking import exact_quantiles, ranked
from cohortframe.operators.tiles import nearest_distance
from cohortframe.session import cut_lineage, measured

MAX_LOCAL_FEATURES = 1024      # p x p covariance and its eigenvectors on the driver


def variant_index(variants: DataFrame) -> tuple[DataFrame, int]:
    """(var_id, idx) with 0-based positions in id order, written out, and its length."""
    out = ranked(variants.select("var_id").distinct(), ["var_id"], name="idx")
    index = cut_lineage(out.withColumn("idx", (F.col("idx") - 1).cast("int")))
    return measured(index), index.count()


def selection_index(chosen: DataFrame) -> tuple[DataFrame, int]:
    """The same for a selection of variants, which is as short as one feature vector."""
    out = chosen.select("var_id").distinct().withColumn("idx", F.row_number().over(W.orderBy("var_id")) - 1)
    index = cut_lineage(out)
    return measured(index), index.count()


def sparse_rows(cells: DataFrame, index: DataFrame, value: str) -> DataFrame:
    """(sample_id, idx, val): one sparse row per sample, as wide as the index."""
    rows = cells.where(F.col(value).isNotNull()).join(index, "var_id")
    pairs = F.sort_array(F.collect_list(F.struct("idx", F.col(value).cast("double").alias("val"))))
    return rows.groupBy("sample_id").agg(pairs.alias("_p")).select(
        "sample_id", F.col("_p.idx").alias("idx"), F.col("_p.val").alias("val"))


def dense_rows(sparse: DataFrame, p: int, fill: float = 0.0) -> DataFrame:
    """(sample_id, vec) from sparse rows, absent positions set to ``fill``."""
    @F.pandas_udf(ArrayType(DoubleType()))
    def widen(idx: pd.Series, val: pd.Series) -> pd.Series:
        out = []
        for i, v in zip(idx, val):
            row = np.full(p, fill)
            row[np.asarray(i, dtype=int)] = v
            out.append(row)
        return pd.Series(out)

    return sparse.select("sample_id", widen("idx", "val").alias("vec"))


@dataclass
class Components:
    """Scores and loadings stay distributed; the k eigenvalues are plain numbers."""

    scores: DataFrame          # sample_id, pc array<double>
    loadings: DataFrame        # var_id, loading array<double>
    eigenvalues: list[float]   # of Z'Z, largest first
    total: float               # trace of Z'Z
    n_samples: int

    @property
    def explained(self) -> list[float]:
        return [v / self.total for v in self.eigenvalues]


def _sum_products(z: DataFrame, table: DataFrame, on: str, to: str, names: list[str]) -> DataFrame:
    return z.join(table, on).groupBy(to).agg(*[F.sum(F.col("z") * F.col(c)).alias(c) for c in names])


def _gram(table: DataFrame, names: list[str]) -> np.ndarray:
    """names x names matrix of column products: the only values that reach the driver."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = table.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i, j in pairs]).first()
    g = np.zeros((len(names), len(names)))
    for i, j in pairs:
        g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    return g


def _rotate(table: DataFrame, key: str, names: list[str], t: np.ndarray, out: list[str]) -> DataFrame:
    cols: list[Column] = []
    for j, name in enumerate(out):
        terms = [F.col(c) * float(t[i, j]) for i, c in enumerate(names)]
        cols.append(reduce(Column.__add__, terms).alias(name))
    return table.select(key, *cols)


def _whiten(g: np.ndarray) -> np.ndarray:
    w, v = np.linalg.eigh(g)
    order = np.argsort(w)[::-1]
    w, v = w[order], v[:, order]
    scale = np.where(w > 1e-12 * max(w[0], 1e-300), 1.0 / np.sqrt(np.maximum(w, 1e-300)), 0.0)
    return v * scale


def _subspace(z: DataFrame, k: int, seed: int, rounds: int, tol: float) -> tuple[DataFrame, list[float]]:
    """Top-k left subspace by block power iteration.

    Two join-and-sum passes over the cells per round; the driver sees matrices of
    (k + 8) x (k + 8).  Neither samples nor variants are ever gathered.
    """
    names = [f"q{i}" for i in range(k + 8)]
    q = z.select("sample_id").distinct().select(
        "sample_id", *[std_normal(seed, F.lit(c), "sample_id").alias(c) for c in names])
    ritz_before = None
    for _ in range(rounds):
        basis = cut_lineage(_rotate(q, "sample_id", names, _whiten(_gram(q, names)), names))
        w = _sum_products(z, basis, "sample_id", "var_id", names)
        w = cut_lineage(w)
        vals, vecs = np.linalg.eigh(_gram(w, names))       # Ritz values of ZZ' on the basis
        vals, vecs = vals[::-1], vecs[:, ::-1]
        q = _sum_products(z, w, "var_id", "sample_id", names)
        if ritz_before is not None and np.max(np.abs(vals[:k] - ritz_before) / np.maximum(vals[:k], 1e-12)) < tol:
            break
        ritz_before = vals[:k]
    else:
        raise RuntimeError(f"power iteration: eigenvalues still move by more than {tol} after {rounds} rounds; allow more rounds or a larger tol")
    scale = np.sqrt(np.maximum(vals[:k], 0.0))
    out = [f"s{i}" for i in range(k)]
    scores = _rotate(basis, "sample_id", names, vecs[:, :k] * scale, out)
    return scores.select("sample_id", F.array(*out).alias("pc")), [float(v) for v in vals[:k]]


def _covariance(z: DataFrame, k: int, p: int) -> tuple[DataFrame, list[float]]:
    """Spark ML PCA on one vector per sample; for a bounded number of variants."""
    index, _ = variant_index(z)
    rows = dense_rows(sparse_rows(z, index, "z"), p).select(
        "sample_id", array_to_vector("vec").alias("v"))
    rows = cut_lineage(rows)
    model = PCA(k=k, inputCol="v", outputCol="s").fit(rows)
    scores = model.transform(rows).select("sample_id", vector_to_array("s").alias("pc"))
    sums = scores.agg(*[F.sum(F.col("pc")[i] * F.col("pc")[i]).alias(f"e{i}") for i in range(k)]).first()
    return scores, [float(sums[f"e{i}"]) for i in range(k)]


def pca(z: DataFrame, k: int = 5, seed: int = 7, rounds: int = 100, tol: float = 1e-6,
        max_local: int = MAX_LOCAL_FEATURES) -> Components:
    """Principal components of standardized cells ``z(sample_id, var_id, z)``.

    Absent cells count as 0, the mean.  Signs are fixed so that the loading
    largest in size is positive.  Above ``max_local`` variants the eigenvalues must
    settle within ``rounds``; otherwise this is an error, not a poor result.
    """
    z = cut_lineage(z.select("sample_id", "var_id", "z"))
    head = z.agg(F.sum(F.col("z") * F.col("z")).alias("total"),
                 F.count_distinct("sample_id").alias("n"), F.count_distinct("var_id").alias("p")).first()
    k = min(k, head.n - 1, head.p)
    if head.p <= max_local:
        scores, values = _covariance(z, k, head.p)
    else:
        scores, values = _subspace(z, k, seed, rounds, tol)
    names = [f"q{i}" for i in range(k)]
    wide = scores.select("sample_id", *[F.col("pc")[i].alias(c) for i, c in enumerate(names)])
    load = _sum_products(z, wide, "sample_id", "var_id", names)
    load = load.select("var_id", *[(F.col(c) / float(max(values[i], 1e-300))).alias(c) for i, c in enumerate(names)])
    load = cut_lineage(load)
    top = load.agg(*[F.max_by(c, F.struct(F.round(F.abs(c), 9), "var_id")).alias(c) for c in names]).first()
    sign = [1.0 if (top[c] or 0.0) >= 0 else -1.0 for c in names]
    flip = F.array(*[F.lit(s) for s in sign])
    return Components(
        scores.select("sample_id", F.zip_with("pc", flip, lambda a, b: a * b).alias("pc")),
        load.select("var_id", F.zip_with(F.array(*names), flip, lambda a, b: a * b).alias("loading")),
        values, float(head.total), int(head.n))


def standard_cells(geno: DataFrame, fit: DataFrame | None = None) -> DataFrame:
    """z per cell with the mean and population sd of ``fit`` (default: the same table)."""
    from cohortframe.operators.impute import standardize
    return standardize(geno.where(F.col("dosage").isNotNull()), fit=fit).select("sample_id", "var_id", "z")


def project(geno: DataFrame, real: DataFrame, parts: Components, whiten: bool = False) -> DataFrame:
    """Scores of new samples on components fitted to ``real``."""
    k = len(parts.eigenvalues)
    z = standard_cells(geno, fit=real).join(parts.loadings, "var_id")
    scale = [1.0 / np.sqrt(max(v, 1e-300) / (parts.n_samples - 1)) if whiten else 1.0 for v in parts.eigenvalues]
    sums = [(F.sum(F.col("z") * F.col("loading")[i]) * float(scale[i])).alias(f"p{i}") for i in range(k)]
    return z.groupBy("sample_id").agg(*sums).select("sample_id", F.array(*[f"p{i}" for i in range(k)]).alias("pc"))


def pc_variance(scores: DataFrame, k: int) -> DataFrame:
    """One row: summed sample variance of the components."""
    v = reduce(Column.__add__, [F.var_samp(F.col("pc")[i]) for i in range(k)])
    return scores.agg(v.alias("variance"))


def capture_ratios(real: DataFrame, synth: DataFrame, k: int = 20, share: float = 0.95) -> DataFrame:
    """How much of the synthetic variance the real components carry, four ways."""
    real, synth = (cut_lineage(df.select("sample_id", "var_id", "dosage")) for df in (real, synth))
    fit = pca(standard_cells(real), k)
    kk = len(fit.eigenvalues)
    syn_z = standard_cells(synth, fit=real)
    total_syn = one_row(syn_z.groupBy("var_id").agg(F.var_samp("z").alias("v")).agg(F.sum("v").alias("v"))).getField("v")
    proj = project(synth, real, fit)
    var_syn = one_row(pc_variance(proj, kk)).getField("variance")
    var_real = one_row(pc_variance(fit.scores, kk)).getField("variance")
    evr = fit.explained
    cum = np.cumsum(evr)
    m = min(int(np.searchsorted(cum, share)) + 1, kk)
    own = pca(standard_cells(synth), k)
    row = real.sparkSession.range(1)
    return row.select(
        F.lit(float(sum(evr))).alias("evr_top"), F.lit(m).alias("n_components"),
        F.lit(float(sum(own.explained[:m]))).alias("own_spectrum_share"),
        safe_div(var_syn, total_syn).alias("capture_ratio"),
        safe_div(safe_div(var_syn, total_syn), F.lit(float(sum(evr)))).alias("capture_over_real"),
        safe_div(var_syn, var_real).alias("pc_variance_ratio"))


# ---- distances ----------------------------------------------------------------

def _norm():
    return F.sqrt(F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x))


def unit_vectors(rows: DataFrame) -> DataFrame:
    """Vectors scaled to length 1; zero vectors are left out."""
    return (rows.withColumn("_n", _norm()).where(F.col("_n") > 0)
            .select("id", F.transform("vec", lambda x: x / F.col("_n")).alias("vec")))


def nearest_real(synth: DataFrame, real: DataFrame) -> DataFrame:
    """Per synthetic (id, vec) row: least Euclidean distance and largest cosine to a real row."""
    s = synth.select("id", F.col("vec").cast("array<double>").alias("vec"))
    r = real.select("id", F.col("vec").cast("array<double>").alias("vec"))
    euclid = nearest_distance(s, r)
    on_sphere = nearest_distance(s.where(_norm() > 0), r.where(_norm() > 0), unit=True)
    cosine = on_sphere.select("id", (1.0 - F.col("distance") * F.col("distance") / 2).alias("cosine"))
    return euclid.join(cosine, "id", "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))


def distance_summary(rows: DataFrame, column: str) -> DataFrame:
    p95 = one_row(exact_quantiles(rows, column, [0.95]).select(F.col("q")[0].alias("q"))).getField("q")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(column).alias("mean")).withColumn("p95", p95)


def _known(geno: DataFrame, index: DataFrame) -> DataFrame:
    """(sample_id, idx, val): the cells with a dosage."""
    there = geno.where(F.col("dosage").isNotNull() & ~F.isnan(F.col("dosage").cast("double")))
    return there.join(index, "var_id").select("sample_id", "idx", F.col("dosage").cast("double").alias("val"))


def nearest_hamming(synth: DataFrame, real: DataFrame) -> DataFrame:
    """(sample_id, distance): least share of differing variants to a real sample.

    Over the variants both tables have; a call missing on one side differs.
    """
    shared = synth.select("var_id").distinct().join(real.select("var_id").distinct(), "var_id", "left_semi")
    index, p = variant_index(shared)

    return nearest_mismatch(_known(synth, index), _known(real, index), p)


def paired_hamming(synth: DataFrame, real: DataFrame) -> DataFrame:
    """(sample_id, partner, distance): i-th synthetic sample against real sample i mod n."""
    s = ranked(synth.select("sample_id").distinct(), ["sample_id"], name="_i")
    r = ranked(real.select(F.col("sample_id").alias("partner")).distinct(), ["partner"], name="_j", total="_n")
    n = one_row(r.agg(F.max("_n").alias("n"))).getField("n")
    pairs = s.withColumn("_j", F.pmod(F.col("_i") - 1, n) + 1).join(r.select("partner", "_j"), "_j")
    a = synth.select("sample_id", "var_id", F.col("dosage").alias("a")).join(pairs.select("sample_id", "partner"), "sample_id")
    b = real.select(F.col("sample_id").alias("partner"), "var_id", F.col("dosage").alias("b"))
    differs = F.when(F.col("a").eqNullSafe(F.col("b")), 0.0).otherwise(1.0)
    return a.join(b, ["partner", "var_id"]).groupBy("sample_id", "partner").agg(F.avg(differs).alias("distance"))


def centroid_filter(synth: DataFrame, real: DataFrame, k: int, percentile: float = 0.95,
                    fallback_percent: float | None = None) -> DataFrame:
    """Synthetic (id, vec) rows no farther from the real centroid than most real rows.

    When fewer than ``fallback_percent`` of the rows pass, that share of the
    closest rows is kept instead.
    """
    mid = one_row(real.agg(F.array(*[F.avg(F.col("vec")[i]) for i in range(k)]).alias("m"))).getField("m")

    def measured(df):
        gaps = F.zip_with("vec", "_m", lambda a, b: (a - b) * (a - b))
        total = F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x)
        return df.withColumn("_m", mid).select("id", F.sqrt(total).alias("distance"))

    limit = one_row(exact_quantiles(measured(real), "distance", [percentile]).select(F.col("q")[0].alias("q"))).getField("q")
    far = measured(synth).withColumn("threshold", limit)
    passing = far.where(F.col("distance") <= F.col("threshold"))
    if fallback_percent is not None:
        seen = far.agg(F.count(F.lit(1)).alias("n"),
                       F.count_if(F.col("distance") <= F.col("threshold")).alias("ok")).first()
        if seen.ok < seen.n * fallback_percent / 100:
            keep = max(1, int(seen.n * fallback_percent / 100))
            return ranked(far, [F.round("distance", 9), "id"], name="_r").where(F.col("_r") <= keep).drop("_r")
    return passing


# ---- KNN imputation --------------------------------------------------------------

def impute_knn(geno: DataFrame, k: int = 5) -> DataFrame:
    """Every (sample, variant) cell, missing ones from the k nearest samples that have it.

    Neighbours weigh 1/distance; identical ones alone count when there are any.
    A cell without a donor takes the variant's mean.
    """
    index, p = variant_index(geno)
    donors, _ = knn_search(_known(geno, index), p, k)
    zero = F.max(F.when(F.col("distance") == 0, 1).otherwise(0)) == 1
    near = F.avg(F.when(F.col("distance") == 0, F.col("value")))
    w = safe_div(F.lit(1.0), "distance")
    found = donors.groupBy("sample_id", "idx").agg(
        F.when(zero, near).otherwise(safe_div(F.sum(w * F.col("value")), F.sum(w))).alias("dosage"))
    filled = found.join(index, "idx").select("sample_id", "var_id", "dosage")
    present = geno.where(F.col("dosage").isNotNull()).select(
        "sample_id", "var_id", F.col("dosage").cast("double").alias("dosage"))
    known = present.unionByName(filled)
    means = geno.groupBy("var_id").agg(F.coalesce(F.avg("dosage"), F.lit(0.0)).alias("dosage"))
    # cells nobody could donate to
    cells = grid(geno.select("sample_id").distinct(), means)
    orphans = cells.join(known.select("sample_id", "var_id"), ["sample_id", "var_id"], "left_anti")
    return known.unionByName(orphans.select("sample_id", "var_id", "dosage"))
