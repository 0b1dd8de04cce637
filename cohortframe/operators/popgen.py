"""Population genetics: frequencies, associations, linkage and relationship."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cohortframe.functions.expr import one_row, safe_div
from cohortframe.operators.ranking import exact_quantiles, ranked
from cohortframe.operators.tiles import pair_dots
from cohortframe.session import cut_lineage, measured


def genotype_frequencies(geno: DataFrame) -> DataFrame:
    """p0, p1, p2 per variant over its calls; .33/.34/.33 where there are none."""
    n = F.count("dosage")
    aggs = [F.coalesce(safe_div(F.count_if(F.col("dosage") == g), n), F.lit(d)).alias(f"p{g}")
            for g, d in ((0, 0.33), (1, 0.34), (2, 0.33))]
    return geno.groupBy("var_id").agg(*aggs)


def class_frequencies(geno: DataFrame, classes: DataFrame, min_rows: int = 3) -> DataFrame:
    """P(dosage | class, variant) for every variant and class; the marginal where a class has ``min_rows`` calls or fewer, none included."""
    n = F.count("dosage")
    per = geno.join(measured(classes.select("sample_id", "cls")), "sample_id").groupBy("var_id", "cls").agg(
        n.alias("n"), *[safe_div(F.count_if(F.col("dosage") == g), n).alias(f"c{g}") for g in (0, 1, 2)])
    names = one_row(classes.agg(F.sort_array(F.collect_set("cls")).alias("all"))).getField("all")     # a few class numbers
    every = genotype_frequencies(geno).withColumn("cls", F.explode(names))
    few = F.coalesce("n", F.lit(0)) <= min_rows
    return every.join(per, ["var_id", "cls"], "left").select(
        "var_id", "cls", F.coalesce("n", F.lit(0)).alias("n"), *[F.when(few, F.col(f"p{g}")).otherwise(F.col(f"c{g}")).alias(f"p{g}") for g in (0, 1, 2)])


def maf_all_rows(geno: DataFrame, n_samples: Column | int | None = None) -> DataFrame:
    """MAF with all samples, missing calls included, in the denominator."""
    n = F.count(F.lit(1)) if n_samples is None else F.lit(n_samples)
    p = safe_div(F.coalesce(F.sum("dosage"), F.lit(0)), n * 2)
    return geno.groupBy("var_id").agg(p.alias("alt_freq")).select(
        "var_id", "alt_freq", F.least(F.col("alt_freq"), 1.0 - F.col("alt_freq")).alias("maf"))


def maf_ld_summary(maf: DataFrame, blocks: DataFrame) -> DataFrame:
    """Mean and 95th percentile of the MAF and of the block sizes."""
    sizes = blocks.groupBy("block_id").agg(F.count(F.lit(1)).cast("double").alias("size"))
    m95 = one_row(exact_quantiles(maf, "maf", [0.95]).select(F.col("q")[0].alias("q"))).getField("q")
    s95 = one_row(exact_quantiles(sizes, "size", [0.95]).select(F.col("q")[0].alias("q"))).getField("q")
    m = one_row(maf.agg(F.count(F.lit(1)).alias("n"), F.avg("maf").alias("m")))
    s = one_row(sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("m")))
    row = maf.sparkSession.range(1).select(m.alias("m"), s.alias("s"), m95.alias("m95"), s95.alias("s95"))
    return row.select(F.col("m.n").alias("n_variants"), F.col("m.m").alias("maf_mean"), F.col("m95").alias("maf_p95"),
                      F.col("s.n").alias("n_blocks"), F.col("s.m").alias("block_size_mean"),
                      F.col("s95").alias("block_size_p95"))


# ---- association with a target ----------------------------------------------

def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta integral (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 200):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
        if np.nanmax(np.abs(step - 1.0), initial=0.0) < 1e-14:
            break
    return h


def _log_gamma(z: np.ndarray) -> np.ndarray:
    """Stirling series after shifting the argument above 10."""
    shift = np.zeros_like(z)
    while np.any(z < 10):
        small = z < 10
        shift = np.where(small, shift - np.log(np.where(small, z, 1.0)), shift)
        z = np.where(small, z + 1, z)
    i2 = 1.0 / (z * z)
    series = (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 / 1680))) / z
    return shift + (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided tail of Student's t."""
    x = np.clip(df / (df + t * t), 0.0, 1.0)
    a, b = df / 2.0, np.full_like(df, 0.5)
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b)
                   + a * np.log(np.maximum(x, 1e-300)) + b * np.log(np.maximum(1 - x, 1e-300)))
    low = x < (a + 1) / (a + b + 2)
    direct = front * _beta_fraction(a, b, np.where(low, x, 0.0)) / a
    other = 1.0 - front * _beta_fraction(b, a, np.where(low, 0.0, 1 - x)) / b
    return np.clip(np.where(low, direct, other), 0.0, 1.0)


@F.pandas_udf(DoubleType())
def pearson_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """p-value of a Pearson correlation, one Arrow batch at a time."""
    rv, df = r.to_numpy(float), n.to_numpy(float) - 2
    ok = np.isfinite(rv) & (df > 0)
    out = np.full(len(rv), np.nan)
    rr, dd = rv[ok], df[ok]
    with np.errstate(divide="ignore"):
        out[ok] = t_two_sided(np.sqrt(dd * rr * rr / np.maximum(1 - rr * rr, 1e-300)), dd)
    return pd.Series(out).where(ok, None)


def target_correlation(geno: DataFrame, pheno: DataFrame) -> DataFrame:
    """Pearson r of every variant with the target; null for a constant side."""
    known = measured(pheno.where(F.col("y").isNotNull()).select("sample_id", "y"))
    rows = geno.where(F.col("dosage").isNotNull()).join(known, "sample_id")
    x = F.col("dosage").cast("double")
    return (rows.groupBy("var_id").agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop(x, F.col("y")).alias("_c"),
        F.stddev_pop(x).alias("_sx"), F.stddev_pop("y").alias("_sy"))
        .select("var_id", "n", safe_div("_c", F.col("_sx") * F.col("_sy")).alias("r"))
        .withColumn("abs_r", F.abs("r")))


def association(geno: DataFrame, pheno: DataFrame) -> DataFrame:
    """Correlation with its two-sided p-value."""
    return target_correlation(geno, pheno).withColumn("p_value", pearson_p("r", "n"))


def correlation_counts(corr: DataFrame) -> DataFrame:
    return corr.agg(F.count("r").alias("n"), F.count_if(F.col("abs_r") > 0.1).alias("above_01"),
                    F.count_if(F.col("abs_r") > 0.2).alias("above_02"))


def f_scores(geno: DataFrame, pheno: DataFrame) -> DataFrame:
    """Regression F score per variant."""
    r2 = F.col("r") * F.col("r")
    return target_correlation(geno, pheno).select(
        "var_id", "n", (safe_div(r2, 1.0 - r2) * (F.col("n") - 2)).alias("f_score"))


def select_k_best(geno: DataFrame, pheno: DataFrame, k: int, train: DataFrame | None = None) -> DataFrame:
    """The k variants with the largest F score, judged on the training samples only."""
    rows = geno if train is None else geno.join(train.select("sample_id"), "sample_id", "left_semi")
    return (f_scores(rows, pheno).where(F.col("f_score").isNotNull())
            .orderBy(F.desc(F.round("f_score", 9)), "var_id").limit(k))


def fold_sums(geno: DataFrame, pheno: DataFrame, folds: DataFrame) -> DataFrame:
    """Sums behind the correlation per (variant, fold): one pass over the cells for all folds.

    ``folds(sample_id, fold)`` with -1 for the holdout and null for synthetic
    samples.  The target is centred first, which keeps the sums well scaled.
    """
    known = pheno.where(F.col("y").isNotNull()).select("sample_id", "y")
    mid = one_row(known.agg(F.avg("y").alias("m"))).getField("m")
    side = measured(known.select("sample_id", (F.col("y") - mid).alias("y")).join(folds.select("sample_id", "fold"), "sample_id"))
    rows = geno.where(F.col("dosage").isNotNull()).join(side, "sample_id")
    x, y = F.col("dosage").cast("double"), F.col("y")
    return rows.groupBy("var_id", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"),
        F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))


def select_k_without(sums: DataFrame, fold: int, k: int) -> DataFrame:
    """The k best variants by F score over everything but one fold and the holdout."""
    train = sums.where(F.col("fold").isNull() | ((F.col("fold") != fold) & (F.col("fold") != -1)))
    t = train.groupBy("var_id").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    r2 = F.when((vx > 1e-12 * F.col("sxx")) & (vy > 0), cov * cov / F.nullif(vx * vy, F.lit(0.0)))
    score = safe_div(r2, 1.0 - r2) * (n - 2)
    return (t.select("var_id", score.alias("f_score")).where(F.col("f_score").isNotNull())
            .orderBy(F.desc(F.round("f_score", 6)), "var_id").limit(k).select("var_id"))


def variable_variants(geno: DataFrame, min_variance: float = 0.0, min_sd: float | None = None) -> DataFrame:
    """Variants whose population variance (or sd) exceeds the threshold."""
    per = geno.groupBy("var_id").agg(F.var_pop("dosage").alias("variance"))
    if min_sd is not None:
        return per.where(F.sqrt("variance") > min_sd)
    return per.where(F.col("variance") > min_variance)


# ---- linkage -----------------------------------------------------------------

def unit_scaled(geno: DataFrame) -> DataFrame:
    """(row=variant, col=sample, val) centred and scaled so that a dot product is r.

    Missing calls count as the variant's mean; a constant variant gives zeros.
    """
    stats = geno.groupBy("var_id").agg(F.avg("dosage").alias("_m"),
                                       (F.var_pop("dosage") * F.count("dosage")).alias("_ss"))
    x = (F.col("dosage") - F.col("_m")) / F.sqrt(F.col("_ss"))
    return (geno.where(F.col("dosage").isNotNull()).join(stats, "var_id")
            .select(F.col("var_id").alias("row"), F.col("sample_id").alias("col"),
                    F.when(F.col("_ss") > 0, x).otherwise(0.0).alias("val")))


def dimensions(geno: DataFrame) -> tuple[int, int]:
    """(samples, variants) of the table."""
    # two small distinct tables; two distinct counts in one aggregate would write every cell twice
    return geno.select("sample_id").distinct().count(), geno.select("var_id").distinct().count()


def pairwise_r2(geno: DataFrame) -> DataFrame:
    """r and r2 of every pair of variants (var1 < var2)."""
    n, p = dimensions(geno)
    return _as_pairs(pair_dots(unit_scaled(geno), p, n))


def windowed_r2(geno: DataFrame, variants: DataFrame, max_distance: int) -> DataFrame:
    """r and r2 of the pairs on one chromosome at most ``max_distance`` apart."""
    n, p = dimensions(geno)
    rows = variants.select(F.col("var_id").alias("row"), "chr", F.floor(F.col("pos") / max_distance).alias("w"),
                           F.col("pos").cast("long").alias("pos"))
    return _as_pairs(pair_dots(unit_scaled(geno), p, n, rows, max_distance=max_distance))


def _as_pairs(dots: DataFrame) -> DataFrame:
    return dots.select(F.col("row1").alias("var1"), F.col("row2").alias("var2"), F.col("dot").alias("r"),
                       (F.col("dot") * F.col("dot")).alias("r2"))


def high_ld_fraction(geno: DataFrame, variants: DataFrame, max_distance: int, threshold: float = 0.2,
                     sample: int | None = None, seed: int = 42) -> DataFrame:
    """Share of pairs with |r| above the threshold among all pairs at most ``max_distance`` apart.

    ``sample`` asks for a hashed choice of so many variants instead, all pairs of them.
    """
    if sample is None:
        pairs = windowed_r2(geno, variants, max_distance)
    else:
        from cohortframe.functions.expr import u01
        picked = geno.select("var_id").distinct().orderBy(u01(seed, "var_id"), "var_id").limit(sample)
        pairs = pairwise_r2(geno.join(picked, "var_id", "left_semi"))
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"),
                     F.avg(F.when(F.abs("r") > threshold, 1.0).otherwise(0.0)).alias("high_ld_fraction"))


def _joined_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over a task's edges: (node, root), the root being the smallest node of its piece."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for frame in frames:
        for u, v in zip(frame["a"], frame["b"]):
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
    names = list(parent)
    yield pd.DataFrame({"node": names, "root": [root(x) for x in names]}, dtype=object)


def _labels(edges: DataFrame) -> DataFrame:
    """(node, label): smallest node of the component, by min-label steps with pointer jumps; for edges between pieces."""
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b")
                .groupBy("a").agg(F.min("label").alias("m")).withColumnRenamed("a", "node"))
        step = labels.join(near, "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = cut_lineage(step.join(jump, "label").select("node", "old", F.col("up").alias("label")))
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels


def connected_components(nodes: DataFrame, edges: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """(node, label, size): the component of every node, named by its smallest.

    Edges are laid out by ``order`` (positions; else by their first node), so neighbours lie in one task, which connects what
    it has by union-find.  Only nodes that several tasks met tie pieces together; the graph of these pieces is as small as
    the number of tasks and the edges across their borders, and is solved by steps.  Pieces, not components, are joined
    on afterwards, so a component as long as a chromosome makes no task larger than another.
    """
    spark = edges.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = cut_lineage(edges.select("a", "b", *order)).repartitionByRange(parts, *(order or ["a"])).select("a", "b")
    pieces = cut_lineage(laid.mapInPandas(_joined_up, "node string, root string"))
    # a row per task that met the node
    home = cut_lineage(pieces.groupBy("node").agg(F.min("root").alias("root"), F.count(F.lit(1)).alias("met")))
    border = home.where("met > 1").select("node", F.col("root").alias("a"))
    across = cut_lineage(pieces.join(border, "node").where("a <> root").select("a", F.col("root").alias("b")).distinct())
    sizes = home.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    if not across.isEmpty():
        named = sizes.join(_labels(across).withColumnRenamed("node", "root"), "root", "left").withColumn("label", F.coalesce("label", "root"))
    else:
        named = sizes.withColumn("label", F.col("root"))
    named = cut_lineage(named)
    whole = named.groupBy("label").agg(F.sum("n").alias("size"))
    told = cut_lineage(named.join(whole, "label").select("root", "label", "size"))      # a row per piece
    found = home.join(told, "root").select("node", "label", "size")
    return nodes.select("node").distinct().join(found, "node", "left").select(
        "node", F.coalesce("label", "node").alias("label"), F.coalesce("size", F.lit(1)).cast("long").alias("size"))


def ld_blocks(pairs: DataFrame, variants: DataFrame, r2: float = 0.2, min_size: int = 5) -> DataFrame:
    """(var_id, block_id, block_size): components of linked variants.

    A component smaller than ``min_size`` falls apart into blocks of one.  With ``chr`` and ``pos`` in ``variants`` edges are
    laid out along the genome.
    """
    edges, order = pairs.where(F.col("r2") >= r2).select(F.col("var1").alias("a"), F.col("var2").alias("b")), []
    if {"chr", "pos"} <= set(variants.columns):
        order = ["chr", "pos"]
        edges = edges.join(variants.select(F.col("var_id").alias("a"), *order), "a")
    comp = connected_components(variants.select(F.col("var_id").alias("node")), edges, order)
    big = F.col("size") >= min_size
    return comp.select(F.col("node").alias("var_id"), F.when(big, F.col("label")).otherwise(F.col("node")).alias("block_id"),
                       F.when(big, F.col("size")).otherwise(1).cast("long").alias("block_size"))


def nested_blocks(blocks: DataFrame, size: int = 10_000) -> DataFrame:
    """(block_id, part, variants): blocks as sorted id arrays of at most ``size`` ids.

    A block longer than that goes on in its next part, so no task gathers a
    whole chromosome.
    """
    r = ranked(blocks.select("block_id", "var_id"), ["var_id"], by=["block_id"], name="_r")
    part = F.floor((F.col("_r") - 1) / size).alias("part")
    return r.groupBy("block_id", part).agg(F.sort_array(F.collect_list("var_id")).alias("variants"))


def relationship_matrix(geno: DataFrame) -> DataFrame:
    """(sample1, sample2, g): VanRaden ZZ'/(2 sum pq), upper triangle with the diagonal."""
    freq = geno.groupBy("var_id").agg((F.avg("dosage") / 2).alias("_p"))
    c = one_row(freq.agg((2 * F.sum(F.col("_p") * (1 - F.col("_p")))).alias("c"))).getField("c")
    cells = geno.where(F.col("dosage").isNotNull()).join(freq, "var_id").select(
        F.col("sample_id").alias("row"), F.col("var_id").alias("col"),
        (F.col("dosage") - 2 * F.col("_p")).alias("val"))
    n, p = dimensions(geno)
    dots = pair_dots(cells, n, p, self_pairs=True)
    return dots.select(F.col("row1").alias("sample1"), F.col("row2").alias("sample2"),
                       safe_div("dot", c).alias("g"))


# ---- real against synthetic ---------------------------------------------------

def correlation_structure_diff(real: DataFrame, synth: DataFrame, variants: DataFrame, max_distance: int | None = None) -> DataFrame:
    """Mean |r_real - r_synthetic| over the pairs of the given variants.

    With ``max_distance``, and ``chr`` and ``pos`` in ``variants``, over those at most so far apart: what a genome can afford,
    since without it the work is quadratic in the variants.
    """
    def side(df):
        cells = cut_lineage(df.select("sample_id", "var_id", "dosage").join(places.select("var_id"), "var_id", "left_semi"))
        return pairwise_r2(cells) if max_distance is None else windowed_r2(cells, places, max_distance)
    places = cut_lineage(variants)
    a, b = side(real), side(synth).select("var1", "var2", F.col("r").alias("r_s"))
    return a.join(b, ["var1", "var2"]).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg(F.abs(F.col("r") - F.col("r_s"))).alias("mean_abs_diff"))


def correlation_preserved(real: DataFrame, real_y: DataFrame, synth: DataFrame, synth_y: DataFrame,
                          tolerance: float = 0.1) -> DataFrame:
    """Per variant the target correlation on both sides and whether they agree."""
    a = target_correlation(real, real_y).select("var_id", F.col("r").alias("r_real"))
    b = target_correlation(synth, synth_y).select("var_id", F.col("r").alias("r_synth"))
    return a.join(b, "var_id").withColumn("diff", F.abs(F.col("r_real") - F.col("r_synth"))) \
            .withColumn("preserved", F.col("diff") < tolerance)


def histogram_overlap(real: DataFrame, synth: DataFrame, bins: int = 50) -> DataFrame:
    """Shared area of the two target histograms over a common range, last bin closed."""
    rows = (real.select("y", F.lit("r").alias("side")).unionByName(synth.select("y", F.lit("s").alias("side")))
            .where(F.col("y").isNotNull()))
    lim = one_row(rows.agg(F.min("y").alias("lo"), F.max("y").alias("hi")))
    binned = rows.withColumn("_l", lim).withColumn("bin", F.least(
        F.lit(bins - 1), F.floor(safe_div(F.col("y") - F.col("_l.lo"), F.col("_l.hi") - F.col("_l.lo")) * bins)))
    per = binned.groupBy("bin").agg(*[F.count_if(F.col("side") == s).alias(s) for s in ("r", "s")])
    n = one_row(rows.agg(*[F.count_if(F.col("side") == s).alias(s) for s in ("r", "s")]))
    share = per.withColumn("_n", n)
    return share.agg(F.coalesce(F.sum(F.when(F.col("bin").isNotNull(), F.least(
        safe_div("r", F.col("_n.r")), safe_div("s", F.col("_n.s"))))), F.lit(0.0)).alias("overlap"))


def maf_drift(real: DataFrame, synth: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Distance of the MAFs: mean, 95th percentile, share within tolerance and the gate."""
    a = maf_all_rows(real).select("var_id", F.col("maf").alias("m1"))
    b = maf_all_rows(synth).select("var_id", F.col("maf").alias("m2"))
    d = a.join(b, "var_id").select(F.abs(F.col("m1") - F.col("m2")).alias("d"))
    p95 = one_row(exact_quantiles(d, "d", [0.95]).select(F.col("q")[0].alias("q"))).getField("q")
    out = d.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("drift_mean"),
                F.avg(F.when(F.col("d") <= tolerance, 1.0).otherwise(0.0)).alias("pass_rate"))
    return out.withColumn("drift_p95", p95).withColumn(
        "gate", (F.col("drift_mean") < 0.02) & (F.col("drift_p95") < 0.05))


def positional_correlation(real: DataFrame, synth: DataFrame) -> DataFrame:
    """Correlation of two label lists position by position, cut to the shorter one."""
    a = ranked(real.where(F.col("y").isNotNull()).select("sample_id", "y"), ["sample_id"], name="i")
    b = ranked(synth.where(F.col("y").isNotNull()).select("sample_id", F.col("y").alias("y_s")), ["sample_id"], name="i")
    both = a.select("i", "y").join(b.select("i", "y_s"), "i")
    return both.agg(F.count(F.lit(1)).alias("n"), safe_div(
        F.covar_pop("y", "y_s"), F.stddev_pop("y") * F.stddev_pop("y_s")).alias("r"))
