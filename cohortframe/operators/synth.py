"""Synthetic cohorts: samplers, corrections, labels and checks.

Every random number is a hash of (seed, purpose, keys).  A cell therefore draws
the same value whatever the partitioning, and a lost task redraws it exactly.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortframe.functions.encoding import clean_dosage, numbered_id, try_double
from cohortframe.functions.expr import clip, norm_ppf, one_row, std_normal, u01
from cohortframe.operators.grid import grid
from cohortframe.operators.impute import discretize
from cohortframe.operators.popgen import pairwise_r2
from cohortframe.operators.ranking import exact_quantiles, ranked
from cohortframe.operators.runs import regression_metrics

CONTEXTS = ("A", "B", "C", "D", "E")


def numbered_samples(spark: SparkSession, n: int, prefix: str = "SYNTH_") -> DataFrame:
    """n sample ids, numbered from 1."""
    return spark.range(1, n + 1).select(numbered_id(prefix, "id").alias("sample_id"))


def _inverse_cdf(u: Column, p0: Column | str, p1: Column | str) -> Column:
    p0, p1 = (F.col(c) if isinstance(c, str) else c for c in (p0, p1))
    return F.when(u < p0, 0).when(u < p0 + p1, 1).otherwise(2)


# ---- genotype samplers -----------------------------------------------------------

def sample_marginal(samples: DataFrame, freqs: DataFrame, seed: int = 42) -> DataFrame:
    """Each cell from the variant's genotype frequencies p0, p1, p2."""
    u = u01(seed, F.lit("marginal"), "sample_id", "var_id")
    return grid(samples.select("sample_id"), freqs).select(
        "sample_id", "var_id", _inverse_cdf(u, "p0", "p1").alias("dosage"))


def sample_hwe(samples: DataFrame, freqs: DataFrame, seed: int = 42) -> DataFrame:
    """Each cell from Hardy-Weinberg proportions of ``p``."""
    p = F.col("p")
    u = u01(seed, F.lit("hwe"), "sample_id", "var_id")
    return grid(samples.select("sample_id"), freqs).select(
        "sample_id", "var_id", _inverse_cdf(u, (1.0 - p) * (1.0 - p), 2.0 * p * (1.0 - p)).alias("dosage"))


def sample_ld_blocks(samples: DataFrame, blocks: DataFrame, seed: int = 42, sigma: float = 0.5) -> DataFrame:
    """Genotypes that are correlated inside linkage blocks.

    ``blocks(var_id, block_id, p)``.  A sample draws one latent value per block;
    each allele adds its own noise and counts when it passes the variant's
    threshold.  The latent value is a hash, so no join hands it round.
    """
    p = clip("p", 1e-6, 1 - 1e-6)
    cells = grid(samples.select("sample_id"), blocks.withColumn("_t", norm_ppf(1.0 - p)))
    shared = std_normal(seed, F.lit("block"), "sample_id", "block_id")

    def allele(name):
        noise = std_normal(seed, F.lit(name), "sample_id", "var_id") * sigma
        return F.when(F.col("_z") + noise > F.col("_t"), 1).otherwise(0)

    return cells.withColumn("_z", shared).select(
        "sample_id", "var_id", (allele("a1") + allele("a2")).alias("dosage"))


def correct_maf(geno: DataFrame, targets: DataFrame, tolerance: float = 0.02, seed: int = 42) -> DataFrame:
    """Bring the MAF of each variant outside the tolerance to its target, exact to the allele.

    A cell is two alleles.  A variant that is short of d alternative alleles turns the d reference alleles with the
    smallest hash, one with d too many turns d alternative ones.  ``targets(var_id, maf)``.
    """
    alleles = F.lit(2) * F.count(F.lit(1))
    per = geno.groupBy("var_id").agg(alleles.alias("all"), F.sum("dosage").alias("alt")).join(
        targets.select("var_id", F.col("maf").alias("target")), "var_id")
    p = F.col("alt") / F.col("all").cast("double")
    want = F.when(p <= 0.5, F.col("target")).otherwise(1.0 - F.col("target"))       # stay on the side of the minor allele
    deficit = F.rint(F.col("all") * (want - p)).cast("long")
    plan = per.where(F.abs(F.least(p, 1.0 - p) - F.col("target")) > tolerance).select("var_id", deficit.alias("deficit"), "all", "alt") \
        .where("deficit <> 0")
    open_ = F.when(F.col("deficit") > 0, F.col("all") - F.col("alt")).otherwise(F.col("alt"))     # alleles that can turn
    share = F.abs("deficit") / open_
    plan = plan.select("var_id", "deficit", (share + 6.0 * F.sqrt(share / open_) + 10.0 / open_).alias("below"))
    up = F.col("deficit") > 0
    pool = geno.join(plan, "var_id").select("sample_id", "var_id", "deficit", "below", "dosage", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")) \
        .where(F.when(up, F.col("copy") > F.col("dosage")).otherwise(F.col("copy") <= F.col("dosage"))) \
        .withColumn("_u", u01(seed, F.lit("allele"), "sample_id", "var_id", "copy"))
    # few alleles turn, so only those under a bound somewhat above the wanted share are sorted; too few under it: all are
    under = pool.where("_u < below").groupBy("var_id").agg(F.count(F.lit(1)).alias("_n"))
    few = plan.join(under, "var_id", "left").select("var_id", (F.coalesce("_n", F.lit(0)) < F.abs("deficit")).alias("_few"))
    near = pool.join(few, "var_id").where("_few OR _u < below")
    turned = ranked(near, ["_u", "sample_id", "copy"], by=["var_id"], name="_r").where(F.col("_r") <= F.abs("deficit")) \
        .groupBy("sample_id", "var_id").agg(F.sum(F.sign("deficit")).alias("_d"))
    return geno.join(turned, ["sample_id", "var_id"], "left").select(
        "sample_id", "var_id", (F.col("dosage") + F.coalesce("_d", F.lit(0.0))).cast("int").alias("dosage"))


# ---- class-conditional and context samplers -------------------------------------------

def context_range(context: str | Column, y: DataFrame) -> Column:
    """Target range [lo, hi] of contexts A..E: all, low, high, middle half, lower half."""
    s = one_row(y.agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.avg("y").alias("m")))
    c = F.col(context) if isinstance(context, str) else context
    lo, hi, m = (s.getField(f) for f in ("lo", "hi", "m"))
    span = hi - lo
    return (F.when(c == "B", F.array(lo, m)).when(c == "C", F.array(m, hi))
            .when(c == "D", F.array(lo + span * 0.25, lo + span * 0.75))
            .when(c == "E", F.array(lo, lo + span * 0.5)).otherwise(F.array(lo, hi)))


def draw_targets(samples: DataFrame, real_y: DataFrame, seed: int = 42, bootstrap: bool = False) -> DataFrame:
    """A target per sample: uniform in its context's range, or a real value drawn by rank."""
    u = u01(seed, F.lit("target"), "sample_id")
    known = real_y.where(F.col("y").isNotNull()).select("sample_id", "y")
    if not bootstrap:
        return samples.withColumn("_g", context_range("context", known)).withColumn(
            "y", F.col("_g")[0] + u * (F.col("_g")[1] - F.col("_g")[0])).drop("_g")
    pool = ranked(known, ["y", "sample_id"], name="_r", total="_n").select(F.col("y").alias("y"), "_r", "_n")
    n = one_row(pool.agg(F.max("_n").alias("n"))).getField("n")
    return samples.withColumn("_r", F.floor(u * n) + 1).join(pool.drop("_n"), "_r").drop("_r")


def sample_by_class(targets: DataFrame, real_y: DataFrame, class_freqs: DataFrame, freqs: DataFrame,
                    n_classes: int = 5, seed: int = 42) -> DataFrame:
    """Cells from P(dosage | class of the sample's target, variant); the variant's marginal ``freqs`` for a class without any."""
    known = real_y.where(F.col("y").isNotNull())
    cuts = [i / n_classes for i in range(1, n_classes)]
    q = one_row(exact_quantiles(known, "y", cuts).select("q")).getField("q")
    classed = targets.withColumn("_q", q).withColumn(
        "cls", F.size(F.filter("_q", lambda c: c <= F.col("y"))).cast("int")).drop("_q")
    # the frequencies of all classes ride with the variant: the grid needs no second join
    by_class = class_freqs.groupBy("var_id").agg(F.map_from_entries(F.collect_list(F.struct("cls", F.struct("p0", "p1")))).alias("_f"))
    table = freqs.select("var_id", F.struct("p0", "p1").alias("_all")).join(by_class, "var_id", "left")
    u = u01(seed, F.lit("class"), "sample_id", "var_id")
    cells = grid(classed.select("sample_id", "cls"), table).withColumn("_p", F.coalesce(F.try_element_at("_f", F.col("cls")), F.col("_all")))
    return cells.select("sample_id", "var_id", _inverse_cdf(u, F.col("_p.p0"), F.col("_p.p1")).alias("dosage"))


def real_classes(real_y: DataFrame, n_classes: int = 5) -> DataFrame:
    """(sample_id, y, cls) of the real targets by equal quantile shares."""
    return discretize(real_y.where(F.col("y").isNotNull()), "y", [i / n_classes for i in range(1, n_classes)], [],
                      right_open=True)


def sample_contexts(samples: DataFrame, freqs: DataFrame, corr: DataFrame, seed: int = 42) -> DataFrame:
    """Discrete context samplers on ``samples(sample_id, context)``.

    A, C, D draw from the real frequencies; B adds .1 to genotype 2 (r > .1) or 0
    (r < -.1); E mixes 80 % of them with a flat Dirichlet draw.
    """
    table = freqs.join(corr.select("var_id", "r"), "var_id", "left")
    cells = grid(samples.select("sample_id", "context"), table)
    r = F.coalesce("r", F.lit(0.0))
    b0, b2 = F.when(r < -0.1, 0.1).otherwise(0.0), F.when(r > 0.1, 0.1).otherwise(0.0)
    biased = [(F.col("p0") + b0) / (1.0 + b0 + b2), F.col("p1") / (1.0 + b0 + b2)]
    e = [-F.log(u01(seed, F.lit(f"dirichlet{i}"), "sample_id", "var_id")) for i in range(3)]
    mixed = [F.col(f"p{i}") * 0.8 + e[i] / (e[0] + e[1] + e[2]) * 0.2 for i in (0, 1)]
    c = F.col("context")
    p0 = F.when(c == "B", biased[0]).when(c == "E", mixed[0]).otherwise(F.col("p0"))
    p1 = F.when(c == "B", biased[1]).when(c == "E", mixed[1]).otherwise(F.col("p1"))
    u = u01(seed, F.lit("context"), "sample_id", "var_id")
    return cells.select("sample_id", "context", "var_id", _inverse_cdf(u, p0, p1).alias("dosage"))


def context_targets(cells: DataFrame, real_y: DataFrame, seed: int = 42) -> DataFrame:
    """Target = mean + (mean dosage - 1) sd c + noise; tighter in C, noisier in E."""
    s = one_row(real_y.agg(F.avg("y").alias("m"), F.stddev_samp("y").alias("sd")))
    per = cells.groupBy("sample_id", "context").agg(F.avg("dosage").alias("g")).withColumn("_s", s)
    c = F.col("context")
    slope = F.when(c == "C", 0.8).otherwise(0.5)
    noise = F.when(c == "C", 0.2).otherwise(0.3) * std_normal(seed, F.lit("y"), "sample_id")
    extra = F.when(c == "E", 0.5 * std_normal(seed, F.lit("y2"), "sample_id")).otherwise(0.0)
    return per.select("sample_id", "context", (
        F.col("_s.m") + F.col("_s.sd") * ((F.col("g") - 1.0) * slope + noise + extra)).alias("y"))


def sample_gaussian(samples: DataFrame, real: DataFrame, seed: int = 42, head: int = 12) -> DataFrame:
    """Normal cells with each variant's mean and sd; the first ``head`` variants (by name) jointly normal with their real correlations.

    The values are continuous on purpose: they are what ``valid_samples`` rejects.  A head variant mixes the head's
    independent draws by its row of the Cholesky factor of the correlation matrix (head x head numbers on the driver);
    the draws are hashes, so no cell needs another cell.
    """
    stats = real.groupBy("var_id").agg(F.avg("dosage").alias("m"), F.stddev_samp("dosage").alias("sd"))
    names = [r.var_id for r in stats.select("var_id").orderBy("var_id").limit(head).collect()]
    corr = np.eye(len(names))
    for x in pairwise_r2(real.where(F.col("var_id").isin(*names))).collect():
        i, j = names.index(x.var1), names.index(x.var2)
        corr[i, j] = corr[j, i] = x.r if x.r is not None else 0.0
    factor = np.linalg.cholesky(corr + 1e-9 * np.eye(len(names))) if names else corr
    weights = real.sparkSession.createDataFrame([(v, row.tolist()) for v, row in zip(names, factor)], "var_id string, _w array<double>")
    table = stats.join(F.broadcast(weights), "var_id", "left")              # head rows
    draws = F.array(*[std_normal(seed, F.lit("gauss"), "sample_id", F.lit(v)) for v in names])
    mixed = F.aggregate(F.zip_with("_w", draws, lambda w, z: w * z), F.lit(0.0), lambda a, b: a + b)
    z = F.when(F.col("_w").isNull(), std_normal(seed, F.lit("gauss"), "sample_id", "var_id")).otherwise(mixed)
    return grid(samples.select("sample_id"), table).select("sample_id", "var_id", (F.col("m") + F.col("sd") * z).alias("dosage"))


def bootstrap_samples(samples: DataFrame, real: DataFrame, real_y: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Genotypes of real samples drawn with replacement, and normal targets cut to the real range."""
    pool = ranked(real.select(F.col("sample_id").alias("donor")).distinct(), ["donor"], name="_r", total="_n")
    n = one_row(pool.agg(F.max("_n").alias("n"))).getField("n")
    picks = samples.select("sample_id", (F.floor(u01(seed, F.lit("donor"), "sample_id") * n) + 1).alias("_r")) \
        .join(pool.select("donor", "_r"), "_r").select("sample_id", "donor")
    cells = picks.join(real.select(F.col("sample_id").alias("donor"), "var_id", "dosage"), "donor")
    s = one_row(real_y.agg(F.avg("y").alias("m"), F.stddev_samp("y").alias("sd"),
                           F.min("y").alias("lo"), F.max("y").alias("hi")))
    y = samples.select("sample_id").withColumn("_s", s).select("sample_id", clip(
        F.col("_s.m") + F.col("_s.sd") * std_normal(seed, F.lit("boot"), "sample_id"),
        F.col("_s.lo"), F.col("_s.hi")).alias("y"))
    return cells.select("sample_id", "donor", "var_id", "dosage"), y


# ---- labels ---------------------------------------------------------------------------

def teacher_labels(real: DataFrame, synth: DataFrame, folds: int = 5, alpha: float = 1.0, factor: float = 0.5,
                   clamp: Sequence[float] = (0.01, 0.99), seed: int = 42) -> DataFrame:
    """Ridge predictions for synthetic vectors plus noise of the cross-validated residual size.

    ``real(sample_id, features, y)``, ``synth(sample_id, features)``; the result
    is clipped to real percentiles.
    """
    from cohortframe.operators.modeling import fit, out_of_fold, predict

    by = real.select("sample_id", F.floor(u01(seed, F.lit("teacher"), "sample_id") * folds).cast("int").alias("fold"))
    oof = out_of_fold(real, by, {"ridge": {"alpha": alpha}}, folds)
    sigma = one_row(regression_metrics(oof).select((F.col("rmse") * factor).alias("s"))).getField("s")
    q = one_row(exact_quantiles(real, "y", list(clamp)).select("q")).getField("q")
    pred = predict(fit("ridge", {"alpha": alpha}, real), synth)
    noisy = F.col("prediction") + F.col("_s") * std_normal(seed, F.lit("label"), "sample_id")
    return pred.withColumn("_s", sigma).withColumn("_q", q).select(
        "sample_id", F.greatest(F.col("_q")[0], F.least(F.col("_q")[1], noisy)).alias("y"))


def correlated_labels(pairs: DataFrame, real_y: DataFrame, r: float = 0.8, seed: int = 42,
                      mean_band: float = 0.02, sd_band: float = 0.01) -> DataFrame:
    """Targets correlated with ``pairs(sample_id, real_y)``: slope r, matching noise, clipped.

    Recentred when the mean is off by more than ``mean_band`` and rescaled when
    the sd is off by more than ``sd_band``; both bands are fixed values of the definition.
    """
    s = one_row(real_y.agg(F.avg("y").alias("m"), F.stddev_samp("y").alias("sd"),
                           F.min("y").alias("lo"), F.max("y").alias("hi")))
    eps = std_normal(seed, F.lit("eps"), "sample_id") * F.col("_s.sd") * float((1 - r * r) ** 0.5)
    rows = pairs.withColumn("_s", s).withColumn("y", clip(
        (F.col("real_y") - F.col("_s.m")) * r + F.col("_s.m") + eps, F.col("_s.lo"), F.col("_s.hi")))

    def moments(df):
        return one_row(df.agg(F.avg("y").alias("m"), F.stddev_samp("y").alias("sd")))

    off = F.col("_n.m") - F.col("_s.m")
    rows = rows.withColumn("_n", moments(rows)).withColumn("y", F.when(
        F.abs(off) > mean_band, clip(F.col("y") - off, F.col("_s.lo"), F.col("_s.hi"))).otherwise(F.col("y"))).drop("_n")
    scale = F.when(F.col("_n.sd") > 0, F.col("_s.sd") / F.nullif(F.col("_n.sd"), F.lit(0.0))).otherwise(1.0)
    rows = rows.withColumn("_n", moments(rows)).withColumn("y", F.when(
        F.abs(F.col("_n.sd") - F.col("_s.sd")) > sd_band,
        clip(F.col("_n.m") + (F.col("y") - F.col("_n.m")) * scale, F.col("_s.lo"), F.col("_s.hi")))
        .otherwise(F.col("y"))).drop("_n")
    return rows.select("sample_id", "real_y", "y")


def noisy_labels(pairs: DataFrame, real_y: DataFrame, r: float = 0.8, seed: int = 42) -> DataFrame:
    """Targets with correlation ``r`` to ``pairs(sample_id, real_y)`` and the real mean and sd, cut to the real range.

    The noise is freed of what it shares with the targets by chance (its regression on them) and standardised, so that
    sd (r z + sqrt(1 - r^2) e) has the wanted correlation exactly; only the cut at the range can change it.
    """
    s = one_row(real_y.agg(F.avg("y").alias("m"), F.stddev_samp("y").alias("sd"), F.min("y").alias("lo"), F.max("y").alias("hi")))
    raw = pairs.select("sample_id", "real_y", std_normal(seed, F.lit("noise"), "sample_id").alias("_e"))
    both = one_row(raw.agg(F.avg("real_y").alias("m"), F.stddev_samp("real_y").alias("sd"), F.avg("_e").alias("me"),
                           (F.covar_pop("real_y", "_e") / F.nullif(F.var_pop("real_y"), F.lit(0.0))).alias("slope"), F.var_samp("_e").alias("ve")))
    rows = raw.withColumn("_s", s).withColumn("_b", both)
    at = F.col("real_y") - F.col("_b.m")
    free = F.col("_e") - F.col("_b.me") - F.coalesce("_b.slope", F.lit(0.0)) * at
    left = F.sqrt(F.col("_b.ve") - F.coalesce(F.pow("_b.slope", F.lit(2.0)) * F.pow("_b.sd", F.lit(2.0)), F.lit(0.0)))
    z = F.coalesce(at / F.nullif(F.col("_b.sd"), F.lit(0.0)), F.lit(0.0))
    e = F.coalesce(free / F.nullif(left, F.lit(0.0)), F.lit(0.0))
    y = F.col("_s.m") + F.col("_s.sd") * (z * r + e * float((1 - r * r) ** 0.5))
    return rows.select("sample_id", "real_y", clip(y, F.col("_s.lo"), F.col("_s.hi")).alias("y"))


def targeted_labels(pairs: DataFrame, real_y: DataFrame, r: float = 0.8, least: float = 0.7, seed: int = 42, shrink: float = 0.7,
                    tries: int = 6, mean_band: float = 0.02, sd_band: float = 0.01) -> DataFrame:
    """Targets made of ``pairs(sample_id, real_y)`` and as much noise as a correlation of ``least`` allows.

    The noise is first sized for correlation ``r``, then shrunk by ``shrink`` until the values, brought to the real mean and sd
    and cut to the real range, correlate with ``real_y`` by ``least``; after ``tries`` sizes there is none.  Every size is
    judged in the same two aggregates, so no try costs another pass.  Adds ``attempt``, the ``correlation`` reached, and
    ``reached``: whether it, the mean and the sd are what was asked for (within ``mean_band`` and ``sd_band``).
    """
    s = one_row(real_y.agg(F.avg("y").alias("m"), F.stddev_samp("y").alias("sd"), F.min("y").alias("lo"), F.max("y").alias("hi")))
    sizes = F.array(*[F.col("_s.sd") * float((1 / (r * r) - 1) ** 0.5 * shrink ** i) for i in range(tries)], F.lit(0.0))
    noise = std_normal(seed, F.lit("target"), "sample_id")
    raw = pairs.select("sample_id", "real_y", noise.alias("_e")).withColumn("_s", s).withColumn(
        "_y", F.transform(sizes, lambda c: F.col("real_y") + c * F.col("_e")))
    every = range(tries + 1)

    def per_size(f):
        return F.array(*[f(F.col("_y")[i]) for i in every])

    moments = one_row(raw.agg(per_size(F.avg).alias("m"), per_size(F.stddev_samp).alias("sd")))
    made = raw.withColumn("_n", moments).withColumn("_y", F.transform("_y", lambda v, i: clip(
        F.col("_s.m") + (v - F.col("_n.m")[i]) * F.coalesce(F.col("_s.sd") / F.nullif(F.col("_n.sd")[i], F.lit(0.0)), F.lit(1.0)),
        F.col("_s.lo"), F.col("_s.hi")))).select("sample_id", "real_y", "_y", "_s")

    def correlation(v):             # none without spread
        return F.coalesce(F.covar_samp("real_y", v) / F.nullif(F.stddev_samp("real_y") * F.stddev_samp(v), F.lit(0.0)), F.lit(0.0))

    judged = one_row(made.agg(per_size(correlation).alias("r"),
                              per_size(F.avg).alias("m"), per_size(F.stddev_samp).alias("sd")))
    first = F.array_position(F.transform("_j.r", lambda c: c >= least), True)
    at = F.when(first > 0, first).otherwise(tries + 1).cast("int")
    rows = made.withColumn("_j", judged).withColumn("attempt", at)

    def chosen(name):
        return F.element_at(name, F.col("attempt"))

    kept = (chosen("_j.r") >= least) & (F.abs(chosen("_j.m") - F.col("_s.m")) <= mean_band) & (F.abs(chosen("_j.sd") - F.col("_s.sd")) <= sd_band)
    return rows.select("sample_id", "real_y", chosen("_y").alias("y"), "attempt", chosen("_j.r").alias("correlation"),
                       F.coalesce(kept, F.lit(False)).alias("reached"))


def enforce_moments(y: DataFrame, mean: float | Column, sd: float | Column, lo: float | Column,
                    hi: float | Column) -> DataFrame:
    """The affine map that gives the values inside [lo, hi] the wanted mean and sd, cut to [lo, hi]; a null becomes the mean."""
    mean, sd = (c if isinstance(c, Column) else F.lit(c) for c in (mean, sd))
    inside = y.withColumn("y", clip(F.coalesce("y", mean), lo, hi))
    have = one_row(inside.agg(F.avg("y").alias("m"), F.stddev_samp("y").alias("sd")))
    z = F.coalesce((F.col("y") - F.col("_m.m")) / F.nullif(F.col("_m.sd"), F.lit(0.0)), F.lit(0.0))
    return inside.withColumn("_m", have).withColumn("y", clip(mean + sd * z, lo, hi)).drop("_m")


# ---- set size, checks, scenarios ----------------------------------------------------------

FEW = 1000      # the engine limits ranked groups before the shuffle up to here (spark.sql.optimizer.windowGroupLimitThreshold)


def top_up(rows: DataFrame, target: int = 200, by: str = "source", seed: int = 42) -> DataFrame:
    """Exactly ``target`` rows per source: a hashed subset, or the rows repeated in turn.

    Up to ``FEW`` rows every task keeps its own first ``target`` of a source before the shuffle (the engine's limit on ranked
    groups); for more, all rows are ranked over as many tasks as they need.  Either way a source that holds most rows costs no
    more than another.
    """
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    drawn = rows.withColumn("_u", u01(seed, F.lit("topup"), by, "sample_id"))
    place = (drawn.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy("_u", "sample_id"))) if target <= FEW
             else ranked(drawn, ["_u", "sample_id"], by=[by], name="_r"))
    first = place.where(F.col("_r") <= target)
    copies = F.floor((F.lit(target) - F.col("_r")) / F.col("_n"))
    out = first.join(sizes, by).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies)))
    new_id = F.when(F.col("copy") == 0, F.col("sample_id")).otherwise(
        F.concat("sample_id", F.lit("_"), F.col("copy").cast("string")))
    return out.withColumn("sample_id", new_id).drop("_n", "_r", "_u")


def count_plan(rows: DataFrame, target: int = 200, by: str = "source") -> DataFrame:
    """Existing and missing rows per source."""
    per = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_existing"))
    missing = F.greatest(F.lit(0), F.lit(target) - F.col("n_existing"))
    return per.withColumn("n_missing", missing.cast("long")).withColumn(
        "status", F.when(missing > 0, "generate").otherwise("up to date"))


def check_counts(rows: DataFrame, target: int, lo: float, hi: float, by: str = "source") -> DataFrame:
    """Count, nulls and range per source, with one verdict."""
    out = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("y").isNull()).alias("n_null"),
        F.count_if((F.col("y") < lo) | (F.col("y") > hi)).alias("n_out_of_range"))
    return out.withColumn("ok", (F.col("n") == target) & (F.col("n_null") == 0) & (F.col("n_out_of_range") == 0))


def structural_violations(cells: DataFrame, y: DataFrame) -> DataFrame:
    """(kind, sample_id, n): ids on one side only, calls outside 0/1/2, targets that are not numbers."""
    ids = cells.select("sample_id").distinct()
    one = F.lit(1).cast("long").alias("n")
    only_x = ids.join(y.select("sample_id"), "sample_id", "left_anti").select(F.lit("no_target").alias("kind"), "sample_id", one)
    only_y = y.select("sample_id").join(ids, "sample_id", "left_anti").select(F.lit("no_genotypes").alias("kind"), "sample_id", one)
    bad = F.coalesce(F.col("dosage").isin(0, 1, 2), F.lit(False))
    calls = cells.where(~bad).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")) \
        .select(F.lit("invalid_calls").alias("kind"), "sample_id", "n")
    text = y.where(try_double(F.col("y")).isNull()).select(F.lit("target_not_numeric").alias("kind"), "sample_id", one)
    return reduce(DataFrame.unionByName, [only_x, only_y, calls, text])


def set_report(cells: DataFrame, y: DataFrame, by: str = "source") -> DataFrame:
    """Per synthetic set: samples, variants, integer calls and the target range."""
    c = cells.groupBy(by, "sample_id").agg(F.count_if(F.rint("dosage") != F.col("dosage")).alias("odd")) \
        .groupBy(by).agg(F.count(F.lit(1)).alias("n_samples"), (F.sum("odd") == 0).alias("integer_calls"))
    v = cells.select(by, "var_id").distinct().groupBy(by).agg(F.count(F.lit(1)).alias("n_variants"))
    t = y.groupBy(by).agg(F.min("y").alias("y_min"), F.max("y").alias("y_max"))
    return c.join(v, by).join(t, by)


def scenario_sets(samples: DataFrame, sources: Sequence[str]) -> DataFrame:
    """(scenario, sample_id, origin, source): baseline, each source, hybrid and synthetic only.

    A sample names the scenarios it belongs to; one explode builds all sets.
    """
    names = [F.when(F.col("origin") == "real", F.lit("baseline")),
             *[F.when((F.col("origin") == "real") | (F.col("source") == s), F.lit(s)) for s in sources],
             F.lit("hybrid"), F.when(F.col("origin") != "real", F.lit("synthetic_only"))]
    return samples.select(F.explode(F.array_compact(F.array(*names))).alias("scenario"), "sample_id", "origin", "source")


# ---- parsing model answers ----------------------------------------------------------------

# Starts of lines that are talk, not data.
TALK = ("Here", "REFERENCE", "Alright", "1.", "2.")


def response_lines(responses: DataFrame) -> DataFrame:
    """(run_id, pos, line, n_fields): lines that may be CSV, quotes and fences removed."""
    clean = F.regexp_replace("text", "[\"']", "")
    lines = responses.select("run_id", F.posexplode(F.split(clean, "\n")).alias("pos", "line"))
    line = F.trim(F.regexp_replace("line", "```csv|```", ""))
    out = lines.withColumn("line", line).withColumn("n_fields", F.size(F.split("line", ",")))
    talk = reduce(Column.__or__, [F.startswith("line", F.lit(s)) for s in TALK])
    return out.where((F.col("line") != "") & ~F.contains("line", F.lit("...")) & ~talk & (F.col("n_fields") >= 3))


def parse_responses(responses: DataFrame, columns: Sequence[str], target: str = "y", limit: int | None = None
                    ) -> tuple[DataFrame, DataFrame]:
    """Rows read from the answers, and the lines that were turned down with the reason.

    The header is the line equal to the wanted one, else the first line with its
    number of fields.  Later lines with no more fields than the header are rows:
    calls are coerced to 0..2, repeated ids renumbered, at most ``limit`` rows kept
    per answer.
    """
    header = ",".join(["Sample_ID", *columns, target])
    width = len(columns) + 2
    lines = response_lines(responses)
    exact = F.min(F.when(F.col("line") == header, F.col("pos")))
    same = F.min(F.when(F.col("n_fields") == width, F.col("pos")))
    heads = lines.groupBy("run_id").agg(F.coalesce(exact, same).alias("_h"))
    placed = lines.join(heads, "run_id")
    reason = (F.when(F.col("_h").isNull(), "no header").when(F.col("pos") < F.col("_h"), "before header")
              .when(F.col("pos") == F.col("_h"), "header").when(F.col("n_fields") > width, "too many fields"))
    judged = placed.withColumn("reason", reason)
    rejects = judged.where("reason IS NOT NULL AND reason <> 'header'").select("run_id", "pos", "line", "reason")
    parts = F.split("line", ",")
    rows = judged.where("reason IS NULL").select(
        "run_id", "pos", F.trim(parts[0]).alias("sample_id"),
        *[clean_dosage(F.get(parts, i + 1)).alias(c) for i, c in enumerate(columns)],
        try_double(F.get(parts, len(columns) + 1)).alias(target))
    per = rows.groupBy("run_id").agg((F.count(F.lit(1)) > F.count_distinct("sample_id")).alias("_dup"))
    w = W.partitionBy("run_id").orderBy("pos")       # rows of one answer
    rows = rows.withColumn("_i", F.row_number().over(w))
    if limit is not None:
        rows = rows.where(F.col("_i") <= limit)
    rows = rows.join(per, "run_id").withColumn("sample_id", F.when(
        F.col("_dup"), numbered_id("SYNTH_", "_i")).otherwise(F.col("sample_id")))
    return rows.drop("_dup", "_i"), rejects
