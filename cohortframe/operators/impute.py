"""Imputation, scaling and class encoding of the long genotype table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.functions.expr import one_row, safe_div
from cohortframe.operators.grid import filled_grid
from cohortframe.operators.ranking import exact_quantiles


def dosage_modes(geno: DataFrame) -> DataFrame:
    """Most frequent dosage per variant; ties go to the smaller, no calls give 0."""
    n = {g: F.count_if(F.col("dosage") == g) for g in (0, 1, 2)}
    return geno.groupBy("var_id").agg(
        F.when((n[0] >= n[1]) & (n[0] >= n[2]), 0).when(n[1] >= n[2], 1).otherwise(2).alias("mode"))


def impute_mode(geno: DataFrame) -> DataFrame:
    filled = geno.join(dosage_modes(geno), "var_id")
    return filled.withColumn("dosage", F.coalesce("dosage", "mode")).select(geno.columns)


def impute_stat(geno: DataFrame, stat: str = "mean", fit: DataFrame | None = None) -> DataFrame:
    """Fill with the per-variant mean or median, taken from ``fit`` (default: same table).

    Dosages have at most a handful of distinct values, so the exact percentile
    buffer stays tiny however many samples there are.
    """
    agg = F.avg("dosage") if stat == "mean" else F.percentile("dosage", 0.5)
    fills = (fit if fit is not None else geno).groupBy("var_id").agg(agg.alias("_fill"))
    return (geno.join(fills, "var_id", "left")
            .withColumn("dosage", F.coalesce(F.col("dosage").cast("double"), "_fill"))
            .select(geno.columns))


def imputation_counts(geno: DataFrame) -> DataFrame:
    missing = F.count_if(F.col("dosage").isNull())
    return geno.agg(F.count(F.lit(1)).alias("n_calls"), missing.alias("n_imputed"),
                    safe_div(missing, F.count(F.lit(1))).alias("imputation_rate"))


def align_to_variants(geno: DataFrame, samples: DataFrame | None = None, variants: DataFrame | None = None,
                      fill: int | None = 0) -> DataFrame:
    """Every sample with every given variant: unseen cells get ``fill``, extras go.

    Left out, the samples or the variants are those of the table itself.
    """
    samples, variants = (geno if df is None else df for df in (samples, variants))
    return filled_grid(samples.select("sample_id").distinct(), variants.select("var_id").distinct(), geno,
                       F.lit(fill).cast(geno.schema["dosage"].dataType))


def standardize(values: DataFrame, value: str = "dosage", key: str = "var_id",
                fit: DataFrame | None = None, sd: str = "population") -> DataFrame:
    """(x - mean) / sd per key, sd 0 taken as 1; statistics come from ``fit``.

    ``sd`` is population, sample, or both: then ``z`` and ``z_sample`` come from one aggregate and one join.
    """
    spread = {"population": {"z": F.stddev_pop}, "sample": {"z": F.stddev_samp}, "both": {"z": F.stddev_pop, "z_sample": F.stddev_samp}}[sd]
    stats = (fit if fit is not None else values).groupBy(key).agg(
        F.avg(value).alias("_m"), *[f(value).alias(f"_s_{name}") for name, f in spread.items()])
    scaled = {name: (F.col(value) - F.col("_m")) / F.when(F.col(f"_s_{name}") > 0, F.col(f"_s_{name}")).otherwise(1.0) for name in spread}
    return values.join(stats, key).withColumns(scaled).drop("_m", *[f"_s_{name}" for name in spread])


def fill_nonfinite(values: DataFrame, value: str, key: str) -> DataFrame:
    """NaN, infinite and null values replaced by the key's exact median of the finite ones."""
    x = F.col(value).cast("double")
    clean = values.withColumn(value, F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x))
    med = exact_quantiles(clean, value, [0.5], by=[key]).select(key, F.col("q")[0].alias("_med"))
    return (clean.join(med, key, "left")
            .withColumn(value, F.coalesce(value, "_med")).drop("_med").select(values.columns))


def valid_samples(synth: DataFrame) -> DataFrame:
    """Rows of the samples whose calls are all present and round to 0, 1 or 2; calls rounded."""
    ok = F.coalesce(F.rint("dosage").isin(0.0, 1.0, 2.0), F.lit(False))
    good = synth.groupBy("sample_id").agg(F.bool_and(ok).alias("_ok")).where("_ok")
    return (synth.join(good.select("sample_id"), "sample_id", "left_semi")
            .withColumn("dosage", F.rint("dosage").cast("int")))


def repair_calls(synth: DataFrame, real: DataFrame) -> DataFrame:
    """Calls outside 0, 1, 2 replaced by the real mode of the variant."""
    bad = F.col("dosage").isNull() | ~F.col("dosage").isin(0, 1, 2)
    return (synth.join(dosage_modes(real), "var_id")
            .withColumn("dosage", F.when(bad, F.col("mode")).otherwise(F.col("dosage")).cast("int"))
            .select(synth.columns))


def target_within_sd(synth_y: DataFrame, real_y: DataFrame, k: float = 2.0) -> DataFrame:
    """Synthetic targets inside real mean +- k sample sd."""
    s = one_row(real_y.agg(F.avg("y").alias("m"), F.stddev_samp("y").alias("sd")))
    return (synth_y.withColumn("_s", s)
            .where(F.col("y").between(F.col("_s.m") - k * F.col("_s.sd"),
                                      F.col("_s.m") + k * F.col("_s.sd"))).drop("_s"))


def discretize(values: DataFrame, value: str, cuts: Sequence[float], by: Sequence[str],
               name: str = "cls", right_open: bool = False) -> DataFrame:
    """Class number = how many quantile cuts the value exceeds.

    ``right_open`` counts a value equal to a cut as beyond it (numpy digitize);
    otherwise the comparison is strict.
    """
    by = list(by)
    q = exact_quantiles(values, value, cuts, by).select(*by, F.col("q").alias("_q"))
    if by:
        out = values.join(q, by)
    else:
        out = values.withColumn("_q", one_row(q).getField("_q"))
    x = F.col(value)
    passed = F.filter("_q", (lambda c: c <= x) if right_open else (lambda c: c < x))
    return out.withColumn(name, F.when(x.isNotNull(), F.size(passed))).drop("_q")


def equal_width_class(values: DataFrame, value: str, cuts: Sequence[float] = (1 / 3, 2 / 3),
                      name: str = "cls") -> DataFrame:
    """Class by fixed shares of the value range."""
    r = one_row(values.agg(F.min(value).alias("lo"), F.max(value).alias("hi")))
    x = F.col(value)
    edges = [F.col("_r.lo") + c * (F.col("_r.hi") - F.col("_r.lo")) for c in cuts]
    count = sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return values.withColumn("_r", r).withColumn(name, F.when(x.isNotNull(), count)).drop("_r")
