"""Variant and sample quality control on the long genotype table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortframe.functions.expr import one_row, safe_div
from cohortframe.operators.ranking import ranked


def variant_stats(geno: DataFrame, n_samples: int | Column | None = None) -> DataFrame:
    """Calls, missing rate, alternate frequency and MAF per variant, in one aggregate.

    Cells absent from the table are "not genotyped".  Give ``n_samples`` to
    count them as missing, which spares writing null cells out.
    """
    calls = F.count("dosage")
    rows = F.count(F.lit(1)) if n_samples is None else F.lit(n_samples)
    stats = geno.groupBy("var_id").agg(
        rows.cast("long").alias("n_total"), calls.alias("n_valid"),
        F.sum("dosage").cast("double").alias("_alt"))
    freq = safe_div("_alt", F.col("n_valid") * 2)
    return stats.select(
        "var_id", "n_total", "n_valid", (F.col("n_total") - F.col("n_valid")).alias("n_missing"),
        safe_div(F.col("n_total") - F.col("n_valid"), "n_total").alias("missing_rate"),
        freq.alias("alt_freq"),
        F.coalesce(F.least(freq, 1.0 - freq), F.lit(0.0)).alias("maf"))


def hardy_weinberg(geno: DataFrame, alpha: float = 0.05, min_expected: float = 5.0) -> DataFrame:
    """Pearson chi-square against Hardy-Weinberg counts; p-value on 2 degrees of freedom.

    With two degrees of freedom the tail is exp(-x/2), so no special function is
    needed.  The p-value is null when an expected count is below the minimum.
    """
    counts = geno.groupBy("var_id").agg(
        *[F.count_if(F.col("dosage") == g).alias(f"n{g}") for g in (0, 1, 2)])
    n = F.col("n0") + F.col("n1") + F.col("n2")
    p = safe_div(F.col("n0") * 2 + F.col("n1"), n * 2)
    with_exp = counts.select(
        "var_id", "n0", "n1", "n2", (n * p * p).alias("e0"),
        (n * p * (1.0 - p) * 2).alias("e1"), (n * (1.0 - p) * (1.0 - p)).alias("e2"))
    enough = F.least("e0", "e1", "e2") >= min_expected
    chi2 = sum(((F.col(f"n{g}") - F.col(f"e{g}")) * (F.col(f"n{g}") - F.col(f"e{g}"))
                / F.col(f"e{g}") for g in (0, 1, 2)), F.lit(0.0))
    return (with_exp.withColumn("chi2", F.when(enough, chi2))
            .withColumn("p_value", F.exp(-F.col("chi2") / 2))
            .withColumn("hwe_pass", F.col("p_value") >= alpha))


def hwe_summary(tested: DataFrame) -> DataFrame:
    """Tested and passing variants over a ``hardy_weinberg`` result."""
    return tested.agg(
        F.count(F.lit(1)).alias("n_variants"), F.count("p_value").alias("n_tested"),
        F.count_if("hwe_pass").alias("n_pass"),
        safe_div(F.count_if("hwe_pass"), F.count("p_value")).alias("pass_share"))


def judge_variants(stats: DataFrame, max_missing: float = 0.05, min_maf: float = 0.05,
                   hwe: DataFrame | None = None, min_hwe_p: float | None = None) -> DataFrame:
    """Add ``verdict``: missing, maf, hwe or pass; the first failing rule names it."""
    rule = (F.when(F.col("missing_rate") > max_missing, F.lit("missing"))
             .when(F.col("maf") < min_maf, F.lit("maf")))
    if hwe is not None and min_hwe_p is not None:
        stats = stats.join(hwe.select("var_id", "p_value"), "var_id", "left")
        rule = rule.when(F.col("p_value") < min_hwe_p, F.lit("hwe"))
    return stats.withColumn("verdict", rule.otherwise(F.lit("pass")))


def filter_variants(geno: DataFrame, max_missing: float = 0.05, min_maf: float = 0.05,
                    min_hwe_p: float | None = None) -> DataFrame:
    """Genotype rows of the variants that pass.

    The verdict table has one row per variant; the semi join is left to the
    optimizer, which broadcasts it only while its measured size allows.
    """
    hwe = hardy_weinberg(geno) if min_hwe_p is not None else None
    kept = judge_variants(variant_stats(geno), max_missing, min_maf, hwe, min_hwe_p)
    return geno.join(kept.where("verdict = 'pass'").select("var_id"), "var_id", "left_semi")


def sample_stats(geno: DataFrame) -> DataFrame:
    """Missing and heterozygosity rate per sample over the given variants."""
    per = geno.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n_total"), F.count("dosage").alias("n_valid"),
        F.count_if(F.col("dosage") == 1).alias("n_het"))
    return per.select(
        "sample_id", "n_total", "n_valid",
        safe_div(F.col("n_total") - F.col("n_valid"), "n_total").alias("missing_rate"),
        safe_div("n_het", "n_valid").alias("het_rate"))


def het_bounds(stats: DataFrame, max_missing: float = 0.10, k: float = 3.0,
               dialect: str = "passers_clamped") -> DataFrame:
    """One row: mean, sample sd and bounds of the heterozygosity rate.

    ``passers_clamped``: over samples that pass the missing rule, bounds kept in
    0..1; ``passers``: same, not clamped; ``all``: over all samples.
    """
    base = stats if dialect == "all" else stats.where(F.col("missing_rate") <= max_missing)
    row = base.agg(F.avg("het_rate").alias("het_mean"), F.stddev_samp("het_rate").alias("het_sd"),
                   F.count("het_rate").alias("n"))
    lo, hi = F.col("het_mean") - k * F.col("het_sd"), F.col("het_mean") + k * F.col("het_sd")
    if dialect == "passers_clamped":
        lo, hi = F.greatest(F.lit(0.0), lo), F.least(F.lit(1.0), hi)
    elif dialect not in ("passers", "all"):
        raise ValueError(f"unknown dialect {dialect!r}")
    return row.select("het_mean", "het_sd", "n", lo.alias("lo"), hi.alias("hi"))


def judge_samples(stats: DataFrame, max_missing: float = 0.10, k: float = 3.0,
                  dialect: str = "passers_clamped") -> DataFrame:
    """Add ``verdict``: missing, heterozygosity or pass."""
    b = one_row(het_bounds(stats, max_missing, k, dialect))
    many = b.getField("n") > 1
    outside = (F.col("het_rate") < F.col("_b.lo")) | (F.col("het_rate") > F.col("_b.hi"))
    return (stats.withColumn("_b", F.when(many, b))
            .withColumn("verdict", F.when(F.col("missing_rate") > max_missing, F.lit("missing"))
                        .when(outside, F.lit("heterozygosity")).otherwise(F.lit("pass")))
            .drop("_b"))


def filter_samples(geno: DataFrame, max_missing: float = 0.10, k: float = 3.0,
                   dialect: str = "passers_clamped") -> DataFrame:
    kept = judge_samples(sample_stats(geno), max_missing, k, dialect).where("verdict = 'pass'")
    return geno.join(kept.select("sample_id"), "sample_id", "left_semi")


def sample_map(judged: DataFrame) -> DataFrame:
    """Sample_map rows: status kept/removed, the failure reasons and the rates behind them."""
    why = F.array_compact(F.array(
        F.when(F.col("verdict") == "missing", F.concat(
            F.lit("missing rate "), F.format_number("missing_rate", 4))),
        F.when(F.col("verdict") == "heterozygosity", F.concat(
            F.lit("heterozygosity "), F.format_number("het_rate", 4)))))
    return judged.select(
        "sample_id", F.when(F.col("verdict") == "pass", "kept").otherwise("removed").alias("status"),
        why.alias("failure_reasons"), "missing_rate", "het_rate")


def snp_columns(values: DataFrame) -> DataFrame:
    """Variants whose values are all 0, 1 or 2."""
    return (values.groupBy("var_id").agg(
        F.bool_and(F.col("dosage").isin(0, 1, 2)).alias("is_snp")).where("is_snp").select("var_id"))


def thin_variants(variants: DataFrame, limit: int, target: int,
                  dialect: str = "floor") -> DataFrame:
    """Every f-th variant along the genome when there are more than ``limit``.

    f = n // target (``floor``) or n // target + 1 (``floor_plus_one``).
    """
    order = ranked(variants, ["chr", "pos", "var_id"], name="_r", total="_n")
    step = F.floor(F.col("_n") / target)
    if dialect == "floor_plus_one":
        step = step + 1
    step = F.when(F.col("_n") > limit, F.greatest(F.lit(1), step)).otherwise(F.lit(1))
    return order.where((F.col("_r") - 1) % step == 0).drop("_r", "_n")


def qc_report(geno: DataFrame, max_missing: float = 0.05, min_maf: float = 0.05,
              max_sample_missing: float = 0.10, k: float = 3.0,
              dialect: str = "passers_clamped") -> DataFrame:
    """Named metrics of a whole quality-control run, one row each."""
    judged = judge_variants(variant_stats(geno), max_missing, min_maf)
    v = judged.agg(
        F.count(F.lit(1)).alias("variants_total"),
        F.count_if(F.col("verdict") == "pass").alias("variants_passed"),
        F.count_if(F.col("verdict") == "missing").alias("variants_failed_missing"),
        F.count_if(F.col("verdict") == "maf").alias("variants_failed_maf"))
    kept = geno.join(judged.where("verdict = 'pass'").select("var_id"), "var_id", "left_semi")
    stats = judge_samples(sample_stats(kept), max_sample_missing, k, dialect)
    passed = F.col("verdict") == "pass"
    s = stats.agg(
        F.count(F.lit(1)).alias("samples_total"), F.count_if(passed).alias("samples_passed"),
        F.count_if(F.col("verdict") == "missing").alias("samples_failed_missing"),
        F.count_if(F.col("verdict") == "heterozygosity").alias("samples_failed_heterozygosity"),
        F.sum(F.when(passed, F.col("n_total"))).alias("calls_total"),
        F.sum(F.when(passed, F.col("n_total") - F.col("n_valid"))).alias("calls_imputed"),
        safe_div(F.sum(F.when(passed, F.col("n_total") - F.col("n_valid"))),
                 F.sum(F.when(passed, F.col("n_total")))).alias("imputation_rate"))
    h = het_bounds(stats, max_sample_missing, k, dialect).select("het_mean", "het_sd")
    parts = [p.select([F.col(c).cast("double").alias(c) for c in p.columns])
              .unpivot([], p.columns, "metric", "value") for p in (v, s, h)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
