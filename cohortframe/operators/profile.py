"""Column, table and cohort profiling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.functions.encoding import try_double
from cohortframe.functions.expr import one_row, safe_div


def as_long(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """(ids.., col, v) rows with every value as text."""
    return df.select(*ids, *[F.col(c).cast("string").alias(c) for c in columns]) \
             .unpivot(list(ids), list(columns), "col", "v")


def numeric_screen(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: present values, texts among them, share without a number, verdict.

    A column is numeric when something is present, nothing present is text, and
    at most half of its rows lack a number.  All rows are read, in one pass.
    """
    rows = as_long(df, columns).withColumn("x", try_double("v"))
    text = F.count_if(F.col("v").isNotNull() & F.col("x").isNull())
    share = safe_div(F.count_if(F.col("x").isNull()), F.count(F.lit(1)))
    return (rows.groupBy("col").agg(F.count("v").alias("n_present"), text.alias("n_text"),
                                    share.alias("null_share"))
            .withColumn("is_numeric", (F.col("n_present") > 0) & (F.col("n_text") == 0)
                        & (F.col("null_share") <= 0.5)))


def target_stats(values: DataFrame, value: str) -> DataFrame:
    """Count, nulls, mean, population sd, range, exact quartiles and both skewness forms."""
    from cohortframe.operators.ranking import exact_quantiles

    x = F.col(value)
    n = F.col("n")
    stats = values.agg(
        F.count(x).alias("n"), F.count_if(x.isNull()).alias("n_null"), F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.skewness(x).alias("skew_biased"))
    q = one_row(exact_quantiles(values, value, [0.25, 0.5, 0.75]).select("q")).getField("q")
    adjusted = F.when(n > 2, F.col("skew_biased") * F.sqrt(n * (n - 1)) / (n - 2))
    return (stats.withColumn("_q", q).withColumn("skew_adjusted", adjusted)
            .select(*stats.columns, "skew_adjusted", F.col("_q")[0].alias("q25"),
                    F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q75")))


def best_covered_target(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The trait with most non-null rows; the first listed on ties."""
    counts = df.agg(*[F.count(c).alias(c) for c in columns])
    order = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(-i))])
    return (counts.unpivot([], list(columns), "trait", "n")
            .agg(F.max_by("trait", F.struct("n", order[F.col("trait")])).alias("trait"),
                 F.max("n").alias("n")))


def snp_profile(real: DataFrame, synth: DataFrame, k: int = 10) -> DataFrame:
    """Variants with the largest absolute mean difference between the two tables."""
    rows = (real.select("var_id", "dosage", F.lit("r").alias("side"))
            .unionByName(synth.select("var_id", "dosage", F.lit("s").alias("side"))))
    aggs = []
    for side, name in (("r", "real"), ("s", "synth")):
        x = F.when(F.col("side") == side, F.col("dosage"))
        here = F.count_if(F.col("side") == side)
        aggs += [F.avg(x).alias(f"mean_{name}"), F.var_samp(x).alias(f"var_{name}"),
                 safe_div(here - F.count(x), here).alias(f"missing_{name}")]
    return (rows.groupBy("var_id").agg(*aggs)
            .withColumn("abs_mean_diff", F.abs(F.col("mean_real") - F.col("mean_synth")))
            .where(F.col("abs_mean_diff").isNotNull())
            .orderBy(F.desc(F.round("abs_mean_diff", 9)), "var_id").limit(k))


def genotype_quality(geno: DataFrame, by: str = "dataset") -> DataFrame:
    """Samples, variants, usable variants and mean missing rate per dataset."""
    per = geno.groupBy(by, "var_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("dosage").alias("c"), F.var_samp("dosage").alias("v"))
    miss = safe_div(F.col("n") - F.col("c"), "n")
    out = per.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_snps"), F.avg(miss).alias("missing_rate"),
        F.count_if((miss < 0.2) & (F.col("v") > 1e-9)).alias("usable_snps"))
    return out.join(geno.groupBy(by).agg(F.count_distinct("sample_id").alias("n_samples")), by)


def phenotype_quality(pheno: DataFrame, value: str, by: str = "dataset") -> DataFrame:
    """Missing rate and label balance (adjusted skewness) of a numeric target per dataset."""
    n, g = F.count(value), F.skewness(value)
    return pheno.groupBy(by).agg(
        safe_div(F.count_if(F.col(value).isNull()), F.count(F.lit(1))).alias("phenotype_missing_rate"),
        F.when(n > 2, g * F.sqrt(n * (n - 1)) / (n - 2)).alias("label_balance"))


def class_balance(pheno: DataFrame, value: str, by: str = "dataset") -> DataFrame:
    """Share of the most frequent class of a text target per dataset."""
    per = pheno.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(by).agg(safe_div(F.max("n"), F.sum("n")).alias("label_balance"))


def quality_buckets(q: DataFrame) -> DataFrame:
    """High / Medium / Low for genotypes, phenotypes and augmentation potential."""
    r2 = F.coalesce("baseline_r2", F.lit(0.0))
    g = (F.when((F.col("n_samples") >= 100) & (F.col("usable_snps") >= 100)
                & (F.coalesce("missing_rate", F.lit(0.0)) < 0.1), "High")
         .when((F.col("n_samples") >= 50) & (F.col("usable_snps") >= 50), "Medium").otherwise("Low"))
    p = (F.when(F.col("has_numeric_target") & (F.coalesce("phenotype_missing_rate", F.lit(0.0)) < 0.1), "High")
         .when(F.col("has_numeric_target"), "Medium").otherwise("Low"))
    a = (F.when((F.col("genotype_quality") == "High") & (F.col("phenotype_quality") == "High")
                & (F.col("overlap") >= 0.8) & (r2 >= 0.1), "High")
         .when((F.col("overlap") >= 0.5) & (r2 >= 0.05), "Medium").otherwise("Low"))
    return (q.withColumn("genotype_quality", g).withColumn("phenotype_quality", p)
            .withColumn("augmentation_potential", a))


def top_candidates(bucketed: DataFrame, k: int = 3) -> DataFrame:
    tier = (F.when(F.col("augmentation_potential") == "High", 2)
            .when(F.col("augmentation_potential") == "Medium", 1).otherwise(0))
    return bucketed.orderBy(tier.desc(), F.coalesce("baseline_r2", F.lit(-1.0)).desc(), "dataset").limit(k)


def context_summary(synth: DataFrame, synth_y: DataFrame, real: DataFrame, real_y: DataFrame) -> DataFrame:
    """Rows, call validity and target moments per (source, context), plus a REAL row."""
    def side(calls: DataFrame, y: DataFrame) -> DataFrame:
        keys = ["source", "context"]
        ok = F.coalesce(F.col("dosage").isin(0, 1, 2), F.lit(False))
        c = calls.groupBy(*keys).agg(F.count_if(~ok).alias("n_invalid"))
        t = y.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_samples"), F.avg("y").alias("y_mean"),
                                 F.stddev_samp("y").alias("y_sd"), F.min("y").alias("y_min"),
                                 F.max("y").alias("y_max"))
        return t.join(c, keys, "left").withColumn("valid_calls", F.col("n_invalid") == 0)

    def tag(df: DataFrame) -> DataFrame:
        return df.withColumn("source", F.lit("REAL")).withColumn("context", F.lit("REAL"))

    return side(synth, synth_y).unionByName(side(tag(real), tag(real_y)))


def drop_metadata_first_row(cells: DataFrame, share: float = 0.3) -> DataFrame:
    """``cells(seq, col, v)`` without the first row when more than ``share`` of its values are not numbers (a null is not)."""
    first = one_row(cells.agg(F.min("seq").alias("seq"))).getField("seq")
    odd = one_row(cells.where(F.col("seq") == first).agg(
        F.avg(F.when(try_double(F.col("v")).isNull(), 1.0).otherwise(0.0)).alias("share"))).getField("share")
    return cells.where((F.col("seq") != first) | (odd <= share))


def usable_target(pheno: DataFrame, value: str, min_sd: float = 1e-6, min_n: int = 100) -> DataFrame:
    return pheno.agg(F.count(value).alias("n"), F.stddev_samp(value).alias("sd")).withColumn(
        "verdict", F.when((F.coalesce("sd", F.lit(0.0)) < min_sd) | (F.col("n") < min_n), "reject")
        .otherwise("use"))


def extremes(pheno: DataFrame, k: int = 5) -> DataFrame:
    """The k highest and k lowest targets, ranked from each end."""
    from pyspark.sql import Window as W

    def side(order, name):
        picked = pheno.where(F.col("y").isNotNull()).orderBy(*order).limit(k)   # top-k per task, then merged
        return picked.withColumn("end", F.lit(name)).withColumn("rank", F.row_number().over(W.orderBy(*order)))

    return side([F.desc("y"), F.col("sample_id")], "top").unionByName(
        side([F.asc("y"), F.col("sample_id")], "bottom"))


def top_variance(geno: DataFrame, k: int = 120) -> DataFrame:
    return (geno.groupBy("var_id").agg(F.var_samp("dosage").alias("variance"))
            .orderBy(F.desc(F.round("variance", 9)), "var_id").limit(k))


def closest_to_median(pheno: DataFrame, k: int = 10) -> DataFrame:
    from cohortframe.functions.expr import one_row
    from cohortframe.operators.ranking import exact_quantiles

    med = one_row(exact_quantiles(pheno, "y", [0.5]).select(F.col("q")[0].alias("m"))).getField("m")
    return (pheno.where(F.col("y").isNotNull()).withColumn("distance", F.abs(F.col("y") - med))
            .orderBy(F.round("distance", 9), "sample_id").limit(k))


def head_median_tail(pheno: DataFrame, edge: int = 7, half: int = 3, minimum: int = 20) -> DataFrame:
    """The highest, the middle and the lowest rows; every row of a small table."""
    from cohortframe.operators.ranking import ranked

    r = ranked(pheno.where(F.col("y").isNotNull()), [F.desc("y"), "sample_id"], name="_r", total="_n")
    i, n = F.col("_r") - 1, F.col("_n")
    mid = F.floor(n / 2)
    part = (F.when(n < minimum, "all").when(i < edge, "high").when(i >= n - edge, "low")
            .when((i >= mid - half) & (i < mid + half), "median"))
    return r.withColumn("part", part).where(F.col("part").isNotNull()).drop("_r", "_n")
