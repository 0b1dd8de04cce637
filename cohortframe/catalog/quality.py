"""Quality control and imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortframe.catalog import query
from cohortframe.functions.expr import round_columns, rounded
from cohortframe.operators import impute as I
from cohortframe.operators import qc as Q

VSTATS = """
vs AS (SELECT var_id, count(*) AS n_total, count(dosage) AS n_valid, count(*) - count(dosage) AS n_missing,
              (count(*) - count(dosage)) * 1e0 / count(*) AS missing_rate,
              sum(dosage) * 1e0 / nullif(2 * count(dosage), 0) AS alt_freq FROM geno GROUP BY var_id),
vm AS (SELECT *, coalesce(least(alt_freq, 1 - alt_freq), 0) AS maf FROM vs),
vj AS (SELECT *, CASE WHEN missing_rate > 5e-2 THEN 'missing' WHEN maf < 5e-2 THEN 'maf' ELSE 'pass' END AS verdict FROM vm)
"""

SSTATS = VSTATS + """,
kept AS (SELECT g.* FROM geno g JOIN vj ON vj.var_id = g.var_id AND verdict = 'pass'),
ss AS (SELECT sample_id, count(*) AS n_total, count(dosage) AS n_valid,
              (count(*) - count(dosage)) * 1e0 / count(*) AS missing_rate,
              count(*) FILTER (WHERE dosage = 1) * 1e0 / nullif(count(dosage), 0) AS het_rate
       FROM kept GROUP BY sample_id)
"""


def judged(where: str, k: str, clamp: bool) -> str:
    lo, hi = f"avg(het_rate) - {k} * stddev_samp(het_rate)", f"avg(het_rate) + {k} * stddev_samp(het_rate)"
    if clamp:
        lo, hi = f"greatest(0, {lo})", f"least(1, {hi})"
    return SSTATS + f""",
b AS (SELECT {lo} AS lo, {hi} AS hi, avg(het_rate) AS het_mean, stddev_samp(het_rate) AS het_sd FROM ss {where}),
sj AS (SELECT ss.*, CASE WHEN missing_rate > 1e-1 THEN 'missing'
                         WHEN het_rate < lo OR het_rate > hi THEN 'heterozygosity' ELSE 'pass' END AS verdict FROM ss, b)
"""


PASSERS = "WHERE missing_rate <= 1e-1"
VCOLS = ["missing_rate", "alt_freq", "maf"]


@query("qc1_variant_stats", f"""
WITH {VSTATS} SELECT var_id, n_total, n_valid, n_missing, round(missing_rate, 6) AS missing_rate,
       round(alt_freq, 6) AS alt_freq, round(maf, 6) AS maf FROM vm""")
def _(t):
    return round_columns(Q.variant_stats(t.geno), VCOLS)


@query("qc2_filter_variants", f"""
WITH {VSTATS} SELECT g.sample_id, g.var_id, g.dosage FROM geno g JOIN vj ON vj.var_id = g.var_id WHERE verdict = 'pass'""")
def _(t):
    return Q.filter_variants(t.geno).select("sample_id", "var_id", "dosage")


@query("qc2_variant_verdicts", f"""
WITH {VSTATS} SELECT var_id, round(missing_rate, 6) AS missing_rate, round(maf, 6) AS maf, verdict FROM vj""")
def _(t):
    return round_columns(Q.judge_variants(Q.variant_stats(t.geno)).select(
        "var_id", "missing_rate", "maf", "verdict"), ["missing_rate", "maf"])


@query("qc3_sample_stats", f"""
WITH {SSTATS} SELECT sample_id, n_total, n_valid, round(missing_rate, 6) AS missing_rate,
       round(het_rate, 6) AS het_rate FROM ss""")
def _(t):
    return round_columns(Q.sample_stats(Q.filter_variants(t.geno)), ["missing_rate", "het_rate"])


def _sample_query(key: str, dialect: str, k: float, where: str, clamp: bool):
    @query(key, f"WITH {judged(where, f'{k:e}', clamp)} SELECT sample_id, verdict FROM sj")
    def run(t):
        stats = Q.sample_stats(Q.filter_variants(t.geno))
        return Q.judge_samples(stats, k=k, dialect=dialect).select("sample_id", "verdict")


_sample_query("qc4_filter_samples", "passers_clamped", 3.0, PASSERS, True)
_sample_query("qc4_filter_samples_narrow", "passers_clamped", 1.5, PASSERS, True)
_sample_query("qc4_filter_samples_unclamped", "passers", 2.0, PASSERS, False)
_sample_query("qc4_filter_samples_all", "all", 1.5, "", False)


@query("qc5_sample_map", f"""
WITH {judged(PASSERS, '15e-1', True)}
SELECT sample_id, CASE WHEN verdict = 'pass' THEN 'kept' ELSE 'removed' END AS status,
       CASE verdict WHEN 'missing' THEN concat('missing rate ', printf('%.4f', missing_rate))
                    WHEN 'heterozygosity' THEN concat('heterozygosity ', printf('%.4f', het_rate)) ELSE '' END AS reasons,
       round(het_rate, 6) AS het_rate FROM sj""")
def _(t):
    stats = Q.judge_samples(Q.sample_stats(Q.filter_variants(t.geno)), k=1.5)
    return Q.sample_map(stats).select("sample_id", "status", F.array_join("failure_reasons", "; ").alias("reasons"),
                       rounded("het_rate").alias("het_rate"))


@query("qc6_qc_report", f"""
WITH {judged(PASSERS, '15e-1', True)},
v AS (SELECT count(*) AS a, count(*) FILTER (verdict = 'pass') AS b, count(*) FILTER (verdict = 'missing') AS c,
             count(*) FILTER (verdict = 'maf') AS d FROM vj),
s AS (SELECT count(*) AS a, count(*) FILTER (verdict = 'pass') AS b, count(*) FILTER (verdict = 'missing') AS c,
             count(*) FILTER (verdict = 'heterozygosity') AS d, sum(n_total) FILTER (verdict = 'pass') AS e,
             sum(n_total - n_valid) FILTER (verdict = 'pass') AS f FROM sj)
SELECT 'variants_total' AS metric, a * 1e0 AS value FROM v UNION ALL SELECT 'variants_passed', b FROM v
UNION ALL SELECT 'variants_failed_missing', c FROM v UNION ALL SELECT 'variants_failed_maf', d FROM v
UNION ALL SELECT 'samples_total', a FROM s UNION ALL SELECT 'samples_passed', b FROM s
UNION ALL SELECT 'samples_failed_missing', c FROM s UNION ALL SELECT 'samples_failed_heterozygosity', d FROM s
UNION ALL SELECT 'calls_total', e FROM s UNION ALL SELECT 'calls_imputed', f FROM s
UNION ALL SELECT 'imputation_rate', round(f * 1e0 / e, 6) FROM s
UNION ALL SELECT 'het_mean', round(het_mean, 6) FROM b UNION ALL SELECT 'het_sd', round(het_sd, 6) FROM b""")
def _(t):
    return Q.qc_report(t.geno, k=1.5).withColumn("value", rounded("value"))


HWE = """
h0 AS (SELECT var_id, count(*) FILTER (dosage = 0) AS n0, count(*) FILTER (dosage = 1) AS n1,
              count(*) FILTER (dosage = 2) AS n2, count(dosage) AS n FROM geno GROUP BY var_id),
h1 AS (SELECT *, (2*n0 + n1) * 1e0 / nullif(2*n, 0) AS p FROM h0),
h2 AS (SELECT *, n*p*p AS e0, 2*n*p*(1-p) AS e1, n*(1-p)*(1-p) AS e2 FROM h1),
h3 AS (SELECT *, CASE WHEN least(e0, e1, e2) >= 5
                 THEN (n0-e0)*(n0-e0)/e0 + (n1-e1)*(n1-e1)/e1 + (n2-e2)*(n2-e2)/e2 END AS chi2 FROM h2),
h AS (SELECT *, exp(-chi2/2) AS p_value, exp(-chi2/2) >= 5e-2 AS hwe_pass FROM h3)
"""


@query("qc7_hardy_weinberg", f"""
WITH {HWE} SELECT var_id, n0, n1, n2, round(chi2, 6) AS chi2, round(p_value, 6) AS p_value, hwe_pass FROM h""")
def _(t):
    return round_columns(Q.hardy_weinberg(t.geno).drop("e0", "e1", "e2"), ["chi2", "p_value"])


@query("qc7_hwe_summary", f"""
WITH {HWE} SELECT count(*) AS n_variants, count(p_value) AS n_tested, count(*) FILTER (hwe_pass) AS n_pass,
       round(count(*) FILTER (hwe_pass) * 1e0 / nullif(count(p_value), 0), 6) AS pass_share FROM h""")
def _(t):
    return round_columns(Q.hwe_summary(Q.hardy_weinberg(t.geno)), ["pass_share"])


@query("qc8_snp_columns", """
SELECT var_id FROM synth GROUP BY var_id HAVING count(*) = count(*) FILTER (dosage IN (0, 1, 2) OR dosage IS NULL)""")
def _(t):
    return Q.snp_columns(t.synth)


@query("qc9_hwe_prefilter", f"""
WITH {VSTATS}, {HWE}
SELECT vj.var_id, CASE WHEN verdict = 'pass' AND p_value < 1e-3 THEN 'hwe' ELSE verdict END AS verdict
FROM vj JOIN h USING (var_id)""")
def _(t):
    return Q.judge_variants(Q.variant_stats(t.geno), hwe=Q.hardy_weinberg(t.geno),
                            min_hwe_p=1e-3).select("var_id", "verdict")


@query("qc10_thin_variants", """
WITH r AS (SELECT *, row_number() OVER (ORDER BY chr, pos, var_id) - 1 AS r, count(*) OVER () AS n FROM variants)
SELECT var_id, chr, pos FROM r WHERE n <= 100 OR r % greatest(1, n // 50) = 0""")
def _(t):
    return Q.thin_variants(t.variants, limit=100, target=50).select("var_id", "chr", "pos")


@query("qc10_thin_variants_plus_one", """
WITH r AS (SELECT *, row_number() OVER (ORDER BY chr, pos, var_id) - 1 AS r, count(*) OVER () AS n FROM variants)
SELECT var_id FROM r WHERE n <= 100 OR r % (n // 50 + 1) = 0""")
def _(t):
    return Q.thin_variants(t.variants, limit=100, target=50, dialect="floor_plus_one").select("var_id")


@query("im1_mode_impute", """
WITH n AS (SELECT var_id, dosage, count(*) AS n FROM geno WHERE dosage IS NOT NULL GROUP BY 1, 2),
m AS (SELECT var_id, dosage AS mode FROM
      (SELECT *, row_number() OVER (PARTITION BY var_id ORDER BY n DESC, dosage) AS r FROM n) WHERE r = 1)
SELECT sample_id, var_id, coalesce(dosage, mode, 0) AS dosage FROM geno LEFT JOIN m USING (var_id)""")
def _(t):
    return I.impute_mode(t.geno)


@query("im2_mean_impute", """
WITH m AS (SELECT var_id, avg(dosage) AS a FROM geno GROUP BY 1)
SELECT s.sample_id, s.var_id, round(coalesce(s.dosage, a), 6) AS dosage FROM synth s LEFT JOIN m USING (var_id)""")
def _(t):
    return round_columns(I.impute_stat(t.synth.select("sample_id", "var_id", "dosage"), "mean", t.geno), ["dosage"])


@query("im2_median_impute", """
WITH m AS (SELECT var_id, quantile_cont(dosage, 0.5) AS a FROM geno GROUP BY 1)
SELECT sample_id, var_id, round(coalesce(dosage * 1e0, a), 6) AS dosage FROM geno LEFT JOIN m USING (var_id)""")
def _(t):
    return round_columns(I.impute_stat(t.geno, "median"), ["dosage"])


@query("im4_imputation_counts", """
SELECT count(*) AS n_calls, count(*) - count(dosage) AS n_imputed,
       round((count(*) - count(dosage)) * 1e0 / count(*), 6) AS imputation_rate FROM geno""")
def _(t):
    return round_columns(I.imputation_counts(t.geno), ["imputation_rate"])


@query("im5_zero_fill", """
SELECT s.sample_id, v.var_id, coalesce(g.dosage, 0) AS dosage
FROM (SELECT DISTINCT sample_id FROM synth) s CROSS JOIN (SELECT DISTINCT var_id FROM geno) v
LEFT JOIN synth g ON g.sample_id = s.sample_id AND g.var_id = v.var_id""")
def _(t):
    return I.align_to_variants(t.synth, variants=t.geno).withColumn("dosage", F.col("dosage").cast("double"))
