"""Scalar rules on calls, names and ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortframe.catalog import query
from cohortframe.functions import encoding as E
from cohortframe.functions.expr import round_columns, rounded
from cohortframe.operators import impute as I
from cohortframe.operators import profile as P

# every genotype notation the rules must read, one per cell of geno
GT_TEXT = """
SELECT sample_id, var_id,
       CASE WHEN dosage IS NULL THEN CASE WHEN sample_id < 'S000000050' THEN './.' ELSE '.' END
            WHEN dosage = 0 THEN '0/0'
            WHEN dosage = 1 THEN CASE WHEN var_id < 'V0030' THEN '0|1' WHEN var_id < 'V0060' THEN './1'
                                      WHEN var_id < 'V0090' THEN '1/2' ELSE '1/0' END
            ELSE CASE WHEN var_id < 'V0100' THEN '1|1' ELSE '1/1' END END AS gt
FROM geno
"""

IUPAC_TEXT = """
SELECT sample_id, var_id,
       CASE WHEN dosage IS NULL THEN CASE WHEN var_id < 'V0050' THEN 'N' WHEN var_id < 'V0100' THEN ' - ' ELSE '?' END
            WHEN dosage = 0 THEN CASE WHEN var_id < 'V0100' THEN 'A' ELSE 'AA' END
            WHEN dosage = 1 THEN CASE WHEN var_id < 'V0100' THEN 'ag' ELSE 'R' END
            ELSE CASE WHEN var_id < 'V0100' THEN 'GG' ELSE 'GGG' END END AS gt
FROM geno
"""

MIXED_TEXT = """
SELECT sample_id, var_id,
       CASE WHEN dosage IS NULL THEN CASE WHEN var_id < 'V0050' THEN 'NA' WHEN var_id < 'V0100' THEN '.' ELSE 'x/1' END
            WHEN dosage = 0 THEN CASE WHEN var_id < 'V0050' THEN '0' WHEN var_id < 'V0100' THEN 'g' ELSE '0/0' END
            WHEN dosage = 1 THEN CASE WHEN var_id < 'V0050' THEN '10' WHEN var_id < 'V0100' THEN '1.0' ELSE ' 0/1 ' END
            ELSE CASE WHEN var_id < 'V0050' THEN '11' WHEN var_id < 'V0100' THEN '2' ELSE '1/1' END END AS gt
FROM geno
"""


@query("sc1_gt_to_dosage_vcf", f"""
WITH g AS ({GT_TEXT})
SELECT sample_id, var_id, gt,
       CASE WHEN gt IN ('./.', '.|.', '.') THEN NULL
            ELSE CAST(length(gt) - length(replace(gt, '1', '')) AS INTEGER) END AS dosage FROM g""")
def _(t):
    return t.sql(GT_TEXT).withColumn("dosage", E.vcf_dosage("gt"))


@query("sc2_gt_to_dosage_iupac", f"""
WITH g AS ({IUPAC_TEXT}), u AS (SELECT *, upper(trim(gt)) AS c FROM g)
SELECT sample_id, var_id,
       CAST(CASE WHEN c IN ('N', '-', '?', '') THEN NULL WHEN c = 'A' THEN 0 WHEN length(c) = 1 THEN 1
            ELSE length(replace(c, 'A', '')) % 3 END AS INTEGER) AS dosage FROM u""")
def _(t):
    return t.sql(IUPAC_TEXT).select("sample_id", "var_id", E.iupac_dosage("gt").alias("dosage"))


@query("sc3_gt_to_dosage_generic", f"""
WITH g AS ({MIXED_TEXT}), u AS (SELECT sample_id, var_id, upper(trim(gt)) AS c FROM g)
SELECT sample_id, var_id,
       CASE WHEN try_cast(c AS DOUBLE) IS NOT NULL THEN try_cast(c AS DOUBLE)
            WHEN contains(c, '/') THEN
              CAST(try_cast(split_part(c, '/', 1) AS INTEGER) + try_cast(split_part(c, '/', 2) AS INTEGER) AS DOUBLE)
            WHEN c IN ('A', 'T', 'G', 'C') THEN CAST(0 AS DOUBLE) END AS dosage FROM u""")
def _(t):
    return t.sql(MIXED_TEXT).select("sample_id", "var_id", E.generic_dosage("gt").alias("dosage"))


@query("sc4_numeric_coercion", """
SELECT gbs_id, try_cast(y3 AS DOUBLE) AS y3, try_cast(segment AS DOUBLE) AS segment,
       try_cast(substr(name, 10) AS DOUBLE) AS digits FROM phenos_wide""")
def _(t):
    return t.phenos_wide.select(
        "gbs_id", E.try_double("y3").alias("y3"), E.try_double("segment").alias("segment"),
        E.try_double(F.substring("name", 10, 30)).alias("digits"))


@query("sc5_genotype_cleanup", """
SELECT sample_id, var_id,
       CAST(least(2, greatest(0, round_even(coalesce(dosage * 13e-1 - 4e-1, 0), 0))) AS INTEGER) AS dosage FROM synth""")
def _(t):
    return t.synth.select("sample_id", "var_id",
                          E.clean_dosage(F.col("dosage") * 1.3 - 0.4).alias("dosage"))


@query("sc6_valid_genotypes", """
SELECT sample_id, var_id, CAST(round_even(dosage, 0) AS INTEGER) AS dosage, source, context FROM synth
WHERE sample_id NOT IN (SELECT sample_id FROM synth
                        WHERE dosage IS NULL OR round_even(dosage, 0) NOT IN (0, 1, 2))""")
def _(t):
    return I.valid_samples(t.synth)


@query("sc7_repair_calls", """
WITH n AS (SELECT var_id, dosage, count(*) AS n FROM geno WHERE dosage IS NOT NULL GROUP BY 1, 2),
m AS (SELECT var_id, dosage AS mode FROM
      (SELECT *, row_number() OVER (PARTITION BY var_id ORDER BY n DESC, dosage) AS r FROM n) WHERE r = 1),
b AS (SELECT avg(y) - 2 * stddev_samp(y) AS lo, avg(y) + 2 * stddev_samp(y) AS hi FROM pheno)
SELECT s.sample_id, s.var_id, p.y,
       CAST(CASE WHEN s.dosage IN (0, 1, 2) THEN s.dosage ELSE m.mode END AS INTEGER) AS dosage
FROM synth s JOIN m USING (var_id) JOIN synth_pheno p ON p.sample_id = s.sample_id, b
WHERE p.y BETWEEN b.lo AND b.hi""")
def _(t):
    fixed = I.repair_calls(t.synth, t.geno)
    y = I.target_within_sd(t.synth_pheno, t.pheno).select("sample_id", "y")
    return fixed.join(y, "sample_id").select("sample_id", "var_id", "y", "dosage")


@query("sc8_nonfinite_to_median", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_returnflag,
                  CASE WHEN l_tax = 0 THEN NULL ELSE l_extendedprice END AS v FROM lineitem),
m AS (SELECT l_returnflag, quantile_cont(v, 0.5) AS med FROM x GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_returnflag, round(coalesce(v, med), 6) AS v FROM x JOIN m USING (l_returnflag)""")
def _(t):
    odd = (F.when(F.col("l_tax") == 0, F.when(F.col("l_linenumber") % 2 == 0, float("nan"))
                  .otherwise(float("inf"))).otherwise(F.col("l_extendedprice")))
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", odd.alias("v"))
    return I.fill_nonfinite(x, "v", "l_returnflag").withColumn("v", rounded("v"))


@query("sc9_metadata_rows", """
WITH l AS (SELECT *, CASE WHEN l_linenumber = 5 THEN 'pos' WHEN l_linenumber = 6 THEN 'CHROM'
                          ELSE l_shipmode_id END AS label
           FROM (SELECT l_orderkey, l_linenumber, concat('S', CAST(l_suppkey AS STRING)) AS l_shipmode_id FROM lineitem) z)
SELECT l_orderkey, l_linenumber, label FROM l WHERE upper(label) NOT IN ('POS', 'REF', 'ALT', 'CHR', 'CHROM')""")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.expr(
        "CASE WHEN l_linenumber = 5 THEN 'pos' WHEN l_linenumber = 6 THEN 'CHROM' "
        "ELSE concat('S', CAST(l_suppkey AS STRING)) END").alias("label"))
    return rows.where(~E.is_meta_label("label"))


@query("sc9_id_prefix", "SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def _(t):
    return t.customer.where(E.has_id_prefix("c_name", "Customer#00000001")).select("c_custkey", "c_name")


FIRST_ROW = """SELECT s_suppkey AS seq, 'a' AS col, CASE WHEN s_suppkey = (SELECT min(s_suppkey) FROM supplier) THEN 'REF' ELSE CAST(s_nationkey AS STRING) END AS v FROM supplier
UNION ALL SELECT s_suppkey, 'b', CAST(s_nationkey AS STRING) FROM supplier"""


@query("sc9_first_row", f"WITH c AS ({FIRST_ROW}) SELECT seq, col, v FROM c WHERE seq > (SELECT min(seq) FROM c)")
def _(t):
    return P.drop_metadata_first_row(t.sql(FIRST_ROW))


@query("sc9_first_row_kept", "SELECT s_suppkey AS seq, 'b' AS col, CAST(s_nationkey AS STRING) AS v FROM supplier")
def _(t):
    return P.drop_metadata_first_row(t.supplier.select(F.col("s_suppkey").alias("seq"), F.lit("b").alias("col"), F.col("s_nationkey").cast("string").alias("v")))


@query("sc10_numeric_columns", """
WITH u AS (
  SELECT 'name' AS col, name AS v FROM phenos_wide UNION ALL SELECT 'segment', segment FROM phenos_wide
  UNION ALL SELECT 'y1', CAST(y1 AS STRING) FROM phenos_wide UNION ALL SELECT 'y2', CAST(y2 AS STRING) FROM phenos_wide
  UNION ALL SELECT 'y3', y3 FROM phenos_wide)
SELECT col, count(v) AS n_present, count(*) FILTER (WHERE v IS NOT NULL AND try_cast(v AS DOUBLE) IS NULL) AS n_text,
       round(avg(CASE WHEN try_cast(v AS DOUBLE) IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_share,
       count(v) > 0 AND count(*) FILTER (WHERE v IS NOT NULL AND try_cast(v AS DOUBLE) IS NULL) = 0
         AND avg(CASE WHEN try_cast(v AS DOUBLE) IS NULL THEN 1.0 ELSE 0.0 END) <= 0.5 AS is_numeric
FROM u GROUP BY col""")
def _(t):
    from cohortframe.operators.profile import numeric_screen
    return round_columns(numeric_screen(t.phenos_wide, ["name", "segment", "y1", "y2", "y3"]),
                         ["null_share"])


@query("sc11_tercile_discretize", """
WITH x AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice AS v FROM lineitem),
q AS (SELECT l_suppkey, quantile_cont(v, 0.3333) AS a, quantile_cont(v, 0.6667) AS b FROM x GROUP BY 1)
SELECT l_orderkey, l_linenumber, CASE WHEN v > b THEN 2 WHEN v > a THEN 1 ELSE 0 END AS cls
FROM x JOIN q USING (l_suppkey)""")
def _(t):
    x = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return I.discretize(x, "l_extendedprice", [0.3333, 0.6667], ["l_suppkey"]) \
        .select("l_orderkey", "l_linenumber", "cls")


@query("sc12_quantile_class", """
WITH q AS (SELECT quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.5) AS b, quantile_cont(y, 0.75) AS c,
                  min(y) AS lo, max(y) AS hi FROM pheno)
SELECT sample_id,
       CASE WHEN y >= c THEN 3 WHEN y >= b THEN 2 WHEN y >= a THEN 1 WHEN y IS NOT NULL THEN 0 END AS cls,
       CASE WHEN y >= lo + 66e-2*(hi-lo) THEN 2 WHEN y >= lo + 33e-2*(hi-lo) THEN 1
            WHEN y IS NOT NULL THEN 0 END AS width_cls FROM pheno, q""")
def _(t):
    out = I.discretize(t.pheno, "y", [0.25, 0.5, 0.75], [], right_open=True)
    return I.equal_width_class(out, "y", (0.33, 0.66), "width_cls").select("sample_id", "cls", "width_cls")


@query("sc13_standardize", """
WITH s AS (SELECT var_id, avg(dosage) AS m, stddev_pop(dosage) AS sp, stddev_samp(dosage) AS ss FROM geno_full GROUP BY 1)
SELECT sample_id, var_id, round((dosage - m) / CASE WHEN sp > 0 THEN sp ELSE 1 END, 6) + 0.0 AS z,
       round((dosage - m) / CASE WHEN ss > 0 THEN ss ELSE 1 END, 6) + 0.0 AS z_sample
FROM geno_full JOIN s USING (var_id)""")
def _(t):
    return round_columns(I.standardize(t.geno_full, sd="both"), ["z", "z_sample"]).select("sample_id", "var_id", "z", "z_sample")


@query("sc14_model_names", """
SELECT seq,
  CASE WHEN lower(raw_model) IN ('random_forest', 'rf', 'randomforest') THEN 'randomforest'
       WHEN lower(raw_model) IN ('svm', 'svr') THEN 'svr' WHEN lower(raw_model) IN ('lgbm', 'lightgbm') THEN 'lightgbm'
       WHEN lower(raw_model) IN ('xgb', 'xgboost') THEN 'xgboost' ELSE lower(raw_model) END AS by_alias,
  CASE WHEN lower(raw_model) LIKE '%rf%' OR lower(raw_model) LIKE '%randomforest%' THEN 'randomforest'
       WHEN lower(raw_model) LIKE '%svr%' THEN 'svr'
       WHEN lower(raw_model) LIKE '%lightgbm%' OR lower(raw_model) LIKE '%lgbm%' THEN 'lightgbm'
       WHEN lower(raw_model) LIKE '%xgb%' THEN 'xgboost' WHEN lower(raw_model) LIKE '%elasticnet%' THEN 'elasticnet'
       WHEN lower(raw_model) LIKE '%lasso%' THEN 'lasso' WHEN lower(raw_model) LIKE '%ridge%' THEN 'ridge'
       ELSE lower(raw_model) END AS by_part,
  CASE WHEN context IS NULL OR context = 'baseline' THEN 'baseline'
       WHEN regexp_matches(context, '(context|prompt)_A') THEN 'context_A'
       WHEN regexp_matches(context, '(context|prompt)_B') THEN 'context_B'
       WHEN regexp_matches(context, '(context|prompt)_C') THEN 'context_C'
       WHEN regexp_matches(context, '(context|prompt)_D') THEN 'context_D'
       WHEN regexp_matches(context, '(context|prompt)_E') THEN 'context_E' ELSE context END AS context
FROM runs""")
def _(t):
    return t.runs.select("seq", E.model_name_by_alias("raw_model").alias("by_alias"),
                         E.model_name_by_part("raw_model").alias("by_part"),
                         E.context_name("context").alias("context"))


@query("sc15_name_metadata", """
SELECT seq, try_cast(regexp_extract(augment_file, '_k(\\d+)', 1) AS INTEGER) AS k,
       try_cast(regexp_extract(augment_file, '_f(\\d+)_s(\\d+)', 1) AS INTEGER) AS fallback,
       try_cast(regexp_extract(augment_file, '_f(\\d+)_s(\\d+)', 2) AS INTEGER) AS seed FROM runs""")
def _(t):
    return t.runs.select("seq", E.k_from_name("augment_file").alias("k"),
                         E.fallback_from_name("augment_file").alias("fallback"),
                         E.seed_from_name("augment_file").alias("seed"))


FRACTION_TEXT = """
SELECT seq, CASE WHEN seq%4 = 0 THEN concat(CAST(n_samples AS STRING), '%') WHEN seq%4 = 1 THEN concat(' 0.', CAST(k AS STRING))
                 WHEN seq%4 = 2 THEN concat(CAST(seq%90 AS STRING), '%') ELSE source END AS txt FROM runs"""


@query("sc16_parse_fraction", f"""
WITH f AS ({FRACTION_TEXT}),
n AS (SELECT seq, CASE WHEN trim(txt) LIKE '%\\%' ESCAPE '\\' THEN try_cast(rtrim(trim(txt), '%') AS DOUBLE) / 100
                       ELSE try_cast(trim(txt) AS DOUBLE) END AS x FROM f)
SELECT seq, round(CASE WHEN x IS NULL THEN NULL WHEN x > 1 THEN 1 WHEN x < 0 THEN 0 ELSE x END, 6) AS fraction FROM n""")
def _(t):
    return t.sql(FRACTION_TEXT).select("seq", rounded(E.parse_fraction("txt")).alias("fraction"))


@query("sc17_synthetic_ids", """
WITH ids AS (SELECT sample_id FROM pheno UNION ALL SELECT sample_id FROM synth_pheno)
SELECT sample_id, CASE WHEN sample_id LIKE 'SYNTHETIC\\_%' ESCAPE '\\' THEN sample_id
       ELSE concat('SYNTHETIC_', sample_id) END AS new_id,
       concat('SYNTH_', lpad(CAST(length(sample_id) AS STRING), 6, '0')) AS numbered FROM ids""")
def _(t):
    ids = t.pheno.select("sample_id").unionByName(t.synth_pheno.select("sample_id"))
    return ids.select("sample_id", E.synthetic_id("sample_id").alias("new_id"),
                      E.numbered_id("SYNTH_", F.length("sample_id")).alias("numbered"))


@query("sc18_delta_marker", """
SELECT seq, round(cv_r2 - holdout_r2, 6) + 0.0 AS delta,
       CASE WHEN holdout_r2 IS NULL THEN 'N/A' WHEN cv_r2 - holdout_r2 > 1e-2 THEN 'up'
            WHEN cv_r2 - holdout_r2 < -1e-2 THEN 'down' ELSE '' END AS r2_mark,
       CASE WHEN rmse - mae - 1 > 1e-2 THEN 'down' WHEN rmse - mae - 1 < -1e-2 THEN 'up' ELSE '' END AS err_mark
FROM runs""")
def _(t):
    return t.runs.select(
        "seq", rounded(F.col("cv_r2") - F.col("holdout_r2")).alias("delta"),
        E.delta_marker("cv_r2", "holdout_r2").alias("r2_mark"),
        E.delta_marker(F.col("rmse") - F.col("mae"), F.lit(1.0), higher_is_better=False).alias("err_mark"))


@query("sc19_strip_id_prefix", """
WITH i AS (SELECT concat(CASE WHEN s_nationkey%2 = 0 THEN 'SAMEA' ELSE 'X' END, CAST(s_suppkey AS STRING), '_',
                         s_name, '_b') AS id FROM supplier)
SELECT id, CASE WHEN id LIKE 'SAMEA%' THEN substr(id, strpos(id, '_') + 1) ELSE id END AS short_id FROM i""")
def _(t):
    ids = t.supplier.select(F.concat(
        F.when(F.col("s_nationkey") % 2 == 0, "SAMEA").otherwise("X"),
        F.col("s_suppkey").cast("string"), F.lit("_"), "s_name", F.lit("_b")).alias("id"))
    return ids.select("id", E.strip_id_prefix("id").alias("short_id"))
