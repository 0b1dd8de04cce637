"""Joins, set operations and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortframe.catalog import query
from cohortframe.functions.expr import round_columns
from cohortframe.operators import align as A
from cohortframe.operators import profile as P

FIRST = """first_y AS (SELECT sample_id, y FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY seq, y) AS r FROM pheno_rows) z WHERE r = 1)"""


@query("j1_align_samples", f"""
WITH {FIRST} SELECT f.sample_id, f.y, p.pc1, p.pc2 FROM first_y f JOIN pcs p USING (sample_id)
WHERE f.sample_id IN (SELECT sample_id FROM geno)""")
def _(t):
    return A.align_samples(t.geno, t.pheno_rows, t.pcs, order=("seq", "y"))


@query("j2_attach_target", """
SELECT g.sample_id, g.var_id, g.dosage, p.y FROM geno g LEFT JOIN pheno p USING (sample_id) WHERE p.y IS NOT NULL""")
def _(t):
    return A.attach_target(t.geno, t.pheno)


@query("j3_map_ids", """
SELECT m.sample_id, p.gbs_id, p.y1 FROM phenos_wide p JOIN id_map m USING (gbs_id)""")
def _(t):
    return A.map_ids(t.phenos_wide.select("gbs_id", "y1"), t.id_map, "gbs_id")


@query("j4_zip_by_position", """
WITH a AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) AS position FROM pheno),
b AS (SELECT gbs_id, row_number() OVER (ORDER BY gbs_id) AS position FROM phenos_wide)
SELECT position, sample_id, gbs_id FROM a JOIN b USING (position)""")
def _(t):
    return A.zip_by_position(t.pheno.select("sample_id"), t.phenos_wide.select("gbs_id"),
                             ["sample_id"], ["gbs_id"])


FUZZY = """SELECT concat(CASE WHEN s_suppkey%4 = 0 THEN '00000_' ELSE 'LIB_' END,
  lpad(CAST(s_suppkey*12 AS STRING), 9, '0'), '_batch', CAST(s_suppkey%3 AS STRING),
  CASE WHEN s_suppkey%5 = 0 THEN concat('_', lpad(CAST(s_suppkey*12 + 1 AS STRING), 9, '0')) ELSE '' END) AS sample_id
  FROM supplier"""


@query("j5_fuzzy_match", f"""
WITH f AS ({FUZZY}),
p AS (SELECT sample_id, unnest(string_split(sample_id, '_')) AS part,
             generate_subscripts(string_split(sample_id, '_'), 1) AS pos FROM f),
m AS (SELECT p.sample_id, p.part, p.pos, count(*) AS n, min(w.gbs_id) AS gbs_id
      FROM p JOIN phenos_wide w ON contains(w.gbs_id, p.part) WHERE length(p.part) > 4 GROUP BY 1, 2, 3)
SELECT sample_id, part, gbs_id FROM
  (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY pos) AS r FROM m WHERE n = 1) z WHERE r = 1""")
def _(t):
    return A.fuzzy_match(t.sql(FUZZY), t.phenos_wide, "gbs_id")


@query("j6_join_column", """
WITH u AS (SELECT 'name' AS col, 0 AS position, name AS v FROM phenos_wide UNION ALL
           SELECT 'segment', 1, segment FROM phenos_wide UNION ALL SELECT 'gbs_id', 2, gbs_id FROM phenos_wide UNION ALL
           SELECT 'y3', 3, y3 FROM phenos_wide),
c AS (SELECT col, position, count(DISTINCT v) FILTER (v IN (SELECT gbs_id FROM id_map)) AS n_common FROM u GROUP BY 1, 2)
SELECT *, position = (SELECT min(position) FROM c WHERE n_common > 0) AS chosen FROM c""")
def _(t):
    ids = t.id_map.select(F.col("gbs_id").alias("sample_id"))
    return A.discover_join_column(t.phenos_wide, ["name", "segment", "gbs_id", "y3"], ids)


KEYS = """
kv AS (SELECT DISTINCT t, tbl, col, lower(trim(v)) AS v FROM (
  SELECT 0 AS t, 'phenos' AS tbl, 'gbs_id' AS col, gbs_id AS v FROM phenos_wide
  UNION ALL SELECT 0, 'phenos', 'name', name FROM phenos_wide
  UNION ALL SELECT 1, 'map', 'gbs_id', gbs_id FROM id_map UNION ALL SELECT 1, 'map', 'sample_id', sample_id FROM id_map
  UNION ALL SELECT 2, 'pheno', 'sample_id', sample_id FROM pheno) z WHERE trim(v) <> ''),
ks AS (SELECT tbl, col, count(*) AS n FROM kv GROUP BY 1, 2),
kc AS (SELECT a.tbl AS table1, a.col AS column1, b.tbl AS table2, b.col AS column2, count(*) AS n_common
       FROM kv a JOIN kv b ON a.v = b.v AND a.t < b.t GROUP BY 1, 2, 3, 4),
kp AS (SELECT kc.*, n_common*1e0/s1.n AS coverage1, n_common*1e0/s2.n AS coverage2 FROM kc
       JOIN ks s1 ON s1.tbl = table1 AND s1.col = column1 JOIN ks s2 ON s2.tbl = table2 AND s2.col = column2)
"""


@query("j7_join_key_profile", f"""
WITH {KEYS} SELECT table1, column1, table2, column2, n_common, round(coverage1, 6) AS coverage1,
  round(coverage2, 6) AS coverage2, CAST(row_number() OVER (PARTITION BY table1, table2
  ORDER BY coverage1 + coverage2 DESC, column1, column2) AS INTEGER) AS rank FROM kp""")
def _(t):
    prof = A.profile_join_keys({"phenos": (t.phenos_wide, ["gbs_id", "name"]),
                                "map": (t.id_map, ["gbs_id", "sample_id"]),
                                "pheno": (t.pheno, ["sample_id"])})
    return round_columns(A.top_join_keys(prof).select(
        "table1", "column1", "table2", "column2", "n_common", "coverage1", "coverage2", "rank"),
        ["coverage1", "coverage2"])


@query("j8_detect_columns", """
WITH u AS (
  SELECT 'gbs_id' AS col, gbs_id AS v FROM phenos_wide UNION ALL SELECT 'name', name FROM phenos_wide
  UNION ALL SELECT 'segment', segment FROM phenos_wide
  UNION ALL SELECT 'y', CAST(y1 AS STRING) FROM phenos_wide UNION ALL SELECT 'y2', CAST(y2 AS STRING) FROM phenos_wide
  UNION ALL SELECT 'kidney', y3 FROM phenos_wide),
d AS (SELECT col, count(try_cast(v AS DOUBLE)) AS n_numeric, count(*) AS n_rows,
  CASE WHEN col IN ('gbs_id', 'name') THEN 'id' WHEN count(try_cast(v AS DOUBLE)) >= 5 THEN 'target' ELSE 'other' END AS role FROM u GROUP BY col)
SELECT *, round(n_numeric * 1e0 / n_rows, 6) AS numeric_ratio,
  CASE WHEN role = 'target' THEN CAST(row_number() OVER (PARTITION BY role ORDER BY n_numeric * 1e0 / n_rows DESC, col) AS INTEGER) END AS target_rank FROM d""")
def _(t):
    wide = t.phenos_wide.withColumnsRenamed({"y1": "y", "y3": "kidney"})      # short headers that id names contain
    return round_columns(A.detect_columns(wide), ["numeric_ratio"])


@query("j9_overlap_audit", """
WITH u AS (SELECT sample_id, 1 AS x, 0 AS y, 0 AS p FROM geno UNION ALL SELECT sample_id, 0, 1, 0 FROM pheno
           UNION ALL SELECT sample_id, 0, 0, 1 FROM pcs),
f AS (SELECT sample_id, max(x) AS x, max(y) AS y, max(p) AS p FROM u GROUP BY 1)
SELECT count(*) FILTER (x+y+p = 3) AS common, count(*) FILTER (x = 1) AS n_x, count(*) FILTER (y = 1) AS n_y,
  count(*) FILTER (p = 1) AS n_pca, count(*) FILTER (x = 1 AND x+y+p < 3) AS only_x, count(*) FILTER (y = 1 AND x+y+p < 3) AS only_y,
  count(*) FILTER (p = 1 AND x+y+p < 3) AS only_pca, count(*) FILTER (x+y+p < 3) AS not_in_all,
  round(count(*) FILTER (x+y+p = 3) * 1e0 / greatest(count(*) FILTER (x = 1), count(*) FILTER (y = 1), count(*) FILTER (p = 1)), 6) AS overlap
FROM f""")
def _(t):
    return round_columns(A.overlap_audit({"x": t.geno, "y": t.pheno, "pca": t.pcs}), ["overlap"])


@query("j9_mapped_overlap", """
WITH m AS (SELECT count(DISTINCT i.gbs_id) AS c FROM id_map i WHERE i.sample_id IN (SELECT sample_id FROM geno)
           AND i.gbs_id IN (SELECT gbs_id FROM phenos_wide))
SELECT c AS common, (SELECT count(DISTINCT sample_id) FROM geno) AS n_x, (SELECT count(DISTINCT gbs_id) FROM phenos_wide) AS n_y,
  true AS used_map, round(c * 1e0 / greatest((SELECT count(DISTINCT sample_id) FROM geno), (SELECT count(DISTINCT gbs_id) FROM phenos_wide)), 6) AS overlap
FROM m""")
def _(t):
    y = t.phenos_wide.select(F.col("gbs_id").alias("sample_id"))
    return round_columns(A.mapped_overlap(t.geno, y, t.id_map), ["overlap"])


@query("j10_shared_variants", """
SELECT DISTINCT var_id FROM geno WHERE var_id IN (SELECT var_id FROM synth)""")
def _(t):
    return A.shared_variants(t.geno, t.synth)


@query("j11_semi_anti", """
SELECT sample_id, var_id, CASE WHEN sample_id IN (SELECT sample_id FROM pcs) THEN 'in' ELSE 'out' END AS side FROM geno""")
def _(t):
    inside = A.keep_ids(t.geno, t.pcs).withColumn("side", F.lit("in"))
    return inside.unionByName(A.keep_ids(t.geno, t.pcs, inside=False).withColumn("side", F.lit("out"))) \
        .select("sample_id", "var_id", "side")


@query("so1_union_real_first", """
WITH o AS (SELECT DISTINCT sample_id, 'real' AS origin FROM geno UNION ALL SELECT DISTINCT sample_id, 'synthetic' FROM synth),
r AS (SELECT sample_id, var_id, dosage * 1e0 AS dosage FROM geno UNION ALL SELECT sample_id, var_id, dosage FROM synth)
SELECT o.sample_id, v.var_id, coalesce(r.dosage, 0) AS dosage, o.origin
FROM o CROSS JOIN (SELECT DISTINCT var_id FROM geno) v LEFT JOIN r ON r.sample_id = o.sample_id AND r.var_id = v.var_id""")
def _(t):
    # the second part repeats real ids: the real rows win
    again = t.geno_full.withColumn("dosage", F.col("dosage").cast("double"))
    out = A.union_real_first(t.geno.withColumn("dosage", F.col("dosage").cast("double")),
                             {"synthetic": t.synth, "again": again})
    return out.select("sample_id", "var_id", "dosage", "origin")


@query("so2_set_algebra", """
SELECT coalesce(a.var_id, b.var_id) AS var_id,
  CASE WHEN a.var_id IS NULL THEN 'right_only' WHEN b.var_id IS NULL THEN 'left_only' ELSE 'both' END AS side
FROM (SELECT DISTINCT var_id FROM geno) a FULL JOIN (SELECT DISTINCT var_id FROM synth) b ON a.var_id = b.var_id""")
def _(t):
    return A.set_algebra(t.geno, t.synth, "var_id")


@query("ag1_target_stats", """
WITH s AS (SELECT count(y) AS n, count(*) - count(y) AS n_null, avg(y) AS mean, stddev_pop(y) AS sd, min(y) AS min, max(y) AS max,
  quantile_cont(y, 0.25) AS q25, quantile_cont(y, 0.5) AS median, quantile_cont(y, 0.75) AS q75 FROM pheno),
k AS (SELECT avg(power((y - mean) / sd, 3)) AS g FROM pheno, s)
SELECT n, n_null, round(mean, 6) AS mean, round(sd, 6) AS sd, min, max, round(q25, 6) AS q25, round(median, 6) AS median,
  round(q75, 6) AS q75, round(g, 6) AS skew_biased, round(g * sqrt(n * (n - 1)) / (n - 2), 6) AS skew_adjusted FROM s, k""")
def _(t):
    return round_columns(P.target_stats(t.pheno, "y"),
                         ["mean", "sd", "q25", "median", "q75", "skew_biased", "skew_adjusted"])


@query("ag2_best_covered_target", """
SELECT trait, n FROM (SELECT 'y1' AS trait, count(y1) AS n, 0 AS i FROM phenos_wide UNION ALL
  SELECT 'y2', count(y2), 1 FROM phenos_wide UNION ALL SELECT 'y3', count(y3), 2 FROM phenos_wide) z ORDER BY n DESC, i LIMIT 1""")
def _(t):
    return P.best_covered_target(t.phenos_wide, ["y1", "y2", "y3"])


@query("ag7_snp_profile", """
WITH r AS (SELECT var_id, avg(dosage) AS m, var_samp(dosage) AS v, (count(*) - count(dosage)) * 1e0 / count(*) AS x FROM geno GROUP BY 1),
s AS (SELECT var_id, avg(dosage) AS m, var_samp(dosage) AS v, (count(*) - count(dosage)) * 1e0 / count(*) AS x FROM synth GROUP BY 1)
SELECT var_id, round(r.m, 6) AS mean_real, round(r.v, 6) AS var_real, round(r.x, 6) AS missing_real, round(s.m, 6) AS mean_synth,
  round(s.v, 6) AS var_synth, round(s.x, 6) AS missing_synth, round(abs(r.m - s.m), 6) AS abs_mean_diff
FROM r JOIN s USING (var_id) ORDER BY round(abs(r.m - s.m), 9) DESC, var_id LIMIT 10""")
def _(t):
    out = P.snp_profile(t.geno, t.synth)
    return round_columns(out, [c for c in out.columns if c != "var_id"])


DATASETS = """
dg AS (SELECT concat('nation_', CAST(s_nationkey AS STRING)) AS dataset, g.* FROM geno g
       JOIN supplier ON g.sample_id = concat('S', lpad(CAST(s_suppkey AS STRING), 9, '0')))
"""


def by_nation(t, df):
    owner = t.supplier.select(
        F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("sample_id"),
        F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string")).alias("dataset"))
    return df.join(owner, "sample_id")


@query("ag8_genotype_quality", f"""
WITH {DATASETS},
v AS (SELECT dataset, var_id, (count(*) - count(dosage)) * 1e0 / count(*) AS m, var_samp(dosage) AS v FROM dg GROUP BY 1, 2)
SELECT dataset, count(*) AS n_snps, round(avg(m), 6) AS missing_rate, count(*) FILTER (m < 2e-1 AND v > 1e-9) AS usable_snps,
  (SELECT count(DISTINCT sample_id) FROM dg WHERE dg.dataset = v.dataset) AS n_samples FROM v GROUP BY dataset""")
def _(t):
    return round_columns(P.genotype_quality(by_nation(t, t.geno)), ["missing_rate"])


@query("ag8_phenotype_quality", """
WITH p AS (SELECT segment AS dataset, y2 AS y, y3 FROM phenos_wide),
s AS (SELECT dataset, count(y) AS n, count(*) AS r, avg(y) AS m, stddev_pop(y) AS sd FROM p GROUP BY 1),
k AS (SELECT dataset, avg(power((y - m) / sd, 3)) AS g FROM p JOIN s USING (dataset) GROUP BY 1),
c AS (SELECT dataset, max(n) * 1e0 / sum(n) AS share FROM (SELECT dataset, y3, count(*) AS n FROM p WHERE y3 IS NOT NULL GROUP BY 1, 2) z GROUP BY 1)
SELECT dataset, round((r - n) * 1e0 / r, 6) AS phenotype_missing_rate, round(g * sqrt(n * (n - 1)) / (n - 2), 6) AS label_balance,
  round(share, 6) AS top_class_share FROM s JOIN k USING (dataset) JOIN c USING (dataset)""")
def _(t):
    p = t.phenos_wide.withColumnRenamed("segment", "dataset")
    num = P.phenotype_quality(p, "y2")
    cat = P.class_balance(p, "y3").withColumnRenamed("label_balance", "top_class_share")
    return round_columns(num.join(cat, "dataset"),
                         ["phenotype_missing_rate", "label_balance", "top_class_share"])


Q9 = """
SELECT c_mktsegment AS segment, concat(c_mktsegment, '_', CAST(c_nationkey AS STRING)) AS dataset,
  count(*) AS n_samples, count(*) * 2 AS usable_snps, avg(CASE WHEN c_custkey%10 = 0 THEN 1e0 ELSE 0e0 END) AS missing_rate,
  avg(CASE WHEN c_custkey%9 = 0 THEN 1e0 ELSE 0e0 END) AS phenotype_missing_rate, c_nationkey%3 <> 0 AS has_numeric_target,
  avg(CASE WHEN c_acctbal > 0 THEN 1e0 ELSE 0e0 END) AS overlap, avg(c_acctbal) * 3e-5 AS baseline_r2
FROM customer GROUP BY c_mktsegment, c_nationkey"""


def q9_sql(tail: str) -> str:
    return f"""
WITH q AS ({Q9}),
a AS (SELECT *, CASE WHEN n_samples >= 100 AND usable_snps >= 100 AND missing_rate < 1e-1 THEN 'High'
    WHEN n_samples >= 50 AND usable_snps >= 50 THEN 'Medium' ELSE 'Low' END AS genotype_quality,
  CASE WHEN has_numeric_target AND phenotype_missing_rate < 1e-1 THEN 'High' WHEN has_numeric_target THEN 'Medium' ELSE 'Low' END AS phenotype_quality FROM q),
b AS (SELECT *, CASE WHEN genotype_quality = 'High' AND phenotype_quality = 'High' AND overlap >= 8e-1 AND baseline_r2 >= 1e-1 THEN 'High'
    WHEN overlap >= 5e-1 AND baseline_r2 >= 5e-2 THEN 'Medium' ELSE 'Low' END AS augmentation_potential FROM a)
SELECT dataset, genotype_quality, phenotype_quality, augmentation_potential, round(baseline_r2, 6) AS baseline_r2 FROM b {tail}"""


@query("ag9_quality_buckets", q9_sql(""))
def _(t):
    out = P.quality_buckets(t.sql(Q9))
    return round_columns(out.select("dataset", "genotype_quality", "phenotype_quality",
                                    "augmentation_potential", "baseline_r2"), ["baseline_r2"])


@query("ag9_top_candidates", q9_sql("""ORDER BY CASE augmentation_potential WHEN 'High' THEN 2 WHEN 'Medium' THEN 1 ELSE 0 END DESC,
  b.baseline_r2 DESC, dataset LIMIT 3"""))
def _(t):
    out = P.top_candidates(P.quality_buckets(t.sql(Q9)))
    return round_columns(out.select("dataset", "genotype_quality", "phenotype_quality",
                                    "augmentation_potential", "baseline_r2"), ["baseline_r2"])


@query("ag10_context_summary", """
WITH y AS (SELECT source, context, y FROM synth_pheno UNION ALL SELECT 'REAL', 'REAL', y FROM pheno),
c AS (SELECT source, context, dosage FROM synth UNION ALL SELECT 'REAL', 'REAL', dosage FROM geno),
i AS (SELECT source, context, count(*) FILTER (dosage IS NULL OR dosage NOT IN (0, 1, 2)) AS n_invalid FROM c GROUP BY 1, 2)
SELECT source, context, count(*) AS n_samples, round(avg(y), 6) AS y_mean, round(stddev_samp(y), 6) AS y_sd, round(min(y), 6) AS y_min,
  round(max(y), 6) AS y_max, any_value(n_invalid) AS n_invalid, any_value(n_invalid) = 0 AS valid_calls
FROM y JOIN i USING (source, context) GROUP BY source, context""")
def _(t):
    return round_columns(P.context_summary(t.synth, t.synth_pheno, t.geno, t.pheno),
                         ["y_mean", "y_sd", "y_min", "y_max"])


@query("ag23_status", """
WITH f AS (SELECT DISTINCT concat('set_', p_brand, '_', CAST(p_size AS STRING)) AS dataset,
  CASE p_partkey%5 WHEN 0 THEN 'X' WHEN 1 THEN 'y' WHEN 2 THEN 'pca' WHEN 3 THEN 'manifest' ELSE 'notes' END AS file
  FROM part)
SELECT dataset, count(*) FILTER (file <> 'notes') AS n_present,
  CASE count(*) FILTER (file <> 'notes') WHEN 4 THEN 'Complete' WHEN 0 THEN 'Incomplete' ELSE 'Partial' END AS status
FROM f GROUP BY 1""")
def _(t):
    found = t.part.selectExpr(
        "concat('set_', p_brand, '_', CAST(p_size AS STRING)) AS dataset",
        "element_at(array('X', 'y', 'pca', 'manifest', 'notes'), CAST(p_partkey % 5 AS INT) + 1) AS file")
    return A.preprocessing_status(found, ["X", "y", "pca", "manifest"])


@query("ag23_duplicates", """
SELECT 'pheno_rows' AS tbl, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count(DISTINCT sample_id) AS BIGINT) AS n_duplicates FROM pheno_rows
UNION ALL SELECT 'pheno', count(*), count(*) - count(DISTINCT sample_id) FROM pheno""")
def _(t):
    return A.duplicate_ids({"pheno_rows": t.pheno_rows, "pheno": t.pheno})


@query("ag23_numeric_share", """
SELECT count(*) FILTER (n = 0) AS n_non_numeric, count(*) AS n_columns, round(count(*) FILTER (n = 0) * 1e0 / count(*), 6) AS non_numeric_ratio,
  count(*) FILTER (n = 0) * 1e0 / count(*) < 5e-2 AS ok
FROM (SELECT count(try_cast(segment AS DOUBLE)) AS n FROM phenos_wide UNION ALL SELECT count(y1) FROM phenos_wide
      UNION ALL SELECT count(y2) FROM phenos_wide UNION ALL SELECT count(try_cast(y3 AS DOUBLE)) FROM phenos_wide) z""")
def _(t):
    return round_columns(A.numeric_share(t.phenos_wide, ["segment", "y1", "y2", "y3"]), ["non_numeric_ratio"])


@query("ag24_usable_target", """
SELECT count(y) AS n, round(stddev_samp(y), 6) AS sd, CASE WHEN coalesce(stddev_samp(y), 0) < 1e-6 OR count(y) < 100 THEN 'reject' ELSE 'use' END AS verdict
FROM pheno""")
def _(t):
    return round_columns(P.usable_target(t.pheno, "y"), ["sd"])


@query("wn1_extremes", """
SELECT * FROM (SELECT sample_id, y, 'top' AS end, CAST(row_number() OVER (ORDER BY y DESC, sample_id) AS INTEGER) AS rank FROM pheno WHERE y IS NOT NULL
  UNION ALL SELECT sample_id, y, 'bottom', CAST(row_number() OVER (ORDER BY y, sample_id) AS INTEGER) FROM pheno WHERE y IS NOT NULL) z WHERE rank <= 5""")
def _(t):
    return P.extremes(t.pheno)


@query("wn1_top_variance", """
SELECT var_id, round(var_samp(dosage), 6) AS variance FROM geno GROUP BY 1 ORDER BY round(var_samp(dosage), 9) DESC, var_id LIMIT 120""")
def _(t):
    return round_columns(P.top_variance(t.geno), ["variance"])


@query("wn2_closest_to_median", """
WITH m AS (SELECT quantile_cont(y, 0.5) AS m FROM pheno)
SELECT sample_id, y, round(abs(y - m), 6) AS distance FROM pheno, m WHERE y IS NOT NULL ORDER BY round(abs(y - m), 9), sample_id LIMIT 10""")
def _(t):
    return round_columns(P.closest_to_median(t.pheno), ["distance"])


@query("wn3_head_median_tail", """
WITH r AS (SELECT sample_id, y, row_number() OVER (ORDER BY y DESC, sample_id) - 1 AS i, count(*) OVER () AS n FROM pheno WHERE y IS NOT NULL)
SELECT sample_id, y, CASE WHEN n < 20 THEN 'all' WHEN i < 7 THEN 'high' WHEN i >= n - 7 THEN 'low' ELSE 'median' END AS part FROM r
WHERE n < 20 OR i < 7 OR i >= n - 7 OR (i >= n // 2 - 3 AND i < n // 2 + 3)""")
def _(t):
    return P.head_median_tail(t.pheno)
