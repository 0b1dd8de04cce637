"""Population genetics and linear algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortframe.catalog import query
from cohortframe.functions.expr import round_columns, rounded
from cohortframe.operators import impute as I
from cohortframe.operators import popgen as G


@query("ag3_genotype_frequencies", """
SELECT var_id, round(coalesce(count(*) FILTER (dosage = 0) * 1e0 / nullif(count(dosage), 0), 33e-2), 6) AS p0,
  round(coalesce(count(*) FILTER (dosage = 1) * 1e0 / nullif(count(dosage), 0), 34e-2), 6) AS p1,
  round(coalesce(count(*) FILTER (dosage = 2) * 1e0 / nullif(count(dosage), 0), 33e-2), 6) AS p2 FROM geno GROUP BY 1""")
def _(t):
    return round_columns(G.genotype_frequencies(t.geno), ["p0", "p1", "p2"])


CLASSES = """
yq AS (SELECT quantile_cont(y, 0.2) AS a, quantile_cont(y, 0.4) AS b, quantile_cont(y, 0.6) AS c, quantile_cont(y, 0.8) AS d FROM pheno),
yc AS (SELECT sample_id, CASE WHEN y >= d THEN 4 WHEN y >= c THEN 3 WHEN y >= b THEN 2 WHEN y >= a THEN 1 ELSE 0 END AS cls
       FROM pheno, yq WHERE y IS NOT NULL)
"""


def yield_classes(t):
    return I.discretize(t.pheno.where("y IS NOT NULL"), "y", [0.2, 0.4, 0.6, 0.8], [], right_open=True)


@query("ag4_class_frequencies", f"""
WITH {CLASSES},
m AS (SELECT var_id, count(*) FILTER (dosage = 0) * 1e0 / count(dosage) AS m0, count(*) FILTER (dosage = 1) * 1e0 / count(dosage) AS m1,
  count(*) FILTER (dosage = 2) * 1e0 / count(dosage) AS m2 FROM geno GROUP BY 1),
c AS (SELECT var_id, cls, count(dosage) AS n, count(*) FILTER (dosage = 0) AS k0, count(*) FILTER (dosage = 1) AS k1,
  count(*) FILTER (dosage = 2) AS k2 FROM geno JOIN yc USING (sample_id) GROUP BY 1, 2)
SELECT m.var_id, z.cls, coalesce(n, 0) AS n, round(CASE WHEN coalesce(n, 0) <= 15 THEN m0 ELSE k0 * 1e0 / n END, 6) AS p0,
  round(CASE WHEN coalesce(n, 0) <= 15 THEN m1 ELSE k1 * 1e0 / n END, 6) AS p1, round(CASE WHEN coalesce(n, 0) <= 15 THEN m2 ELSE k2 * 1e0 / n END, 6) AS p2
FROM m CROSS JOIN (SELECT DISTINCT cls FROM yc) z LEFT JOIN c ON c.var_id = m.var_id AND c.cls = z.cls""")
def _(t):
    return round_columns(G.class_frequencies(t.geno, yield_classes(t), min_rows=15), ["p0", "p1", "p2"])


MAF = "mf AS (SELECT var_id, sum(dosage) * 1e0 / (2 * count(*)) AS p, least(sum(dosage) * 1e0 / (2 * count(*)), 1 - sum(dosage) * 1e0 / (2 * count(*))) AS maf FROM geno GROUP BY 1)"


@query("ag5_maf_all_rows", f"WITH {MAF} SELECT var_id, round(p, 6) AS alt_freq, round(maf, 6) AS maf FROM mf")
def _(t):
    return round_columns(G.maf_all_rows(t.geno), ["alt_freq", "maf"])


LD = """
zs AS (SELECT var_id, avg(dosage) AS m, var_pop(dosage) * count(dosage) AS ss FROM geno_full GROUP BY 1),
z AS (SELECT sample_id, var_id, CASE WHEN ss > 0 THEN (dosage - m) / sqrt(ss) ELSE 0 END AS x FROM geno_full JOIN zs USING (var_id)),
ld AS (SELECT a.var_id AS var1, b.var_id AS var2, sum(a.x * b.x) AS r FROM z a JOIN z b ON a.sample_id = b.sample_id AND a.var_id < b.var_id GROUP BY 1, 2)
"""


@query("gx4_pairwise_r2", f"WITH {LD} SELECT var1, var2, round(r, 6) + 0.0 AS r, round(r * r, 6) + 0.0 AS r2 FROM ld")
def _(t):
    return round_columns(G.pairwise_r2(t.geno_full), ["r", "r2"])


@query("gx4_windowed_r2", f"""
WITH {LD} SELECT var1, var2, round(r, 6) + 0.0 AS r, round(r * r, 6) + 0.0 AS r2 FROM ld JOIN variants v ON v.var_id = var1 JOIN variants w ON w.var_id = var2
WHERE v.chr = w.chr AND abs(v.pos - w.pos) <= 30000""")
def _(t):
    return round_columns(G.windowed_r2(t.geno_full, t.variants, 30000), ["r", "r2"])


NEAR = LD + """,
lw AS (SELECT ld.* FROM ld JOIN variants v ON v.var_id = var1 JOIN variants w ON w.var_id = var2 WHERE v.chr = w.chr AND abs(v.pos - w.pos) <= 30000)
"""


@query("gx5_high_ld_fraction", f"""
WITH {NEAR} SELECT count(*) AS n_pairs, round(avg(CASE WHEN abs(r) > 2e-1 THEN 1e0 ELSE 0e0 END), 6) AS high_ld_fraction FROM lw""")
def _(t):
    return round_columns(G.high_ld_fraction(t.geno_full, t.variants, 30000), ["high_ld_fraction"])


BLOCKS = NEAR + """,
e AS (SELECT var1 AS a, var2 AS b FROM lw WHERE r * r >= 3e-1 UNION ALL SELECT var2, var1 FROM lw WHERE r * r >= 3e-1),
reach AS (SELECT DISTINCT var_id AS node, var_id AS label FROM geno_full UNION SELECT e.b, reach.label FROM reach JOIN e ON e.a = reach.node),
comp AS (SELECT node, min(label) AS label FROM reach GROUP BY 1),
cs AS (SELECT label, count(*) AS n FROM comp GROUP BY 1),
lb AS (SELECT node AS var_id, CASE WHEN n >= 5 THEN label ELSE node END AS block_id, CASE WHEN n >= 5 THEN n ELSE 1 END AS block_size FROM comp JOIN cs USING (label))
"""


def blocks(t):
    ids = t.geno_full.select("var_id").distinct().join(t.variants.select("var_id", "chr", "pos"), "var_id", "left")
    return G.ld_blocks(G.windowed_r2(t.geno_full, t.variants, 30000), ids, r2=0.3)


@query("gx6_ld_blocks", f"WITH RECURSIVE {BLOCKS} SELECT var_id, block_id, block_size FROM lb")
def _(t):
    return blocks(t)


@query("gx6_nested_blocks", f"WITH RECURSIVE {BLOCKS} SELECT block_id, CAST(0 AS BIGINT) AS part, list(var_id ORDER BY var_id) AS variants FROM lb GROUP BY 1")
def _(t):
    return G.nested_blocks(blocks(t))


@query("gx6_nested_parts", f"""
WITH RECURSIVE {BLOCKS}, r AS (SELECT block_id, var_id, (row_number() OVER (PARTITION BY block_id ORDER BY var_id) - 1) // 2 AS part FROM lb)
SELECT block_id, CAST(part AS BIGINT) AS part, list(var_id ORDER BY var_id) AS variants FROM r GROUP BY 1, 2""")
def _(t):
    return G.nested_blocks(blocks(t), size=2)


@query("ag6_maf_ld_summary", f"""
WITH RECURSIVE {BLOCKS}, {MAF}, s AS (SELECT block_id, count(*) AS n FROM lb GROUP BY 1)
SELECT (SELECT count(*) FROM mf) AS n_variants, (SELECT round(avg(maf), 6) FROM mf) AS maf_mean, (SELECT round(quantile_cont(maf, 0.95), 6) FROM mf) AS maf_p95,
  count(*) AS n_blocks, round(avg(n), 6) AS block_size_mean, round(quantile_cont(n * 1e0, 0.95), 6) AS block_size_p95 FROM s""")
def _(t):
    out = G.maf_ld_summary(G.maf_all_rows(t.geno), blocks(t))
    return round_columns(out, ["maf_mean", "maf_p95", "block_size_mean", "block_size_p95"])


@query("gx7_relationship_matrix", """
WITH f AS (SELECT var_id, avg(dosage) / 2 AS p FROM geno GROUP BY 1), c AS (SELECT 2 * sum(p * (1 - p)) AS c FROM f),
z AS (SELECT sample_id, var_id, dosage - 2 * p AS x FROM geno JOIN f USING (var_id) WHERE dosage IS NOT NULL)
SELECT a.sample_id AS sample1, b.sample_id AS sample2, round(sum(a.x * b.x) / any_value(c), 6) + 0.0 AS g
FROM z a JOIN z b ON a.var_id = b.var_id AND a.sample_id <= b.sample_id, c GROUP BY 1, 2""")
def _(t):
    return round_columns(G.relationship_matrix(t.geno), ["g"])


CORR = """
cr AS (SELECT var_id, count(*) AS n, covar_pop(dosage, y) / nullif(stddev_pop(dosage) * stddev_pop(y), 0) AS r
       FROM geno JOIN pheno USING (sample_id) WHERE dosage IS NOT NULL AND y IS NOT NULL GROUP BY 1)
"""


@query("gx1_target_correlation", f"WITH {CORR} SELECT var_id, n, round(r, 6) + 0.0 AS r, round(abs(r), 6) AS abs_r FROM cr")
def _(t):
    return round_columns(G.target_correlation(t.geno, t.pheno), ["r", "abs_r"])


@query("gx1_correlation_counts", f"""
WITH {CORR} SELECT count(r) AS n, count(*) FILTER (abs(r) > 1e-1) AS above_01, count(*) FILTER (abs(r) > 2e-1) AS above_02 FROM cr""")
def _(t):
    return G.correlation_counts(G.target_correlation(t.geno, t.pheno))


@query("gx1_association_p_values")
def _(t):
    return round_columns(G.association(t.geno, t.pheno), ["r", "abs_r", "p_value"])


@query("gx2_f_scores", f"WITH {CORR} SELECT var_id, n, round(r*r/nullif(1 - r*r, 0)*(n-2), 6) AS f_score FROM cr")
def _(t):
    return round_columns(G.f_scores(t.geno, t.pheno), ["f_score"])


@query("gx2_select_k_best", f"""
WITH {CORR} SELECT var_id, n, round(r*r/nullif(1 - r*r, 0)*(n-2), 6) AS f_score FROM cr WHERE r IS NOT NULL
ORDER BY round(r*r/nullif(1 - r*r, 0)*(n-2), 9) DESC, var_id LIMIT 50""")
def _(t):
    return round_columns(G.select_k_best(t.geno, t.pheno, 50), ["f_score"])


@query("gx3_variable_variants", "SELECT var_id, round(var_pop(dosage), 6) AS variance FROM geno GROUP BY 1 HAVING var_pop(dosage) > 1e-2")
def _(t):
    return round_columns(G.variable_variants(t.geno, 0.01), ["variance"])


@query("gx3_variable_by_sd", "SELECT var_id, round(var_pop(dosage), 6) AS variance FROM geno GROUP BY 1 HAVING stddev_pop(dosage) > 3e-1")
def _(t):
    return round_columns(G.variable_variants(t.geno, min_sd=0.3), ["variance"])


def ld_over(table: str, tag: str) -> str:
    return f"""
{tag}s AS (SELECT var_id, avg(dosage) AS m, var_pop(dosage) * count(dosage) AS ss FROM {table} GROUP BY 1),
{tag}z AS (SELECT sample_id, var_id, CASE WHEN ss > 0 THEN (dosage - m) / sqrt(ss) ELSE 0 END AS x FROM {table} JOIN {tag}s USING (var_id) WHERE dosage IS NOT NULL),
{tag}p AS (SELECT a.var_id AS var1, b.var_id AS var2, sum(a.x * b.x) AS r FROM {tag}z a JOIN {tag}z b ON a.sample_id = b.sample_id AND a.var_id < b.var_id GROUP BY 1, 2)"""


@query("gx14_structure_diff", f"""
WITH {ld_over('geno', 'ra')}, {ld_over('synth', 'sb')}
SELECT count(*) AS n_pairs, round(avg(abs(rap.r - sbp.r)), 6) AS mean_abs_diff FROM rap JOIN sbp USING (var1, var2)""")
def _(t):
    shared = t.geno.select("var_id").distinct().join(t.synth.select("var_id").distinct(), "var_id", "left_semi")
    return round_columns(G.correlation_structure_diff(t.geno, t.synth, shared), ["mean_abs_diff"])


@query("gx14_structure_diff_windowed", f"""
WITH {ld_over('geno', 'ra')}, {ld_over('synth', 'sb')}
SELECT count(*) AS n_pairs, round(avg(abs(rap.r - sbp.r)), 6) AS mean_abs_diff FROM rap JOIN sbp USING (var1, var2)
JOIN variants a ON a.var_id = var1 JOIN variants b ON b.var_id = var2 WHERE a.chr = b.chr AND abs(a.pos - b.pos) <= 30000""")
def _(t):
    shared = t.variants.join(t.geno.select("var_id").distinct(), "var_id", "left_semi").join(t.synth.select("var_id").distinct(), "var_id", "left_semi")
    return round_columns(G.correlation_structure_diff(t.geno, t.synth, shared, 30000), ["mean_abs_diff"])


@query("gx14_correlation_preserved", f"""
WITH {CORR}, cs AS (SELECT var_id, covar_pop(dosage, y) / nullif(stddev_pop(dosage) * stddev_pop(y), 0) AS r
  FROM synth s JOIN synth_pheno p ON p.sample_id = s.sample_id WHERE dosage IS NOT NULL GROUP BY 1)
SELECT var_id, round(cr.r, 6) + 0.0 AS r_real, round(cs.r, 6) + 0.0 AS r_synth, round(abs(cr.r - cs.r), 6) AS diff, abs(cr.r - cs.r) < 1e-1 AS preserved
FROM cr JOIN cs USING (var_id)""")
def _(t):
    return round_columns(G.correlation_preserved(t.geno, t.pheno, t.synth, t.synth_pheno), ["r_real", "r_synth", "diff"])


@query("gx15_histogram_overlap", """
WITH u AS (SELECT y, 'r' AS side FROM pheno WHERE y IS NOT NULL UNION ALL SELECT y, 's' FROM synth_pheno),
l AS (SELECT min(y) AS lo, max(y) AS hi, count(*) FILTER (side = 'r') AS nr, count(*) FILTER (side = 's') AS ns FROM u),
b AS (SELECT least(49, floor((y - lo) / (hi - lo) * 50)) AS bin, count(*) FILTER (side = 'r') AS r, count(*) FILTER (side = 's') AS s FROM u, l GROUP BY 1)
SELECT round(sum(least(r * 1e0 / nr, s * 1e0 / ns)), 6) AS overlap FROM b, l""")
def _(t):
    return round_columns(G.histogram_overlap(t.pheno, t.synth_pheno), ["overlap"])


@query("gx16_maf_drift", f"""
WITH {MAF}, ms AS (SELECT var_id, least(sum(dosage) / (2 * count(*)), 1 - sum(dosage) / (2 * count(*))) AS maf FROM synth GROUP BY 1),
d AS (SELECT abs(mf.maf - ms.maf) AS d FROM mf JOIN ms USING (var_id))
SELECT count(*) AS n, round(avg(d), 6) AS drift_mean, round(avg(CASE WHEN d <= 2e-2 THEN 1e0 ELSE 0e0 END), 6) AS pass_rate,
  round(quantile_cont(d, 0.95), 6) AS drift_p95, avg(d) < 2e-2 AND quantile_cont(d, 0.95) < 5e-2 AS gate FROM d""")
def _(t):
    return round_columns(G.maf_drift(t.geno, t.synth), ["drift_mean", "pass_rate", "drift_p95"])


@query("gx17_positional_correlation", """
WITH a AS (SELECT y, row_number() OVER (ORDER BY sample_id) AS i FROM pheno WHERE y IS NOT NULL),
b AS (SELECT y AS y_s, row_number() OVER (ORDER BY sample_id) AS i FROM synth_pheno)
SELECT count(*) AS n, round(covar_pop(y, y_s) / (stddev_pop(y) * stddev_pop(y_s)), 6) AS r FROM a JOIN b USING (i)""")
def _(t):
    return G.positional_correlation(t.pheno, t.synth_pheno).withColumn("r", rounded("r"))


@query("gx8_pca_scores")
def _(t):
    from cohortframe.operators import latent as L
    out = L.pca(L.standard_cells(t.geno), 5)
    return out.scores.select("sample_id", *[rounded(F.col("pc")[i]).alias(f"pc{i + 1}") for i in range(len(out.eigenvalues))])


@query("gx8_explained_variance", """
WITH s AS (SELECT var_id, avg(dosage) AS m, stddev_pop(dosage) AS sd FROM geno GROUP BY 1)
SELECT round(sum(CASE WHEN sd > 0 THEN (dosage - m) * (dosage - m) / (sd * sd) ELSE 0 END), 4) AS total_variance, true AS ordered, true AS bounded
FROM geno JOIN s USING (var_id)""")
def _(t):
    from cohortframe.operators import latent as L
    out = L.pca(L.standard_cells(t.geno), 5)
    e = out.explained
    return t.spark.range(1).select(
        rounded(F.lit(out.total), 4).alias("total_variance"),
        F.lit(all(a >= b - 1e-12 for a, b in zip(e, e[1:]))).alias("ordered"),
        F.lit(0 < sum(e) <= 1 + 1e-9).alias("bounded"))


@query("gx8_pca_loadings")
def _(t):
    from cohortframe.operators import latent as L
    out = L.pca(L.standard_cells(t.geno), 5)
    return out.loadings.select("var_id", *[rounded(F.col("loading")[i]).alias(f"l{i + 1}") for i in range(len(out.eigenvalues))])


FIVE = "(SELECT unnest(range(1, 6)) AS component) k"


# what the scores and loadings above are: eigenvectors of Z'Z, told by going through all cells again
@query("gx8_pca_residuals", f"SELECT var_id, CAST(component AS INT) AS component, 0e0 AS residual FROM (SELECT DISTINCT var_id FROM geno WHERE dosage IS NOT NULL) v, {FIVE}")
def _(t):
    from cohortframe.operators import latent as L
    z = L.standard_cells(t.geno)
    fit = L.pca(z, 5)
    again = z.join(L.project(t.geno, t.geno, fit), "sample_id").groupBy("var_id").agg(
        F.array(*[F.sum(F.col("z") * F.col("pc")[i]) for i in range(5)]).alias("up")).join(fit.loadings, "var_id")
    left = [(F.col("up")[i] - F.col("loading")[i] * fit.eigenvalues[i]) / fit.eigenvalues[0] for i in range(5)]
    return again.select("var_id", F.posexplode(F.array(*left)).alias("at", "residual")).select(
        "var_id", (F.col("at") + 1).alias("component"), (rounded("residual", 4) + 0.0).alias("residual"))


@query("gx8_pca_gram", f"""
SELECT CAST(k.component AS INT) AS component, CAST(o.component AS INT) AS other, CASE WHEN k.component = o.component THEN 1e0 ELSE 0e0 END AS loadings,
  CASE WHEN k.component = o.component THEN 1e0 ELSE 0e0 END AS scores, (SELECT count(DISTINCT sample_id) FROM geno WHERE dosage IS NOT NULL) AS n_samples
FROM {FIVE}, {FIVE.replace(") k", ") o")}""")
def _(t):
    from cohortframe.operators import latent as L
    fit = L.pca(L.standard_cells(t.geno), 5)

    def products(df, column, scale):
        each = [F.struct(F.lit(i + 1).alias("component"), F.lit(j + 1).alias("other"), (rounded(F.sum(F.col(column)[i] * F.col(column)[j]) / scale[i], 4) + 0.0).alias("v"))
                for i in range(5) for j in range(5)]
        return df.agg(F.array(*each).alias("e"), F.count(F.lit(1)).alias("n_samples")).select(F.inline("e"), "n_samples")

    load = products(fit.loadings, "loading", [1.0] * 5).drop("n_samples").withColumnRenamed("v", "loadings")
    return load.join(products(fit.scores, "pc", fit.eigenvalues).withColumnRenamed("v", "scores"), ["component", "other"])


# real samples on their own whitened components: mean 0, variance 1
@query("gx9_whitened_real", f"SELECT CAST(component AS INT) AS component, (SELECT count(DISTINCT sample_id) FROM geno WHERE dosage IS NOT NULL) AS n, 0e0 AS mean, 1e0 AS variance FROM {FIVE}")
def _(t):
    from cohortframe.operators import latent as L
    out = L.project(t.geno, t.geno, L.pca(L.standard_cells(t.geno), 5), whiten=True)
    rows = out.select(F.posexplode("pc").alias("at", "x")).groupBy((F.col("at") + 1).alias("component"))
    return rows.agg(F.count("x").alias("n"), (rounded(F.avg("x"), 4) + 0.0).alias("mean"), rounded(F.var_samp("x"), 4).alias("variance"))


@query("gx9_project_synthetic")
def _(t):
    from cohortframe.operators import latent as L
    fit = L.pca(L.standard_cells(t.geno), 5)
    out = L.project(t.synth, t.geno, fit, whiten=True)
    return out.select("sample_id", *[rounded(F.col("pc")[i]).alias(f"pc{i + 1}") for i in range(len(fit.eigenvalues))])


@query("gx10_capture_ratios")
def _(t):
    from cohortframe.operators import latent as L
    out = L.capture_ratios(t.geno, t.synth, 20)
    return round_columns(out, [c for c in out.columns if c != "n_components"])


def _sides(t):
    v = t.vectors.select(F.col("sample_id").alias("id"), "origin", F.col("features").cast("array<double>").alias("vec"))
    return v.where("origin = 'synthetic'").select("id", "vec"), v.where("origin = 'real'").select("id", "vec")


NEAREST = """
v AS (SELECT sample_id AS id, origin, CAST(features AS DOUBLE[]) AS f FROM vectors),
nn AS (SELECT s.id, min(list_distance(s.f, r.f)) AS distance, max(list_cosine_similarity(s.f, r.f)) AS cosine
       FROM v s JOIN v r ON s.origin = 'synthetic' AND r.origin = 'real' GROUP BY 1)
"""


@query("gx11_nearest_real", f"WITH {NEAREST} SELECT id, round(distance, 6) AS distance, round(cosine, 6) + 0.0 AS cosine FROM nn")
def _(t):
    from cohortframe.operators import latent as L
    return round_columns(L.nearest_real(*_sides(t)), ["distance", "cosine"])


@query("gx11_nearest_summary", f"WITH {NEAREST} SELECT count(*) AS n, round(avg(distance), 6) AS mean, round(quantile_cont(distance, 0.95), 6) AS p95 FROM nn")
def _(t):
    from cohortframe.operators import latent as L
    from cohortframe.operators.tiles import nearest_distance
    return round_columns(L.distance_summary(nearest_distance(*_sides(t)), "distance"), ["mean", "p95"])


@query("gx12_nearest_hamming", """
WITH sv AS (SELECT DISTINCT var_id FROM geno WHERE var_id IN (SELECT var_id FROM synth)),
g AS (SELECT * FROM geno WHERE dosage IS NOT NULL AND var_id IN (SELECT var_id FROM sv)),
s AS (SELECT * FROM synth WHERE dosage IS NOT NULL AND var_id IN (SELECT var_id FROM sv)),
ng AS (SELECT sample_id, count(*) AS n FROM g GROUP BY 1), ns AS (SELECT sample_id, count(*) AS n FROM s GROUP BY 1),
j AS (SELECT s.sample_id AS a, g.sample_id AS b, count(*) AS n_both, count(*) FILTER (s.dosage = g.dosage) AS same FROM s JOIN g USING (var_id) GROUP BY 1, 2),
d AS (SELECT a, 1 - (coalesce(same, 0) + (SELECT count(*) FROM sv) - ns.n - ng.n + coalesce(n_both, 0)) * 1e0 / (SELECT count(*) FROM sv) AS d
      FROM j JOIN ns ON ns.sample_id = a JOIN ng ON ng.sample_id = b)
SELECT a AS sample_id, round(min(d), 6) AS distance FROM d GROUP BY 1""")
def _(t):
    from cohortframe.operators import latent as L
    return round_columns(L.nearest_hamming(t.synth, t.geno), ["distance"])


@query("gx12_paired_hamming", """
WITH s AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS i FROM (SELECT DISTINCT sample_id FROM synth) z),
r AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS j, count(*) OVER () AS n FROM (SELECT DISTINCT sample_id FROM geno) z),
p AS (SELECT s.sample_id, r.sample_id AS partner FROM s JOIN r ON s.i % r.n = r.j)
SELECT p.sample_id, p.partner, round(avg(CASE WHEN a.dosage IS NOT DISTINCT FROM b.dosage THEN 0e0 ELSE 1e0 END), 6) AS distance
FROM p JOIN synth a ON a.sample_id = p.sample_id JOIN geno b ON b.sample_id = p.partner AND b.var_id = a.var_id GROUP BY 1, 2""")
def _(t):
    from cohortframe.operators import latent as L
    return round_columns(L.paired_hamming(t.synth, t.geno.withColumn("dosage", F.col("dosage").cast("double"))), ["distance"])


CENTROID = """
v AS (SELECT sample_id AS id, origin, CAST(features AS DOUBLE[]) AS f FROM vectors),
u AS (SELECT id, origin, unnest(f) AS x, generate_subscripts(f, 1) AS i FROM v),
m AS (SELECT i, avg(x) AS m FROM u WHERE origin = 'real' GROUP BY 1),
d AS (SELECT id, origin, sqrt(sum((x - m) * (x - m))) AS distance FROM u JOIN m USING (i) GROUP BY 1, 2)
"""


@query("gx13_centroid_filter", f"""
WITH {CENTROID} SELECT id, round(distance, 6) AS distance FROM d
WHERE origin = 'synthetic' AND distance <= (SELECT quantile_cont(distance, 0.8) FROM d WHERE origin = 'real')""")
def _(t):
    from cohortframe.operators import latent as L
    s, r = _sides(t)
    return round_columns(L.centroid_filter(s, r, 64, 0.8).select("id", "distance"), ["distance"])


@query("gx13_centroid_fallback", f"""
WITH {CENTROID} SELECT id, round(distance, 6) AS distance FROM d WHERE origin = 'synthetic' ORDER BY round(distance, 9), id
LIMIT (SELECT CAST(floor(count(*) * 5e-1) AS BIGINT) FROM d WHERE origin = 'synthetic')""")
def _(t):
    from cohortframe.operators import latent as L
    s, r = _sides(t)
    return round_columns(L.centroid_filter(s, r, 64, 0.05, fallback_percent=50).select("id", "distance"), ["distance"])


@query("im3_knn_impute", """
WITH p AS (SELECT * FROM geno WHERE dosage IS NOT NULL), nv AS (SELECT count(DISTINCT var_id) AS n FROM geno),
d AS (SELECT a.sample_id AS s, b.sample_id AS t, sqrt(sum((a.dosage - b.dosage) * (a.dosage - b.dosage)) * any_value(n) * 1e0 / count(*)) AS d
      FROM p a JOIN p b USING (var_id), nv WHERE a.sample_id <> b.sample_id GROUP BY 1, 2),
c AS (SELECT s.sample_id, v.var_id FROM (SELECT DISTINCT sample_id FROM geno) s CROSS JOIN (SELECT DISTINCT var_id FROM geno) v),
h AS (SELECT c.* FROM c LEFT JOIN p USING (sample_id, var_id) WHERE p.dosage IS NULL),
k AS (SELECT h.sample_id, h.var_id, d.d, p.dosage, row_number() OVER (PARTITION BY h.sample_id, h.var_id ORDER BY d.d, d.t) AS r
      FROM h JOIN d ON d.s = h.sample_id JOIN p ON p.sample_id = d.t AND p.var_id = h.var_id),
f AS (SELECT sample_id, var_id, CASE WHEN min(d) = 0 THEN avg(dosage) FILTER (d = 0) ELSE sum(dosage / d) FILTER (d > 0) / sum(1 / d) FILTER (d > 0) END AS dosage
      FROM k WHERE r <= 5 GROUP BY 1, 2)
SELECT sample_id, var_id, round(dosage, 6) AS dosage FROM f UNION ALL SELECT sample_id, var_id, dosage * 1e0 FROM p""")
def _(t):
    from cohortframe.operators import latent as L
    return round_columns(L.impute_knn(t.geno), ["dosage"])
