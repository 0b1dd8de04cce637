"""Synthetic cohorts."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortframe.catalog import query
from cohortframe.catalog.modelling import u
from cohortframe.functions.expr import one_row, round_columns, rounded
from cohortframe.operators import popgen as G
from cohortframe.operators import synth as S


def n01(*parts: str) -> str:
    """The hashed standard normal in checking SQL."""
    seed, *keys = parts
    return (f"(sqrt(-2 * ln({u(seed, chr(39) + 'r' + chr(39), *keys)})) * "
            f"cos(2 * pi() * {u(seed, chr(39) + 'a' + chr(39), *keys)}))")


# one synthetic sample per supplier
NEW = "ns AS (SELECT concat('SYNTH_', lpad(CAST(s_suppkey + 1 AS STRING), 9, '0')) AS sample_id, s_suppkey AS k FROM supplier)"
CTX = "nc AS (SELECT sample_id, substr('ABCDE', CAST(k % 5 AS INTEGER) + 1, 1) AS context FROM ns)"
VARS = "vv AS (SELECT DISTINCT var_id FROM geno)"
FREQ = """
fq AS (SELECT var_id, count(*) FILTER (dosage = 0) * 1e0 / count(dosage) AS p0, count(*) FILTER (dosage = 1) * 1e0 / count(dosage) AS p1,
  count(*) FILTER (dosage = 2) * 1e0 / count(dosage) AS p2 FROM geno GROUP BY 1)"""
MAFS = "mf AS (SELECT var_id, least(sum(dosage) * 1e0 / (2 * count(*)), 1 - sum(dosage) * 1e0 / (2 * count(*))) AS p FROM geno GROUP BY 1)"


def new_samples(t):
    return t.supplier.select(F.concat(F.lit("SYNTH_"), F.lpad((F.col("s_suppkey") + 1).cast("string"), 9, "0")).alias("sample_id"),
                             F.substring(F.lit("ABCDE"), (F.col("s_suppkey") % 5 + 1).cast("int"), F.lit(1)).alias("context"))


def mafs(t):
    return G.maf_all_rows(t.geno).select("var_id", F.col("maf").alias("p"))


@query("sy1_marginal_sampler", f"""
WITH {NEW}, {FREQ}, c AS (SELECT sample_id, fq.*, {u("'42'", "'marginal'", 'sample_id', 'var_id')} AS u FROM ns CROSS JOIN fq)
SELECT sample_id, var_id, CASE WHEN u < p0 THEN 0 WHEN u < p0 + p1 THEN 1 ELSE 2 END AS dosage FROM c""")
def _(t):
    return S.sample_marginal(new_samples(t), G.genotype_frequencies(t.geno))


HWE_CELLS = f"""
hc AS (SELECT sample_id, mf.*, {u("'42'", "'hwe'", 'sample_id', 'var_id')} AS u FROM ns CROSS JOIN mf),
hw AS (SELECT sample_id, var_id, CASE WHEN u < (1 - p) * (1 - p) THEN 0 WHEN u < (1 - p) * (1 - p) + 2 * p * (1 - p) THEN 1 ELSE 2 END AS dosage FROM hc)"""


@query("sy2_hwe_sampler", f"WITH {NEW}, {MAFS}, {HWE_CELLS} SELECT sample_id, var_id, dosage FROM hw")
def _(t):
    return S.sample_hwe(new_samples(t), mafs(t))


def ppf(p: str) -> str:
    """Inverse normal CDF in checking SQL: the rational approximation spelled out."""
    a = ["-39.69683028665376", "220.9460984245205", "-275.9285104469687", "138.3577518672690", "-30.66479806614716", "2.506628277459239"]
    b = ["-54.47609879822406", "161.5858368580409", "-155.6989798598866", "66.80131188771972", "-13.28068155288572", "1.0"]
    c = ["-0.007784894002430293", "-0.3223964580411365", "-2.400758277161838", "-2.549732539343734", "4.374664141464968", "2.938163982698783"]
    d = ["0.007784695709041462", "0.3224671290700398", "2.445134137142996", "3.754408661907416", "1.0"]

    def poly(cs, x):
        out = f"CAST({cs[0]} AS DOUBLE)"
        for k in cs[1:]:
            out = f"({out} * {x} + CAST({k} AS DOUBLE))"
        return out

    q = f"({p} - 5e-1)"
    r = f"({q} * {q})"
    tl = f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    return (f"CASE WHEN {p} < 2425e-5 THEN {poly(c, tl)} / {poly(d, tl)} WHEN {p} > 1 - 2425e-5 THEN -{poly(c, tl)} / {poly(d, tl)} "
            f"ELSE {poly(a, r)} * {q} / {poly(b, r)} END")


@query("sy3_ld_block_sampler", f"""
WITH {NEW}, {MAFS}, bl AS (SELECT var_id, substr(var_id, 1, 4) AS block_id, least(1 - 1e-6, greatest(1e-6, p)) AS p FROM mf),
t0 AS (SELECT *, 1 - p AS q FROM bl), t1 AS (SELECT *, {ppf('q')} AS t FROM t0),
z AS (SELECT sample_id, var_id, t, {n01("'42'", "'block'", 'sample_id', 'block_id')} AS z, {n01("'42'", "'a1'", 'sample_id', 'var_id')} AS e1,
  {n01("'42'", "'a2'", 'sample_id', 'var_id')} AS e2 FROM ns CROSS JOIN t1)
SELECT sample_id, var_id, CASE WHEN z + e1 * 5e-1 > t THEN 1 ELSE 0 END + CASE WHEN z + e2 * 5e-1 > t THEN 1 ELSE 0 END AS dosage FROM z""")
def _(t):
    blocks = mafs(t).withColumn("block_id", F.substring("var_id", 1, 4))
    return S.sample_ld_blocks(new_samples(t), blocks)


@query("sy4_maf_correction", f"""
WITH g AS (SELECT sample_id, var_id, dosage FROM geno_full), {MAFS},
c AS (SELECT var_id, 2 * count(*) AS al, sum(dosage) * 1e0 / (2 * count(*)) AS cur FROM g GROUP BY 1),
p AS (SELECT c.*, least(45e-2, mf.p + 6e-2) AS target FROM c JOIN mf USING (var_id)),
q AS (SELECT var_id, CAST(round_even(al * (CASE WHEN cur <= 5e-1 THEN target ELSE 1 - target END - cur), 0) AS BIGINT) AS d FROM p WHERE abs(least(cur, 1 - cur) - target) > 2e-2),
k AS (SELECT g.sample_id, g.var_id, d, row_number() OVER (PARTITION BY g.var_id ORDER BY {u("'42'", "'allele'", 'g.sample_id', 'g.var_id', 'k.k')}, g.sample_id, k.k) AS r
  FROM g JOIN q USING (var_id) CROSS JOIN (VALUES (1), (2)) AS k(k) WHERE CASE WHEN d > 0 THEN k.k > dosage ELSE k.k <= dosage END),
f AS (SELECT sample_id, var_id, sum(sign(d)) AS d FROM k WHERE r <= abs(d) GROUP BY 1, 2)
SELECT g.sample_id, g.var_id, CAST(g.dosage + coalesce(f.d, 0) AS INTEGER) AS dosage FROM g LEFT JOIN f USING (sample_id, var_id)""")
def _(t):
    targets = mafs(t).select("var_id", F.least(F.lit(0.45), F.col("p") + 0.06).alias("maf"))
    return S.correct_maf(t.geno_full, targets)


YSTAT = "ys AS (SELECT avg(y) AS m, stddev_samp(y) AS sd, min(y) AS lo, max(y) AS hi FROM pheno)"
RANGED = f"""
tg AS (SELECT sample_id, context, CASE context WHEN 'C' THEN m WHEN 'D' THEN lo + (hi - lo) * 25e-2 ELSE lo END AS a,
  CASE context WHEN 'B' THEN m WHEN 'D' THEN lo + (hi - lo) * 75e-2 WHEN 'E' THEN lo + (hi - lo) * 5e-1 ELSE hi END AS b FROM nc, ys),
ty AS (SELECT sample_id, context, a + {u("'42'", "'target'", 'sample_id')} * (b - a) AS y FROM tg)"""
CLS = """
yq AS (SELECT quantile_cont(y, 0.2) AS a, quantile_cont(y, 0.4) AS b, quantile_cont(y, 0.6) AS c, quantile_cont(y, 0.8) AS d FROM pheno),
yc AS (SELECT sample_id, CASE WHEN y >= d THEN 4 WHEN y >= c THEN 3 WHEN y >= b THEN 2 WHEN y >= a THEN 1 ELSE 0 END AS cls FROM pheno, yq WHERE y IS NOT NULL),
tc AS (SELECT ty.*, CASE WHEN y >= d THEN 4 WHEN y >= c THEN 3 WHEN y >= b THEN 2 WHEN y >= yq.a THEN 1 ELSE 0 END AS cls FROM ty, yq)"""


@query("sy5_class_targets", f"WITH {NEW}, {CTX}, {YSTAT}, {RANGED} SELECT sample_id, context, round(y, 6) AS y FROM ty")
def _(t):
    return round_columns(S.draw_targets(new_samples(t), t.pheno), ["y"])


@query("sy5_bootstrap_targets", f"""
WITH {NEW}, {CTX}, r AS (SELECT y, row_number() OVER (ORDER BY y, sample_id) AS r, count(*) OVER () AS n FROM pheno WHERE y IS NOT NULL)
SELECT sample_id, context, round(y, 6) AS y FROM nc JOIN r ON r.r = floor({u("'42'", "'target'", 'sample_id')} * r.n) + 1""")
def _(t):
    return round_columns(S.draw_targets(new_samples(t), t.pheno, bootstrap=True), ["y"])


@query("sy5_class_conditional_sampler", f"""
WITH {NEW}, {CTX}, {YSTAT}, {RANGED}, {CLS}, {FREQ},
k AS (SELECT var_id, cls, count(dosage) AS n, count(*) FILTER (dosage = 0) AS k0, count(*) FILTER (dosage = 1) AS k1 FROM geno JOIN yc USING (sample_id) GROUP BY 1, 2),
kf AS (SELECT fq.var_id, z.cls, CASE WHEN coalesce(n, 0) <= 3 THEN p0 ELSE k0 * 1e0 / n END AS p0, CASE WHEN coalesce(n, 0) <= 3 THEN p1 ELSE k1 * 1e0 / n END AS p1
  FROM fq CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS z(cls) LEFT JOIN k ON k.var_id = fq.var_id AND k.cls = z.cls),
c AS (SELECT tc.sample_id, kf.*, {u("'42'", "'class'", 'sample_id', 'var_id')} AS u FROM tc JOIN kf USING (cls))
SELECT sample_id, var_id, CASE WHEN u < p0 THEN 0 WHEN u < p0 + p1 THEN 1 ELSE 2 END AS dosage FROM c""")
def _(t):
    targets = S.draw_targets(new_samples(t), t.pheno)
    freqs = G.class_frequencies(t.geno, S.real_classes(t.pheno))
    return S.sample_by_class(targets, t.pheno, freqs, G.genotype_frequencies(t.geno))


CONTEXT_CELLS = f"""
cr AS (SELECT var_id, coalesce(covar_pop(dosage, y) / nullif(stddev_pop(dosage) * stddev_pop(y), 0), 0) AS r
       FROM geno JOIN pheno USING (sample_id) WHERE dosage IS NOT NULL AND y IS NOT NULL GROUP BY 1),
c0 AS (SELECT sample_id, context, var_id, p0, p1, CASE WHEN r < -1e-1 THEN 1e-1 ELSE 0e0 END AS b0, CASE WHEN r > 1e-1 THEN 1e-1 ELSE 0e0 END AS b2,
  -ln({u("'42'", "'dirichlet0'", 'sample_id', 'var_id')}) AS e0, -ln({u("'42'", "'dirichlet1'", 'sample_id', 'var_id')}) AS e1,
  -ln({u("'42'", "'dirichlet2'", 'sample_id', 'var_id')}) AS e2, {u("'42'", "'context'", 'sample_id', 'var_id')} AS u FROM nc CROSS JOIN fq JOIN cr USING (var_id)),
c1 AS (SELECT *, CASE context WHEN 'B' THEN (p0 + b0) / (1 + b0 + b2) WHEN 'E' THEN p0 * 8e-1 + e0 / (e0 + e1 + e2) * 2e-1 ELSE p0 END AS q0,
  CASE context WHEN 'B' THEN p1 / (1 + b0 + b2) WHEN 'E' THEN p1 * 8e-1 + e1 / (e0 + e1 + e2) * 2e-1 ELSE p1 END AS q1 FROM c0),
cc AS (SELECT sample_id, context, var_id, CASE WHEN u < q0 THEN 0 WHEN u < q0 + q1 THEN 1 ELSE 2 END AS dosage FROM c1)"""


def context_cells(t):
    return S.sample_contexts(new_samples(t), G.genotype_frequencies(t.geno), G.target_correlation(t.geno, t.pheno))


@query("sy6_context_sampler", f"WITH {NEW}, {CTX}, {FREQ}, {CONTEXT_CELLS} SELECT sample_id, context, var_id, dosage FROM cc")
def _(t):
    return context_cells(t)


@query("sy6_context_targets", f"""
WITH {NEW}, {CTX}, {FREQ}, {CONTEXT_CELLS}, {YSTAT}, g AS (SELECT sample_id, context, avg(dosage) AS g FROM cc GROUP BY 1, 2)
SELECT sample_id, context, round(m + sd * ((g - 1) * CASE context WHEN 'C' THEN 8e-1 ELSE 5e-1 END
  + CASE context WHEN 'C' THEN 2e-1 ELSE 3e-1 END * {n01("'42'", "'y'", 'sample_id')}
  + CASE context WHEN 'E' THEN 5e-1 * {n01("'42'", "'y2'", 'sample_id')} ELSE 0 END), 6) AS y FROM g, ys""")
def _(t):
    return round_columns(S.context_targets(context_cells(t), t.pheno), ["y"])


# the factor of a 3 x 3 correlation matrix written out; missing calls count as the variant's mean
@query("sy7_gaussian_sampler", f"""
WITH {NEW}, st AS (SELECT var_id, avg(dosage) AS m, stddev_samp(dosage) AS sd FROM geno GROUP BY 1),
nm AS (SELECT min(var_id) AS a, min(var_id) FILTER (var_id > (SELECT min(var_id) FROM st)) AS b,
  min(var_id) FILTER (var_id > (SELECT min(var_id) FROM st WHERE var_id > (SELECT min(var_id) FROM st))) AS c FROM st),
ce AS (SELECT sample_id, var_id, coalesce(dosage - avg(dosage) OVER (PARTITION BY var_id), 0) AS x FROM geno),
ss AS (SELECT var_id, sqrt(sum(x * x)) AS s FROM ce GROUP BY 1),
rr AS (SELECT l.var_id AS v1, r.var_id AS v2, sum(l.x * r.x) / (any_value(p.s) * any_value(q.s)) AS r FROM ce l JOIN ce r USING (sample_id)
  JOIN ss p ON p.var_id = l.var_id JOIN ss q ON q.var_id = r.var_id CROSS JOIN nm WHERE l.var_id IN (nm.a, nm.b) AND r.var_id IN (nm.b, nm.c) AND l.var_id < r.var_id GROUP BY 1, 2),
k AS (SELECT nm.*, coalesce((SELECT r FROM rr WHERE v1 = nm.a AND v2 = nm.b), 0) AS ab, coalesce((SELECT r FROM rr WHERE v1 = nm.a AND v2 = nm.c), 0) AS ac,
  coalesce((SELECT r FROM rr WHERE v1 = nm.b AND v2 = nm.c), 0) AS bc FROM nm),
ch AS (SELECT *, sqrt(1 - ab * ab) AS l22, (bc - ab * ac) / sqrt(1 - ab * ab) AS l32 FROM k),
z AS (SELECT sample_id, {n01("'42'", "'gauss'", 'sample_id', 'a')} AS za, {n01("'42'", "'gauss'", 'sample_id', 'b')} AS zb, {n01("'42'", "'gauss'", 'sample_id', 'c')} AS zc, ch.* FROM ns CROSS JOIN ch)
SELECT z.sample_id, st.var_id, round(m + sd * CASE WHEN var_id = a THEN za WHEN var_id = b THEN ab * za + l22 * zb
  WHEN var_id = c THEN ac * za + l32 * zb + sqrt(1 - ac * ac - l32 * l32) * zc ELSE {n01("'42'", "'gauss'", 'z.sample_id', 'st.var_id')} END, 6) AS dosage FROM z CROSS JOIN st""")
def _(t):
    return round_columns(S.sample_gaussian(new_samples(t), t.geno, head=3), ["dosage"])


def _factor(n: int) -> str:
    """CTEs from ``rr(i, j, r)``: one row with the lower Cholesky factor l<row>_<column> of n correlations, column by column; then long as ``wl(j, m, w)``."""
    pairs = [(i, j) for j in range(1, n + 1) for i in range(1, j)]
    out = ["f0 AS (SELECT " + ", ".join(f"coalesce(max(r) FILTER (i = {i} AND j = {j}), 0) AS c{i}_{j}" for i, j in pairs) + " FROM rr)"]
    for k in range(1, n + 1):
        inner = [f"sqrt(1 + 1e-9{''.join(f' - l{k}_{m} * l{k}_{m}' for m in range(1, k))}) AS l{k}_{k}"]
        inner += [f"(c{k}_{j}{''.join(f' - l{j}_{m} * l{k}_{m}' for m in range(1, k))}) / l{k}_{k} AS l{j}_{k}" for j in range(k + 1, n + 1)]
        out.append(f"f{k} AS (SELECT *, {', '.join(inner)} FROM f{k - 1})")
    cells = ", ".join(f"{{'j': {j}, 'm': {m}, 'w': l{j}_{m}}}" for j in range(1, n + 1) for m in range(1, j + 1))
    return ",\n".join([*out, f"wl AS (SELECT u.j AS j, u.m AS m, u.w AS w FROM (SELECT unnest([{cells}]) AS u FROM f{n}) z)"])


# the operator's own head
@query("sy7_gaussian_sampler_head", f"""
WITH {NEW}, st AS (SELECT var_id, avg(dosage) AS m, stddev_samp(dosage) AS sd FROM geno GROUP BY 1),
hd AS (SELECT * FROM (SELECT var_id, row_number() OVER (ORDER BY var_id) AS i FROM st) z WHERE i <= 12),
ce AS (SELECT sample_id, i, coalesce(dosage - avg(dosage) OVER (PARTITION BY i), 0) AS x FROM geno JOIN hd USING (var_id)),
ss AS (SELECT i, sqrt(sum(x * x)) AS s FROM ce GROUP BY 1),
rr AS (SELECT l.i AS i, r.i AS j, sum(l.x * r.x) / nullif(any_value(p.s) * any_value(q.s), 0) AS r FROM ce l JOIN ce r ON l.sample_id = r.sample_id AND l.i < r.i
  JOIN ss p ON p.i = l.i JOIN ss q ON q.i = r.i GROUP BY 1, 2),
{_factor(12)},
zz AS (SELECT sample_id, i, {n01("'42'", "'gauss'", 'sample_id', 'var_id')} AS z FROM ns CROSS JOIN hd),
mx AS (SELECT sample_id, j, sum(w * z) AS z FROM zz JOIN wl ON wl.m = zz.i GROUP BY 1, 2)
SELECT ns.sample_id, st.var_id, round(st.m + sd * coalesce(mx.z, {n01("'42'", "'gauss'", 'ns.sample_id', 'st.var_id')}), 6) AS dosage
FROM ns CROSS JOIN st LEFT JOIN hd ON hd.var_id = st.var_id LEFT JOIN mx ON mx.j = hd.i AND mx.sample_id = ns.sample_id""")
def _(t):
    return round_columns(S.sample_gaussian(new_samples(t), t.geno), ["dosage"])


@query("sy8_bootstrap_samples", f"""
WITH {NEW}, d AS (SELECT sample_id AS donor, row_number() OVER (ORDER BY sample_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT sample_id FROM geno) z),
k AS (SELECT ns.sample_id, d.donor FROM ns JOIN d ON d.r = floor({u("'42'", "'donor'", 'ns.sample_id')} * d.n) + 1)
SELECT k.sample_id, k.donor, g.var_id, g.dosage FROM k JOIN geno g ON g.sample_id = k.donor""")
def _(t):
    return S.bootstrap_samples(new_samples(t), t.geno, t.pheno)[0]


@query("sy8_bootstrap_targets", f"""
WITH {NEW}, {YSTAT} SELECT sample_id, round(least(hi, greatest(lo, m + sd * {n01("'42'", "'boot'", 'sample_id')})), 6) AS y FROM ns, ys""")
def _(t):
    return round_columns(S.bootstrap_samples(new_samples(t), t.geno, t.pheno)[1], ["y"])


@query("sy9_teacher_labels")
def _(t):
    rows = t.vectors.select("sample_id", "origin", array_to_vector(F.col("features").cast("array<double>")).alias("features"), "y")
    real = rows.where("origin = 'real'").drop("origin")
    return round_columns(S.teacher_labels(real, rows.where("origin <> 'real'").select("sample_id", "features")), ["y"])


PAIRS = f"""
ys AS (SELECT avg(y) AS m, stddev_samp(y) AS sd, min(y) AS lo, max(y) AS hi FROM pheno),
l0 AS (SELECT sample_id, y AS real_y, least(hi, greatest(lo, (y - m) * 8e-1 + m + {n01("'42'", "'eps'", 'sample_id')} * sd * sqrt(1 - 8e-1 * 8e-1))) AS y
       FROM pheno, ys WHERE y IS NOT NULL),
m0 AS (SELECT avg(y) AS am, stddev_samp(y) AS asd FROM l0),
l1 AS (SELECT sample_id, real_y, CASE WHEN abs(am - m) > 2e-2 THEN least(hi, greatest(lo, y - (am - m))) ELSE y END AS y FROM l0, m0, ys),
m1 AS (SELECT avg(y) AS bm, stddev_samp(y) AS bsd FROM l1),
l2 AS (SELECT sample_id, real_y, CASE WHEN abs(bsd - sd) > 1e-2 THEN least(hi, greatest(lo, bm + (y - bm) * (sd / bsd))) ELSE y END AS y FROM l1, m1, ys)"""


@query("sy10_correlated_labels", f"WITH {PAIRS} SELECT sample_id, round(real_y, 6) AS real_y, round(y, 6) AS y FROM l2")
def _(t):
    pairs = t.pheno.where("y IS NOT NULL").select("sample_id", F.col("y").alias("real_y"))
    return round_columns(S.correlated_labels(pairs, t.pheno), ["real_y", "y"])


def _targeted(least: str) -> str:
    return f"""
WITH ys AS (SELECT avg(y) AS m, stddev_samp(y) AS sd, min(y) AS lo, max(y) AS hi FROM pheno),
a AS (SELECT sample_id, y AS real_y, {n01("'42'", "'target'", 'sample_id')} AS e FROM pheno WHERE y IS NOT NULL),
g AS (SELECT sample_id, real_y, i, real_y + CASE WHEN i = 7 THEN 0e0 ELSE sd * sqrt(1e0 / 64e-2 - 1) * pow(7e-1, i - 1) END * e AS y
      FROM a, ys, (SELECT unnest(range(1, 8)) AS i) z),
k AS (SELECT i, avg(y) AS am, stddev_samp(y) AS asd FROM g GROUP BY i),
c AS (SELECT sample_id, real_y, g.i, least(hi, greatest(lo, m + (y - am) * (sd / asd))) AS y FROM g JOIN k ON g.i = k.i, ys),
j AS (SELECT i, corr(real_y, y) AS r, avg(y) AS bm, stddev_samp(y) AS bsd FROM c GROUP BY i),
w AS (SELECT coalesce(min(i) FILTER (r >= {least}), 7) AS i FROM j)
SELECT sample_id, round(real_y, 6) AS real_y, round(y, 6) AS y, CAST(c.i AS INT) AS attempt, round(r, 6) AS correlation,
       r >= {least} AND abs(bm - m) <= 2e-2 AND abs(bsd - sd) <= 1e-2 AS reached
FROM c JOIN w ON c.i = w.i JOIN j ON j.i = c.i, ys"""


def _targets(t, least: float):
    pairs = t.pheno.where("y IS NOT NULL").select("sample_id", F.col("y").alias("real_y"))
    return round_columns(S.targeted_labels(pairs, t.pheno, 0.8, least), ["real_y", "y", "correlation"])


@query("sy10_targeted_labels", _targeted("7e-1"))
def _(t):
    return _targets(t, 0.7)


# more than the first noise allows: shrunk until it does, or left out
@query("sy10_targeted_labels_shrunk", _targeted("9e-1"))
def _(t):
    return _targets(t, 0.9)


@query("sy10_noisy_labels", f"""
WITH ys AS (SELECT avg(y) AS m, stddev_samp(y) AS sd, min(y) AS lo, max(y) AS hi FROM pheno),
a AS (SELECT sample_id, y AS real_y, {n01("'42'", "'noise'", 'sample_id')} AS e FROM pheno WHERE y IS NOT NULL),
b AS (SELECT avg(real_y) AS am, stddev_samp(real_y) AS asd, avg(e) AS ae, covar_pop(real_y, e) / var_pop(real_y) AS k FROM a),
f AS (SELECT sample_id, real_y, (real_y - am) / asd AS z, e - ae - k * (real_y - am) AS free FROM a, b),
g AS (SELECT stddev_samp(free) AS s FROM f)
SELECT sample_id, round(real_y, 6) AS real_y, round(least(hi, greatest(lo, m + sd * (z * 8e-1 + free / s * sqrt(1 - 8e-1 * 8e-1)))), 6) AS y FROM f, g, ys""")
def _(t):
    pairs = t.pheno.where("y IS NOT NULL").select("sample_id", F.col("y").alias("real_y"))
    return round_columns(S.noisy_labels(pairs, t.pheno), ["real_y", "y"])


TOP = f"""
ro AS (SELECT source, concat('R', CAST(seq AS STRING)) AS sample_id, cv_r2 AS y FROM runs
       UNION ALL SELECT 'small', sample_id, y FROM pheno),
rk AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {u("'42'", "'topup'", 'source', 'sample_id')}, sample_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM ro),
tu AS (SELECT source, CASE WHEN c = 0 THEN sample_id ELSE concat(sample_id, '_', CAST(c AS STRING)) END AS sample_id, y, CAST(c AS BIGINT) AS copy FROM
       (SELECT *, unnest(generate_series(0, (250 - r) // n)) AS c FROM rk WHERE r <= 250) z)"""


def top_rows(t):
    many = t.runs.select("source", F.concat(F.lit("R"), F.col("seq").cast("string")).alias("sample_id"), F.col("cv_r2").alias("y"))
    return many.unionByName(t.pheno.select(F.lit("small").alias("source"), "sample_id", "y"))


@query("sy11_top_up", f"WITH {TOP} SELECT source, sample_id, round(y, 6) AS y, copy FROM tu")
def _(t):
    return round_columns(S.top_up(top_rows(t), 250), ["y"])


@query("sy11_count_plan", f"""
WITH {TOP} SELECT source, count(*) AS n_existing, greatest(0, 250 - count(*)) AS n_missing, CASE WHEN count(*) < 250 THEN 'generate' ELSE 'up to date' END AS status FROM ro GROUP BY 1""")
def _(t):
    return S.count_plan(top_rows(t), 250)


@query("sy11_check_counts", f"""
WITH {TOP} SELECT source, count(*) AS n, count(*) - count(y) AS n_null, count(*) FILTER (y < 0 OR y > 95e-2) AS n_out_of_range,
  count(*) = 250 AND count(y) = count(*) AND count(*) FILTER (y < 0 OR y > 95e-2) = 0 AS ok FROM tu GROUP BY 1""")
def _(t):
    return S.check_counts(S.top_up(top_rows(t), 250), 250, 0.0, 0.95)


@query("sy12_structural_violations", """
WITH x AS (SELECT CASE WHEN context = 'A' THEN concat(sample_id, '_x') ELSE sample_id END AS sample_id, var_id, dosage FROM synth),
y AS (SELECT CASE WHEN context = 'B' THEN concat(sample_id, '_y') ELSE sample_id END AS sample_id, CASE WHEN context = 'C' THEN 'n/a' ELSE CAST(y AS STRING) END AS y FROM synth_pheno),
i AS (SELECT DISTINCT sample_id FROM x)
SELECT 'no_target' AS kind, sample_id, CAST(1 AS BIGINT) AS n FROM i WHERE sample_id NOT IN (SELECT sample_id FROM y)
UNION ALL SELECT 'no_genotypes', sample_id, 1 FROM y WHERE sample_id NOT IN (SELECT sample_id FROM i)
UNION ALL SELECT 'invalid_calls', sample_id, count(*) FROM x WHERE dosage IS NULL OR dosage NOT IN (0, 1, 2) GROUP BY sample_id
UNION ALL SELECT 'target_not_numeric', sample_id, 1 FROM y WHERE try_cast(y AS DOUBLE) IS NULL""")
def _(t):
    def renamed(context, tail):     # ids that the other table does not have
        return F.when(F.col("context") == context, F.concat("sample_id", F.lit(tail))).otherwise(F.col("sample_id")).alias("sample_id")
    x = t.synth.select(renamed("A", "_x"), "var_id", "dosage")
    y = t.synth_pheno.select(renamed("B", "_y"), F.when(F.col("context") == "C", "n/a").otherwise(F.col("y").cast("string")).alias("y"))
    return S.structural_violations(x, y)


@query("sy12_set_report", """
WITH c AS (SELECT source, count(DISTINCT sample_id) AS n_samples, count(DISTINCT var_id) AS n_variants, count(*) FILTER (round_even(dosage, 0) <> dosage) = 0 AS integer_calls FROM synth GROUP BY 1)
SELECT c.*, y_min, y_max FROM c JOIN (SELECT source, round(min(y), 6) AS y_min, round(max(y), 6) AS y_max FROM synth_pheno GROUP BY 1) z USING (source)""")
def _(t):
    return round_columns(S.set_report(t.synth, t.synth_pheno), ["y_min", "y_max"])


LINES = """
l0 AS (SELECT run_id, unnest(string_split(regexp_replace(text, '[\"'']', '', 'g'), chr(10))) AS raw,
  generate_subscripts(string_split(regexp_replace(text, '[\"'']', '', 'g'), chr(10)), 1) - 1 AS pos FROM responses),
l1 AS (SELECT run_id, CAST(pos AS INTEGER) AS pos, trim(replace(replace(raw, '```csv', ''), '```', ''), ' ') AS line FROM l0),
l2 AS (SELECT *, length(line) - length(replace(line, ',', '')) + 1 AS nf FROM l1 WHERE line <> '' AND NOT contains(line, '...') AND NOT starts_with(line, 'Here')
  AND NOT starts_with(line, 'REFERENCE') AND NOT starts_with(line, 'Alright') AND NOT starts_with(line, '1.') AND NOT starts_with(line, '2.')),
l3 AS (SELECT * FROM l2 WHERE nf >= 3),
h AS (SELECT run_id, coalesce(min(pos) FILTER (line = 'Sample_ID,V1,V2,V3,y'), min(pos) FILTER (nf = 5)) AS h FROM l3 GROUP BY 1),
j AS (SELECT l3.*, h, CASE WHEN h IS NULL THEN 'no header' WHEN pos < h THEN 'before header' WHEN pos = h THEN 'header' WHEN nf > 5 THEN 'too many fields' END AS reason FROM l3 JOIN h USING (run_id)),
v AS (SELECT run_id, pos, string_split(line, ',') AS f FROM j WHERE reason IS NULL),
d AS (SELECT run_id, count(*) > count(DISTINCT trim(f[1])) AS dup FROM v GROUP BY 1)"""


def _call(i: int) -> str:
    return f"CAST(least(2, greatest(0, round_even(coalesce(try_cast(trim(f[{i}]) AS DOUBLE), 0), 0))) AS INTEGER)"


PARSED = f"""
WITH {LINES}, w AS (SELECT v.*, dup, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS i FROM v JOIN d USING (run_id))
SELECT run_id, pos, CASE WHEN dup THEN concat('SYNTH_', lpad(CAST(i AS STRING), 6, '0')) ELSE trim(f[1]) END AS sample_id,
  {_call(2)} AS V1, {_call(3)} AS V2, {_call(4)} AS V3, try_cast(trim(f[5]) AS DOUBLE) AS y FROM w"""


@query("sy13_parse_responses", PARSED)
def _(t):
    return S.parse_responses(t.responses, ["V1", "V2", "V3"])[0]


# the head of every answer, where a fixed number of rows is asked for
@query("sy13_first_rows", f"{PARSED} WHERE i <= 1")
def _(t):
    return S.parse_responses(t.responses, ["V1", "V2", "V3"], limit=1)[0]


@query("sy13_rejected_lines", f"WITH {LINES} SELECT run_id, pos, line, reason FROM j WHERE reason IS NOT NULL AND reason <> 'header'")
def _(t):
    return S.parse_responses(t.responses, ["V1", "V2", "V3"])[1]


@query("sy14_enforce_moments", """
WITH ys AS (SELECT avg(y) AS m, stddev_samp(y) AS sd, min(y) AS lo, max(y) AS hi FROM pheno),
a AS (SELECT sample_id, least(hi, greatest(lo, y)) AS y FROM synth_pheno, ys), s AS (SELECT avg(y) AS am, stddev_samp(y) AS asd FROM a)
SELECT sample_id, round(least(hi, greatest(lo, m + sd * (y - am) / asd)), 6) AS y FROM a, s, ys""")
def _(t):
    s = one_row(t.pheno.agg(F.avg("y").alias("m"), F.stddev_samp("y").alias("sd"), F.min("y").alias("lo"), F.max("y").alias("hi")))
    out = S.enforce_moments(t.synth_pheno, s.getField("m"), s.getField("sd"), s.getField("lo"), s.getField("hi"))
    return out.select("sample_id", rounded("y").alias("y"))


@query("sy15_scenario_sets", """
WITH a AS (SELECT sample_id, 'real' AS origin, 'real' AS source FROM pheno UNION ALL SELECT sample_id, 'synthetic', source FROM synth_pheno)
SELECT 'baseline' AS scenario, * FROM a WHERE origin = 'real' UNION ALL SELECT 'model_0', * FROM a WHERE source IN ('real', 'model_0')
UNION ALL SELECT 'model_1', * FROM a WHERE source IN ('real', 'model_1') UNION ALL SELECT 'model_2', * FROM a WHERE source IN ('real', 'model_2')
UNION ALL SELECT 'hybrid', * FROM a UNION ALL SELECT 'synthetic_only', * FROM a WHERE origin <> 'real'""")
def _(t):
    a = t.pheno.select("sample_id", F.lit("real").alias("origin"), F.lit("real").alias("source")).unionByName(
        t.synth_pheno.select("sample_id", F.lit("synthetic").alias("origin"), "source"))
    return S.scenario_sets(a, ["model_0", "model_1", "model_2"])
