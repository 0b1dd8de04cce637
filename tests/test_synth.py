import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortframe.operators import popgen, synth


def freqs(spark, table):
    return spark.createDataFrame([(v, *p) for v, p in table.items()], "var_id string, p0 double, p1 double, p2 double")


def test_marginal_frequencies_and_partition_independence(spark):
    ids = synth.numbered_samples(spark, 4000)
    f = freqs(spark, {"a": (0.2, 0.3, 0.5), "b": (1.0, 0.0, 0.0)})
    out = synth.sample_marginal(ids, f)
    got = {r.var_id: [r.p0, r.p1, r.p2] for r in popgen.genotype_frequencies(out).collect()}
    assert np.allclose(got["a"], [0.2, 0.3, 0.5], atol=0.03) and got["b"] == [1.0, 0.0, 0.0]
    again = synth.sample_marginal(ids.repartition(11), f)
    assert out.exceptAll(again).count() == 0


def test_ld_blocks_are_correlated_and_keep_maf(spark):
    blocks = spark.createDataFrame([("a", "x", 0.3), ("b", "x", 0.3), ("c", "z", 0.3)], "var_id string, block_id string, p double")
    out = synth.sample_ld_blocks(synth.numbered_samples(spark, 3000), blocks)
    r = {(x.var1, x.var2): x.r for x in popgen.pairwise_r2(out).collect()}
    assert r[("a", "b")] > 0.4 and abs(r[("a", "c")]) < 0.08
    assert out.where(~F.col("dosage").isin(0, 1, 2)).count() == 0


def test_maf_correction_steps(spark):
    g = spark.range(200).select(F.format_string("s%03d", "id").alias("sample_id"), F.lit("v").alias("var_id"),
                                (F.col("id") % 10 == 0).cast("int").alias("dosage"))
    for target in (0.2, 0.01, 0.5, 0.0):
        t = spark.createDataFrame([("v", target)], "var_id string, maf double")
        out = synth.correct_maf(g, t, tolerance=0.005)
        assert abs(popgen.maf_all_rows(out).first().maf - target) < 1e-9            # exact to the allele
        assert out.where(~F.col("dosage").isin(0, 1, 2)).count() == 0 and out.count() == 200
    near = spark.createDataFrame([("v", 0.06)], "var_id string, maf double")
    assert synth.correct_maf(g, near, tolerance=0.02).exceptAll(g).count() == 0


def test_gaussian_is_rejected(spark):
    from cohortframe.operators.impute import valid_samples
    rng = np.random.default_rng(0)
    real = spark.createDataFrame([(f"r{i}", f"v{j}", int(rng.integers(0, 3))) for i in range(30) for j in range(5)],
                                 "sample_id string, var_id string, dosage int")
    out = synth.sample_gaussian(synth.numbered_samples(spark, 50), real)
    assert out.count() == 250 and out.where(F.rint("dosage") != F.col("dosage")).count() > 200
    assert valid_samples(out).count() < 250


def test_gaussian_head_has_the_real_correlations(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 3, 400)
    cols = {f"v{j}": np.where(rng.random(400) < 0.25 * j, rng.integers(0, 3, 400), base) for j in range(4)}
    real = spark.createDataFrame([(f"r{i}", v, int(x[i])) for v, x in cols.items() for i in range(400)], "sample_id string, var_id string, dosage int")
    out = synth.sample_gaussian(synth.numbered_samples(spark, 4000), real, head=4).toPandas().pivot(index="sample_id", columns="var_id", values="dosage")
    assert np.allclose(np.corrcoef(out.to_numpy().T), np.corrcoef(np.array(list(cols.values()))), atol=0.06)
    one = synth.sample_gaussian(synth.numbered_samples(spark, 4000), real, head=1).toPandas().pivot(index="sample_id", columns="var_id", values="dosage")
    assert np.abs(np.corrcoef(one.to_numpy().T) - np.eye(4)).max() < 0.06


def test_registered_gaussian_head_equals_brute_force(spark):
    """The first twelve variants are the independent draws times the Cholesky factor of their correlations; missing calls count as the mean."""
    from cohortframe.catalog import QUERIES, load
    from cohortframe.catalog.synthetic import new_samples
    from cohortframe.fixtures import Tables
    load()
    t = Tables(spark, "/root/testdata/sf0.001")

    def wide(df):
        return df.toPandas().pivot(index="sample_id", columns="var_id", values="dosage").sort_index(axis=1).sort_index().astype(float)

    got, real = wide(QUERIES["sy7_gaussian_sampler_head"](t)), wide(t.geno)
    apart = ((wide(synth.sample_gaussian(new_samples(t), t.geno, head=1)) - real.mean()) / real.std()).fillna(0)     # a constant variant has no spread
    corr = np.nan_to_num(np.corrcoef(real.fillna(real.mean()).to_numpy()[:, :12].T))
    np.fill_diagonal(corr, 1)
    want = apart.copy()
    want.iloc[:, :12] = apart.to_numpy()[:, :12] @ np.linalg.cholesky(corr + 1e-9 * np.eye(12)).T
    assert got.shape[1] > 12 and np.allclose(got, real.mean() + real.std() * want, atol=2e-5)
    assert np.abs(np.tril(corr, -1)[3:]).max() > 0.01          # beyond a head of three


def test_class_without_calls_draws_from_the_marginal(spark):
    rows = [(f"s{i}", v, (0 if v == "a" else 2) if i >= 4 or v == "b" else None) for i in range(20) for v in "ab"]
    geno = spark.createDataFrame(rows, "sample_id string, var_id string, dosage int")
    y = spark.createDataFrame([(f"s{i}", float(i)) for i in range(20)], "sample_id string, y double")
    per = popgen.class_frequencies(geno, synth.real_classes(y))
    assert {(r.var_id, r.cls) for r in per.collect()} == {(v, c) for v in "ab" for c in range(5)}
    assert [(r.n, r.p0) for r in per.where("var_id = 'a' AND cls = 0").collect()] == [(0, 1.0)]
    few = per.where("cls <> 1")             # a class that has no row at all
    targets = spark.createDataFrame([(f"n{i}", float(i)) for i in range(20)], "sample_id string, y double")
    out = synth.sample_by_class(targets, y, few, popgen.genotype_frequencies(geno))
    assert out.count() == 40 and {(r.var_id, r.dosage) for r in out.collect()} == {("a", 0), ("b", 2)}


def test_noise_has_the_wanted_correlation(spark):
    rng = np.random.default_rng(6)
    real = spark.createDataFrame([(f"s{i}", float(v)) for i, v in enumerate(rng.normal(0, 1, 200))], "sample_id string, y double")
    wide = real.unionByName(spark.createDataFrame([("lo", -1e6), ("hi", 1e6)], "sample_id string, y double"))
    pairs = real.withColumnRenamed("y", "real_y")
    for r in (0.3, 0.9):
        p = synth.noisy_labels(pairs, wide, r).toPandas()
        assert abs(np.corrcoef(p.real_y, p.y)[0, 1] - r) < 1e-9
    flat = synth.noisy_labels(pairs.withColumn("real_y", F.lit(2.0)), real).toPandas()
    assert flat.y.notna().all()


def test_labels(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(10, 2, 500)
    real = spark.createDataFrame([(f"s{i}", float(v)) for i, v in enumerate(y)], "sample_id string, y double")
    pairs = real.withColumnRenamed("y", "real_y")
    for out in (synth.correlated_labels(pairs, real, 0.8), synth.noisy_labels(pairs, real, 0.8)):
        p = out.toPandas()
        assert abs(p.y.mean() - y.mean()) < 0.1 and abs(p.y.std() - y.std(ddof=1)) < 0.15
        assert np.corrcoef(p.real_y, p.y)[0, 1] >= 0.65
        assert p.y.min() >= y.min() - 1e-9 and p.y.max() <= y.max() + 1e-9


@pytest.mark.parametrize("least", [0.5, 0.9, 0.999, 1.1])
def test_targeted_labels_shrink_the_noise_as_far_as_needed(spark, least):
    rng = np.random.default_rng(11)
    y = rng.exponential(3.0, 400)
    real = spark.createDataFrame([(f"s{i}", float(v)) for i, v in enumerate(y)], "sample_id string, y double")
    p = synth.targeted_labels(real.withColumnRenamed("y", "real_y"), real, 0.6, least).toPandas()
    assert p.attempt.nunique() == p.correlation.nunique() == 1 and len(p) == 400
    r, attempt = p.correlation[0], p.attempt[0]
    assert abs(np.corrcoef(p.real_y, p.y)[0, 1] - r) < 1e-9
    assert p.y.min() >= y.min() - 1e-9 and p.y.max() <= y.max() + 1e-9
    if attempt < 7:
        assert r >= least
    else:                                        # no noise left: the values themselves
        assert np.allclose(p.y, p.real_y)
    assert bool(p.reached[0]) == (r >= least and abs(p.y.mean() - y.mean()) <= 0.02 and abs(p.y.std() - y.std(ddof=1)) <= 0.01)
    assert (attempt == 1) == (least == 0.5) and (attempt == 7) == (least > 0.99)


def test_targeted_labels_of_odd_tables(spark):
    real = spark.createDataFrame([(f"s{i}", 2.0) for i in range(5)], "sample_id string, y double")
    flat = synth.targeted_labels(real.withColumnRenamed("y", "real_y"), real).collect()
    assert len(flat) == 5 and all(r.y == 2.0 and not r.reached and r.attempt == 7 for r in flat)
    assert synth.targeted_labels(real.withColumnRenamed("y", "real_y").where("false"), real).collect() == []


def test_top_up_is_exact_under_skew(spark):
    rows = spark.range(1003).select(F.when(F.col("id") < 3, "small").otherwise("big").alias("source"),
                                    F.format_string("s%04d", "id").alias("sample_id"), F.col("id").cast("double").alias("y"))
    out = synth.top_up(rows, 200)
    assert {(r.source, r["count"]) for r in out.groupBy("source").count().collect()} == {("small", 200), ("big", 200)}
    assert out.select("sample_id").distinct().count() == 400
    exact = synth.top_up(rows.limit(200).withColumn("source", F.lit("x")), 200)
    assert exact.count() == 200 and exact.where("copy > 0").count() == 0


def test_scenarios(spark):
    s = spark.createDataFrame([("r", "real", "real"), ("a", "synthetic", "m0"), ("b", "synthetic", "m1")], "sample_id string, origin string, source string")
    got = {}
    for r in synth.scenario_sets(s, ["m0", "m1"]).collect():
        got.setdefault(r.scenario, set()).add(r.sample_id)
    assert got == {"baseline": {"r"}, "m0": {"r", "a"}, "m1": {"r", "b"}, "hybrid": {"r", "a", "b"}, "synthetic_only": {"a", "b"}}


def answers(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "run_id long, text string")


def test_parse_answers(spark):
    text = "Here are, some, rows, yes, ok\n```csv\nSample_ID,V1,V2,y\n\"a\",1,x,2.5\nb,3,0.4,1\n1. c,0,0,0\nd,0,1...\ne,0,1,2,3,4\nf,2,1\n```"
    rows, bad = synth.parse_responses(answers(spark, text), ["V1", "V2"])
    got = sorted((r.sample_id, r.V1, r.V2, r.y) for r in rows.collect())
    assert got == [("a", 1, 0, 2.5), ("b", 2, 0, 1.0), ("f", 2, 1, None)]
    assert [(r.line, r.reason) for r in bad.collect()] == [("e,0,1,2,3,4", "too many fields")]


def test_parse_repairs_header_renumbers_and_limits(spark):
    text = "id,m1,m2,t\nx,0,1,2\nx,1,1,3\ny,2,2,4"
    rows, _ = synth.parse_responses(answers(spark, text), ["V1", "V2"], limit=2)
    assert sorted((r.sample_id, r.V1, r.y) for r in rows.collect()) == [("SYNTH_000001", 0, 2.0), ("SYNTH_000002", 1, 3.0)]
    none, bad = synth.parse_responses(answers(spark, "a,b,c"), ["V1", "V2"])
    assert none.count() == 0 and bad.first().reason == "no header"


@pytest.mark.parametrize("target", [300, 1500])
def test_top_up_limits_groups_before_the_shuffle(spark, target):
    """Both ways of ranking choose the same rows; the small one keeps only a task's first rows of a source."""
    rows = spark.range(4000).select(F.when(F.col("id") % 40 == 0, "small").otherwise("big").alias("source"), F.format_string("s%04d", "id").alias("sample_id"))
    out = synth.top_up(rows, target)
    assert {(r.source, r["count"]) for r in out.groupBy("source").count().collect()} == {("small", target), ("big", target)}
    limited = "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert limited == (target <= synth.FEW)
    least = rows.where("source = 'big'").withColumn("u", synth.u01(42, F.lit("topup"), "source", "sample_id")).orderBy("u", "sample_id").limit(target)
    assert out.where("source = 'big'").select("sample_id").exceptAll(least.select("sample_id")).isEmpty()
