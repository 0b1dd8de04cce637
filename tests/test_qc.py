import math
import statistics

import pytest
from pyspark.sql import functions as F

from cohortframe.operators import impute, qc


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def variant(geno_of, calls):
    return geno_of({f"s{i:03d}": {"v": c} for i, c in enumerate(calls)})


def test_missing_rate_at_the_limit_passes(geno_of):
    g = variant(geno_of, [None] + [1] * 19)            # exactly .05 missing
    assert rows_of(qc.judge_variants(qc.variant_stats(g)), "verdict") == [("pass",)]


def test_maf_at_the_limit_passes_and_below_fails(geno_of):
    at = variant(geno_of, [1] * 2 + [0] * 18)          # 2 / 40 = .05
    below = variant(geno_of, [1] + [0] * 19)
    assert rows_of(qc.judge_variants(qc.variant_stats(at)), "verdict") == [("pass",)]
    assert rows_of(qc.judge_variants(qc.variant_stats(below)), "verdict") == [("maf",)]


def test_all_null_variant_fails_missing_with_zero_maf(geno_of):
    out = qc.judge_variants(qc.variant_stats(variant(geno_of, [None] * 4))).first()
    assert (out.verdict, out.maf, out.alt_freq, out.n_valid) == ("missing", 0.0, None, 0)


def test_sparse_cells_count_as_missing_when_the_sample_count_is_given(geno_of):
    g = variant(geno_of, [0, 1, 2])
    assert qc.variant_stats(g, n_samples=4).first().missing_rate == 0.25


def test_het_dialects(spark):
    rates = [0.1, 0.12, 0.11, 0.13, 0.9]
    miss = [0.0, 0.0, 0.0, 0.0, 0.5]
    stats = spark.createDataFrame(
        [(f"s{i}", 10, 10, m, r) for i, (m, r) in enumerate(zip(miss, rates))],
        "sample_id string, n_total long, n_valid long, missing_rate double, het_rate double")
    passers = statistics.mean(rates[:4]) - 3 * statistics.stdev(rates[:4])
    everyone = statistics.mean(rates) - 3 * statistics.stdev(rates)
    assert math.isclose(qc.het_bounds(stats, dialect="passers").first().lo, passers)
    assert math.isclose(qc.het_bounds(stats, dialect="all").first().lo, everyone)
    assert qc.het_bounds(stats, k=100).first().lo == 0.0
    assert qc.het_bounds(stats, k=100).first().hi == 1.0
    with pytest.raises(ValueError):
        qc.het_bounds(stats, dialect="other")


def test_one_sample_has_no_het_bounds(spark):
    stats = spark.createDataFrame([("a", 1, 1, 0.0, 1.0)],
                                  "sample_id string, n_total long, n_valid long, missing_rate double, het_rate double")
    assert rows_of(qc.judge_samples(stats), "verdict") == [("pass",)]


def test_sample_map_reasons(spark):
    judged = spark.createDataFrame([("a", 0.25, 0.3, "missing"), ("b", 0.0, 0.3, "pass")],
                                   "sample_id string, missing_rate double, het_rate double, verdict string")
    out = {r.sample_id: (r.status, r.failure_reasons) for r in qc.sample_map(judged).collect()}
    assert out == {"a": ("removed", ["missing rate 0.2500"]), "b": ("kept", [])}


def test_hardy_weinberg_by_hand(geno_of):
    g = variant(geno_of, [0] * 30 + [1] * 40 + [2] * 30)
    out = qc.hardy_weinberg(g).first()
    assert math.isclose(out.chi2, 4.0) and math.isclose(out.p_value, math.exp(-2.0)) and out.hwe_pass
    assert qc.hardy_weinberg(variant(geno_of, [0] * 50 + [1])).first().p_value is None


def test_thinning_keeps_every_fth(spark):
    v = spark.createDataFrame([(f"v{i:02d}", "1", i) for i in range(20)], "var_id string, chr string, pos long")
    kept = rows_of(qc.thin_variants(v, limit=10, target=5), "pos")
    assert kept == [(0,), (4,), (8,), (12,), (16,)]
    assert qc.thin_variants(v, limit=20, target=5).count() == 20
    assert rows_of(qc.thin_variants(v, 10, 5, "floor_plus_one"), "pos") == [(0,), (5,), (10,), (15,)]


def test_mode_ties_go_to_the_smaller_and_no_calls_to_zero(geno_of):
    g = geno_of({"a": {"t": 0, "n": None}, "b": {"t": 2, "n": None}, "c": {"t": None, "n": None}})
    out = {(r.sample_id, r.var_id): r.dosage for r in impute.impute_mode(g).collect()}
    assert out[("c", "t")] == 0 and out[("a", "n")] == 0


def test_standardize_constant_and_population_sd(geno_of):
    g = geno_of({"a": {"x": 0, "c": 1}, "b": {"x": 2, "c": 1}})
    z = {(r.sample_id, r.var_id): r.z for r in impute.standardize(g).collect()}
    assert z[("a", "x")] == -1.0 and z[("b", "x")] == 1.0 and z[("a", "c")] == 0.0


def test_tercile_value_on_the_cut_stays_low(spark):
    df = spark.createDataFrame([(float(i),) for i in range(4)], "y double")
    out = impute.discretize(df, "y", [1 / 3, 2 / 3], [])
    assert rows_of(out, "y", "cls") == [(0.0, 0), (1.0, 0), (2.0, 1), (3.0, 2)]
    assert rows_of(impute.discretize(df, "y", [1 / 3, 2 / 3], [], right_open=True), "cls") == [(0,), (1,), (2,), (2,)]


def test_align_fills_unseen_and_drops_extras(geno_of):
    syn = geno_of({"s": {"a": 2, "x": 1}})
    real = geno_of({"r": {"a": 0, "b": 1}})
    assert rows_of(impute.align_to_variants(syn, syn, real), "var_id", "dosage") == [("a", 2), ("b", 0)]


def test_valid_samples_drop_the_whole_sample(geno_of):
    syn = geno_of({"ok": {"a": 0.9, "b": 2.0}, "bad": {"a": 0.0, "b": 2.6}, "null": {"a": None}}, "double")
    assert rows_of(impute.valid_samples(syn), "sample_id", "dosage") == [("ok", 1), ("ok", 2)]


def test_repair_and_target_band(geno_of, spark):
    real = geno_of({f"r{i}": {"a": 2} for i in range(3)})
    syn = geno_of({"s": {"a": 7.0}}, "double")
    assert impute.repair_calls(syn, real).first().dosage == 2
    y = spark.createDataFrame([("r", 1.0), ("q", 3.0)], "sample_id string, y double")
    s = spark.createDataFrame([("in", 2.0), ("out", 9.0)], "sample_id string, y double")
    assert rows_of(impute.target_within_sd(s, y), "sample_id") == [("in",)]


def test_nonfinite_median(spark):
    df = spark.createDataFrame([("k", 1.0), ("k", 3.0), ("k", float("nan")), ("k", float("inf")), ("k", None)], "k string, v double")
    assert rows_of(impute.fill_nonfinite(df, "v", "k"), "v") == [(1.0,), (2.0,), (2.0,), (2.0,), (3.0,)]


def test_result_does_not_depend_on_partitions(geno_of):
    g = geno_of({f"s{i:02d}": {f"v{j}": (i * j) % 3 if (i + j) % 7 else None for j in range(5)} for i in range(40)})
    base = rows_of(qc.qc_report(g, max_missing=0.3), "metric", "value")
    assert rows_of(qc.qc_report(g.repartition(13), max_missing=0.3), "metric", "value") == base
    assert F is not None
