import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortframe.operators import ranking
from cohortframe.operators.ranking import exact_quantiles, ranked


def test_ranks_with_a_hot_group(spark):
    """One group holds most rows; ranks are dense and group-wise all the same."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
                                  (F.col("id") * 7919 % 3001).alias("v"), "id")
    out = ranked(df, ["v", "id"], by=["g"], name="r", total="n").toPandas()
    want = out.sort_values(["g", "v", "id"]).groupby("g").cumcount() + 1
    assert (want.sort_index() == out["r"]).all()
    assert (out.groupby("g")["r"].max() == out.groupby("g")["n"].first()).all()


def test_null_groups_are_a_group(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "g string, v int")
    assert sorted((r.g or "", r.v, r.r) for r in ranked(df, ["v"], ["g"], "r").collect()) == [("", 1, 1), ("", 2, 2), ("a", 5, 1)]


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    vals = rng.normal(size=997)
    df = spark.createDataFrame([(int(i % 3), float(v)) for i, v in enumerate(vals)], "g int, v double")
    probs = [0.0, 0.1, 0.5, 0.95, 1.0]
    for r in exact_quantiles(df, "v", probs, by=["g"]).collect():
        assert np.allclose(r.q, np.quantile(vals[r.g::3], probs))
    one = exact_quantiles(df, "v", probs).first()
    assert one.n == 997 and np.allclose(one.q, np.quantile(vals, probs))


def test_one_hot_value(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 700, 1.0).otherwise(F.col("id").cast("double")).alias("v"))
    assert exact_quantiles(df, "v", [0.5, 0.9]).first().q[0] == 1.0


def test_empty(spark):
    df = spark.createDataFrame([], "v double")
    assert exact_quantiles(df, "v", [0.5]).first().n is None


@pytest.mark.parametrize("kind", ["normal", "wide", "ties", "infinite"])
def test_quantiles_by_refinement(spark, monkeypatch, kind):
    """Several rounds of small buckets, in groups of all sizes, null keys too."""
    monkeypatch.setattr(ranking, "BUCKETS", 4)
    monkeypatch.setattr(ranking, "REST", 3)
    rng = np.random.default_rng(1)
    vals = {"normal": rng.normal(size=400), "wide": rng.normal(size=400) * 10.0 ** rng.integers(-300, 300, 400),
            "ties": rng.integers(0, 3, 400).astype(float), "infinite": np.where(rng.random(400) < 0.1, np.inf, np.where(rng.random(400) < 0.1, -np.inf, rng.normal(size=400)))}[kind]
    groups = [None if i % 4 == 0 else "x" * (i % 4) if i < 390 else f"g{i}" for i in range(400)]
    df = spark.createDataFrame([(g, float(v)) for g, v in zip(groups, vals)], "g string, v double").repartition(5)
    probs = [0.0, 0.03, 0.5, 0.95, 1.0]
    got = exact_quantiles(df, "v", probs, by=["g"]).collect()
    assert len(got) == len(set(groups))
    for r in got:
        own = np.sort([v for g, v in zip(groups, vals) if g == r.g])
        at = np.array(probs) * (len(own) - 1)
        lo, hi = own[np.floor(at).astype(int)], own[np.minimum(np.floor(at).astype(int) + 1, len(own) - 1)]
        with np.errstate(invalid="ignore", over="ignore"):
            want = np.where(at == np.floor(at), lo, lo + (hi - lo) * (at - np.floor(at)))
        assert r.n == len(own) and np.allclose(r.q, want, equal_nan=True, rtol=1e-12)


def test_no_sort_of_rows_and_few_rounds_under_a_heavy_tie(spark, monkeypatch):
    calls = []
    real = ranking.measured
    monkeypatch.setattr(ranking, "measured", lambda df: calls.append(1) or real(df))
    df = spark.range(40_000).select(F.when(F.col("id") % 10 < 7, F.lit(5.0)).otherwise(F.col("id") / 100).alias("v"))
    out = exact_quantiles(df, "v", [0.5, 0.9, 0.99])
    assert "rangepartitioning" not in out._jdf.queryExecution().toString().lower()
    want = np.quantile([5.0 if i % 10 < 7 else i / 100 for i in range(40_000)], [0.5, 0.9, 0.99])
    assert np.allclose(out.first().q, want) and len(calls) <= 3


def test_nan_is_larger_than_numbers(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,), (None,)], "v double")
    q = exact_quantiles(df, "v", [0.0, 0.5, 1.0]).first().q
    assert q[:2] == [1.0, 2.0] and np.isnan(q[2])
