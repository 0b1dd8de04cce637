import pytest
from pyspark.sql import functions as F

from cohortframe.functions import encoding as E
from cohortframe.functions.expr import norm_ppf, safe_div, u01


def apply(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.o for r in df.select("i", fn(F.col("x")).alias("o")).orderBy("i").collect()]


def test_vcf(spark):
    texts = ["0/0", "0|1", "1/1", "./.", ".|.", ".", "./1", "1/2", "2/2", None]
    assert apply(spark, E.vcf_dosage, texts) == [0, 1, 2, None, None, None, 1, 1, 0, None]


def test_iupac(spark):
    assert apply(spark, E.iupac_dosage, ["N", "-", "?", "", "A", "a", "G", "AG", "gg", "GGG", "AA"]) == \
        [None, None, None, None, 0, 0, 1, 1, 2, 0, 0]


def test_generic(spark):
    texts = ["10", "11", "0/1", "1/1", "NA", ".", "", "g", "x/1", "1.5", "nan", None, "01"]
    assert apply(spark, E.generic_dosage, texts) == [10.0, 11.0, 1.0, 2.0, None, None, None, 0.0, None, 1.5, None, None, 1.0]


def test_cleanup(spark):
    assert apply(spark, E.clean_dosage, ["0.5", "1.5", "2.6", "-3", "bad", None, "1"]) == [0, 2, 2, 0, 0, 0, 1]


@pytest.mark.parametrize("text, want", [("80%", 0.8), (" 0.25 ", 0.25), ("250%", 1.0), ("-1", 0.0), ("abc", None), ("", None)])
def test_fraction(spark, text, want):
    assert apply(spark, E.parse_fraction, [text]) == [want]


def test_names(spark):
    assert apply(spark, E.model_name_by_alias, ["RF", "SVM", "xgb", None, "Other"]) == ["randomforest", "svr", "xgboost", "", "other"]
    assert apply(spark, E.model_name_by_part, ["my_rf_2", "LGBM-x", "ridgecv"]) == ["randomforest", "lightgbm", "ridge"]
    assert apply(spark, E.context_name, [None, "prompt_C_1", "context_E", "zzz"]) == ["baseline", "context_C", "context_E", "zzz"]
    assert apply(spark, E.k_from_name, ["a_k3000.csv", "none"]) == [3000, None]
    assert apply(spark, E.strip_id_prefix, ["SAMEA1_B_C", "X_B"]) == ["B_C", "X_B"]


def test_ids(spark):
    assert apply(spark, E.synthetic_id, ["a", "SYNTHETIC_a"]) == ["SYNTHETIC_a", "SYNTHETIC_a"]
    assert apply(spark, lambda c: E.numbered_id("S_", c, 3), [7, 12345], "long") == ["S_007", "S_12345"]


def test_delta_band(spark):
    def up(c):
        return E.delta_marker(c, F.lit(0.0))

    def err(c):
        return E.delta_marker(c, F.lit(0.0), higher_is_better=False)

    assert apply(spark, up, [0.02, -0.02, 0.005, None], "double") == ["up", "down", "", "N/A"]
    assert apply(spark, err, [0.02, -0.02], "double") == ["down", "up"]


def test_helpers(spark):
    from statistics import NormalDist
    ps = [1e-6, 0.01, 0.3, 0.5, 0.9, 0.99999]
    got = apply(spark, norm_ppf, ps, "double")
    assert all(abs(g - NormalDist().inv_cdf(p)) < 1e-7 for g, p in zip(got, ps))
    assert apply(spark, lambda c: safe_div(c, F.lit(0)), [1.0], "double") == [None]
    us = apply(spark, lambda c: u01(1, c), [str(i) for i in range(4000)])
    assert abs(sum(us) / 4000 - 0.5) < 0.02 and min(us) > 0 and max(us) < 1
