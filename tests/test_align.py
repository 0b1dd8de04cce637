from cohortframe.operators import align as A
from cohortframe.operators import profile as P


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "sample_id string")


def test_fuzzy_needs_one_match_and_takes_the_first_part(spark):
    s = ids(spark, "AAAAA_11111", "lib_22222", "lib_33333_44444", "shrt_55")
    p = spark.createDataFrame([("xAAAAAy",), ("zAAAAAw",), ("q11111",), ("r22222",), ("t22222",), ("u33333",), ("w44444",)], "gbs string")
    got = {r.sample_id: (r.part, r.gbs) for r in A.fuzzy_match(s, p, "gbs").collect()}
    assert got == {"AAAAA_11111": ("11111", "q11111"), "lib_33333_44444": ("33333", "u33333")}


def test_fuzzy_sorts_only_substrings_that_are_parts(spark):
    got = A.fuzzy_match(ids(spark, "x_12345"), spark.createDataFrame([("a12345",), ("b67890",)], "gbs string"), "gbs")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [part") < plan.index("LeftSemi") < plan.index("Generate explode") < plan.index("Repartition")
    assert [tuple(r) for r in got.collect()] == [("x_12345", "12345", "a12345")]


def test_fuzzy_counts_rows_not_ids(spark):
    got = A.fuzzy_match(ids(spark, "x_12345"), spark.createDataFrame([("a12345",), ("a12345",)], "gbs string"), "gbs")
    assert got.count() == 0


def test_first_record_on_repeats(spark, geno_of):
    g = geno_of({"a": {"v": 1}, "b": {"v": 0}})
    y = spark.createDataFrame([("a", 2, 9.0), ("a", 1, 5.0), ("c", 1, 1.0)], "sample_id string, seq long, y double")
    assert [tuple(r) for r in A.align_samples(g, y).collect()] == [("a", 5.0)]


def test_union_keeps_the_real_row(spark, geno_of):
    real = geno_of({"a": {"v": 1, "w": 2}})
    syn = geno_of({"a": {"v": 0}, "s": {"v": 2, "x": 1}})
    got = sorted((r.sample_id, r.var_id, r.dosage, r.origin) for r in A.union_real_first(real, {"m": syn}).collect())
    assert got == [("a", "v", 1, "real"), ("a", "w", 2, "real"), ("s", "v", 2, "m"), ("s", "w", 0, "m")]


def test_status(spark):
    f = spark.createDataFrame([("a", "X"), ("a", "y"), ("b", "X"), ("c", "zzz")], "dataset string, file string")
    assert {r.dataset: r.status for r in A.preprocessing_status(f, ["X", "y"]).collect()} == {"a": "Complete", "b": "Partial", "c": "Incomplete"}


def test_overlap(spark):
    out = A.overlap_audit({"x": ids(spark, "a", "b", "b"), "y": ids(spark, "b", "c", "d")}).first()
    assert (out.common, out.n_x, out.n_y, out.only_x, out.only_y) == (1, 2, 3, 1, 2) and abs(out.overlap - 1 / 3) < 1e-12


def test_slices_at_nineteen_and_twenty(spark):
    def y(n):
        return spark.createDataFrame([(f"s{i:02d}", float(i)) for i in range(n)], "sample_id string, y double")
    assert {r.part for r in P.head_median_tail(y(19)).collect()} == {"all"}
    got = P.head_median_tail(y(20)).collect()
    assert len(got) == 20 and sorted(r.y for r in got if r.part == "median") == [7.0, 8.0, 9.0, 10.0, 11.0, 12.0]


def test_numeric_screen(spark):
    df = spark.createDataFrame([("1", None, "x", None), ("2", None, "3", None), ("3", "4", "4", "5")], "a string, b string, c string, d string")
    assert {r.col: r.is_numeric for r in P.numeric_screen(df, ["a", "b", "c", "d"]).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_constant_target_is_rejected(spark):
    df = spark.createDataFrame([(1.0,)] * 150, "y double")
    assert P.usable_target(df, "y").first().verdict == "reject"
