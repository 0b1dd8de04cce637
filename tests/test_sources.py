import datetime as dt
import json
import re

import pytest

from cohortframe.plans import experiments, preprocess
from cohortframe.sources import genotypes as G
from cohortframe.sources import runs as R
from cohortframe.sources import tables as T
from cohortframe.streaming import jobs as J


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_vcf_files_with_their_own_samples(spark, tmp_path):
    head = "##meta\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
    write(tmp_path / "a.vcf", head + "s1\ts2\n1\t5\t.\tA\tG,T\t.\t.\t.\tGT:DP\t0|1:3\t./.\nbroken\tline\n")
    write(tmp_path / "b.vcf", head + "s3\n2\t7\trs7\tC\t.\t.\t.\t.\tGT\t1/1\n")
    variants, geno = G.read_vcf(spark, str(tmp_path / "*.vcf"))
    assert sorted(tuple(r) for r in variants.collect()) == [("1_5", "1", 5, "A", "G"), ("rs7", "2", 7, "C", "")]
    assert sorted((r.sample_id, r.var_id, r.dosage) for r in geno.collect()) == [("s1", "1_5", 1), ("s2", "1_5", None), ("s3", "rs7", 2)]
    with pytest.raises(Exception, match="no header line found in .*c.txt"):
        G.read_vcf(spark, write(tmp_path / "c.txt", "nothing\n"))[1].collect()


def test_a_cell_does_not_carry_its_line(spark, tmp_path):
    vcf = write(tmp_path / "a.vcf", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n1\t5\tx\tA\tG\t.\t.\t.\tGT\t1/1\t0/0\n")
    markers = write(tmp_path / "m.csv", "Marker,s1,s2\nm1,0,2\n")
    samples = write(tmp_path / "x.csv", "Sample_ID,v1,v2\ns1,0,2\n")
    for geno in (G.read_vcf(spark, vcf)[1], G.read_marker_matrix(spark, markers), G.read_sample_matrix(spark, samples)):
        plan = geno._jdf.queryExecution().executedPlan().toString()
        carried = re.findall(r"Generate explode\(.*\), \[(.*)\], false", plan)
        assert carried and not any("fields#" in c or "value#" in c for c in carried)


def test_vcf_without_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(G, "MAX_BROADCAST_NAMES", 0)
    path = write(tmp_path / "a.vcf", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\n1\t5\tx\tA\tG\t.\t.\t.\tGT\t1/1\n")
    assert [tuple(r) for r in G.read_vcf(spark, path)[1].collect()] == [("s1", "x", 2)]


def test_hapmap_alleles(spark, tmp_path):
    names = ",".join(["rs#", "alleles", "chrom", "pos", "strand", *"abcdef", "s1", "s2"])
    path = write(tmp_path / "h.csv", names + "\nv1,A/G,1,9,+,.,.,.,.,.,.,AG,N\n")
    variants, geno = G.read_hapmap(spark, path)
    assert [tuple(r) for r in variants.collect()] == [("v1", "1", 9, "A", "G")]
    assert sorted((r.sample_id, r.dosage) for r in geno.collect()) == [("s1", 1), ("s2", None)]


def test_ids_that_look_like_headers_two_delimiters_and_rejects(spark, tmp_path):
    names = ["rs#", "alleles", "chrom", "pos", "strand", *"abcdef", "s1"]
    line = ["rs123", "A/G", "1", "9", "+", *"......", "GG"]
    write(tmp_path / "h/a.txt", "\t".join(names) + "\n" + "\t".join(line) + "\nV2\tA/G\n" + "\t".join([*line, "AA"]) + "\n")
    write(tmp_path / "h/b.txt", ",".join([*names[:-1], "s2"]) + "\n" + ",".join(["Rs_9", *line[1:]]) + "\n")
    assert sorted((r.sample_id, r.var_id, r.dosage) for r in G.read_hapmap(spark, str(tmp_path / "h"))[1].collect()) == [("s1", "rs123", 2), ("s2", "Rs_9", 2)]
    write(tmp_path / "h/c.txt", "rs5,A/G\n")
    bad = {(r.file.rsplit("/", 1)[1], r.reason) for r in G.rejected_lines(spark, str(tmp_path / "h"), *G.HAPMAP).collect()}
    assert bad == {("a.txt", "too few fields"), ("a.txt", "too many fields"), ("c.txt", "no header")}
    write(tmp_path / "m/a.csv", "marker,s1\nMarker_1,2\nmarkers,0\n")
    assert sorted((r.var_id, r.dosage) for r in G.read_marker_matrix(spark, str(tmp_path / "m")).collect()) == [("Marker_1", 2.0), ("markers", 0.0)]
    x = write(tmp_path / "x.csv", "Sample_ID;v1\nSample_ID_7;1\n")
    assert [tuple(r) for r in G.read_sample_matrix(spark, x).collect()] == [("Sample_ID_7", "v1", 1.0)]


def test_marker_matrix_drops_metadata(spark, tmp_path):
    path = write(tmp_path / "m.csv", "Marker;POS;s1;chrom;s2\nm1;77;0/1;1;NA\n")
    assert sorted((r.sample_id, r.var_id, r.dosage) for r in G.read_marker_matrix(spark, path).collect()) == [("s1", "m1", 1.0), ("s2", "m1", None)]
    wide = spark.createDataFrame([("m1", "77", "2")], "Marker string, POS string, s1 string")
    assert [tuple(r) for r in G.matrix_to_long(wide, "Marker").collect()] == [("m1", "s1", 2.0)]
    x = write(tmp_path / "x.csv", "Sample_ID,v1,v2\ns1,0,2\n")
    assert sorted(tuple(r) for r in G.read_sample_matrix(spark, x).collect()) == [("s1", "v1", 0.0), ("s1", "v2", 2.0)]


def test_files_of_one_path_have_their_own_delimiter_and_header(spark, tmp_path):
    write(tmp_path / "t" / "a.csv", "IID,y\n1,2\n")
    write(tmp_path / "t" / "b.csv", "IID\ty\n3\t4\n")
    write(tmp_path / "t" / "c.csv", "y;IID;z\n6;5;q\n")
    write(tmp_path / "t" / "d.csv", "IID,y\n7,8\n")
    write(tmp_path / "t" / "e.csv", "")
    got = {tuple(r) for r in T.read_delimited(spark, str(tmp_path / "t"), [",", "\t", ";"]).select("IID", "y", "z").collect()}
    assert got == {("1", "2", None), ("3", "4", None), ("5", "6", "q"), ("7", "8", None)}
    with pytest.raises(ValueError):
        T.read_delimited(spark, str(tmp_path / "t" / "e.csv"))


def test_delimiter_and_id(spark, tmp_path):
    df = T.read_delimited(spark, write(tmp_path / "d.txt", "IID\ta,b\tc\n007\t1\t2\n"))
    assert df.columns == ["IID", "a,b", "c"] and T.with_string_id(df).first().sample_id == "007"


def test_tolerant(spark, tmp_path):
    rows, bad = T.read_tolerant(spark, write(tmp_path / "t.csv", "a,b\n1,2\n3,x,9\n"), "a int, b int")
    assert [tuple(r) for r in rows.collect()] == [(1, 2)] and [r.line for r in bad.collect()] == ["3,x,9"]


def test_tolerant_leaves_out_the_first_line_of_each_file_only(spark, tmp_path):
    write(tmp_path / "t/a.csv", "a,b\n1,2\na,b\n")
    write(tmp_path / "t/b.csv", "x,y\n3,4\n")
    rows, bad = T.read_tolerant(spark, str(tmp_path / "t"), "a int, b int")
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 2), (3, 4)] and [r.line for r in bad.collect()] == ["a,b"]


def test_differences_count_repeats(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    out = T.table_differences(a, b).first()
    assert (out.rows_left, out.rows_right, out.only_left, out.only_right, out.equal) == (3, 3, 1, 1, False)
    assert T.table_differences(a, a).first().equal


def test_pruned_read_reads_only_what_it_needs(spark, tmp_path):
    path = str(tmp_path / "w")
    spark.createDataFrame([("s", 1, 2, 3)], "Sample_ID string, a int, b int, c int").write.parquet(path)
    plan = T.read_columns(spark, path, ["b"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<Sample_ID:string,b:int>" in plan


def test_run_dialects(spark, tmp_path):
    docs = [
        {"model_name": "RandomForest", "run_id": "1", "cv_r2_mean": 0.5, "cv_r2_std": 0.1, "holdout_r2": 0.0, "selected_k": 10},
        {"model": {"name": "svr"}, "timestamp": "2", "cv": {"r2_mean": 0.4, "r2_std": 0.2}, "holdout": {"r2_score": 0.3}},
        {"model_name": "ridge", "run_id": "3", "average_scores": {"r2": 0.2}, "holdout_metrics": {"r2": 0.1},
         "outer_scores": [{"r2": 0.1, "best_params": {}}, {"r2": 0.3, "best_params": {"max_features": 7}}]},
    ]
    for i, d in enumerate(docs):
        write(tmp_path / "j" / f"r{i}.json", json.dumps(d, indent=1))
    got = {r.run_id: r for r in R.read_runs(spark, str(tmp_path / "j"), multi_line=True).collect()}
    assert (got["1"].model, got["1"].holdout_r2, got["1"].selected_k) == ("randomforest", 0.0, 10)
    assert (got["2"].model, got["2"].cv_r2_mean, got["2"].holdout_r2) == ("svr", 0.4, 0.3)
    assert got["3"].selected_k == 7 and abs(got["3"].cv_r2_std - 0.1) < 1e-12 and got["3"].cv_r2_mean == 0.2


def test_guarded_append(spark, tmp_path):
    path = str(tmp_path / "runs")
    a = spark.createDataFrame([("m", "1", 0.1)], "model string, run_id string, v double")
    b = spark.createDataFrame([("m", "1", 0.9), ("m", "2", 0.2)], "model string, run_id string, v double")
    R.append_new_runs(a, path)
    R.append_new_runs(b, path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("m", "1", 0.1), ("m", "2", 0.2)]


def test_writers_of_one_run_leave_one(spark, tmp_path):
    """Writers that started from the same version: the first claim stands, the others add what is left; versions stay readable."""
    from cohortframe.sources.runtable import RunTable

    table = RunTable(spark, str(tmp_path / "runs"))
    def runs(who, *ids):
        return spark.createDataFrame([("m", i, who) for i in ids], "model string, run_id string, who string")
    def rows(version=None):
        return sorted(((r.run_id or "", r.who) for r in table.read(version).collect()))
    assert table.read() is None and table.version() == 0
    a, b, c = table.prepare(runs("a", "1", "2")), table.prepare(runs("b", "2", "3", None)), table.prepare(runs("c", "1", "3", "4", None))
    assert table.read() is None                  # nothing is listed yet
    assert table.commit(b).count() == 3
    assert rows() == [("", "b"), ("2", "b"), ("3", "b")]
    seen = table.read()
    assert [r.run_id for r in table.commit(a).collect()] == ["1"]
    assert [r.run_id for r in table.commit(c).collect()] == ["4"]
    assert rows() == [("", "b"), ("1", "a"), ("2", "b"), ("3", "b"), ("4", "c")] and table.version() == 3
    assert seen.count() == 3 and rows(1) == [("", "b"), ("2", "b"), ("3", "b")]
    late = table.prepare(runs("late", "9"))
    table.replace(runs("new", "7"))
    assert rows() == [("7", "new")]
    table.commit(late)
    assert rows() == [("7", "new"), ("9", "late")]
    # a claim leaves no draft, a lost one no folder
    left = {p.name for p in (tmp_path / "runs").iterdir() if p.name.startswith("data-")}
    assert left >= set(table.folders(5)) and not [p for p in (tmp_path / "runs" / "_log").iterdir() if p.suffix != ".json" and not p.name.endswith(".crc")]
    assert table.append_new(runs("again", "7", "9")).count() == 0


def test_discovery(spark, tmp_path):
    write(tmp_path / "m1" / "context_A" / "x.csv", "Sample_ID,y\na,1\n")
    write(tmp_path / "m2" / "context_B" / "y.csv", "Sample_ID,y\nb,2\n")
    got = sorted(tuple(r) for r in T.discover(spark, str(tmp_path)).collect())
    assert got == [("a", "1", "m1", "A"), ("b", "2", "m2", "B")]
    files = T.dataset_files(spark, str(tmp_path / "m1"))
    assert [(r.dataset, r.file) for r in files.collect()] == [("context_A", "x.csv")]


def test_ingest_takes_each_file_once(spark, tmp_path):
    land, table, ck = tmp_path / "land", str(tmp_path / "table"), str(tmp_path / "ck")
    write(land / "1.csv", "sample_id,var_id,dosage\na,v,1\n")
    J.finish(J.ingest_genotypes(spark, str(land), table, ck))
    write(land / "2.csv", "sample_id,var_id,dosage\nb,v,2\n")
    J.finish(J.ingest_genotypes(spark, str(land), table, ck))
    assert sorted(tuple(r) for r in spark.read.parquet(table).collect()) == [("a", "v", 1), ("b", "v", 2)]


@pytest.mark.parametrize("empty_batches", ["true", "false"])
def test_answers_stream_duplicates_and_late_rows(spark, tmp_path, empty_batches):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", empty_batches)
    land = str(tmp_path / "land")
    body = "Sample_ID,V1,V2,y\nq,1,2,3\n"
    day = dt.datetime(2024, 1, 10)
    def drop(rows):
        spark.createDataFrame(rows, "run_id long, text string, ts timestamp").coalesce(1).write.mode("append").parquet(land)
    schema = "run_id long, text string, ts timestamp"
    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(land)
        J.finish(J.ingest_responses(stream, ["V1", "V2"], str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "ck"), delay="1 hour"))
    drop([(1, body, day), (2, body, day)])
    run()
    drop([(2, body, day + dt.timedelta(minutes=5)), (3, body, day + dt.timedelta(days=2))])
    run()
    drop([(4, body, day - dt.timedelta(days=5)), (5, body, day + dt.timedelta(days=2)), (5, body, day + dt.timedelta(days=2)), (6, None, None), (4, body, day)])
    run()
    got = spark.read.parquet(f"{tmp_path}/ok/batch=*")
    assert sorted((r.run_id, r.sample_id) for r in got.collect()) == [(i, f"SYNTHETIC_{i}_1") for i in (1, 2, 3, 5)]
    judged = {(r.run_id, r.reason): r.n for r in J.judged_answers(spark, str(tmp_path / "ok")).collect()}
    assert judged == {(i, "accepted"): 1 for i in (1, 2, 3, 5, 6)} | {(2, "repeated"): 1, (5, "repeated"): 1, (4, "late"): 2}
    # the state holds the ids of the delay and the mark
    state = {r.run_id for r in spark.read.parquet(f"{tmp_path}/ok_state/turn=0").collect()}
    assert state == {3, 5, 6, None}


def test_stream_summary_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"m{i % 3}", i / 10, i / 7) for i in range(30)], "model string, cv_r2 double, holdout_r2 double")
    rows.repartition(5).write.json(str(tmp_path / "land"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "land"))
    J.finish(J.upsert_stream(J.running_summary(stream), str(tmp_path / "out"), str(tmp_path / "ck")))
    a = {r.model: tuple(round(x, 9) for x in r[1:]) for r in J.read_latest(spark, str(tmp_path / "out"), ["model"]).collect()}
    b = {r.model: tuple(round(x, 9) for x in r[1:]) for r in J.running_summary(rows).collect()}
    assert a == b


def test_whole_preprocessing_and_run(spark, tmp_path, geno_of):
    table = {f"s{i:02d}": {f"v{j:02d}": ((i * 7 + j * 3 + i * j) % 5) % 3 for j in range(12)} for i in range(40)}
    table["s01"]["v03"] = None
    geno = geno_of(table)
    pheno = spark.createDataFrame([(f"s{i:02d}", float(i % 7) + table[f"s{i:02d}"]["v05"]) for i in range(40)], "sample_id string, y double")
    variants = spark.createDataFrame([(f"v{j:02d}", "1", j, "A", "G") for j in range(12)], "var_id string, chr string, pos long, ref string, alt string")
    tables = preprocess.process(geno, pheno, variants, preprocess.Settings(components=2))
    out = {r.table: r.n_rows for r in preprocess.write_processed(tables, str(tmp_path / "set")).collect()}
    assert out["X"] == 480 and out["sample_map"] == 40 and out["pcs"] == 40 and out["manifest"] == 12
    assert tables["X"].where("dosage IS NULL").count() == 0
    knn = preprocess.process(geno, pheno, variants, preprocess.Settings(components=2, imputation="knn"))
    assert knn["X"].count() == 480
    syn = tables["X"].selectExpr("concat('SYNTHETIC_', sample_id) AS sample_id", "var_id", "dosage")
    syn_y = pheno.selectExpr("concat('SYNTHETIC_', sample_id) AS sample_id", "y")
    rec = experiments.augmented_run(tables["X"], pheno, syn, syn_y, {"ridge": {"alpha": [1.0]}}, k=5, outer=2, inner=2)
    assert sorted(r["mode"] for r in rec.collect()) == ["augmented", "original"]
    assert experiments.comparison(rec).count() == 1
    rep = experiments.normalization_report(tables["X"], syn, pheno, syn_y).first()
    assert rep.drift_mean == 0.0 and rep.gate and rep.id_mismatches == 0 and abs(rep.overlap - 1.0) < 1e-9


def shuffles_of_cells(df):
    """Shuffles in the physical plan that move rows keyed on the variant."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning(var_id" in line]


def test_bucketed_table_needs_no_shuffle_per_variant(spark, tmp_path, geno_of):
    from cohortframe.operators import impute, qc
    from cohortframe.sources.layout import save_bucketed
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.sql("DROP TABLE IF EXISTS cells_by_variant")
    g = geno_of({f"s{i:02d}": {f"v{j}": (i * j) % 3 for j in range(6)} for i in range(30)})
    try:
        plain = qc.filter_variants(g)
        stored = save_bucketed(g, "cells_by_variant", str(tmp_path / "cells"), 4)
        assert shuffles_of_cells(plain)
        for make in (qc.filter_variants, impute.impute_mode, impute.standardize):
            assert not shuffles_of_cells(make(stored))
        assert qc.filter_variants(stored).exceptAll(plain).count() == 0
    finally:
        spark.sql("DROP TABLE IF EXISTS cells_by_variant")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_summaries_are_compacted(spark, tmp_path):
    """Twenty batches in a bounded number of folders; a batch that is replayed adds nothing."""
    land, out, ck = str(tmp_path / "land"), str(tmp_path / "out"), str(tmp_path / "ck")
    total = {}
    for number in range(20):
        rows = [(f"m{(number + j) % 7}", float(number * 10 + j), float(j)) for j in range(3)]
        for m, a, b in rows:
            total.setdefault(m, []).append(a)
        spark.createDataFrame(rows, "model string, cv_r2 double, holdout_r2 double").coalesce(1).write.mode("append").json(land)

    def run():
        stream = spark.readStream.schema("model string, cv_r2 double, holdout_r2 double").option("maxFilesPerTrigger", 1).json(land)
        J.finish(J.upsert_stream(J.running_summary(stream), out, ck, ["model"], every=3))
        return {r.model: (r.n_runs, round(r.cv_r2_mean, 6)) for r in J.read_latest(spark, out, ["model"]).collect()}

    want = {m: (len(v), round(sum(v) / len(v), 6)) for m, v in total.items()}
    assert run() == want
    folders = sorted(p.name for p in (tmp_path / "out").iterdir() if "=" in p.name)
    assert len(folders) <= 8 and {"base=0", "base=1"} <= set(folders)
    last = max((tmp_path / "ck" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (last, last.with_name(f".{last.name}.crc")):
        if p.exists():
            p.unlink()              # as after a loss between write and commit
    assert run() == want
