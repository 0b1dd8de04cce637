"""Sources, sinks and streams: each query writes a derived table and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortframe.catalog import query
from cohortframe.catalog.synthetic import LINES, _call
from cohortframe.fixtures import VIEWS
from cohortframe.functions.expr import round_columns, rounded
from cohortframe.operators.impute import align_to_variants
from cohortframe.session import shared_dir
from cohortframe.sources import genotypes as SG
from cohortframe.sources import runs as SR
from cohortframe.sources import tables as ST
from cohortframe.streaming import jobs as SJ


def folder(t, name: str) -> str:
    """A new folder under the shared one."""
    return f"{shared_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _line_files(t, name: str, text, header, sep: str = "\t"):
    """One text file per chromosome: its header line, then a line per variant."""
    cells = align_to_variants(t.geno, fill=None)
    calls = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sample_id", text.alias("g")))), lambda s: s["g"]), sep)
    lines = (cells.groupBy("var_id").agg(calls.alias("calls")).join(t.variants, "var_id"))
    names = t.geno.select("sample_id").distinct().agg(F.array_join(F.sort_array(F.collect_list("sample_id")), sep).alias("names"))
    heads = t.variants.select("chr").distinct().withColumn("names", names.scalar()).select(
        "chr", header.alias("value"), F.lit(0).alias("o"))
    return lines, heads


def _write_lines(t, lines, heads, path):
    rows = lines.unionByName(heads).repartition(F.col("chr")).sortWithinPartitions("chr", "o", "value")
    rows.select(F.col("chr").alias("c"), "value").write.partitionBy("c").text(path)


FULL = """
SELECT s.sample_id, v.var_id, g.dosage FROM (SELECT DISTINCT sample_id FROM geno) s CROSS JOIN (SELECT DISTINCT var_id FROM geno) v
LEFT JOIN geno g ON g.sample_id = s.sample_id AND g.var_id = v.var_id"""

def gt_text():
    d = F.col("dosage")
    return F.when(d.isNull(), "./.:9").when(d == 0, "0/0:30").when(d == 1, "0|1:30").otherwise("1/1:30")


VCF_HEAD = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"


def vcf(t):
    path = folder(t, "vcf")
    lines, heads = _line_files(t, "vcf", gt_text(), F.concat(F.lit(VCF_HEAD), "names"))
    body = lines.select("chr", F.concat_ws("\t", "chr", F.col("pos").cast("string"), F.when(F.col("pos") % 3000 == 0, ".").otherwise(F.col("var_id")),
                        "ref", F.concat("alt", F.lit(",T")), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT:DP"), "calls").alias("value"), F.lit(1).alias("o"))
    meta = heads.select("chr", F.lit("##fileformat=VCFv4.2").alias("value"), F.lit(-1).alias("o"))
    _write_lines(t, body.unionByName(meta), heads, path)
    return SG.read_vcf(t.spark, f"{path}/*/*.txt")


VCF_NAME = "CASE WHEN v.pos % 3000 = 0 THEN concat(v.chr, '_', CAST(v.pos AS STRING)) ELSE f.var_id END"


@query("io1_read_vcf", f"WITH f AS ({FULL}) SELECT f.sample_id, {VCF_NAME} AS var_id, f.dosage FROM f JOIN variants v ON v.var_id = f.var_id")
def _(t):
    return vcf(t)[1]


@query("io1_vcf_variants", f"SELECT {VCF_NAME} AS var_id, v.chr, v.pos, v.ref, v.alt FROM variants v JOIN (SELECT DISTINCT var_id FROM geno) f ON f.var_id = v.var_id")
def _(t):
    return vcf(t)[0]


def _renamed(prefix: str) -> str:
    return f"WITH f AS ({FULL}) SELECT sample_id, concat('{prefix}', substr(var_id, 2)) AS var_id, dosage FROM f"


def hapmap(t):
    """Marker ids rs..., tabs in some files and commas in others, a short line per file, and one file without a header."""
    path = folder(t, "hapmap")
    call = F.when(F.col("dosage").isNull(), "N").when(F.col("dosage") == 0, "AA").when(F.col("dosage") == 1, "AG").otherwise("GG")
    head = "rs#\talleles\tchrom\tpos\tstrand\tassembly\tcenter\tprotLSID\tassayLSID\tpanel\tQCcode\t"
    lines, heads = _line_files(t, "hapmap", call, F.concat(F.lit(head), "names"))
    name = F.concat(F.lit("rs"), F.substring("var_id", 2, 100))
    body = lines.select("chr", F.concat_ws("\t", name, F.concat("ref", F.lit("/"), "alt"), "chr", F.col("pos").cast("string"),
                        *[F.lit(x) for x in ("+", "NA", "NA", "NA", "NA", "NA", "NA")], "calls").alias("value"), F.lit(1).alias("o"))
    short = heads.select("chr", F.concat(F.lit("rs_short\tA/G\t"), "chr").alias("value"), F.lit(1).alias("o"))
    all_lines = body.unionByName(short).unionByName(heads)
    value = F.when(F.crc32("chr") % 2 == 0, F.replace("value", F.lit("\t"), F.lit(","))).otherwise(F.col("value"))
    all_lines = all_lines.withColumn("value", value)
    _write_lines(t, all_lines.where("o > 0"), all_lines.where("o = 0"), f"{path}/whole")
    bare = t.region.select(F.concat_ws("\t", F.lit("rs_bare"), F.col("r_regionkey").cast("string")).alias("value"))
    bare.write.text(f"{path}/bare/c=none")
    return path


@query("io2_read_hapmap", _renamed("rs"))
def _(t):
    return SG.read_hapmap(t.spark, f"{hapmap(t)}/whole/*/*.txt")[1]


@query("io2_rejected_lines", """
WITH c AS (SELECT DISTINCT v.chr FROM variants v JOIN geno g ON g.var_id = v.var_id),
s AS (SELECT concat('rs_short', chr(9), 'A/G', chr(9), chr) AS line FROM (SELECT DISTINCT chr FROM variants) z)
SELECT replace(line, ',', chr(9)) AS line, 'too few fields' AS reason FROM s
UNION ALL SELECT concat('rs_bare', chr(9), CAST(r_regionkey AS STRING)), 'no header' FROM region""")
def _(t):
    rows = SG.rejected_lines(t.spark, f"{hapmap(t)}/*/*/*.txt", *SG.HAPMAP)
    return rows.select(F.replace("line", F.lit(","), F.lit("\t")).alias("line"), "reason")


@query("io3_read_marker_matrix", f"WITH f AS ({_renamed('Marker_')}) SELECT sample_id, var_id, dosage * 1e0 AS dosage FROM f")
def _(t):
    path = folder(t, "markers")
    call = F.coalesce(F.col("dosage").cast("string"), F.lit("NA"))
    lines, heads = _line_files(t, "markers", call, F.concat(F.lit("Marker,CHROM,POS,REF,ALT,"), "names"), ",")
    name = F.concat(F.lit("Marker_"), F.substring("var_id", 2, 100))
    body = lines.select("chr", F.concat_ws(",", name, "chr", F.col("pos").cast("string"), "ref", "alt", "calls").alias("value"), F.lit(1).alias("o"))
    value = F.when(F.crc32("chr") % 2 == 0, F.replace("value", F.lit(","), F.lit(";"))).otherwise(F.col("value"))
    _write_lines(t, body.withColumn("value", value), heads.withColumn("value", value), path)
    return SG.read_marker_matrix(t.spark, f"{path}/*/*.txt")


@query("io4_read_delimited", "SELECT gbs_id, name, segment, CAST(y1 AS STRING) AS y1, y3 FROM phenos_wide")
def _(t):
    path = folder(t, "delimited")
    t.phenos_wide.select("gbs_id", "name", "segment", "y1", "y3").write.option("header", True).option("sep", ";").csv(path)
    return ST.read_delimited(t.spark, path)


@query("io5_read_tolerant", """
SELECT gbs_id, name, y1 FROM phenos_wide WHERE y1 IS NOT NULL""")
def _(t):
    path = folder(t, "tolerant")
    good = F.concat_ws(",", "gbs_id", "name", F.col("y1").cast("string"))
    line = F.when(F.col("y1").isNull(), F.concat(F.col("gbs_id"), F.lit(",torn,not a number,and,more"))).otherwise(good)
    t.phenos_wide.select(line.alias("value")).write.text(path)
    rows, _bad = ST.read_tolerant(t.spark, path, "gbs_id string, name string, y1 double", header=False)
    return rows


@query("io5_malformed_lines", "SELECT concat(gbs_id, ',torn,not a number,and,more') AS line FROM phenos_wide WHERE y1 IS NULL")
def _(t):
    path = folder(t, "malformed")
    good = F.concat_ws(",", "gbs_id", "name", F.col("y1").cast("string"))
    line = F.when(F.col("y1").isNull(), F.concat(F.col("gbs_id"), F.lit(",torn,not a number,and,more"))).otherwise(good)
    t.phenos_wide.select(line.alias("value")).write.text(path)
    return ST.read_tolerant(t.spark, path, "gbs_id string, name string, y1 double", header=False)[1].select("line")


@query("io5_headed", "SELECT gbs_id, name, y1 FROM phenos_wide WHERE y1 IS NOT NULL")
def _(t):
    path = folder(t, "headed")
    t.phenos_wide.where("y1 IS NOT NULL").select("gbs_id", "name", "y1").repartition(3).write.option("header", True).csv(path)
    return ST.read_tolerant(t.spark, path, "gbs_id string, name string, y1 double")[0]


@query("io6_pruned_read", "SELECT sample_id, var_id, dosage FROM geno WHERE var_id IN ('V0003', 'V0042', 'V0117')")
def _(t):
    path = folder(t, "pruned")
    t.geno.repartitionByRange("var_id").sortWithinPartitions("var_id").write.parquet(path)      # row groups can be skipped
    return ST.read_variants(t.spark, path, ["V0003", "V0042", "V0117"]).select("sample_id", "var_id", "dosage")


@query("io7_convert_and_compare", """
SELECT count(*) AS rows_left, count(*) AS rows_right, CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right, true AS same_columns, true AS equal FROM geno""")
def _(t):
    src, dst = folder(t, "csv"), folder(t, "parquet")
    t.geno.write.option("header", True).csv(src)
    back = ST.convert_to_parquet(t.spark, src, dst, "sample_id string, var_id string, dosage int")
    return ST.table_differences(t.geno, back)


@query("io9_read_runs", """
SELECT CASE WHEN model = 'svr' THEN 'svm' ELSE model END AS model, run_id, round(cv_r2, 6) AS cv_r2_mean,
  round(CASE seq % 3 WHEN 0 THEN 5e-2 WHEN 1 THEN 7e-2 ELSE 1e-1 END, 6) AS cv_r2_std,
  round(holdout_r2, 6) AS holdout_r2, CAST(k AS INTEGER) AS selected_k FROM runs""")
def _(t):
    path = folder(t, "runs")
    r = t.runs
    flat = r.where("seq % 3 = 0").selectExpr("raw_model AS model_name", "run_id", "cv_r2 AS cv_r2_mean", "5e-2 AS cv_r2_std", "holdout_r2", "CAST(k AS INT) AS selected_k")
    nested = r.where("seq % 3 = 1").selectExpr("named_struct('name', raw_model) AS model", "run_id AS timestamp", "named_struct('r2_mean', cv_r2, 'r2_std', 7e-2) AS cv",
                                               "named_struct('r2', holdout_r2) AS holdout", "CAST(k AS INT) AS selected_k")
    scored = r.where("seq % 3 = 2").selectExpr(
        "raw_model AS model_name", "run_id", "named_struct('r2', cv_r2) AS average_scores",
        "array(named_struct('r2', cv_r2 - 1e-1, 'best_params', named_struct('max_features', CAST(k AS INT))), named_struct('r2', cv_r2 + 1e-1, 'best_params', named_struct('max_features', CAST(k AS INT)))) AS outer_scores",
        "named_struct('r2_score', holdout_r2) AS holdout_metrics")
    for name, df in (("flat", flat), ("nested", nested), ("scored", scored)):
        df.write.json(f"{path}/{name}")
    out = SR.read_runs(t.spark, f"{path}/*")
    return round_columns(out.select("model", "run_id", "cv_r2_mean", "cv_r2_std", "holdout_r2", "selected_k"),
                         ["cv_r2_mean", "cv_r2_std", "holdout_r2"])


@query("io10_write_processed")
def _(t):
    from cohortframe.plans import preprocess as P
    tables = P.process(t.geno, t.pheno, t.variants)
    return P.write_processed(tables, folder(t, "processed"))


@query("io11_append_new_runs", """
WITH a AS (SELECT model, run_id, count(*) AS n, max(cv_r2) AS cv_r2 FROM runs GROUP BY 1, 2)
SELECT model, run_id, CASE WHEN n > 2 THEN 'first' ELSE 'second' END AS written, round(cv_r2, 6) AS cv_r2 FROM a""")
def _(t):
    path = folder(t, "guarded")
    agg = round_columns(t.runs.groupBy("model", "run_id").agg(F.count(F.lit(1)).alias("n"), F.max("cv_r2").alias("cv_r2")), ["cv_r2"])
    SR.append_new_runs(agg.where("n > 2").withColumn("written", F.lit("first")), path)
    SR.append_new_runs(agg.withColumn("written", F.lit("second")), path)
    return t.spark.read.parquet(path).select("model", "run_id", "written", "cv_r2")


@query("io11_two_writers", """
WITH a AS (SELECT model, run_id, count(*) AS n, max(cv_r2) AS cv_r2 FROM runs GROUP BY 1, 2)
SELECT model, run_id, CASE WHEN n > 2 THEN 'first' ELSE 'second' END AS written, round(cv_r2, 6) AS cv_r2, CAST(2 AS INT) AS version FROM a""")
def _(t):
    from cohortframe.sources.runtable import RunTable
    table = RunTable(t.spark, folder(t, "claimed"))
    agg = round_columns(t.runs.groupBy("model", "run_id").agg(F.count(F.lit(1)).alias("n"), F.max("cv_r2").alias("cv_r2")), ["cv_r2"])
    # both writers start from the empty table; the second loses the claim, and with it the runs of the first
    one = table.prepare(agg.where("n > 2").withColumn("written", F.lit("first")))
    two = table.prepare(agg.withColumn("written", F.lit("second")))
    table.commit(one)
    table.commit(two)
    return table.read().select("model", "run_id", "written", "cv_r2").withColumn("version", F.lit(table.version()))


@query("io12_discover", "SELECT sample_id, round(y, 6) AS y, source, context FROM synth_pheno")
def _(t):
    root = folder(t, "sets")
    # one write per file layout: folders named after the columns, then read through the path
    rows = t.synth_pheno.withColumn("y", rounded("y"))
    for source in ("model_0", "model_1", "model_2"):
        for context in "ABCDE":
            mine = rows.where((F.col("source") == source) & (F.col("context") == context))
            mine.select("sample_id", "y").coalesce(1).write.option("header", True).csv(f"{root}/{source}/context_{context}")
    return ST.discover(t.spark, root, schema="sample_id string, y double").select("sample_id", "y", "source", "context")


@query("st1_ingest_genotypes", VIEWS["geno"])
def _(t):
    land, table, ck = folder(t, "landing"), folder(t, "ingested"), folder(t, "offsets")
    t.geno.repartition(8, "var_id").write.option("header", True).csv(land)
    SJ.finish(SJ.ingest_genotypes(t.spark, land, table, ck, files_per_batch=3))
    return t.spark.read.parquet(table)


def _answers(t):
    land = folder(t, "answers")
    rows = t.responses.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("run_id")))
    rows.unionByName(rows.where("run_id % 2 = 0")).repartition(4, "run_id").write.parquet(land)     # half arrive twice
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(land)
    return stream


@query("st2_ingest_responses", f"""
WITH {LINES} SELECT run_id, concat('SYNTHETIC_', CAST(run_id AS STRING), '_', CAST(pos AS STRING)) AS sample_id,
  {_call(2)} AS V1, {_call(3)} AS V2, {_call(4)} AS V3, try_cast(trim(f[5]) AS DOUBLE) AS y FROM v""")
def _(t):
    ok, bad, ck = folder(t, "accepted"), folder(t, "rejected"), folder(t, "offsets")
    SJ.finish(SJ.ingest_responses(_answers(t), ["V1", "V2", "V3"], ok, bad, ck, delay="3000 days"))
    return t.spark.read.parquet(f"{ok}/batch=*").select("run_id", "sample_id", "V1", "V2", "V3", "y")


# answers that land years behind the mark, in a third run of the same query; those of the first two come within the delay
@query("st2_late_answers", "SELECT -run_id - 1 AS run_id, 'late' AS reason FROM responses WHERE run_id % 5 = 0")
def _(t):
    return _judged(t).where("reason = 'late'").select("run_id", "reason")


# in the second run a third of the first run's answers come again, in the third all late ones twice
@query("st2_judged_answers", """
SELECT run_id, 'accepted' AS reason, 1 AS n FROM responses
UNION ALL SELECT run_id, 'repeated', 1 FROM responses WHERE run_id % 6 = 0
UNION ALL SELECT -run_id - 1, 'late', 2 FROM responses WHERE run_id % 5 = 0""")
def _(t):
    return _judged(t).withColumn("n", F.col("n").cast("int"))


def _judged(t):
    land, ok, bad, ck = folder(t, "answers"), folder(t, "accepted"), folder(t, "rejected"), folder(t, "offsets")
    rows = t.responses.select("run_id", "text", F.timestamp_seconds(F.lit(1704067200) + F.col("run_id")).alias("ts"))
    late = rows.where("run_id % 5 = 0").select((-F.col("run_id") - 1).alias("run_id"), "text", F.timestamp_seconds(F.lit(946684800)).alias("ts"))
    for part in (rows.where("run_id % 2 = 0"), rows.where("run_id % 2 = 1 OR run_id % 6 = 0"), late.unionByName(late)):
        part.write.mode("append").parquet(land)
        stream = t.spark.readStream.schema(rows.schema).parquet(land)
        SJ.finish(SJ.ingest_responses(stream, ["V1", "V2", "V3"], ok, bad, ck, delay="3000 days"))
    return SJ.judged_answers(t.spark, ok)


@query("st3_running_summary", """
SELECT model, count(*) AS n_runs, round(avg(cv_r2), 6) AS cv_r2_mean, round(coalesce(stddev_samp(cv_r2), 0), 6) AS cv_r2_sd,
  round(avg(holdout_r2), 6) AS holdout_r2_mean, round(coalesce(stddev_samp(holdout_r2), 0), 6) AS holdout_r2_sd FROM runs GROUP BY 1""")
def _(t):
    land, path, ck = folder(t, "landing"), folder(t, "summary"), folder(t, "offsets")
    rows = t.runs.select("model", "run_id", "cv_r2", "holdout_r2")
    rows.repartition(4).write.json(land)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).json(land)
    SJ.finish(SJ.upsert_stream(SJ.running_summary(stream), path, ck, ["model"], every=2))
    out = SJ.read_latest(t.spark, path, ["model"])
    return round_columns(out, ["cv_r2_mean", "cv_r2_sd", "holdout_r2_mean", "holdout_r2_sd"])


@query("st3_event_windows", """
SELECT epoch(date_trunc('day', ts))::BIGINT AS day_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def _(t):
    path, ck = folder(t, "windows"), folder(t, "offsets")
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/event[s].parquet")
    # the files hold plain UTC times without a zone
    stream = stream.withColumn("ts", F.expr("CAST(convert_timezone('UTC', current_timezone(), ts) AS TIMESTAMP)"))
    SJ.finish(SJ.upsert_stream(SJ.windowed_counts(stream), path, ck, ["start", "event_type"]))
    out = SJ.read_latest(t.spark, path, ["start", "event_type"])
    return out.select(F.unix_timestamp("start").alias("day_start"), "event_type", "n", rounded("total", 4).alias("total"))
