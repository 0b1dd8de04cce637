"""Incremental jobs on Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cohortframe.functions.expr import one_row
from cohortframe.operators.synth import parse_responses


def ingest_genotypes(spark: SparkSession, landing: str, table: str, checkpoint: str,
                     files_per_batch: int = 100, schema: str = "sample_id string, var_id string, dosage int") -> StreamingQuery:
    """Genotype CSV files to a Parquet table as they land; each file is taken once."""
    source = (spark.readStream.schema(schema).option("header", True)
              .option("maxFilesPerTrigger", files_per_batch).csv(landing))
    return (source.writeStream.format("parquet").option("path", table)
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())


def ingest_responses(responses: DataFrame, columns: Sequence[str], accepted: str, rejected: str, checkpoint: str,
                     delay: str = "1 hour", target: str = "y") -> StreamingQuery:
    """Streaming answers (run_id, text, ts) judged and parsed as they arrive.

    The mark is the latest event time of the batches before.  An answer older than the mark less ``delay`` is ``late``; one
    whose id was accepted within the delay is ``repeated``; the first of the others by (ts, text) is ``accepted`` and
    parsed.  A null event time counts as the mark's.  Every answer is told in ``<accepted>_judged``, so nothing goes unseen,
    and the verdict depends on the batches alone, not on when the engine moves its own watermark.

    Row ids carry the answer's id, so numbering never depends on the batch.  The ids of the delay are the only state:
    each batch writes them anew from those of the batch before.  A batch overwrites its own folders when it is replayed, so
    a restart adds nothing twice.
    """
    spark, state = responses.sparkSession, f"{accepted}_state"
    wait = F.expr(f"INTERVAL {delay}")

    def write(batch: DataFrame, number: int) -> None:
        known = _newest(spark, state, number)
        mark = known.agg(F.max("ts").alias("ts")).first()["ts"] if known is not None else None
        now = batch.select("run_id", "text", F.coalesce("ts", F.lit(mark).cast("timestamp")).alias("ts"))
        edge = F.lit(mark).cast("timestamp") - wait
        late = F.col("ts") < edge
        first = now.where(~F.coalesce(late, F.lit(False))).groupBy("run_id").agg(F.min_by(F.struct("ts", "text"), F.struct("ts", "text")).alias("a"))
        if known is not None:
            first = first.join(known.where(F.col("run_id").isNotNull()).select("run_id"), "run_id", "left_anti")
        taken = first.select("run_id", "a.*")
        taken.write.mode("overwrite").parquet(f"{accepted}_taken/batch={number}")
        taken = spark.read.schema(taken.schema).parquet(f"{accepted}_taken/batch={number}")
        rows, rejects = parse_responses(taken, columns, target)
        rows = rows.withColumn("sample_id", F.concat(
            F.lit("SYNTHETIC_"), F.col("run_id").cast("string"), F.lit("_"), F.col("pos").cast("string")))
        rows.write.mode("overwrite").parquet(f"{accepted}/batch={number}")
        rejects.write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        counted = now.groupBy("run_id", F.when(late, "late").otherwise("repeated").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
        ok = taken.select("run_id", F.lit("accepted").alias("reason"), F.lit(1).cast("long").alias("n"))
        # the accepted one of an id is not its own repetition
        told = counted.unionByName(ok).groupBy("run_id").pivot("reason", ["accepted", "late", "repeated"]).agg(F.sum("n"))
        each = F.stack(F.lit(3), F.lit("accepted"), "accepted", F.lit("late"), "late", F.lit("repeated"), F.col("repeated") - F.coalesce("accepted", F.lit(0))).alias("reason", "n")
        told.select("run_id", each).where("n > 0").write.mode("overwrite").parquet(f"{accepted}_judged/batch={number}")
        seen = taken.select("run_id", "ts")
        top = now.agg(F.max("ts").alias("ts")).select(F.lit(None).cast(now.schema["run_id"].dataType).alias("run_id"), "ts")      # the mark, whoever brought it
        whole = seen.unionByName(top) if known is None else seen.unionByName(top).unionByName(known)
        latest = one_row(whole.agg(F.max("ts").alias("ts"))).getField("ts")
        whole.where("ts IS NOT NULL").where(F.col("ts") >= latest - wait).groupBy("run_id").agg(F.max("ts").alias("ts")).write.mode("overwrite").parquet(f"{state}/turn={number % 2}")

    return (responses.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _newest(spark: SparkSession, state: str, before: int) -> DataFrame | None:
    """The state of the last batch before this one; every batch writes one, into two folders in turn."""
    return spark.read.parquet(f"{state}/turn={(before - 1) % 2}") if before else None


def judged_answers(spark: SparkSession, accepted: str) -> DataFrame:
    """(run_id, reason, n): how often each answer was accepted, repeated and late."""
    rows = spark.read.option("basePath", f"{accepted}_judged").parquet(f"{accepted}_judged/batch=*")
    return rows.groupBy("run_id", "reason").agg(F.sum("n").alias("n"))


COMPACT_EVERY = 10          # batches between two bases


def upsert_stream(updates: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = (), every: int = COMPACT_EVERY) -> StreamingQuery:
    """Changed rows of a streaming aggregate, a folder per batch, and every so many batches the newest rows of all as a base.

    Rows carry their batch number, which alone decides what is newest (``read_latest``), so a folder that is already in a
    base does no harm.  Two bases are written in turn, and a batch's folder is used again only after the base that took
    it in, so there are never more than ``2 * every + 2`` folders, and a batch that is replayed finds what it found before.
    Without ``keys`` no base is written and folders are not used again.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        place = number % (2 * every) if keys else number
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/part={place}")
        if keys and number % every == every - 1:
            turn = number // every
            parts = [f"{path}/part={n % (2 * every)}" for n in range(number - every + 1, number + 1)]
            before = [f"{path}/base={(turn - 1) % 2}"] if turn else []
            _newest_rows(spark.read.parquet(*parts, *before), keys).write.mode("overwrite").parquet(f"{path}/base={turn % 2}")

    return (updates.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _newest_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("_batch")).alias("_v"))
    return newest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])


def read_latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest version of every key written by ``upsert_stream``; the folders are read as one table."""
    return _newest_rows(spark.read.parquet(f"{path}/*=*"), keys).drop("_batch")


def running_summary(runs: DataFrame) -> DataFrame:
    """Multi-seed moments per model on a stream of run records."""
    aggs = []
    for m in ("cv_r2", "holdout_r2"):
        aggs += [F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_sd")]
    return runs.groupBy("model").agg(F.count(F.lit(1)).alias("n_runs"), *aggs)


def windowed_counts(events: DataFrame, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Count and total per event type and tumbling window."""
    return (events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
            .select(F.col("w.start").alias("start"), "event_type", "n", "total"))


def finish(query: StreamingQuery) -> None:
    """Wait for an ``availableNow`` query and raise what it raised."""
    query.awaitTermination()
