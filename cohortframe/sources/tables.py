"""Delimited and Parquet tables: reading, converting, comparing, discovering."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortframe.session import cut_lineage
from cohortframe.sources.genotypes import DELIMITERS, MAX_BROADCAST_FILES, best_delimiter

# Id columns by priority.
ID_COLUMNS = ("Sample_ID", "IID")


def _first_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, head): the first line of every file that has one."""
    lines = spark.read.text(path)
    files = lines.inputFiles()
    if len(files) == 1:                     # a look at one line in place of a pass over all
        return lines.limit(1).select(F.lit(files[0]).alias("file"), F.col("value").alias("head"))
    at = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"),
                      F.monotonically_increasing_id().alias("_i"))
    return at.where("_b = 0").groupBy("file").agg(F.min_by("value", "_i").alias("head"))


def read_delimited(spark: SparkSession, path: str, delimiters: Sequence[str] = DELIMITERS,
                   schema: StructType | str | None = None) -> DataFrame:
    """Headed text tables whose delimiters are found from their first lines; columns are text by default.

    Files of one path may differ in delimiter and header: those with the same first line are read together, columns meet by
    name, and one that a file does not have is null in its rows.  With a ``schema`` only delimiters may differ.
    """
    heads = cut_lineage(_first_lines(spark, path))
    kinds = [r.head for r in heads.select("head").distinct().orderBy("head").collect()]       # a header line each
    if not kinds:
        raise ValueError(f"{path} is empty")

    def read(kind: str, files: str | list[str]) -> DataFrame:
        reader = spark.read.option("header", True).option("sep", best_delimiter(kind, delimiters))
        return (reader.schema(schema) if schema is not None else reader).csv(files)

    if len(kinds) == 1:
        return read(kinds[0], path)
    parts = [read(k, [r.file for r in heads.where(F.col("head") == k).select("file").collect()]) for k in kinds]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_tolerant(spark: SparkSession, path: str, schema: str, sep: str = ",",
                  header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed lines): lines that do not fit the schema are set apart, not lost.

    With ``header`` the line at the very start of each file is left out, whatever it says; no other line is.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.lit(False).alias("_first"))
    if header:
        # a read by whole files would not split them; the start of a file is the start of its first block
        block = F.col("_metadata.file_block_start")
        tagged = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), block.alias("_b"), F.monotonically_increasing_id().alias("_i"))
        starts = tagged.where("_b = 0").groupBy("file").agg(F.min("_i").alias("_s"))
        lines = tagged.join(F.broadcast(starts) if starts.count() <= MAX_BROADCAST_FILES else starts, "file").select(
            "value", "file", (F.col("_i") == F.col("_s")).alias("_first"))
    lines = lines.where(~F.col("_first")).drop("_first")
    options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    both = lines.select("file", F.from_csv("value", f"{schema}, _bad string", options).alias("_r"))
    bad = F.col("_r._bad").isNotNull()
    return (both.where(~bad).select("_r.*").drop("_bad"),
            both.where(bad).select("file", F.col("_r._bad").alias("line")))


def id_column(columns: Sequence[str]) -> str:
    """The id column by name, else the first column."""
    return next((c for c in ID_COLUMNS if c in columns), columns[0])


def with_string_id(df: DataFrame) -> DataFrame:
    """The detected id column as text ``sample_id``."""
    name = id_column(df.columns)
    return df.select(F.col(name).cast("string").alias("sample_id"), *[c for c in df.columns if c != name])


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Only the wanted columns of a wide Parquet table; the rest is not read."""
    df = spark.read.parquet(path)
    name = id_column(df.columns)
    return df.select(name, *[c for c in columns if c in df.columns and c != name])


def read_variants(spark: SparkSession, path: str, var_ids: Sequence[str]) -> DataFrame:
    """The cells of some variants of a long Parquet table; the filter reaches the scan."""
    return spark.read.parquet(path).where(F.col("var_id").isin(*var_ids))


def convert_to_parquet(spark: SparkSession, source: str, target: str, schema: str, sep: str = ",",
                       mode: str = "errorifexists") -> DataFrame:
    """CSV to Parquet; returns the table read back."""
    rows = spark.read.option("header", True).option("sep", sep).schema(schema).csv(source)
    rows.write.mode(mode).option("compression", "snappy").parquet(target)
    return spark.read.parquet(target)


def table_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: counts of both tables and rows that only one of them has, repeats counted.

    A signed count per distinct row: one shuffle, combined map-side.
    """
    cols = a.columns
    rows = a.withColumn("_s", F.lit(1)).unionByName(b.select(*cols).withColumn("_s", F.lit(-1)))
    per = rows.groupBy(*cols).agg(F.sum("_s").alias("_d"), F.sum(F.abs("_s") + F.col("_s")).alias("_a"),
                                  F.count(F.lit(1)).alias("_n"))
    out = per.agg((F.coalesce(F.sum("_a"), F.lit(0)) / 2).cast("long").alias("rows_left"),
                  (F.coalesce(F.sum("_n"), F.lit(0)) - F.coalesce(F.sum("_a"), F.lit(0)) / 2).cast("long").alias("rows_right"),
                  F.coalesce(F.sum(F.greatest(F.col("_d"), F.lit(0))), F.lit(0)).alias("only_left"),
                  F.coalesce(F.sum(F.greatest(-F.col("_d"), F.lit(0))), F.lit(0)).alias("only_right"))
    return out.withColumn("same_columns", F.lit(sorted(a.columns) == sorted(b.columns))).withColumn(
        "equal", (F.col("only_left") == 0) & (F.col("only_right") == 0) & F.col("same_columns"))


def discover(spark: SparkSession, root: str, pattern: str = "*/context_*/*.csv", schema: str | None = None) -> DataFrame:
    """Rows of files laid out ``source/context_X/file`` with source and context from the path."""
    reader = spark.read.option("header", True)
    rows = (reader.schema(schema) if schema else reader).csv(f"{root.rstrip('/')}/{pattern}")
    parts = F.split(F.col("_metadata.file_path"), "/")
    return rows.select("*", F.element_at(parts, -3).alias("source"),
                       F.regexp_extract(F.element_at(parts, -2), "context_(.+)$", 1).alias("context"))


def dataset_files(spark: SparkSession, root: str, pattern: str = "*/*") -> DataFrame:
    """(dataset, file, bytes) of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{pattern}").select("path", "length")
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("dataset"), F.element_at(parts, -1).alias("file"),
                        F.col("length").alias("bytes"))
