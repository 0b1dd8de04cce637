"""Readers of genotype text files.  All of them return long tables.

A file line holds one variant and every sample.  It is split in the task that
read it and zipped with its file's sample names, so cells are never shuffled to
find out whose they are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortframe.functions.encoding import META_LABELS, generic_dosage, iupac_dosage, vcf_dosage
from cohortframe.session import cut_lineage

MAX_BROADCAST_NAMES = 2_000_000     # sample names over all distinct headers, about 50 MB
MAX_BROADCAST_FILES = 500_000       # files, a path and a header's number each
DELIMITERS = ("\t", ",", ";")


def best_delimiter(line: str, delimiters: Sequence[str] = DELIMITERS) -> str:
    """The delimiter that cuts the line into most fields."""
    return max(delimiters, key=lambda d: line.count(d))


def _most_frequent(line: Column) -> Column:
    """The delimiter that cuts a line into most fields; the first of those that tie."""
    counts = [F.length(line) - F.length(F.replace(line, F.lit(d), F.lit(""))) for d in DELIMITERS]
    most = F.greatest(*counts)
    return F.coalesce(*[F.when(c == most, F.lit(d)) for c, d in zip(counts, DELIMITERS)])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are not empty and not ``##`` comments, with their file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return lines.where((F.trim("value") != "") & ~F.startswith("value", F.lit("##")))


def _is_header(names: Sequence[str]) -> Column:
    """Whether the whole first field is one of ``names``, case ignored."""
    field = F.regexp_extract(F.lower("value"), r'^"?([^\t,;"]*)"?(?:[\t,;]|$)', 1)
    return field.isin(*[n.lower() for n in names])


def _judged(lines: DataFrame, header: Sequence[str], first: int, sep: str | None = None) -> DataFrame:
    """Data lines as (file, value, fields, names, reason); names and delimiter come from the header line of the same file.

    ``reason`` is null for lines that fit; others have no header in their file, fewer fields than the ``first``
    leading ones, or more fields than the header.
    """
    is_header = _is_header(header)
    heads = lines.where(is_header).groupBy("file").agg(F.min("value").alias("_h"))
    heads = cut_lineage(heads.withColumn("_id", F.xxhash64("_h")))
    # chromosome files of one cohort share a header: its names are kept once, files only point to it
    cut = F.lit(sep) if sep else _most_frequent(F.col("_h"))
    texts = heads.groupBy("_id").agg(F.min("_h").alias("_h")).withColumn("_sep", cut)
    texts = cut_lineage(texts.select("_id", "_sep", F.size(F.split("_h", F.col("_sep"))).alias("_width"),
                                     F.slice(F.split("_h", F.col("_sep")), first + 1, 1 << 30).alias("names")))
    total = texts.agg(F.sum("_width").alias("n")).first().n or 0
    files = heads.select("file", "_id")
    files = F.broadcast(files) if files.count() <= MAX_BROADCAST_FILES else files
    texts = F.broadcast(texts) if total <= MAX_BROADCAST_NAMES else texts
    data = lines.where(~is_header).join(files, "file", "left").join(texts, "_id", "left")
    fields = F.split("value", F.coalesce("_sep", F.lit("\t")))
    reason = (F.when(F.col("_id").isNull(), "no header").when(F.size("fields") < first, "too few fields")
              .when(F.size("fields") > F.col("_width"), "too many fields"))
    return data.withColumn("fields", fields).withColumn("reason", reason).select("file", "value", "fields", "names", "reason")


def _fitting(lines: DataFrame, header: Sequence[str], first: int, sep: str | None = None) -> DataFrame:
    """The lines that fit.  A file without a header fails the job; other unfit lines are listed by ``rejected_lines``."""
    stop = F.raise_error(F.concat(F.lit("no header line found in "), F.col("file"))).cast("boolean")
    rows = _judged(lines, header, first, sep)
    return rows.where(F.when(F.col("reason") == "no header", stop).otherwise(F.col("reason").isNull()))


def _cells(rows: DataFrame, keys: Sequence[Column], first: int, dosage: Callable[[Column], Column]) -> DataFrame:
    pairs = F.arrays_zip(F.col("names").alias("s"), F.slice("fields", first + 1, 1 << 30).alias("g"))
    # keys first: a key taken from ``fields`` afterwards would put the whole line into every cell's row
    return rows.select(*keys, pairs.alias("_p")).select("var_id", F.explode("_p").alias("_c")).select(
        F.trim(F.col("_c.s")).alias("sample_id"), "var_id", dosage(F.col("_c.g")).alias("dosage"))


# First field of the header line, leading columns and delimiter of each layout.
VCF, HAPMAP = (("#CHROM",), 9, "\t"), (("rs#", "rs"), 11, None)


def rejected_lines(spark: SparkSession, path: str, header: Sequence[str], first: int, sep: str | None = None) -> DataFrame:
    """(file, line, reason) of the lines that a reader with this header leaves out."""
    rows = _judged(_lines(spark, path), header, first, sep)
    return rows.where(F.col("reason").isNotNull()).select("file", F.col("value").alias("line"), "reason")


def read_vcf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(variants, geno) of VCF files: first ALT allele, GT as the first field, ID '.' named chr_pos."""
    rows = _fitting(_lines(spark, path), *VCF)
    f = F.col("fields")
    pos = f[1].cast("long")
    var = F.when(f[2] == ".", F.concat(f[0], F.lit("_"), f[1])).otherwise(f[2]).alias("var_id")
    variants = rows.select(var, f[0].alias("chr"), pos.alias("pos"), f[3].alias("ref"), F.when(
        f[4] == ".", "").otherwise(F.split(f[4], ",")[0]).alias("alt"))
    return variants, _cells(rows, [var], 9, lambda g: vcf_dosage(F.split(g, ":")[0]))


def read_hapmap(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(variants, geno) of HapMap files: 11 leading columns, alleles written ``A/G``; any marker id, ``rs123`` too."""
    rows = _fitting(_lines(spark, path), *HAPMAP)
    f = F.col("fields")
    alleles = F.split(f[1], "/")
    var = f[0].alias("var_id")
    variants = rows.select(var, f[2].alias("chr"), f[3].cast("long").alias("pos"),
                           alleles[0].alias("ref"), F.coalesce(F.get(alleles, 1), F.lit("")).alias("alt"))
    return variants, _cells(rows, [var], 11, iupac_dosage)


def read_marker_matrix(spark: SparkSession, path: str, header: str = "Marker") -> DataFrame:
    """geno of a marker x sample matrix; metadata columns are dropped."""
    rows = _fitting(_lines(spark, path), (header,), 1)
    cells = _cells(rows, [F.col("fields")[0].alias("var_id")], 1, generic_dosage)
    return cells.where(~F.upper("sample_id").isin(*META_LABELS))


def read_sample_matrix(spark: SparkSession, path: str, header: str = "Sample_ID") -> DataFrame:
    """geno of a sample x variant matrix (one line per sample)."""
    rows = _fitting(_lines(spark, path), (header,), 1)
    turned = _cells(rows, [F.col("fields")[0].alias("var_id")], 1, generic_dosage)
    return turned.select(F.col("var_id").alias("sample_id"), F.col("sample_id").alias("var_id"), "dosage")


def matrix_to_long(wide: DataFrame, id_column: str, drop: Sequence[str] = META_LABELS) -> DataFrame:
    """Unpivot a DataFrame of modest width; metadata columns are left out."""
    cols = [c for c in wide.columns if c != id_column and c.upper() not in drop]
    return wide.select(F.col(id_column).alias("var_id"), *[generic_dosage(F.col(c).cast("string")).alias(c) for c in cols]) \
               .unpivot("var_id", cols, "sample_id", "dosage")
