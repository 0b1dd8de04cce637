"""Joins and set operations that bring genotype, phenotype and covariate ids together."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortframe.functions.encoding import try_double
from cohortframe.functions.expr import first_by, one_row, safe_div
from cohortframe.operators.impute import align_to_variants
from cohortframe.operators.profile import as_long
from cohortframe.operators.ranking import ranked
from cohortframe.session import cut_lineage, measured

# Header texts that name an id column.
ID_TOKENS = ("IID", "Taxa", "Genotype", "ID", "Sample", "Accession", "Accession_ID", "Variety",
             "Line", "Name")


def align_samples(geno: DataFrame, pheno_rows: DataFrame, pcs: DataFrame | None = None,
                  order: Sequence[str] = ("seq",)) -> DataFrame:
    """Samples present in all tables, one row each, first phenotype record on repeats."""
    first = first_by(pheno_rows, ["sample_id"], [F.col(c) for c in order]).drop("seq")
    out = first.join(geno.select("sample_id").distinct(), "sample_id")
    return out if pcs is None else out.join(pcs, "sample_id")


def attach_target(samples: DataFrame, pheno: DataFrame, keep_null: bool = False) -> DataFrame:
    """Every sample row with its target; rows without one are masked out."""
    out = samples.join(pheno, "sample_id", "left")
    return out if keep_null else out.where(F.col("y").isNotNull())


def map_ids(pheno: DataFrame, id_map: DataFrame, key: str) -> DataFrame:
    """Phenotype rows re-keyed through a two-column map; unmapped rows are dropped."""
    return (pheno.join(id_map, key, "left").where(F.col("sample_id").isNotNull()))


def zip_by_position(left: DataFrame, right: DataFrame, left_order: Sequence[str],
                    right_order: Sequence[str]) -> DataFrame:
    """i-th row of one table with the i-th of the other, in the given orders."""
    a = ranked(left, left_order, name="position")
    b = ranked(right, right_order, name="position")
    return a.join(b, "position")


def fuzzy_match(samples: DataFrame, phenos: DataFrame, key: str, min_length: int = 5) -> DataFrame:
    """(sample_id, part, key): the first id part that occurs in exactly one phenotype id.

    "Occurs in" is a substring test.  All substrings of a phenotype id whose
    length equals that of some part are written out, in as many tasks as a
    shuffle has; those that are no part go before anything is sorted.  Of the
    others, only those seen in a single phenotype row survive, so the equi-join
    emits at most one row per part however common a fragment is.
    """
    parts = (samples.select("sample_id", F.posexplode(F.split("sample_id", "_")).alias("pos", "part"))
             .where(F.length("part") >= min_length))
    parts = cut_lineage(parts)                          # read three times
    wanted = measured(parts.select("part").distinct())
    lengths = one_row(parts.agg(F.collect_set(F.length("part")).alias("l"))).getField("l")
    spread = phenos.select(F.col(key).alias("_id")).repartition(int(phenos.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spans = (spread.select("_id", F.explode(lengths).alias("_l"))
             .where(F.length("_id") >= F.col("_l")))
    grams = spans.select("_id", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length("_id") - F.col("_l") + 1),
        lambda i: F.substring(F.col("_id"), i, F.col("_l"))))).alias("part")).join(wanted, "part", "left_semi")
    single = (grams.groupBy("part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias(key))
              .where("_n = 1").drop("_n"))
    hits = parts.join(single, "part")
    return first_by(hits, ["sample_id"], [F.col("pos")]).select("sample_id", "part", key)


def discover_join_column(phenos: DataFrame, columns: Sequence[str], samples: DataFrame) -> DataFrame:
    """Per phenotype column, how many of its values are sample ids; the first with any is chosen."""
    ids = samples.select(F.col("sample_id").alias("v")).distinct()
    found = (as_long(phenos, columns).where(F.col("v").isNotNull()).distinct()
             .join(ids, "v", "left_semi").groupBy("col").agg(F.count(F.lit(1)).alias("n_common")))
    names = phenos.sparkSession.createDataFrame(
        [(c, i) for i, c in enumerate(columns)], "col string, position int")
    all_cols = names.join(found, "col", "left").fillna(0, ["n_common"])
    first = one_row(all_cols.agg(F.min(F.when(F.col("n_common") > 0, F.col("position"))).alias("p")))
    return all_cols.withColumn("chosen", F.coalesce(F.col("position") == first.getField("p"), F.lit(False)))


def profile_join_keys(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Every pair of id columns of different tables that share values, best first.

    Values are trimmed, lower-cased and made distinct first, so one value has
    at most as many rows as there are id columns.
    """
    long = reduce(DataFrame.unionByName, [
        as_long(df, cols).select(F.lit(i).alias("t"), F.lit(name).alias("tbl"), "col",
                                 F.lower(F.trim("v")).alias("v"))
        for i, (name, (df, cols)) in enumerate(tables.items())])
    values = long.where(F.col("v") != "").distinct()
    sizes = values.groupBy("tbl", "col").agg(F.count(F.lit(1)).alias("n"))
    a = values.select("t", F.col("tbl").alias("table1"), F.col("col").alias("column1"), "v")
    b = values.select(F.col("t").alias("t2"), F.col("tbl").alias("table2"), F.col("col").alias("column2"), "v")
    common = (a.join(b, "v").where(F.col("t") < F.col("t2"))
              .groupBy("table1", "column1", "table2", "column2").agg(F.count(F.lit(1)).alias("n_common")))
    for side in ("1", "2"):
        named = sizes.toDF(f"table{side}", f"column{side}", f"n{side}")
        common = common.join(named, [f"table{side}", f"column{side}"])
    return (common.withColumn("coverage1", safe_div("n_common", "n1"))
            .withColumn("coverage2", safe_div("n_common", "n2"))
            .withColumn("score", F.col("coverage1") + F.col("coverage2")))


def top_join_keys(profile: DataFrame, k: int = 3) -> DataFrame:
    """The k best column pairs of each table pair (the profile has one row per column pair)."""
    w = W.partitionBy("table1", "table2").orderBy(F.desc("score"), "column1", "column2")
    return profile.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def is_id_header(name: str) -> bool:
    """Whether the header, or a run of its words, is one of the id names; ``y`` and ``kidney`` are not."""
    words = _header_words(name)
    runs = {"".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)}
    return any("".join(_header_words(token)) in runs for token in ID_TOKENS)


def _header_words(name: str) -> list[str]:
    """Words of a header: cut at signs and where a capital follows a small letter."""
    return re.findall("[a-z]+|[0-9]+", re.sub("([a-z])([A-Z])", r"\1 \2", name).lower())


def detect_columns(df: DataFrame, min_numeric: int = 5) -> DataFrame:
    """Role of each column: id by its header, target by its numeric rows; targets ranked by their share of numeric rows."""
    ids = [c for c in df.columns if is_id_header(c)]
    rows = as_long(df, df.columns)
    out = rows.groupBy("col").agg(F.count(try_double("v")).alias("n_numeric"),
                                  F.count(F.lit(1)).alias("n_rows"))
    role = (F.when(F.col("col").isin(*ids), "id") if ids else F.when(F.lit(False), "id"))
    judged = (out.withColumn("numeric_ratio", safe_div("n_numeric", "n_rows"))
              .withColumn("role", role.when(F.col("n_numeric") >= min_numeric, "target").otherwise("other")))
    best = W.partitionBy("role").orderBy(F.desc("numeric_ratio"), "col")         # a row per column
    return judged.withColumn("target_rank", F.when(F.col("role") == "target", F.row_number().over(best)))


def presence(tables: Mapping[str, DataFrame], key: str = "sample_id") -> DataFrame:
    """One row per id with a flag per table: one aggregate instead of chained outer joins."""
    names = list(tables)
    rows = reduce(DataFrame.unionByName, [
        df.select(F.col(key), F.lit(n).alias("_t")) for n, df in tables.items()])
    return rows.groupBy(key).agg(*[F.bool_or(F.col("_t") == n).alias(f"in_{n}") for n in names])


def overlap_audit(tables: Mapping[str, DataFrame], key: str = "sample_id") -> DataFrame:
    """Common ids, ids per table, ids outside the common set, overlap = common / largest."""
    flags = presence(tables, key)
    names = list(tables)
    both = reduce(Column.__and__, [F.col(f"in_{n}") for n in names])
    agg = flags.agg(
        F.count_if(both).alias("common"),
        *[F.count_if(f"in_{n}").alias(f"n_{n}") for n in names],
        *[F.count_if(F.col(f"in_{n}") & ~both).alias(f"only_{n}") for n in names],
        F.count_if(~both).alias("not_in_all"))
    largest = F.greatest(*[F.col(f"n_{n}") for n in names])
    return agg.withColumn("overlap", safe_div("common", largest))


def mapped_overlap(x: DataFrame, y: DataFrame, id_map: DataFrame) -> DataFrame:
    """Overlap of genotype and phenotype ids, through the sample map when none agree directly."""
    direct = x.select("sample_id").distinct()
    mapped = direct.join(id_map, "sample_id").select(F.col("gbs_id").alias("sample_id")).distinct()
    plain = overlap_audit({"x": direct, "y": y}).select("common", "n_x", "n_y")
    via = overlap_audit({"x": mapped, "y": y}).select(F.col("common").alias("common"))
    p, v = one_row(plain), one_row(via)
    base = x.sparkSession.range(1).select(p.alias("p"), v.alias("v"))
    common = F.when(F.col("p.common") > 0, F.col("p.common")).otherwise(F.col("v.common"))
    return base.select(
        common.alias("common"), F.col("p.n_x").alias("n_x"), F.col("p.n_y").alias("n_y"),
        (F.col("p.common") == 0).alias("used_map"),
        safe_div(common, F.greatest("p.n_x", "p.n_y")).alias("overlap"))


def shared_variants(a: DataFrame, b: DataFrame) -> DataFrame:
    """Variants present on both sides."""
    return a.select("var_id").distinct().join(b.select("var_id").distinct(), "var_id", "left_semi")


def keep_ids(df: DataFrame, ids: DataFrame, key: str = "sample_id", inside: bool = True) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi" if inside else "left_anti")


def union_real_first(real: DataFrame, parts: Mapping[str, DataFrame]) -> DataFrame:
    """Real and synthetic rows over the real variants; an id belongs to its first table.

    Cells a synthetic table lacks are 0, its extra variants are dropped.
    """
    cols = ["sample_id", "var_id", "dosage"]
    rows = real.select(*cols).withColumn("_o", F.lit(0)).withColumn("origin", F.lit("real"))
    for i, (name, df) in enumerate(parts.items()):
        rows = rows.unionByName(df.select(*cols).withColumn("_o", F.lit(i + 1))
                                .withColumn("origin", F.lit(name)))
    owner = rows.groupBy("sample_id").agg(
        F.min(F.struct("_o", "origin")).alias("_w")).select(
        "sample_id", F.col("_w._o").alias("_own"), F.col("_w.origin").alias("origin"))
    own_rows = rows.drop("origin").join(owner.drop("origin"), "sample_id").where("_o = _own")
    filled = align_to_variants(own_rows.select(*cols), variants=real)
    return filled.join(owner.select("sample_id", "origin"), "sample_id")


def set_algebra(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row per id: in both, left only or right only (a single aggregate)."""
    flags = presence({"a": a, "b": b}, key)
    return flags.select(key, F.when(F.col("in_a") & F.col("in_b"), "both")
                        .when(F.col("in_a"), "left_only").otherwise("right_only").alias("side"))


def preprocessing_status(found: DataFrame, expected: Sequence[str]) -> DataFrame:
    """(dataset, n_present, status) from a table of (dataset, file) that exist."""
    n = F.count_distinct(F.when(F.col("file").isin(*expected), F.col("file")))
    return found.groupBy("dataset").agg(n.alias("n_present")).withColumn(
        "status", F.when(F.col("n_present") == len(expected), "Complete")
        .when(F.col("n_present") > 0, "Partial").otherwise("Incomplete"))


def duplicate_ids(tables: Mapping[str, DataFrame], key: str = "sample_id") -> DataFrame:
    """Rows and repeated ids per table."""
    rows = reduce(DataFrame.unionByName, [
        df.select(F.lit(n).alias("tbl"), F.col(key).cast("string").alias("k")) for n, df in tables.items()])
    per = rows.groupBy("tbl", "k").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("tbl").agg(F.sum("n").alias("n_rows"),
                                  (F.sum("n") - F.count(F.lit(1))).alias("n_duplicates"))


def numeric_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of columns without a single number, and the verdict (< 5 % passes)."""
    per = as_long(df, columns).groupBy("col").agg(F.count(try_double("v")).alias("n"))
    return per.agg(F.count_if(F.col("n") == 0).alias("n_non_numeric"), F.count(F.lit(1)).alias("n_columns"),
                   safe_div(F.count_if(F.col("n") == 0), F.count(F.lit(1))).alias("non_numeric_ratio")) \
              .withColumn("ok", F.col("non_numeric_ratio") < 0.05)
