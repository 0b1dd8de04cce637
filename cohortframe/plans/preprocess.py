"""Raw genotypes and phenotypes to a processed, aligned set of tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.operators import qc
from cohortframe.operators.impute import impute_mode
from cohortframe.operators.latent import impute_knn, pca, standard_cells
from cohortframe.session import cut_lineage, measured


@dataclass
class Settings:
    max_missing: float = 0.05
    min_maf: float = 0.05
    max_sample_missing: float = 0.10
    het_k: float = 3.0
    het_dialect: str = "passers_clamped"
    min_hwe_p: float | None = None
    imputation: str = "mode"
    components: int = 5


def process(geno: DataFrame, pheno: DataFrame, variants: DataFrame, settings: Settings | None = None) -> Mapping[str, DataFrame]:
    """Tables X, y, pcs, manifest, sample_map and qc_report of one dataset.

    The cells and the filtered cells are written out once, because filters and
    report, imputation, components and alignment all read them.
    """
    s = settings or Settings()
    geno = cut_lineage(geno)
    kept_v = qc.filter_variants(geno, s.max_missing, s.min_maf, s.min_hwe_p)
    judged = qc.judge_samples(qc.sample_stats(kept_v), s.max_sample_missing, s.het_k, s.het_dialect)
    judged = cut_lineage(judged)
    good = measured(judged.where("verdict = 'pass'").select("sample_id"))
    clean = cut_lineage(kept_v.join(good, "sample_id", "left_semi"))
    x = cut_lineage(impute_knn(clean) if s.imputation == "knn" else impute_mode(clean))
    parts = pca(standard_cells(x), s.components)
    y = pheno.where(F.col("y").isNotNull()).join(good, "sample_id", "left_semi")
    report = qc.qc_report(geno, s.max_missing, s.min_maf, s.max_sample_missing, s.het_k, s.het_dialect)
    shares = geno.sparkSession.createDataFrame(
        [(f"pc{i + 1}_variance", float(v)) for i, v in enumerate(parts.explained)], "metric string, value double")
    return {
        "X": x, "y": y, "pcs": parts.scores,
        "manifest": variants.join(x.select("var_id").distinct(), "var_id", "left_semi"),
        "sample_map": qc.sample_map(judged), "qc_report": report.unionByName(shares),
    }


def write_processed(tables: Mapping[str, DataFrame], folder: str, mode: str = "errorifexists") -> DataFrame:
    """One Parquet table per name; returns (table, n_rows) read back from the files."""
    spark = next(iter(tables.values())).sparkSession
    out = None
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{folder}/{name}")
        row = spark.read.parquet(f"{folder}/{name}").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("table", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.select("table", "n_rows")
