"""Genotype-shaped views over the plain tables of a data folder.

Each view is one SQL text that Spark and a checking engine both run: integer
arithmetic decides every cell, so the two agree bit by bit.  Samples are
suppliers, so they grow with the data; each of 200 variants belongs to a
block of five neighbours that are inherited together.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _sid(expr: str, prefix: str = "S") -> str:
    return f"concat('{prefix}', lpad(CAST({expr} AS STRING), 9, '0'))"


def _vid(expr: str, prefix: str = "V") -> str:
    return f"concat('{prefix}', lpad(CAST({expr} AS STRING), 4, '0'))"


VIEWS: dict[str, str] = {}

# one row per genotyped cell: h varies per cell, b per (sample, block), t per block
VIEWS["cells"] = """
SELECT s, v, h, t,
       (s*s*31 + (v - v%5)*s*13 + (v - v%5)*(v - v%5)*7 + s*7) % 1009 AS b
FROM (SELECT s, v, h, 10 + ((v - v%5)*379) % 500 AS t
      FROM (SELECT l_suppkey AS s, l_partkey % 200 AS v,
                   SUM(l_partkey*7 + l_linenumber*13 + l_orderkey) % 100 AS h
            FROM lineitem GROUP BY 1, 2) AS c0) AS c1
"""

_CALL = """(CASE WHEN (b + h%90) % 1009 < t THEN 1 ELSE 0 END)
          + (CASE WHEN (b*37 + 11 + h%90) % 1009 < t THEN 1 ELSE 0 END)"""

VIEWS["geno"] = f"""
SELECT {_sid('s')} AS sample_id, {_vid('v')} AS var_id,
       CASE WHEN (h*11 + s*17 + v*29) % 100 <
                 CASE WHEN v%11 = 0 THEN 12 WHEN s%13 = 0 THEN 20 ELSE 2 END THEN NULL
            WHEN s%29 = 3 AND h%2 = 0 THEN 1
            ELSE {_CALL} END AS dosage
FROM cells
"""

VIEWS["geno_full"] = f"""
SELECT {_sid('s')} AS sample_id, {_vid('v')} AS var_id, {_CALL} AS dosage FROM cells
"""

VIEWS["variants"] = f"""
SELECT DISTINCT {_vid('p_partkey % 200')} AS var_id,
       concat('chr', CAST((p_partkey % 200 - p_partkey % 5) % 25 AS STRING)) AS chr,
       CAST((p_partkey % 200) * 1000 AS BIGINT) AS pos, 'A' AS ref, 'G' AS alt
FROM part
"""

VIEWS["pheno"] = f"""
SELECT {_sid('s_suppkey')} AS sample_id,
       CASE WHEN s_suppkey % 17 = 4 THEN NULL ELSE s_acctbal * 1e-2 END AS y
FROM supplier
"""

VIEWS["pcs"] = f"""
SELECT {_sid('s_suppkey')} AS sample_id, ((s_suppkey*37) % 101) * 1e-2 AS pc1,
       ((s_suppkey*53) % 97) * 1e-2 AS pc2
FROM supplier WHERE s_nationkey <> 3
"""

# many phenotype records per sample, in file order
VIEWS["pheno_rows"] = f"""
SELECT {_sid('l_suppkey')} AS sample_id, l_orderkey*10 + l_linenumber AS seq,
       l_extendedprice AS y
FROM lineitem
"""

VIEWS["synth"] = f"""
SELECT {_sid('s', 'SYNTHETIC_')} AS sample_id,
       CASE WHEN v%40 = 7 THEN {_vid('v', 'X')} ELSE {_vid('v')} END AS var_id,
       CASE WHEN s%4 = 1 AND h = 13 THEN NULL
            WHEN s%4 = 1 AND h = 14 THEN 3e0
            WHEN s%4 = 1 AND h = 15 THEN 1.4e0
            ELSE ((CASE WHEN (b*3 + h%90) % 1009 < t THEN 1 ELSE 0 END)
                  + (CASE WHEN (b*59 + 29 + h%90) % 1009 < t THEN 1 ELSE 0 END)) * 1e0 END AS dosage,
       concat('model_', CAST(s%3 AS STRING)) AS source,
       CASE WHEN s%5 = 0 THEN 'A' WHEN s%5 = 1 THEN 'B' WHEN s%5 = 2 THEN 'C'
            WHEN s%5 = 3 THEN 'D' ELSE 'E' END AS context
FROM cells
"""

VIEWS["synth_pheno"] = f"""
SELECT {_sid('s_suppkey', 'SYNTHETIC_')} AS sample_id,
       s_acctbal * 9e-3 + (s_suppkey % 7) AS y,
       concat('model_', CAST(s_suppkey%3 AS STRING)) AS source,
       CASE WHEN s_suppkey%5 = 0 THEN 'A' WHEN s_suppkey%5 = 1 THEN 'B'
            WHEN s_suppkey%5 = 2 THEN 'C' WHEN s_suppkey%5 = 3 THEN 'D' ELSE 'E' END AS context
FROM supplier
"""

VIEWS["phenos_wide"] = f"""
SELECT {_sid('c_custkey', 'GBS_')} AS gbs_id, c_name AS name, c_mktsegment AS segment,
       CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS y1,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal * 2e0 + c_nationkey END AS y2,
       CASE WHEN c_nationkey < 5 THEN 'n/a' ELSE CAST(c_nationkey AS STRING) END AS y3
FROM customer
"""

VIEWS["id_map"] = f"""
SELECT {_sid('s_suppkey * 12', 'GBS_')} AS gbs_id, {_sid('s_suppkey')} AS sample_id FROM supplier
"""

VIEWS["runs"] = """
SELECT o_orderkey AS seq,
       CASE WHEN o_orderpriority LIKE '1%' THEN 'RandomForest' WHEN o_orderpriority LIKE '2%' THEN 'XGB'
            WHEN o_orderpriority LIKE '3%' THEN 'lightgbm' WHEN o_orderpriority LIKE '4%' THEN 'svm'
            ELSE 'ridge' END AS raw_model,
       CASE WHEN o_orderpriority LIKE '1%' THEN 'randomforest' WHEN o_orderpriority LIKE '2%' THEN 'xgboost'
            WHEN o_orderpriority LIKE '3%' THEN 'lightgbm' WHEN o_orderpriority LIKE '4%' THEN 'svr'
            ELSE 'ridge' END AS model,
       CASE WHEN o_orderstatus = 'F' THEN 'alpha' WHEN o_orderstatus = 'O' THEN 'beta'
            ELSE 'gamma' END AS source,
       CASE WHEN o_custkey%7 = 0 THEN NULL WHEN o_custkey%7 = 1 THEN 'baseline'
            WHEN o_custkey%7 = 2 THEN 'prompt_A' WHEN o_custkey%7 = 3 THEN 'x_context_B_v2'
            WHEN o_custkey%7 = 4 THEN 'context_C' WHEN o_custkey%7 = 5 THEN 'prompt_E'
            ELSE 'other' END AS context,
       concat('run_', lpad(CAST(o_orderkey%997 AS STRING), 5, '0')) AS run_id,
       concat('synthetic_y_k', CAST(1000*(1 + o_orderkey%3) AS STRING), '_f',
              CAST(10*(o_custkey%5) AS STRING), '_s', CAST(o_custkey%3 AS STRING), '.csv') AS augment_file,
       o_custkey%3 AS seed, 1000*(1 + o_orderkey%3) AS k,
       CASE WHEN o_orderkey%4 = 0 THEN 25e-2 WHEN o_orderkey%4 = 1 THEN 5e-1 ELSE 1e0 END AS sigma,
       CASE WHEN o_custkey%6 = 5 THEN NULL ELSE 10*(o_custkey%5) END AS rate,
       100 + o_custkey%200 AS n_samples,
       floor(o_totalprice) * 2e-6 - 1e-1 AS cv_r2,
       CASE WHEN o_custkey%19 = 0 THEN NULL ELSE floor(o_totalprice) * 1e-6 + (o_orderkey%7)*1e-3 END AS holdout_r2,
       2e0 - floor(o_totalprice) * 1e-6 AS rmse, 1e0 - floor(o_totalprice) * 1e-6 AS mae
FROM orders
"""

# model answers: prose of the conversation with a CSV answer inside
VIEWS["responses"] = f"""
SELECT conv_id*1000 + turn AS run_id, concat('model_', CAST(conv_id%3 AS STRING)) AS source,
       concat(text, chr(10), 'Here is the table, as asked, with 3 markers:', chr(10), '```csv', chr(10),
              CASE WHEN conv_id%4 = 0 THEN 'id,m1,m2,m3,target' ELSE 'Sample_ID,V1,V2,V3,y' END, chr(10),
              'SYNTH_', CAST(turn AS STRING), 'a,', CAST(conv_id%3 AS STRING), ',', CAST(turn%3 AS STRING), ',1,',
              CAST(conv_id%50 AS STRING), '.5', chr(10),
              'SYNTH_', CAST(turn AS STRING), 'b,', CAST(conv_id%4 AS STRING), ',bad,2.6,',
              CAST(turn AS STRING), chr(10),
              '1. SYNTH_x,1,1,1,1', chr(10), 'SYNTH_y,1,1...', chr(10), 'SYNTH_z,0,1,2', chr(10), '```') AS text
FROM conversations WHERE role = 'assistant'
"""

VIEWS["vectors"] = """
SELECT concat(CASE WHEN label%2 = 0 THEN 'R' ELSE 'SYNTHETIC_' END, CAST(vec_id AS STRING)) AS sample_id,
       CASE WHEN label%2 = 0 THEN 'real' ELSE 'synthetic' END AS origin,
       embedding AS features, label * 1e0 AS y
FROM embeddings
"""


def _uses(sql: str, name: str) -> bool:
    return re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql, re.I) is not None


def _needed(sql: str) -> list[str]:
    """Views a text reads, directly or through another view, in definition order."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name, body in VIEWS.items():
            if name not in found and _uses(text, name):
                found.add(name)
                todo.append(body)
    return [v for v in VIEWS if v in found]


def with_views(sql: str) -> str:
    """The statement with the views it reads put in front as a WITH list."""
    heads = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in _needed(sql))
    sql = sql.strip()
    if not heads:
        return sql
    if sql.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {heads},\n{sql[len('WITH RECURSIVE'):]}"
    if sql.upper().startswith("WITH"):
        return f"WITH {heads},\n{sql[4:]}"
    return f"WITH {heads}\n{sql}"


class Tables:
    """Plain tables and derived views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, str(sf_dir).rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        """Run a text over plain tables and views, without naming anything in the session."""
        used = {}
        for name in (*VIEWS, *TABLES):
            if _uses(text, name):
                used[name] = self.view(name) if name in VIEWS else self.table(name)
                text = re.sub(rf"\b(FROM|JOIN)\s+{name}\b", rf"\1 {{{name}}}", text, flags=re.I)
        return self.spark.sql(text, **used)

    def view(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self.sql(VIEWS[name])
        return self._made[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(name)
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    @cached_property
    def imputed(self) -> DataFrame:
        from cohortframe.operators.impute import impute_mode
        return impute_mode(self.geno)
