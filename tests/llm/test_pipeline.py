"""The pipeline stage by stage against brute force, and the registered queries against their SQL."""

import os
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check import canon
from cohortframe.fixtures import TABLES
from cohortframe.llm import quality, queries
from cohortframe.llm.common import stored, table

from . import test_decontam, test_jaccard, test_packing
from .test_packing import tokenizer  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not found")


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_stages_equal_brute_force(spark, tokenizer):  # noqa: F811
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    # a null text, an empty one, copies and a row that repeats
    more = spark.createDataFrame([(9000, None, None, None, None), (9001, "", "en", "s", 0), (9002, docs.first().text, "en", "s", 1), (9002, docs.first().text, "en", "s", 1)], docs.schema)
    docs = docs.unionByName(more)
    rows = Counter(rows_of(docs))
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality_classifier", "exact_dedup", "near_dedup", "decontamination", "best_fit_packing"]

    out = stored(steps["quality_classifier"](spark, docs, FOLDER), "t")
    model = quality.fit_quality(docs, table(spark, FOLDER, "labels"))
    good = {r.doc_id for r in quality.quality_scores(docs, model).where("predicted = 1").collect()}
    assert out.columns == columns and Counter(rows_of(out)) == Counter({r: n for r, n in rows.items() if r[0] in good})

    rows = rows_of(out)
    out = stored(steps["exact_dedup"](spark, out, FOLDER), "t")
    least = {}
    for d, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        least[norm] = min(d, least.get(norm, d))
    assert out.columns == columns and Counter(d for d, _ in rows_of(out)) == Counter(least.values())

    rows = rows_of(out)
    out = stored(steps["near_dedup"](spark, out, FOLDER), "t")
    component = {d: c for (d, _, c) in test_jaccard.brute(rows)[0]}
    assert out.columns == columns and sorted(d for d, _ in rows_of(out)) == sorted(d for d, _ in rows if component[d] == d)

    rows = rows_of(out)
    out = stored(steps["decontamination"](spark, out, FOLDER), "t")
    leaky = {d for d, _ in test_decontam.brute(rows, [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()])}
    assert leaky and out.columns == columns and sorted(d for d, _ in rows_of(out)) == sorted(d for d, _ in rows if d not in leaky)

    packed = steps["best_fit_packing"](spark, out, FOLDER)
    bins, total = test_packing.check(packed.collect(), rows_of(out), tokenizer, 2048)
    assert bins <= total / 2048 * 1.001 + 2


def test_run_is_its_stages_and_empty_documents_pass(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, FOLDER, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_registered():
    assert [re.match(r"op(\d+)_|pipeline", q)[1] for q in queries.QUERIES] == [*map(str, range(1, 14)), None]
    assert set(queries.CHECKS) <= set(queries.QUERIES) <= set(entry.queries()) and set(queries.CHECKS) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    df = queries.QUERIES[name](spark, FOLDER)
    cur = con.execute(queries.CHECKS[name])
    got, want = canon(df.columns, df.collect()), canon([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0] and repr(got[1]) == repr(want[1])
