import zlib

import numpy as np
import pytest

from cohortframe.llm import quality

from .conftest import text_of


def corpus(n):
    good = [(i, text_of(i, 40 + i % 50) + ".") for i in range(n)]
    bad = [(n + i, " ".join(w.upper() + "!!" for w in text_of(n + i, 30 + i % 40).split())) for i in range(n // 2)]
    return good, bad


@pytest.fixture(scope="module")
def fitted(spark, docs_of):
    good, bad = corpus(300)
    docs = docs_of(good + bad)
    labels = spark.createDataFrame([(d, 1) for d, _ in good] + [(d, 0) for d, _ in bad] + [(None, 1), (5, None), (7, 1), (10**6, 0)], "doc_id long, quality int")
    return docs, labels, quality.fit_quality(docs, labels), {d for d, _ in good}


def test_held_out_accuracy(fitted):
    docs, _, model, good = fitted
    rows = quality.quality_scores(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 80 and np.mean([(r.doc_id in good) == r.predicted for r in held]) > 0.97


def test_the_sample_is_bounded_and_keeps_the_held_out_rows_out(fitted):
    docs, labels, _, _ = fitted
    assert quality.labelled(docs, labels, 50).count() == 50
    rows = quality.labelled(docs, labels).count()
    assert rows == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(450))


def test_pairs_in_linear_time_equal_the_sum_over_pairs(fitted):
    model = fitted[2]
    at, value, starts = model.rows([quality.parts(text_of(9, 25), 10.0), quality.parts(None, float("nan"))])
    z, _ = model.margin(at, value, starts)
    for k, (lo, hi) in enumerate(zip(starts, np.append(starts[1:], len(at)))):
        a, x = at[lo:hi], value[lo:hi]
        want = model.w0 + (model.w[a] * x).sum() + sum(float(model.v[a[i]] @ model.v[a[j]]) * x[i] * x[j] for i in range(len(a)) for j in range(i))
        assert z[k] == pytest.approx(want, abs=1e-4)


def test_odd_rows_and_no_columns_but_the_text_matter(fitted, docs_of, odd_rows, spark):
    model = fitted[2]
    docs = docs_of(odd_rows)
    rows = quality.quality_scores(docs, model).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    other = docs.selectExpr("doc_id + 5 AS doc_id", "text", "'xx' AS lang", "'other' AS source", "n_chars", "1 AS quality")
    assert sorted(r.score for r in quality.quality_scores(other, model).collect()) == sorted(r.score for r in rows)
    kept = quality.good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows)


def test_without_two_labels(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows)
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(4, 1), (7, 1), (8, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.quality_scores(docs, quality.fit_quality(docs, none)).collect()} == {0.5}
    assert {r.score for r in quality.quality_scores(docs, quality.fit_quality(docs, one)).collect()} == {1.0}
    empty = docs.where("doc_id = 99")
    assert quality.quality_scores(empty, quality.fit_quality(empty, one)).collect() == []
