"""Operators that need their cells several times have them computed once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortframe.operators import latent, popgen, trees
from cohortframe.plans import preprocess


@pytest.fixture
def read(spark):
    """A table of cells and the number of its rows computed so far; a checkpoint computes its last stage twice."""
    def make(n, p, seed):
        seen, x = spark.sparkContext.accumulator(0), np.random.default_rng(seed).integers(0, 3, (n, p))

        def told(dosage):
            seen.add(1)
            return dosage
        rows = spark.createDataFrame([(f"s{i:02d}", f"v{j}", int(x[i, j])) for i in range(n) for j in range(p)], "sample_id string, var_id string, dosage int")
        return rows.withColumn("dosage", F.udf(told, "int").asNondeterministic()("dosage")), seen
    return make


def test_trees_read_their_cells_once(spark, read):
    cells, seen = read(40, 6, 1)
    pheno = spark.createDataFrame([(f"s{i:02d}", float(i % 7)) for i in range(40)], "sample_id string, y double")
    trees.fit_forest(cells, pheno, trees=3, depth=3, share=0.5).nodes.count()
    assert 240 <= seen.value <= 480
    seen.value = 0
    trees.fit_boosting(cells, pheno, rounds=2, depth=2).nodes.count()
    assert 240 <= seen.value <= 480


def test_capture_ratios_read_their_cells_once(read):
    (real, seen), (synth, seen_synth) = read(40, 6, 2), read(40, 6, 3)
    assert latent.capture_ratios(real, synth, 3).count() == 1
    assert 240 <= seen.value <= 480 and 240 <= seen_synth.value <= 480


def test_structure_difference_reads_its_cells_once(spark, read):
    (real, seen), (synth, seen_synth) = read(40, 6, 4), read(40, 6, 5)
    places = spark.createDataFrame([(f"v{j}", "chr1", j * 10) for j in range(6)], "var_id string, chr string, pos long")
    assert popgen.correlation_structure_diff(real, synth, places, 20).first()["n_pairs"] == 9
    assert 240 <= seen.value <= 480 and 240 <= seen_synth.value <= 480


def test_process_reads_its_cells_once(spark, read):
    cells, seen = read(40, 6, 6)
    pheno = spark.createDataFrame([(f"s{i:02d}", float(i)) for i in range(40)], "sample_id string, y double")
    places = spark.createDataFrame([(f"v{j}", "chr1", j * 10) for j in range(6)], "var_id string, chr string, pos long")
    out = preprocess.process(cells, pheno, places)
    assert out["X"].count() > 0 and out["qc_report"].count() > 0
    assert 240 <= seen.value <= 480
