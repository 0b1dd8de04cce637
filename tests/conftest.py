import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortframe.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def geno_of(spark):
    """Long genotype table from {sample: {variant: dosage}}."""
    def make(table, dosage="int"):
        rows = [(s, v, d) for s, cells in table.items() for v, d in cells.items()]
        return spark.createDataFrame(rows, f"sample_id string, var_id string, dosage {dosage}")
    return make
