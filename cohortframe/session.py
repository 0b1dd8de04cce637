"""Session settings used by the tests, the bench and small scripts."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.master(master).appName("cohortframe")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per Spark context: their kernels are found by module name, wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_cohortframe_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="cohortframe-ship-")) / "cohortframe.zip"         # the driver serves it to the executors
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent).as_posix())
    context.addPyFile(str(target))
    context._cohortframe_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A folder of our own is taken only on a local master with the setting unset;
    a cluster without it is an error, since executors see no common local disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cohortframe-"))
        current = context.getCheckpointDir()
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result outlives the executors that made it."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


_DROPS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of a job go when it ends, not when the driver next collects its garbage.

    For steps that store what they make.  What is run later, or twice, makes its shuffles anew.
    """
    before = spark.conf.get(_DROPS, "false")
    spark.conf.set(_DROPS, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROPS, before)


MAX_BROADCAST_ROWS = 2_000_000      # of a narrow table: an id and a few numbers, about 100 MB


def measured(df: DataFrame) -> DataFrame:
    """A narrow per-sample table with a broadcast hint when its counted rows allow one.

    It spares the join a shuffle of all cells.  Above the limit the table is
    returned as it is and the join shuffles both sides.
    """
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df
