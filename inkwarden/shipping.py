"""Takes this package to the executors' Python workers, and rows to idle cores."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Serve the package to all workers of the session's context, once.

    Workers import what UDFs name; on a cluster, and wherever the driver found the
    package by its own path, they need it sent. Spark's file server does that.
    """
    sc = spark.sparkContext
    if getattr(sc, "_inkwarden_shipped", False):
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / "inkwarden_package.zip"
    with zipfile.ZipFile(target, "w") as packed:
        for path in sorted(here.rglob("*.py")):
            packed.write(path, Path("inkwarden") / path.relative_to(here))
    sc.addPyFile(str(target))
    sc._inkwarden_shipped = True


#: A table of at most so many bytes may be dealt out anew; larger ones never are.
SMALL = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it is a small table in fewer files than there are cores.

    A small file is often a single row group, which one task reads whatever the size of its splits. What
    this shuffles is bounded by SMALL, by Spark's own estimate of the plan; a table beyond it stays as it is read.
    """
    if df.isStreaming or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)
