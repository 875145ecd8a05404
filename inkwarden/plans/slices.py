"""Populations of an evaluation: which are run, and which sources count towards a gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import per_mille


def select(slices: DataFrame, wanted: list[str] | None = None, offline: bool = False) -> DataFrame:
    """The slices to run: those named, or all; offline, only those read from local files. An unknown name is an error.

    slices has slice and origin ('query' or 'local'). Slices are configuration, so their names may come to the driver.
    """
    if wanted is not None:
        if unknown := set(wanted) - {r["slice"] for r in slices.select("slice").collect()}:
            raise ValueError(f"unknown slices {sorted(unknown)}")
        slices = slices.where(F.col("slice").isin(wanted))
    return slices.where("origin = 'local'") if offline else slices


def gated_tally(rows: DataFrame, exclusions: DataFrame, hit: str = "detected") -> DataFrame:
    """(slice, n, hits, permille, n_excluded, hits_excluded): rates over the sources that count, and what was left out.

    rows has slice and source; exclusions (slice, source) names sources that don't count, a null slice everywhere. A
    null source always counts. Rows are aggregated by slice and source before they meet the exclusions.
    """
    few = rows.groupBy("slice", "source").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    out = exclusions.select(F.col("slice").alias("__slice"), F.col("source").alias("__source")).distinct()
    barred = few.join(out, (F.col("source") == F.col("__source")) & (F.col("__slice").isNull() | (F.col("slice") == F.col("__slice"))), "left_semi").select("slice", "source", F.lit(True).alias("barred"))
    both = few.join(barred.withColumnsRenamed({"slice": "__s", "source": "__o"}), (F.col("slice").eqNullSafe(F.col("__s"))) & (F.col("source") == F.col("__o")), "left")
    counts = F.coalesce("barred", F.lit(False))
    total = lambda c, which: F.coalesce(F.sum(F.when(which, F.col(c))), F.lit(0))
    told = both.groupBy("slice").agg(total("n", ~counts).alias("n"), total("hits", ~counts).alias("hits"), total("n", counts).alias("n_excluded"), total("hits", counts).alias("hits_excluded"))
    return told.withColumn("permille", per_mille(F.col("hits"), F.col("n")))
