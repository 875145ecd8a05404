"""Mixing sources to target weights: repetition rates from token totals, then seeded copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, unused

#: Weights of the sources in order of code point, repeating; the most a source is repeated.
WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix-1"


def coin(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the seed and the id alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """(source, source_size, target) for a table of (source, size).

    Targets share `share` of all tokens by weight; none is above `most` times its source, and
    what that leaves goes to the others by weight. That is a water level: target =
    min(most * size, level * weight), and the level is the first that no later source's cap is
    under, going through sources from the lowest cap per weight. The windows run over one row
    for each source, not over documents. A null source is a source like any other.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sources.withColumn("w", F.element_at(F.array(*(F.lit(w) for w in weights)), (rank % len(weights) + 1).cast("int")).cast("long"))
    rows = rows.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything).cast("double") * share - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rows = rows.withColumn("level", left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    rows = rows.withColumn("level", F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(everything))
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("w"))
    return rows.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", seed: str = SEED, **goal) -> DataFrame:
    """doc_id, size, source_size, target and copies of each document.

    A document of a source with rate r = target / source_size is taken floor(r) times, and once
    more where its coin, which depends on seed and id only, is under r's fraction. Repeated ids
    share a coin. A source without tokens has rate 0; an empty table gives no rows.
    """
    own = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size")))
    goals = targets(own, **goal).withColumnRenamed("source", "__source")
    out = own.join(goals, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = (coin(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("int")
    return out.select("doc_id", "size", "source_size", "target", (F.floor(rate).cast("int") + extra).alias("copies"))


def mix_rows(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", seed: str = SEED, **goal) -> DataFrame:
    """The documents themselves, each as often as mix() takes it; all columns stay.

    The rates hang on the source alone, so the documents meet the small table of sources
    and are not joined with each other.
    """
    own, rated, copy = (unused(c, docs.columns) for c in ("__source", "__rate", "__copy"))
    goals = targets(docs.select(F.col(source_col).alias("source"), size.alias("size")), **goal)
    goals = goals.select(F.col("source").alias(own), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias(rated))
    rate = F.col(rated)
    copies = F.floor(rate).cast("int") + (coin(F.col(id_col), seed) < rate - F.floor(rate)).cast("int")
    out = docs.join(goals, F.col(source_col).eqNullSafe(F.col(own)))
    return out.where(copies > 0).select(*docs.columns, F.explode(F.array_repeat(F.lit(1), copies)).alias(copy)).drop(copy)
