"""Freezing a reviewed collection: everything that must hold before its cases may be measured on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..policy import SOURCES

TEXTS = ("id", "control_role", "label_reason", "group", "provenance", "task_context", "labeler")
LABELS, SPLITS = ("benign", "injection", "uncertain"), ("development", "holdout")


def checks(cases: DataFrame, exposed: DataFrame) -> DataFrame:
    """(check, n_bad) of every check, zero if it holds; a collection is frozen only if all are.

    cases has TEXTS, source, label, split, text, sha256 (of the text that was reviewed) and previously_exposed;
    exposed has sha256. Counts over rows are one aggregate, those over groups one each, and nothing is gathered.
    """
    own = cases.withColumn("__have", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    unknown = lambda c, among: ~F.coalesce(F.col(c).isin(*among), F.lit(False))
    held = F.col("split") == "holdout"
    benign = F.count_distinct(F.when(held & (F.col("label") == "benign"), F.col("source")))
    rows = own.agg(
        (F.count("*") == 0).cast("long").alias("no_cases"),
        *(F.count_if(blank(c)).alias(f"blank_{c}") for c in TEXTS),
        F.count_if(unknown("source", SOURCES)).alias("unknown_source"),
        F.count_if(unknown("label", LABELS) | unknown("split", SPLITS)).alias("unknown_label_or_split"),
        F.count_if(~F.col("sha256").eqNullSafe(F.col("__have"))).alias("hash_differs"),
        F.count_if(held & F.coalesce("previously_exposed", F.lit(False))).alias("declared_exposed"),
        F.greatest(F.lit(3) - benign, F.lit(0)).alias("too_few_benign_sources"),
        (F.count_if(held & (F.col("label") == "injection")) == 0).cast("long").alias("no_injection"),
    )
    several = lambda name, *by: own.groupBy(*by).count().agg(F.count_if(F.col("count") > 1).alias(name))
    crossing = lambda name, by: own.groupBy(by).agg(F.min("split").alias("low"), F.max("split").alias("high")).agg(F.count_if(F.col("low") != F.col("high")).alias(name))
    known = own.where(held).join(exposed.select("sha256").where("sha256 IS NOT NULL").distinct(), "sha256", "left_semi").agg(F.count("*").alias("known_exposed"))
    nothing = exposed.agg((F.count("*") == 0).cast("long").alias("no_exclusions"))
    parts = [rows, several("duplicate_id", "id"), several("duplicate_case", "sha256", "source", "control_role"), crossing("group_crosses_splits", "group"), crossing("text_crosses_splits", "sha256"), known, nothing]
    return reduce(DataFrame.unionByName, (p.unpivot([], p.columns, "check", "n_bad") for p in parts))
