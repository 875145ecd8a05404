"""Building evaluation sets: exact duplicates, stratified samples, exclusions, manifests, generated rows."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.matching import arrow_function


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def content_id(text: Column) -> Column:
    """The first 16 hex digits of the content hash."""
    return F.substring(content_hash(text), 1, 16)


def normalised(text: str) -> str:
    """A text without differences of form, case and white space: NFKC, case folded, blanks as one space."""
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def normalised_hash(text: Column) -> Column:
    """SHA-256 of the normalised text; what Unicode folds can't be said in built-in functions."""
    fold = arrow_function(lambda texts: [normalised(t) for t in texts], pa.string(), "string")
    return F.sha2(fold(text).cast("binary"), 256)


def fresh_sample(rows: DataFrame, exposed: DataFrame, label: str, most: int, *stratum: str, over: int = 4) -> DataFrame:
    """At most `most` rows a stratum, those of least content hash, no two alike when normalised.

    rows has sha256, norm and the label; exposed has norm. Of each stratum the first over * most rows are
    candidates; of these, texts whose normalised forms bear different labels go, exposed ones go, and of each
    normalised form the first stays. A form that stands in several strata counts where it comes first.
    """
    candidates = stratified(rows, list(stratum), most * over)
    labels = candidates.groupBy("norm").agg(F.min(label).alias("low"), F.max(label).alias("high"), F.min("sha256").alias("first")).where("low = high").select(F.col("norm").alias("__norm"), "first")
    kept = candidates.join(labels, (F.col("norm") == F.col("__norm")) & (F.col("sha256") == F.col("first"))).drop("__norm", "first")
    kept = kept.join(exposed.select("norm").where("norm IS NOT NULL").distinct(), "norm", "left_anti")
    return stratified(kept, list(stratum), most)


def dedup_exact(rows: DataFrame, *order: str, text_col: str = "text") -> DataFrame:
    """One row of each text, the first by `order`, which should end in a unique column.

    The first row's columns travel through a partial aggregate, so a text that a third of all
    rows share never meets in one task.
    """
    first = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")
    return rows.groupBy(content_hash(F.col(text_col)).alias("sha256")).agg(first).select("sha256", "r.*")


def stratified(rows: DataFrame, stratum: str | list[str], most: int) -> DataFrame:
    """At most `most` rows of each stratum, those of least content hash: a sample without a seed.

    Catalyst limits groups before the shuffle, so a large stratum is cut where it is read.
    """
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(stratum).orderBy("sha256"))).where(F.col("n") <= most).drop("n")


def without_conflicts(rows: DataFrame, label_col: str) -> DataFrame:
    """Texts whose labels agree: (sha256, label, n_rows)."""
    told = rows.groupBy("sha256").agg(F.min(label_col).alias("low"), F.max(label_col).alias("high"), F.count("*").alias("n_rows"))
    return told.where("low = high").select("sha256", F.col("low").alias(label_col), "n_rows")


def without_exposed(rows: DataFrame, exposed: DataFrame) -> DataFrame:
    """Rows whose content hash the exposed set doesn't hold; a null hash excludes nothing."""
    return rows.join(exposed.select("sha256").where(F.col("sha256").isNotNull()).distinct(), "sha256", "left_anti")


def manifest(rows: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return rows.select("doc_id", content_id(text).alias("id"), content_hash(text).alias("sha256"), "source", F.col("lang").alias("language"), F.octet_length(text).cast("long").alias("bytes"))


def verify_manifest(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """One row per id that is not in both with the same hash: (id, problem)."""
    both = rows.select("id", F.col("sha256").alias("have")).join(listed.select("id", F.col("sha256").alias("want")), "id", "full")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("have") != F.col("want"), "changed")
    return both.select("id", problem.alias("problem")).where(F.col("problem").isNotNull())


def generate(carriers: DataFrame, payloads: DataFrame, positions: DataFrame) -> DataFrame:
    """Carriers times payloads, at the positions each carrier has: one row per applicable triple.

    Payloads and positions are small tables of fixed size; only carriers grow.
    """
    placed = carriers.withColumn("position", F.explode("anchors")).join(F.broadcast(positions), "position")
    rows = placed.join(F.broadcast(payloads), F.lit(True))
    start = F.octet_length("body").cast("long") + F.octet_length("before")
    return rows.select(F.concat_ws(":", "carrier", "payload_id", "position").alias("id"), "context", "position", F.concat("body", "before", "payload", "after").alias("text"), start.alias("inj_start"), (start + F.octet_length("payload")).alias("inj_end"))


def skipped(carriers: DataFrame, positions: DataFrame) -> DataFrame:
    """(carrier, position) pairs that can't be placed."""
    every = carriers.select("carrier").join(F.broadcast(positions.select("position")), F.lit(True))
    return every.join(carriers.select("carrier", F.explode("anchors").alias("position")), ["carrier", "position"], "left_anti")
