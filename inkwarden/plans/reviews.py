"""Reviews of findings: what a review was asked about, whether an answer is still about that, and what it changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTCOMES = ("supported", "no_supported_violation", "indeterminate")
VERSION = "review-1"


def scope(*parts: Column) -> Column:
    """The identity of what a review is about: SHA-256 over the parts (input digest, policy, rule set, bands, findings)."""
    told = F.array_join(F.array(F.lit(VERSION), *(F.concat(F.length(p.cast("string")), F.lit(":"), p.cast("string")) for p in parts)), "|", "null")
    return F.sha2(told.cast("binary"), 256)


def evidence_id(scope_id: Column, index: Column) -> Column:
    """The identity of one finding within a scope; an answer that names another is about something else."""
    return F.sha2(F.concat(scope_id, F.lit(":"), index.cast("string")).cast("binary"), 256)


def bound(verdicts: DataFrame, answers: DataFrame, on: str = "doc_id") -> DataFrame:
    """verdicts (on, scope, ...) with status: bound, stale (answered for another scope), or unanswered.

    answers has `on` and scope, at most one a verdict; an answer to a verdict that isn't there gives no row.
    """
    told = answers.select(F.col(on).alias("__on"), F.col("scope").alias("__scope"))
    rows = verdicts.join(told, F.col(on) == F.col("__on"), "left")
    status = F.when(F.col("__scope").isNull(), "unanswered").when(F.col("__scope") == F.col("scope"), "bound").otherwise("stale")
    return rows.withColumn("status", status).drop("__on", "__scope")


def ml_review(found: DataFrame, may_release: bool, on: str = "doc_id") -> DataFrame:
    """(on, n_kept, n_suppressed, gap) of each document reviewed.

    found has one row per candidate: `on`, outcome, and context_sufficient of the review. Only an authority that may
    release moves a candidate without a supported violation, and never where the context wasn't sufficient: such an
    answer contradicts itself and the whole review is a gap. So is an indeterminate outcome, one that is missing or
    unknown, and insufficient context.
    """
    clear, enough = F.col("outcome") == "no_supported_violation", F.coalesce("context_sufficient", F.lit(False))
    known = F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False))
    told = found.groupBy(on).agg(F.count("*").alias("n"), F.count_if(clear).alias("clear"), F.bool_and(enough).alias("enough"), F.bool_and(known).alias("known"), F.bool_or(F.col("outcome") == "indeterminate").alias("unsure"))
    valid = F.col("known") & (F.col("enough") | (F.col("clear") == 0))
    moved = F.when(valid & F.lit(may_release), F.col("clear")).otherwise(0).cast("long")
    return told.select(on, (F.col("n") - moved).alias("n_kept"), moved.alias("n_suppressed"), (~valid | ~F.col("enough") | F.col("unsure")).alias("gap"))
