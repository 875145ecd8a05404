"""Scores, risk bands, outcomes and decisions from observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..policy import RISKS
from ..rules import Bands

#: What each further class adds to a score, and at most.
BREADTH, MOST_BREADTH = 5, 15


def score(severity: Column, breadth_class: Column) -> Column:
    """Aggregate: the worst severity, plus BREADTH for each further class, at most 100; 0 without findings.

    breadth_class is null for findings that add severity but no breadth.
    """
    further = F.greatest(F.count_distinct(breadth_class) - 1, F.lit(0))
    return F.coalesce(F.least(F.lit(100), F.max(severity) + F.least(F.lit(MOST_BREADTH), further * BREADTH)), F.lit(0)).cast("int")


def score_of(found: Column) -> Column:
    """score() of an array of findings in their own row; those whose breadth is false add severity only."""
    classes = F.array_distinct(F.transform(F.filter(found, lambda f: f["breadth"]), lambda f: f["rule_class"]))
    further = F.least(F.lit(MOST_BREADTH), F.greatest(F.size(classes) - 1, F.lit(0)) * BREADTH)
    worst = F.array_max(F.transform(found, lambda f: f["severity"]))
    return F.when(F.size(found) > 0, F.least(F.lit(100), worst + further)).otherwise(0).cast("int")


def band(points: Column, bands: Bands = Bands()) -> Column:
    return F.when(points >= bands.critical, "critical").when(points >= bands.high, "high").when(points >= bands.medium, "medium").when(points >= bands.low, "low").otherwise("none")


def rank(risk: Column) -> Column:
    """A risk's ordinal, none 0 to critical 4."""
    return (F.array_position(F.array(*(F.lit(r) for r in RISKS)), risk) - 1).cast("int")


def outcome(findings: Column, gaps: Column) -> Column:
    """Any finding is risk; otherwise any gap is inconclusive; otherwise clean. Independent of the score."""
    return F.when(findings > 0, "risk_found").when(gaps > 0, "inconclusive").otherwise("clean")


def decision(result: Column, risk: Column, threshold: str = "high") -> Column:
    return F.when(result == "risk_found", F.when(rank(risk) >= RISKS.index(threshold), "at_or_above").otherwise("below")).otherwise(result)


def in_row(rows: DataFrame, found: Column, gaps: Column | None = None, bands: Bands = Bands()) -> DataFrame:
    """rows with n_reasons, n_gaps, score, risk and outcome; found and gaps are arrays of the row, so nothing is shuffled."""
    rows = rows.withColumns({"__found": F.transform(found, lambda f: f.withField("breadth", F.lit(True))), "n_gaps": F.lit(0) if gaps is None else F.size(gaps)})
    rows = rows.select("*", F.size("__found").cast("long").alias("n_reasons"), score_of(F.col("__found")).alias("score")).withColumn("n_gaps", F.col("n_gaps").cast("long")).drop("__found")
    return rows.withColumns({"risk": band(F.col("score"), bands), "outcome": outcome(F.col("n_reasons"), F.col("n_gaps"))})


def budget(found: DataFrame, most: int) -> DataFrame:
    """The findings within a document's budget, in order of (start, rule_id, end), and their number before."""
    order = Window.partitionBy("doc_id").orderBy("start", "rule_id", "end")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def reasons(found: DataFrame, most: int) -> DataFrame:
    """(doc_id, reasons, n_reasons, reasons_truncated): ordered rule@start:end, the first `most` shown."""
    rows = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "rule_id", "end"))).alias("all"))
    shown = F.transform(F.slice("all", 1, most), lambda r: F.concat(r["rule_id"], F.lit("@"), r["start"].cast("string"), F.lit(":"), r["end"].cast("string")))
    return rows.select("doc_id", F.array_join(shown, ",").alias("reasons"), F.size("all").cast("long").alias("n_reasons"), (F.size("all") > most).alias("reasons_truncated"))


#: Exit codes.
CLEAN, AT_THRESHOLD, INCONCLUSIVE, BELOW = 0, 1, 2, 3


def exit_code(decided: DataFrame) -> DataFrame:
    """One row: counts by outcome and the exit code of a whole run.

    A finding at the threshold gives 1; otherwise any finding 3; otherwise any inconclusive target 2.
    """
    count = lambda c: F.count_if(F.col("decision") == c)
    code = F.when(count("at_or_above") > 0, AT_THRESHOLD).when(count("below") > 0, BELOW).when(count("inconclusive") > 0, INCONCLUSIVE).otherwise(CLEAN)
    return decided.agg(F.count("*").alias("n_targets"), count("clean").alias("n_clean"), (count("at_or_above") + count("below")).alias("n_findings"), count("inconclusive").alias("n_inconclusive"), code.cast("int").alias("exit_code"))
