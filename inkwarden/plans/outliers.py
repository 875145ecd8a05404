"""Sibling outliers among embeddings, windows of a classifier, and tiers that amend a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import per_mille


def dot(a: Column, b: Column) -> Column:
    """The product of two vectors; what one of them lacks or holds as null is 0."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0).cast("double"), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    size = norm(v)
    return F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(x))


def softmax(v: Column) -> Column:
    """Shares by exp, safe against overflow."""
    top = F.array_max(v)
    powers = F.transform(v, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0).cast("double"), lambda s, x: s + x)
    return F.transform(powers, lambda x: x / total)


def mean_pool(rows: DataFrame, vector: str, size: int, *by: str) -> DataFrame:
    """(by, <vector>): the mean of a group's vectors, as `size` partial sums."""
    return rows.groupBy(*by).agg(F.array(*(F.avg(F.get(vector, F.lit(i)).cast("double")) for i in range(size))).alias(vector))


def outlier_scores(rows: DataFrame, group: str = "label", vector: str = "embedding", size: int | None = None) -> DataFrame:
    """(vec_id, group, score): 1000 minus 1000 times the mean product with the group's other vectors, 0 to 2000.

    The sum over pairs is (v . S - v . v) / (n - 1) with the group's sum S, so no pair is ever made;
    S is one partial sum a component and group, as many as the longest vector has unless size is given. A lone
    vector scores 0.
    """
    if size is None:
        size = rows.agg(F.max(F.size(vector))).first()[0] or 0
    v = rows.select("vec_id", group, F.col(vector).cast("array<double>").alias("v"))
    sums = v.groupBy(group).agg(F.count("*").alias("n"), F.array(*(F.sum(F.get("v", F.lit(i))) for i in range(size))).alias("s"))
    joined = v.join(sums, group)
    mean = (dot(F.col("v"), F.col("s")) - dot(F.col("v"), F.col("v"))) / (F.col("n") - 1)
    points = F.greatest(F.lit(0), F.least(F.lit(2000), F.round(F.lit(1000) - mean * 1000))).cast("int")
    return joined.select("vec_id", group, F.when(F.col("n") > 1, points).otherwise(0).alias("score"))


def ranks(scored: DataFrame, group: str = "label") -> DataFrame:
    """Rank of each among its group: one more than the others that score as much or more."""
    few = scored.groupBy(group, "score").agg(F.count("*").alias("m"))
    upto = Window.partitionBy(group).orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return scored.join(few.withColumn("rank", F.sum("m").over(upto)).drop("m"), [group, "score"])


# Shares of first places, per mille, from which a ranking is shipped, or worked on.
SHIP, CONTINUE = 600, 500


def rank_tallies(ranked: DataFrame, *strata: str) -> DataFrame:
    """(stratum, value, n, top1, top3, top1_permille, top3_permille, verdict) of a rank column over strata, and over all.

    Null values of a stratum count nowhere. One partial aggregate over all strata together, unpivoted afterwards.
    """
    few = ranked.groupBy(*strata).agg(F.count("*").alias("n"), F.count_if(F.col("rank") == 1).alias("top1"), F.count_if(F.col("rank") <= 3).alias("top3"))
    each = F.array(F.struct(F.lit("all").alias("stratum"), F.lit("all").alias("value")), *(F.struct(F.lit(c).alias("stratum"), F.col(c).cast("string").alias("value")) for c in strata))
    told = few.select(F.explode(each).alias("s"), "n", "top1", "top3").select("s.*", "n", "top1", "top3").where("value IS NOT NULL")
    told = told.groupBy("stratum", "value").agg(*(F.sum(c).alias(c) for c in ("n", "top1", "top3")))
    told = told.withColumns({f"{c}_permille": per_mille(F.col(c), F.col("n")) for c in ("top1", "top3")})
    return told.withColumn("verdict", F.when(F.col("top1_permille") >= SHIP, "ship").when(F.col("top1_permille") >= CONTINUE, "continue").otherwise("abandon"))


def zero_fpr(scored: DataFrame, negative: Column) -> DataFrame:
    """(threshold, n, hits): the least score above all negatives, and positives that reach it."""
    top = scored.agg((F.coalesce(F.max(F.when(negative, F.col("score"))), F.lit(-1)) + 1).alias("threshold"))
    return scored.join(top, F.lit(True)).groupBy("threshold").agg(F.count_if(~negative).alias("n"), F.count_if(~negative & (F.col("score") >= F.col("threshold"))).alias("hits"))


def windows(tokens: DataFrame, payload: int, overlap: int, most_windows: int) -> DataFrame:
    """(doc_id, window, token_start, token_end) of a classifier's windows; all or nothing within the budget.

    tokens has doc_id and n_tokens. Windows step by payload - overlap; the last is the tail.
    """
    step = payload - overlap
    count = (F.lit(1) + F.ceil(F.greatest(F.col("n_tokens") - payload, F.lit(0)) / step)).cast("int")
    rows = tokens.withColumn("count", count).where(F.col("count") <= most_windows)
    rows = rows.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("window"))
    start = F.col("window").cast("long") * step
    return rows.select("doc_id", "window", start.alias("token_start"), F.least(start + payload, F.col("n_tokens")).alias("token_end"))


def document_score(scored: DataFrame) -> DataFrame:
    """(doc_id, raw, window): the best window's score, the first of equals."""
    best = F.max_by(F.struct("raw", "window"), F.struct("raw", -F.col("window")))
    return scored.groupBy("doc_id").agg(best.alias("b")).select("doc_id", "b.raw", "b.window")


def ml_merge(verdicts: DataFrame, scores: DataFrame, threshold: int = 700, impact: int = 75) -> DataFrame:
    """Verdicts amended by a classifier: a finding at the threshold adds severity, no breadth; no score is a gap.

    verdicts has doc_id, n_reasons, score and n_gaps; scores has doc_id and raw.
    """
    rows = verdicts.join(scores.select("doc_id", "raw"), "doc_id", "left")
    hit = F.coalesce(F.col("raw") >= threshold, F.lit(False))
    out = rows.withColumns({"score": F.when(hit, F.greatest("score", F.lit(impact))).otherwise(F.col("score")).cast("int"), "n_reasons": F.col("n_reasons") + hit.cast("int"), "n_gaps": F.col("n_gaps") + F.col("raw").isNull().cast("int")})
    return out.withColumn("ml", F.when(hit, "finding").when(F.col("raw").isNull(), "unavailable").otherwise("below"))


def span_judgement(role: Column, relation: Column, addressed: Column, framing: Column, source: Column, purpose: Column) -> Column:
    """demoted where a reviewer calls a span a description that the document shows, and the document agrees.

    Speaking to the agent forbids it; example, data or report framing, a quoted third party or a
    purpose that explains the text each suffice.
    """
    display = framing.isin("presented_as_example", "presented_as_data", "presented_as_report") | (source == "quoted_third_party") | (purpose == "yes")
    demoted = (role == "description_of_an_instruction") & (relation == "is_what_the_document_shows") & (addressed != "processing_agent") & display
    return F.when(demoted, "demoted").otherwise("confirmed")


def release(found: DataFrame, may_release: bool) -> DataFrame:
    """Findings with active: a demoted one leaves only where the reviewer may release; advice changes nothing."""
    return found.withColumn("active", ~(F.lit(may_release) & (F.col("judgement") == "demoted")))


def review_coverage(asked: DataFrame, answered: DataFrame) -> DataFrame:
    """(review_id, accepted, missing, unknown, repeated): an answer counts only if it covers exactly what was asked."""
    a = asked.select("review_id", "evidence_id").withColumn("want", F.lit(1))
    b = answered.groupBy("review_id", "evidence_id").agg(F.count("*").alias("got"))
    both = a.join(b, ["review_id", "evidence_id"], "full")
    told = both.groupBy("review_id").agg(F.count_if(F.col("got").isNull()).alias("missing"), F.count_if(F.col("want").isNull()).alias("unknown"), F.count_if((F.col("got") > 1) & F.col("want").isNotNull()).alias("repeated"))
    return told.withColumn("accepted", (F.col("missing") == 0) & (F.col("unknown") == 0) & (F.col("repeated") == 0))
