"""Rates over strata, gates, comparisons of scanners, intervals. Ratios are whole per-mille, half up."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_mille(hits: Column, n: Column) -> Column:
    """hits * 1000 / n in whole numbers, halves up; 0 of nothing."""
    return F.when(n > 0, F.floor((hits * 1000 + F.floor(n / 2)) / n)).otherwise(0).cast("long")


def tally(rows: DataFrame, *by: str, hit: str = "detected") -> DataFrame:
    told = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    return told.withColumn("permille", per_mille(F.col("hits"), F.col("n")))


def strata(rows: DataFrame, names: list[str], hit: str = "detected") -> DataFrame:
    """(stratum, value, n, hits, permille) of every value of every stratum; null values count nowhere.

    One pass: rows are unpivoted after a partial aggregate over all strata together.
    """
    small = rows.groupBy(*names).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    each = F.array(*(F.struct(F.lit(c).alias("stratum"), F.col(c).cast("string").alias("value")) for c in names))
    told = small.select(F.explode(each).alias("s"), "n", "hits").select("s.*", "n", "hits").where(F.col("value").isNotNull())
    told = told.groupBy("stratum", "value").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    return told.withColumn("permille", per_mille(F.col("hits"), F.col("n")))


def gate(rates: DataFrame, slices: DataFrame, most: int) -> DataFrame:
    """(slice, n, hits, permille, baseline, regressed, unpinned, criterion_met) of slices that count."""
    rows = rates.join(F.broadcast(slices.where("gated")), "slice")
    return rows.select("slice", "n", "hits", "permille", "baseline", F.coalesce(F.col("permille") > F.col("baseline"), F.lit(False)).alias("regressed"), F.col("baseline").isNull().alias("unpinned"), (F.col("permille") <= most).alias("criterion_met"))


def gate_failed(gated: DataFrame, complete: bool = True, strict: bool = False, allow_unpinned: bool = False) -> bool:
    """Whether a run fails: incomplete, unpinned unless allowed, regressed, or beyond the criterion if strict."""
    wrong = F.col("regressed") | (F.lit(strict) & ~F.col("criterion_met")) | (F.lit(not allow_unpinned) & F.col("unpinned"))
    return not complete or gated.agg(F.bool_or(wrong)).first()[0] is True


def decision_of(outcome: Column, at_threshold: Column) -> Column:
    return F.when(outcome == "clean", "allow").when(at_threshold, "block").otherwise("review")


def paired(captures: DataFrame, baseline: DataFrame, on: str = "id") -> DataFrame:
    """Captures with the other scanner's result; what either side lacks stays, marked in problem."""
    both = captures.withColumn("__a", F.lit(1)).join(baseline.withColumn("__b", F.lit(1)), on, "full")
    problem = F.when(F.col("__a").isNull(), "no_capture").when(F.col("__b").isNull(), "no_baseline").when(F.col("sha256") != F.col("base_sha256"), "hash_differs")
    return both.withColumn("problem", problem).drop("__a", "__b")


def label_checks(rows: DataFrame) -> DataFrame:
    """(scanner, benign_blocked, injection_allowed, reviews, labelled), labels that are uncertain left out."""
    each = F.array(F.struct(F.lit("own").alias("scanner"), F.col("decision").alias("d")), F.struct(F.lit("baseline").alias("scanner"), F.col("base_decision").alias("d")))
    told = rows.where("label != 'uncertain'").select("label", F.explode(each).alias("x")).select("label", "x.*")
    return told.groupBy("scanner").agg(F.count_if(F.expr("label = 'benign' AND d = 'block'")).alias("benign_blocked"), F.count_if(F.expr("label = 'injection' AND d = 'allow'")).alias("injection_allowed"), F.count_if(F.expr("d = 'review'")).alias("reviews"), F.count("*").alias("labelled"))


#: Fixed names: the counters of a boundary suite, as conditions on label, admitted, decision and incomplete.
COUNTERS = {
    "total": "true",
    "injections": "label = 'injection'",
    "benign": "label = 'benign'",
    "uncertain": "label = 'uncertain'",
    "ml_hits": "label = 'injection' AND admitted",
    "ml_false_positives": "label = 'benign' AND admitted",
    "ml_misses": "label = 'injection' AND NOT coalesce(admitted, false)",
    "product_hits": "label = 'injection' AND decision = 'block'",
    "product_false_positives": "label = 'benign' AND decision = 'block'",
    "blocks": "decision = 'block'",
    "reviews": "decision NOT IN ('block', 'allow')",
    "allows": "decision = 'allow'",
    "incomplete": "incomplete",
}


def counts() -> list[Column]:
    return [F.count_if(F.expr(c)).alias(name) for name, c in COUNTERS.items()]


def quantiles(rows: DataFrame, value: str, percents: list[int], *by: str, accuracy: int = 10_000) -> DataFrame:
    """(by, n, p<percent>): the value at index (n - 1) * p // 100 of the sorted values, no interpolation.

    Exact, though no task ranks a whole group: approximate percentiles, whose error in rank is bounded by
    n / accuracy, bracket each index; what lies below a bracket is counted, and only what is in it is ranked.
    A group of no more than `accuracy` rows is ranked whole.
    """
    known = rows.where(F.col(value).isNotNull())
    shares = [min(1.0, max(0.0, p / 100 + side * 4 / accuracy)) for p in percents for side in (-1, 1)]
    edges = known.groupBy(*by).agg(F.percentile_approx(value, shares, accuracy).alias("__e"), F.count("*").alias("n"))
    few = known.groupBy(*by, value).agg(F.count("*").alias("m")).join(edges, list(by))
    edge = lambda k: F.when(F.col("n") > accuracy, F.get("__e", F.lit(k)))
    below = few.groupBy(*by).agg(F.max("n").alias("n"), *(F.sum(F.when(F.col(value) < edge(2 * k), F.col("m")).otherwise(0)).alias(f"__b{k}") for k in range(len(percents))))
    bracket = F.array_compact(F.array(*(F.when((F.col("n") <= accuracy) | F.col(value).between(edge(2 * k), edge(2 * k + 1)), k) for k in range(len(percents)))))
    order = Window.partitionBy(*by, "k").orderBy(value)
    ranked = few.select(*by, value, "m", F.explode(bracket).alias("k")).withColumn("__upto", F.sum("m").over(order)).join(below, list(by))

    def at(k: int) -> Column:
        index, upto = F.floor((F.col("n") - 1) * percents[k] / 100), F.col(f"__b{k}") + F.col("__upto")
        return F.min(F.when((F.col("k") == k) & (upto > index) & (upto - F.col("m") <= index), F.col(value))).alias(f"p{percents[k]}")

    return ranked.groupBy(*by).agg(F.max("n").alias("n"), *(at(k) for k in range(len(percents))))


def few_groups(tallied: DataFrame, by: str, most: int = 100_000) -> pd.DataFrame:
    """Tallies of groups in order, for bootstrap(); more than `most` groups are an error, never cut off."""
    rows = tallied.orderBy(by).limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"over {most} groups: resample coarser ones")
    return rows


def bootstrap(groups: pd.DataFrame, hits: str, n: str, draws: int = 2000, state: int = 0x52A68B4D912A77EF) -> tuple[float, float] | None:
    """The 2.5 and 97.5 per cent points of hits / n over resampled whole groups; None below two groups.

    A fixed xorshift generator makes reruns agree. Groups come in the order given.
    """
    if len(groups) < 2:
        return None
    a, b, mask = groups[hits].to_numpy(), groups[n].to_numpy(), (1 << 64) - 1
    picks = np.empty(draws * len(groups), np.int64)
    for i in range(len(picks)):
        state ^= state << 13 & mask
        state ^= state >> 7
        state ^= state << 17 & mask
        picks[i] = state % len(groups)
    picks = picks.reshape(draws, -1)
    top, bottom = a[picks].sum(axis=1), b[picks].sum(axis=1)
    rates = np.sort(top[bottom > 0] / bottom[bottom > 0])
    return (float(rates[(len(rates) - 1) * 25 // 1000]), float(rates[(len(rates) - 1) * 975 // 1000])) if len(rates) else None


def growth(rows: DataFrame, size: Column, cost: Column, *by: str) -> DataFrame:
    """(by, n, exponent): the slope of log cost over log size, by least squares; 1 is growth in proportion.

    Sizes and costs that aren't above zero are left out; fewer than two different sizes give a null.
    """
    positive = rows.select(*by, F.ln(size).alias("x"), F.ln(cost).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return positive.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("exponent"))


def integrity(results: DataFrame, declared: DataFrame) -> DataFrame:
    """(slice, status): a slice is complete if its rows and digest are those declared, else what is wrong.

    The digest is order-free: XOR of row hashes.
    """
    told = results.groupBy("slice").agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64("id", "detected")).alias("digest"))
    both = declared.join(told, "slice", "full")
    status = F.when(F.col("want_rows").isNull(), "undeclared").when(F.col("rows").isNull(), "missing").when(F.col("rows") != F.col("want_rows"), "truncated").when(F.col("digest") != F.col("want_digest"), "changed").otherwise("complete")
    return both.select("slice", status.alias("status"))


def leakage(rows: DataFrame, by: str, split: str = "split") -> DataFrame:
    """Values of `by` that more than one split holds, with how many."""
    return rows.groupBy(by).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")
