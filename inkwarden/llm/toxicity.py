"""Toxicity: maximum-scoring segments over token log-odds, calibrated by extreme values.

Tokens are words; a word's units are its prefixes and itself, so that a stem is learned from
all words built on it. Log-odds of units under a Dirichlet prior are fitted on a bounded
sample of labelled documents. A text is a sequence of scores, negative on average; the linear
scan of Ruzzo and Tompa finds all maximal segments at once. Under the background the best of n
tokens follows an extreme-value law, so lambda * score - ln(K n) says how surprising a segment
is, and a text's segments add up to one number that a logistic turns into a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import CHUNK, pieces

#: Labelled documents that the model is fitted on at most, taken by least hashed id.
SAMPLE = 20_000
#: Code points of prefixes that are units; strength of the prior; what a unit must show to be kept.
PREFIXES = (4, 5, 6, 7)
PRIOR, LEAST_COUNT, LEAST_Z = 20.0, 3, 4.5
#: Tokens of class 0 that every unit is taken to have besides those seen.
FLOOR = 0.5
#: Units the model may hold.
MOST_UNITS = 50_000
#: Segments below this many nats of surprise don't count.
SIGNIFICANT = 0.0
_LONGEST_FIRST = tuple(sorted(PREFIXES, reverse=True))
#: Words are runs of letters of the lower-cased text, in learning (by the JVM) and in scoring alike.
_WORD = regex.compile(r"\p{L}+")


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    default: float = -0.01  #: log-odds of a token without a unit, negative
    rate: float = 1.0  #: lambda of the extreme-value law
    offset: float = 0.0  #: ln K
    slope: float = 0.0
    intercept: float = 0.0


def segments(positions: list[int], weights: list[float], default: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments as (score, first token, last token).

    Ruzzo and Tompa's scan; tokens other than those listed score `default`, which is negative,
    so runs of them are taken in one step.
    """
    stack: list[tuple[float, float, int, int]] = []  # (total before, total after, first, last)
    total, at = 0.0, -1
    for position, weight in zip(positions, weights, strict=True):
        total += default * (position - at - 1)
        at = position
        left, total = total, total + weight
        if weight <= 0:
            continue
        right, first = total, position
        while stack:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] >= left:
                k -= 1
            if k < 0 or stack[k][1] >= right:
                break
            left, first = stack[k][0], stack[k][2]
            del stack[k:]
        stack.append((left, right, first, position))
    return [(r - lo, a, b) for lo, r, a, b in stack]


def lower(text: str) -> str:
    """Lower case letter by letter, so that offsets stay; a letter that would become several stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def weigh(text: str, model: Model) -> tuple[list[int], list[float], int]:
    """Positions and scores of the tokens that the model knows, and the number of tokens."""
    words = _WORD.findall(lower(text))
    known = model.weights
    stems = model.stems if hasattr(model, "stems") else None
    if stems is None:
        stems = model.stems = {u.removesuffix("$")[: min(PREFIXES)] for u in known}
    low = min(PREFIXES)
    positions, weights = [], []
    for i, word in enumerate(words):
        if word[:low] in stems:
            weight = known.get(word + "$")
            for n in _LONGEST_FIRST if weight is None else ():
                if (weight := known.get(word[:n])) is not None:
                    break
            if weight is not None:
                positions.append(i)
                weights.append(weight)
    return positions, weights, len(words)


def surprise(text: str, model: Model) -> float:
    """Nats by which all significant segments of a text exceed what its length would bring by chance."""
    positions, weights, n = weigh(text, model)
    if not positions:
        return 0.0
    least = model.offset + math.log(n)
    nats = (model.rate * s - least for s, _, _ in segments(positions, weights, model.default))
    return sum(x for x in nats if x > SIGNIFICANT)


def passages(text: str, model: Model) -> list[tuple[int, int, float]]:
    """Every significant passage as (start, end, surprise): code points, end exclusive."""
    positions, weights, n = weigh(text, model)
    if not positions:
        return []
    places = [m.span() for m in _WORD.finditer(lower(text))]
    least = model.offset + math.log(n)
    found = ((a, b, model.rate * s - least) for s, a, b in segments(positions, weights, model.default))
    return [(places[a][0], places[min(b, len(places) - 1)][1], x) for a, b, x in found if x > SIGNIFICANT]


def probability(nats: float, model: Model) -> float:
    """The logistic of a text's surprise."""
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.intercept + model.slope * math.log1p(nats)))))


def _units(word: Column) -> Column:
    """The units of a word: its prefixes, and itself with a closing mark."""
    cuts = [F.when(F.length(word) >= n, F.substring(word, 1, n)) for n in PREFIXES]
    return F.array_compact(F.array(*cuts, F.concat(word, F.lit("$"))))


def _odds(counts: list[tuple[str, float, float]], n1: float, n0: float) -> tuple[dict[str, float], float, list[tuple[float, float]]]:
    """Log-odds of units that mark class 1, of all other tokens, and the units' background shares.

    n1, n0: tokens of the classes. Where units nest, a word goes by the one of greatest z, so
    units below a shorter one of no less weight are left out.
    """
    found = {}
    for unit, y1, y0 in counts:
        if y1 < LEAST_COUNT:
            continue
        prior = PRIOR * (y1 + y0) / (n1 + n0)
        a, b = y1 + prior, y0 + prior + FLOOR
        odds = math.log(a / (n1 + PRIOR - a)) - math.log(b / (n0 + PRIOR - b))
        z = odds / math.sqrt(1 / a + 1 / b)
        if odds > 0 and z >= LEAST_Z:
            found[unit] = (z, odds, y1, y0 + prior)
    best = dict(sorted(found.items(), key=lambda x: (-x[1][0], x[0]))[:MOST_UNITS])
    shorter = lambda u: (u[:n] for n in PREFIXES if n < len(u) and u[:n] in best)
    best = {u: x for u, x in best.items() if all(best[v][0] < x[0] for v in shorter(u))}
    tops = [u for u in best if not any(True for _ in shorter(u))]
    p1, p0 = (min(0.5, sum(best[u][k] for u in tops) / n) for k, n in ((2, n1), (3, n0)))
    rest = min(-1e-4, math.log(1 - p1) - math.log(1 - p0))
    return {u: x[1] for u, x in best.items()}, rest, [(best[u][3] / n0, best[u][1]) for u in tops]


def _law(model: Model, shares: list[tuple[float, float]]) -> None:
    """lambda and K of the background: the positive root of sum p exp(lambda s) = 1.

    shares: (share of background tokens, score) of the units; other tokens score the default.
    """
    rest = max(1e-9, 1 - sum(p for p, _ in shares))
    if not shares:
        return
    low, high = 1e-6, 1.0

    def excess(rate: float) -> float:
        return rest * math.exp(rate * model.default) + sum(p * math.exp(min(500.0, rate * s)) for p, s in shares) - 1

    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    model.rate = max(low, 1e-3)
    # Karlin and Altschul's K, here for scores whose positive steps are rare. A segment begins at a step up, and
    # that one is the first of its climb with probability 1 - exp(-lambda * step): what drifts down as slowly as
    # `default` is rarely met again. So the expected number of segments of at least x in n tokens is
    # n * sum(p * (1 - exp(-lambda * s))) * exp(-lambda * x), the sum over units of share p and score s.
    model.offset = math.log(max(sum(p * (1 - math.exp(-model.rate * s)) for p, s in shares), 1e-9))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) by Newton's method with a small penalty on the slope."""
    slope, intercept = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + intercept, -30, 30)))
        w = p * (1 - p) + 1e-9
        gradient = np.array([((y - p) * x).sum() - 0.05 * slope, (y - p).sum() - 0.01 * intercept])
        hessian = np.array([[(w * x * x).sum() + 0.05, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(hessian, gradient)
        slope, intercept = slope + step[0], intercept + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(slope)), float(intercept)


def _words(text: Column) -> Column:
    """The different words of a text, as lower() and _WORD have them."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(set(_WORD.findall(lower(t or "")))) for t in texts.to_pylist()], pa.list_(pa.string()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<string>")(text)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled rows, those of least hashed id; null labels and texts teach nothing.

    Units are counted in Spark, once for each different word of a document, so that repeated lines
    don't weigh more; only those of at least LEAST_COUNT tokens of class 1 and a higher
    share there come to the driver. The calibration is fitted on documents whose units were
    learned from the other half of the sample. Without labels of both classes every score is 0
    except that of a label seen alone.
    """
    spark = docs.sparkSession
    ship(spark)
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id").limit(sample)  # at most `sample` small rows, so they can be broadcast
    rows = docs.where(F.col(text_col).isNotNull()).join(F.broadcast(chosen), F.col(id_col) == F.col("__id"))
    half = F.pmod(F.xxhash64("__id", F.lit("half")), F.lit(2)).cast("int")
    held = rows.select("y", half.alias("half"), F.col(text_col).alias("text")).cache()
    sides = [(y, h) for y in (1, 0) for h in (0, 1)]
    tally = lambda n: [F.sum(F.when((F.col("y") == y) & (F.col("half") == h), n).otherwise(0)).cast("double").alias(f"y{y}{h}") for y, h in sides]
    words = held.select("y", "half", F.explode(_words(F.col("text"))).alias("word"))
    words = words.groupBy("word").agg(*tally(F.lit(1)))
    one, zero = F.col("y10") + F.col("y11"), F.col("y00") + F.col("y01")
    counts = words.select(F.explode(_units(F.col("word"))).alias("unit"), *(f"y{y}{h}" for y, h in sides)).groupBy("unit").agg(*(F.sum(c).alias(c) for c in ("y10", "y11", "y00", "y01")))
    sizes = words.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("y10", "y11", "y00", "y01"))).first()
    ones, zeros = sizes["y10"] + sizes["y11"], sizes["y00"] + sizes["y01"]
    # Only what has a clearly higher share among the ones can reach LEAST_Z.
    # The driver gets no more than the units a model may hold, those of most weight among the ones first.
    counts = counts.where((one >= LEAST_COUNT) & (one * F.lit(zeros) > zero * F.lit(1.2 * ones)))
    counts = counts.orderBy((one / (zero + 1)).desc(), one.desc(), "unit").limit(4 * MOST_UNITS).collect()
    model = Model()
    if not ones or not zeros:
        model.intercept = 10.0 if ones else -10.0
        held.unpersist()
        return model

    def fit(halves: tuple[int, ...]) -> Model:
        n1, n0 = (max(1.0, sum(sizes[f"y{y}{h}"] for h in halves)) for y in (1, 0))
        rows = [(r["unit"], sum(r[f"y1{h}"] for h in halves), sum(r[f"y0{h}"] for h in halves)) for r in counts]
        weights, rest, shares = _odds(rows, n1, n0)
        own = Model(weights, rest)
        _law(own, shares)
        return own

    crossed = [fit((1,)), fit((0,))]  # crossed[h] has not seen half h

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nats = [surprise(t, crossed[h]) for t, h in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(nats, pa.float64())], names=["y", "nats"])

    seen = held.select("y", "half", "text").mapInArrow(measure, "y int, nats double").toPandas()
    model = fit((0, 1))
    model.slope, model.intercept = _logistic(np.log1p(seen["nats"].to_numpy()), seen["y"].to_numpy(float))
    held.unpersist()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, n_passages, toxic_words) of every row.

    Null and empty texts score what a text without known tokens does. Repeated rows stay; other
    columns are not read. toxic_words is the number of words within significant passages.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in pieces(batches, "text", CHUNK):
            scores, many, covered = [], [], []
            for text in batch.column("text").to_pylist():
                positions, weights, n = weigh(text or "", model)
                total, found, inside = 0.0, 0, 0
                if positions:
                    least = model.offset + math.log(n)
                    for s, a, b in segments(positions, weights, model.default):
                        nats = model.rate * s - least
                        if nats > SIGNIFICANT:
                            total, found, inside = total + nats, found + 1, inside + b - a + 1
                scores.append(probability(total, model))
                many.append(found)
                covered.append(inside)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(many, pa.int64()), pa.array(covered, pa.int64())], names=["doc_id", "score", "predicted", "n_passages", "toxic_words"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int, n_passages long, toxic_words long")
