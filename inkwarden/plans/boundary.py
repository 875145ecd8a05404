"""Boundary suites: a payload placed at the tokens where a classifier's windows begin and end."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

# What surrounds a payload, the placements, and how many tokens around the wanted one are tried.
CARRIER = "The quarterly inventory report lists completed deliveries. Items are counted and stored in the warehouse. "
PLACEMENTS = ("first", "inside", "before", "crossing", "after", "last", "later_crossing")
LONG_ONES, REACH = ("first", "after", "last", "crossing", "later_crossing"), 16
Tokens = Callable[[str], list[tuple[int, int]]]
CASE = "seed string, placement string, text string, start long, end long, token_start long, token_end long"


def words(text: str) -> list[tuple[int, int]]:
    """Words and single signs as tokens, by code points: a stand-in for a model's own."""
    return [m.span() for m in re.finditer(r"\w+|[^\w\s]", text)]


def wanted(placement: str, capacity: int, size: int) -> tuple[int, int]:
    """(token the payload should begin at, tokens after it) for windows of `capacity` tokens."""
    begin = {"first": 0, "inside": capacity // 4, "before": max(0, capacity - size), "crossing": capacity - 1, "after": capacity, "last": 2 * capacity, "later_crossing": 2 * capacity - 1}[placement]
    return begin, {"first": 2 * capacity, "inside": 2 * capacity, "last": 0}.get(placement, capacity)


def placed(payload: str, placement: str, capacity: int, tokens: Tokens = words) -> tuple[str, int, int, int, int] | None:
    """(text, start, end, first token, token behind) with the payload where the placement says, or None if it can't be.

    A tokeniser may join or split at the seams, so prefixes of some tokens more or fewer are tried, the shortest first.
    """
    size = len(tokens(payload))
    begin, after = wanted(placement, capacity, size)
    if not payload.strip() or capacity < 2 or size > capacity // 2 and placement not in LONG_ONES:
        return None
    carrier = CARRIER * (2 + (3 * capacity + REACH) // len(tokens(CARRIER)))
    marks = [a for a, _ in tokens(carrier)]
    for prefix in range(max(0, begin - REACH), begin + REACH + 1):
        head = carrier[: marks[prefix]]
        text = f"{head}\n{payload}\n{carrier[: marks[after]]}"
        start, end = len(head) + 1, len(head) + 1 + len(payload)
        own = [n for n, (a, b) in enumerate(tokens(text)) if a < end and b > start]
        first, behind = own[0], own[-1] + 1
        exact, limit = first == begin, {"crossing": capacity, "later_crossing": 2 * capacity}.get(placement, 0)
        if behind == capacity if placement == "before" else exact and behind > limit and not (placement == "inside" and behind > capacity):
            return text, start, end, first, behind
    return None


def suite(seeds: DataFrame, capacity: int, tokens: Tokens = words) -> DataFrame:
    """CASE rows: every seed (id, text) at every placement that it fits; offsets are code points."""
    ship(seeds.sparkSession)

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = [(i, p, *case) for i, t in zip(batch["id"], batch["text"], strict=True) for p in PLACEMENTS if (case := placed(t or "", p, capacity, tokens))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CASE.split(", ")])

    return seeds.select(F.col("id").cast("string").alias("id"), "text").mapInPandas(run, CASE)
