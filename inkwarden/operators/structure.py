"""Regions of a text that quote or conceal, and where findings stand to them.

Regions are arrays of (start, end, context) in bytes, kept in the document's own row: a finding
is placed by filtering its row's array, so no range join and no shuffle is needed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .matching import arrow_function, shaped_like_json

REGIONS = "array<struct<start:bigint,end:bigint,context:string>>"
_REGIONS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("context", pa.string())]))
# Phrases that introduce an example, and how many bytes they reach.
MARKERS = ("for example", "for instance", "e.g.", "such as", "the phrase", "phrases like", "the string", "strings like", "patterns include", "attack string", "example payload", "injection example", "test case", "sample input")
WINDOW = 200
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
QUOTE_LINE = r"(?m)^[ \t\f\r]*>[^\n]*\n?"
FENCE_LINE = r"(?m)^[ \t\f\r]*(?:```|~~~)[^\n]*\n?"
LEADING = r"^[ \t\f\r]*"
Region = tuple[int, int, str]

_QUOTE_LINE, _FENCE_LINE = re.compile(rb"(?m)^[ \t\f\r]*(>)[^\n]*\n?"), re.compile(rb"(?m)^[ \t\f\r]*(```|~~~)[^\n]*\n?")


def comment_regions(raw: bytes) -> list[Region]:
    """HTML comments; an open one reaches to the end."""
    found, at = [], raw.find(b"<!--")
    while at >= 0:
        close = raw.find(b"-->", at + 4)
        end = close + 3 if close >= 0 else len(raw)
        found.append((at, end, "html_comment"))
        at = raw.find(b"<!--", end)
    return found


def quote_line_regions(raw: bytes) -> list[Region]:
    """Lines whose first character is >, from there to the line's end."""
    return [(m.start(1), m.end(), "block_quote") for m in _QUOTE_LINE.finditer(raw)] if b">" in raw else []


def fence_regions(raw: bytes) -> list[Region]:
    """Fenced blocks with both their markers; markers alternate, and an open block reaches to the end."""
    if b"```" not in raw and b"~~~" not in raw:
        return []
    marks = [(m.start(1), m.end()) for m in _FENCE_LINE.finditer(raw)]
    return [(marks[i][0], marks[i + 1][1] if i + 1 < len(marks) else len(raw), "fenced_code") for i in range(0, len(marks), 2)]


def attributive_regions(raw: bytes) -> list[Region]:
    """What follows a phrase that introduces examples; phrases may overlap each other, not themselves."""
    low, found = raw.lower(), []
    for marker in MARKERS:
        own = marker.encode()
        at = low.find(own)
        while at >= 0:
            end = at + len(own)
            found.append((at, min(end + WINDOW, len(raw)), "attributive_marker"))
            at = low.find(own, end)
    return found


def pair_quotes(raw: bytes, double: bool) -> list[Region]:
    """Inline code and quoted strings, paired from left to right.

    A pair may hold one line break at most; an apostrophe between letters or digits opens nothing; a
    delimiter without a partner is ordinary text. double: whether " quotes here (not in JSON).
    """
    found, at, first, limit = [], 0, -1, len(raw)
    ahead = {mark: raw.find(mark) for mark in ((b"`", b"'", b'"') if double else (b"`", b"'"))}
    while ahead := {mark: place for mark, place in ahead.items() if place >= 0}:
        mark = min(ahead, key=ahead.get)
        start = ahead[mark]
        at = start + 1
        if mark != b"'" or not (raw[max(0, start - 1) : start].isalnum() and raw[at : at + 1].isalnum()):
            if first < at:  # the first line break from here on is another one
                first = raw.find(b"\n", at) % (len(raw) + 1)
                limit = raw.find(b"\n", first + 1) % (len(raw) + 1)
            close = raw.find(mark, at, limit)
            if close >= 0:
                at = close + 1
                found.append((start, at, "inline_code" if mark == b"`" else "quoted_string"))
        for other, place in ahead.items():
            if place < at:
                ahead[other] = raw.find(other, at)
    return found


def quoting_regions(text: str) -> list[Region]:
    """Every region that quotes, by start, end and context."""
    raw = text.encode()
    return sorted(fence_regions(raw) + quote_line_regions(raw) + pair_quotes(raw, not shaped_like_json(text)) + attributive_regions(raw))


class Places:
    """The regions of one text, to be asked about single offsets."""

    def __init__(self, text: str) -> None:
        self.quoting = quoting_regions(text)
        self.hidden = comment_regions(text.encode())
        self._starts, self._opens = [r[0] for r in self.quoting], [r[0] for r in self.hidden]

    def innermost(self, at: int) -> str | None:
        """The context of the region around an offset that starts last."""
        for i in range(bisect_right(self._starts, at) - 1, -1, -1):
            if at < self.quoting[i][1]:
                return self.quoting[i][2]
        return None

    def around(self, start: int, end: int) -> str | None:
        """The context of the first region that holds a whole span."""
        return next((c for a, b, c in self.quoting if a <= start and end <= b), None)

    def concealed(self, at: int) -> bool:
        """Whether an offset lies in a comment that is not itself shown in a quoting region."""
        i = bisect_right(self._opens, at) - 1  # comments don't overlap
        return i >= 0 and at < self.hidden[i][1] and self.innermost(self.hidden[i][0]) is None


def _region_function(f: Callable[[bytes], list[Region]]) -> Callable[[Column], Column]:
    return _text_function(lambda t: f(t.encode()))


def _text_function(f: Callable[[str], list[Region]]) -> Callable[[Column], Column]:
    tell = lambda texts: [[{"start": a, "end": b, "context": c} for a, b, c in f(t)] for t in texts]
    return arrow_function(tell, _REGIONS, REGIONS)


def comments(text: Column) -> Column:
    return _region_function(comment_regions)(text)


def block_quotes(text: Column) -> Column:
    return _region_function(quote_line_regions)(text)


def fences(text: Column) -> Column:
    return _region_function(fence_regions)(text)


def attributive(text: Column) -> Column:
    return _region_function(attributive_regions)(text)


def with_regions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with __regions (quoting) and __comments (concealing)."""
    ship(docs.sparkSession)
    return docs.withColumns({"__regions": _text_function(quoting_regions)(F.col(text_col)), "__comments": comments(F.col(text_col))})


def covering(regions: Column, at: Column) -> Column:
    """Regions that hold an offset, in order; the innermost, which starts last, is the last of them."""
    return F.filter(regions, lambda r: (r["start"] <= at) & (at < r["end"]))


def innermost(regions: Column, at: Column) -> Column:
    """The context of the innermost region at an offset, null outside of all."""
    return F.get(F.transform(F.sort_array(covering(regions, at)), lambda r: r["context"]), F.size(covering(regions, at)) - 1)


def concealed(regions: Column, hidden: Column, at: Column) -> Column:
    """Whether an offset lies in a comment that is not itself shown in a quoting region."""
    return F.exists(covering(hidden, at), lambda c: F.size(covering(regions, c["start"])) == 0)


def split_suppressed(found: DataFrame, suppress: bool) -> DataFrame:
    """Findings with quoted_by and suppressed; found carries __regions and __comments.

    A finding in a comment stands, quoted or not. Otherwise a quoting region around its start marks it,
    and takes it out where the policy suppresses and the rule doesn't fire in quotes.
    """
    quoted = F.when(~concealed(F.col("__regions"), F.col("__comments"), F.col("start")), innermost(F.col("__regions"), F.col("start")))
    rows = found.withColumn("quoted_by", quoted)
    held = F.lit(suppress) & F.col("quoted_by").isNotNull() & ~F.col("fires_in_quotes")
    return rows.withColumn("suppressed", held)


def conceal_markup(found: DataFrame) -> DataFrame:
    """(doc_id, start, end, severity, evidence): each comment in which something was found.

    Its severity is the worst inside, its evidence the rules found, each once, in order.
    """
    inside = found.select("doc_id", "rule_id", "severity", F.explode(covering(F.col("__comments"), F.col("start"))).alias("c"))
    return inside.groupBy("doc_id", F.col("c.start").alias("start"), F.col("c.end").alias("end")).agg(F.max("severity").alias("severity"), F.array_join(F.sort_array(F.collect_set("rule_id")), ",").alias("evidence"))
