"""Rule matching: literal gate, all matches, byte spans, frames.

A batch of texts goes to Python once, as Arrow. There one vectorised pass finds which literals occur,
and a rule's pattern runs once over a text in which one of its literals does.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import BUILTIN, Rule, Ruleset
from ..shipping import ship
from .literals import CHUNK, Literals, chunks

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Where a unit begins, as patterns on the text before a match; quotes open a unit in JSON.
FRAME = r"(?:\A|[\n\[`]|(?:\||<!--)[ \t]*|[.!?;:,][ \t\r]+|(?:\A|\n)[ \t>*+\-#.)\]0-9]{1,8})\z"
FRAME_JSON = FRAME.replace(r"[\n\[`]", r"[\n\[`\"]", 1)
JSON_SHAPE = r"\A\s*[\{\[]"
_OPENERS, _MARKERS, _STOPS, _LEAD = "\n[`", ("|", "<!--"), ".!?;:,", frozenset(" \t>*+-#.)]0123456789")
_SHAPE = regex.compile(r"\s*[\{\[]")

MATCHES = "array<struct<rule_id:string,rule_class:string,severity:int,fires_in_quotes:boolean,start:bigint,end:bigint,matched:string>>"
COUNTS = "array<struct<rule_id:string,n_matches:bigint>>"
_FOUND = pa.list_(pa.struct([("rule_id", pa.string()), ("rule_class", pa.string()), ("severity", pa.int32()), ("fires_in_quotes", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.string())]))
_COUNTED = pa.list_(pa.struct([("rule_id", pa.string()), ("n_matches", pa.int64())]))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def looks_like_json(text: Column) -> Column:
    """A text that opens with a brace or bracket and has a quoted key."""
    return text.rlike(JSON_SHAPE) & F.contains(text, F.lit('":'))


def shaped_like_json(text: str) -> bool:
    """As looks_like_json."""
    return '":' in text and _SHAPE.match(text) is not None


def begins_unit(text: str, at: int, json: bool) -> bool:
    """Whether a unit begins at a place: FRAME, read backwards from there."""
    if not at or text[at - 1] in _OPENERS or json and text[at - 1] == '"':
        return True
    blank = at
    while blank and text[blank - 1] in " \t":
        blank -= 1
    if text.endswith(_MARKERS, 0, blank):
        return True
    while blank and text[blank - 1] in " \t\r":
        blank -= 1
    if blank < at and blank and text[blank - 1] in _STOPS:
        return True
    lead = at
    while lead and at - lead < 8 and text[lead - 1] in _LEAD:
        lead -= 1
    return lead < at and (not lead or text[lead - 1] == "\n")


def byte_offsets(text: str, places: list[int]) -> dict[int, int]:
    """Bytes before each of the places of a text."""
    if text.isascii():
        return {p: p for p in places}
    out, at, size = {}, 0, 0
    for p in sorted(set(places)):
        size += len(text[at:p].encode())
        out[p] = size
        at = p
    return out


class Matcher:
    """A rule set made ready: which rules may fire in a text, and where they do."""

    def __init__(self, ruleset: Ruleset = BUILTIN, cap: int = 16, classes: tuple[str, ...] | None = None) -> None:
        self.rules: list[Rule] = [r for r in ruleset.active if classes is None or r.rule_class in classes]
        self.cap = cap
        names = sorted({x.encode().lower() for r in self.rules for x in r.literals})
        number = {x: i for i, x in enumerate(names)}
        self.literals = Literals(names)
        self._needs = [[number[x.encode().lower()] for x in r.literals] for r in self.rules]
        self.patterns = [self._compiled(r) for r in self.rules]
        self._any = self._alternatives(names)

    @staticmethod
    def _compiled(rule: Rule):
        try:
            return regex.compile(rule.python_pattern)
        except regex.error:
            return None

    @staticmethod
    def _alternatives(names: list[bytes]) -> str | None:
        """One pattern for all literals, for an automaton that says some 500 MB/s whether any of them occurs; None if it can't hold them."""
        pattern = "|".join(re.escape(x.decode()) for x in names)
        try:
            pc.match_substring_regex(pa.array(["a"]), pattern, ignore_case=True)
        except pa.ArrowInvalid:
            return None
        return pattern

    def _suspects(self, texts: list[str]) -> list[int]:
        """Places of the texts that may hold a literal: all that do, and some where only letters outside ASCII fold to one."""
        if self._any is None:
            return list(range(len(texts)))
        told = pc.match_substring_regex(pa.array(texts, pa.string()), self._any, ignore_case=True)
        return pc.indices_nonzero(told).to_pylist()

    def opened(self, texts: list[str]) -> list[list[int]]:
        """Of each text: the numbers of the rules whose gate opens; a rule without literals always may fire."""
        rows: list[list[int]] = [[] for _ in texts]
        for a, b in chunks([len(t) for t in texts]):
            few = [a + i for i in self._suspects(texts[a:b])]
            seen = self.literals.among([texts[i].encode().lower() for i in few])
            for n, needs in enumerate(self._needs):
                for i in (few[k] for k in seen[:, needs].any(axis=1).nonzero()[0].tolist()) if needs else range(a, b):
                    rows[i].append(n)
        return rows

    def matches(self, text: str, numbers: list[int]) -> Iterator[tuple[Rule, list[tuple[int, int]], bool]]:
        """(rule, spans, cut off) of each rule that matches: the first `cap` spans, before any frame."""
        for n in numbers:
            if self.patterns[n] is None:
                continue
            spans, more = [], False
            for m in self.patterns[n].finditer(text):
                if len(spans) == self.cap:
                    more = True
                    break
                spans.append(m.span())
            if spans or more:
                yield self.rules[n], spans, more

    def found(self, text: str, numbers: list[int]) -> tuple[list[tuple[Rule, int, int]], set[str]]:
        """Matches that stand where their rule's anchor allows, in code points, and the gaps they leave."""
        kept, gaps, json = [], {"ruleset_unavailable" for n in numbers if self.patterns[n] is None}, shaped_like_json(text)
        for rule, spans, more in self.matches(text, numbers):
            kept += [(rule, a, b) for a, b in spans if rule.anchor != "frame" or begins_unit(text, a, json)]
            if more:
                gaps.add("max_matches_per_rule")
        return kept, gaps

    def firing(self, texts: list[str]) -> list[tuple[list[Rule], set[str]]]:
        """Of each text: the rules that fire in it at all, and the gaps."""
        out = []
        for text, numbers in zip(texts, self.opened(texts), strict=True):
            kept, gaps = self.found(text, numbers) if numbers else ([], set())
            out.append((list(dict.fromkeys(r for r, _, _ in kept)), gaps))
        return out


def arrow_function(f: Callable[[list[str]], list], kind: pa.DataType, schema: str, limit: int = CHUNK) -> Callable[[Column], Column]:
    """A column function of texts: f tells a list of texts, null as empty, a list of values; long batches come in chunks of at most limit bytes."""

    def run(texts: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        parts = [pa.array(f([t or "" for t in texts[a:b].to_pylist()]), kind) for a, b in chunks(sizes, limit)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    # Spark reads the kind of function from these.
    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, schema)


def _matches(ruleset: Ruleset, cap: int, classes: tuple[str, ...] | None) -> Callable[[Column], Column]:
    matcher = Matcher(ruleset, cap, classes)

    def tell(texts: list[str]) -> list:
        out = []
        for text, numbers in zip(texts, matcher.opened(texts), strict=True):
            kept = matcher.found(text, numbers)[0] if numbers else []
            at = byte_offsets(text, [p for _, a, b in kept for p in (a, b)]) if kept else {}
            out.append([{"rule_id": r.id, "rule_class": r.rule_class, "severity": r.severity, "fires_in_quotes": r.fires_in_quotes, "start": at[a], "end": at[b], "matched": text[a:b]} for r, a, b in kept])
        return out

    return arrow_function(tell, _FOUND, MATCHES)


def observation_array(text: Column, ruleset: Ruleset = BUILTIN, cap: int = 16, classes: tuple[str, ...] | None = None) -> Column:
    """All findings of a text as an array of (rule_id, rule_class, severity, fires_in_quotes, start, end, matched).

    Candidates are rules whose gate opens; of each the first `cap` matches count, and of those of a
    rule anchored to frames only the ones that begin a unit. Offsets are bytes.
    """
    return _matches(ruleset, cap, classes)(text)


def count_array(text: Column, ruleset: Ruleset = BUILTIN) -> Column:
    """All matches of every candidate rule, zero included, before any cap, as an array of (rule_id, n_matches)."""
    matcher = Matcher(ruleset)

    def tell(texts: list[str]) -> list:
        return [[{"rule_id": matcher.rules[n].id, "n_matches": sum(1 for _ in matcher.patterns[n].finditer(t))} for n in numbers if matcher.patterns[n]] for t, numbers in zip(texts, matcher.opened(texts), strict=True)]

    return arrow_function(tell, _COUNTED, COUNTS)(text)


def match_counts(docs: DataFrame, ruleset: Ruleset = BUILTIN, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, rule_id, n_matches): all matches of every candidate rule, zero included, before any cap."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col), F.explode(count_array(F.col(text_col), ruleset)).alias("c")).select(id_col, "c.*")


def observations(docs: DataFrame, ruleset: Ruleset = BUILTIN, text_col: str = "text", cap: int = 16, classes: tuple[str, ...] | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per finding: kept columns and what observation_array tells. One pass over the text, no shuffle."""
    ship(docs.sparkSession)
    return docs.select(*keep, F.explode(observation_array(F.col(text_col), ruleset, cap, classes)).alias("o")).select(*keep, "o.*")


def saturation(docs: DataFrame, ruleset: Ruleset = BUILTIN, cap: int = 16, text_col: str = "text") -> DataFrame:
    """(doc_id, rule_id, n_kept, saturated): a rule with more raw matches than the cap leaves a gap."""
    counts = match_counts(docs, ruleset, text_col).where("n_matches > 0")
    return counts.select("doc_id", "rule_id", F.least("n_matches", F.lit(cap)).cast("long").alias("n_kept"), (F.col("n_matches") > cap).alias("saturated"))
