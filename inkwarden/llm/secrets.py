"""Secret scans: all rules as one minimal byte automaton, run once over every byte."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .automaton import determinise, scan
from .common import pieces, text_buffer


@dataclass(frozen=True)
class Rule:
    """head, then at least `least` bytes of tail; shorter tails match and are dropped.

    The combined automaton counts `mark` bytes of tail only: counters of several rules
    multiply its states, and how far a tail goes is measured at the places that it marks.
    """

    kind: str
    head: str
    tail: str
    least: int
    mark: int = 1


# The three base kinds in their order, then the kinds this method adds.
BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 8),
    Rule("access", "AKIA", "[A-Z0-9]", 12),
    Rule("hex", "", "[0-9a-f]", 32, 32),
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", 10),
    Rule("private_key", "-----BEGIN ([A-Z]+ )*PRIVATE KEY----", "-", 1),
)
KINDS = tuple(r.kind for r in RULES)


@cache
def combined():
    """The automaton that marks every place where head and `mark` bytes of tail of a rule end."""
    return determinise([f"{r.head}{r.tail}{{{r.mark}}}" for r in RULES], anchored=False)


@cache
def backwards(rule: Rule):
    """The rule's own automaton read from a marked place to the left, as lists: classes, steps, accepts, start, dead."""
    dfa = determinise([f"{rule.head}{rule.tail}{{{rule.mark}}}"], anchored=True, backwards=True)
    return dfa.classes.tolist(), dfa.step.tolist(), (dfa.accepts > 0).tolist(), dfa.start, dfa.dead


@cache
def tails(rule: Rule) -> re.Pattern:
    return re.compile(f"{rule.tail}*".encode())


def resolve(rule: Rule, data: bytes, places: list[int]) -> list[tuple[int, int]]:
    """Leftmost non-overlapping longest matches, without those whose tail is too short.

    places are those of the text at which the combined pass saw head and `mark` bytes of tail end. From there the
    match's start is read backwards, and its tail taken as far as it goes.
    """
    classes, step, accepts, start, dead = backwards(rule)
    found, free = [], 0
    for place in places:
        if place < free:
            continue
        state, at, first = start, place, -1
        while at >= free:
            state = step[state][classes[data[at]]]
            if state == dead:
                break
            if accepts[state]:
                first = at
            at -= 1
        if first >= 0:
            free = tails(rule).match(data, place + 1).end()
            if free - place - 1 + rule.mark >= rule.least:
                found.append((first, free))
    return found


def spans(data: np.ndarray, bounds: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """For each text with secrets: (start, end, rule number) in bytes of the text, in order."""
    places, masks = scan(combined(), data, bounds)
    found: dict[int, list[tuple[int, int, int]]] = {}
    owner = np.searchsorted(bounds, places, side="right") - 1
    edges = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(owner)], strict=True) if len(edges) else ():
        text = int(owner[a])
        raw = data[bounds[text] : bounds[text + 1]].tobytes()
        for number, rule in enumerate(RULES):
            own = places[a:b][masks[a:b] >> number & 1 == 1] - bounds[text]
            if len(own):
                found.setdefault(text, []).extend((x, y, number) for x, y in resolve(rule, raw, own.tolist()))
    return {k: sorted(v, key=lambda x: (x[0], x[2])) for k, v in found.items() if v}


def _points(raw: np.ndarray, own: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans in code points."""
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [(int(before[a]), int(before[b]), k) for a, b, k in own]


def _told(own: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in own)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, count per base kind, digest of base spans, all spans.

    A null or empty text has no spans: counts 0, digest of the empty string, spans ''.
    Repeated rows give repeated rows; an empty table gives none; other columns are not read.
    Spans are code points, end exclusive. Rules see ASCII only, so any text is legal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, bounds = text_buffer(batch.column("text"))
            found = spans(data, bounds)
            rows = []
            for i in range(batch.num_rows):
                own = _points(data[bounds[i] : bounds[i + 1]], found[i]) if i in found else []
                base = [s for s in own if s[2] < len(BASE)]
                kinds = [s[2] for s in base]
                rows.append((*(kinds.count(k) for k in range(len(BASE))), hashlib.sha256(_told(base).encode()).hexdigest(), _told(own)))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The documents, each secret replaced by ``[SECRET:kind]``; all rows and columns stay.

    Overlapping spans are merged under the kind of the first. Texts without secrets,
    null and empty ones included, stay as they are; size_col, if the table has it, is
    counted anew where a text changed.
    """
    ship(docs.sparkSession)
    names = docs.columns
    sized = size_col in names
    out = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            data, bounds = text_buffer(batch.column(text_col))
            found = spans(data, bounds)
            if found:
                texts = batch.column(text_col).to_pylist()
                sizes = batch.column(size_col).to_pylist() if sized else []
                for i, own in found.items():
                    raw, parts, at = data[bounds[i] : bounds[i + 1]].tobytes(), [], 0
                    for a, b, k in own:
                        if a >= at:
                            parts += [raw[at:a], f"[SECRET:{KINDS[k]}]".encode()]
                        at = max(at, b)
                    texts[i] = b"".join([*parts, raw[at:]]).decode("utf-8", "replace")
                    if sized:
                        sizes[i] = len(texts[i])
                columns = [pa.array(texts, batch.schema.field(c).type) if c == text_col else pa.array(sizes, batch.schema.field(c).type) if sized and c == size_col else batch.column(c) for c in names]
                batch = pa.RecordBatch.from_arrays(columns, names=names)
            yield batch

    return docs.mapInArrow(run, out)
