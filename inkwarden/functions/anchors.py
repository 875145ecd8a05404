"""Carrier templates: a text with named places, rendered with one of them filled and the others at their defaults."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# How a place is written, as @@ANCHOR:name@@ or @@ANCHOR:name|default@@.
PLACE = re.compile(r"@@ANCHOR:(?P<name>[^@|]*?(?:@(?!@)[^@|]*?)*)(?:\|(?P<default>(?:[^@]|@(?!@))*))?@@")
OPENING = "@@ANCHOR:"
ESCAPES = ("none", "single_line", "table_cell", "json_string")


def escape(text: str, how: str) -> str:
    """A payload as the place it goes to can hold it: on one line, in a table's cell, within a JSON string."""
    if how == "json_string":
        return json.dumps(text, ensure_ascii=False)[1:-1]
    if how in ("single_line", "table_cell"):
        text = re.sub(r"[\r\n]", " ", text)
    return text.replace("|", "/") if how == "table_cell" else text


def places(template: str) -> list[re.Match]:
    """The places of a template; one that is never closed, has no name or a name used before is an error."""
    found = list(PLACE.finditer(template))
    if template.count(OPENING) != len(found):
        raise ValueError("a place is opened and never closed")
    names = [m["name"].strip() for m in found]
    if "" in names or len(set(names)) < len(names):
        raise ValueError(f"places need names of their own: {names}")
    return found


def render(template: str, target: str | None = None, payload: str = "") -> tuple[str, tuple[int, int] | None]:
    """(text, span of the payload in bytes): the target filled, every other place at its default.

    A place that stays empty takes its line with it if it stands there alone, and the blanks before it if it ends a line.
    """
    text, span, at = "", None, 0
    for m in places(template):
        text += template[at : m.start()]
        at = m.end()
        if m["name"] == target and payload:
            start = len(text.encode())
            text += payload
            span = (start, start + len(payload.encode()))
            continue
        filling = payload if m["name"] == target else m["default"] or ""
        rest = re.match(r"[^\n]*", template[at:])[0]
        if filling:
            text += filling
        elif not rest.strip() and not template[: m.start()].rpartition("\n")[2].strip():
            text = text[: text.rfind("\n") + 1]
            at += len(rest) + 1
        elif not rest:
            text = text.rstrip(" \t") if template[at : at + 1] == "\n" else text
    return text + template[at:], span


RENDERED = "struct<text:string,start:bigint,end:bigint>"
_RENDERED = pa.struct([("text", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def rendered(template: Column, target: Column, payload: Column) -> Column:
    """RENDERED of each row; start and end are null where the payload is nowhere."""

    def run(templates: pa.Array, targets: pa.Array, payloads: pa.Array) -> pa.Array:
        rows = (render(a or "", b, c or "") for a, b, c in zip(templates.to_pylist(), targets.to_pylist(), payloads.to_pylist(), strict=True))
        return pa.array([{"text": text, "start": span and span[0], "end": span and span[1]} for text, span in rows], _RENDERED)

    run.__annotations__ = {"templates": pa.Array, "targets": pa.Array, "payloads": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, RENDERED)(template, target, payload)
