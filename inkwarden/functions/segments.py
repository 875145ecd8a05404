"""Structural segments of a text: headings, items, rows, fields, prose and what lies between."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

# Abbreviations that don't end a sentence.
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "st", "vs", "etc", "e.g", "i.e", "inc", "ltd", "no", "fig")
SIGN_OFFS = re.compile(r"(?i)\s*(?:--\s*|(?:best|kind|warm)?\s*regards,?|best,|thanks,|sincerely,|cheers,)\s*")
GAP_LINES = 3
SEGMENTS = "array<struct<kind:string,start:bigint,end:bigint,trailing:boolean>>"


def _kind(line: str) -> str | None:
    """The kind that a line shows by itself, prose if none."""
    if re.match(r"#{1,6} ", line):
        return "heading"
    if len(re.findall(r"(?<!\\)\|", line)) >= 2 or len([f for f in line.strip().split("  ") if f.strip()]) >= 3:
        return "table_row"
    if re.match(r"\s*(?:[-*+] |\d+[.)] )", line):
        return "list_item"
    if re.match(r"(?:\$ |PS[ >])|.:\\.*>", line):
        return "transcript_command"
    if re.match(r"[A-Za-z][A-Za-z0-9 _.-]{0,31}[:=]\s*\S", line) and line[: re.search("[:=]", line).start()].count(" ") <= 3:
        return "key_value"
    return None


def _sentences(text: str, start: int) -> list[tuple[str, int, int]]:
    found, at = [], 0
    for m in re.finditer(r"[.!?]+(?=\s|$)", text):
        word = re.search(r"([\w.]+)$", text[at : m.start()])
        if m[0] == "." and word and word[1].lower() in ABBREVIATIONS:
            continue
        found.append((at, m.end()))
        at = m.end()
    found.append((at, len(text)))
    return [("prose", start + a + len(s) - len(s.lstrip()), start + a + len(s.rstrip())) for a, b in found if (s := text[a:b]).strip()]


def _json_fields(text: str) -> list[tuple[str, int, int]] | None:
    """Scalar fields of a JSON text, None if it isn't one. Only the opening brace is asked for."""
    if not text.lstrip().startswith(("{", "[")):
        return None
    try:
        json.loads(text)
    except ValueError:
        return None
    return [("json_scalar_field", m.start(1), m.end(1)) for m in re.finditer(r'"(?:[^"\\]|\\.)*"\s*:\s*("(?:[^"\\]|\\.)*"|-?[0-9.eE+-]+|true|false|null)', text)]


def segment(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, trailing) in code points; trailing marks the last segment."""
    found = _json_fields(text)
    if found is None:
        found, lines, at = [], [], 0
        for line in text.split("\n"):
            lines.append((at, line))
            at += len(line) + 1
        i = 0
        if lines and lines[0][1].strip() == "---":
            end = next((k for k in range(1, len(lines)) if lines[k][1].strip() == "---"), None)
            if end:
                found.append(("frontmatter", 0, lines[end][0] + len(lines[end][1])))
                i = end + 1
        command = False
        while i < len(lines):
            start, line = lines[i]
            mark = re.match(r"\s*(```|~~~)", line)
            if not line.strip():
                j = i
                while j < len(lines) and not lines[j][1].strip():
                    j += 1
                if j - i >= GAP_LINES:
                    found.append(("whitespace_gap", start, lines[j][0] if j < len(lines) else len(text)))
                i, command = j, False
            elif mark:
                j = next((k for k in range(i + 1, len(lines)) if lines[k][1].lstrip().startswith(mark[1])), len(lines) - 1)
                found.append(("code_fence", start, lines[j][0] + len(lines[j][1])))
                i = j + 1
            elif i > 0 and SIGN_OFFS.fullmatch(line) and len(lines) - i <= 8:
                found.append(("signature_block", start, len(text.rstrip())))
                break
            elif kind := _kind(line):
                found.append((kind, start, start + len(line)))
                i, command = i + 1, kind == "transcript_command"
            elif command:
                found.append(("transcript_output", start, start + len(line)))
                i += 1
            else:
                j = i + 1
                while j < len(lines) and lines[j][1].strip() and not _kind(lines[j][1]) and not re.match(r"\s*(```|~~~)", lines[j][1]) and not SIGN_OFFS.fullmatch(lines[j][1]):
                    j += 1
                end = lines[j - 1][0] + len(lines[j - 1][1])
                found += _sentences(text[start:end], start)
                i = j
    return [(k, a, b, n == len(found) - 1) for n, (k, a, b) in enumerate(found)]


def _segmented(texts: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("kind", "start", "end", "trailing"), s, strict=True)) for s in segment(t or "")] for t in texts])


def segments(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per segment: kept columns, place, kind, start, end, trailing."""
    ship(docs.sparkSession)
    cut = F.pandas_udf(_segmented, SEGMENTS)
    return docs.select(*keep, F.posexplode(cut(F.col(text_col))).alias("place", "s")).select(*keep, "place", "s.*")
