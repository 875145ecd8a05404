"""Text made safe to show: characters that hide, move or act become visible escapes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

# What is escaped.
DANGEROUS = re.compile("[\u0000-\u001f\u007f-\u009f​-‏‪-‮⁠-⁤⁦-⁩﻿᠎︀-️\U000e0100-\U000e01ef\U000e0000-\U000e007f]")


def escape(c: str) -> str:
    return f"\\x{ord(c):02x}" if ord(c) < 0x20 or ord(c) == 0x7F else f"\\u{{{ord(c):04x}}}"


def sanitize(text: str | bytes, most: int) -> tuple[str, bool]:
    """(shown, truncated): at most `most` bytes, cut between whole characters and escapes.

    Bytes that aren't UTF-8 become escapes one by one.
    """
    if isinstance(text, bytes):
        text = text.decode("utf-8", "surrogateescape")
    head = text[: most + 1]
    if head.isascii() and not DANGEROUS.search(head):
        return head[:most], len(head) > most
    out, size = [], 0
    for c in text:
        unit = f"\\x{ord(c) - 0xDC00:02x}" if 0xDC80 <= ord(c) <= 0xDCFF else escape(c) if DANGEROUS.match(c) else c
        size += len(unit.encode("utf-8", "replace"))
        if size > most:
            return "".join(out), True
        out.append(unit)
    return "".join(out), False


def sanitized(rows: DataFrame, column: str, most: int = 256) -> DataFrame:
    """rows with <column>_shown and <column>_truncated; text or binary columns."""
    ship(rows.sparkSession)

    def shown(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sanitize(v if v is not None else "", most) for v in values], columns=["shown", "truncated"])

    udf = F.pandas_udf(shown, "shown string, truncated boolean")
    return rows.withColumn("__s", udf(F.col(column))).withColumns({f"{column}_shown": F.col("__s.shown"), f"{column}_truncated": F.col("__s.truncated")}).drop("__s")


def markup(text: Column) -> Column:
    """& < > as entities."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def table_cell(text: Column) -> Column:
    """A Markdown table cell: bars escaped, line ends as spaces."""
    return F.regexp_replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ")
