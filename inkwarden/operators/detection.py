"""Detectors of mechanisms rather than phrases: concealing characters and look-alike tokens."""

from __future__ import annotations

import functools
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rules import spelled
from ..shipping import ship
from .matching import arrow_function, byte_offsets

# The characters of each kind (tab, line feed and carriage return belong to none), severities, ids.
CONCEALING = {
    "control_characters": r"\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}",
    "zero_width": r"\x{200B}-\x{200D}\x{2060}-\x{2064}\x{FEFF}\x{180E}",
    "bidi_override": r"\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}",
    "unicode_tags": r"\x{E0000}-\x{E007F}",
    "variation_selectors": r"\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}",
}
CONCEALMENT_SEVERITY, CONFUSABLE_SEVERITY, LEAST_TOKEN = 80, 60, 3
# Letters of other scripts that look like ASCII letters (the common part of the Unicode table).
LOOKALIKES = dict(
    zip(
        "аеорсухікјѕһԁԛԝьАВЕКМНОРСТУХІЈЅԌԛοανιρκτυχγΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcyxikjshdqwbABEKMHOPCTYXIJSGqoavipktuxyABEZHIKMNOPTYX",
        strict=True,
    )
)

_RUNS = {kind: regex.compile(spelled(f"[{members}]+")) for kind, members in CONCEALING.items()}
_CONTROLS = bytes(b for b in range(128) if _RUNS["control_characters"].match(chr(b)))
_HIDES = re.compile(spelled(f"[{''.join(CONCEALING.values())}]"))
_SUSPECT = re.compile("[" + "".join(LOOKALIKES) + "\uff01-\uff5e]")
# Characters that a skeleton spells otherwise, and those that end a token: white space and ASCII but letters and digits.
_SPELLED = re.compile("[" + "".join(LOOKALIKES) + "\uff01-\U0010ffff]")
_BREAK = re.compile(r"[\s\x00-/:-@\[-`{-\x7f]")
_ASCII_LETTER, _WIDE = re.compile("[A-Za-z]"), re.compile("[\uff01-\uffee]")


class _Skeleton(dict):
    """A table for str.translate, filled as characters are met."""

    def __missing__(self, point: int) -> str:
        x = chr(point)
        self[point] = LOOKALIKES.get(x) or (unicodedata.normalize("NFKC", x) if point > 0xFF00 else x)
        return self[point]


_SKELETON = _Skeleton()


def concealed_runs(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, run) of runs of concealing characters of one kind; offsets are bytes."""
    if len(raw := text.encode()) == len(raw.translate(None, _CONTROLS)) and (text.isascii() or not _HIDES.search(text)):
        return []
    found = [(kind, *m.span(), m[0]) for kind, pattern in _RUNS.items() for m in pattern.finditer(text)]
    at = byte_offsets(text, [p for _, a, b, _ in found for p in (a, b)])
    return [(kind, at[a], at[b], run) for kind, a, b, run in found]


def _concealments(texts: list[str]) -> list:
    return [[{"rule_id": f"concealment.{kind}", "start": a, "end": b, "n_chars": len(run), "recovered": recover_tags(run) if kind == "unicode_tags" else None} for kind, a, b, run in concealed_runs(t)] for t in texts]


def concealments(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, rule_id, start, end, n_chars, recovered), one row per run; recovered is what tag characters spell."""
    ship(docs.sparkSession)
    kind = pa.list_(pa.struct([("rule_id", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("n_chars", pa.int64()), ("recovered", pa.string())]))
    runs = arrow_function(_concealments, kind, "array<struct<rule_id:string,start:bigint,end:bigint,n_chars:bigint,recovered:string>>")
    return docs.select("doc_id", F.explode(runs(F.col(text_col))).alias("r")).select("doc_id", "r.*")


def recover_tags(run: str) -> str:
    """What a run of tag characters spells in ASCII."""
    return "".join(chr(ord(c) - 0xE0000) if 0xE0020 <= ord(c) <= 0xE007E else "" for c in run)


@functools.cache
def _script(c: str) -> str:
    name = unicodedata.name(c, "")
    return name.split(" ")[0] if unicodedata.category(c).startswith("L") else ""


def confusable_tokens(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, token, skeleton) of tokens that mix scripts and read as ASCII; offsets are bytes.

    Tokens end at white space and ASCII punctuation. A token of one script never counts; the skeleton
    must be ASCII with a letter and differ from the token.
    """
    if text.isascii() or not _SUSPECT.search(text):
        return []
    found, behind, at, size = [], 0, 0, 0
    for m in _SPELLED.finditer(text):
        if m.start() < behind:
            continue
        close = _BREAK.search(text, m.end())
        begin, end = m.start(), close.start() if close else len(text)
        while begin > behind and not _BREAK.match(text, begin - 1):
            begin -= 1
        behind, token = end, text[begin:end]
        if len(token) < LEAST_TOKEN:
            continue
        skeleton = token.translate(_SKELETON)
        if skeleton != token and skeleton.isascii() and _ASCII_LETTER.search(skeleton) and (_mixed(token) or _WIDE.search(token)):
            start = size + len(text[at:begin].encode("utf-8", "surrogatepass"))
            at, size = end, start + len(token.encode("utf-8", "surrogatepass"))
            found.append((start, size, token, skeleton))
    return found


def _mixed(token: str) -> bool:
    """Whether letters of several scripts stand in a token, Latin ones of ASCII and others."""
    latin, other = _ASCII_LETTER.search(token), any(x.isalpha() and not x.isascii() for x in token)
    return bool(latin and other and len({s for s in map(_script, token) if s}) > 1)


def _confusable(texts: list[str]) -> list:
    return [[dict(zip(("start", "end", "token", "skeleton"), x, strict=True)) for x in confusable_tokens(t)] for t in texts]


def confusables(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, token, skeleton); ASCII texts never reach Python."""
    ship(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("token", pa.string()), ("skeleton", pa.string())]))
    found = arrow_function(_confusable, kind, "array<struct<start:bigint,end:bigint,token:string,skeleton:string>>")
    # A set of that many letters costs a Java pattern more than Python needs for the whole text.
    suspects = docs.where(F.octet_length(text_col) > F.length(text_col))
    return suspects.select("doc_id", F.explode(found(F.col(text_col))).alias("c")).select("doc_id", "c.*")
