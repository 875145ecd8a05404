"""Decoders: one layer as Spark expressions, nested layers as a bounded search."""

from __future__ import annotations

import binascii
import re
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import BUILTIN, Ruleset
from ..shipping import ship
from .literals import CHUNK
from .matching import Matcher, arrow_function

# Least run, candidates in all, depth of whole-text decoders, bytes and share that make text.
LEAST_RUN, CANDIDATES, WHOLE_DEPTH, LEAST_TEXT, PRINTABLE = 16, 32, 2, 8, 0.85
RUN64, RUN16 = r"[A-Za-z0-9+/=_-]{16,}", r"[0-9A-Fa-f]{16,}"
ROT_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ROT_TO = "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm"
LEET_FROM, LEET_TO = "4@31!05$7", "aaeiiosst"
RUN_KINDS = ("base64", "hex", "unicode_tags")
KINDS = (*RUN_KINDS, "rot13", "reversed", "leetspeak")
_RUN64, _RUN16, _TAGS = re.compile(rb"[A-Za-z0-9+/=_-]{16,}"), re.compile(rb"[0-9A-Fa-f]{16,}"), re.compile("[\U000e0000-\U000e007f]{2,}")
#: What every tag character begins with in UTF-8.
_TAG_BYTES = "\U000e0000".encode()[:2]
_IN64, _LEAST64, _URL64 = bytes(43 if _RUN64.match(bytes([b]) * LEAST_RUN) else 32 for b in range(256)), b"+" * LEAST_RUN, bytes.maketrans(b"-_", b"+/")
_NOT_SHOWN = bytes(b for b in range(256) if not (0x20 <= b <= 0x7E or b in b"\n\r\t"))
_ROT, _LEET = (bytes.maketrans(a.encode(), b.encode()) for a, b in ((ROT_FROM, ROT_TO), (LEET_FROM, LEET_TO)))


def rot13(text: Column) -> Column:
    return F.translate(text, ROT_FROM, ROT_TO)


def reversed_text(text: Column) -> Column:
    """By code point."""
    return F.reverse(text)


def leet_evidence(text: Column) -> Column:
    """Whether a word holds a digit that stands for a letter between letters; hex-like runs don't count."""
    runs = F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.exists(runs, lambda r: ~r.rlike(r"\A[0-9A-Fa-f]{7,}\z") & r.rlike(r"[A-Za-z][A-Za-z0-9]*[013457][A-Za-z0-9]*[A-Za-z]"))


def leetspeak(text: Column) -> Column:
    """Digits and signs read as letters, where the text shows that it means them; otherwise null."""
    return F.when(leet_evidence(text), F.translate(text, LEET_FROM, LEET_TO))


def printable(text: Column) -> Column:
    """Whether decoded bytes read as text: long enough, mostly printable ASCII, with a space."""
    size = F.octet_length(text)
    good = F.length(F.regexp_replace(text, r"[^\x20-\x7E\n\r\t]", ""))
    return (size >= LEAST_TEXT) & (good.cast("double") / size >= PRINTABLE) & F.contains(text, F.lit(" "))


def encoded(text: Column) -> Column:
    """Whether decoded bytes are themselves one run of an encoding."""
    return text.rlike(r"\A[A-Za-z0-9+/=_-]{16,}\z")


def to_base64(raw: Column) -> Column:
    """In one line; Spark's own breaks it."""
    return F.regexp_replace(F.base64(raw), r"\s", "")


def hex_runs(text: Column) -> Column:
    """Texts that hexadecimal runs decode to; an odd last digit is dropped."""
    runs = F.regexp_extract_all(text, F.lit(RUN16), F.lit(0))
    whole = F.transform(runs, lambda r: F.substring(r, F.lit(1), (F.length(r) - F.length(r) % 2).cast("int")))
    texts = F.transform(whole, lambda r: F.unhex(r))
    return F.filter(F.transform(F.filter(texts, lambda b: F.is_valid_utf8(b.cast("string"))), lambda b: b.cast("string")), lambda t: printable(t) | encoded(t))


def base64_runs(text: Column) -> Column:
    """Texts that base64 runs decode to, of either alphabet, padded or not, in canonical form only."""
    runs = F.regexp_extract_all(text, F.lit(RUN64), F.lit(0))
    standard = F.transform(runs, lambda r: F.when(~F.contains(r, F.lit("+")) & ~F.contains(r, F.lit("/")), F.translate(r, "-_", "+/")).otherwise(r))
    bare = F.filter(F.transform(standard, lambda r: F.rtrim(r, F.lit("="))), lambda r: ~r.rlike("[=_-]") & (F.length(r) % 4 != 1))
    padded = F.transform(bare, lambda r: F.rpad(r, (F.ceil(F.length(r) / 4) * 4).cast("int"), "="))
    pairs = F.transform(padded, lambda r: F.struct(r.alias("run"), F.unbase64(r).alias("bytes")))
    sound = F.filter(pairs, lambda p: (to_base64(p["bytes"]) == p["run"]) & F.is_valid_utf8(p["bytes"].cast("string")))
    return F.filter(F.transform(sound, lambda p: p["bytes"].cast("string")), lambda t: printable(t) | encoded(t))


def _reads(raw: bytes) -> bool:
    good = len(raw.translate(None, _NOT_SHOWN))
    text = len(raw) >= LEAST_TEXT and good / len(raw) >= PRINTABLE and b" " in raw
    return text or bool(_RUN64.fullmatch(raw))


def _runs(raw: bytes) -> list[tuple[int, int]]:
    """Spans of the runs that may be base64; a run of hexadecimal digits lies in one of them. Most texts have none."""
    shape, found = raw.translate(_IN64), []
    at = shape.find(_LEAST64)
    while at >= 0:
        end = shape.find(b" ", at) % (len(raw) + 1)
        found.append((at, end))
        at = shape.find(_LEAST64, end)
    return found


def _decode64(run: bytes) -> bytes | None:
    """A run's bytes if it is canonical base64 in one alphabet."""
    bare = run.rstrip(b"=")
    if not bare or b"=" in bare or len(run) - len(bare) not in (0, -len(bare) % 4):
        return None
    if b"-" in bare or b"_" in bare:
        if b"+" in bare or b"/" in bare:
            return None
        bare = bare.translate(_URL64)
    try:
        out = binascii.a2b_base64(bare + b"=" * (-len(bare) % 4), strict_mode=True)
    except ValueError:
        return None
    return out if binascii.b2a_base64(out, newline=False).rstrip(b"=") == bare else None


#: Letters as a, digits as 0, all else as blanks.
_SHAPES = bytes(97 if b < 128 and chr(b).isalpha() else 48 if 48 <= b < 58 else 32 for b in range(256))
#: The second is that of leet_evidence without its choices: a search goes over a run once, however long that is.
_LIKE_HEX, _LEET_WORD = re.compile(rb"[0-9A-Fa-f]{7,}"), re.compile(rb"[A-Za-z][2689]*[013457][0-9]*[A-Za-z]")


def shows_leet(raw: bytes) -> bool:
    """As leet_evidence, on a text's bytes; runs without a letter before a digit are never looked at."""
    shape = raw.translate(_SHAPES)
    at = shape.find(b"a0")
    while at >= 0:
        start, end = shape.rfind(b" ", 0, at) + 1, shape.find(b" ", at) % (len(raw) + 1)
        if _LEET_WORD.search(raw, start, end) and not _LIKE_HEX.fullmatch(raw, start, end):
            return True
        at = shape.find(b"a0", end)
    return False


def layer(text: str, depth: int, last: str = "", kinds: Collection[str] = KINDS) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, end, decoded) of one layer, in order of kinds; offsets are bytes of text.

    last is the kind that text came from: turning it by the same once more gives what is known. Other kinds
    than those asked for aren't decoded.
    """
    raw = text.encode()
    runs = _runs(raw)
    for a, b in runs if "base64" in kinds else ():
        out = _decode64(raw[a:b])
        if out is not None and _reads(out):
            yield "base64", a, b, out.decode("utf-8", "replace")
    for m in (m for a, b in runs for m in _RUN16.finditer(raw, a, b)) if "hex" in kinds else ():
        run = m[0][: len(m[0]) // 2 * 2]
        if _reads(out := bytes.fromhex(run.decode())):
            yield "hex", m.start(), m.start() + len(run), out.decode("utf-8", "replace")
    for m in _TAGS.finditer(text) if "unicode_tags" in kinds and _TAG_BYTES in raw else ():
        start = len(text[: m.start()].encode())
        yield "unicode_tags", start, start + len(m[0].encode()), "".join(chr(ord(c) - 0xE0000) for c in m[0])
    if depth <= WHOLE_DEPTH:
        turned = lambda table: raw.translate(table).decode()
        whole = (("rot13", lambda: turned(_ROT)), ("reversed", lambda: text[::-1]), ("leetspeak", lambda: turned(_LEET) if shows_leet(raw) else text))
        for kind, turn in whole:
            if kind in kinds and kind != last and (out := turn()) != text:
                yield kind, 0, len(raw), out


def one_layer(text: str, depth: int, last: str = "") -> list[tuple[str, int, int, str]]:
    """All that layer gives."""
    return list(layer(text, depth, last))


def expand(text: str, max_depth: int = 3, kinds: Collection[str] = KINDS) -> tuple[list[dict], list[str]]:
    """Candidates (text, start, end, chain) by breadth-first decoding, and the gaps it leaves.

    Nothing blank or seen before is followed. Offsets are those of the outermost layer in the input. The
    limit counts a layer's candidates twice, as found and as waiting; a run that it cuts off is a gap and ends
    the search, a whole-text form that it cuts off only ends that text's layer. So is a run at the last depth.
    """
    seen, queue, found, gaps = {text}, [(text, None, ())], [], []
    for depth in range(1, max_depth + 1):
        waiting, pending, full = [], False, False
        for source, origin, chain in queue:
            for kind, start, end, out in layer(source, depth, chain[-1] if chain else "", kinds):
                if len(found) + len(waiting) >= CANDIDATES:
                    full = full or kind in RUN_KINDS
                    break
                if not out or out.isspace() or out in seen:
                    continue
                seen.add(out)
                place, steps = origin or (start, end), (*chain, kind)
                found.append({"text": out, "start": place[0], "end": place[1], "chain": list(steps)})
                pending = pending or kind in RUN_KINDS
                waiting.append((out, place, steps))
            if full:
                break
        if full:
            gaps.append("decode_failed")
        if not waiting or full:
            break
        if depth == max_depth and pending:
            gaps.append("decode_depth")
        queue = waiting
    return found, gaps


#: Bytes of text that are decoded at once, forms kept for the rules.
FEW = CHUNK // 4
NESTED = "array<struct<rule_id:string,rule_class:string,severity:int,start:bigint,end:bigint,candidate:int,chain:string>>"
_NESTED = pa.list_(pa.struct([("rule_id", pa.string()), ("rule_class", pa.string()), ("severity", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("candidate", pa.int32()), ("chain", pa.string())]))


def decoded_array(text: Column, ruleset: Ruleset = BUILTIN, max_depth: int = 3, cap: int = 16, kinds: Collection[str] = KINDS) -> Column:
    """Each decoded candidate of a text and rule that fires in it, as an array.

    Decoded texts never leave Python: a text has up to 32 of them, most as long as itself, so few texts are
    decoded at once. Candidates are gated on their own text; the span of a finding is that of the encoded region in the input.
    Where only some kinds count, asking for these spares decoding and matching the others.
    """
    matcher = Matcher(ruleset, cap)

    def tell(texts: list[str]) -> list:
        expanded = [expand(t, max_depth, kinds)[0] for t in texts]
        fired, out = iter(matcher.firing([c["text"] for candidates in expanded for c in candidates])), []
        for candidates in expanded:
            out.append([{"rule_id": r.id, "rule_class": r.rule_class, "severity": r.severity, "start": c["start"], "end": c["end"], "candidate": i, "chain": ">".join(c["chain"])} for i, c in enumerate(candidates) for r in next(fired)[0]])
        return out

    return arrow_function(tell, _NESTED, NESTED, FEW)(text)


REACH = "struct<direct:boolean,nested:boolean>"
_REACH = pa.struct([("direct", pa.bool_()), ("nested", pa.bool_())])


def reach(text: Column, ruleset: Ruleset = BUILTIN, max_depth: int = 1, kinds: Collection[str] = KINDS) -> Column:
    """REACH: whether a rule fires in a text as it is; if not, whether one does in a decoded form of it (null if that wasn't asked). One trip for both."""
    matcher = Matcher(ruleset)

    def tell(texts: list[str]) -> list:
        direct = [bool(rules) for rules, _ in matcher.firing(texts)]
        expanded = [[] if told else [c["text"] for c in expand(t, max_depth, kinds)[0]] for t, told in zip(texts, direct, strict=True)]
        fired = iter(matcher.firing([form for forms in expanded for form in forms]))
        nested = [[bool(next(fired)[0]) for _ in forms] for forms in expanded]
        return [{"direct": a, "nested": None if a else any(b)} for a, b in zip(direct, nested, strict=True)]

    return arrow_function(tell, _REACH, REACH, FEW)(text)


def decoded_observations(docs: DataFrame, ruleset: Ruleset = BUILTIN, text_col: str = "text", max_depth: int = 3, cap: int = 16, keep: tuple[str, ...] = ("doc_id",), kinds: Collection[str] = KINDS) -> DataFrame:
    """One row per decoded candidate and rule that fires in it."""
    ship(docs.sparkSession)
    return docs.select(*keep, F.explode(decoded_array(F.col(text_col), ruleset, max_depth, cap, kinds)).alias("f")).select(*keep, "f.*")
