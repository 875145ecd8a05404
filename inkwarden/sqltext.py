"""DuckDB fragments that the comparison SQL of several queries is put together from."""

from __future__ import annotations

from .corpus import PAYLOADS, POSITIONS
from .operators.matching import FRAME, FRAME_JSON
from .rules import BUILTIN, Ruleset

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quoted(text: str) -> str:
    """A string literal; control characters are spelled out."""
    parts = ["'" + p.replace("'", "''") + "'" for p in text.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def corpus() -> str:
    payloads = ", ".join(f"({i}, {quoted(a)}, {quoted(k)}, {quoted(t)})" for i, (a, k, t) in enumerate(PAYLOADS))
    positions = ", ".join(f"({i}, {quoted(p.id)}, {str(p.leads).lower()}, {quoted(p.before)}, {quoted(p.after)})" for i, p in enumerate(POSITIONS))
    return f"""payloads(i, payload_id, kind, payload) AS (VALUES {payloads}),
positions(j, position, leads, lead_text, tail_text) AS (VALUES {positions}),
corpus AS (SELECT doc_id, source, lang, payload_id, kind, position,
    CASE WHEN leads THEN lead_text || payload || tail_text || coalesce(text, '') ELSE coalesce(text, '') || lead_text || payload || tail_text END AS text,
    (CASE WHEN leads THEN strlen(lead_text) ELSE strlen(coalesce(text, '')) + strlen(lead_text) END)::BIGINT AS inj_start,
    (CASE WHEN leads THEN strlen(lead_text) ELSE strlen(coalesce(text, '')) + strlen(lead_text) END + strlen(payload))::BIGINT AS inj_end
  FROM documents JOIN payloads ON doc_id % {len(PAYLOADS)} = i JOIN positions ON (doc_id // {len(PAYLOADS)}) % {len(POSITIONS)} = j)"""


def encoded_corpus(payload: str) -> str:
    """corpus, and e(doc_id, position, text): the same texts with an expression of the payload in its place."""
    return f"""{corpus()},
e AS (SELECT doc_id, position, CASE WHEN leads THEN lead_text || {payload} || tail_text || coalesce(text, '') ELSE coalesce(text, '') || lead_text || {payload} || tail_text END AS text
  FROM documents JOIN payloads ON doc_id % {len(PAYLOADS)} = i JOIN positions ON (doc_id // {len(PAYLOADS)}) % {len(POSITIONS)} = j)"""


def rules(ruleset: Ruleset = BUILTIN) -> str:
    rows = ", ".join(f"({quoted(r.id)}, {quoted(r.rule_class)}, {r.severity}, {quoted(r.anchor)}, [{', '.join(quoted(x.lower()) for x in r.literals)}], {quoted(r.pattern)})" for r in ruleset.active)
    return f"rules(rule_id, rule_class, severity, anchor, literals, pattern) AS (VALUES {rows})"


def lowered(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def json_shape(text: str) -> str:
    return f"(regexp_matches({text}, '^\\s*[\\{{\\[]') AND contains({text}, '\":'))"


def gated(source: str = "corpus") -> str:
    """(doc_id, rule ..., text) of every rule whose gate opens."""
    return f"""gated AS (SELECT c.doc_id, r.*, c.text FROM (SELECT *, {lowered("text")} AS low FROM {source}) c JOIN rules r
    ON len(list_filter(r.literals, lambda x: contains(c.low, x))) > 0)"""


def spans(source: str, keep: str, pattern: str, cap: int = 1 << 20, name: str = "hits") -> str:
    """All matches of a pattern with ordinal, byte offsets and characters before."""
    sums = lambda f: f"(list_sum(list_transform(gaps[1:ordinal], lambda g: {f}(g))) + coalesce(list_sum(list_transform(ms[1:ordinal-1], lambda g: {f}(g))), 0))::BIGINT"
    return f"""{name} AS (SELECT {keep}, text, ordinal, ms[ordinal] AS matched, {sums("strlen")} AS "start", {sums("strlen")} + strlen(ms[ordinal]) AS "end", {sums("len")} AS chars
  FROM (SELECT *, unnest(range(1, least(len(ms), {cap}) + 1)) AS ordinal
    FROM (SELECT *, regexp_extract_all(text, {pattern}) AS ms, string_split_regex(text, {pattern}) AS gaps FROM {source})))"""


def findings(source: str = "corpus", cap: int = 16) -> str:
    """rules, gated, hits, found: the observations of a corpus."""
    head = "substring(text, 1, chars::INT)"
    frame, frame_json = (f"regexp_matches({head}, {quoted(f)})" for f in (FRAME, FRAME_JSON))
    return f"""{rules()},
{gated(source)},
{spans("gated", "doc_id, rule_id, rule_class, severity, anchor", "pattern", cap)},
found AS (SELECT doc_id, rule_id, rule_class, severity, "start", "end", matched FROM hits
  WHERE anchor = 'any' OR CASE WHEN {json_shape("text")} THEN {frame_json} ELSE {frame} END)"""


def scored(source: str = "corpus") -> str:
    """verdicts(doc_id, n_reasons, score, risk, outcome) of a corpus with found."""
    return f"""scores AS (SELECT d.doc_id, count(f.doc_id)::BIGINT AS n_reasons,
    (CASE WHEN count(f.doc_id) = 0 THEN 0 ELSE least(100, max(severity) + least(15, (count(DISTINCT rule_class) - 1) * 5)) END)::INT AS score
  FROM {source} d LEFT JOIN found f ON d.doc_id = f.doc_id GROUP BY d.doc_id),
verdicts AS (SELECT *, CASE WHEN score >= 90 THEN 'critical' WHEN score >= 70 THEN 'high' WHEN score >= 45 THEN 'medium' WHEN score >= 20 THEN 'low' ELSE 'none' END AS risk,
    CASE WHEN n_reasons > 0 THEN 'risk_found' ELSE 'clean' END AS outcome FROM scores)"""


DECIDED = """CASE WHEN outcome = 'risk_found' THEN CASE WHEN risk IN ('high', 'critical') THEN 'at_or_above' ELSE 'below' END ELSE outcome END"""
