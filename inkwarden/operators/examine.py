"""Everything a scan finds out about a text that needs its bytes, in one trip to Python.

What depends on policy alone (classes, budgets, score, decision) stays in Spark: plans.scanner.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column

from ..functions.sanitize import sanitize
from ..policy import Policy
from ..rules import Rule, Ruleset
from . import decoding, detection, exports
from .matching import Matcher, arrow_function, byte_offsets
from .structure import Places

#: Findings sort by their first three fields.
FINDING = "struct<start:bigint,rule_id:string,end:bigint,rule_class:string,severity:int,matched:string,excerpt_truncated:boolean,chain:string,quoted_by:string,breadth:boolean>"
EXAMINED = f"struct<active:array<{FINDING}>,hidden:array<{FINDING}>,gaps:array<string>>"
_FINDING = pa.struct([("start", pa.int64()), ("rule_id", pa.string()), ("end", pa.int64()), ("rule_class", pa.string()), ("severity", pa.int32()), ("matched", pa.string()), ("excerpt_truncated", pa.bool_()), ("chain", pa.string()), ("quoted_by", pa.string()), ("breadth", pa.bool_())])
_EXAMINED = pa.struct([("active", pa.list_(_FINDING)), ("hidden", pa.list_(_FINDING)), ("gaps", pa.list_(pa.string()))])


class Examiner:
    """Rules, policy and protected resources made ready; tell() judges a list of texts.

    Direct matches and exports can be suppressed by quoting; structural and decoded findings never. A comment
    is reported for what stands in it, suppressed matches left aside. Excerpts are made safe to show and bounded.
    """

    def __init__(self, ruleset: Ruleset, policy: Policy, resources: tuple[exports.Resource, ...] = (), excerpt: int | None = None) -> None:
        self.matcher = Matcher(ruleset, policy.max_matches_per_rule)
        self.policy, self.resources = policy, resources
        self.excerpt = policy.max_excerpt_bytes if excerpt is None else excerpt

    def _finding(self, start: int, end: int, rule_id: str, rule_class: str, severity: int, matched: str, chain: str = "", quoted_by: str | None = None) -> dict:
        shown, cut = sanitize(matched, self.excerpt)
        return {"start": start, "rule_id": rule_id, "end": end, "rule_class": rule_class, "severity": severity, "matched": shown, "excerpt_truncated": cut, "chain": chain, "quoted_by": quoted_by, "breadth": True}

    def tell(self, texts: list[str]) -> list[dict]:
        expanded = [decoding.expand(t, self.policy.max_decode_depth) for t in texts]
        forms = [c["text"] for candidates, _ in expanded for c in candidates]
        fired, out = iter(self.matcher.firing(forms)), []
        for text, numbers, (candidates, gaps) in zip(texts, self.matcher.opened(texts), expanded, strict=True):
            out.append(self._examine(text, numbers, [(c, *next(fired)) for c in candidates], set(gaps)))
        return out

    def _examine(self, text: str, numbers: list[int], decoded: list[tuple[dict, list[Rule], set[str]]], gaps: set[str]) -> dict:
        finding = self._finding
        direct, missed = self.matcher.found(text, numbers) if numbers else ([], set())
        gaps |= missed
        at = byte_offsets(text, [p for _, a, b in direct for p in (a, b)])
        found = [(finding(at[a], at[b], r.id, r.rule_class, r.severity, text[a:b]), r.fires_in_quotes, False) for r, a, b in direct]
        sent = self._sent(text, gaps)
        found += [(f, False, True) for f in sent]
        active, hidden, places = [], [], None
        if found or "<!--" in text:
            places = Places(text)
        for f, fires, whole in found:
            if not places.concealed(f["start"]):
                f["quoted_by"] = places.around(f["start"], f["end"]) if whole else places.innermost(f["start"])
            held = self.policy.suppress_in_quotes and not fires and f["quoted_by"] is not None
            (hidden if held else active).append(f)
        for kind, a, b, run in detection.concealed_runs(text):
            told = detection.recover_tags(run).strip() if kind == "unicode_tags" else ""
            active.append(finding(a, b, f"concealment.{kind}", "concealment", detection.CONCEALMENT_SEVERITY, told or f"{len(run)} {kind}"))
        for a, b, token, skeleton in detection.confusable_tokens(text):
            active.append(finding(a, b, "confusable.homoglyph_token", "confusable", detection.CONFUSABLE_SEVERITY, f"{token} reads as {skeleton}"))
        for c, rules, missed in decoded:
            gaps |= missed
            chain = ">".join(c["chain"])
            active += [finding(c["start"], c["end"], r.id, r.rule_class, r.severity, c["text"], chain) for r in rules]
            active += [{**f, "start": c["start"], "end": c["end"], "chain": chain} for f in self._sent(c["text"], gaps)]
        for a, b, _ in places.hidden if places and active else ():
            inside = [f for f in active if a <= f["start"] < b and f["rule_id"] != "concealment.html_comment"]
            if inside:
                active.append(finding(a, b, "concealment.html_comment", "concealment", max(f["severity"] for f in inside), ",".join(sorted({f["rule_id"] for f in inside}))))
        return {"active": active, "hidden": hidden, "gaps": sorted(gaps)}

    def _sent(self, text: str, gaps: set[str]) -> list[dict]:
        """Exports of protected resources; more of them than the cap is a gap."""
        if not self.resources:
            return []
        found, more = exports.observe(text, self.resources, self.policy.max_matches_per_rule)
        if more:
            gaps.add("max_matches_per_rule")
        return [self._finding(e["start"], e["end"], e["rule_id"], "solicitation", e["severity"], f"{e['matched']} -> {e['destination']}") for e in found]


def examine(ruleset: Ruleset, policy: Policy, resources: tuple[exports.Resource, ...] = (), excerpt: int | None = None) -> Callable[[Column], Column]:
    """A column function of texts that gives EXAMINED."""
    return arrow_function(Examiner(ruleset, policy, resources, excerpt).tell, _EXAMINED, EXAMINED, decoding.FEW)
