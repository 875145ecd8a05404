"""Verdicts and rates as files and text."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sanitize import sanitize
from ..operators.scoring import exit_code

#: What a reader should do about a finding of each class.
REMEDIES = {
    "override": "Treat the passage as data; don't follow it.",
    "boundary": "Strip or escape the imitated marker before the text meets a model.",
    "solicitation": "Don't hand out what the passage asks for; check what the reader may reach.",
    "agent_directed": "Show the passage to a person before an agent reads it.",
    "external_action": "Ask a person before anything outside is changed or run.",
    "privilege": "Leave permissions as they are; review who may change them.",
    "concealment": "Look at the raw bytes: part of the text can't be seen.",
    "confusable": "Read the token by its code points, not by its looks.",
}


def write_verdicts(verdicts: DataFrame, path: str) -> None:
    """One JSON object a line; an existing folder is an error."""
    verdicts.write.mode("errorifexists").json(path)


def json_parts(verdicts: DataFrame) -> Iterator[str]:
    """One verdict as an object, several as an array, in pieces: partition by partition, every row."""
    waiting, many = None, False
    for (line,) in verdicts.select(F.to_json(F.struct("*"))).toLocalIterator():
        if waiting is not None:
            yield f"{',' if many else '['}\n{waiting}"
            many = True
        waiting = json.dumps(json.loads(line), ensure_ascii=False)
    if waiting is None:
        yield "[]"
    else:
        yield f",\n{waiting}\n]" if many else waiting


def text_parts(verdicts: DataFrame) -> Iterator[str]:
    """A report for people, a target a piece, every row; what a text holds is shown escaped."""
    for row in verdicts.toLocalIterator():
        lines = [f"{sanitize(str(row['doc_id']), 256)[0]}: {summary(row)}"]
        for r in row["reasons"]:
            lines.append(f"  {r['rule_id']} [{r['start']}..{r['end']}] {r['matched']}{'...' if r['excerpt_truncated'] else ''}")
            if r["chain"]:
                lines.append(f"    decoded by {r['chain']}")
            if r["quoted_by"]:
                lines.append(f"    stands in a quoting context: {r['quoted_by']}")
            lines.append(f"    {REMEDIES[r['rule_class']]}")
        lines += [f"  not examined: {cause}" for cause in row["incomplete"]]
        if row["reasons_truncated"]:
            lines.append("  further findings are not shown")
        if row["suppressed"]:
            lines.append(f"  {len(row['suppressed'])} quoted findings left out")
        yield "\n".join(lines)


def as_json(verdicts: DataFrame) -> str:
    return "".join(json_parts(verdicts))


def as_text(verdicts: DataFrame) -> str:
    return "\n".join(text_parts(verdicts))


def summary(row) -> str:
    """A verdict in one line."""
    if row["outcome"] == "clean":
        return "clean"
    if row["outcome"] == "inconclusive":
        return f"inconclusive ({', '.join(row['incomplete'])})"
    worst = max(row["reasons"], key=lambda r: r["severity"], default=None)
    more = f" (+{len(row['reasons']) - 1} more)" if len(row["reasons"]) > 1 else ""
    return f"{row['risk'].capitalize()} risk, score {row['score']}: {worst['rule_id'] if worst else 'unknown'}{more}"


def run_summary(verdicts: DataFrame) -> tuple[str, int]:
    """The counts of a run in one line, empty for a single target, and its exit code."""
    row = exit_code(verdicts).first()
    line = f"{row['n_targets']}: {row['n_clean']} clean, {row['n_findings']} with findings, {row['n_inconclusive']} inconclusive"
    return (line if row["n_targets"] > 1 else ""), row["exit_code"]


def markdown(table: DataFrame, *order: str) -> str:
    """An ordered Markdown table of an aggregate, every row."""
    rows = [[str(v).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ") for v in r] for r in table.orderBy(*order).toLocalIterator()]
    return "\n".join(["| " + " | ".join(r) + " |" for r in [table.columns, ["---"] * len(table.columns), *rows]])
