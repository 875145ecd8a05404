"""Scan policies: limits, classes, threshold, and where a text comes from."""

from __future__ import annotations

from dataclasses import dataclass, replace

from .rules import CLASSES

RISKS = ("none", "low", "medium", "high", "critical")
#: Kinds of text; only security references may show attacks without meaning them.
SOURCES = ("user_input", "tool_response", "external_document", "security_reference")


@dataclass(frozen=True)
class Policy:
    """The defaults equal those of the scans this package's results are held against."""

    max_input_bytes: int = 1 << 20
    max_decode_depth: int = 3
    max_matches_per_rule: int = 16
    max_observations: int = 4096
    max_reasons: int = 64
    max_excerpt_bytes: int = 256
    retained_excerpt_bytes: int = 4096
    threshold: str = "high"
    classes: tuple[str, ...] = CLASSES
    suppress_in_quotes: bool = False
    ml_impact: int = 75
    ml_threshold: int = 700

    def __post_init__(self) -> None:
        if self.threshold not in RISKS:
            raise ValueError(f"threshold {self.threshold!r} is none of {RISKS}")
        if unknown := set(self.classes) - set(CLASSES):
            raise ValueError(f"unknown classes {sorted(unknown)}")

    @classmethod
    def for_source(cls, source: str, **changes) -> Policy:
        """The policy for a kind of text: security references are analysed with quotes suppressed."""
        if source not in SOURCES:
            raise ValueError(f"source {source!r} is none of {SOURCES}")
        return replace(cls(suppress_in_quotes=source == "security_reference"), **changes)
