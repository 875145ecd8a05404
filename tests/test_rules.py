from __future__ import annotations

import pytest

from inkwarden import rules
from inkwarden.rules import BUILTIN, Rule, Ruleset, RulesetError, layer, parse, validate

GOOD = '[ruleset]\nname = "x"\nversion = "1"\n[[rule]]\nid = "a.b"\nclass = "override"\nseverity = 50\npattern = "stop"\ndescription = "d"\n'


def test_builtin_is_valid():
    assert len(BUILTIN.rules) == 18
    assert validate(rules.BUILTIN_RULES + rules.EXPERIMENTAL_RULES) == []


def test_parse_warns_without_literals():
    assert parse(GOOD).warnings


@pytest.mark.parametrize(
    "change",
    [
        ('id = "a.b"', 'id = "A"'), ('class = "override"', 'class = "concealment"'), ("severity = 50", "severity = 101"), ('pattern = "stop"', 'pattern = "(?=stop)"'),
        ('pattern = "stop"', 'pattern = "(a)\\\\1"'), ('pattern = "stop"', 'pattern = "("'), ('pattern = "stop"', 'pattern = "((a{1000}){1000}){9}"'), ('description = "d"', 'description = " "'),
        ('description = "d"', 'description = "d"\nanchor = "end"'), ('description = "d"', 'description = "d"\nnew = 1'), ("severity = 50\n", ""),
    ],
)
def test_parse_refuses(change):
    with pytest.raises(RulesetError):
        parse(GOOD.replace(*change))


def test_layers_replace_join_and_disable():
    added = Ruleset("t", "1", (Rule("override.new_identity", "override", 10, "x", ("x",), "d"), Rule("my.rule", "override", 20, "y", ("y",), "d")))
    merged = layer(BUILTIN, added, disable=("my.rule",))
    by_id = {r.id: r for r in merged.rules}
    assert len(merged.rules) == 19 and by_id["override.new_identity"].severity == 10 and not by_id["my.rule"].enabled
    assert merged.digest != BUILTIN.digest and layer(BUILTIN).digest == BUILTIN.digest
    with pytest.raises(RulesetError):
        layer(BUILTIN, disable=("no.such",))


def test_load_is_all_or_nothing(tmp_path):
    (tmp_path / "good.toml").write_text(GOOD)
    assert len(rules.load([str(tmp_path / "good.toml")]).rules) == 19
    with pytest.raises(RulesetError, match="gone.toml"):
        rules.load([str(tmp_path / "good.toml"), str(tmp_path / "gone.toml")])


def test_identity_tells_supplied_rules_from_built_in_ones():
    from dataclasses import replace

    from inkwarden.rules import BUILTIN, layer

    same = replace(BUILTIN, rules=tuple(replace(r) for r in BUILTIN.rules))
    assert same.identity == BUILTIN.identity and len(BUILTIN.identity) == 16
    own = replace(BUILTIN.rules[0], description="mine")
    assert layer(BUILTIN, replace(BUILTIN, rules=(own,))).identity != BUILTIN.identity
    assert layer(BUILTIN, disable=(BUILTIN.rules[0].id,)).identity != BUILTIN.identity
