"""Pattern rules: the built-in set, loading and validating further ones, layering.

A rule is data. It fires where its pattern matches and one of its literals occurs somewhere
in the same text (letters A to Z in either case); a rule without literals always may.
"""

from __future__ import annotations

import hashlib
import re
import tomllib
from dataclasses import dataclass, field, replace

CLASSES = ("override", "boundary", "solicitation", "agent_directed", "external_action", "privilege", "concealment", "confusable")
#: Classes that rules can declare; the last two are detected by code.
RULE_CLASSES = CLASSES[:6]
ANCHORS = ("any", "frame")
MAX_RULES, MAX_PATTERN_BYTES, MAX_REPEATS = 1024, 512, 1_000_000
_ID = re.compile(r"[a-z0-9_]+(\.[a-z0-9_]+)+")


class RulesetError(ValueError):
    """A rule set that can't be used; it names the file and the rule."""


def spelled(pattern: str) -> str:
    """A pattern with Python's spelling of code points and of the end of a text."""
    points = re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern)
    return re.sub(r"(?<!\\)((?:\\\\)*)\\z", r"\1\\Z", points)


@dataclass(frozen=True)
class Rule:
    id: str
    rule_class: str
    severity: int
    pattern: str
    literals: tuple[str, ...] = ()
    description: str = ""
    anchor: str = "any"
    fires_in_quotes: bool = False
    enabled: bool = True

    @property
    def python_pattern(self) -> str:
        """The pattern in Python's spelling of code points and of the end of a text."""
        return spelled(self.pattern)


@dataclass(frozen=True)
class Bands:
    low: int = 20
    medium: int = 45
    high: int = 70
    critical: int = 90


@dataclass(frozen=True)
class Ruleset:
    name: str
    version: str
    rules: tuple[Rule, ...]
    bands: Bands = Bands()
    warnings: tuple[str, ...] = field(default=(), compare=False)

    @property
    def active(self) -> tuple[Rule, ...]:
        return tuple(r for r in self.rules if r.enabled)

    @property
    def digest(self) -> str:
        """First 8 bytes, in hex, of the SHA-256 over all rules in order of id and the bands."""
        told = hashlib.sha256()
        for rule in sorted(self.rules, key=lambda r: r.id):
            for part in (rule.id, rule.rule_class, str(rule.severity), rule.pattern, *sorted(rule.literals), rule.anchor, str(rule.fires_in_quotes), str(rule.enabled)):
                told.update(f"{len(part.encode())}:{part}".encode())
        told.update(repr(self.bands).encode())
        return told.hexdigest()[:16]


    @property
    def identity(self) -> str:
        """The digest, and where each rule comes from and under which limits it was let in: what a verdict names."""
        own = {r.id: "builtin" if BUILTIN_BY_ID.get(r.id) == replace(r, enabled=True) else "supplied" for r in self.rules}
        told = "|".join([self.digest, *(f"{k}={v}" for k, v in sorted(own.items())), str((MAX_RULES, MAX_PATTERN_BYTES, MAX_REPEATS))])
        return hashlib.sha256(told.encode()).hexdigest()[:16]


# Ids, classes, severities, patterns, literals and anchors of the built-in rules.
BUILTIN_RULES = (
    Rule(
        'override.disregard_prior',
        'override',
        85,
        r'''(?i)\b(ignore|disregard|forget|override|bypass)\b(?:[^.\n]|\.[^\s\n]){0,40}\b(previous|prior|above|earlier|all|any|your)\b(?:[^.\n]|\.[^\s\n]){0,25}\b(instruction|prompt|rule|direction|guideline|constraint|context)s?\b''',
        ('ignore', 'disregard', 'forget', 'override', 'bypass'),
        'Tells the reader to drop earlier instructions.',
    ),
    Rule(
        'override.forget_everything',
        'override',
        80,
        r'''(?i)\b(forget|disregard|ignore)\s+everything\b''',
        ('forget everything', 'disregard everything', 'ignore everything'),
        'Tells the reader to drop all context.',
    ),
    Rule(
        'override.new_identity',
        'override',
        75,
        r'''(?i)\byou are (now|no longer)\b|\bact as if you\b''',
        ('you are now', 'you are no longer', 'act as if you'),
        'Assigns the reader a new identity.',
    ),
    Rule(
        'override.new_instructions_follow',
        'override',
        70,
        r'''(?i)\b(new|updated|revised)\s+instructions?\b\s*[:.]''',
        ('new instruction', 'updated instruction', 'revised instruction'),
        'Announces replacement instructions.',
    ),
    Rule(
        'boundary.forged_role_marker',
        'boundary',
        80,
        r'''(?i)(?:\[\s*(?:system|assistant)\s*\]|<\|\s*(?:system|assistant)\s*\|>|\b(?:system|assistant)\s*:)''',
        ('system:', 'assistant:', '[system]', '<|im_start|>', '### system'),
        'Imitates the marker of another speaker.',
        anchor='frame',
    ),
    Rule(
        'boundary.forged_tool_result',
        'boundary',
        80,
        r'''(?i)(</?tool_result|tool_output\s*:|function_results)''',
        ('<tool_result', '</tool_result', 'tool_output:', 'function_results'),
        'Imitates the frame of a tool result.',
    ),
    Rule(
        'boundary.delimiter_breakout',
        'boundary',
        70,
        r'''(?i)-{2,}\s*(end of (document|user input|context)|begin system)''',
        ('end of document', 'end of user input', 'begin system', 'end context'),
        'Imitates the end of the data.',
    ),
    Rule(
        'solicitation.system_prompt',
        'solicitation',
        70,
        r'''(?i)\b(reveal|repeat|print|show|output|display|dump|verbatim|disclose)\b(?:[^.\n]|\.[^\s\n]){0,30}\b(system prompt|your instructions|initial prompt|your prompt)\b''',
        ('system prompt', 'your instructions', 'initial prompt', 'your prompt'),
        "Asks for the reader's own prompt.",
    ),
    Rule(
        'solicitation.credentials',
        'solicitation',
        85,
        r'''(?i)\b(print|output|reveal|send|forward|exfiltrate|email|upload|list|read|include|attach|embed|append|pass)\b(?:[^.\n]|\.[^\s\n]){0,40}(?:\b(environment variables?|api keys?|id_rsa|credentials?|access tokens?|secrets?)\b|~?/?\.(?:aws/credentials|env\b|npmrc|git-credentials|ssh/id_[a-z0-9]+))''',
        ('environment variable', 'api key', 'id_rsa', 'credentials', 'access token', '.env', '.npmrc', '.aws/credentials', '.git-credentials'),
        'Asks for credentials or secrets.',
    ),
    Rule(
        'solicitation.tool_enumeration',
        'solicitation',
        55,
        r'''(?i)\b(list|enumerate|describe|show)\b(?:[^.\n]|\.[^\s\n]){0,25}\b(your )?(available )?tools?\b''',
        ('your available tools', 'list your tools', 'your tool schemas'),
        "Asks for a list of the reader's tools.",
    ),
    Rule(
        'boundary.forged_system_directive',
        'boundary',
        85,
        r'''(?i)\bsystem[ _-]?override\b''',
        ('system override', 'system_override', 'system-override'),
        'Imitates a directive of the system.',
    ),
    Rule(
        'agent_directed.addressed_marker',
        'agent_directed',
        80,
        r'''(?i)\b(?:(?:note|message|instruction|reminder)s?\s+(?:to|for)\s+(?:the|any|your|this|processing)?\s*(?:ai|a\.i\.|assistant|llm|agent|model|bot|copilot|chatbot)\b|(?:ai|assistant|llm|agent)[ _-]?(?:note|notice|directive|instruction)s?\s*:|(?:dear|attention)\s+(?:ai|assistant|agent|llm)\b|(?:if\s+)?you(?:[\x27\x{2019}]re|\s+are)\s+(?:an?\s+)?(?:ai|assistant|llm|language\s+model)\b)''',
        ('note to', 'note for', 'message to', 'notes to', 'dear ai', 'dear assistant', 'dear agent', 'attention ai', 'attention assistant', 'attention agent', 'ai note', 'ai-note', 'ai_note', 'assistant note', 'agent note', 'llm note', 'ai directive', 'assistant directive', 'ai instruction', 'assistant instruction', 'you are an ai', "you're an ai", 'you are a language model', 'you are an assistant'),
        'Speaks to an assistant rather than a person.',
    ),
    Rule(
        'solicitation.actionable_disclosure',
        'solicitation',
        75,
        r'''(?i)(?:reveal|share|output|forward|send|exfiltrate)\b(?:[^.\n]|\.[^\s\n]){0,80}(?:\b(?:emails?|credentials?|api[ _-]?keys?|access|permissions?|passwords?|tokens?|accounts?|admin|system\s+prompts?|candidates?|records?|configurations?)\b|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|https?://|www\.)''',
        ('reveal', 'share', 'output', 'forward', 'send', 'exfiltrate'),
        'Orders something disclosed or sent away.',
        anchor='frame',
    ),
    Rule(
        'external_action.actionable_directive',
        'external_action',
        75,
        r'''(?i)(?:grant|approve|update|modify|delete|execute|transfer)\b(?:[^.\n]|\.[^\s\n]){0,80}(?:\b(?:emails?|credentials?|api[ _-]?keys?|access|permissions?|passwords?|tokens?|accounts?|admin|system\s+prompts?|candidates?|records?|configurations?|capabilit(?:y|ies)|status(?:es)?|scores?|evaluations?)\b|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|https?://|www\.)''',
        ('grant', 'approve', 'update', 'modify', 'delete', 'execute', 'transfer'),
        'Orders an action on outside state.',
        anchor='frame',
    ),
    Rule(
        'solicitation.actionable_disclosure_introduced',
        'solicitation',
        75,
        r'''(?i)(?:please\s+|and\s+(?:then\s+)?|then\s+|you\s+(?:must|should|need\s+to|have\s+to|are\s+required\s+to)\s+)(?:reveal|share|output|forward|send|exfiltrate)\b(?:[^.\n]|\.[^\s\n]){0,80}(?:\b(?:emails?|credentials?|api[ _-]?keys?|access|permissions?|passwords?|tokens?|accounts?|admin|system\s+prompts?|candidates?|records?|configurations?)\b|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|https?://|www\.)''',
        ('reveal', 'share', 'output', 'forward', 'send', 'exfiltrate'),
        'Orders something disclosed, after an introducing word.',
    ),
    Rule(
        'external_action.actionable_directive_introduced',
        'external_action',
        75,
        r'''(?i)(?:please\s+|and\s+(?:then\s+)?|then\s+|you\s+(?:must|should|need\s+to|have\s+to|are\s+required\s+to)\s+)(?:grant|approve|update|modify|delete|execute|transfer)\b(?:[^.\n]|\.[^\s\n]){0,80}(?:\b(?:emails?|credentials?|api[ _-]?keys?|access|permissions?|passwords?|tokens?|accounts?|admin|system\s+prompts?|candidates?|records?|configurations?|capabilit(?:y|ies)|status(?:es)?|scores?|evaluations?)\b|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|https?://|www\.)''',
        ('grant', 'approve', 'update', 'modify', 'delete', 'execute', 'transfer'),
        'Orders an action on outside state, after an introducing word.',
    ),
    Rule(
        'privilege.permission_widening',
        'privilege',
        85,
        r'''(?i)(?:\b(?:auto[ _-]?approve|autoapprove|bypass[ _-]?permissions|skip[ _-]?permissions|dangerously[ _-]?skip[ _-]?permissions)\b|\b(?:add|append|insert|put)\b[^.\n]{0,40}\b(?:allow[ _-]?list|allowlist)\b|\b(?:disable|turn\s+off)\b[^.\n]{0,30}\b(?:confirmation\s+prompts?|approval\s+prompts?|permission\s+prompts?|the\s+sandbox)\b)''',
        ('autoapprove', 'auto-approve', 'bypasspermissions', 'allow list', 'allowlist', 'skip-permissions', 'yolo'),
        "Widens the reader's own permissions.",
    ),
    Rule(
        'external_action.remote_execution',
        'external_action',
        85,
        r'''(?i)(?:\b(?:curl|wget)\b[^\n|]{0,120}\|\s*(?:sudo\s+)?(?:ba|z|k|da)?sh\b|\b(?:ba|z|k|da)?sh\s+<\(\s*(?:curl|wget)\b|\b(?:iwr|invoke-webrequest)\b[^\n|]{0,120}\|\s*(?:iex|invoke-expression)\b)''',
        ('curl', 'wget', 'iwr', 'invoke-webrequest', 'iex'),
        'Fetches a script and runs it.',
    ),
)

# Rules on trial, not loaded unless asked for.
EXPERIMENTAL_RULES = (
    Rule(
        'solicitation.actionable_directive',
        'solicitation',
        75,
        r'''(?i)(?:please\s+|and\s+(?:then\s+)?|then\s+|you\s+(?:must|should|need\s+to|have\s+to|are\s+required\s+to)\s+)?(?:forward|send|grant|approve|update|modify|delete|execute|transfer|share|reveal|output|exfiltrate)\b(?:[^.\n]|\.[^\s\n]){0,80}\b(?:emails?|credentials?|api[ _-]?keys?|access|permissions?|passwords?|tokens?|accounts?|admin|system\s+prompts?|candidates?|records?|configurations?)\b''',
        ('forward', 'send', 'grant', 'approve', 'update', 'modify', 'delete', 'execute', 'transfer', 'share', 'reveal', 'output', 'exfiltrate'),
        'Orders an action on a sensitive thing.',
        anchor='frame',
    ),
    Rule(
        'solicitation.actionable_directive_v2',
        'solicitation',
        75,
        r'''(?i)(?:please\s+|and\s+(?:then\s+)?|then\s+|you\s+(?:must|should|need\s+to|have\s+to|are\s+required\s+to)\s+)?(?:forward|send|grant|approve|update|modify|delete|execute|transfer|share|reveal|output|exfiltrate)\b(?:[^.\n]|\.[^\s\n]){0,80}(?:\b(?:emails?|credentials?|api[ _-]?keys?|access|permissions?|passwords?|tokens?|accounts?|admin|system\s+prompts?|candidates?|records?|configurations?)\b|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|https?://|www\.)''',
        ('forward', 'send', 'grant', 'approve', 'update', 'modify', 'delete', 'execute', 'transfer', 'share', 'reveal', 'output', 'exfiltrate'),
        'Orders an action on a sensitive thing or an outside address.',
        anchor='frame',
    ),
    Rule(
        'override.nondisclosure_directive',
        'override',
        70,
        r'''(?i)(?:\b(?:do\s+not|do\s*n[o']t|don[\x27\x{2019}]t|never|no\s+need\s+to)\s+(?:mention|disclose|reveal|report|flag|tell|summari[sz]e|include|note|log)\b(?:[^.\n]|\.[^\s\n]){0,60}\b(?:this|that|these|those|it|them|above|following|steps?|instructions?|changes?|summary|review|output)\b|\bwithout\s+mentioning\b|\b(?:this|it|that)\s+is\s+not\s+(?:a|an)\s+(?:prompt\s+)?injection\b|\bnot\s+a\s+prompt\s+injection\b)''',
        ('do not mention', "don't mention", 'never mention', 'without mentioning', 'do not disclose', 'do not reveal', 'do not report', 'do not flag', 'do not tell', 'do not include', 'do not summarize', 'do not summarise', 'no need to mention', 'not a prompt injection', 'not an injection'),
        'Orders silence about something, or denies being an injection.',
    ),
)

BUILTIN = Ruleset("inkwarden.builtin", "1", tuple(sorted(BUILTIN_RULES, key=lambda r: r.id)))

#: Rules that are trusted as they stand; all others count as supplied.
BUILTIN_BY_ID = {r.id: r for r in (*BUILTIN_RULES, *EXPERIMENTAL_RULES)}

_RULE_FIELDS = {"id", "class", "severity", "pattern", "literals", "description", "anchor", "fires_in_quotes", "enabled"}


def check_pattern(pattern: str) -> str | None:
    """Why a pattern can't run in time linear in the text, or None.

    Look-around, back-references and repetitions whose product is too large are refused,
    for engines that backtrack would accept them.
    """
    if len(pattern.encode()) > MAX_PATTERN_BYTES:
        return f"pattern is over {MAX_PATTERN_BYTES} bytes"
    if re.search(r"(?<!\\)\(\?(?:[=!]|<[=!])", pattern):
        return "look-around is not supported"
    if re.search(r"(?<!\\)(?:\\\\)*\\[1-9]|\(\?P=", pattern):
        return "back-references are not supported"
    try:
        re.compile(Rule("a.b", "override", 0, pattern).python_pattern)
    except re.error as error:
        return f"pattern does not compile: {error}"
    product = 1
    for low, high in re.findall(r"\{(\d+)(?:,(\d*))?\}", pattern):
        product *= max(int(high or low), 1)
    return f"repetitions multiply to over {MAX_REPEATS}" if product > MAX_REPEATS else None


def validate(rules: list[Rule] | tuple[Rule, ...], bands: Bands = Bands()) -> list[str]:
    """Warnings; a rule that can't be used raises."""
    warnings, seen = [], set()
    if len(rules) > MAX_RULES:
        raise RulesetError(f"{len(rules)} rules; at most {MAX_RULES} are allowed")
    for rule in rules:
        problems = [
            (not _ID.fullmatch(rule.id), "id must be lower-case words joined by dots"),
            (rule.id in seen, "id is used twice"),
            (rule.rule_class not in RULE_CLASSES, f"class {rule.rule_class!r} can't be declared"),
            (not 0 <= rule.severity <= 100, "severity must be from 0 to 100"),
            (rule.anchor not in ANCHORS, f"anchor {rule.anchor!r} is unknown"),
            (not rule.description.strip(), "description is missing"),
            (any(not literal for literal in rule.literals), "a literal is empty"),
        ]
        for wrong, why in problems:
            if wrong:
                raise RulesetError(f"{rule.id}: {why}")
        if why := check_pattern(rule.pattern):
            raise RulesetError(f"{rule.id}: {why}")
        if not rule.literals:
            warnings.append(f"{rule.id}: without literals its pattern runs on every text")
        seen.add(rule.id)
    levels = (bands.low, bands.medium, bands.high, bands.critical)
    if any(a >= b for a, b in zip(levels, levels[1:], strict=False)) or levels[0] < 0 or levels[-1] > 100:
        raise RulesetError("bands must ascend within 0 to 100")
    return warnings


def parse(text: str, origin: str = "<text>") -> Ruleset:
    """A rule set from TOML; unknown fields are errors."""
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        raise RulesetError(f"{origin}: {error}") from error
    if unknown := set(raw) - {"ruleset", "bands", "rule"}:
        raise RulesetError(f"{origin}: unknown {sorted(unknown)}")
    rules = []
    for row in raw.get("rule", []):
        if unknown := set(row) - _RULE_FIELDS:
            raise RulesetError(f"{origin}: {row.get('id')}: unknown {sorted(unknown)}")
        if missing := {"id", "class", "severity", "pattern", "description"} - set(row):
            raise RulesetError(f"{origin}: {row.get('id')}: missing {sorted(missing)}")
        rules.append(Rule(row["id"], row["class"], row["severity"], row["pattern"], tuple(row.get("literals", ())), row["description"], row.get("anchor", "any"), row.get("fires_in_quotes", False), row.get("enabled", True)))
    head = raw.get("ruleset", {})
    try:
        bands = Bands(**raw.get("bands", {}))
        warnings = validate(rules, bands)
    except (RulesetError, TypeError) as error:
        raise RulesetError(f"{origin}: {error}") from error
    return Ruleset(head.get("name", origin), head.get("version", "0"), tuple(sorted(rules, key=lambda r: r.id)), bands, tuple(warnings))


def layer(base: Ruleset, *added: Ruleset, disable: tuple[str, ...] = ()) -> Ruleset:
    """Later rules replace earlier ones of their id or join them; then the disabled ids are turned off."""
    rules = {r.id: r for r in base.rules}
    for more in added:
        rules |= {r.id: r for r in more.rules}
    if unknown := set(disable) - set(rules):
        raise RulesetError(f"can't disable unknown rules: {sorted(unknown)}")
    rules = {k: replace(r, enabled=r.enabled and k not in disable) for k, r in rules.items()}
    last = added[-1] if added else base
    warnings = validate(list(rules.values()), base.bands)
    return Ruleset(base.name if not added else f"{base.name}+{last.name}", base.version, tuple(sorted(rules.values(), key=lambda r: r.id)), base.bands, tuple(warnings))


def load(paths: list[str], disable: tuple[str, ...] = ()) -> Ruleset:
    """The built-in set with rule files on top, in order: all of them or none."""
    layers = []
    for path in paths:
        try:
            with open(path, encoding="utf-8") as file:
                layers.append(parse(file.read(), path))
        except OSError as error:
            raise RulesetError(f"{path}: {error}") from error
    return layer(BUILTIN, *layers, disable=disable)
