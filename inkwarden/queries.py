"""Registered queries over the shared tables, each with DuckDB SQL of the same result where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sqltext as S
from .corpus import scan_corpus, with_payload
from .operators import decoding, detection, exports, matching, scoring, structure
from .shipping import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Few enough that several documents go beyond it.
SMALL_CAP, SMALL_BUDGET, SMALL_REASONS, SMALL_INPUT = 1, 2, 2, 2000
FOUND = f"WITH {S.corpus()},\n{S.findings()}"
SCORED = f"{FOUND},\n{S.scored()}"


# ---- matching -------------------------------------------------------------------------------


@query(f"WITH {S.corpus()},\n{S.rules()},\n{S.gated()} SELECT rule_id, count(*)::BIGINT AS n_candidates FROM gated GROUP BY rule_id")
def literal_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_counts(scan_corpus(spark, sf_dir)).groupBy("rule_id").agg(F.count("*").alias("n_candidates"))


@query(f"WITH {S.corpus()},\n{S.rules()},\n{S.gated()} SELECT doc_id, rule_id, len(regexp_extract_all(text, pattern))::BIGINT AS n_matches FROM gated")
def rule_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_counts(scan_corpus(spark, sf_dir))


@query(f'{FOUND} SELECT doc_id, rule_id, rule_class, severity, "start", "end", matched FROM found')
def frame_eligible_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.observations(scan_corpus(spark, sf_dir)).drop("fires_in_quotes")


@query(f'WITH {S.corpus()},\n{S.rules()},\n{S.gated()},\n{S.spans("gated", "doc_id, rule_id", "pattern", 16)} SELECT doc_id, rule_id, "start", "end" FROM hits')
def rule_match_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    from .rules import BUILTIN

    anywhere = replace(BUILTIN, rules=tuple(replace(r, anchor="any") for r in BUILTIN.rules))
    return matching.observations(scan_corpus(spark, sf_dir), anywhere).select("doc_id", "rule_id", "start", "end")


@query(f"""WITH {S.corpus()},\n{S.rules()},\n{S.gated()} SELECT doc_id, rule_id, least(n, {SMALL_CAP})::BIGINT AS n_kept, n > {SMALL_CAP} AS saturated
FROM (SELECT doc_id, rule_id, len(regexp_extract_all(text, pattern)) AS n FROM gated) WHERE n > 0""")
def match_cap_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.saturation(scan_corpus(spark, sf_dir), cap=SMALL_CAP)


@query(f"""WITH {S.corpus()},\n{S.findings()} SELECT doc_id, count(DISTINCT rule_id)::BIGINT AS n_rules, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rule_ids FROM found GROUP BY doc_id""")
def matching_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.observations(scan_corpus(spark, sf_dir)).groupBy("doc_id").agg(F.sort_array(F.collect_set("rule_id")).alias("r"))
    return found.select("doc_id", F.size("r").cast("long").alias("n_rules"), F.array_join("r", ",").alias("rule_ids"))


def judged(spark: SparkSession, sf_dir: str, *keep: str, gaps: Column | None = None) -> DataFrame:
    """The verdict of every corpus text, made in its own row, with the columns to keep."""
    corpus = scan_corpus(spark, sf_dir).withColumn("n_bytes", F.octet_length("text").cast("long"))
    rows = corpus.select(*keep, matching.observation_array(F.col("text")).alias("found"), (F.array() if gaps is None else gaps).cast("array<string>").alias("gaps"))
    return scoring.in_row(rows, F.col("found"), F.col("gaps"))


def gap_array(cap: int, most_bytes: int) -> Column:
    """What a scan of a corpus text with these limits leaves out, as an array of causes."""
    many = F.exists(matching.count_array(F.col("text")), lambda c: c["n_matches"] > cap)
    causes = F.array(F.when(F.octet_length("text") > most_bytes, "max_input_bytes"), F.when(many, "max_matches_per_rule"))
    return F.array_compact(causes)


@query(f"{SCORED} SELECT doc_id, n_reasons, score, risk, outcome FROM verdicts")
def verdict_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir, "doc_id").select("doc_id", "n_reasons", "score", "risk", "outcome")


@query(f"{SCORED} SELECT risk, count(*)::BIGINT AS n_docs, min(score)::INT AS low, max(score)::INT AS high FROM verdicts GROUP BY risk")
def risk_banding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict_score(spark, sf_dir).groupBy("risk").agg(F.count("*").alias("n_docs"), F.min("score").alias("low"), F.max("score").alias("high"))


@query(f"""{SCORED}, gaps AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, rule_id FROM gated WHERE len(regexp_extract_all(text, pattern)) > {SMALL_CAP}) GROUP BY doc_id)
SELECT position, outcome, count(*)::BIGINT AS n_docs FROM (SELECT v.doc_id, CASE WHEN n_reasons > 0 THEN 'risk_found' WHEN coalesce(n, 0) > 0 OR strlen(text) > {SMALL_INPUT} THEN 'inconclusive' ELSE 'clean' END AS outcome, position
  FROM verdicts v JOIN corpus USING (doc_id) LEFT JOIN gaps USING (doc_id)) GROUP BY ALL""")
def outcome_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = judged(spark, sf_dir, "position", gaps=gap_array(SMALL_CAP, SMALL_INPUT))
    return told.groupBy("position", "outcome").agg(F.count("*").alias("n_docs"))


@query(f"""{SCORED}, d AS (SELECT {S.DECIDED} AS decision FROM verdicts)
SELECT count(*)::BIGINT AS n_targets, count(*) FILTER (decision = 'clean')::BIGINT AS n_clean, count(*) FILTER (decision IN ('below', 'at_or_above'))::BIGINT AS n_findings,
count(*) FILTER (decision = 'inconclusive')::BIGINT AS n_inconclusive, (CASE WHEN bool_or(decision = 'at_or_above') THEN 1 WHEN bool_or(decision = 'below') THEN 3 WHEN bool_or(decision = 'inconclusive') THEN 2 ELSE 0 END)::INT AS exit_code FROM d""")
def exit_code_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.exit_code(verdict_score(spark, sf_dir).select(scoring.decision(F.col("outcome"), F.col("risk")).alias("decision")))


@query(f"{SCORED} SELECT doc_id, {S.DECIDED} AS decision FROM verdicts")
def threshold_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict_score(spark, sf_dir).select("doc_id", scoring.decision(F.col("outcome"), F.col("risk")).alias("decision"))


@query(f"{FOUND} SELECT rule_class, count(*)::BIGINT AS n FROM found WHERE rule_class IN ('override', 'solicitation') GROUP BY rule_class")
def class_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.observations(scan_corpus(spark, sf_dir), classes=("override", "solicitation")).groupBy("rule_class").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, strlen(coalesce(text, '')) > {SMALL_INPUT} AS oversized FROM documents")
def size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", size.alias("n_bytes"), (size > SMALL_INPUT).alias("oversized"))


@query(f"""{FOUND} SELECT doc_id, rule_id, "start", place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start", rule_id, "end")::INT AS place FROM found) WHERE place <= {SMALL_BUDGET}""")
def observation_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.budget(matching.observations(scan_corpus(spark, sf_dir)), SMALL_BUDGET).select("doc_id", "rule_id", "start", "place")


@query(f"""{FOUND}, o AS (SELECT doc_id, list(rule_id || '@' || "start" || ':' || "end" ORDER BY "start", rule_id, "end") AS l FROM found GROUP BY doc_id)
SELECT doc_id, array_to_string(l[1:{SMALL_REASONS}], ',') AS reasons, len(l)::BIGINT AS n_reasons, len(l) > {SMALL_REASONS} AS reasons_truncated FROM o""")
def reason_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.reasons(matching.observations(scan_corpus(spark, sf_dir)), SMALL_REASONS)


# ---- structure ------------------------------------------------------------------------------


@query(f"""WITH t AS (SELECT 'event:' || event_id AS id, props AS text FROM events UNION ALL SELECT 'doc:' || doc_id, text FROM documents)
SELECT id, coalesce({S.json_shape("text")}, false) AS json FROM t""")
def json_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("event:"), "event_id").alias("id"), F.col("props").alias("text"))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), "doc_id").alias("id"), "text")
    return events.unionByName(docs).select("id", F.coalesce(matching.looks_like_json(F.col("text")), F.lit(False)).alias("json"))


def _regions(spark: SparkSession, sf_dir: str, regions) -> DataFrame:
    rows = scan_corpus(spark, sf_dir).select("doc_id", F.explode(regions(F.col("text"))).alias("r"))
    return rows.select("doc_id", "r.start", "r.end")


_SPANNED = lambda pattern: f"WITH {S.corpus()},\n{S.spans('corpus', 'doc_id', S.quoted(pattern))}"
_INDENT = f"strlen(regexp_extract(matched, {S.quoted(structure.LEADING)}))"


@query(f"""WITH p AS (SELECT page_id AS doc_id, html AS text FROM pages),\n{S.spans("p", "doc_id", S.quoted(structure.COMMENT))} SELECT doc_id AS page_id, "start", "end" FROM hits""")
def html_comment_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(structure.comments(F.col("html"))).alias("r")).select("page_id", "r.start", "r.end")


@query(f"""{_SPANNED(structure.QUOTE_LINE)} SELECT doc_id, "start" + {_INDENT} AS "start", "end" FROM hits""")
def block_quote_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regions(spark, sf_dir, structure.block_quotes)


@query(f"""{_SPANNED(structure.FENCE_LINE)} SELECT a.doc_id, a."start" + strlen(regexp_extract(a.matched, {S.quoted(structure.LEADING)})) AS "start", coalesce(b."end", strlen(a.text)) AS "end"
FROM hits a LEFT JOIN hits b ON a.doc_id = b.doc_id AND b.ordinal = a.ordinal + 1 WHERE a.ordinal % 2 = 1""")
def fenced_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regions(spark, sf_dir, structure.fences)


_MARKED = " UNION ALL ".join(f"SELECT doc_id, text, {S.quoted('(?i)' + m.replace('.', chr(92) + '.'))} AS p FROM corpus" for m in structure.MARKERS)


@query(f"""WITH {S.corpus()}, marked AS ({_MARKED}),\n{S.spans("marked", "doc_id, p", "p")} SELECT doc_id, "start", least("end" + {structure.WINDOW}, strlen(text))::BIGINT AS "end" FROM hits""")
def attributive_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regions(spark, sf_dir, structure.attributive)


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.observations(structure.with_regions(scan_corpus(spark, sf_dir)), keep=("doc_id", "position", "__regions", "__comments"))


@query()
def innermost_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding with the region around it, of any kind; quote pairing is a state machine, so no SQL tells it."""
    return _placed(spark, sf_dir).select("doc_id", "rule_id", "start", structure.innermost(F.col("__regions"), F.col("start")).alias("quoted_by"))


@query()
def suppression_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.split_suppressed(_placed(spark, sf_dir), True).groupBy("quoted_by", "suppressed").agg(F.count("*").alias("n"))


@query()
def quote_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.split_suppressed(_placed(spark, sf_dir), True)
    return found.groupBy("position", "quoted_by", "suppressed").agg(F.count("*").alias("n"))


@query(f"""{FOUND}, {S.spans("corpus", "doc_id", S.quoted(structure.COMMENT), name="hidden")}
SELECT h.doc_id, h."start", h."end", max(severity)::INT AS severity, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS evidence
FROM hidden h JOIN found f ON f.doc_id = h.doc_id AND f."start" >= h."start" AND f."start" < h."end" GROUP BY ALL""")
def markup_concealment(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = scan_corpus(spark, sf_dir).withColumn("__comments", structure.comments(F.col("text")))
    return structure.conceal_markup(matching.observations(corpus, keep=("doc_id", "__comments")))


# Fixed sample of concealing characters, put into documents by their id.
_HIDDEN = ("​‌", "‮", "️︎︀", "\u0085", "\U000e0061\U000e0062", "⁦⁩", "", "​‎")
_SPOILT_SQL = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN {' || '.join(f'chr({ord(c)})' for c in h) or repr('')}" for i, h in enumerate(_HIDDEN)) + " END"


def _spoilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    extra = F.element_at(F.array(*(F.lit(h) for h in _HIDDEN)), (F.pmod("doc_id", F.lit(8)) + 1).cast("int"))
    return docs.select("doc_id", F.concat("text", F.lit("\n"), extra, F.lit("end")).alias("text"))


_KINDS = " UNION ALL ".join(f"SELECT doc_id, text, 'concealment.{k}' AS rule_id, '[{m}]+' AS p FROM spoilt" for k, m in detection.CONCEALING.items())


@query(f"""WITH spoilt AS (SELECT doc_id, text || chr(10) || {_SPOILT_SQL} || 'end' AS text FROM documents), kinds AS ({_KINDS}),\n{S.spans("kinds", "doc_id, rule_id, p", "p")}
SELECT doc_id, rule_id, "start", "end", len(matched)::BIGINT AS n_chars FROM hits""")
def concealment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.concealments(_spoilt(spark, sf_dir)).drop("recovered")


@query()
def confusable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\nignоre this раyment, сafé and ＡＢＣ\n")).alias("text"))
    return detection.confusables(docs)


# ---- decoding -------------------------------------------------------------------------------


@query(f"SELECT doc_id, sha256(translate(text, '{decoding.ROT_FROM}', '{decoding.ROT_TO}')) AS digest FROM documents")
def decode_rot13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(decoding.rot13(F.col("text")), 256).alias("digest"))


@query("SELECT doc_id, sha256(coalesce(list_aggregate(list_reverse(string_split(text, '')), 'string_agg', ''), '')) AS digest FROM documents")
def decode_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(decoding.reversed_text(F.col("text")), 256).alias("digest"))


_EVIDENCE = r"len(list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda r: NOT regexp_full_match(r, '[0-9A-Fa-f]{7,}') AND regexp_matches(r, '[A-Za-z][A-Za-z0-9]*[013457][A-Za-z0-9]*[A-Za-z]'))) > 0"


#: A last line for every document; two of three hold words that digits stand in.
_LEET_LINES = ("r3ad th1s n0w", "a calm line 2024", "d0 n0t st0p deadbeef00")
_LEET_SQL = "(SELECT doc_id, coalesce(text, '') || chr(10) || CASE doc_id % 3 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_LEET_LINES)) + " END AS text FROM documents)"


def _leet(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.element_at(F.array(*(F.lit(x) for x in _LEET_LINES)), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), line).alias("text"))


@query(f"SELECT doc_id, {_EVIDENCE} AS evidence FROM {_LEET_SQL}")
def leet_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leet(spark, sf_dir).select("doc_id", decoding.leet_evidence(F.col("text")).alias("evidence"))


@query(f"SELECT doc_id, sha256(translate(text, '{decoding.LEET_FROM}', '{decoding.LEET_TO}')) AS digest FROM {_LEET_SQL} WHERE {_EVIDENCE}")
def decode_leetspeak(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _leet(spark, sf_dir).select("doc_id", decoding.leetspeak(F.col("text")).alias("t"))
    return rows.where("t IS NOT NULL").select("doc_id", F.sha2("t", 256).alias("digest"))


_PRINTABLE = r"(strlen({t}) >= 8 AND len(regexp_replace({t}, '[^\x20-\x7E\n\r\t]', '', 'g'))::DOUBLE / strlen({t}) >= 0.85 AND contains({t}, ' '))"
_ENCODED = r"regexp_full_match({t}, '[A-Za-z0-9+/=_-]{{16,}}')"
_READS = f"({_PRINTABLE} OR {_ENCODED})"


@query(f"SELECT doc_id, coalesce({_PRINTABLE.format(t='text')}, false) AS printable FROM documents")
def printable_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(decoding.printable(F.col("text")), F.lit(False)).alias("printable"))


def _encoded_corpus(spark: SparkSession, sf_dir: str, how) -> DataFrame:
    """Whole texts with an encoded payload in its place."""
    return scan_corpus(spark, sf_dir).select("doc_id", "position", with_payload(how).alias("text"))


_BASE64 = f"""r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/=_-]{{16,}}')) AS run FROM e),
bare AS (SELECT doc_id, rtrim(CASE WHEN contains(run, '+') OR contains(run, '/') THEN run ELSE translate(run, '-_', '+/') END, '=') AS b FROM r),
bytes AS (SELECT doc_id, b, TRY(from_base64(b || repeat('=', (4 - len(b) % 4) % 4))) AS raw FROM bare WHERE len(b) % 4 <> 1 AND NOT regexp_matches(b, '[=_-]')),
d AS (SELECT doc_id, TRY(decode(raw)) AS decoded FROM bytes WHERE rtrim(to_base64(raw), '=') = b), told AS (SELECT doc_id, decoded FROM d WHERE {_READS.format(t="decoded")})"""


@query(f"""WITH {S.encoded_corpus("to_base64(encode(payload))")}, {_BASE64} SELECT doc_id, decoded FROM told""")
def decode_base64_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _encoded_corpus(spark, sf_dir, lambda p: decoding.to_base64(p.cast("binary")))
    return rows.select("doc_id", F.explode(decoding.base64_runs(F.col("text"))).alias("decoded"))


@query(f"""WITH {S.encoded_corpus("lower(hex(encode(payload))) || '0'")},
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9A-Fa-f]{{16,}}')) AS run FROM e), d AS (SELECT doc_id, TRY(decode(unhex(left(run, (len(run) - len(run) % 2)::INT)))) AS decoded FROM r)
SELECT doc_id, decoded FROM d WHERE {_READS.format(t="decoded")}""")
def decode_hex_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _encoded_corpus(spark, sf_dir, lambda p: F.concat(F.lower(F.hex(p)), F.lit("0")))
    return rows.select("doc_id", F.explode(decoding.hex_runs(F.col("text"))).alias("decoded"))


@query(f"""WITH {S.encoded_corpus("rtrim(to_base64(encode(payload)), '=')")}, {_BASE64}, plain AS (SELECT doc_id, decoded AS text FROM told),\n{S.findings("plain")} SELECT doc_id, rule_id FROM found GROUP BY ALL""")
def decoded_rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that fire in what a base64 run decodes to, nested forms left aside."""
    rows = _encoded_corpus(spark, sf_dir, lambda p: F.rtrim(decoding.to_base64(p.cast("binary")), F.lit("=")))
    found = decoding.decoded_observations(rows, max_depth=1, kinds=("base64",))
    return found.select("doc_id", "rule_id").distinct()


@query()
def decode_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of nested encodings: base64 around reversed, rot13 and hex texts."""
    rows = _encoded_corpus(spark, sf_dir, lambda p: decoding.to_base64(F.concat(F.lower(F.hex(p)), F.lit(" "), F.reverse(p)).cast("binary")))
    found = decoding.decoded_observations(rows)
    return found.groupBy("chain", "rule_id").agg(F.count("*").alias("n"))


_POLICY = (exports.Resource("credential", ("api key", "passwords", "aws credentials"), ("https://example.org/ok",)), exports.Resource("summary", ("the summary", "summary", "notes")))
_ALIASES = ", ".join(f"('{r.id}', {i}, {j}, '{a}', [{', '.join(repr(w) for w in exports.words(a))}])" for i, r in enumerate(_POLICY) for j, a in enumerate(r.aliases))
_LIST = lambda v: "(" + ", ".join(repr(x) for x in v) + ")"


@query(f"""WITH {S.corpus()}, aliases(resource, o, k, alias, ws) AS (VALUES {_ALIASES}),
toks AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS t FROM corpus),
words AS (SELECT doc_id, t, unnest(range(0, len(t))) AS i FROM toks),
live AS (SELECT doc_id, i, t[i+1] AS w FROM words WHERE NOT coalesce((i > 0 AND t[i] IN ('never', 'without')) OR (i > 1 AND t[i] = 'not' AND t[i-1] = 'do'), false)),
hits AS (SELECT doc_id, resource, o, k, alias, i AS p, len(ws) AS n FROM words JOIN aliases ON t[i+1:i+len(ws)] = ws),
near AS (SELECT h.*, v.i AS v, v.w AS verb, p > v.i AND p - v.i <= {exports.NEAR} AS names_object,
   EXISTS (SELECT 1 FROM live r WHERE r.doc_id = h.doc_id AND r.w IN {_LIST(exports.READ_VERBS)} AND r.i >= p - {exports.NEAR} AND r.i < p + n + {exports.READ_AFTER}) AS read,
   p < v.i AND EXISTS (SELECT 1 FROM words x WHERE x.doc_id = h.doc_id AND x.t[x.i+1] IN {_LIST(exports.REFERENCES)} AND x.i > v.i AND x.i <= v.i + {exports.NEAR}) AS back
 FROM hits h JOIN live v ON v.doc_id = h.doc_id AND v.w IN {_LIST(exports.EXPORT_VERBS)} AND v.i >= p - {exports.WINDOW} AND v.i < p + n + {exports.WINDOW}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, resource, v ORDER BY k, p) AS rn FROM near WHERE names_object OR (read AND back))
SELECT doc_id, resource, alias, p::INT AS alias_at, v::INT AS verb_at, verb, names_object, read FROM ranked WHERE rn = 1""")
def export_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.relations(scan_corpus(spark, sf_dir), _POLICY)


@query()
def export_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.exports(scan_corpus(spark, sf_dir), _POLICY)


@query()
def full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scan of the corpus, as a security reference: quoting suppresses."""
    from .plans.scanner import Scanner
    from .policy import Policy

    told = Scanner(policy=Policy.for_source("security_reference")).scan(scan_corpus(spark, sf_dir))
    return told.select("doc_id", "outcome", "score", "risk", "decision", F.size("reasons").alias("n_reasons"), F.size("suppressed").alias("n_suppressed"), F.array_join("incomplete", ",").alias("incomplete"))
