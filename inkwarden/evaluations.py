"""Registered queries of the evaluation side: sampling, rates, gates, comparisons, tiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sqltext as S
from .corpus import PAYLOADS, POSITIONS, scan_corpus, with_payload
from .functions import sanitize as shown
from .functions import segments as segmenting
from .operators import decoding, matching
from .plans import metrics, outliers, sampling
from .queries import FOUND, SCORED, gap_array, judged, query, table
from .rules import BUILTIN, EXPERIMENTAL_RULES, Ruleset, layer

PER_STRATUM = 5
_SHA = "sha256(coalesce(text, ''))"
_DEDUP = f"dedup AS (SELECT * FROM (SELECT *, {_SHA} AS sha256, row_number() OVER (PARTITION BY {_SHA} ORDER BY source, lang, doc_id) AS rn FROM documents) WHERE rn = 1)"
_MILLE = "CASE WHEN {n} > 0 THEN ({h} * 1000 + {n} // 2) // {n} ELSE 0 END"


def per_mille(h: str, n: str) -> str:
    return f"({_MILLE.format(h=h, n=n)})::BIGINT"


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("sha256", sampling.content_hash(F.col("text")))


# ---- sampling -------------------------------------------------------------------------------


@query(f"WITH {_DEDUP} SELECT sha256, doc_id, source, lang FROM dedup")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return sampling.dedup_exact(rows, "source", "lang", "doc_id").select("sha256", "doc_id", "source", "lang")


@query(f"WITH {_DEDUP} SELECT sha256, doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256) AS n FROM dedup) WHERE n <= {PER_STRATUM}")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified(dedup_exact(spark, sf_dir), "source", PER_STRATUM).select("sha256", "doc_id", "source")


@query(f"""SELECT sha256, low AS toxic, n::BIGINT AS n_rows FROM (SELECT {_SHA} AS sha256, min(toxic) AS low, max(toxic) AS high, count(*) AS n
FROM documents JOIN labels USING (doc_id) GROUP BY 1) WHERE low = high""")
def label_conflict_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hashed(spark, sf_dir).select("doc_id", "sha256").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    return sampling.without_conflicts(rows, "toxic")


_EXPOSED = "SELECT sha256(coalesce(text, '')) AS sha256 FROM benchmark UNION ALL SELECT sha256(coalesce(text, '')) FROM documents WHERE doc_id % 7 = 0"


@query(f"SELECT doc_id, {_SHA} AS sha256 FROM documents WHERE {_SHA} NOT IN (SELECT sha256 FROM ({_EXPOSED}))")
def exposure_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text neither the benchmark nor an exposed part of the corpus holds."""
    rows = _hashed(spark, sf_dir).select("doc_id", "sha256")
    exposed = table(spark, sf_dir, "benchmark").select(sampling.content_hash(F.col("text")).alias("sha256")).unionByName(rows.where("doc_id % 7 = 0").select("sha256"))
    return sampling.without_exposed(rows, exposed).select("doc_id", "sha256")


@query(f"SELECT doc_id, left({_SHA}, 16) AS id, {_SHA} AS sha256, source, lang AS language, strlen(coalesce(text, ''))::BIGINT AS bytes FROM documents")
def content_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.manifest(table(spark, sf_dir, "documents"))


@query(f"""WITH m AS (SELECT DISTINCT left({_SHA}, 16) AS id, {_SHA} AS sha256 FROM documents),
listed AS (SELECT id, CASE WHEN substr(id, 1, 1) = '0' THEN reverse(sha256) ELSE sha256 END AS sha256 FROM m WHERE substr(id, 1, 1) <> '1' UNION ALL SELECT 'ffff-unknown', 'x')
SELECT coalesce(m.id, l.id) AS id, CASE WHEN m.id IS NULL THEN 'missing' WHEN l.id IS NULL THEN 'unlisted' ELSE 'changed' END AS problem FROM m FULL JOIN listed l ON m.id = l.id
WHERE m.id IS NULL OR l.id IS NULL OR m.sha256 <> l.sha256""")
def manifest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a list with some hashes spoilt, some ids left out and one that is unknown."""
    have = sampling.manifest(table(spark, sf_dir, "documents")).select("id", "sha256").distinct()
    first = F.substring("id", 1, 1)
    listed = have.where(first != "1").withColumn("sha256", F.when(first == "0", F.reverse("sha256")).otherwise(F.col("sha256")))
    return sampling.verify_manifest(have, listed.unionByName(spark.createDataFrame([("ffff-unknown", "x")], "id string, sha256 string")))


_ANCHORS = "CASE doc_id % 4 WHEN 0 THEN ['prepend', 'trailing'] WHEN 1 THEN ['list_item', 'comment', 'quoted'] WHEN 2 THEN ['fenced'] ELSE ['table_cell', 'block_quote', 'mid_sentence'] END"
_CARRIERS = f"carriers AS (SELECT doc_id::VARCHAR AS carrier, coalesce(text, '') AS body, source AS context, {_ANCHORS} AS anchors FROM documents)"


def _carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = F.expr("CASE doc_id % 4 WHEN 0 THEN array('prepend', 'trailing') WHEN 1 THEN array('list_item', 'comment', 'quoted') WHEN 2 THEN array('fenced') ELSE array('table_cell', 'block_quote', 'mid_sentence') END")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("carrier"), F.coalesce("text", F.lit("")).alias("body"), F.col("source").alias("context"), anchors.alias("anchors"))


def _payloads(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, t) for a, _, t in PAYLOADS], "payload_id string, payload string")


def _positions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p.id, p.before, p.after) for p in POSITIONS], "position string, before string, after string")


@query(f"""WITH {S.corpus()}, {_CARRIERS}, placed AS (SELECT *, unnest(anchors) AS a FROM carriers), rows AS (SELECT carrier || ':' || payload_id || ':' || p.position AS id, context, p.position,
  body || lead_text || payload || tail_text AS text, (strlen(body) + strlen(lead_text))::BIGINT AS inj_start, (strlen(body) + strlen(lead_text) + strlen(payload))::BIGINT AS inj_end
  FROM placed JOIN positions p ON p.position = a CROSS JOIN payloads)
SELECT id, context, position, sha256(text) AS digest, inj_start, inj_end FROM rows""")
def generate_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.generate(_carriers(spark, sf_dir), _payloads(spark), _positions(spark))
    return rows.select("id", "context", "position", F.sha2("text", 256).alias("digest"), "inj_start", "inj_end")


@query(f"WITH {S.corpus()}, {_CARRIERS} SELECT carrier, position FROM carriers, positions WHERE NOT list_contains(anchors, position)")
def generate_skipped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.skipped(_carriers(spark, sf_dir), _positions(spark))


# ---- rates ----------------------------------------------------------------------------------

_RESULTS = f"{SCORED}, results AS (SELECT v.*, source, lang, payload_id, position, kind, inj_start, inj_end, risk IN ('high', 'critical') AS detected FROM verdicts v JOIN corpus USING (doc_id))"


_CORPUS = ("doc_id", "source", "lang", "payload_id", "kind", "position", "inj_start", "inj_end", "n_bytes")


def _results(spark: SparkSession, sf_dir: str, gaps: Column | None = None) -> DataFrame:
    told = judged(spark, sf_dir, *_CORPUS, gaps=gaps)
    return told.withColumn("detected", F.col("risk").isin("high", "critical"))


@query(f"{_RESULTS} SELECT source, count(*)::BIGINT AS n, count(*) FILTER (detected)::BIGINT AS hits, {per_mille('count(*) FILTER (detected)', 'count(*)')} AS permille FROM results GROUP BY source")
def per_source_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.tally(_results(spark, sf_dir), "source")


_STRATA = ("source", "lang", "payload_id", "position", "kind")


@query(f"{_RESULTS}, s AS (" + " UNION ALL ".join(f"SELECT '{c}' AS stratum, {c} AS value, detected FROM results" for c in _STRATA) + f""")
SELECT stratum, value, count(*)::BIGINT AS n, count(*) FILTER (detected)::BIGINT AS hits, {per_mille('count(*) FILTER (detected)', 'count(*)')} AS permille FROM s WHERE value IS NOT NULL GROUP BY ALL""")
def slice_strata_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.strata(_results(spark, sf_dir), list(_STRATA))


_SLICES = [("prepend", True, 900), ("trailing", True, 0), ("fenced", True, None), ("quoted", False, None), ("comment", True, 1000)]
_SLICE_SQL = ", ".join(f"('{a}', {str(b).lower()}, {'NULL' if c is None else c})" for a, b, c in _SLICES)


@query(f"""{_RESULTS}, slices(slice, gated, baseline) AS (VALUES {_SLICE_SQL}), rates AS (SELECT position AS slice, count(*)::BIGINT AS n, count(*) FILTER (detected)::BIGINT AS hits FROM results GROUP BY 1),
r AS (SELECT *, {per_mille('hits', 'n')} AS permille FROM rates) SELECT slice, n, hits, permille, coalesce(permille > baseline, false) AS regressed, baseline IS NULL AS unpinned, permille <= 10 AS criterion_met FROM r JOIN slices USING (slice) WHERE gated""")
def fp_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = spark.createDataFrame(_SLICES, "slice string, gated boolean, baseline long")
    return metrics.gate(metrics.tally(_results(spark, sf_dir), "position").withColumnRenamed("position", "slice"), slices, 10).drop("baseline")


@query(f"""{_RESULTS}, hit AS (SELECT r.doc_id, r.position, bool_or(f."start" < inj_end AND inj_start < f."end") AS on_span FROM results r JOIN found f USING (doc_id) GROUP BY ALL)
SELECT position, count(*)::BIGINT AS n, count(*) FILTER (on_span)::BIGINT AS hits, {per_mille('count(*) FILTER (on_span)', 'count(*)')} AS permille FROM hit GROUP BY position""")
def span_localisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan_corpus(spark, sf_dir).select("position", "inj_start", "inj_end", matching.observation_array(F.col("text")).alias("found")).where(F.size("found") > 0)
    on_span = F.exists("found", lambda f: (f["start"] < F.col("inj_end")) & (F.col("inj_start") < f["end"]))
    return metrics.tally(rows.withColumn("on_span", on_span), "position", hit="on_span")


_MIXED = "CASE WHEN doc_id % 3 = 0 THEN payload ELSE to_base64(encode(payload)) END"


@query(f"""WITH {S.encoded_corpus(_MIXED)}, direct AS (WITH {S.findings("e")} SELECT DISTINCT doc_id FROM found),
coded AS (SELECT doc_id, payload AS text FROM documents JOIN payloads ON doc_id % {len(PAYLOADS)} = i WHERE doc_id % 3 <> 0), nested AS (WITH {S.findings("coded")} SELECT DISTINCT doc_id FROM found)
SELECT true AS direct, count(*)::BIGINT AS n_docs FROM direct HAVING count(*) > 0 UNION ALL SELECT false, count(*)::BIGINT FROM nested WHERE doc_id NOT IN (SELECT doc_id FROM direct) HAVING count(*) > 0""")
def direct_vs_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which something is found as they are, and those in which only what a base64 run decodes to gives a finding."""
    rows = scan_corpus(spark, sf_dir).select(with_payload(lambda p: F.when(F.col("doc_id") % 3 == 0, p).otherwise(decoding.to_base64(p.cast("binary")))).alias("text"), "doc_id")
    told = rows.select(decoding.reach(F.col("text"), kinds=("base64",)).alias("r")).select("r.*")
    # Counted rather than filtered: Spark would ask Python once more for what a filter reads.
    return told.groupBy("direct").agg(F.count_if(F.expr("direct OR nested")).alias("n_docs")).where("n_docs > 0")


_GAPS = f"""gaps AS (SELECT doc_id, 'max_input_bytes' AS cause FROM corpus WHERE strlen(text) > 2000 UNION ALL
  SELECT DISTINCT doc_id, 'max_matches_per_rule' FROM gated WHERE len(regexp_extract_all(text, pattern)) > 1)"""


@query(f"WITH {S.corpus()},\n{S.rules()},\n{S.gated()}, {_GAPS} SELECT cause, count(*)::BIGINT AS n_docs FROM gaps GROUP BY cause")
def incomplete_by_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_corpus(spark, sf_dir).select(F.explode(gap_array(1, 2000)).alias("cause")).groupBy("cause").agg(F.count("*").alias("n_docs"))


@query(f"""{_RESULTS}, {_GAPS}, c AS (SELECT count(*) FILTER (kind = 'phrase' AND lang <> 'en') AS pos, count(*) FILTER (kind = 'plain' AND lang <> 'en') AS neg FROM results)
SELECT 'multilingual_positives' AS gap, pos::BIGINT AS n FROM c UNION ALL SELECT 'multilingual_negatives', neg::BIGINT FROM c
UNION ALL SELECT 'incomplete_rows', count(DISTINCT doc_id)::BIGINT FROM gaps UNION ALL SELECT 'missed_phrases', count(*)::BIGINT FROM results WHERE kind = 'phrase' AND NOT detected""")
def known_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run can't say, as counts: each becomes a sentence of the report if it isn't zero."""
    conditions = {"multilingual_positives": "kind = 'phrase' AND lang <> 'en'", "multilingual_negatives": "kind = 'plain' AND lang <> 'en'", "incomplete_rows": "n_gaps > 0", "missed_phrases": "kind = 'phrase' AND NOT detected"}
    told = _results(spark, sf_dir, gaps=gap_array(1, 2000)).agg(*(F.count_if(F.expr(c)).alias(n) for n, c in conditions.items()))
    return told.unpivot([], told.columns, "gap", "n")


_BASE_SQL = "CASE doc_id % 5 WHEN 0 THEN 'block' WHEN 1 THEN 'review' ELSE 'allow' END"
_LABEL_SQL = "CASE WHEN doc_id % 11 = 0 THEN 'uncertain' WHEN kind = 'phrase' THEN 'injection' ELSE 'benign' END"
_OWN_SQL = "CASE WHEN outcome = 'clean' THEN 'allow' WHEN detected THEN 'block' ELSE 'review' END"
_PAIRS = f"{_RESULTS}, pairs AS (SELECT *, {_OWN_SQL} AS decision, {_BASE_SQL} AS base_decision, {_LABEL_SQL} AS label, doc_id % 13 = 0 AS base_incomplete, strlen(text) > 2000 AS incomplete, strlen(text) AS n_bytes FROM results JOIN (SELECT doc_id, text FROM corpus) USING (doc_id))"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir).withColumn("decision", metrics.decision_of(F.col("outcome"), F.col("detected")))
    return rows.withColumns({"base_decision": F.expr(_BASE_SQL), "label": F.expr(_LABEL_SQL), "base_incomplete": F.expr("doc_id % 13 = 0"), "incomplete": F.col("n_bytes") > 2000})


@query(f"""{_PAIRS} SELECT source, position, count(*)::BIGINT AS cases, count(*) FILTER (decision <> base_decision)::BIGINT AS disagreements, count(*) FILTER (incomplete)::BIGINT AS own_incomplete, count(*) FILTER (base_incomplete)::BIGINT AS base_incomplete FROM pairs GROUP BY ALL""")
def replay_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir)
    return rows.groupBy("source", "position").agg(F.count("*").alias("cases"), F.count_if(F.expr("decision <> base_decision")).alias("disagreements"), F.count_if("incomplete").alias("own_incomplete"), F.count_if("base_incomplete").alias("base_incomplete"))


@query(f"""{_PAIRS}, x AS (SELECT 'own' AS scanner, label, decision AS d FROM pairs UNION ALL SELECT 'baseline', label, base_decision FROM pairs)
SELECT scanner, count(*) FILTER (label = 'benign' AND d = 'block')::BIGINT AS benign_blocked, count(*) FILTER (label = 'injection' AND d = 'allow')::BIGINT AS injection_allowed, count(*) FILTER (d = 'review')::BIGINT AS reviews, count(*)::BIGINT AS labelled FROM x WHERE label <> 'uncertain' GROUP BY scanner""")
def label_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.label_checks(_pairs(spark, sf_dir))


@query(f"""WITH c AS (SELECT left({_SHA}, 16) AS id, {_SHA} AS sha256, doc_id FROM documents), a AS (SELECT doc_id AS id, sha256 FROM c WHERE doc_id % 10 <> 3),
b AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 = 5 THEN 'other' ELSE sha256 END AS base_sha256 FROM c WHERE doc_id % 10 <> 4)
SELECT problem, count(*)::BIGINT AS n FROM (SELECT CASE WHEN a.id IS NULL THEN 'no_capture' WHEN b.id IS NULL THEN 'no_baseline' WHEN sha256 <> base_sha256 THEN 'hash_differs' END AS problem FROM a FULL JOIN b ON a.id = b.id) GROUP BY problem""")
def replay_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hashed(spark, sf_dir).select(F.col("doc_id").alias("id"), "sha256")
    base = rows.where("id % 10 <> 4").select("id", F.when(F.col("id") % 10 == 5, "other").otherwise(F.col("sha256")).alias("base_sha256"))
    return metrics.paired(rows.where("id % 10 <> 3"), base).groupBy("problem").agg(F.count("*").alias("n"))


_ADMITTED = "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE score >= 85 END"


@query(f"{_PAIRS}, p AS (SELECT *, {_ADMITTED} AS admitted, CASE WHEN n_bytes < 4096 THEN 'under_4k' ELSE '4k_or_more' END AS length FROM pairs), s AS ("
       + " UNION ALL ".join(f"SELECT '{k}' AS stratum, {c} AS value, * FROM p" for k, c in (("source", "source"), ("placement", "position"), ("length", "length"), ("total", "'all'")))
       + ") SELECT stratum, value, " + ", ".join(f"count(*) FILTER ({c})::BIGINT AS {k}" for k, c in metrics.COUNTERS.items()) + " FROM s GROUP BY ALL")
def boundary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).withColumns({"admitted": F.expr(_ADMITTED), "length": F.expr("CASE WHEN n_bytes < 4096 THEN 'under_4k' ELSE '4k_or_more' END")})
    few = rows.groupBy("source", "position", "length").agg(*metrics.counts())
    names = [c for c in few.columns if c not in ("source", "position", "length")]
    each = F.array(*(F.struct(F.lit(k).alias("stratum"), c.alias("value")) for k, c in (("source", F.col("source")), ("placement", F.col("position")), ("length", F.col("length")), ("total", F.lit("all")))))
    return few.select(F.explode(each).alias("s"), *names).select("s.*", *names).groupBy("stratum", "value").agg(*(F.sum(c).alias(c) for c in names))


@query("""WITH o AS (SELECT event_type, list(value ORDER BY value) AS l FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT event_type, len(l)::BIGINT AS n, l[(len(l) - 1) * 50 // 100 + 1] AS p50, l[(len(l) - 1) * 95 // 100 + 1] AS p95, l[(len(l) - 1) * 99 // 100 + 1] AS p99 FROM o""")
def latency_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.quantiles(table(spark, sf_dir, "events"), "value", [50, 95, 99], "event_type")


@query()
def group_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of the detection rate over whole sources; the rows stay in Spark, one row a source comes to the driver."""
    groups = metrics.few_groups(metrics.tally(_results(spark, sf_dir), "source"), "source")
    low, high = metrics.bootstrap(groups, "hits", "n") or (None, None)
    return spark.createDataFrame(pd.DataFrame({"groups": [len(groups)], "low": [low], "high": [high]}), "groups long, low double, high double")


@query("SELECT source AS slice, CASE WHEN source = 'src1' THEN 'truncated' WHEN source = 'src2' THEN 'undeclared' ELSE 'complete' END AS status FROM documents GROUP BY source UNION ALL SELECT 'src_gone', 'missing'")
def run_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved results against what was declared: one slice cut short, one never declared, one never run."""
    rows = _hashed(spark, sf_dir).select(F.col("source").alias("slice"), F.col("doc_id").alias("id"), F.lit(True).alias("detected"))
    declared = rows.where("slice <> 'src2'").groupBy("slice").agg(F.count("*").alias("want_rows"), F.bit_xor(F.xxhash64("id", "detected")).alias("want_digest"))
    declared = declared.withColumn("want_rows", F.col("want_rows") + (F.col("slice") == "src1").cast("long")).unionByName(spark.createDataFrame([("src_gone", 1, 0)], "slice string, want_rows long, want_digest long"))
    return metrics.integrity(rows, declared)


@query(f"SELECT sha256, count(DISTINCT doc_id % 3)::BIGINT AS n_splits FROM (SELECT {_SHA} AS sha256, doc_id FROM documents) GROUP BY 1 HAVING count(DISTINCT doc_id % 3) > 1")
def capture_split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.leakage(_hashed(spark, sf_dir).withColumn("split", F.col("doc_id") % 3), "sha256")


@query("SELECT source, lang, coalesce(toxic::VARCHAR, 'unlabelled') AS label, count(*)::BIGINT AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def capture_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left").groupBy("source", "lang", F.coalesce(F.col("toxic").cast("string"), F.lit("unlabelled")).alias("label")).agg(F.count("*").alias("n"))


# ---- vectors, windows, tiers ----------------------------------------------------------------

_SCORES = """v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
s AS (SELECT label, i, sum(x) AS t FROM v GROUP BY ALL), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
outliers AS (SELECT vec_id, v.label, greatest(0, least(2000, round(1000 - 1000 * (sum(x * t) - sum(x * x)) / (any_value(n) - 1))))::INT AS score FROM v JOIN s USING (label, i) JOIN n ON n.label = v.label GROUP BY vec_id, v.label)"""


def _outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.outlier_scores(table(spark, sf_dir, "embeddings"))


@query(f"WITH {_SCORES} SELECT vec_id, label, score FROM outliers")
def sibling_outlier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outliers(spark, sf_dir)


@query(f"WITH {_SCORES} SELECT vec_id, label, score, (SELECT count(*) FROM outliers b WHERE b.label = a.label AND b.score >= a.score)::BIGINT AS rank FROM outliers a")
def outlier_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.ranks(_outliers(spark, sf_dir)).select("vec_id", "label", "score", "rank")


@query(f"WITH {_SCORES}, t AS (SELECT coalesce(max(score) FILTER (label % 2 = 0), -1) + 1 AS threshold FROM outliers) SELECT threshold::INT AS threshold, count(*) FILTER (label % 2 = 1)::BIGINT AS n, count(*) FILTER (label % 2 = 1 AND score >= threshold)::BIGINT AS hits FROM outliers, t GROUP BY threshold")
def zero_fpr_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.zero_fpr(_outliers(spark, sf_dir), F.col("label") % 2 == 0)


@query(f"WITH {_SCORES}, o AS (SELECT label, list(score ORDER BY score) AS l FROM outliers GROUP BY 1) SELECT label, len(l)::BIGINT AS n, " + ", ".join(f"l[(len(l) - 1) * {p} // 100 + 1] AS p{p}" for p in (0, 25, 50, 75, 100)) + " FROM o")
def score_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.quantiles(_outliers(spark, sf_dir), "score", [0, 25, 50, 75, 100], "label")


@query()
def segment_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmenting.segments(scan_corpus(spark, sf_dir), keep=("doc_id", "position")).groupBy("position", "kind").agg(F.count("*").alias("n"), F.count_if("trailing").alias("n_trailing"))


@query()
def span_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment that holds most of each payload: the last of equals; split, isolated or diluted."""
    # Segments count code points, so the payload's bytes are turned into characters first.
    corpus = scan_corpus(spark, sf_dir)
    head = F.length(F.expr("substring(cast(encode(text, 'utf-8') as binary), 1, cast(inj_start as int))").cast("string")).cast("long")
    corpus = corpus.withColumn("a", head).withColumn("b", F.col("a") + F.col("inj_end") - F.col("inj_start"))
    parts = segmenting.segments(corpus, keep=("doc_id", "position", "a", "b"))
    overlap = F.greatest(F.lit(0), F.least("end", "b") - F.greatest("start", "a"))
    best = F.max_by(F.struct("kind", overlap.alias("overlap"), (F.col("end") - F.col("start")).alias("size")), F.struct(overlap, "place"))
    told = parts.groupBy("doc_id", "position", "a", "b").agg(best.alias("s")).where("s.overlap > 0")
    size = F.col("b") - F.col("a")
    placement = F.when(F.col("s.overlap") < size, "split").when(F.col("s.size") <= size + F.floor(size / 2), "isolated").otherwise("diluted")
    return told.groupBy("position", F.col("s.kind").alias("kind"), placement.alias("placement")).agg(F.count("*").alias("n"))


_TOKENS = r"len(regexp_extract_all(text, '[A-Za-z0-9]+'))"
_WINDOWS = f"""t AS (SELECT doc_id, {_TOKENS}::BIGINT AS n_tokens FROM documents), c AS (SELECT *, 1 + (greatest(n_tokens - 510, 0) + 446) // 447 AS k FROM t),
w AS (SELECT doc_id, n_tokens, unnest(range(0, k)) AS w FROM c WHERE k <= 16), windows AS (SELECT doc_id, w::INT AS "window", (w * 447)::BIGINT AS token_start, least(w * 447 + 510, n_tokens)::BIGINT AS token_end FROM w)"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit("[A-Za-z0-9]+")).cast("long").alias("n_tokens"))
    return outliers.windows(tokens, 510, 63, 16)


@query(f'WITH {_WINDOWS} SELECT doc_id, "window", token_start, token_end FROM windows')
def ml_window_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir)


@query(f"""{SCORED}, {_WINDOWS}, raw AS (SELECT doc_id, "window", (doc_id * 37 + "window" * 101) % 1001 AS raw FROM windows), best AS (SELECT doc_id, max(raw) AS raw FROM raw GROUP BY 1)
SELECT v.doc_id, n_reasons + CASE WHEN coalesce(raw >= 700, false) THEN 1 ELSE 0 END AS n_reasons, (CASE WHEN raw >= 700 THEN greatest(score, 75) ELSE score END)::INT AS score, (CASE WHEN raw IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_gaps,
raw::BIGINT AS raw, CASE WHEN raw IS NULL THEN 'unavailable' WHEN raw >= 700 THEN 'finding' ELSE 'below' END AS ml FROM verdicts v LEFT JOIN best USING (doc_id)""")
def ml_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in scorer gives each window a number; documents beyond the window budget have none."""
    scored = _windows(spark, sf_dir).withColumn("raw", (F.col("doc_id") * 37 + F.col("window") * 101) % 1001)
    told = judged(spark, sf_dir, "doc_id").select("doc_id", "n_reasons", "score", "n_gaps")
    return outliers.ml_merge(told, outliers.document_score(scored))


_REVIEW = {
    "role": ("description_of_an_instruction", "instruction", "unrelated"), "relation": ("is_what_the_document_shows", "rides_along"), "addressed": ("human_reader", "processing_agent", "nobody"),
    "framing": ("presented_as_example", "presented_as_data", "none", "presented_as_report", "none"), "third_party": ("quoted_third_party", "author"), "purpose": ("no", "yes", "unclear"),
}
_REVIEW_PRIMES = {"role": 1, "relation": 3, "addressed": 6, "framing": 18, "third_party": 90, "purpose": 180}
_REVIEW_SQL = ", ".join(f"[{', '.join(repr(x) for x in v)}][(doc_id // {_REVIEW_PRIMES[k]}) % {len(v)} + 1] AS {k}" for k, v in _REVIEW.items())
_JUDGED = f"""{FOUND}, j AS (SELECT f.*, {_REVIEW_SQL} FROM found f), judged AS (SELECT *, CASE WHEN role = 'description_of_an_instruction' AND relation = 'is_what_the_document_shows' AND addressed <> 'processing_agent'
  AND (framing IN ('presented_as_example', 'presented_as_data', 'presented_as_report') OR third_party = 'quoted_third_party' OR purpose = 'yes') THEN 'demoted' ELSE 'confirmed' END AS judgement FROM j)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.observations(scan_corpus(spark, sf_dir))
    pick = lambda k: F.element_at(F.array(*(F.lit(x) for x in _REVIEW[k])), (F.floor(F.col("doc_id") / _REVIEW_PRIMES[k]) % len(_REVIEW[k]) + 1).cast("int"))
    judgement = outliers.span_judgement(*(pick(k) for k in ("role", "relation", "addressed", "framing", "third_party", "purpose")))
    return found.withColumn("judgement", judgement)


@query(f'{_JUDGED} SELECT doc_id, rule_id, "start", judgement FROM judged')
def span_judgement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("doc_id", "rule_id", "start", "judgement")


@query(f"""{_JUDGED} SELECT authority, count(*) FILTER (authority = 'advisory' OR judgement <> 'demoted')::BIGINT AS n_active, count(*) FILTER (authority <> 'advisory' AND judgement = 'demoted')::BIGINT AS n_suppressed
FROM judged, (VALUES ('advisory'), ('may_release')) a(authority) GROUP BY authority""")
def release_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _judged(spark, sf_dir)
    both = [outliers.release(judged, may).withColumn("authority", F.lit(name)) for name, may in (("advisory", False), ("may_release", True))]
    return both[0].unionByName(both[1]).groupBy("authority").agg(F.count_if("active").alias("n_active"), F.count_if(F.expr("NOT active")).alias("n_suppressed"))


@query("""WITH asked AS (SELECT doc_id // 4 AS review_id, doc_id AS evidence_id FROM documents), answered AS (SELECT review_id, evidence_id FROM asked WHERE evidence_id % 9 <> 4
  UNION ALL SELECT review_id, evidence_id FROM asked WHERE evidence_id % 14 = 5 UNION ALL SELECT review_id, -evidence_id FROM asked WHERE evidence_id % 22 = 7),
b AS (SELECT review_id, evidence_id, count(*) AS got FROM answered GROUP BY ALL), j AS (SELECT coalesce(a.review_id, b.review_id) AS review_id, a.evidence_id IS NOT NULL AS want, got FROM asked a FULL JOIN b ON a.review_id = b.review_id AND a.evidence_id = b.evidence_id)
SELECT review_id::BIGINT AS review_id, count(*) FILTER (got IS NULL)::BIGINT AS missing, count(*) FILTER (NOT want)::BIGINT AS unknown, count(*) FILTER (got > 1 AND want)::BIGINT AS repeated, count(*) FILTER (got IS NULL OR NOT want OR got > 1) = 0 AS accepted FROM j GROUP BY review_id""")
def review_coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 4).alias("review_id"), F.col("doc_id").alias("evidence_id"))
    answered = asked.where("evidence_id % 9 <> 4").unionByName(asked.where("evidence_id % 14 = 5")).unionByName(asked.where("evidence_id % 22 = 7").withColumn("evidence_id", -F.col("evidence_id")))
    return outliers.review_coverage(asked, answered)


_LAYERED = layer(BUILTIN, Ruleset("trial", "1", EXPERIMENTAL_RULES), disable=("boundary.forged_role_marker",))


@query(f"WITH {S.corpus()},\n{S.findings().replace(S.rules(), S.rules(_LAYERED), 1)} SELECT rule_id, count(*)::BIGINT AS n FROM found GROUP BY rule_id")
def ruleset_layering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.observations(scan_corpus(spark, sf_dir), _LAYERED).groupBy("rule_id").agg(F.count("*").alias("n"))


@query("SELECT page_id, sha256(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS digest FROM pages")
def markup_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(shown.markup(F.col("html")), 256).alias("digest"))


@query()
def sanitize_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching.observations(scan_corpus(spark, sf_dir)).select("doc_id", "rule_id", "start", F.concat("matched", F.lit("‮ \n")).alias("matched"))
    return shown.sanitized(rows, "matched", 24).select("doc_id", "rule_id", "start", "matched_shown", "matched_truncated")
