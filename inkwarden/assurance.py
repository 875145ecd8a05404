"""Registered queries of what surrounds an evaluation: slices, fresh samples, templates, reviews, frozen collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import PAYLOADS, scan_corpus
from .evaluations import _RESULTS, _SCORES, _SHA, _outliers, _results, per_mille
from .functions import anchors
from .operators import matching
from .plans import boundary, freezing, metrics, outliers, reviews, sampling, slices
from .policy import SOURCES
from .queries import FOUND, query, table
from .rules import BUILTIN
from .shipping import spread

_SLICES = [("prepend", "query"), ("trailing", "query"), ("fenced", "local"), ("comment", "local")]
_EXCLUSIONS = [(None, "src0"), ("fenced", "src1"), ("comment", "src2"), ("comment", "src0")]
_values = lambda rows: ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in rows)


@query(f"SELECT slice, origin FROM (VALUES {_values(_SLICES)}) s(slice, origin) WHERE slice IN ('prepend', 'fenced', 'comment') AND origin = 'local'")
def slice_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.select(spark.createDataFrame(_SLICES, "slice string, origin string"), ["prepend", "fenced", "comment"], offline=True)


@query(f"""{_RESULTS}, out(slice, source) AS (VALUES {_values(_EXCLUSIONS)}),
t AS (SELECT position AS slice, detected, EXISTS (SELECT 1 FROM out o WHERE o.source = r.source AND (o.slice IS NULL OR o.slice = r.position)) AS barred FROM results r),
c AS (SELECT slice, count(*) FILTER (NOT barred)::BIGINT AS n, count(*) FILTER (NOT barred AND detected)::BIGINT AS hits, count(*) FILTER (barred)::BIGINT AS n_excluded, count(*) FILTER (barred AND detected)::BIGINT AS hits_excluded FROM t GROUP BY slice)
SELECT *, {per_mille('hits', 'n')} AS permille FROM c""")
def gated_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir).select(F.col("position").alias("slice"), "source", "detected")
    return slices.gated_tally(rows, spark.createDataFrame(_EXCLUSIONS, "slice string, source string"))


@query()
def normalised_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", sampling.normalised_hash(F.col("text")).alias("digest"))


@query()
def fresh_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of labelled documents a source and label, none like a benchmark text or another when normalised."""
    known = table(spark, sf_dir, "benchmark").select(sampling.normalised_hash(F.col("text")).alias("norm"))
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", sampling.content_hash(F.col("text")).alias("sha256"), sampling.normalised_hash(F.col("text")).alias("norm"))
    rows = rows.join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    return sampling.fresh_sample(rows, known, "toxic", 3, "source", "toxic").select("sha256", "doc_id", "source", "toxic")


_RANKED = "ranked AS (SELECT a.*, a.vec_id % 3 AS split, (SELECT count(*) FROM outliers b WHERE b.label = a.label AND b.score >= a.score) AS rank FROM outliers a)"
_RANK_STRATA = " UNION ALL ".join(f"SELECT '{c}' AS stratum, {v} AS value, rank FROM ranked" for c, v in (("all", "'all'"), ("label", "label::VARCHAR"), ("split", "split::VARCHAR")))


@query(f"""WITH {_SCORES}, {_RANKED}, strata AS ({_RANK_STRATA}), t AS (SELECT stratum, value, count(*)::BIGINT AS n, count(*) FILTER (rank = 1)::BIGINT AS top1, count(*) FILTER (rank <= 3)::BIGINT AS top3 FROM strata WHERE value IS NOT NULL GROUP BY ALL),
m AS (SELECT *, {per_mille('top1', 'n')} AS top1_permille, {per_mille('top3', 'n')} AS top3_permille FROM t) SELECT *, CASE WHEN top1_permille >= 600 THEN 'ship' WHEN top1_permille >= 500 THEN 'continue' ELSE 'abandon' END AS verdict FROM m""")
def rank_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.rank_tallies(outliers.ranks(_outliers(spark, sf_dir)).withColumn("split", F.col("vec_id") % 3), "label", "split")


_TEMPLATE = "\n| a | @@ANCHOR:cell|-@@ |\n  @@ANCHOR:line@@\nend"
_PAYLOAD = "one | two\nthree"


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS body, doc_id % 2 = 0 AS cell FROM documents), t AS (SELECT doc_id, CASE WHEN cell THEN body || chr(10) || '| a | ' ELSE body || chr(10) || '| a | - |' || chr(10) || '  ' END AS head,
  CASE WHEN cell THEN 'one / two three' ELSE 'one | two three' END AS payload, CASE WHEN cell THEN ' |' || chr(10) || 'end' ELSE chr(10) || 'end' END AS tail FROM d)
SELECT doc_id, sha256(head || payload || tail) AS digest, strlen(head)::BIGINT AS "start", (strlen(head) + strlen(payload))::BIGINT AS "end" FROM t""")
def template_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cell = F.col("doc_id") % 2 == 0
    target, payload = F.when(cell, "cell").otherwise("line"), F.when(cell, anchors.escape(_PAYLOAD, "table_cell")).otherwise(anchors.escape(_PAYLOAD, "single_line"))
    made = docs.select("doc_id", anchors.rendered(F.concat(F.coalesce("text", F.lit("")), F.lit(_TEMPLATE)), target, payload).alias("r"))
    return made.select("doc_id", F.sha2("r.text", 256).alias("digest"), "r.start", "r.end")


_SCOPE = lambda x: f"sha256('review-1|64:' || digest || '|' || len(reasons) || ':' || reasons || '|{len(BUILTIN.digest)}:{BUILTIN.digest}|' || len({x}) || ':' || {x})"


@query(f"""{FOUND}, o AS (SELECT doc_id, string_agg(rule_id || '@' || "start" || ':' || "end", ',' ORDER BY "start", rule_id, "end") AS reasons FROM found GROUP BY doc_id),
v AS (SELECT c.doc_id, sha256(text) AS digest, coalesce(reasons, '') AS reasons FROM corpus c LEFT JOIN o USING (doc_id))
SELECT doc_id, {_SCOPE("'tool_response'")} AS scope, CASE WHEN doc_id % 7 = 3 THEN 'unanswered' WHEN doc_id % 5 = 0 THEN 'stale' ELSE 'bound' END AS status FROM v""")
def review_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of every document's findings: some were asked under another policy, some never came."""
    found = F.array_sort(F.transform(matching.observation_array(F.col("text")), lambda f: F.struct(f["start"], f["rule_id"], f["end"])))
    told = F.array_join(F.transform("found", lambda f: F.concat(f["rule_id"], F.lit("@"), f["start"].cast("string"), F.lit(":"), f["end"].cast("string"))), ",")
    rows = scan_corpus(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("digest"), found.alias("found")).select("doc_id", "digest", told.alias("reasons"))
    scoped = lambda policy: reviews.scope(F.col("digest"), F.col("reasons"), F.lit(BUILTIN.digest), policy)
    answers = rows.where("doc_id % 7 <> 3").select("doc_id", scoped(F.when(F.col("doc_id") % 5 == 0, "user_input").otherwise("tool_response")).alias("scope"))
    return reviews.bound(rows.select("doc_id", scoped(F.lit("tool_response")).alias("scope")), answers)


_OUTCOME = "CASE (doc_id + \"start\") % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'indeterminate' ELSE 'no_supported_violation' END"


@query(f"""{FOUND}, r AS (SELECT doc_id, {_OUTCOME} AS outcome, doc_id % 4 <> 0 AS enough FROM found),
t AS (SELECT doc_id, count(*) AS n, count(*) FILTER (outcome = 'no_supported_violation') AS clear, bool_and(enough) AS enough, bool_or(outcome = 'indeterminate') AS unsure FROM r GROUP BY doc_id)
SELECT doc_id, (n - CASE WHEN enough THEN clear ELSE 0 END)::BIGINT AS n_kept, (CASE WHEN enough THEN clear ELSE 0 END)::BIGINT AS n_suppressed, NOT enough OR unsure AS gap FROM t""")
def ml_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.observations(scan_corpus(spark, sf_dir)).select("doc_id", F.expr(_OUTCOME.replace('"', "`")).alias("outcome"), (F.col("doc_id") % 4 != 0).alias("context_sufficient"))
    return reviews.ml_review(found, may_release=True)


_CASES = f"""c AS (SELECT doc_id // 2 AS id, 'user' AS control_role, 'seen' AS label_reason, CASE WHEN doc_id % 50 = 7 THEN ' ' ELSE (doc_id // 3)::VARCHAR END AS "group", 'log' AS provenance, 'task' AS task_context, 'person' AS labeler,
  [{', '.join(f"'{s}'" for s in SOURCES)}, 'elsewhere'][doc_id % 5 + 1] AS source, CASE doc_id % 3 WHEN 0 THEN 'benign' WHEN 1 THEN 'injection' ELSE 'uncertain' END AS label,
  CASE WHEN doc_id % 4 = 0 THEN 'holdout' ELSE 'development' END AS split, {_SHA} AS have, CASE WHEN doc_id % 9 = 2 THEN 'other' ELSE {_SHA} END AS sha256, doc_id % 16 = 4 AS exposed FROM documents)"""
_BLANKS = ", ".join(f"count(*) FILTER (trim(\"{c}\"::VARCHAR) = '') AS blank_{c}" for c in freezing.TEXTS)


@query(f"""WITH {_CASES}, x AS (SELECT DISTINCT {_SHA} AS sha256 FROM benchmark), r AS (SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS no_cases, {_BLANKS}, count(*) FILTER (source = 'elsewhere') AS unknown_source, 0 AS unknown_label_or_split,
  count(*) FILTER (sha256 <> have) AS hash_differs, count(*) FILTER (split = 'holdout' AND exposed) AS declared_exposed, greatest(3 - count(DISTINCT source) FILTER (split = 'holdout' AND label = 'benign'), 0) AS too_few_benign_sources,
  CASE WHEN count(*) FILTER (split = 'holdout' AND label = 'injection') = 0 THEN 1 ELSE 0 END AS no_injection,
  (SELECT count(*) FROM (SELECT id FROM c GROUP BY id HAVING count(*) > 1)) AS duplicate_id, (SELECT count(*) FROM (SELECT 1 FROM c GROUP BY sha256, source, control_role HAVING count(*) > 1)) AS duplicate_case,
  (SELECT count(*) FROM (SELECT 1 FROM c GROUP BY "group" HAVING count(DISTINCT split) > 1)) AS group_crosses_splits, (SELECT count(*) FROM (SELECT 1 FROM c GROUP BY sha256 HAVING count(DISTINCT split) > 1)) AS text_crosses_splits,
  (SELECT count(*) FROM c WHERE split = 'holdout' AND sha256 IN (SELECT sha256 FROM x)) AS known_exposed, (SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM x) AS no_exclusions FROM c)
SELECT "check", n_bad::BIGINT AS n_bad FROM (UNPIVOT (SELECT COLUMNS(*)::BIGINT FROM r) ON COLUMNS(*) INTO NAME "check" VALUE n_bad)""")
def capture_freeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check of a collection made of all documents, with some faults of each kind."""
    own, held = sampling.content_hash(F.col("text")), F.col("doc_id") % 4 == 0
    names = F.array(*(F.lit(s) for s in (*SOURCES, "elsewhere")))
    cases = table(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / 2).alias("id"), *(F.lit(v).alias(k) for k, v in (("control_role", "user"), ("label_reason", "seen"), ("provenance", "log"), ("task_context", "task"), ("labeler", "person"))),
        F.when(F.col("doc_id") % 50 == 7, " ").otherwise(F.floor(F.col("doc_id") / 3).cast("string")).alias("group"), F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int")).alias("source"),
        F.expr("CASE doc_id % 3 WHEN 0 THEN 'benign' WHEN 1 THEN 'injection' ELSE 'uncertain' END").alias("label"), F.when(held, "holdout").otherwise("development").alias("split"), "text",
        F.when(F.col("doc_id") % 9 == 2, "other").otherwise(own).alias("sha256"), (F.col("doc_id") % 16 == 4).alias("previously_exposed"))
    return freezing.checks(cases, table(spark, sf_dir, "benchmark").select(own.alias("sha256")))


@query()
def boundary_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads and benchmark texts at the tokens where windows of 64 begin and end; word tokens stand in for a model's."""
    seeds = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text").unionByName(spark.createDataFrame([(a, t) for a, _, t in PAYLOADS], "id string, text string"))
    return boundary.suite(seeds, 64).select("seed", "placement", F.sha2("text", 256).alias("digest"), "start", "end", "token_start", "token_end")


@query("""SELECT source, count(*)::BIGINT AS n, round(regr_slope(ln(len(regexp_extract_all(text, '[A-Za-z0-9]+'))), ln(strlen(text))), 6) AS exponent
FROM documents WHERE strlen(text) > 0 AND len(regexp_extract_all(text, '[A-Za-z0-9]+')) > 0 GROUP BY source""")
def growth_exponent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the words of texts grow with their bytes, by source."""
    words, size = F.regexp_count("text", F.lit("[A-Za-z0-9]+")), F.octet_length("text")
    told = metrics.growth(table(spark, sf_dir, "documents"), size, F.when(words > 0, words), "source")
    return told.select("source", "n", F.round("exponent", 6).alias("exponent"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), e AS (SELECT vec_id, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n, list_max(v) AS top, v FROM v)
SELECT vec_id, round(n, 6) AS norm, round(list_max(v) / n, 6) AS largest, round(1 / list_sum(list_transform(v, lambda x: exp(x - top))), 6) AS surest FROM e""")
def vector_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every vector: its length, the largest component of its unit vector, and of its softmax."""
    v = F.col("embedding").cast("array<double>")
    top = lambda x: F.round(F.array_max(x), 6)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(outliers.norm(v), 6).alias("norm"), top(outliers.unit(v)).alias("largest"), top(outliers.softmax(v)).alias("surest"))


_MEANS = ", ".join(f"round(avg(embedding[{i}]::DOUBLE), 6) AS m{i}" for i in (1, 2, 64))


@query(f"SELECT label, {_MEANS} FROM embeddings GROUP BY label")
def mean_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = outliers.mean_pool(table(spark, sf_dir, "embeddings"), "embedding", 64, "label")
    return pooled.select("label", *(F.round(F.get("embedding", F.lit(i - 1)), 6).alias(f"m{i}") for i in (1, 2, 64)))
