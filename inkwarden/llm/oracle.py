"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
# A run that is too short holds no longer one: here the least length can stand in the pattern.
_ACCESS = r"AKIA[A-Z0-9]{12,}"
_HEX = r"[0-9a-f]{32,}"
_GITHUB = r"gh[pousr]_[A-Za-z0-9]+"
_SLACK = r"xox[abprs]-[A-Za-z0-9-]+"
_KEY = r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----+"


def _found(kind: str, rank: int, pattern: str, keep: str) -> str:
    """Spans of one kind: texts between matches and matches, summed up to offsets."""
    return f"""
    SELECT doc_id, '{kind}' AS kind, {rank} AS k, s AS a, s + len(m) AS b FROM (
      SELECT doc_id, unnest(ms) AS m, unnest(tails) AS tail,
             unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda g: len(g)))::BIGINT
               + coalesce(list_sum(list_transform(ms[1:i-1], lambda g: len(g))), 0)::BIGINT)) AS s
      FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, {keep} AS tails, string_split_regex(text, '{pattern}') AS gaps
            FROM docs WHERE regexp_matches(text, '{pattern}')))"""


_OP1 = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spans AS (
  SELECT * FROM ({_found("assign", 0, _ASSIGN, f"list_transform(regexp_extract_all(text, '{_ASSIGN}', 1), lambda x: len(x) >= 8)")} WHERE tail)
  UNION ALL SELECT * FROM ({_found("access", 1, _ACCESS, f"list_transform(regexp_extract_all(text, '{_ACCESS}'), lambda x: true)")} WHERE tail)
  UNION ALL SELECT * FROM ({_found("hex", 2, _HEX, f"list_transform(regexp_extract_all(text, '{_HEX}'), lambda x: true)")} WHERE tail)
  UNION ALL SELECT * FROM ({_found("github", 3, _GITHUB, f"list_transform(regexp_extract_all(text, '{_GITHUB}'), lambda x: len(x) >= 40)")} WHERE tail)
  UNION ALL SELECT * FROM ({_found("slack", 4, _SLACK, f"list_transform(regexp_extract_all(text, '{_SLACK}'), lambda x: len(x) >= 15)")} WHERE tail)
  UNION ALL SELECT * FROM ({_found("private_key", 5, _KEY, f"list_transform(regexp_extract_all(text, '{_KEY}'), lambda x: true)")} WHERE tail)
), told AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k < 3), '') AS base,
         string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN told USING (doc_id)
"""

_OP3 = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS w, source_size * 3 AS cap FROM sources),
levels AS (SELECT *, cap::DOUBLE / w AS ratio,
  (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER earlier, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER earlier, 0)) AS level
  FROM ranked WINDOW earlier AS (ORDER BY cap::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT arg_min(level, ratio) FROM levels WHERE level <= ratio) * w) AS target FROM levels),
rated AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0 AS coin
  FROM sized JOIN goals ON sized.source IS NOT DISTINCT FROM goals.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
"""

_OP2 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
  len(role) + len(regexp_replace(role, '[^\\\\<\[\n]', '', 'g')) + len(text) + len(regexp_replace(text, '[^\\\\<\[]', '', 'g')) + 12 + 1 + 11 AS chars FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

# All pairs, with cosines in double precision; equal vectors and rows are pairs like any other.
_OP8 = """
WITH RECURSIVE vecs AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON vec_id = a
"""

SQL = {"op1_secret_scan": _OP1, "op2_chat_format": _OP2, "op3_source_mixing": _OP3, "op8_embedding_near_dedup": _OP8}
