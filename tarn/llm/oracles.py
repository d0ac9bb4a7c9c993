"""DuckDB SQL that computes the rows of three of the queries another way: all pairs that share a shingle, all pairs of vectors, one pattern after another."""

from __future__ import annotations

#: The names that a secret is assigned to, in either case (of ASCII letters only).
_NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = f"""({_NAMES})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

#: ``links`` (x, y) both ways and ``nodes`` (id) to (id, low): the smallest id that each reaches.
_REACH = """reach AS (SELECT id, id AS seen FROM nodes UNION SELECT reach.id, links.y FROM reach JOIN links ON reach.seen = links.x),
low AS (SELECT id, min(seen) AS low FROM reach GROUP BY 1)"""

MINHASH = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
nodes AS (SELECT doc_id AS id FROM documents),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes a ON x = a.doc_id JOIN sizes b ON y = b.doc_id WHERE 100 * i >= 75 * (a.n + b.n - i)),
{_REACH}
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, low AS component_id, d.doc_id = low AS kept FROM documents d LEFT JOIN sizes USING (doc_id) JOIN low ON d.doc_id = low.id"""

SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
hits AS (
  SELECT doc_id, 0 AS rank, 'assign' AS kind, string_split_regex(t, '{_ASSIGN}') AS gaps, regexp_extract_all(t, '{_ASSIGN}') AS hit, regexp_extract_all(t, '{_ASSIGN}', 2) AS part, 8 AS least FROM d
  UNION ALL SELECT doc_id, 1, 'access', string_split_regex(t, 'AKIA[A-Z0-9]{{12,}}'), regexp_extract_all(t, 'AKIA[A-Z0-9]{{12,}}'), regexp_extract_all(t, 'AKIA[A-Z0-9]{{12,}}'), 16 FROM d
  UNION ALL SELECT doc_id, 2, 'hex', string_split_regex(t, '[0-9a-f]{{32,}}'), regexp_extract_all(t, '[0-9a-f]{{32,}}'), regexp_extract_all(t, '[0-9a-f]{{32,}}'), 32 FROM d),
each AS (SELECT *, unnest(range(1, len(hit) + 1)) AS i FROM hits WHERE len(hit) > 0),
spans AS (
  SELECT doc_id, rank, kind, list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(hit[1:i - 1], lambda x: length(x))), 0)::BIGINT AS start, length(hit[i]) AS size
  FROM each WHERE length(part[i]) >= least),
listed AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
    string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, rank) AS spans FROM spans GROUP BY 1)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (doc_id)"""

VECTORS = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
nodes AS (SELECT vec_id AS id FROM embeddings),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
n AS (SELECT x, count(*) AS n FROM links GROUP BY 1),
{_REACH}
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, low AS component_id, id = low AS kept FROM low LEFT JOIN n ON id = x"""
