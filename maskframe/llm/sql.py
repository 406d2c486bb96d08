"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from maskframe.llm import quality_rules as rules

_SPACE = r"[^\x20\x09-\x0D]+"

_FAILED = " | ".join(f"(CASE WHEN {rule} THEN {1 << i} ELSE 0 END)" for i, rule in enumerate(rules.RULES.values()))

OP10 = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w FROM documents
), lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '{_SPACE}') GROUP BY r
), windows AS (
  SELECT r, i, list_slice(w, i, i + {rules.WINDOW - 1}) AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - {rules.WINDOW - 2})) AS i FROM texts)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1
), repeats AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, range({rules.WINDOW}) AS x(k) GROUP BY r
), measured AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters,
    length(regexp_replace(t, '[^!]', '', 'g')) AS n_shouts,
    coalesce(len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])), 0) AS n_echoes
  FROM texts LEFT JOIN lines USING (r) LEFT JOIN repeats USING (r)
), judged AS (SELECT *, CAST({_FAILED} AS BIGINT) AS failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  failed & {rules.mask_of(rules.POLICIES["base"])} <> 0 AS base_failed, failed & {rules.mask_of(rules.POLICIES["v1"])} = 0 AS kept, failed
FROM judged
"""

#: Works on hexadecimal text, two digits a byte.
OP5 = """
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents
), starts AS MATERIALIZED (
  SELECT r, p, md5_number(substr(h, 2 * p + 1, 400)) AS s
  FROM (SELECT r, h, unnest(range(0, CAST(len(h) // 2 AS BIGINT) - 199)) AS p FROM texts)
), twice AS (
  SELECT r, p FROM starts SEMI JOIN (SELECT s FROM starts GROUP BY s HAVING count(*) > 1) USING (s)
), marked AS (
  SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM twice
), runs AS (
  SELECT r, min(p) AS a, max(p) + 200 AS b FROM (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS g FROM marked) GROUP BY r, g
), removed AS (
  SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r
), gaps AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS from_, FROM runs
), heads AS (
  SELECT r, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) AS head, max(b) AS last FROM gaps JOIN texts USING (r) GROUP BY r
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN removed USING (r) LEFT JOIN heads USING (r)
"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Lower case for A-Z alone.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, i, i + least(10, len(w)) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows), hits AS (
  SELECT r, item_id, i, x.n FROM (
    SELECT r, n, i, list_slice(w, i, i + n - 1) AS g
    FROM (SELECT r, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM texts, sizes)
  ) AS x JOIN windows AS y ON x.g = y.g
), hit_words AS (
  SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT r, i, unnest(range(n)) AS k FROM hits) GROUP BY r
), hit_items AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

OP6 = """
SELECT doc_id, CAST(coalesce(((doc_id % 5) + 5) % 5, 0) AS INTEGER) AS arrival, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256 FROM documents
"""

#: Every anchor against every row.
OP12 = """
WITH used AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.vec_id, b.r, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM (SELECT * FROM used WHERE vec_id % 100 = 0) AS a JOIN used AS b ON a.r <> b.r
), positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank, n.vec_id AS negative_id,
    p.score AS positive_score, n.score AS negative_score
  FROM positives AS p JOIN scored AS n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
)
SELECT * FROM ranked WHERE rank <= 5
"""

ORACLE_SQL = {"op12_hard_negatives": OP12, "op6_shards": OP6, "op9_decontaminate": OP9, "op5_suffix_dedup": OP5, "op10_quality_rules": OP10}
