"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from jobloom.llm.secret_scan import RULES


def _scan(no: int) -> str:
    rule = RULES[no]
    pattern = rule.pattern.replace("'", "''")
    return f"""
SELECT doc, {no} AS kind_no, '{rule.kind}' AS kind, begin, begin + len AS stop FROM (
  SELECT doc, i, len, part, gap + coalesce(sum(gap + len) OVER (
    PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin
  FROM (
    SELECT doc, i, length(gaps[i]) AS gap, length(whole[i]) AS len, length(parts[i]) AS part FROM (
      SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (
        SELECT doc, regexp_split_to_array(text, '{pattern}') AS gaps,
          regexp_extract_all(text, '{pattern}') AS whole, regexp_extract_all(text, '{pattern}', {rule.group}) AS parts
        FROM texts))))
WHERE part >= {rule.least}"""


OP3 = f"""
WITH texts AS (
  SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents
), found AS ({" UNION ALL ".join(_scan(n) for n in range(len(RULES)))}
), lines AS (
  SELECT doc, string_agg(kind || ':' || begin::BIGINT || ':' || stop::BIGINT, ',' ORDER BY begin, kind_no) AS spans,
    count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h
  FROM found GROUP BY doc
)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN lines USING (doc)
"""

OP5 = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(64 * x::DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(64 * coalesce(x, 0)::DOUBLE)))
  GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

def _mask(side: str) -> str:
    pieces = f"list_transform({side}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10))"
    at = f"coalesce(list_sum(list_transform({pieces}[:i - 1], lambda x: length(x))), 0)"
    return f"""array_to_string(list_transform(list_filter(range(1, len({side}) + 1), lambda i: {side}[i].role = 'assistant'),
      lambda i: ({at} + length({side}[i].role) + 5)::BIGINT || ':' || ({at} + length({pieces}[i]))::BIGINT), ',')"""


def _text(side: str) -> str:
    return f"array_to_string(list_transform({side}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '')"


OP8 = f"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), d AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS turns,
    sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS said
  FROM t GROUP BY conv_id
), n AS (
  SELECT *, row_number() OVER (ORDER BY turns[1].role, md5(turns[1].text), substr(md5(conv_id::VARCHAR), 1, 8), conv_id) - 1 AS seat FROM d
), p AS (
  SELECT list({{'id': conv_id, 'turns': turns}} ORDER BY said DESC, seat) AS two FROM n GROUP BY seat // 2
), s AS (
  SELECT two[1].id AS chosen_id, two[2].id AS rejected_id, two[1].turns AS c, two[2].turns AS r FROM p
), k AS (
  SELECT *, CASE WHEN rejected_id IS NULL
      THEN len(c) - coalesce(list_position(list_reverse(list_transform(c, lambda x: x.role = 'assistant')), true), 0)
      ELSE coalesce(list_min(list_filter(range(1, greatest(len(c), len(r)) + 1), lambda i: c[i] IS DISTINCT FROM r[i])) - 1, len(c)) END AS shared FROM s
), f AS (
  SELECT chosen_id, rejected_id, shared, c[:shared] AS p, c[shared + 1:] AS c, r[shared + 1:] AS r FROM k
)
SELECT chosen_id, rejected_id, shared::INTEGER AS n_prompt_turns, {_text('p')} AS prompt, {_text('c')} AS chosen,
  CASE WHEN rejected_id IS NOT NULL THEN {_text('r')} END AS rejected, {_mask('c')} AS chosen_mask,
  CASE WHEN rejected_id IS NOT NULL THEN {_mask('r')} END AS rejected_mask
FROM f
"""

OP10 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), t AS (
  SELECT digest, max(page_id) AS target FROM p WHERE n >= 1000 GROUP BY digest
)
SELECT page_id, n::BIGINT AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN target <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN target <> page_id THEN target END AS refers_to
FROM p LEFT JOIN t USING (digest)
"""


def shards(limit: int, bits: int) -> str:
    """Every bucket of every depth is summed; a row's shard is the first that fits."""
    return f"""
WITH h AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(strlen(text), 0) AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS hash
  FROM documents
), d AS (
  SELECT h.*, depth, hash >> ({bits} - depth)::BIGINT AS prefix FROM h, (SELECT unnest(range({bits} + 1)) AS depth)
), s AS (
  SELECT depth, prefix, sum(n_bytes) AS shard_bytes FROM d GROUP BY depth, prefix
), a AS (
  SELECT d.*, shard_bytes, row_number() OVER (PARTITION BY r ORDER BY depth) AS k
  FROM d JOIN s USING (depth, prefix) WHERE shard_bytes <= {limit} OR depth = {bits}
)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, CASE WHEN depth = 0 THEN 'all' ELSE lpad(bin(prefix), depth::INTEGER, '0') END AS shard,
  depth::INTEGER AS depth, shard_bytes::BIGINT AS shard_bytes
FROM a WHERE k = 1
"""


def resampling(buckets: int, least_words: int, percent: int, seed: int) -> str:
    """Features are single words. A word's CRC is computed byte by byte, once for each distinct word."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {words} AS words FROM documents
), w AS MATERIALIZED (
  SELECT r, unnest(words) AS word FROM d UNION ALL SELECT -1, unnest({words}) FROM benchmark
), c AS MATERIALIZED (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda x, i: CASE WHEN x & 1 = 1 THEN xor(3988292384, x >> 1) ELSE x >> 1 END)) AS byte_crc
), k AS MATERIALIZED (
  SELECT word, xor(list_reduce(list_prepend(4294967295, bytes),
    lambda x, b: xor(x >> 8, byte_crc[(xor(x, b) & 255) + 1])), 4294967295) % {buckets} AS bucket
  FROM (
    SELECT word, list_transform(range(1, strlen(word) + 1), lambda i: ('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::BIGINT) AS bytes
    FROM (SELECT DISTINCT word FROM w)), c
), b AS MATERIALIZED (
  SELECT r, bucket, count(*) AS n FROM w JOIN k USING (word) GROUP BY r, bucket
), h AS (
  SELECT bucket, coalesce(sum(n) FILTER (r >= 0), 0) AS s, coalesce(sum(n) FILTER (r < 0), 0) AS t FROM b GROUP BY bucket
), g AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {buckets})::DOUBLE
    / ((s + 1)::DOUBLE * (sum(t) OVER () + {buckets})::DOUBLE)))::BIGINT AS gain FROM h
), v AS (
  SELECT r, sum(n * gain)::BIGINT AS weight FROM b JOIN g USING (bucket) WHERE r >= 0 GROUP BY r
), x AS (
  SELECT r, doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN v USING (r)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {least_words} ORDER BY score DESC, doc_id NULLS LAST, n_features, r) AS place,
    count(*) FILTER (n_features >= {least_words}) OVER () AS enough FROM x
)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
  CASE WHEN n_features >= {least_words} AND place <= {percent} * enough // 100 THEN place END::BIGINT AS rank
FROM o
"""
