"""Plain SQL (DuckDB) for the queries that SQL can express on whole tables."""

from __future__ import annotations

_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

ORACLES: dict[str, str] = {}

ORACLES["op5_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
    SELECT DISTINCT item_id, least(13, len(w)) AS size,
           array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS body
    FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS s
          FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
spots AS (
    SELECT doc_id, size, s, array_to_string(w[s : s + size - 1], ' ') AS body
    FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS s
          FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, spots.s, spots.size, item_id FROM spots JOIN win USING (size, body)),
covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(generate_series(s, s + size - 1)) AS p FROM hits) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

ORACLES["op8_topk"] = """
WITH v AS (
    SELECT row_number() OVER () AS row_no, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
    SELECT q.row_no, q.vec_id AS query_id, c.vec_id,
           CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)]) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def _escaped(column: str, *more: tuple[str, str]) -> str:
    for plain, code in (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"), *more):
        column = f"replace({column}, '{plain}', '{code}')"
    return column


ORACLES["op12_chat_format"] = rf"""
WITH RECURSIVE said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (
    SELECT *, coalesce(trunc(turn / 1024.0), -1e18) AS block,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p,
           len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS tokens,
           13 + length({_escaped("replace(role, chr(10), 'nn')")}) + length({_escaped("text")}) AS chars
    FROM said),
head AS (SELECT conv_id, tokens, chars FROM t WHERE p = 1 AND role = 'system'),
body AS (
    SELECT *, sum(tokens) OVER (PARTITION BY conv_id, block ORDER BY p) AS upto,
           row_number() OVER (PARTITION BY conv_id, block ORDER BY p) AS i
    FROM t WHERE NOT (p = 1 AND role = 'system')),
room AS (
    SELECT b.conv_id, block, any_value(coalesce(h.tokens, 0)) AS system_tokens,
           any_value(coalesce(h.chars, 0)) AS system_chars
    FROM body b LEFT JOIN head h ON b.conv_id IS NOT DISTINCT FROM h.conv_id GROUP BY ALL),
walk AS (
    SELECT conv_id, block, i, i AS start, CAST(0 AS HUGEINT) AS base FROM body WHERE i = 1
    UNION ALL
    SELECT b.conv_id, b.block, b.i,
           CASE WHEN b.upto - w.base > 512 - system_tokens - 128 THEN b.i ELSE w.start END,
           CASE WHEN b.upto - w.base > 512 - system_tokens - 128 THEN b.upto - b.tokens ELSE w.base END
    FROM walk w JOIN body b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.block = w.block AND b.i = w.i + 1
    JOIN room r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.block = b.block),
spans AS (SELECT conv_id, block, start, base, max(i) AS last FROM walk GROUP BY ALL),
sized AS (
    SELECT s.*, system_chars, greatest(0, least(128, 512 - system_tokens - (e.upto - base))) AS spare
    FROM spans s JOIN body e ON e.conv_id IS NOT DISTINCT FROM s.conv_id AND e.block = s.block AND e.i = s.last
    JOIN room r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.block = s.block),
shown AS (
    SELECT s.conv_id, s.block, s.start, any_value(system_chars) + sum(b.chars) AS chars
    FROM sized s JOIN body b ON b.conv_id IS NOT DISTINCT FROM s.conv_id AND b.block = s.block
         AND b.i <= s.last AND s.base - (b.upto - b.tokens) <= s.spare GROUP BY ALL),
formatted AS (
    SELECT conv_id, sum(chars) AS chars FROM (
        SELECT conv_id, chars FROM shown
        UNION ALL
        SELECT conv_id, chars FROM head h
        WHERE NOT EXISTS (SELECT 1 FROM body b WHERE b.conv_id IS NOT DISTINCT FROM h.conv_id
                          AND b.block = (SELECT min(block) FROM t WHERE t.conv_id IS NOT DISTINCT FROM h.conv_id)))
    GROUP BY conv_id),
read AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY p) AS turns,
           coalesce(string_agg(text, '' ORDER BY p) FILTER (WHERE role = 'assistant'), '') AS loss
    FROM t GROUP BY conv_id)
SELECT read.conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(chars AS BIGINT) AS formatted_chars
FROM read JOIN formatted ON read.conv_id IS NOT DISTINCT FROM formatted.conv_id
"""
