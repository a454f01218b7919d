"""DuckDB SQL for the queries that SQL can express, written from the
operators' definitions and by other means than the Spark code."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY_RULES = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
windows AS (
  SELECT doc_id, i, words[i:i+4] AS win
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1))) AS i FROM w)
),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS p
    FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS times FROM windows) WHERE times > 1)
  GROUP BY doc_id
),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
),
c AS (
  SELECT w.doc_id, source, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(dup, 0)::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)
),
flags AS (
  SELECT *, unnest([n_words < 10, 100 * n_repeat_words > 20 * n_words, 100 * n_symbols > 10 * n_words,
                    100 * n_dup_lines > 30 * n_lines]) AS failed, unnest([1, 2, 3, 4]) AS rule FROM c
),
hosts AS (SELECT source, rule, count(*)::DOUBLE AS n, count(*) FILTER (failed)::DOUBLE AS x FROM flags GROUP BY ALL),
prior AS (
  SELECT rule, sum(x) / sum(n) AS m, sum(n) AS total, count(*) AS k,
         sum(n * (x / n) * (x / n)) / sum(n) - (sum(x) / sum(n)) ^ 2 AS v
  FROM hosts GROUP BY rule
),
strength AS (
  SELECT rule, m, CASE WHEN v - m * (1 - m) * (k - 1) / total <= 0 THEN 1e6
    ELSE least(1e6, greatest(1.0, m * (1 - m) / (v - m * (1 - m) * (k - 1) / total) - 1)) END AS s FROM prior
),
bad AS (
  SELECT DISTINCT coalesce(source, chr(0)) AS source FROM hosts JOIN strength USING (rule)
  WHERE (x + m * s) / (n + s) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND coalesce(source, chr(0)) NOT IN (SELECT source FROM bad) AS kept
FROM c
"""

CHAT_FORMAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'),
                   (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
),
marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS starts,
         length(text) + len(regexp_extract_all(text, '<\\*\|')) AS escaped
  FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       (sum(escaped) + sum(CASE WHEN starts THEN length(role) + 24 ELSE 10 END))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

WARC = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS hex FROM pages
),
named AS (
  SELECT page_id, octet_length(body)::BIGINT AS payload_bytes,
         translate(list_aggregate(list_transform([1, 11, 21, 31],
                     lambda i: to_base(('0x' || substr(hex, i::INTEGER, 10))::BIGINT, 32, 8)), 'string_agg', ''),
                   '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM named)
"""

JACCARD_JOIN = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN words ELSE words[i:i+4] END AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""



FOLDED_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
                r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {FOLDED_WORDS} AS words FROM documents),
b AS (SELECT item_id, {FOLDED_WORDS} AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, words[i:i + 9] AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 8, 2))) AS i FROM b WHERE len(words) > 0)
),
sizes AS (SELECT DISTINCT len(win) AS m FROM windows),
places AS (
  SELECT doc_id, i, words[i:i + m - 1] AS win
  FROM (SELECT doc_id, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM d JOIN sizes ON m <= len(words))
),
hits AS (SELECT DISTINCT doc_id, i, len(win) AS m, item_id FROM places JOIN windows USING (win)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id
),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit,
       coalesce(named.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def _vector_codes() -> str:
    """Every distance of every round, without bounds."""
    rounds = ""
    for r in range(5):
        rounds += f"""
near{r} AS MATERIALIZED (
  SELECT vec_id, part, min(d * 256 + entry)::BIGINT AS k FROM (
    SELECT vec_id, part, entry, sum((v - c) * (v - c)) AS d FROM x JOIN book{r} USING (part, pos) GROUP BY ALL)
  GROUP BY ALL
),"""
        if r < 4:
            rounds += f"""
book{r + 1} AS MATERIALIZED (
  SELECT part, entry, pos, coalesce((s - ((s % n) + n) % n) // n, c)::BIGINT AS c FROM book{r} LEFT JOIN (
    SELECT part, k % 256 AS entry, pos, sum(v) AS s, count(*) AS n FROM near{r} JOIN x USING (vec_id, part)
    GROUP BY ALL) USING (part, entry, pos)
),"""
    return f"""
WITH kept AS (
  SELECT vec_id, label, embedding, len(embedding) // 4 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
x AS MATERIALIZED (
  SELECT vec_id, i // w AS part, i % w AS pos, floor(1024 * embedding[i + 1])::BIGINT AS v
  FROM (SELECT *, unnest(range(len(embedding))) AS i FROM kept)
),
book0 AS MATERIALIZED (
  SELECT part, entry, pos, v AS c FROM x
  JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 256)
  USING (vec_id)
),{rounds}
coded AS (
  SELECT vec_id, string_agg(printf('%02x', (k % 256)::INT), '' ORDER BY part) AS code, sum(k // 256)::BIGINT AS error
  FROM near4 GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book4) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


ORACLES: dict[str, str] = {"op2_warc": WARC, "op3_quality_rules": QUALITY_RULES, "op4_chat_format": CHAT_FORMAT,
                           "op10_jaccard_join": JACCARD_JOIN, "op11_decontamination": DECONTAMINATION,
                           "op12_vector_codes": _vector_codes()}
