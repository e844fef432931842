"""DuckDB SQL of the text queries that SQL can express."""

from __future__ import annotations

WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def line_dedup(docs: str = "documents", min_docs: int = 10) -> str:
    """Text, line counts and dropped lines of every row of ``docs``."""
    key = ASCII_LOWER.format(f"trim(x.line, {WHITE})")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, * FROM {docs}),
l AS (SELECT rid, x.line, x.n, {key} AS k FROM d, LATERAL (
        SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n) x),
hot AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT rid) >= {min_docs}),
kept AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (hot.k IS NOT NULL) AS n_dropped,
                coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (hot.k IS NULL), '') AS kept
         FROM l LEFT JOIN hot USING (k) GROUP BY rid)
SELECT d.* EXCLUDE (rid, text), kept.kept AS text, n_lines, n_dropped FROM d JOIN kept USING (rid)"""


LINE_DEDUP = f"SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM ({line_dedup()})"

CHAT_FORMAT = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
f AS (SELECT *, lag(role, 1, 'start') OVER w AS before, row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS last
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(role) + 1 + length(regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g')) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars,
  bool_and((before, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user'))
           AND (NOT last OR role = 'assistant')) AS legal_order
FROM f GROUP BY conv_id"""


FIM = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS digest,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
h AS (
  SELECT *, len(u) AS n, ('0x' || substr(digest, 1, 8))::UBIGINT % (len(u) + 1) AS x, ('0x' || substr(digest, 9, 8))::UBIGINT % (len(u) + 1) AS y,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR ('0x' || substr(digest, 17, 8))::UBIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || substr(digest, 25, 8))::UBIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (
  SELECT *, array_to_string(u[1:least(x, y)::BIGINT], '') AS pre, array_to_string(u[least(x, y)::BIGINT + 1:greatest(x, y)::BIGINT], '') AS mid,
         array_to_string(u[greatest(x, y)::BIGINT + 1:], '') AS suf FROM h)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid
              ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p"""

QUALITY_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (SELECT rid, w, i, CASE WHEN lead(i, 4) OVER o IS NOT NULL THEN
             w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o END AS g
      FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT *, g IS NOT NULL AND count(*) OVER (PARTITION BY rid, g) > 1 AS again FROM g),
c AS (SELECT rid, w, bool_or(again) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM r),
words AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (covered) AS n_repeat_words FROM c GROUP BY rid),
l AS (SELECT rid, host, text, line, {ASCII_LOWER.format("trim(regexp_replace(line, '[' || " + WHITE + " || ']+', ' ', 'g'), ' ')")} AS k
      FROM (SELECT rid, host, text, unnest(string_split(text, chr(10))) AS line FROM d) WHERE trim(line, {WHITE}) <> ''),
k AS (SELECT host, k, count(DISTINCT text) AS n FROM l GROUP BY host, k),
hosts AS (SELECT host, count(DISTINCT text) AS host_docs FROM d GROUP BY host),
hot AS (SELECT host, k FROM k JOIN hosts USING (host) WHERE n >= 10 AND n >= host_docs * 0.001),
lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines, sum(length(l.k)) AS chars,
                 coalesce(sum(length(l.k)) FILTER (hot.k IS NOT NULL), 0) AS lost FROM l LEFT JOIN hot USING (host, k) GROUP BY rid),
x AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, CASE WHEN chars > 0 THEN 1 - lost / chars ELSE 1 END AS left_share
      FROM d LEFT JOIN words USING (rid) LEFT JOIN lines USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND left_share >= 0.2 AS kept FROM b"""
