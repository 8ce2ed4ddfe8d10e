"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from quern.llm import chat_format, license_scan, substring_dedup
from quern.llm.quality_rules import STOP_WORDS

_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

_VOTERS = ", ".join(f"({t}, '{label}', {phrase}, '{f}', {n}, {m}, '{gram}', {i})" for t, label, phrase, f, n, m, gram, i in license_scan.positions())

ORACLES: dict[str, str] = {
    "op1_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
""",
    "op2_quality_rules": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), tri AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n FROM tri, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(regexp_extract_all(t, '!')) AS marks,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS stops
  FROM d LEFT JOIN rep USING (r)
), x AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    concat_ws(',',
      CASE WHEN word_chars < 2.0 * n_words OR n_words = 0 THEN 'mean_word_chars' END,
      CASE WHEN word_chars > 14.0 * n_words THEN 'mean_word_chars' END,
      CASE WHEN n_symbols > 0.25 * n_words AND n_words > 0 THEN 'symbol_ratio' END,
      CASE WHEN n_words > 0 AND marks / n_words > 0.6 THEN 'mark_ratio' END,
      CASE WHEN n_words = 0 OR stops / n_words < 0.02 THEN 'stop_ratio' END,
      CASE WHEN n_dup_lines > 0.5 * lines THEN 'dup_line_ratio' END) AS failed_rules
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, failed_rules
FROM x
""",
    "op3_license_scan": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), t(template, label, phrase, family, grams, needed, tgram, tpos) AS (VALUES {_VOTERS}),
g AS (
  SELECT r, i - 1 AS pos, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM d)
), v AS (
  SELECT r, template, label, phrase, family, grams, needed, pos, tpos, pos - tpos AS diagonal FROM g JOIN t ON gram = tgram
), dia AS (
  SELECT *, sum(CASE WHEN phrase OR coalesce(diagonal - prev > {license_scan.GAP}, true) THEN 1 ELSE 0 END)
            OVER (PARTITION BY r, template ORDER BY diagonal) AS c
  FROM (SELECT *, lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) AS prev
        FROM (SELECT DISTINCT r, template, phrase, diagonal FROM v))
), m AS (
  SELECT r, template, label, phrase, family, grams, c, min(diagonal) AS diagonal, min(pos) AS lo, max(pos) AS hi,
         count(DISTINCT tpos)::DOUBLE / grams AS score
  FROM v JOIN dia USING (r, template, phrase, diagonal) GROUP BY r, template, label, phrase, family, grams, needed, c
  HAVING count(DISTINCT tpos) >= needed
), o AS (
  SELECT *, sum(beyond) OVER (PARTITION BY r, family ORDER BY lo, hi, template) AS place
  FROM (SELECT *, CASE WHEN lo > 1 + max(hi) OVER (PARTITION BY r, family ORDER BY lo, hi, template ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                       THEN 1 ELSE 0 END AS beyond FROM m WHERE NOT phrase)
), f AS (
  SELECT r, label, phrase, diagonal, score FROM m WHERE phrase
  UNION ALL
  SELECT r, label, phrase, diagonal, score FROM (SELECT *, max(score) OVER (PARTITION BY r, family, place) AS best FROM o) WHERE score = best
), a AS (
  SELECT r, count(*) FILTER (phrase) AS n_base, min(diagonal) FILTER (phrase) AS first_word,
         max(diagonal) FILTER (phrase) AS last_word,
         coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (phrase))), ','), '') AS base_labels,
         array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(score) AS score
  FROM f GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN a USING (r)
""",
    "op5_substring_dedup": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '(?s).*?(?:{substring_dedup.ENDS["clause"]}|$)') AS l FROM documents
), p AS (
  SELECT r, doc_id, unnest(l) AS p, unnest(range(len(l))) AS i FROM d
), c AS (
  SELECT *, regexp_extract_all(translate(p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM p
), h AS (
  -- Words since the last cut; a line end cuts where there are any, a clause where it has enough itself.
  SELECT *, sum(len(w)) OVER (PARTITION BY r ORDER BY i) AS upto, len(w) >= {substring_dedup.SHORT} OR right(p, 1) = chr(10) AS ends FROM c
), e AS (
  SELECT *, ends AND upto > coalesce(max(upto) FILTER (ends) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut FROM h
), n AS (
  SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS unit FROM e
), o AS (
  SELECT r, doc_id, unit, string_agg(p, '' ORDER BY i) AS u, sum(len(w)) AS words,
         array_to_string(flatten(list(w ORDER BY i)), ' ') AS key FROM n GROUP BY r, doc_id, unit
), s AS (
  SELECT *, (sum(length(u)) OVER (PARTITION BY r ORDER BY unit) - length(u))::BIGINT AS start, sum(length(u)) OVER (PARTITION BY r) AS total,
         max(unit) FILTER (words > 0) OVER (PARTITION BY r) AS last FROM o
), k AS (
  SELECT r, doc_id, unit, key, words, start, CASE WHEN unit = last THEN total - start ELSE length(u) END::BIGINT AS length FROM s WHERE words > 0
), f AS (
  SELECT *, row_number() OVER g AS n, first_value(doc_id) OVER g AS keep_doc_id, first_value(start) OVER g AS keep_start
  FROM k WINDOW g AS (PARTITION BY key ORDER BY doc_id NULLS LAST, start, r)
), x AS (
  SELECT *, unit - row_number() OVER (PARTITION BY r ORDER BY unit) AS run FROM f WHERE n > 1
), y AS (
  SELECT *, sum(words) OVER (PARTITION BY r, run) AS together FROM x
)
SELECT doc_id, start, length, keep_doc_id, keep_start FROM y WHERE together >= {substring_dedup.PASSAGE}
""",
    "op6_warc": """
WITH p AS (SELECT row_number() OVER () AS r, page_id, octet_length(encode(coalesce(html, ''))) AS b, sha256(coalesce(html, '')) AS d FROM pages),
q AS (
  SELECT *, first_value(page_id) OVER g AS lo, row_number() OVER g AS i FROM p
  WINDOW g AS (PARTITION BY d ORDER BY page_id NULLS LAST, r)
)
SELECT page_id, b::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN b >= 100 AND i > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN b >= 100 AND i > 1 THEN lo END AS refers_to
FROM q
""",
    "op8_chat_format": rf"""
WITH src AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{chat_format.END}{chat_format.START}assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '{chat_format.END}{chat_format.START}assistant ok'
), t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
         len(regexp_extract_all(coalesce(text, ''), '{chat_format.PIECES}')) + {chat_format.MARKS} AS n
  FROM src
), q AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY i) AS e,
         CASE WHEN first_value(role) OVER (PARTITION BY conv_id ORDER BY i) = 'system'
               AND first_value(n) OVER (PARTITION BY conv_id ORDER BY i) <= {(chat_format.BUDGET - chat_format.HISTORY) // 2}
              THEN first_value(n) OVER (PARTITION BY conv_id ORDER BY i) ELSE 0 END AS sys
  FROM t
), p AS (
  SELECT *, greatest(1, {chat_format.BUDGET - chat_format.HISTORY} - sys) AS step FROM q
), c AS (
  SELECT *, ((e - n) // step) * 2 + CASE WHEN (e - n) // step < (e - 1) // step THEN 1 ELSE 0 END AS cell FROM p
), w AS (
  SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY i) - 1 AS win
  FROM (SELECT *, CASE WHEN cell IS DISTINCT FROM lag(cell) OVER (PARTITION BY conv_id ORDER BY i) THEN 1 ELSE 0 END AS new FROM c)
), o AS (
  SELECT conv_id, win, any_value(sys) AS sys, sum(n) AS own, max(e) AS last FROM w GROUP BY conv_id, win
), f AS (
  SELECT *, lead(own) OVER (PARTITION BY conv_id ORDER BY win) AS follow,
         count(*) FILTER (win > 0 AND sys > 0 AND sys + own <= {chat_format.BUDGET}) OVER (PARTITION BY conv_id) AS heads FROM o
), l AS (
  SELECT w.*, f.last, f.heads, CASE WHEN follow IS NULL THEN -1 ELSE least({chat_format.HISTORY}, {chat_format.BUDGET} - follow - CASE WHEN f.sys <= {chat_format.BUDGET} - follow THEN f.sys ELSE 0 END) END AS room
  FROM w JOIN f ON w.win = f.win AND w.conv_id IS NOT DISTINCT FROM f.conv_id
), k AS (
  SELECT *, CASE WHEN sys > 0 AND i = 1 THEN heads + 1 WHEN last - (e - n) <= room THEN 2 ELSE 1 END AS copies,
         length(replace(replace(replace(role, '~', '~0'), '<|', '<~1'), chr(10), '~2')) + length(replace(replace(text, '~', '~0'), '<|', '<~1'))
           + {len(chat_format.START) + len(chat_format.END) + 2} AS chars
  FROM l
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(copies * chars)::BIGINT AS formatted_chars
FROM k GROUP BY conv_id
""",
}
