"""DuckDB SQL for the queries that SQL can express.

The others are held in tests/llm, over whole tables, to a plain version or the library (op4, op5, op7, op8, pipeline), to
the way back (op9), to held-out rows (op2, op6) or to marked articles (op1); op11, op12 and op13 have tests of their own."""

from __future__ import annotations

from saleskiln.llm.line_quality import BOILERPLATE

WORDS = r"[^\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {}

ORACLES["op3_line_quality"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{WORDS}') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS ls FROM d),
win AS (SELECT r, i, array_to_string(words[i : i + 7], ' ') AS g FROM w, unnest(range(1, len(words) - 6)) AS u(i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range(0, 8) AS s(k) GROUP BY r),
lines AS (SELECT r, x, len(regexp_extract_all(x, '{WORDS}')) AS n FROM w, unnest(ls) AS u(x)),
good AS (SELECT r, sum(n) AS n FROM lines WHERE NOT (
    NOT regexp_matches(x, '[.!?:;…。！？]')
    OR 100 * len(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) > 10 * n
    OR 100 * len(regexp_replace(x, '[^!]', '', 'g')) > 60 * greatest(n, 3)
    OR len(regexp_replace(x, '[^|»›•·>]', '', 'g')) >= 3
    OR regexp_matches(x, '{BOILERPLATE}')) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars,
       len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
       (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
       len(words) < 20 OR 100 * coalesce(cov.n, 0) > 30 * len(words) AS base_failed,
       NOT (len(words) < 20 OR 100 * coalesce(cov.n, 0) > 30 * len(words)) AND 100 * coalesce(good.n, 0) >= 40 * len(words) AS kept,
       coalesce(good.n, 0)::BIGINT AS n_kept_words
FROM w LEFT JOIN cov USING (r) LEFT JOIN good USING (r)
"""

ORACLES["op10_line_spread"] = rf"""
WITH l AS (SELECT doc_id, source, i, x, trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
           FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
s AS (SELECT k, min(doc_id) AS first FROM l WHERE regexp_matches(x, '{WORDS}') GROUP BY k HAVING count(DISTINCT source) >= 10),
m AS (SELECT l.*, regexp_matches(x, '{WORDS}') AS worded, s.k IS NOT NULL AND doc_id > s.first AS gone FROM l LEFT JOIN s USING (k))
SELECT doc_id, count(*) FILTER (worded) AS n_lines, count(*) FILTER (worded AND gone) AS n_removed,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT (worded AND gone)), '')) AS text_sha256
FROM m GROUP BY doc_id
"""
