"""Query op1_quality_rules and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.llm.quality import BOILERPLATE, LINKS, NAV_SEPARATORS, judged
from shutterlake.llm.text import table


def op1_quality_rules(spark, sf_dir):
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*cols)


def _count(col: str, part: str) -> str:
    return f"((length({col}) - length(replace({col}, '{part}', ''))) // {len(part)})"


_CHARS = r"length(regexp_replace({0}, '[\x20\x09-\x0D]+', '', 'g'))"
_SYMBOLS = "(length({0}) - length(translate({0}, '#*$%&|<>', '')))"

_LETTERS = "length(regexp_replace(line, '[^A-Za-z]', '', 'g'))"

SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT r, i, list_slice(w, i, i + 4) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, i + j AS p FROM rep, range(5) AS t(j)) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
lj AS (SELECT r, line, {_CHARS.format('line')} AS chars,
  ({_SYMBOLS.format('line')} * 100 > {_CHARS.format('line')} * 10) OR {_count('line', '!!')} > 2
  OR {' + '.join(_count('line', s) for s in NAV_SEPARATORS)} > 2
  OR {' + '.join(_count('line', s) for s in LINKS)} > 2
  OR suffix(rtrim(line, ' '), '...') OR suffix(rtrim(line, ' '), '…')
  OR ({_CHARS.format('line')} > 300 AND NOT regexp_matches(line, '[.,;:!?…。！？]'))
  OR (regexp_matches(line, '[A-Z][^a-z][^a-z][^a-z]') AND {_LETTERS} >= 20 AND length(regexp_replace(line, '[^A-Z]', '', 'g')) * 100 > {_LETTERS} * 70)
  OR regexp_matches(lower(line), '{'|'.join(BOILERPLATE)}') AS bad FROM l),
ls AS (SELECT r, count(*) FILTER (chars > 0) - count(DISTINCT line) FILTER (chars > 0) AS dups, coalesce(sum(chars) FILTER (bad), 0) AS lost FROM lj GROUP BY r),
b AS (SELECT d.doc_id, len(w.w) AS n_words, {_CHARS.format('d.text')} AS word_chars, {_SYMBOLS.format('d.text')} AS n_symbols,
  ls.dups AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, ls.lost AS lost_chars
  FROM d JOIN w USING (r) JOIN ls USING (r) LEFT JOIN cov USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(lost_chars AS BIGINT) AS lost_chars,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_chars * 100 <= word_chars * 40 AS kept
FROM b
"""
