"""op9: quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiometra.llm import rules
from regiometra.llm.registry import query, table

_BASE = " OR ".join(f"({r.rejects})" for r in rules.BASE_RULES)
_ANY = " OR ".join(f"({r.rejects})" for r in rules.RULES)

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
p AS (SELECT rid, unnest(range(len(ws))) AS i, ws FROM w),
g AS (SELECT rid, i, ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] AS g FROM p WHERE i + 3 <= len(ws)),
f AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM f) GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(list_aggregate(ws || [''], 'string_agg', ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
  len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({_BASE}) AS base_failed,
  NOT ({_ANY}) AS kept FROM m"""


@query("op9_quality_rules", SQL)
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base measures and the verdict of the cascade for every document."""
    judged = rules.judge(table(spark, folder, "documents").select("doc_id", "text"))
    measured = rules.measure(judged, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                           F.expr(_BASE).alias("base_failed"), "kept")
