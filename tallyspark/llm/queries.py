"""Queries of this package and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import conversations, leakage, percentiles, quality, tokenizer
from tallyspark.llm.statistics import COUNTS, FEATURES, document_statistics
from tallyspark.sources.tables import table

PER_MILLE = (10, 250, 500, 750, 900, 990)


GRID = 1 / 1024  # step of the bounded states: a power of two, so that multiples are exact


def _states(spark: SparkSession, d: str, grid: float = 0.0) -> DataFrame:
    return percentiles.day_states(table(spark, d, "llm_analyses"), "chatbot_id", ["precision", "recall"], "id", F.to_date("analyzed_at"), grid)


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.percentiles(_states(spark, d), "chatbot_id", PER_MILLE)


def p3_day_states(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d)


def p3_percentiles_bounded(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles below the exact ones by less than :data:`GRID`, from states of bounded size."""
    return percentiles.percentiles(_states(spark, d, GRID), "chatbot_id", PER_MILLE)


def p3_day_states_bounded(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d, GRID)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_conversations(spark, d).select("thread_id", "turn_no", "comment_id", "speaker_role")


def p5_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(table(spark, d, "thread_comments"), table(spark, d, "timeline_events"), table(spark, d, "prs"), table(spark, d, "chatbots"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_column(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_passages(spark, d).select("doc_id", "item_id").distinct()


def p7_passages(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.structural_documents(table(spark, d, "documents"), table(spark, d, "common_words"))


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    stats = p8_all_statistics(spark, d)
    return stats.select("doc_id", "n_chars", "n_words", "mean_word_len", "digit_share", "letter_share", "upper_share", "distinct_words")


def p8_all_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Every statistic the classifier reads, and the counts, of every document; ``p8_statistics`` is the part with SQL."""
    stats = document_statistics(table(spark, d, "documents"), quality.common_words(table(spark, d, "common_words")))
    return stats.select("doc_id", *COUNTS, *[F.round(c, 6).alias(c) for c in FEATURES])


QUERIES = {
    "p3_percentiles": p3_percentiles, "p3_day_states": p3_day_states, "p3_percentiles_bounded": p3_percentiles_bounded, "p3_day_states_bounded": p3_day_states_bounded, "p5_found": p5_found, "p5_conversations": p5_conversations,
    "p6_ids": p6_ids, "p7_found": p7_found, "p7_passages": p7_passages, "p8_found": p8_found, "p8_statistics": p8_statistics, "p8_all_statistics": p8_all_statistics,
}

_ONCE = """
once AS (SELECT id, min(CAST(analyzed_at AS DATE)) AS day, any_value(chatbot_id) AS chatbot_id, any_value("precision") AS p, any_value(recall) AS r FROM llm_analyses GROUP BY id),
v AS (SELECT chatbot_id, 'precision' AS measure, day, CAST(p AS DOUBLE) AS value FROM once WHERE p IS NOT NULL AND NOT isnan(p)
      UNION ALL SELECT chatbot_id, 'recall', day, CAST(r AS DOUBLE) FROM once WHERE r IS NOT NULL AND NOT isnan(r))"""

_BOUNDED = f"{_ONCE}, b AS (SELECT chatbot_id, measure, day, floor(value * 1024) / 1024 AS value FROM v)"


def _ranked(states: str, rows: str) -> str:
    return f"""
WITH {states},
o AS (SELECT *, row_number() OVER (PARTITION BY chatbot_id, measure ORDER BY value) AS rn, count(*) OVER (PARTITION BY chatbot_id, measure) AS n FROM {rows}),
q AS (SELECT unnest([{", ".join(map(str, PER_MILLE))}]) AS per_mille)
SELECT chatbot_id, measure, per_mille, n, value FROM o JOIN q ON rn = greatest(1, (n * per_mille + 999) // 1000)"""


SQL = {
    "p3_percentiles_bounded": _ranked(_BOUNDED, "b"),
    "p3_day_states_bounded": f"WITH {_BOUNDED} SELECT chatbot_id, measure, day, value, count(*) AS n FROM b GROUP BY 1, 2, 3, 4",
    "p8_statistics": r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words FROM documents)
SELECT doc_id, CAST(length(t) AS INTEGER) AS n_chars, CAST(len(words) AS INTEGER) AS n_words,
 round(coalesce(list_sum(list_transform(words, lambda x: length(x))) / nullif(len(words), 0), 0), 6) AS mean_word_len,
 round(coalesce((length(t) - length(regexp_replace(t, '\p{N}+', '', 'g'))) / nullif(length(t), 0), 0), 6) AS digit_share,
 round(coalesce(length(regexp_replace(t, '[^\p{L}]+', '', 'g')) / nullif(length(t), 0), 0), 6) AS letter_share,
 round(coalesce(length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) / nullif(length(regexp_replace(t, '[^\p{L}]+', '', 'g')), 0), 0), 6) AS upper_share,
 round(coalesce(len(list_distinct(words)) / nullif(len(words), 0), 0), 6) AS distinct_words
FROM w""",
    "p3_percentiles": _ranked(_ONCE, "v"),
    "p3_day_states": f"WITH {_ONCE} SELECT chatbot_id, measure, day, value, count(*) AS n FROM v GROUP BY 1, 2, 3, 4",
}
