"""Scorers as injectable functions: the only place where Python code meets rows, always in Arrow batches.

A scorer maps texts (or pairs of texts) to values. Deterministic defaults stand in for language models, which are
plugged in by passing another function; nothing here opens a connection.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERDICT = "match boolean, confidence double, reasoning string"


def overlap_scorer(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Default pair scorer: Jaccard similarity of the word sets."""
    cut = lambda s: s.fillna("").str.lower().str.split(r"[^a-z0-9]+", regex=True).map(lambda ws: {w for w in ws if w})
    score = [len(a & b) / len(a | b) if a | b else 0.0 for a, b in zip(cut(left), cut(right))]
    return pd.DataFrame({"match": [x > 0.05 for x in score], "confidence": score, "reasoning": "shared words"})


def pair_verdict(left: Column, right: Column, scorer: Callable[[pd.Series, pd.Series], pd.DataFrame] = overlap_scorer) -> Column:
    """Verdict struct of a pair of texts by ``scorer``, one call per Arrow batch."""

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return scorer(a, b)

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, VERDICT)(left, right)


def split_extractor(text: Column, separator: str = r"\n\s*---+\s*\n", least: int = 20) -> Column:
    """Default extractor of findings from comment text: parts between separators, of at least ``least`` characters."""
    return F.filter(F.transform(F.split(text, separator), F.trim), lambda x: F.char_length(x) >= least)


def keyword_label(text: Column, table: dict[str, tuple[str, ...]], default: str) -> Column:
    """Default labeller: first label one of whose words occurs in the text."""
    out = F.lit(default)
    for label, words in reversed(list(table.items())):
        out = F.when(F.lower(text).rlike(r"\b(?:" + "|".join(words) + r")\b"), label).otherwise(out)
    return out


def _first_sentence(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"^([^.!?\n]+)", 1))


#: Words by which the default extractors tell categories and severities; any other table can be passed.
CATEGORIES = {"bug": ("error", "fail", "fails", "failures", "wrong", "drops", "loses"), "performance": ("slow", "cache", "batch"), "test": ("test", "tests"), "style": ("rename", "name")}
SEVERITY_WORDS = {"critical": ("crash", "security"), "high": ("loses", "drops", "error"), "low": ("rename", "nit", "name")}


def suggestion_extractor(rows: DataFrame, categories: dict[str, tuple[str, ...]] = CATEGORIES, severities: dict[str, tuple[str, ...]] = SEVERITY_WORDS) -> DataFrame:
    """Default extractor of the bot's suggestions: ``pr_id, issue_id, description, category, file_path, line_number, severity``.

    ``rows``: pr_id, comment_id, body, path, line. One suggestion per comment with a body; a language model is plugged
    in by another function of the same shape.
    """
    body = F.col("body")
    return rows.where(F.col("body").rlike(r"\S")).select(
        "pr_id", F.concat(F.lit("S"), F.col("comment_id").cast("string")).alias("issue_id"), _first_sentence(body).alias("description"), keyword_label(body, categories, "other").alias("category"),
        F.col("path").alias("file_path"), F.col("line").alias("line_number"), keyword_label(body, severities, "medium").alias("severity"),
    )


def action_extractor(commits: DataFrame, replies: DataFrame, categories: dict[str, tuple[str, ...]] = CATEGORIES) -> DataFrame:
    """Default extractor of human actions: ``pr_id, action_id, description, category, file_path, commit_sha, action_type``.

    Commits after the review are code changes, replies are discussion. ``commits``: pr_id, sha, message; ``replies``:
    pr_id, comment_id, body, path.
    """
    none = F.lit(None).cast("string")
    done = commits.select("pr_id", F.concat(F.lit("C"), F.substring("sha", 1, 12)).alias("action_id"), F.col("message").alias("description"), keyword_label(F.col("message"), categories, "other").alias("category"), none.alias("file_path"), F.col("sha").alias("commit_sha"), F.lit("code_change").alias("action_type"))
    said = replies.where(F.col("body").rlike(r"\S")).select("pr_id", F.concat(F.lit("R"), F.col("comment_id").cast("string")).alias("action_id"), _first_sentence(F.col("body")).alias("description"), keyword_label(F.col("body"), categories, "other").alias("category"), F.col("path").alias("file_path"), none.alias("commit_sha"), F.lit("discussion").alias("action_type"))
    return done.unionByName(said)


def action_matcher(suggestions: DataFrame, actions: DataFrame, least: int = 2) -> DataFrame:
    """Default matcher: ``pr_id, bot_issue_id, human_action_id, matched, confidence, reasoning``, one row per suggestion.

    The action of the same pull request that shares most words with the suggestion matches it if they are at least
    ``least``; ties go to the first id.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) > 2))
    a = actions.select("pr_id", F.col("action_id").alias("human_action_id"), words(F.col("description")).alias("aw"))
    s = suggestions.select("pr_id", F.col("issue_id").alias("bot_issue_id"), words(F.col("description")).alias("sw"))
    both = s.join(a, "pr_id", "left").withColumn("shared", F.coalesce(F.size(F.array_intersect("sw", "aw")), F.lit(0)))
    best = both.groupBy("pr_id", "bot_issue_id").agg(F.min(F.struct((-F.col("shared")).alias("neg"), "human_action_id")).alias("b"), F.max(F.size("sw")).alias("n"))
    hit = -F.col("b.neg") >= least
    return best.select("pr_id", "bot_issue_id", F.when(hit, F.col("b.human_action_id")).alias("human_action_id"), hit.alias("matched"), F.coalesce(F.try_divide(-F.col("b.neg"), F.col("n")), F.lit(0.0)).alias("confidence"), F.lit("shared words").alias("reasoning"))


#: The closed vocabularies of the offline labels.
VOCABULARIES = {"pr_size": ("small", "medium", "large"), "complexity": ("simple", "moderate", "complex"), "risk": ("low", "medium", "high", "critical"), "context": ("local", "file", "cross_file", "system")}


def closed_label(value: Column, name: str, default: str = "unknown") -> Column:
    """A label of a closed vocabulary: lower case with underscores, ``default`` where it is not one of its words."""
    key = F.regexp_replace(F.lower(F.trim(value)), r"[\s-]+", "_")
    return F.when(key.isin(*VOCABULARIES[name]), key).otherwise(default)


def with_retries(call: Callable[[], object], tries: int = 3, pause: Callable[[int], None] = lambda attempt: None) -> object:
    """``call()`` up to ``tries`` times; ``pause(attempt)`` runs between them, and the last error is raised."""
    for attempt in range(tries):
        try:
            return call()
        except Exception:
            if attempt == tries - 1:
                raise
            pause(attempt)
