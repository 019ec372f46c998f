"""Reports: crosstabs, mixes, frequencies, export rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages of the benchmark's source repositories.
REPO_LANGUAGES = {
    "keycloak": "Java", "sentry": "Python", "grafana": "Go", "discourse": "Ruby", "cal.com": "TypeScript", "calcom": "TypeScript", "cal_dot_com": "TypeScript",
}


def crosstab(rows: DataFrame, row: str, column: str, columns: Sequence[str]) -> DataFrame:
    """Counts of ``row`` by given values of ``column``, plus the row total; absent cells are 0."""
    wide = rows.groupBy(row).pivot(column, list(columns)).agg(F.count(F.lit(1)))
    filled = [F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in columns]
    totals = rows.groupBy(row).agg(F.count(F.lit(1)).alias("total"))
    return wide.select(row, *filled).join(totals, row)


def totals(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cell, row, column and grand totals in long form; a totalled dimension reads ``(all)``."""
    cube = rows.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping(a).alias("ga"), F.grouping(b).alias("gb"))
    name = lambda c, g: F.when(F.col(g) == 1, "(all)").otherwise(F.col(c).cast("string")).alias(c)
    return cube.select(name(a, "ga"), name(b, "gb"), "n")


def value_mix(rows: DataFrame, key: str, value: str, default: str = "Unknown") -> DataFrame:
    """``key, mix``: counts per value as ``name:n`` in order of name."""
    counts = rows.groupBy(key, F.coalesce(value, F.lit(default)).alias("v")).count()
    return counts.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.concat("v", F.lit(":"), F.col("count").cast("string")))), ",").alias("mix"))


def files_touched(comments: DataFrame, key: str) -> DataFrame:
    """Distinct non-empty paths per key."""
    return comments.groupBy(key).agg(F.count_distinct(F.nullif("path", F.lit(""))).alias("n_files"))


def frequencies(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``dim, value, n`` of every value of every column, NULL left out, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.inline(pairs)).where("value is not null").groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"))


def repo_language(source_file: Column) -> Column:
    """Language of a reference set by the name of its file without ``.json``, ``Unknown`` otherwise."""
    table = F.create_map(*[F.lit(x) for kv in REPO_LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.replace(source_file, F.lit(".json"), F.lit(""))), F.lit("Unknown"))


EXPORT = ["pr_id", "review_url", "review_text", "candidates", "last_comment", "golden_comments", "judge_results", "found_issues", "total_issues"]


def export_rows(reviews: DataFrame, golden: DataFrame, candidates: DataFrame, scores: DataFrame, matches: DataFrame) -> DataFrame:
    """The nine columns of :data:`EXPORT` (after ``url, tool``), one row per review.

    ``reviews``: url, tool, original_url, review_url, bodies; ``golden``: url, golden_idx, golden, severity;
    ``candidates``: url, tool, cand_idx, candidate; ``scores``: as ``review_scores`` gives them, absent where a review
    was not evaluated; ``matches``: as ``golden_matches``. The verdicts list the found texts, then the missed ones.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    ordered = lambda *cols: F.transform(F.sort_array(F.collect_list(F.struct(*cols))), lambda e: e.line)
    asked = golden.groupBy("url").agg(F.array_join(ordered("golden_idx", F.concat(F.lit("["), F.coalesce("severity", F.lit("Unknown")), F.lit("] "), text(F.col("golden"))).alias("line")), "\n\n").alias("golden_comments"))
    named = candidates.groupBy("url", "tool").agg(F.array_join(ordered("cand_idx", text(F.col("candidate")).alias("line")), "\n\n").alias("candidates"))
    # a text listed several times is judged once, with its last severity at its first place
    severity = golden.groupBy("url", "golden").agg(F.max_by("severity", "golden_idx").alias("severity"), F.min("golden_idx").alias("first"))
    judged = scores.where("not skipped").select("url", "tool").join(severity, "url").join(matches.select("url", "tool", "golden", "matched"), ["url", "tool", "golden"], "left")
    hit = F.coalesce("matched", F.lit(False))
    line = F.concat(F.when(hit, "[FOUND] [").otherwise("[MISSED] ["), F.coalesce("severity", F.lit("?")), F.lit("] "), "golden")
    verdicts = judged.groupBy("url", "tool").agg(F.array_join(ordered((~hit).alias("missed"), "first", line.alias("line")), "\n").alias("verdicts"))
    done = scores.select("url", "tool", "skipped", "tp", "total_golden", F.lit(True).alias("evaluated"))
    rows = reviews.join(asked, "url", "left").join(named, ["url", "tool"], "left").join(done, ["url", "tool"], "left").join(verdicts, ["url", "tool"], "left")
    real = F.filter("bodies", lambda b: F.length(b) > 0)
    result = F.when(F.col("evaluated").isNull(), "Not evaluated").when(F.col("skipped"), "No golden comments").otherwise(text(F.col("verdicts")))
    counted = lambda c: F.when(F.col("evaluated") & ~F.col("skipped"), F.col(c))
    return rows.select(
        "url", "tool", F.coalesce(F.nullif("original_url", F.lit("")), "url").alias("pr_id"), text(F.col("review_url")).alias("review_url"), F.array_join(real, "\n\n---\n\n").alias("review_text"),
        text(F.col("candidates")).alias("candidates"), text(F.try_element_at("bodies", F.lit(-1))).alias("last_comment"), text(F.col("golden_comments")).alias("golden_comments"), result.alias("judge_results"),
        counted("tp").alias("found_issues"), counted("total_golden").alias("total_issues"),
    )


def write_export(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Write a report as JSON or CSV, replacing what is there."""
    writer = rows.write.mode("overwrite")
    (writer.option("header", "true").csv if kind == "csv" else writer.json)(path)


def as_document(rows: DataFrame):
    """One JSON document per row, for services that hand out reports."""
    return rows.select(F.to_json(F.struct("*")).alias("document"))
