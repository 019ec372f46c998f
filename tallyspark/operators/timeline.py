"""Timelines of pull requests: union of event sources, thread enrichment, order, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["pr_id", "ts", "event_type", "actor", "comment_id", "review_id", "sha", "body", "path", "line", "is_resolved", "order_index", "source_seq"]
_ACTIONS = {"opened": "pr_opened", "reopened": "pr_reopened"}


def event_kind(kind: Column, action: Column, merged: Column) -> Column:
    """Timeline type of an archive event."""
    pr = F.when((action == "closed") & F.coalesce(merged, F.lit(False)), "pr_merged").when(action == "closed", "pr_closed")
    for a, name in _ACTIONS.items():
        pr = pr.when(action == a, name)
    pr = pr.otherwise(F.concat(F.lit("pr_"), action))
    return (
        F.when(kind == "PullRequestEvent", pr).when(kind == "PullRequestReviewEvent", "review").when(kind == "PullRequestReviewCommentEvent", "review_comment").when(kind == "IssueCommentEvent", "issue_comment")
    )


def comment_line(original_line: Column, line: Column) -> Column:
    """The original line unless it is NULL or 0, then the current one."""
    return F.coalesce(F.nullif(original_line, F.lit(0)), line)


def combine(*sources: DataFrame) -> DataFrame:
    """Union of sources by column name; the position of a source breaks ties between equal times."""
    numbered = [s.withColumn("source_seq", F.lit(i)) for i, s in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def unseen_reviews(reviews: DataFrame, timeline: DataFrame) -> DataFrame:
    """API reviews with a submission time that no timeline event already shows."""
    seen = timeline.where("event_type = 'review' and review_id is not null").select("pr_id", "review_id").distinct()
    return reviews.where("submitted_at is not null").join(seen, ["pr_id", "review_id"], "left_anti")


def thread_comments(threads: DataFrame) -> DataFrame:
    """One row per comment of the threads; a comment in two threads keeps the last of them."""
    rows = threads.select("pr_id", "thread_id", "is_resolved", F.explode("comments").alias("c")).select(
        "pr_id", "thread_id", "is_resolved", F.col("c.id").alias("comment_id"), F.col("c.body").alias("body"), F.col("c.path").alias("path"), comment_line(F.col("c.original_line"), F.col("c.line")).alias("line"), F.col("c.author").alias("author"),
        F.array_sort(F.map_entries("c.reactions")).alias("reactions"),
    )
    best = F.max(F.struct("thread_id", "is_resolved", "body", "path", "line", "author", "reactions")).alias("t")
    return rows.where("comment_id is not null").groupBy("pr_id", "comment_id").agg(best).select("pr_id", "comment_id", "t.*")


def enrich_with_threads(timeline: DataFrame, comments: DataFrame) -> DataFrame:
    """Review comments take thread, resolution, reactions and (if not empty) body from their thread; thread comments nobody saw are added."""
    other = comments.select("pr_id", "comment_id", F.col("body").alias("t_body"), F.col("is_resolved").alias("t_resolved"), "thread_id", "reactions")
    known = timeline.join(other, ["pr_id", "comment_id"], "left").withColumns({"body": F.coalesce(F.nullif("t_body", F.lit("")), "body"), "is_resolved": F.col("t_resolved")}).drop("t_body", "t_resolved")
    missing = comments.join(timeline.where("comment_id is not null").select("pr_id", "comment_id").distinct(), ["pr_id", "comment_id"], "left_anti")
    added = missing.select("pr_id", "comment_id", "body", "path", "line", "is_resolved", "thread_id", "reactions", F.coalesce("author", F.lit("unknown")).alias("actor"), F.lit("review_comment").alias("event_type"))
    return known.unionByName(added, allowMissingColumns=True)


def _order() -> Column:
    """Time (missing first), order index, source, then what else tells events apart."""
    return F.struct(F.coalesce("ts", F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"), F.coalesce("order_index", F.lit(0)).alias("order_index"), F.coalesce("source_seq", F.lit(9)).alias("source_seq"), "comment_id", "event_type", "actor")


def ordered(timeline: DataFrame) -> DataFrame:
    """``pr_id, events``: nested form in order. The list is the result, so a pull request is one row."""
    return timeline.groupBy("pr_id").agg(F.sort_array(F.collect_list(_order())).alias("events"))


def summary(timeline: DataFrame) -> DataFrame:
    """``pr_id, n, first_type, last_at`` of the ordered events, by partial aggregates alone."""
    return timeline.groupBy("pr_id").agg(F.count(F.lit(1)).alias("n"), F.min(_order()).alias("a"), F.max(_order()).alias("b")).select("pr_id", "n", F.col("a.event_type").alias("first_type"), F.col("b.at").alias("last_at"))


def name_key(name: str) -> Column:
    """Names are the same if they agree without letter case, outer blanks and a final ``[bot]``."""
    return F.regexp_replace(F.lower(F.trim(name)), r"\[bot\]$", "")


def _same(actor: str, target: str, exact: bool) -> Column:
    return F.col(actor) == F.col(target) if exact else name_key(actor) == name_key(target)


def target_stats(prs: DataFrame, timeline: DataFrame, threads: DataFrame, exact: bool = False) -> DataFrame:
    """Counts of every pull request of ``prs(pr_id, target)`` (unique per pull request), each with its own target.

    Names agree by :func:`name_key`, or only if they are equal with ``exact``.

    ``timeline`` is enriched with threads. Reviews count among the target's comments; threads and resolved threads are
    those of ``threads(pr_id, thread_id, is_resolved)``. A pull request without events or threads has zeros.
    """
    own, kind = _same("actor", "target", exact), F.col("event_type")
    events = timeline.join(prs.select("pr_id", "target"), "pr_id").groupBy("pr_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(kind == "commit").alias("n_commits"), F.count_if(own & (kind == "review_comment")).alias("n_target_review_comments"),
        F.count_if(own & kind.isin("review_comment", "issue_comment", "review")).alias("n_target_comments"),
    )
    kept = threads.groupBy("pr_id").agg(F.count_distinct("thread_id").alias("n_threads"), F.count_distinct(F.when(F.col("is_resolved"), F.col("thread_id"))).alias("n_resolved"))
    both = prs.select("pr_id").join(events, "pr_id", "left").join(kept, "pr_id", "left")
    return both.select("pr_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in both.columns if c != "pr_id"])


def target_roles(prs: DataFrame, timeline: DataFrame, exact: bool = False) -> DataFrame:
    """``pr_id, roles``: sorted set of author, commenter, reviewer that the target takes in each pull request of ``prs(pr_id, target, pr_author)``.

    The author is ``pr_author``, whoever opened it; no role gives an empty array.
    """
    kind = F.col("event_type")
    role = F.when(kind.isin("review", "review_comment"), "reviewer").when(kind == "issue_comment", "commenter")
    acted = timeline.join(prs.select("pr_id", "target"), "pr_id").where(_same("actor", "target", exact) & role.isNotNull()).select("pr_id", role.alias("role"))
    wrote = prs.where(_same("pr_author", "target", exact)).select("pr_id", F.lit("author").alias("role"))
    found = acted.unionByName(wrote).groupBy("pr_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    return prs.select("pr_id").join(found, "pr_id", "left").select("pr_id", F.coalesce("roles", F.array().cast("array<string>")).alias("roles"))


def diff_lines(details: Column) -> Column:
    """Sum of additions and deletions over all files of all commits; NULL counts as 0."""
    size = lambda f: F.coalesce(f.additions, F.lit(0)) + F.coalesce(f.deletions, F.lit(0))
    own = lambda c: F.coalesce(F.aggregate(c.files, F.lit(0).cast("bigint"), lambda a, f: a + size(f)), F.lit(0))
    return F.aggregate(details, F.lit(0).cast("bigint"), lambda a, c: a + own(c))
