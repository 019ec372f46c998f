"""Discovery of pull requests in an event archive: keys, first-seen days, samples, ordered event lists, metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pr_number(event_type: Column, payload: Column) -> Column:
    """Number of the pull request an event belongs to: issue comments name it under the issue."""
    path = F.when(event_type == "IssueCommentEvent", F.get_json_object(payload, "$.issue.number")).otherwise(F.get_json_object(payload, "$.pull_request.number"))
    return path.try_cast("bigint")


def pr_url(payload: Column, repo: Column, number: Column) -> Column:
    written = F.coalesce(F.get_json_object(payload, "$.pull_request.html_url"), F.get_json_object(payload, "$.issue.pull_request.html_url"))
    return F.coalesce(written, F.concat(F.lit("https://github.com/"), repo, F.lit("/pull/"), number.cast("string")))


def on_pull_request(event_type: Column, payload: Column) -> Column:
    """Issue comments count only where the issue is a pull request."""
    return (event_type != "IssueCommentEvent") | F.get_json_object(payload, "$.issue.pull_request").isNotNull()


def targets(events: DataFrame, bots: Sequence[str] | None, first: object, last: object, min_number: int = 0) -> DataFrame:
    """``bot, repo, number, first_day, url`` of pull requests the bots acted on within the inclusive day range.

    ``events``: bot, repo, number, day, url. Events without a number are no target. One scan serves all bots.
    """
    kept = events.where(F.col("day").between(F.lit(first), F.lit(last)) & (F.col("number") >= min_number))
    if bots is not None:
        kept = kept.where(F.col("bot").isin(list(bots)))
    return kept.groupBy("bot", "repo", "number").agg(F.min("day").alias("first_day"), F.max("url").alias("url"))


def sample_targets(found: DataFrame, per_day: int, seed: int | None = 0) -> DataFrame:
    """At most ``per_day`` targets per bot and first day, in the order of a seeded hash of the key (of the key without seed).

    A bot whose targets number at most ``per_day`` over all days is kept whole. Days are few and a target is one small
    row, but a hot (bot, day) group is still ranked after a pre-selection by hash: rows whose hash already ranks beyond
    the cap within their own slice of the group cannot be chosen and are dropped before the final ranking.
    """
    order = F.lit(0) if seed is None else F.xxhash64(F.lit(seed), "bot", "repo", "number")
    keyed = found.withColumn("h", order).withColumn("slice", F.pmod(F.xxhash64("repo", "number"), F.lit(32)))
    ties = ["h", "repo", "number"]
    first = keyed.withColumn("rs", F.row_number().over(Window.partitionBy("bot", "first_day", "slice").orderBy(*ties))).where(F.col("rs") <= per_day)
    ranked = first.withColumn("rn", F.row_number().over(Window.partitionBy("bot", "first_day").orderBy(*ties)))
    totals = found.groupBy("bot").agg(F.count(F.lit(1)).alias("total"))
    small = totals.where(F.col("total") <= per_day).select("bot")
    cols = ["bot", "repo", "number", "first_day", "url"]
    whole = found.join(small, "bot", "left_semi").select(*cols)
    capped = ranked.join(small, "bot", "left_anti").where(F.col("rn") <= per_day).select(*cols)
    return whole.unionByName(capped)


def target_events(events: DataFrame, chosen: DataFrame) -> DataFrame:
    """All events of the chosen pull requests, by anyone: an equi-join on repository and number."""
    return events.join(chosen.select("repo", "number").distinct(), ["repo", "number"], "left_semi")


def event_lists(events: DataFrame) -> DataFrame:
    """``repo, number, events``: the events of a pull request in time order, then by id.

    The list is the result, so a pull request is one row; where its ends or size are all that is asked for,
    :func:`event_summary` gives them without gathering it.
    """
    one = F.struct("ts", "event_id", "actor", "event_type")
    return events.groupBy("repo", "number").agg(F.sort_array(F.collect_list(one)).alias("events"))


def event_summary(events: DataFrame) -> DataFrame:
    """``repo, number, n, first_id, last_id`` of the ordered events of a pull request, by partial aggregates alone."""
    order = F.struct("ts", "event_id")
    return events.groupBy("repo", "number").agg(F.count(F.lit(1)).alias("n"), F.min_by("event_id", order).alias("first_id"), F.max_by("event_id", order).alias("last_id"))


def first_seen_volume(events: DataFrame, null_numbers: bool = False) -> DataFrame:
    """``bot, day, pr_count``: every pull request counts once, on the day its bot was first seen on it.

    With ``null_numbers`` the events without a number form one more pull request per bot, as a key that concatenates to
    NULL does in the original query.
    """
    kept = events if null_numbers else events.where("number is not null")
    key = F.concat("repo", F.lit("#"), F.col("number").cast("string"))
    firsts = kept.groupBy("bot", key.alias("pr_key")).agg(F.min("day").alias("day"))
    return firsts.groupBy("bot", "day").agg(F.count(F.lit(1)).alias("pr_count"))


def first_non_null(rows: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per key the first non-null (and for strings non-empty) value of each column in the order given."""
    by = F.struct(*order)
    value = {c: F.nullif(F.col(c), F.lit("")) if dict(rows.dtypes)[c] == "string" else F.col(c) for c in columns}
    return rows.groupBy(key).agg(*[F.min_by(v, F.when(v.isNotNull(), by)).alias(c) for c, v in value.items()])


def reviewed_at(events: DataFrame) -> DataFrame:
    """``repo, number, reviewed_at``: earliest event of the pull request by its bot (exact name)."""
    return events.groupBy("repo", "number").agg(F.min(F.when(F.col("actor") == F.col("bot"), F.col("ts"))).alias("reviewed_at"))


def discovery_summary(found: DataFrame, existing: DataFrame) -> DataFrame:
    """One row: discovered, already known, new."""
    known = found.join(existing, ["repo", "number"], "left_semi")
    return found.agg(F.count(F.lit(1)).alias("discovered")).withColumn("known", known.agg(F.count(F.lit(1))).scalar()).withColumn("inserted", F.col("discovered") - F.col("known"))
