"""Documents of the code host as rows, comments of all endpoints as one list, and the assembled record of a pull request.

Documents arrive as JSON text. A field that is missing, null or of another kind takes its stated default; a document
that is no valid JSON yields no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.jsonx import parse_strict
from tallyspark.operators.timeline import comment_line


def _text(doc: Column, path: str, default: str | None = None) -> Column:
    value = F.try_variant_get(doc, path, "string")
    return value if default is None else F.coalesce(value, F.lit(default))


def _number(doc: Column, path: str, default: int | None = None) -> Column:
    value = F.try_variant_get(doc, path, "bigint")
    return value if default is None else F.coalesce(value, F.lit(default).cast("bigint"))


def _parsed(rows: DataFrame, doc: str, fields: dict[str, Column]) -> DataFrame:
    keep = [c for c in rows.columns if c != doc]
    opened = rows.withColumn("__doc", parse_strict(F.col(doc))).where("__doc is not null")
    return opened.select(*keep, *[c.alias(n) for n, c in fields.items()])


def commit_rows(rows: DataFrame, doc: str = "doc") -> DataFrame:
    """``sha, message, date, author`` of commit documents, beside the other columns."""
    d = F.col("__doc")
    return _parsed(rows, doc, {"sha": _text(d, "$.sha"), "message": _text(d, "$.commit.message", ""), "date": _text(d, "$.commit.author.date", ""), "author": _text(d, "$.author.login")})


def review_rows(rows: DataFrame, doc: str = "doc") -> DataFrame:
    """``id, author, state, body, submitted_at, commit_id, author_association`` of review documents."""
    d = F.col("__doc")
    named = {n: _text(d, f"$.{n}", v) for n, v in (("state", ""), ("body", ""), ("submitted_at", None), ("commit_id", None), ("author_association", None))}
    return _parsed(rows, doc, {"id": _number(d, "$.id"), "author": _text(d, "$.user.login"), **named})


def detail_rows(rows: DataFrame, doc: str = "doc") -> DataFrame:
    """``sha, files`` of commit details; ``files`` holds ``filename, status, additions, deletions, patch``, empty where there are none."""
    d = F.col("__doc")
    one = lambda f: F.struct(
        _text(f, "$.filename").alias("filename"), _text(f, "$.status", "unknown").alias("status"), _number(f, "$.additions", 0).alias("additions"), _number(f, "$.deletions", 0).alias("deletions"), _text(f, "$.patch", "").alias("patch")
    )
    files = F.transform(F.coalesce(F.try_variant_get(d, "$.files", "array<variant>"), F.array().cast("array<variant>")), one)
    return _parsed(rows, doc, {"sha": _text(d, "$.sha"), "files": files})


def summary_rows(rows: DataFrame, doc: str = "doc") -> DataFrame:
    """``additions, deletions, commits, changed_files`` of pull-request documents, 0 where missing."""
    return _parsed(rows, doc, {n: _number(F.col("__doc"), f"$.{n}", 0) for n in ("additions", "deletions", "commits", "changed_files")})


def thread_rows(rows: DataFrame, doc: str = "doc") -> DataFrame:
    """``id, is_resolved, resolved_by, comments`` of thread documents; reaction groups become a map of counts."""
    d = F.col("__doc")
    groups = lambda c: F.coalesce(F.try_variant_get(c, "$.reactionGroups", "array<variant>"), F.array().cast("array<variant>"))
    one = lambda c: F.struct(
        _number(c, "$.databaseId").alias("id"), _text(c, "$.body").alias("body"), _text(c, "$.path").alias("path"), _number(c, "$.line").cast("int").alias("line"), _number(c, "$.originalLine").cast("int").alias("original_line"),
        _text(c, "$.diffHunk").alias("diff_hunk"), _text(c, "$.author.login").alias("author"), _text(c, "$.createdAt").alias("created_at"),
        F.map_from_entries(F.transform(groups(c), lambda g: F.struct(_text(g, "$.content"), _number(g, "$.reactors.totalCount", 0).cast("int")))).alias("reactions"),
    )
    comments = F.transform(F.coalesce(F.try_variant_get(d, "$.comments.nodes", "array<variant>"), F.array().cast("array<variant>")), one)
    return _parsed(rows, doc, {"id": _text(d, "$.id"), "is_resolved": F.try_variant_get(d, "$.isResolved", "boolean"), "resolved_by": _text(d, "$.resolvedBy.login"), "comments": comments})


def review_comments(inline: DataFrame, reviews: DataFrame, general: DataFrame) -> DataFrame:
    """``key, endpoint, path, line, body, created_at``: the comments of three endpoints as one list.

    Inputs carry ``key`` and the endpoint's own columns: inline comments path, line, original_line, body, created_at;
    reviews body, submitted_at; general comments body, created_at. Only reviews without a body are left out.
    """
    no_place = [F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line")]
    parts = [
        inline.select("key", F.lit(0).alias("endpoint"), "path", comment_line(F.col("line"), F.col("original_line")).alias("line"), "body", "created_at"),
        reviews.where(F.length("body") > 0).select("key", F.lit(1).alias("endpoint"), *no_place, "body", F.col("submitted_at").alias("created_at")),
        general.select("key", F.lit(2).alias("endpoint"), *no_place, "body", "created_at"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def golden_url(rows: DataFrame, golden: DataFrame) -> DataFrame:
    """``rows`` (repo, number, ...) with ``url``: the reference address of exactly that repository name and number.

    Of several owners' repositories of one name the first address counts. The original system looks for the text
    ``/repo/pull/number`` inside the addresses and so also finds number 10 for 1; here the parts must be equal.
    """
    part = lambda i: F.regexp_extract("url", r"/([^/]+)/pull/([0-9]+)(?:$|[^0-9])", i)
    keyed = golden.where(part(2) != "").select(part(1).alias("repo"), part(2).try_cast("bigint").alias("number"), "url")
    return rows.join(keyed.groupBy("repo", "number").agg(F.min("url").alias("url")), ["repo", "number"], "left")


def thread_summaries(threads: DataFrame) -> DataFrame:
    """``pr_id, thread_id, path, is_resolved, n_comments``: the path of a thread is the first one any of its comments has."""
    paths = F.filter(F.transform("comments", lambda c: c.path), lambda p: p.isNotNull())
    return threads.select("pr_id", "thread_id", F.try_element_at(paths, F.lit(1)).alias("path"), F.coalesce("is_resolved", F.lit(False)).alias("is_resolved"), F.coalesce(F.size("comments"), F.lit(0)).alias("n_comments"))


def assembled(prs: DataFrame, metadata: DataFrame, events: DataFrame, threads: DataFrame, stats: DataFrame, roles: DataFrame) -> DataFrame:
    """One record per pull request with raw events: ``pr_id, pr_url, repo_name, pr_number``, metadata, roles, nested events and threads, stats.

    ``prs``: pr_id, pr_url, repo_name, pr_number, has_events; all others hold one row per ``pr_id``. A pull request
    whose raw events are NULL has no record.
    """
    kept = prs.where("has_events").select("pr_id", "pr_url", "repo_name", "pr_number")
    one = lambda df, name: df.select("pr_id", F.struct(*[c for c in df.columns if c != "pr_id"]).alias(name))
    record = kept.join(metadata, "pr_id", "left").join(roles, "pr_id", "left").join(events, "pr_id", "left").join(threads, "pr_id", "left").join(one(stats, "stats"), "pr_id", "left")
    return record


def as_records(record: DataFrame, name: str = "assembled") -> DataFrame:
    """``pr_id`` and the record as one JSON document; the shape in which records are stored."""
    return record.select("pr_id", F.to_json(F.struct(*[c for c in record.columns if c != "pr_id"])).alias(name))
