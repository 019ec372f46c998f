"""What happened after a review: reviewed commit, split of commits, outcome measures, readable summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.scores import f_beta
from tallyspark.functions.text import same_sha


def reviewed_commit(reviews: DataFrame, comments: DataFrame, commits: DataFrame, activity: DataFrame, bot: str | Column) -> DataFrame:
    """``pr_id, sha``: the commit a bot's review looked at.

    An empty name is none. In this order: commit of the bot's first review with one; original, else current, commit of its first review
    comment with one; last commit at or before its first activity; last commit. Names are compared without case, times
    as times. Inputs: reviews(pr_id, author, commit_id, at), comments(pr_id, author, original_commit_id, commit_id, at),
    commits(pr_id, idx, sha, at), activity(pr_id, actor, at). ``bot`` is one name, or a column that reviews, comments
    and activity carry for each pull request.
    """
    name = F.lower(F.lit(bot) if isinstance(bot, str) else bot)
    mine = lambda c: F.lower(F.col(c)) == name
    first_review = reviews.where(mine("author") & (F.col("commit_id") != "")).groupBy("pr_id").agg(F.min_by("commit_id", F.struct("at", "commit_id")).alias("by_review"))
    sha = F.coalesce(F.nullif("original_commit_id", F.lit("")), F.nullif("commit_id", F.lit("")))
    first_comment = comments.where(mine("author") & sha.isNotNull()).groupBy("pr_id").agg(F.min_by(sha, F.struct(F.col("at"), sha.alias("s"))).alias("by_comment"))
    start = activity.where(mine("actor")).groupBy("pr_id").agg(F.min("at").alias("start"))
    ends = commits.join(start, "pr_id", "left").groupBy("pr_id").agg(F.max_by("sha", F.when(F.col("at") <= F.col("start"), F.col("idx"))).alias("by_time"), F.max_by("sha", "idx").alias("last"))
    return ends.join(first_review, "pr_id", "left").join(first_comment, "pr_id", "left").select("pr_id", F.coalesce("by_review", "by_comment", "by_time", "last").alias("sha"))


def split_commits(commits: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Commits with ``is_post``: after the first commit that equals (or shares a prefix with) the reviewed one."""
    both = commits.join(reviewed.select("pr_id", F.col("sha").alias("reviewed_sha")), "pr_id", "left")
    cut = both.groupBy("pr_id").agg(F.min(F.when(same_sha(F.col("sha"), F.col("reviewed_sha")), F.col("idx"))).alias("cut"))
    return both.join(cut, "pr_id").select("pr_id", "idx", "sha", F.coalesce(F.col("idx") > F.col("cut"), F.lit(False)).alias("is_post"))


def outcome_measures(suggestions: Column, actions: Column, matches: Column, beta: float = 1.0) -> dict[str, Column]:
    """Precision, recall and F of a review from lists of ids and matches (structs of ``bot_issue_id, human_action_id, matched``).

    Numerators count distinct ids that exist in the lists, denominators the lists' lengths; an empty list gives NULL.
    """
    hit = F.filter(matches, lambda m: F.coalesce(m.matched, F.lit(False)))
    found = F.size(F.array_intersect(F.transform(hit, lambda m: m.bot_issue_id), suggestions))
    met = F.size(F.array_intersect(F.filter(F.transform(hit, lambda m: m.human_action_id), lambda x: x.isNotNull()), actions))
    p = F.try_divide(found.cast("double"), F.nullif(F.size(suggestions), F.lit(0)).cast("double"))
    r = F.try_divide(met.cast("double"), F.nullif(F.size(actions), F.lit(0)).cast("double"))
    return {"matched_suggestions": found, "matched_actions": met, "precision": p, "recall": r, "f_beta": f_beta(p, r, beta)}


def suggestion_summary(suggestions: DataFrame, matches: DataFrame) -> DataFrame:
    """``pr_id, total, matched, categories, severities, summary``: counts as ``name(n)`` in order of name, and as one text.

    ``suggestions``: pr_id, category, severity; ``matches``: pr_id, bot_issue_id, matched. A missing category counts as
    ``other``, a missing severity as ``medium``; ``matched`` counts the distinct matched ids.
    """
    kinds = F.array(F.struct(F.lit("category").alias("dim"), F.coalesce("category", F.lit("other")).alias("value")), F.struct(F.lit("severity").alias("dim"), F.coalesce("severity", F.lit("medium")).alias("value")))
    counts = suggestions.select("pr_id", F.inline(kinds)).groupBy("pr_id", "dim", "value").count()
    entry = F.struct("value", F.concat("value", F.lit("("), F.col("count").cast("string"), F.lit(")")).alias("text"))
    joined = lambda d: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("dim") == d, entry))), lambda e: e.text), ", ")
    total = F.sum(F.when(F.col("dim") == "category", F.col("count"))).alias("total")
    rows = counts.groupBy("pr_id").agg(total, joined("category").alias("categories"), joined("severity").alias("severities"))
    hits = matches.where("matched").groupBy("pr_id").agg(F.count_distinct("bot_issue_id").alias("matched"))
    both = rows.join(hits, "pr_id", "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    text = F.concat_ws("\n", F.format_string("Total suggestions: %d, matched: %d", "total", "matched"), F.concat(F.lit("Categories: "), "categories"), F.concat(F.lit("Severities: "), "severities"))
    return both.select("pr_id", "total", "matched", "categories", "severities", text.alias("summary"))


def first_files(files: DataFrame) -> DataFrame:
    """One row per pull request and file name: the first occurrence by commit and position."""
    return files.groupBy("pr_id", "filename").agg(F.min(F.struct("commit_idx", "file_idx", "status")).alias("f")).select("pr_id", "filename", "f.commit_idx", "f.status")


def file_list(files: DataFrame) -> DataFrame:
    """``pr_id, text``: a line per distinct non-empty file name, in order of first occurrence.

    ``files``: pr_id, commit_idx, file_idx, filename, status, additions, deletions.
    """
    line = F.concat("filename", F.lit(" ("), F.coalesce("status", F.lit("")), F.lit(", "), _changes(F.col("additions"), F.col("deletions")), F.lit(")"))
    first = files.where("filename <> ''").groupBy("pr_id", "filename").agg(F.min(F.struct("commit_idx", "file_idx", line.alias("line"))).alias("f"))
    return first.groupBy("pr_id").agg(_lines(F.col("f")).alias("text"))


def _changes(additions: Column, deletions: Column) -> Column:
    return F.concat(F.lit("+"), F.coalesce(additions, F.lit(0)).cast("string"), F.lit("/-"), F.coalesce(deletions, F.lit(0)).cast("string"))


def _lines(entry: Column, sep: str = "\n") -> Column:
    """Lines of a group in the order of ``entry``, a struct that ends with ``line``."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e.line), sep)


def with_details(commits: DataFrame, details: DataFrame) -> DataFrame:
    """Commits with the files of their own detail record, by full name; of several records the last counts.

    ``commits``: pr_id, idx, sha, ...; ``details``: pr_id, seq, sha, files.
    """
    last = details.where("sha <> ''").groupBy("pr_id", "sha").agg(F.max_by("files", "seq").alias("files"))
    return commits.join(last, ["pr_id", "sha"], "left")


def file_text(status: Column, name: Column, additions: Column, deletions: Column, patch: Column | None = None) -> Column:
    """Line of a file in a commit, followed by its patch where there is one."""
    line = F.concat(F.lit("  "), F.upper(F.coalesce(status, F.lit(""))), F.lit(" "), F.coalesce(name, F.lit("")), F.lit(" ("), _changes(additions, deletions), F.lit(")"))
    return line if patch is None else F.when(F.length(patch) > 0, F.concat(line, F.lit("\n  ```diff\n"), patch, F.lit("\n  ```"))).otherwise(line)


def commit_text(files: Column | None = None) -> Column:
    """Text of a commit from its columns sha, message, author, date and its ``files`` (array of structs): name, message, files."""
    head = F.concat(F.lit("COMMIT "), F.substring(F.coalesce("sha", F.lit("")), 1, 12), F.lit(" by "), F.coalesce("author", F.lit("unknown")), F.lit(" ["), F.coalesce("date", F.lit("")), F.lit("]"))
    message = F.concat(F.lit("  Message: "), F.coalesce("message", F.lit("")))
    listed = F.array().cast("array<string>")
    if files is not None:
        listed = F.coalesce(F.transform(files, lambda f: file_text(f.status, f.filename, f.additions, f.deletions, f.patch)), listed)
    return F.concat_ws("\n", head, message, listed, F.lit(""))


def commits_text(commits: DataFrame) -> DataFrame:
    """``pr_id, text``: the texts of a pull request's commits in order; ``commits`` as :func:`with_details` gives them."""
    rows = commits.select("pr_id", "idx", commit_text(F.col("files")).alias("line"))
    return rows.groupBy("pr_id").agg(_lines(F.struct("idx", "line")).alias("text"))


def _place(path: Column, line: Column) -> Column:
    return F.when(F.length(path) > 0, F.concat(F.lit(" ("), path, F.lit(":"), F.coalesce(line.cast("string"), F.lit("")), F.lit(")"))).otherwise("")


def comment_text(kind: Column, at: Column, state: Column, body: Column, path: Column, line: Column, hunk: Column, resolved: Column) -> Column:
    """Text of a review or comment of the bot: stamp, kind and place, code, body."""
    own = F.when(F.length(body) > 0, F.concat(F.lit("  "), body))
    code = F.when(F.length(hunk) > 0, F.concat(F.lit("  Code context:\n  ```\n"), hunk, F.lit("\n  ```")))
    stamp = F.concat(F.lit("["), F.coalesce(at, F.lit("")), F.lit("] "))
    review = F.concat_ws("\n", F.concat(stamp, F.lit("REVIEW ("), F.coalesce(state, F.lit("")), F.lit("):")), own, F.lit(""))
    done = F.when(resolved, " [RESOLVED]").otherwise("")
    comment = F.concat_ws("\n", F.concat(stamp, F.upper(kind), _place(path, line), done, F.lit(":")), code, own, F.lit(""))
    return F.when(kind == "review", review).when(kind.isin("review_comment", "issue_comment"), comment)


def activity_text(kind: Column, at: Column, actor: Column, state: Column, body: Column, path: Column, line: Column, resolved: Column) -> Column:
    """Text of what others did after the review; NULL for kinds that are left out."""
    own = F.when(F.length(body) > 0, F.concat(F.lit("  "), body))
    stamp, who = F.concat(F.lit("["), F.coalesce(at, F.lit("")), F.lit("] ")), F.coalesce(actor, F.lit("unknown"))
    done = F.when(resolved, " [RESOLVED]").otherwise("")
    comment = F.concat_ws("\n", F.concat(stamp, F.upper(kind), F.lit(" by "), who, _place(path, line), done, F.lit(":")), own, F.lit(""))
    review = F.concat_ws("\n", F.concat(stamp, F.lit("REVIEW by "), who, F.lit(": "), F.coalesce(state, F.lit(""))), own, F.lit(""))
    ended = F.concat_ws("\n", F.concat(stamp, F.upper(kind), F.lit(" by "), who), F.lit(""))
    return F.when(kind.isin("review_comment", "issue_comment"), comment).when(kind == "review", review).when(kind.isin("pr_merged", "pr_closed", "pr_reopened"), ended)


def joined_text(rows: DataFrame, order: list[str], line: Column) -> DataFrame:
    """``pr_id, text``: the lines of a pull request in order; NULL lines are left out."""
    return rows.select("pr_id", *order, line.alias("line")).where("line is not null").groupBy("pr_id").agg(_lines(F.struct(*order, "line")).alias("text"))


def suggestion_text(issue_id: Column, category: Column, severity: Column, description: Column, path: Column, line: Column) -> Column:
    place = F.when(F.length(path) > 0, F.concat(F.lit(" ("), path, F.when(line != 0, F.concat(F.lit(":"), line.cast("string"))).otherwise(""), F.lit(")"))).otherwise("")
    return F.concat(F.lit("- ["), issue_id, F.lit("] ("), category, F.lit("/"), severity, F.lit(")"), place, F.lit(": "), description)


def action_text(action_id: Column, category: Column, action_type: Column, description: Column, path: Column) -> Column:
    return suggestion_text(action_id, category, action_type, description, path, F.lit(None).cast("int"))


def bug_types(given: Column, count: Column) -> Column:
    """``bug_type, error`` by position for ``count`` comments; a missing one is ``other`` with the error ``not_labeled``."""
    kind = "array<struct<bug_type:string,error:string>>"
    at = lambda i: F.try_element_at(given, i.cast("int"))
    one = lambda i: F.struct(F.coalesce(at(i), F.lit("other")).alias("bug_type"), F.when(at(i).isNull(), "not_labeled").alias("error"))
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), one)).otherwise(F.array().cast(kind))
