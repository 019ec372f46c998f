"""Queries that take the bot of each pull request: fixtures, and DuckDB over the smallest data."""

import json
import os
from datetime import datetime
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import outcomes, timeline
from tallyspark.plans.registry import collect

DATA = Path(os.environ.get("TALLYSPARK_TEST_DATA", "/root/testdata/sf0.001"))
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test data")
PRS = [(1, "Lint[bot]", "x"), (2, "Quill", "quill"), (3, "Quill", None)]
EVENTS = [(1, "review", "lint"), (1, "review_comment", "LINT[bot]"), (1, "review", "quill"), (1, "commit", "x"), (2, "issue_comment", " quill"), (2, "review_comment", None), (2, "pr_opened", "other")]


def whole(text):
    """The object of a complete JSON text, also of one stored as a JSON string."""
    try:
        value = json.loads(text or "null")
        value = json.loads(value) if isinstance(value, str) else value
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def given():
    """Tables ``t`` (timeline), ``b`` (bot per pull request), ``e`` (timeline with the threads' further comments)."""
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    con.execute("CREATE MACRO k(x) AS regexp_replace(lower(trim(x)), '\\[bot\\]$', '')")
    con.execute("""CREATE TABLE b AS SELECT p.id AS pr_id, k(c.github_username) AS bot, k(p.pr_author) AS author FROM (SELECT id, arg_max(chatbot_id, discovered_at) AS bot_id, arg_max(pr_author, discovered_at) AS pr_author FROM prs GROUP BY id) p
 JOIN chatbots c ON c.id = p.bot_id""")
    rows = con.execute("SELECT pr_id, event_type, actor, data, ingested_at FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ingested_at) AS rn FROM timeline_events) WHERE rn = 1").fetchall()
    con.execute("CREATE TABLE t (pr_id BIGINT, kind STRING, actor STRING, tm TIMESTAMP, comment_id BIGINT, sha STRING, idx INTEGER)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?, ?)", [(p, k, a, at, (d := whole(x)).get("comment_id"), d.get("sha"), d.get("order_index") or 0) for p, k, a, x, at in rows])
    con.execute("""CREATE TABLE e AS SELECT pr_id, kind, k(actor) AS actor FROM t UNION ALL SELECT pr_id, 'review_comment', k(max_by(c.author, thread_id)) FROM (SELECT pr_id, thread_id, unnest(comments) AS c FROM review_threads) r
 WHERE c.id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t WHERE t.pr_id = r.pr_id AND t.comment_id = c.id) GROUP BY pr_id, c.id""")
    return con


def same(spark, name, con, sql):
    df = collect()[0][name](spark, str(DATA))
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(sql).fetchall())


def test_stats_and_roles(frame):
    prs, events = frame(PRS, "pr_id int, target string, pr_author string"), frame(EVENTS, "pr_id int, event_type string, actor string")
    threads = frame([(1, "a", True), (1, "b", False), (1, "c", True), (3, "d", None)], "pr_id int, thread_id string, is_resolved boolean")
    got = {r.pr_id: (r.n_events, r.n_commits, r.n_target_review_comments, r.n_target_comments, r.n_threads, r.n_resolved) for r in timeline.target_stats(prs, events, threads).collect()}
    assert got == {1: (4, 1, 1, 2, 3, 2), 2: (3, 0, 0, 1, 0, 0), 3: (0, 0, 0, 0, 1, 0)}
    roles = {r.pr_id: r.roles for r in timeline.target_roles(prs, events).collect()}
    assert roles == {1: ["reviewer"], 2: ["author", "commenter"], 3: []}


@needs_data
def test_stats_and_roles_of_the_given_tables(spark):
    con = given()
    assert con.execute("SELECT count(*) FROM review_threads WHERE is_resolved").fetchone()[0] > 0
    same(spark, "timeline_stats_by_bot", con, """SELECT pr_id, coalesce(n, 0), coalesce(c, 0), coalesce(rc, 0), coalesce(cm, 0), coalesce(th, 0), coalesce(rs, 0) FROM b
 LEFT JOIN (SELECT e.pr_id, count(*) AS n, count(*) FILTER (kind = 'commit') AS c, count(*) FILTER (kind = 'review_comment' AND actor = bot) AS rc,
 count(*) FILTER (kind IN ('review', 'review_comment', 'issue_comment') AND actor = bot) AS cm FROM e JOIN b ON b.pr_id = e.pr_id GROUP BY 1) USING (pr_id)
 LEFT JOIN (SELECT pr_id, count(*) AS th, count(*) FILTER (is_resolved) AS rs FROM review_threads GROUP BY 1) USING (pr_id)""")
    same(spark, "timeline_roles_by_bot", con, """SELECT b.pr_id, concat_ws(',', CASE WHEN author = bot THEN 'author' END, CASE WHEN bool_or(kind = 'issue_comment') THEN 'commenter' END, CASE WHEN bool_or(kind IN ('review', 'review_comment')) THEN 'reviewer' END)
 FROM b LEFT JOIN e ON e.pr_id = b.pr_id AND e.actor = bot GROUP BY b.pr_id, author, bot""")


def test_reviewed_commit_with_a_bot_per_pull_request(frame):
    t = lambda n: datetime(2026, 1, n)
    commits = frame([(p, i, f"{p}sha{i}", t(2 + 2 * i)) for p in (1, 2, 3, 4, 5) for i in range(3)], "pr_id int, idx int, sha string, at timestamp_ntz")
    reviews = frame([(1, "b", "b", "1sha0", t(5)), (1, "b", "a", "1sha1", t(1))], "pr_id int, bot string, author string, commit_id string, at timestamp_ntz")
    comments = frame([(2, "c", "c", None, "2sha1", t(3)), (2, "c", "b", "2sha0", None, t(1)), (5, "c", "C", "5sha0", "5sha1", t(1))], "pr_id int, bot string, author string, original_commit_id string, commit_id string, at timestamp_ntz")
    activity = frame([(3, "a", "b", t(2)), (3, "a", "a", t(5)), (4, "a", "b", t(2))], "pr_id int, bot string, actor string, at timestamp_ntz")
    got = outcomes.reviewed_commit(reviews, comments, commits, activity, F.col("bot"))
    assert {r.pr_id: r.sha for r in got.collect()} == {1: "1sha0", 2: "2sha1", 3: "3sha1", 4: "4sha2", 5: "5sha0"}
    split = outcomes.split_commits(commits, got).groupBy("pr_id").agg(F.count_if("is_post").alias("post"))
    assert {r.pr_id: r.post for r in split.collect()} == {1: 2, 2: 1, 3: 1, 4: 0, 5: 2}


@needs_data
def test_reviewed_commits_of_the_given_tables(spark):
    con = given()
    con.execute("""CREATE TABLE c AS SELECT pr_id, sha, min(idx) AS idx, min_by(tm, (idx, tm)) AS tm FROM t WHERE kind = 'commit' AND sha IS NOT NULL GROUP BY 1, 2""")
    con.execute("""CREATE TABLE h AS SELECT c.pr_id, coalesce(max_by(sha, CASE WHEN c.tm <= s.start THEN idx END), max_by(sha, idx)) AS sha FROM c LEFT JOIN
 (SELECT t.pr_id, min(tm) AS start FROM t JOIN b ON b.pr_id = t.pr_id AND k(t.actor) = bot WHERE kind IN ('review', 'review_comment', 'issue_comment') GROUP BY 1) s ON s.pr_id = c.pr_id GROUP BY 1""")
    same(spark, "hash_x_by_bot", con, "SELECT pr_id, substr(sha, 1, 10) FROM h")
    same(spark, "pre_post_split_by_bot", con, """SELECT c.pr_id, count(*) FILTER (NOT coalesce(idx > cut, false)), count(*) FILTER (coalesce(idx > cut, false)) FROM c JOIN
 (SELECT c.pr_id, min(idx) FILTER (c.sha = h.sha) AS cut FROM c JOIN h ON h.pr_id = c.pr_id GROUP BY 1) x ON x.pr_id = c.pr_id GROUP BY 1""")
