from datetime import date, datetime

from pyspark.sql import functions as F

from tallyspark.functions import labels, text
from tallyspark.operators import discovery, lifecycle, outcomes, timeline

EV = "bot string, repo string, number long, day date, url string"
D = lambda n: date(2026, 2, n)


def test_targets_and_sample(frame):
    rows = [("a", "r", 1, D(2), "u"), ("a", "r", 1, D(1), "v"), ("a", "r", None, D(1), "x"), ("b", "r", 2, D(9), "y")] + [("c", "r", i, D(3), "z") for i in range(40)]
    found = discovery.targets(frame(rows, EV), None, D(1), D(5))
    one = found.where("bot = 'a'").first()
    assert (one.first_day, one.url) == (D(1), "v") and found.where("bot = 'b'").count() == 0
    sample = discovery.sample_targets(found, 7, seed=5)
    assert sample.where("bot = 'c'").count() == 7 and sample.where("bot = 'a'").count() == 1
    same = discovery.sample_targets(found.repartition(9), 7, seed=5)
    assert sorted(map(str, sample.collect())) == sorted(map(str, same.collect()))
    assert sorted(map(str, sample.collect())) != sorted(map(str, discovery.sample_targets(found, 7, seed=6).collect()))


def test_first_seen_volume(frame):
    rows = [("a", "r", 1, D(2), None), ("a", "r", 1, D(1), None), ("a", "r", 2, D(2), None), ("a", "r", None, D(1), None)]
    ev = frame(rows, EV)
    assert {(r.day, r.pr_count) for r in discovery.first_seen_volume(ev).collect()} == {(D(1), 1), (D(2), 1)}
    assert {(r.day, r.pr_count) for r in discovery.first_seen_volume(ev, True).collect()} == {(D(1), 2), (D(2), 1)}


def test_pr_number_and_url(frame):
    rows = [("IssueCommentEvent", '{"issue":{"number":4}}'), ("PullRequestEvent", '{"pull_request":{"number":5,"html_url":"h"}}'), ("PushEvent", "{}")]
    df = frame(rows, "t string, p string")
    n = discovery.pr_number(F.col("t"), F.col("p"))
    got = df.select(n.alias("n"), discovery.pr_url(F.col("p"), F.lit("o/r"), n).alias("u"), discovery.on_pull_request(F.col("t"), F.col("p")).alias("k")).collect()
    assert [(r.n, r.u, r.k) for r in got] == [(4, "https://github.com/o/r/pull/4", False), (5, "h", True), (None, None, True)]


def test_metadata_falls_through_empty_titles(frame):
    rows = [("k", 1, None, None), ("k", 2, "", False), ("k", 3, "t", True), ("k", 4, "u", True)]
    (r,) = discovery.first_non_null(frame(rows, "k string, i int, title string, merged boolean"), "k", ["i"], ["title", "merged"]).collect()
    assert (r.title, r.merged) == ("t", False)


def test_upserts(frame):
    old = frame([(1, "a", 1), (2, "b", 1)], "id int, v string, at int")
    new = frame([(2, "c", 2), (2, "d", 3), (3, "e", 1), (3, "e", 1)], "id int, v string, at int")
    assert sorted(map(tuple, lifecycle.upsert(old, new, ["id"], ["at"]).collect())) == [(1, "a", 1), (2, "d", 3), (3, "e", 1)]
    assert sorted(map(tuple, lifecycle.insert_ignore(old, new, ["id"], ["at"]).collect())) == [(3, "e", 1)]
    assert {tuple(r) for r in lifecycle.incremental_merge(old, new.where("at = 2"), ["id"], force=True).collect()} == {(1, "a", 1), (2, "c", 2)}
    assert lifecycle.upsert(old.limit(0), new.limit(0), ["id"], ["at"]).collect() == []


def test_queue_gate_lock_and_status(frame):
    df = frame([(1, 60, 10), (2, 3, 5000), (3, None, None), (4, 3, 3)], "id int, c int, l long")
    gate = lifecycle.size_gate(F.col("c"), F.col("l"))
    assert [(r.s, r.r) for r in df.select(gate["status"].alias("s"), gate["reason"].alias("r")).collect()] == [("skipped", "commits 60 > 50"), ("skipped", "lines 5000 > 2000"), ("enriching", None), ("enriching", None)]
    now = F.lit("2026-01-01 12:00:00").cast("timestamp_ntz")
    locks = frame([(None,), (datetime(2026, 1, 1, 11, 29),), (datetime(2026, 1, 1, 11, 31),)], "at timestamp_ntz")
    assert [r.x for r in locks.select(lifecycle.lockable(F.col("at"), now).alias("x")).collect()] == [True, True, False]
    log = frame([(1, 1, "pending"), (1, 3, "error"), (1, 2, "enriched")], "id int, at int, status string")
    assert lifecycle.status_log(log, "id").first().status == "error"
    steps = frame([("threads",), (None,), ("odd",)], "s string")
    assert [r.x for r in steps.select(lifecycle.step_index(F.col("s")).alias("x")).collect()] == [4, 0, 0]


def test_cascade_removes_every_reference(frame):
    prs, labels_ = frame([(1,), (2,)], "id int"), frame([(1, "x"), (2, "y")], "pr_id int, l string")
    kept = lifecycle.delete_cascade({"prs": (prs, "id"), "labels": (labels_, "pr_id")}, prs.where("id = 1"), "id")
    assert [r.id for r in kept["prs"].collect()] == [2] and [r.pr_id for r in kept["labels"].collect()] == [2]


TL = "pr_id int, ts timestamp_ntz, event_type string, actor string, comment_id long, body string, is_resolved boolean, review_id long"


def test_thread_enrichment(frame):
    tl = frame([(1, None, "review_comment", "a", 5, "old", None, None), (1, None, "review_comment", "a", 6, "keep", None, None)], TL)
    threads = frame([(1, "T1", True, [(5, "new"), (6, ""), (7, "added")]), (1, "T0", False, [(7, "early")])], "pr_id int, thread_id string, is_resolved boolean, cs array<struct<id:bigint,body:string>>")
    empty = "cast(map('+1', 2) as map<string,int>)"
    comments = threads.select("pr_id", "thread_id", "is_resolved", F.expr("transform(cs, c -> named_struct('id', c.id, 'body', c.body, 'path', 'p', 'original_line', 0, 'line', 3, 'author', 'z', 'reactions', " + empty + "))").alias("comments"))
    got = {r.comment_id: (r.body, r.is_resolved) for r in timeline.enrich_with_threads(tl, timeline.thread_comments(comments)).collect()}
    assert got == {5: ("new", True), 6: ("keep", True), 7: ("added", True)}
    assert {len(r.reactions) for r in timeline.enrich_with_threads(tl, timeline.thread_comments(comments)).collect()} == {1}


def test_stats_roles_and_order(frame):
    t = datetime(2026, 1, 1)
    tl = frame([(1, t, "commit", "x", None, None, None, None), (1, None, "review_comment", "Bot", 5, "b", True, None), (1, t, "issue_comment", "bot", 6, "b", None, None), (1, t, "pr_opened", "x", None, None, None, None)], TL).withColumn("order_index", F.lit(0)).withColumn("source_seq", F.lit(0))
    prs, threads = frame([(1, "bot", "bot")], "pr_id int, target string, pr_author string"), frame([], "pr_id int, thread_id string, is_resolved boolean")
    loose, exact = (timeline.target_stats(prs, tl, threads, exact=e).first() for e in (False, True))
    assert (loose.n_events, loose.n_commits, loose.n_target_review_comments, loose.n_target_comments) == (4, 1, 1, 2) and (exact.n_target_review_comments, exact.n_target_comments) == (0, 1)
    assert timeline.target_roles(prs, tl).first().roles == ["author", "commenter", "reviewer"] and timeline.target_roles(prs, tl, exact=True).first().roles == ["author", "commenter"]
    assert tuple(timeline.summary(tl).first())[1:3] == (4, "review_comment")
    assert timeline.ordered(tl).first().events[0].comment_id == 5  # a missing time comes first
    seen = frame([(1, t, "review", "a", None, None, None, 9)], TL)
    reviews = frame([(1, 9, "s"), (1, 10, "s"), (1, 11, None)], "pr_id int, review_id long, submitted_at string")
    assert [r.review_id for r in timeline.unseen_reviews(reviews, seen).collect()] == [10]


def test_kinds_lines_and_diff(frame):
    rows = [("PullRequestEvent", "closed", True), ("PullRequestEvent", "closed", None), ("PullRequestEvent", "labeled", None), ("IssueCommentEvent", None, None), ("PushEvent", None, None)]
    got = frame(rows, "k string, a string, m boolean").select(timeline.event_kind(F.col("k"), F.col("a"), F.col("m")).alias("x")).collect()
    assert [r.x for r in got] == ["pr_merged", "pr_closed", "pr_labeled", "issue_comment", None]
    lines = frame([(0, 4), (7, 4), (None, None)], "o int, l int").select(timeline.comment_line(F.col("o"), F.col("l")).alias("x")).collect()
    assert [r.x for r in lines] == [4, 7, None]
    d = frame([([("s", [("f", "m", 3, None), ("g", "m", 1, 2)]), ("t", None)],), ([],)], "d array<struct<sha:string,files:array<struct<filename:string,status:string,additions:bigint,deletions:bigint>>>>")
    assert [r.x for r in d.select(timeline.diff_lines(F.col("d")).alias("x")).collect()] == [6, 0]


def test_reviewed_commit_priorities_and_split(frame):
    t = lambda n: datetime(2026, 1, n)
    commits = frame([(p, i, f"{p}sha{i}", t(2 + 2 * i)) for p in (1, 2, 3, 4) for i in range(3)] + [(5, 0, "", t(2)), (5, 1, "5x", t(3))], "pr_id int, idx int, sha string, at timestamp_ntz")
    reviews = frame([(1, "BOT", "", t(1)), (1, "bot", "1sha1", t(3)), (1, "bot", "1sha2", t(4))], "pr_id int, author string, commit_id string, at timestamp_ntz")
    comments = frame([(1, "bot", "1sha0", None, t(1)), (2, "bot", "", "2sh", t(1)), (3, "other", "3sha0", None, t(1))], "pr_id int, author string, original_commit_id string, commit_id string, at timestamp_ntz")
    activity = frame([(3, "Bot", t(5)), (3, "bot", t(9)), (2, "bot", t(9))], "pr_id int, actor string, at timestamp_ntz")
    got = outcomes.reviewed_commit(reviews, comments, commits, activity, "bot")
    assert {r.pr_id: r.sha for r in got.collect()} == {1: "1sha1", 2: "2sh", 3: "3sha1", 4: "4sha2", 5: "5x"}
    split = outcomes.split_commits(commits, got).groupBy("pr_id").agg(F.count_if("is_post").alias("post"))
    assert {r.pr_id: r.post for r in split.collect()} == {1: 1, 2: 2, 3: 1, 4: 0, 5: 0}


def test_outcome_measures_use_distinct_ids_over_list_length(frame):
    row = [(["a", "b", "a"], ["x"], [("a", "x", True), ("a", "x", True), ("z", "q", True), ("b", None, False)]), ([], [], [])]
    df = frame(row, "s array<string>, a array<string>, m array<struct<bot_issue_id:string,human_action_id:string,matched:boolean>>")
    m = outcomes.outcome_measures(F.col("s"), F.col("a"), F.col("m"))
    one, none = df.select(*[c.alias(n) for n, c in m.items()]).collect()
    assert (one.matched_suggestions, one.matched_actions) == (1, 1) and abs(one.precision - 1 / 3) < 1e-9 and one.recall == 1.0
    assert (none.precision, none.recall, none.f_beta) == (None, None, None)


def test_bug_types_and_files(frame):
    df = frame([(["a"], 3), (None, 0)], "g array<string>, n int").select(outcomes.bug_types(F.coalesce("g", F.array().cast("array<string>")), F.col("n")).alias("x")).collect()
    assert [[tuple(t) for t in r.x] for r in df] == [[("a", None), ("other", "not_labeled"), ("other", "not_labeled")], []]
    files = frame([(1, "f", 2, 0, "m"), (1, "f", 1, 3, "a")], "pr_id int, filename string, commit_idx int, file_idx int, status string")
    assert outcomes.first_files(files).first().status == "a"


def test_text_functions(frame):
    urls = ["https://github.com/o/r.git/pull/12", "https://github.com/o/r/issues/12", None]
    parts = text.pr_url_parts(F.col("u"))
    got = frame([(u,) for u in urls], "u string").select(*[c.alias(n) for n, c in parts.items()]).collect()
    assert [tuple(r) for r in got] == [("o", "r", 12), (None, None, None), (None, None, None)]
    names = text.review_repo_parts(F.col("n"))
    got = frame([("cfg__re_po__tool__PR12__20240101",), ("bad",)], "n string").select(*[c.alias(n) for n, c in names.items()]).collect()
    assert tuple(got[0]) == ("cfg", "re_po", "tool", "12", "20240101") and got[1].tool is None
    one = frame([("--Añ B!!c" + "x" * 40,)], "s string").select(text.slug(F.col("s")).alias("x"), text.csv_values(F.lit(" A,,b ")).alias("v"), text.unfenced(F.lit("a ```json\n{}\n``` b")).alias("f"), text.day_of_suffix(F.lit("260201")).alias("d")).first()
    assert len(one.x) == 30 and one.x.startswith("a-b-c") and one.v == ["a", "b"] and one.f == "{}" and one.d == D(1)


def test_labels(frame):
    docs = ['{"language":" Go ","domain":"Full-Stack","pr_type":"BUG","severity":"urgent"}', '{"language":5,"domain":"","severity":"High"}', "[]", "{", None]
    p = labels.parsed_labels(F.col("d"))
    got = frame([(d,) for d in docs], "d string").select(*[c.alias(n) for n, c in p.items()]).collect()
    assert [tuple(r) for r in got] == [("go", "fullstack", "bugfix", None), (None, None, None, "high")] + [(None,) * 4] * 3


def test_summary_of_suggestions(frame):
    s = frame([(1, "b", None), (1, None, "high"), (1, "b", "high")], "pr_id int, category string, severity string")
    m = frame([(1, "x", True), (1, "x", True), (1, "y", False), (2, "z", True)], "pr_id int, bot_issue_id string, matched boolean")
    r = outcomes.suggestion_summary(s, m).first()
    assert r.summary == "Total suggestions: 3, matched: 1\nCategories: b(2), other(1)\nSeverities: high(2), medium(1)"


def test_texts(frame):
    one = [("f.py", "added", 3, None, "@@ x"), ("g", None, None, 1, "")]
    commits = frame([(1, 1, "s" * 40, "msg", None, "d1"), (1, 0, "", None, "al", None)], "pr_id int, idx int, sha string, message string, author string, date string")
    details = frame([(1, 0, "s" * 40, []), (1, 1, "s" * 40, one), (1, 0, "", one)], "pr_id int, seq int, sha string, files array<struct<filename:string,status:string,additions:bigint,deletions:bigint,patch:string>>")
    text = outcomes.commits_text(outcomes.with_details(commits, details)).first().text
    assert text == "COMMIT  by al []\n  Message: \n\nCOMMIT ssssssssssss by unknown [d1]\n  Message: msg\n  ADDED f.py (+3/-0)\n  ```diff\n@@ x\n  ```\n   g (+0/-1)\n"
    files = frame([(1, 1, 0, "b", "m", 1, 2), (1, 0, 1, "a", None, None, 2), (1, 2, 0, "b", "x", 9, 9), (1, 0, 0, "", "m", 1, 1)], "pr_id int, commit_idx int, file_idx int, filename string, status string, additions int, deletions int")
    assert outcomes.file_list(files).first().text == "a (, +0/-2)\nb (m, +1/-2)"
    rows = frame([("review", "t", "ok", "b", None, None, None, None, "me"), ("review_comment", "t", None, None, "p", 4, "h", True, None), ("commit", "t", None, "b", None, None, None, None, "x"), ("pr_merged", "t", None, None, None, None, None, None, "x")], "k string, at string, s string, b string, p string, l int, h string, r boolean, a string")
    c = {n: F.col(n) for n in "k at s b p l h r a".split()}
    got = [r.x for r in rows.select(outcomes.comment_text(*[c[n] for n in "k at s b p l h r".split()]).alias("x")).collect()]
    assert got == ["[t] REVIEW (ok):\n  b\n", "[t] REVIEW_COMMENT (p:4) [RESOLVED]:\n  Code context:\n  ```\nh\n  ```\n", None, None]
    got = [r.x for r in rows.select(outcomes.activity_text(*[c[n] for n in "k at a s b p l r".split()]).alias("x")).collect()]
    assert got == ["[t] REVIEW by me: ok\n  b\n", "[t] REVIEW_COMMENT by unknown (p:4) [RESOLVED]:\n", None, "[t] PR_MERGED by x\n"]
    s = frame([("i", "bug", "high", "d", "p", 0), ("i", "bug", "high", "d", "", 5)], "i string, c string, s string, d string, p string, l int").select(outcomes.suggestion_text(*[F.col(x) for x in "icsdpl"]).alias("x")).collect()
    assert [r.x for r in s] == ["- [i] (bug/high) (p): d", "- [i] (bug/high): d"]


def test_column_updates_locks_and_resume(frame):
    rows = frame([(1, "a", 5), (2, "b", None)], "id int, s string, n int")
    got = lifecycle.update_columns(rows, frame([(2, None, 7), (3, "c", 8)], "id int, s string, n int"), ["id"], ["s", "n"])
    assert sorted(map(tuple, got.collect())) == [(1, "a", 5), (2, None, 7)]
    now = datetime(2026, 1, 1, 12)
    queue = frame([(1, "x", None), (2, "x", datetime(2026, 1, 1, 11, 45)), (3, "x", datetime(2026, 1, 1, 11))], "id int, status string, locked_at timestamp_ntz")
    taken = lifecycle.take_lock(queue, "w", F.lit(now).cast("timestamp_ntz"), 5, F.asc("id")).collect()
    assert [(r.id, r.locked_by, r.status) for r in taken] == [(1, "w", "enriching"), (3, "w", "enriching")]
    state = frame([(1, 0), (2, 3), (3, None)], "id int, errors_count int")
    assert sorted(r.id for r in lifecycle.resume(frame([(1,), (2,), (3,), (4,)], "id int"), state, ["id"]).collect()) == [2, 4]
    steps = frame([(None,), ("reviews",), ("done",), ("odd",)], "s string").select(lifecycle.remaining_steps(F.col("s")).alias("x")).collect()
    assert [len(r.x) for r in steps] == [6, 3, 0, 6]
