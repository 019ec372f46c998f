import json
from datetime import date, datetime

from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import assembly
from tallyspark.sources import tables
from tallyspark.operators.discovery import first_seen_volume
from tallyspark.operators.reports import as_document, write_export
from tallyspark.sources import archive, documents
from tallyspark.streaming import incremental as inc


def test_archive_prunes_days(spark, frame, tmp_path):
    root = str(tmp_path / "a")
    archive.write_archive(frame([(1, date(2026, 1, d)) for d in (1, 2, 3)], "id int, day date"), root)
    archive.write_archive(frame([(9, date(2026, 1, 2))], "id int, day date"), root)
    df = archive.read_archive(spark, root, date(2026, 1, 2), date(2026, 1, 3))
    assert sorted(r.id for r in df.collect()) == [1, 9]
    assert "PartitionFilters: [isnotnull(event_date" in df._jdf.queryExecution().executedPlan().toString()


def test_golden_set_last_file_wins(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"pr_title": "A", "url": "u", "comments": [{"comment": "old", "severity": "Low"}]}, {"url": "", "pr_url": "w", "comments": []}, {"url": None}]))
    (tmp_path / "b.json").write_text(json.dumps([{"pr_title": "B", "url": "u", "comments": [{"comment": "x", "severity": "High"}, {"comment": "y"}]}]))
    g = documents.read_golden(spark, str(tmp_path))
    assert {r.url: r.pr_title for r in g.collect()} == {"u": "B", "w": None}
    assert [(r.golden_idx, r.golden, r.severity) for r in documents.golden_rows(g).orderBy("golden_idx").collect()] == [(0, "x", "High"), (1, "y", None)]


def test_maps_and_models(spark, tmp_path):
    cand = {"u": {"t": [{"text": "c"}], "empty": []}}
    (tmp_path / "c.json").write_text(json.dumps(cand))
    assert [(r.url, r.tool, r.candidate) for r in documents.candidate_rows(spark, str(tmp_path / "c.json")).collect()] == [("u", "t", "c")]
    assert {r.tool: r.texts for r in documents.candidate_keys(spark, str(tmp_path / "c.json")).collect()} == {"t": ["c"], "empty": []}
    for m in ("m2", "m1"):
        (tmp_path / "models" / m).mkdir(parents=True)
        (tmp_path / "models" / m / "evaluations.json").write_text(json.dumps({"u": {"t": {"tp": 1, "skipped": False}}}))
    assert [r.model for r in documents.model_names(spark, str(tmp_path / "models")).collect()] == ["m1", "m2"]
    assert documents.read_models(spark, str(tmp_path / "models"), ["m1", "m2"]).where("tp = 1").count() == 2
    bench = {"u": {"source_repo": "s", "reviews": [{"tool": "t", "review_comments": [{"body": "b1"}, {"body": "b2"}]}]}}
    (tmp_path / "b.json").write_text(json.dumps(bench))
    assert documents.review_rows(spark, str(tmp_path / "b.json")).first().bodies == ["b1", "b2"]


def test_tree_config_and_tables(spark, frame, tmp_path):
    leaf = tmp_path / "user" / "own" / "repo" / "12"
    leaf.mkdir(parents=True)
    (leaf / "commits.json").write_text("[1]")
    r = documents.read_tree(spark, str(tmp_path / "user")).first()
    assert (r.user, r.owner, r.repo, r.number, r.stage, r.raw) == ("user", "own", "repo", 12, "commits", "[1]")
    (tmp_path / "tokens").write_text("a\n# no\n\nb\n")
    assert documents.token_list(str(tmp_path / "tokens")) == ["a", "b"] == documents.token_list(" a, b,")
    assert documents.seed_bots(spark, ["x", "x ", ""]).count() == 1
    assert documents.table_or_empty(spark, "no_such_table", "a string").count() == 0


def test_paged_source(spark, tmp_path):
    for n, nxt in ((3, 1), (1, 2), (2, None)):
        (tmp_path / f"page-{n}.json").write_text(json.dumps({"items": [{"id": n, "b": None}], "next": nxt}))
    spark.dataSource.register(archive.PagedFixture)
    df = spark.read.format("paged").schema("id int, b string").load(str(tmp_path))
    assert [r.id for r in df.collect()] == [3, 1, 2]


def test_exports(spark, frame, tmp_path):
    df = frame([(1, "a")], "i int, s string")
    write_export(df, str(tmp_path / "j"))
    write_export(df, str(tmp_path / "c"), "csv")
    assert spark.read.json(str(tmp_path / "j")).first().s == "a" and spark.read.option("header", "true").csv(str(tmp_path / "c")).first().s == "a"
    assert json.loads(as_document(df).first().document) == {"i": 1, "s": "a"}


def test_stream_equals_batch(spark, frame, tmp_path):
    rows = [("a", "k1", datetime(2026, 1, 3), 1), ("a", "k1", datetime(2026, 1, 1), 2), ("a", "k2", datetime(2026, 1, 3), 3), ("b", "k1", datetime(2026, 1, 2), 4)]
    for i, r in enumerate(rows):
        frame([r], "bot string, pr_key string, ts timestamp_ntz, id int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    like = spark.read.parquet(str(tmp_path / "in"))
    stream = lambda: inc.event_stream(spark, str(tmp_path / "in"), like, 1)
    got = inc.first_seen_volumes(inc.first_seen(stream(), str(tmp_path / "c1")))
    batch = first_seen_volume(like.select("bot", F.col("pr_key").alias("repo"), F.lit(1).alias("number"), F.to_date("ts").alias("day")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    days = inc.settled(inc.daily_counts(stream(), "bot"), ["day", "bot"], str(tmp_path / "c2"))
    assert sum(r.n for r in days.collect()) == 4
    seen = []
    inc.upsert_stream(inc.once_per_key(stream(), "bot", "pr_key"), lambda b, _: seen.extend(b.collect()), str(tmp_path / "c3")).awaitTermination()
    assert sorted((r.bot, r.pr_key) for r in seen) == [("a", "k1"), ("a", "k2"), ("b", "k1")]


def test_versions_and_tables(spark, frame, tmp_path):
    tables.write_version(frame([(1,)], "a int"), str(tmp_path), "t")
    tables.write_version(frame([(2,), (3,)], "a int"), str(tmp_path), "t")
    assert sorted(r.a for r in tables.read_version(spark, str(tmp_path), "t").collect()) == [2, 3]
    name = "db_" + tmp_path.name.replace("-", "_")
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path / 'db'}'")
    spark.sql(f"CREATE TABLE {name}.chatbots (id bigint) USING parquet")
    tables.create_tables(spark, name)
    assert spark.table(f"{name}.chatbots").columns == ["id", "github_username", "display_name", "created_at"] and spark.table(f"{name}.prs").count() == 0
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_documents_of_the_code_host(frame):
    docs = [('{"sha": "a", "commit": {"message": "m", "author": {"date": "d"}}, "author": {"login": "x"}}',), ('{"sha": "b", "author": null}',), ("{",), (None,)]
    assert [tuple(r) for r in assembly.commit_rows(frame(docs, "doc string")).collect()] == [("a", "m", "d", "x"), ("b", "", "", None)]
    reviews = assembly.review_rows(frame([('{"id": 5, "user": {"login": "x"}, "body": null, "commit_id": "c"}',)], "doc string")).first()
    assert (reviews.id, reviews.author, reviews.state, reviews.body, reviews.commit_id, reviews.submitted_at) == (5, "x", "", "", "c", None)
    d = assembly.detail_rows(frame([('{"sha": "a", "files": [{"filename": "f", "additions": 2}]}',), ('{"sha": "b"}',)], "doc string")).collect()
    assert [tuple(f) for f in d[0].files] == [("f", "unknown", 2, 0, "")] and d[1].files == []
    assert tuple(assembly.summary_rows(frame([('{"additions": 3}',)], "doc string")).first()) == (3, 0, 0, 0)
    thread = {"id": "T", "isResolved": True, "resolvedBy": None, "comments": {"nodes": [{"databaseId": 1, "body": "b", "originalLine": 4, "reactionGroups": [{"content": "EYES", "reactors": {"totalCount": 2}}]}]}}
    t = assembly.thread_rows(frame([(json.dumps(thread),), ('{"id": "U"}',)], "doc string")).collect()
    assert (t[0].id, t[0].is_resolved, t[0].comments[0].id, t[0].comments[0].original_line, t[0].comments[0].reactions) == ("T", True, 1, 4, {"EYES": 2}) and t[1].comments == []


def test_comments_of_three_endpoints_and_addresses(frame):
    inline = frame([("k", "p", None, 7, "", "t1")], "key string, path string, line int, original_line int, body string, created_at string")
    reviews = frame([("k", "", "t"), ("k", None, "t"), ("k", "r", "t2")], "key string, body string, submitted_at string")
    got = assembly.review_comments(inline, reviews, frame([("k", None, "t3")], "key string, body string, created_at string")).orderBy("endpoint").collect()
    assert [(r.endpoint, r.path, r.line, r.body, r.created_at) for r in got] == [(0, "p", 7, "", "t1"), (1, None, None, "r", "t2"), (2, None, None, None, "t3")]
    golden = frame([("https://github.com/b/r/pull/10",), ("https://github.com/a/r/pull/1",), ("https://github.com/b/r/pull/1/files",), ("junk",)], "url string")
    got = assembly.golden_url(frame([("r", 1), ("r", 10), ("r", 2)], "repo string, number long"), golden).collect()
    assert {r.number: r.url for r in got} == {1: "https://github.com/a/r/pull/1", 10: "https://github.com/b/r/pull/10", 2: None}


def test_records_are_saved_as_documents(frame):
    prs = frame([(1, "u", "r", 3, True), (2, "u", "r", 4, False)], "pr_id int, pr_url string, repo_name string, pr_number int, has_events boolean")
    one = lambda name: frame([(1, "x")], f"pr_id int, {name} string")
    record = assembly.assembled(prs, one("pr_title"), one("events"), one("review_threads"), one("n_events"), one("roles"))
    (r,) = assembly.as_records(record).collect()
    assert r.pr_id == 1 and json.loads(r.assembled) == {"pr_url": "u", "repo_name": "r", "pr_number": 3, "pr_title": "x", "roles": "x", "events": "x", "review_threads": "x", "stats": {"n_events": "x"}}


def test_windows_and_pauses():
    now = datetime(2026, 1, 8)
    assert (text.since_day("7d", now), text.since_day("2026-02-05", now), text.since_day("", now)) == ("2026-01-01T00:00:00", "2026-02-05", None)
    assert [text.backoff_seconds(k) for k in range(4)] == [1, 2, 4, 8]
