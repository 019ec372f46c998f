"""Queries of discovery, lifecycle, timelines and outcomes."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import functions as F

from tallyspark.functions import scorers
from tallyspark.functions.jsonx import parse_strict, unwrap
from tallyspark.operators import assembly as asm
from tallyspark.operators import discovery as disc
from tallyspark.operators import lifecycle as life
from tallyspark.operators import outcomes as out
from tallyspark.operators import timeline as tline
from tallyspark.operators.flatten import file_table, with_events
from tallyspark.plans import views as v
from tallyspark.plans.core_problems import P2_EVENTS, P2_FILES
from tallyspark.session import cut_lineage, ensure_checkpoint_dir
from tallyspark.sources.archive import read_archive, write_archive
from tallyspark.sources.tables import table

FIRST, LAST = date(2024, 1, 3), date(2024, 1, 25)
CUT = "2025-07-01 00:00:00"  # what was delivered before is known, the rest is new


def _targets(spark, d):
    return disc.targets(v.raw_events(spark, d), [1, 2, 3, 4, 5, 6, 7], FIRST, LAST, 5)


def discover_sample(spark, d):
    return disc.sample_targets(_targets(spark, d), 3, seed=None).select("bot", "repo", "number", "first_day")


def discover_events(spark, d):
    return disc.target_events(v.raw_events(spark, d), disc.sample_targets(_targets(spark, d), 3, seed=None)).select("event_id", "repo", "number")


def event_list_summary(spark, d):
    return disc.event_summary(v.raw_events(spark, d).where("number is not null"))


def pr_metadata_first_non_null(spark, d):
    rows = v.raw_events(spark, d).where("number is not null").select(
        "repo", "number", "ts", "event_id", F.when(F.col("value") > 50, F.concat(F.lit("t"), F.col("event_id").cast("string"))).when(F.col("value") > 40, "").alias("title"), F.when(F.col("event_type") == "click", F.col("bot")).alias("author")
    )
    keyed = rows.withColumn("k", F.concat("repo", F.lit("#"), F.col("number").cast("string")))
    return disc.first_non_null(keyed, "k", ["ts", "event_id"], ["title", "author"])


def reviewed_at_first(spark, d):
    ev = v.raw_events(spark, d).where("number is not null").withColumn("bot", F.lit("bot3"))
    return disc.reviewed_at(ev).select("repo", "number", F.date_format("reviewed_at", "yyyy-MM-dd HH:mm:ss").alias("reviewed_at"))


def _queue_cols():
    return ["id", "chatbot_id", "repo_name", "pr_number"]


def queue_unanalysed_topk(spark, d):
    a = table(spark, d, "llm_analyses").select(F.col("pr_id").alias("id"), "chatbot_id")
    return life.queue(life.without(v.prs(spark, d), a, ["id", "chatbot_id"]), 50, F.asc_nulls_last("discovered_at"), F.asc("id")).select(*_queue_cols())


def queue_unlabelled_topk(spark, d):
    a = table(spark, d, "llm_analyses").select(F.col("pr_id").alias("id")).distinct()
    done = table(spark, d, "review_threads").select(F.col("pr_id").alias("id")).distinct()
    return life.queue(life.without(v.prs(spark, d).join(a, "id", "left_semi"), done, ["id"]), 40, F.desc_nulls_last("analyzed_at"), F.asc("id")).select(*_queue_cols())


def pending_distinct_from(spark, d):
    return v.prs(spark, d).where(~F.col("enrichment_step").eqNullSafe("done")).select("id", "status", "enrichment_step")


def insert_ignore(spark, d):
    """Deliveries up to a day are known; every pull request delivered later that is not among them is new."""
    p = table(spark, d, "prs").select("id", "chatbot_id", "discovered_at", "status")
    return life.insert_ignore(p.where(F.col("discovered_at") < F.lit(CUT).cast("timestamp_ntz")), p, ["id"], ["discovered_at"]).select("id", "chatbot_id", "status")


def upsert_latest(spark, d):
    rows = table(spark, d, "llm_analyses").select("id", "pr_id", "chatbot_id", "total_bot_comments", "analyzed_at")
    old = rows.groupBy("id").agg(F.min_by(F.struct("pr_id", "chatbot_id", "total_bot_comments", "analyzed_at"), "analyzed_at").alias("r")).select("id", "r.*")
    return life.upsert(old, rows, ["id"], ["analyzed_at"]).select("id", "pr_id", F.date_format("analyzed_at", "yyyy-MM-dd HH:mm:ss").alias("analyzed_at"))


def lockable(spark, d):
    now = F.lit("2025-06-01 00:00:00").cast("timestamp_ntz")
    p = v.prs(spark, d).select("id", "status", F.when(F.col("id") % 3 != 0, F.col("discovered_at")).alias("locked_at"))
    return p.where(life.lockable(F.col("locked_at"), now)).select("id", "status")


def locks_taken(spark, d):
    now = F.lit("2025-06-01 00:00:00").cast("timestamp_ntz")
    p = v.prs(spark, d).select("id", "status", "discovered_at", F.when(F.col("id") % 3 != 0, F.col("discovered_at")).alias("locked_at"))
    return life.take_lock(p, "worker-1", now, 60, F.asc("discovered_at"), F.asc("id")).select("id", "locked_by", "status")


def delete_cascade(spark, d):
    doomed = v.prs(spark, d).where("status = 'error' or id % 7 = 0")
    kept = life.delete_cascade({"prs": (v.prs(spark, d), "id"), "analyses": (table(spark, d, "llm_analyses"), "pr_id"), "threads": (table(spark, d, "review_threads"), "pr_id")}, doomed, "id")
    parts = [t.groupBy(F.lit(n).alias("table_name"), F.col("id" if n == "prs" else "pr_id").alias("pr_id")).agg(F.count(F.lit(1)).alias("n")) for n, t in kept.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def size_gate(spark, d):
    commits = v.timeline(spark, d).where("event_type = 'commit'").groupBy(F.col("pr_id").alias("id")).agg(F.count(F.lit(1)).alias("commits"))
    p = v.prs(spark, d).join(commits, "id", "left")
    gate = life.size_gate(F.col("commits"), F.col("diff_lines"), max_commits=3, max_lines=1000)
    return p.select("id", gate["status"].alias("gate"), gate["reason"].alias("reason"))


def status_infer(spark, d):
    p = v.prs(spark, d).select("id", "analyzed_at", "diff_lines", "enrichment_step", "error_message")
    has = {"analysis": F.col("analyzed_at").isNotNull(), "details": F.col("diff_lines") > 500, "commits": F.col("enrichment_step").isNotNull(), "events": F.col("error_message").isNotNull()}
    return p.select("id", life.inferred_status(has).alias("inferred"), F.coalesce(life.inferred_step(has), F.lit("")).alias("step"), life.step_index(F.col("enrichment_step")).alias("step_no"), F.array_join(life.remaining_steps(F.col("enrichment_step")), ",").alias("to_do"))


def status_current(spark, d):
    return life.status_log(table(spark, d, "prs").select("id", F.col("discovered_at").alias("at"), "status"), "id").select("id", "status")


def backfill_diff_lines(spark, d):
    return life.backfill_diff_lines(v.prs(spark, d), F.col("pr_number") % 100).select("id", "diff_lines")


def missing_sizes(spark, d):
    return life.missing_sizes(v.prs(spark, d).select("diff_lines", F.col("enrichment_step").isin("details", "done").alias("has_details")))


def column_updates(spark, d):
    """The last analysis of a pull request writes its time and comment count into the row of the pull request."""
    a = table(spark, d, "llm_analyses").groupBy(F.col("pr_id").alias("id")).agg(F.max("analyzed_at").alias("analyzed_at"), F.max_by("total_bot_comments", F.struct("analyzed_at", "id", "total_bot_comments")).cast("bigint").alias("diff_lines"))
    return life.update_columns(v.prs(spark, d), a, ["id"], ["analyzed_at", "diff_lines"]).select("id", "diff_lines", F.date_format("analyzed_at", "yyyy-MM-dd HH:mm:ss").alias("analyzed_at"))


def point_lookup(spark, d):
    return life.by_key(v.prs(spark, d), chatbot_id=1, pr_number=1).select("id", "repo_name", "status")


def pending_since(spark, d):
    p = v.prs(spark, d).withColumn("reviewed_at", F.col("discovered_at"))
    return life.pending(p, ["enriched", "assembled", "pending"], datetime(2025, 3, 1), 80).select("id", "status")


def resume_after_errors(spark, d):
    """Pull requests not analysed yet, or analysed with comments left over (counted as errors here)."""
    state = v.analyses(spark, d).select(F.col("pr_id").alias("id"), (F.col("total_bot_comments") - F.col("matched_bot_comments") - 2).alias("left")).withColumn("errors_count", F.greatest(F.lit(0), "left"))
    return life.resume(v.prs(spark, d).select("id", "status"), state, ["id"])


def discovery_summary(spark, d):
    p = table(spark, d, "prs").select(F.col("repo_name").alias("repo"), F.col("pr_number").alias("number"), "discovered_at").where("number is not null")
    known = p.where(F.col("discovered_at") < F.lit(CUT).cast("timestamp_ntz")).select("repo", "number").distinct()
    return disc.discovery_summary(p.select("repo", "number").distinct(), known)


def archive_scan(spark, d):
    """Events written by day and read back for a range of days; the days outside are never opened."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/archive-{uuid.uuid4().hex}"
    write_archive(v.raw_events(spark, d).select("event_id", "bot", "repo", "number", "day"), root)
    return read_archive(spark, root, FIRST, LAST).select("event_id", "bot", "repo", "number", F.col("event_date").alias("day"))


def archive_event_numbers(spark, d):
    """Number and address of the pull request of every archived event of a repository, and whether it concerns one."""
    evs = with_events(table(spark, d, "prs")).select("pr_id", F.inline("evs")).where("event_id is not null")
    kind, payload = F.try_variant_get("body", "$.type", "string"), F.to_json("payload")
    number, repo = disc.pr_number(kind, payload), F.try_variant_get("body", "$.repo_name", "string")
    rows = evs.select("pr_id", "event_id", kind.alias("type"), number.alias("number"), disc.pr_url(payload, repo, number).alias("url"), F.coalesce(disc.on_pull_request(kind, payload), F.lit(False)).alias("on_pr"))
    return rows.distinct()


def incremental_merge(spark, d):
    """Pull requests known before a day, and those delivered from then on, which replace them."""
    p = table(spark, d, "prs").select("id", "status", "discovered_at")
    early = F.col("discovered_at") < F.lit(CUT).cast("timestamp_ntz")
    old, new = (life.latest(p.where(c), ["id"], ["discovered_at"]).select("id", "status", F.lit(n).alias("side")) for c, n in ((early, "old"), (~early, "new")))
    return life.incremental_merge(old, new, ["id"], force=True)


def _timeline(spark, d):
    """One row per timeline event: the fields of its complete JSON, in whatever form it is stored, then its first delivery.

    Fields are read before deliveries are merged, so the documents themselves are never shuffled.
    """
    rows = table(spark, d, "timeline_events").select("event_id", F.col("ingested_at").alias("ts"), "pr_id", "event_type", "actor", unwrap(parse_strict(F.col("data"))).alias("doc"))
    part = lambda name, kind: F.try_variant_get("doc", f"$.{name}", kind).alias(name)
    fields = [part("comment_id", "bigint"), part("review_id", "bigint"), part("order_index", "int"), part("line", "int"), *[part(n, "string") for n in ("sha", "state", "message", "body", "path")]]
    once = rows.select("event_id", F.struct("ts", "pr_id", "event_type", "actor", *fields).alias("r")).groupBy("event_id").agg(F.min("r").alias("r"))
    return once.select("event_id", "r.*", F.lit(None).cast("boolean").alias("is_resolved"), F.lit(0).alias("source_seq"))


def _bots(spark, d):
    """Pull requests with their own bot: ``pr_id, target, pr_author``; there are 30 bots."""
    bots = table(spark, d, "chatbots").select(F.col("id").alias("chatbot_id"), F.col("github_username").alias("target"))
    return v.prs(spark, d).select(F.col("id").alias("pr_id"), "chatbot_id", "pr_author").join(F.broadcast(bots), "chatbot_id", "left").drop("chatbot_id")


def _enriched(spark, d):
    return tline.enrich_with_threads(_timeline(spark, d), tline.thread_comments(table(spark, d, "review_threads")))


def timeline_stats(spark, d):
    return tline.target_stats(_bots(spark, d), _enriched(spark, d), table(spark, d, "review_threads"), exact=True)


def timeline_roles(spark, d):
    return tline.target_roles(_bots(spark, d), _enriched(spark, d), exact=True).select("pr_id", F.array_join("roles", ",").alias("roles"))


def timeline_stats_by_bot(spark, d):
    return tline.target_stats(_bots(spark, d), _enriched(spark, d), table(spark, d, "review_threads"))


def timeline_roles_by_bot(spark, d):
    return tline.target_roles(_bots(spark, d), _enriched(spark, d)).select("pr_id", F.array_join("roles", ",").alias("roles"))


def thread_enrich(spark, d):
    rows = _enriched(spark, d).where("event_type = 'review_comment'")
    return rows.select("pr_id", "comment_id", "thread_id", F.coalesce("is_resolved", F.lit(False)).alias("is_resolved"), "body", F.coalesce(F.size("reactions"), F.lit(0)).alias("n_reactions"))


def thread_summaries(spark, d):
    return asm.thread_summaries(table(spark, d, "review_threads"))


def thread_comment_lines(spark, d):
    return tline.thread_comments(table(spark, d, "review_threads")).select("pr_id", "comment_id", "thread_id", "path", "line", "author")


def timeline_union_sorted(spark, d):
    both = tline.combine(_timeline(spark, d).drop("source_seq", "event_id"), tline.thread_comments(table(spark, d, "review_threads")).select("pr_id", "comment_id", "body", F.col("author").alias("actor"), F.lit("review_comment").alias("event_type")))
    return tline.summary(both).withColumn("last_at", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss"))


def review_dedupe(spark, d):
    """The timeline as it stood on a day; reviews that came later, or whose state is not set, are not on it."""
    t = _timeline(spark, d)
    reviews = t.where("event_type = 'review'").select("pr_id", "review_id", F.when(F.col("state") != "", F.col("ts")).alias("submitted_at"), "actor")
    return tline.unseen_reviews(reviews, t.where(F.col("ts") < F.lit(CUT).cast("timestamp_ntz"))).select("pr_id", "review_id")


def event_kinds(spark, d):
    e = v.raw_events(spark, d)
    kind = F.when(F.col("bot") % 3 == 0, "PullRequestEvent").when(F.col("bot") % 3 == 1, "PullRequestReviewEvent").otherwise("IssueCommentEvent")
    action = F.when(F.col("number") % 4 == 0, "opened").when(F.col("number") % 4 == 1, "closed").otherwise("labeled")
    return e.select("event_id", tline.event_kind(kind, action, F.col("number") % 3 == 0).alias("kind"))


def diff_lines_nested(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("a"), F.col("l_suppkey").alias("s"))
    one = F.struct(F.concat(F.lit("f"), F.col("s").cast("string")).alias("filename"), F.lit("modified").alias("status"), F.col("a").alias("additions"), F.when(F.col("s") % 2 == 0, F.col("s")).alias("deletions"))
    commits = li.groupBy("l_orderkey", "l_linenumber").agg(F.collect_list(one).alias("files"))
    prs = commits.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.lit("x").alias("sha"), F.when(F.col("l_linenumber") != 2, F.col("files")).alias("files"))).alias("details"))
    return prs.select("l_orderkey", tline.diff_lines(F.col("details")).alias("diff_lines"))


def _commits_of(t):
    t = t.where("event_type = 'commit' and sha is not null").select("pr_id", F.coalesce("order_index", F.lit(0)).alias("order_index"), "sha", F.col("ts").alias("at"))
    return t.groupBy("pr_id", "sha").agg(F.min(F.struct("order_index", "at")).alias("r")).select("pr_id", "sha", F.col("r.order_index").alias("idx"), F.col("r.at").alias("at"))


def _review_inputs(spark, d, key):
    """Events once, their commits, and what each pull request's own bot did; ``key`` is the form in which names agree."""
    events = cut_lineage(_timeline(spark, d).select("pr_id", "ts", "event_type", "actor", "review_id", "comment_id", "order_index", "sha"))
    bots = _bots(spark, d).select("pr_id", key("target").alias("bot"))
    acts = events.where("event_type in ('review', 'review_comment', 'issue_comment')").join(bots, "pr_id").withColumns({"actor": key("actor"), "author": key("actor"), "at": F.col("ts")})
    return events, _commits_of(events), acts


def _reviewed(spark, d):
    """Reviews and comments name commits by a rule, as the tables name none: a review with an odd id the first commit,
    a comment whose id leaves 1, 2 or 3 when divided by 4 the original, the original's short and the current one."""
    _, commits, acts = _review_inputs(spark, d, lambda c: F.lower(F.col(c)))
    first = commits.groupBy("pr_id").agg(F.min_by("sha", F.struct("idx", "sha")).alias("first_sha"), F.max_by("sha", F.struct("idx", "sha")).alias("last_sha"))
    named = acts.drop("sha").join(first, "pr_id", "left")
    reviews = named.where("event_type = 'review'").withColumn("commit_id", F.when(F.col("review_id") % 4 == 1, F.col("first_sha")))
    four = F.col("comment_id") % 4
    comments = named.where("event_type = 'review_comment'").withColumns({"original_commit_id": F.when(four == 1, F.col("last_sha")).when(four == 2, F.substring("first_sha", 1, 10)).when(four == 3, ""), "commit_id": F.when(four == 3, F.col("first_sha"))})
    return commits, out.reviewed_commit(reviews, comments, commits, acts, F.col("bot"))


def hash_x(spark, d):
    return _reviewed(spark, d)[1]


def pre_post_split(spark, d):
    return out.split_commits(*_reviewed(spark, d))


def _reviewed_by_bot(spark, d):
    """As the tables have it: no review or comment names a commit, so time decides; the bot acts by reviews and comments."""
    _, commits, acts = _review_inputs(spark, d, tline.name_key)
    none = acts.drop("sha").withColumns({c: F.lit(None).cast("string") for c in ("commit_id", "original_commit_id")})
    return commits, out.reviewed_commit(none.where("event_type = 'review'"), none.where("event_type = 'review_comment'"), commits, acts, F.col("bot"))


def hash_x_by_bot(spark, d):
    return _reviewed_by_bot(spark, d)[1].select("pr_id", F.substring("sha", 1, 10).alias("sha"))


def pre_post_split_by_bot(spark, d):
    return out.split_commits(*_reviewed_by_bot(spark, d)).groupBy("pr_id").agg(F.count_if(~F.col("is_post")).alias("n_pre"), F.count_if("is_post").alias("n_post"))


def outcome_metrics(spark, d):
    """Comments of a thread as suggestions, replies as actions, reply links as matches."""
    c = v.comments(spark, d)
    rows = c.groupBy("thread_id").agg(
        F.collect_list(F.when(F.col("in_reply_to_id").isNull(), F.col("comment_id").cast("string"))).alias("s"), F.collect_list(F.when(F.col("in_reply_to_id").isNotNull(), F.col("comment_id").cast("string"))).alias("a"),
        F.collect_list(F.struct(F.col("in_reply_to_id").cast("string").alias("bot_issue_id"), F.col("comment_id").cast("string").alias("human_action_id"), (F.length("body") > 60).alias("matched"))).alias("m"),
    )
    m = out.outcome_measures(F.col("s"), F.col("a"), F.col("m"))
    return rows.select("thread_id", *[(F.round(c, 6) if n in ("precision", "recall", "f_beta") else c.cast("bigint")).alias(n) for n, c in m.items()])


def suggestion_summary(spark, d):
    """Comments as suggestions, categorised by the kind of file; one that was answered is matched."""
    c = v.comments(spark, d)
    s = c.select("pr_id", F.nullif(F.regexp_extract("path", r"\.([a-z]+)$", 1), F.lit("")).alias("category"), F.when(F.length("body") > 100, "high").when(F.length("body") > 60, "low").alias("severity"))
    return out.suggestion_summary(s, c.select("pr_id", F.col("in_reply_to_id").cast("string").alias("bot_issue_id"), F.col("in_reply_to_id").isNotNull().alias("matched")))


def file_list_distinct(spark, d):
    c = v.comments(spark, d).where("path is not null").select("pr_id", F.col("path").alias("filename"), F.col("comment_id").alias("commit_idx"), F.lit(0).alias("file_idx"), "author")
    return out.first_files(c.withColumn("status", F.coalesce("author", F.lit("")))).select("pr_id", "filename", "commit_idx")


def _files(spark, d):
    """Files of commit events: ``pr_id, sha, event_id, file_ix, filename, status, additions, deletions``."""
    shas = _timeline(spark, d).where("event_type = 'commit' and sha is not null").select("event_id", "sha", "order_index", "ts")
    return file_table(table(spark, d, "timeline_events")).join(shas, "event_id").withColumnRenamed("file_name", "filename")


def commits_text(spark, d):
    t = _timeline(spark, d).where("event_type = 'commit' and sha is not null")
    commits = t.groupBy("pr_id", "sha").agg(F.min(F.struct(F.coalesce("order_index", F.lit(0)).alias("idx"), "ts", "event_id", "message", "actor")).alias("r"))
    commits = commits.select("pr_id", "sha", F.struct("r.idx", "sha").alias("idx"), "r.message", F.col("r.actor").alias("author"), F.date_format("r.ts", "yyyy-MM-dd").alias("date"))
    one = F.struct("file_ix", "filename", "status", "additions", "deletions", F.lit(None).cast("string").alias("patch"))
    files = _files(spark, d).groupBy("pr_id", "sha", "event_id").agg(F.sort_array(F.collect_list(one)).alias("files"))
    return out.commits_text(out.with_details(commits, files.select("pr_id", F.col("event_id").alias("seq"), "sha", "files")))


def file_list_text(spark, d):
    return out.file_list(_files(spark, d).select("pr_id", F.struct(F.coalesce("order_index", F.lit(0)).alias("o"), "event_id").alias("commit_idx"), F.col("file_ix").alias("file_idx"), "filename", "status", "additions", "deletions"))


def _acts(spark, d):
    t = _timeline(spark, d).where("actor is not null").join(_bots(spark, d).select("pr_id", F.lower("target").alias("bot")), "pr_id")
    return t.withColumns({"own": F.lower("actor") == F.col("bot"), "at": F.date_format("ts", "yyyy-MM-dd HH:mm:ss")})


def bot_comments_text(spark, d):
    none, no = F.lit(None).cast("string"), F.lit(False)
    line = out.comment_text(F.col("event_type"), F.col("at"), F.col("state"), F.col("body"), F.col("path"), F.col("line"), none, no)
    return out.joined_text(_acts(spark, d).where("own"), ["ts", "event_id"], line)


def post_review_text(spark, d):
    """What others did after the bot's first review or comment; everything where it made none."""
    acts = _acts(spark, d)
    start = acts.where("own and event_type in ('review', 'review_comment', 'issue_comment')").groupBy("pr_id").agg(F.min("ts").alias("start"))
    after = acts.where("not own").join(start, "pr_id", "left").where("start is null or ts > start")
    return out.joined_text(after, ["ts", "event_id"], out.activity_text(*[F.col(c) for c in ("event_type", "at", "actor", "state", "body", "path", "line")], F.lit(False)))


def _doc(spark, d, kind, **fields):
    """Events of a kind as the documents a code host would give."""
    t = _timeline(spark, d).where(F.col("event_type") == kind)
    return t.select("event_id", "pr_id", F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("doc"))


def host_commits(spark, d):
    commit = F.struct(F.col("message").alias("message"), F.struct(F.date_format("ts", "yyyy-MM-dd").alias("date")).alias("author"))
    return asm.commit_rows(_doc(spark, d, "commit", sha=F.col("sha"), commit=commit, author=F.when(F.col("actor").isNotNull(), F.struct(F.col("actor").alias("login")))))


def host_reviews(spark, d):
    rows = asm.review_rows(_doc(spark, d, "review", id=F.col("review_id"), user=F.struct(F.col("actor").alias("login")), state=F.nullif("state", F.lit("")), body=F.col("body"), submitted_at=F.date_format("ts", "yyyy-MM-dd")))
    return rows.select("event_id", "id", "author", "state", "body", "submitted_at")


def host_details(spark, d):
    """Commit documents with their files, read back; sizes are those of the files."""
    one = F.struct("filename", "status", "additions", "deletions")
    docs = _files(spark, d).groupBy("pr_id", "event_id", "sha").agg(F.collect_list(one).alias("files"))
    rows = asm.detail_rows(docs.select("pr_id", "event_id", F.to_json(F.struct("sha", "files")).alias("doc")))
    return rows.select("event_id", "sha", F.size("files").alias("n_files"), tline.diff_lines(F.array(F.struct("files"))).alias("diff_lines"))


def three_endpoints(spark, d):
    t = _timeline(spark, d).withColumns({"key": F.col("event_id"), "created_at": F.date_format("ts", "yyyy-MM-dd")})
    of = lambda k: t.where(F.col("event_type") == k)
    inline = of("review_comment").select("key", "path", F.when(F.col("line") % 2 == 0, F.col("line")).alias("line"), F.col("line").alias("original_line"), "body", "created_at")
    return asm.review_comments(inline, of("review").withColumnRenamed("created_at", "submitted_at"), of("issue_comment"))


def reference_addresses(spark, d):
    """Every pull request with the address of the same repository name and number among those already analysed."""
    p = v.prs(spark, d).select("id", F.element_at(F.split("repo_name", "/"), -1).alias("repo"), F.col("pr_number").alias("number"), "status", "pr_url")
    return asm.golden_url(p.select("id", "repo", "number"), p.where("status = 'analyzed'").select(F.col("pr_url").alias("url"))).select("id", "url")


def assembled_records(spark, d):
    p = table(spark, d, "prs")
    kept = v.prs(spark, d).select(F.col("id").alias("pr_id"), "pr_url", "repo_name", "pr_number").join(p.groupBy(F.col("id").alias("pr_id")).agg(F.bool_or(F.col("bq_events").isNotNull()).alias("has_events")), "pr_id")
    enriched = _enriched(spark, d)
    own = asm.thread_summaries(table(spark, d, "review_threads"))
    threads = own.groupBy("pr_id").agg(F.sort_array(F.collect_list(F.struct("thread_id", "path", "is_resolved", "n_comments"))).alias("review_threads"))
    meta = v.prs(spark, d).select(F.col("id").alias("pr_id"), "pr_title", "pr_author", "pr_merged")
    stats = tline.target_stats(_bots(spark, d), enriched, table(spark, d, "review_threads"), exact=True)
    return asm.assembled(kept, meta, tline.ordered(enriched), threads, stats, tline.target_roles(_bots(spark, d), enriched, exact=True))


def assembled_summary(spark, d):
    r = assembled_records(spark, d)
    return r.select(
        "pr_id", "pr_url", "pr_title", "pr_author", "pr_merged", F.array_join("roles", ",").alias("roles"), F.coalesce(F.size("events"), F.lit(0)).alias("n_events"), F.coalesce(F.size("review_threads"), F.lit(0)).alias("n_threads"),
        F.try_element_at("review_threads", F.lit(1))["path"].alias("first_path"), "stats.n_commits", "stats.n_resolved", "stats.n_target_comments",
    )


def _suggestions(spark, d):
    return scorers.suggestion_extractor(v.comments(spark, d).where("in_reply_to_id is null").select("pr_id", "comment_id", "body", "path", F.lit(None).cast("int").alias("line")))


def extracted_suggestions(spark, d):
    return _suggestions(spark, d).select("pr_id", "issue_id", "description", "category", "severity", "file_path")


def extracted_actions(spark, d):
    t = _timeline(spark, d).where("event_type = 'commit' and sha is not null").groupBy("pr_id", "sha").agg(F.min("message").alias("message"))
    return scorers.action_extractor(t, v.comments(spark, d).where("in_reply_to_id is not null").select("pr_id", "comment_id", "body", "path"))


def matched_actions(spark, d):
    replies = v.comments(spark, d).where("in_reply_to_id is not null").select("pr_id", F.concat(F.lit("R"), F.col("comment_id").cast("string")).alias("action_id"), F.col("body").alias("description"))
    m = scorers.action_matcher(_suggestions(spark, d), replies, 3)
    return m.select("pr_id", "bot_issue_id", F.coalesce("human_action_id", F.lit("")).alias("human_action_id"), "matched", F.round("confidence", 6).alias("confidence"))


QUERIES = {
    "discover_targets": lambda s, d: _targets(s, d), "discover_sample": discover_sample, "discover_events": discover_events, "event_list_summary": event_list_summary,
    "first_seen_volume": lambda s, d: v.volumes(s, d), "first_seen_volume_compat_null": lambda s, d: disc.first_seen_volume(v.raw_events(s, d), True),
    "pr_metadata_first_non_null": pr_metadata_first_non_null, "reviewed_at_first": reviewed_at_first,
    "queue_unanalysed_topk": queue_unanalysed_topk, "queue_unlabelled_topk": queue_unlabelled_topk, "pending_distinct_from": pending_distinct_from, "insert_ignore": insert_ignore,
    "upsert_latest": upsert_latest, "lockable": lockable, "delete_cascade": delete_cascade, "size_gate": size_gate, "status_infer": status_infer, "status_current": status_current,
    "backfill_diff_lines": backfill_diff_lines, "incremental_merge": incremental_merge,
    "timeline_stats": timeline_stats, "timeline_roles": timeline_roles, "timeline_stats_by_bot": timeline_stats_by_bot, "timeline_roles_by_bot": timeline_roles_by_bot, "thread_enrich": thread_enrich, "timeline_union_sorted": timeline_union_sorted, "review_dedupe": review_dedupe,
    "event_kinds": event_kinds, "diff_lines_nested": diff_lines_nested, "hash_x": hash_x, "pre_post_split": pre_post_split, "hash_x_by_bot": hash_x_by_bot, "pre_post_split_by_bot": pre_post_split_by_bot, "outcome_metrics": outcome_metrics,
    "locks_taken": locks_taken, "missing_sizes": missing_sizes, "column_updates": column_updates, "point_lookup": point_lookup, "pending_since": pending_since, "resume_after_errors": resume_after_errors,
    "discovery_summary": discovery_summary, "archive_scan": archive_scan, "archive_event_numbers": archive_event_numbers, "thread_summaries": thread_summaries, "thread_comment_lines": thread_comment_lines,
    "file_list_text": file_list_text, "bot_comments_text": bot_comments_text, "post_review_text": post_review_text, "host_commits": host_commits, "host_reviews": host_reviews, "host_details": host_details, "three_endpoints": three_endpoints,
    "reference_addresses": reference_addresses, "assembled_summary": assembled_summary, "extracted_suggestions": extracted_suggestions, "extracted_actions": extracted_actions, "matched_actions": matched_actions,
    "suggestion_summary": suggestion_summary, "file_list_distinct": file_list_distinct, "commits_text": commits_text,
}

_TARGETS = f"""WITH {v.EVENTS}, t AS (SELECT bot, repo, number, min(day) AS first_day, max(url) AS url FROM ev
 WHERE day BETWEEN DATE '{FIRST}' AND DATE '{LAST}' AND number >= 5 AND bot BETWEEN 1 AND 7 GROUP BY 1, 2, 3)"""
_SAMPLE = f"""{_TARGETS}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bot, first_day ORDER BY repo, number) AS rn, count(*) OVER (PARTITION BY bot) AS total FROM t) WHERE total <= 3 OR rn <= 3)"""
_TL = f"""WITH {v.TIMELINE}, x0 AS (SELECT event_id, pr_id, ts, event_type, actor, CASE WHEN json_valid(data) THEN data END AS j FROM tl),
x1 AS (SELECT * EXCLUDE (j), CASE WHEN json_type(j) = 'VARCHAR' THEN json_extract_string(j, '$') ELSE j END AS k FROM x0), x AS (SELECT * EXCLUDE (k), CASE WHEN json_valid(k) AND json_type(k) = 'OBJECT' THEN k END AS doc FROM x1),
t AS (SELECT event_id, pr_id, ts, event_type, actor, {", ".join(f"TRY_CAST(json_extract_string(doc, '$.{n}') AS {k}) AS {n}" for n, k in (("comment_id", "BIGINT"), ("review_id", "BIGINT"), ("order_index", "INTEGER"), ("line", "INTEGER")))},
 {", ".join(f"json_extract_string(doc, '$.{n}') AS {n}" for n in ("sha", "state", "message", "body", "path"))} FROM x),
bots AS (SELECT p0.id AS pr_id, c.github_username AS target, p0.pr_author FROM (SELECT id, arg_max(chatbot_id, discovered_at) AS chatbot_id, arg_max(pr_author, discovered_at) AS pr_author FROM prs GROUP BY 1) p0 LEFT JOIN chatbots c ON c.id = p0.chatbot_id)"""
_THREADS = """r AS (SELECT pr_id, thread_id, is_resolved, unnest(comments) AS c FROM review_threads),
rc AS (SELECT pr_id, c.id AS comment_id, max(thread_id) AS thread_id, max_by(c.body, thread_id) AS body, max_by(is_resolved, thread_id) AS is_resolved, max_by(c.author, thread_id) AS author, max_by(c.path, thread_id) AS path, max_by(coalesce(nullif(c.original_line, 0), c.line), thread_id) AS line,
 max_by(len(map_keys(c.reactions)), thread_id) AS n_reactions FROM r WHERE c.id IS NOT NULL GROUP BY 1, 2),
en AS (SELECT t.pr_id, event_type, actor, t.comment_id, coalesce(nullif(rc.body, ''), t.body) AS body, rc.is_resolved, rc.thread_id, n_reactions FROM t LEFT JOIN rc ON rc.pr_id = t.pr_id AND rc.comment_id = t.comment_id
 UNION ALL SELECT pr_id, 'review_comment', coalesce(author, 'unknown'), comment_id, body, is_resolved, thread_id, n_reactions FROM rc WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.pr_id = rc.pr_id AND t.comment_id = rc.comment_id))"""
_SAME = {"exact": "{0} = {1}", "loose": "regexp_replace(lower(trim({0})), '\\[bot\\]$', '') = regexp_replace(lower(trim({1})), '\\[bot\\]$', '')"}


def _stats_sql(same: str) -> str:
    own = _SAME[same].format("actor", "target")
    return f"""{_TL}, {_THREADS}, ev AS (SELECT en.pr_id, count(*) AS n_events, count(*) FILTER (event_type = 'commit') AS n_commits, count(*) FILTER (event_type = 'review_comment' AND {own}) AS n_target_review_comments,
 count(*) FILTER (event_type IN ('review', 'review_comment', 'issue_comment') AND {own}) AS n_target_comments FROM en JOIN bots USING (pr_id) GROUP BY 1),
th AS (SELECT pr_id, count(DISTINCT thread_id) AS n_threads, count(DISTINCT CASE WHEN is_resolved THEN thread_id END) AS n_resolved FROM review_threads GROUP BY 1),
st AS (SELECT bots.pr_id, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("n_events", "n_commits", "n_target_review_comments", "n_target_comments", "n_threads", "n_resolved"))} FROM bots LEFT JOIN ev USING (pr_id) LEFT JOIN th USING (pr_id)),
rk AS (SELECT DISTINCT en.pr_id, CASE WHEN event_type IN ('review', 'review_comment') THEN 'reviewer' WHEN event_type = 'issue_comment' THEN 'commenter' END AS role FROM en JOIN bots USING (pr_id) WHERE {own} UNION SELECT pr_id, 'author' FROM bots WHERE {_SAME[same].format('pr_author', 'target')}),
rl AS (SELECT bots.pr_id, coalesce(string_agg(role, ',' ORDER BY role) FILTER (role IS NOT NULL), '') AS roles FROM bots LEFT JOIN rk USING (pr_id) GROUP BY 1)"""


_COMMITS = "c AS (SELECT pr_id, sha, min(coalesce(order_index, 0)) AS idx, min_by(ts, (coalesce(order_index, 0), ts)) AS tm FROM t WHERE event_type = 'commit' AND sha IS NOT NULL GROUP BY 1, 2)"
_REVIEWED = f"""{_TL}, {_COMMITS}, fl AS (SELECT pr_id, arg_min(sha, (idx, sha)) AS fs, arg_max(sha, (idx, sha)) AS ls FROM c GROUP BY 1),
ac AS (SELECT t.*, fs, ls FROM t JOIN bots USING (pr_id) LEFT JOIN fl USING (pr_id) WHERE lower(actor) = lower(target) AND event_type IN ('review', 'review_comment', 'issue_comment')),
r1 AS (SELECT pr_id, arg_min(fs, (ts, fs)) AS by_review FROM ac WHERE event_type = 'review' AND review_id % 4 = 1 AND fs IS NOT NULL GROUP BY 1),
r2 AS (SELECT pr_id, arg_min(s, (ts, s)) AS by_comment FROM (SELECT pr_id, ts, CASE comment_id % 4 WHEN 1 THEN ls WHEN 2 THEN substr(fs, 1, 10) WHEN 3 THEN fs END AS s FROM ac WHERE event_type = 'review_comment') WHERE s IS NOT NULL GROUP BY 1),
st AS (SELECT pr_id, min(ts) AS start FROM ac GROUP BY 1),
e AS (SELECT c.pr_id, max_by(sha, CASE WHEN tm <= start THEN idx END) AS by_time, max_by(sha, idx) AS last FROM c LEFT JOIN st USING (pr_id) GROUP BY 1),
h AS (SELECT pr_id, coalesce(by_review, by_comment, by_time, last) AS sha FROM e LEFT JOIN r1 USING (pr_id) LEFT JOIN r2 USING (pr_id))"""
_BY_BOT = f"""{_TL}, {_COMMITS}, st AS (SELECT pr_id, min(ts) AS start FROM t JOIN bots USING (pr_id) WHERE {_SAME["loose"].format("actor", "target")} AND event_type IN ('review', 'review_comment', 'issue_comment') GROUP BY 1),
h AS (SELECT c.pr_id, coalesce(max_by(sha, CASE WHEN tm <= start THEN idx END), max_by(sha, idx)) AS sha FROM c LEFT JOIN st USING (pr_id) GROUP BY 1)"""
_FILES = f"""{P2_FILES}, fx AS (SELECT pr_id, event_id, ix, file_name, json_extract_string(f, '$.status') AS status, TRY_CAST(json_extract_string(f, '$.additions') AS BIGINT) AS additions, TRY_CAST(json_extract_string(f, '$.deletions') AS BIGINT) AS deletions
 FROM (SELECT *, row_number() OVER (PARTITION BY pr_id, event_id, file_name ORDER BY ix) AS rn FROM f3 WHERE file_name IS NOT NULL) WHERE rn = 1)"""
_ACTS = f"""{_TL}, ac AS (SELECT t.*, lower(actor) = lower(target) AS own, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, CASE WHEN path <> '' THEN ' (' || path || ':' || coalesce(CAST(line AS VARCHAR), '') || ')' ELSE '' END AS place,
 CASE WHEN body <> '' THEN '  ' || body || chr(10) ELSE '' END AS bd FROM t JOIN bots USING (pr_id) WHERE actor IS NOT NULL AND target IS NOT NULL)"""
_SUGGEST = """sg AS (SELECT pr_id, comment_id, 'S' || comment_id AS issue_id, trim(regexp_extract(body, '^([^.!?\\n]+)', 1), ' ') AS description, {cat} AS category, {sev} AS severity, path AS file_path FROM tc WHERE in_reply_to_id IS NULL AND regexp_matches(body, '\\S'))"""


def _keyword(text: str, words: dict[str, tuple[str, ...]], default: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(lower({text}), '\\b(?:{'|'.join(w)})\\b') THEN '{label}'" for label, w in words.items())
    return f"CASE {cases} ELSE '{default}' END"


_SUGGEST = _SUGGEST.format(cat=_keyword("body", scorers.CATEGORIES, "other"), sev=_keyword("body", scorers.SEVERITY_WORDS, "medium"))
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: length(x) > 2))"

SQL = {
    "discover_targets": f"{_TARGETS} SELECT * FROM t",
    "discover_sample": f"{_SAMPLE} SELECT bot, repo, number, first_day FROM s",
    "discover_events": f"{_SAMPLE} SELECT event_id, repo, number FROM ev WHERE (repo, number) IN (SELECT (repo, number) FROM s)",
    "event_list_summary": f"""WITH {v.EVENTS} SELECT repo, number, count(*) AS n, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id FROM ev WHERE number IS NOT NULL GROUP BY 1, 2""",
    "first_seen_volume": f"WITH {v.EVENTS}, {v.VOLUMES} SELECT * FROM vol",
    "first_seen_volume_compat_null": f"WITH {v.EVENTS} SELECT bot, day, count(*) AS pr_count FROM (SELECT bot, CASE WHEN number IS NOT NULL THEN repo || '#' || number END AS k, min(day) AS day FROM ev GROUP BY 1, 2) GROUP BY 1, 2",
    "pr_metadata_first_non_null": f"""WITH {v.EVENTS}, r AS (SELECT repo || '#' || number AS k, ts, event_id, CASE WHEN value > 50 THEN 't' || event_id END AS title, CASE WHEN event_type = 'click' THEN bot END AS author FROM ev WHERE number IS NOT NULL)
SELECT k, arg_min(title, (ts, event_id)) FILTER (title IS NOT NULL) AS title, arg_min(author, (ts, event_id)) FILTER (author IS NOT NULL) AS author FROM r GROUP BY 1""",
    "reviewed_at_first": f"WITH {v.EVENTS} SELECT repo, number, strftime(min(CASE WHEN actor = 'bot3' THEN ts END), '%Y-%m-%d %H:%M:%S') AS reviewed_at FROM ev WHERE number IS NOT NULL GROUP BY 1, 2",
    "queue_unanalysed_topk": f"WITH {v.PRS} SELECT id, chatbot_id, repo_name, pr_number FROM p WHERE NOT EXISTS (SELECT 1 FROM llm_analyses a WHERE a.pr_id = p.id AND a.chatbot_id = p.chatbot_id) ORDER BY discovered_at NULLS LAST, id LIMIT 50",
    "queue_unlabelled_topk": f"""WITH {v.PRS} SELECT id, chatbot_id, repo_name, pr_number FROM p WHERE id IN (SELECT pr_id FROM llm_analyses) AND NOT EXISTS (SELECT 1 FROM review_threads r WHERE r.pr_id = p.id)
ORDER BY analyzed_at DESC NULLS LAST, id LIMIT 40""",
    "pending_distinct_from": f"""WITH {v.PRS} SELECT id, status, enrichment_step FROM p WHERE enrichment_step IS DISTINCT FROM 'done'""",
    "insert_ignore": f"""SELECT id, arg_min(chatbot_id, discovered_at) AS chatbot_id, arg_min(status, discovered_at) AS status FROM prs WHERE id NOT IN (SELECT id FROM prs WHERE discovered_at < TIMESTAMP '{CUT}') GROUP BY 1""",
    "upsert_latest": "SELECT id, arg_max(pr_id, analyzed_at) AS pr_id, strftime(max(analyzed_at), '%Y-%m-%d %H:%M:%S') AS analyzed_at FROM llm_analyses GROUP BY 1",
    "lockable": f"""WITH {v.PRS} SELECT id, status FROM p WHERE id % 3 = 0 OR discovered_at < TIMESTAMP '2025-06-01' - INTERVAL 30 MINUTE""",
    "delete_cascade": f"""WITH {v.PRS}, g AS (SELECT id FROM p WHERE status = 'error' OR id % 7 = 0) SELECT 'prs' AS table_name, id AS pr_id, count(*) AS n FROM p WHERE id NOT IN (FROM g) GROUP BY id
UNION ALL SELECT 'analyses', pr_id, count(*) FROM llm_analyses WHERE pr_id NOT IN (FROM g) GROUP BY pr_id UNION ALL SELECT 'threads', pr_id, count(*) FROM review_threads WHERE pr_id NOT IN (FROM g) GROUP BY pr_id""",
    "size_gate": f"""WITH {v.PRS}, {v.TIMELINE}, c AS (SELECT pr_id, count(*) AS n FROM tl WHERE event_type = 'commit' GROUP BY 1)
SELECT id, CASE WHEN n > 3 OR diff_lines > 1000 THEN 'skipped' ELSE 'enriching' END AS gate, CASE WHEN n > 3 THEN 'commits ' || n || ' > 3' WHEN diff_lines > 1000 THEN 'lines ' || diff_lines || ' > 1000' END AS reason FROM p LEFT JOIN c ON c.pr_id = p.id""",
    "status_infer": f"""WITH {v.PRS}, k AS (SELECT *, ['bq_events', 'commits', 'reviews', 'threads', 'details', 'done'] AS steps, coalesce(list_position(['bq_events', 'commits', 'reviews', 'threads', 'details', 'done'], enrichment_step), 0) AS no FROM p)
SELECT id, CASE WHEN analyzed_at IS NOT NULL THEN 'analyzed' WHEN diff_lines > 500 THEN 'enriched' WHEN enrichment_step IS NOT NULL THEN 'enriching' ELSE 'pending' END AS inferred,
 CASE WHEN analyzed_at IS NOT NULL THEN 'done' WHEN diff_lines > 500 THEN 'done' WHEN enrichment_step IS NOT NULL THEN 'commits' WHEN error_message IS NOT NULL THEN 'bq_events' ELSE '' END AS step, CAST(no AS INTEGER) AS step_no, array_to_string(steps[no + 1:], ',') AS to_do FROM k""",
    "status_current": """SELECT id, arg_max(status, (discovered_at, status)) AS status FROM prs GROUP BY 1""",
    "backfill_diff_lines": f"""WITH {v.PRS} SELECT id, coalesce(diff_lines, pr_number % 100) AS diff_lines FROM p""",
    "incremental_merge": f"""WITH n AS (SELECT id, arg_max(status, (discovered_at, status)) AS status FROM prs WHERE discovered_at >= TIMESTAMP '{CUT}' GROUP BY 1), o AS (SELECT id, arg_max(status, (discovered_at, status)) AS status FROM prs WHERE discovered_at < TIMESTAMP '{CUT}' GROUP BY 1)
SELECT id, status, 'new' AS side FROM n UNION ALL SELECT id, status, 'old' FROM o WHERE id NOT IN (SELECT id FROM n)""",
    "timeline_stats": _stats_sql("exact") + " SELECT * FROM st",
    "timeline_roles": _stats_sql("exact") + " SELECT * FROM rl",
    "thread_enrich": f"""{_TL}, {_THREADS} SELECT pr_id, comment_id, thread_id, coalesce(is_resolved, false) AS is_resolved, body, CAST(coalesce(n_reactions, 0) AS INTEGER) AS n_reactions FROM en WHERE event_type = 'review_comment'""",
    "timeline_union_sorted": f"""{_TL}, {_THREADS}, u AS (SELECT pr_id, ts AS tm, coalesce(order_index, 0) AS o, 0 AS s, comment_id, event_type, actor FROM t UNION ALL SELECT pr_id, TIMESTAMP '0001-01-01', 0, 1, comment_id, 'review_comment', author FROM rc),
w AS (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY tm, o, s, comment_id NULLS FIRST, event_type, actor NULLS FIRST) AS rn FROM u)
SELECT pr_id, count(*) AS n, max(CASE WHEN rn = 1 THEN event_type END) AS first_type, strftime(max(tm), '%Y-%m-%d %H:%M:%S') AS last_at FROM w GROUP BY 1""",
    "review_dedupe": f"""{_TL} SELECT pr_id, review_id FROM t WHERE event_type = 'review' AND state <> '' AND (pr_id, review_id) NOT IN (SELECT (pr_id, review_id) FROM t WHERE event_type = 'review' AND review_id IS NOT NULL AND ts < TIMESTAMP '{CUT}')""",
    "event_kinds": f"""WITH {v.EVENTS} SELECT event_id, CASE WHEN bot % 3 = 1 THEN 'review' WHEN bot % 3 = 2 THEN 'issue_comment' WHEN number % 4 = 1 AND number % 3 = 0 THEN 'pr_merged' WHEN number % 4 = 1 THEN 'pr_closed'
 WHEN number % 4 = 0 THEN 'pr_opened' ELSE 'pr_labeled' END AS kind FROM ev""",
    "diff_lines_nested": "SELECT l_orderkey, CAST(coalesce(sum(CASE WHEN l_linenumber <> 2 THEN CAST(l_quantity AS BIGINT) + CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey ELSE 0 END END), 0) AS BIGINT) AS diff_lines FROM lineitem GROUP BY 1",
    "hash_x": f"""{_REVIEWED} SELECT pr_id, sha FROM h""",
    "pre_post_split": f"""{_REVIEWED}, k AS (SELECT c.pr_id, min(CASE WHEN starts_with(c.sha, h.sha) OR starts_with(h.sha, c.sha) THEN idx END) AS cut FROM c JOIN h ON h.pr_id = c.pr_id GROUP BY 1)
SELECT c.pr_id, idx, sha, coalesce(idx > cut, false) AS is_post FROM c JOIN k ON k.pr_id = c.pr_id""",
    "outcome_metrics": f"""WITH {v.COMMENTS}, g AS (SELECT thread_id, count(*) FILTER (in_reply_to_id IS NULL) AS ns, count(*) FILTER (in_reply_to_id IS NOT NULL) AS na, count(*) FILTER (in_reply_to_id IS NOT NULL AND length(body) > 60) AS ma FROM tc GROUP BY 1),
b AS (SELECT c.thread_id, count(DISTINCT c.in_reply_to_id) AS mb FROM tc c JOIN tc r ON r.thread_id = c.thread_id AND r.comment_id = c.in_reply_to_id AND r.in_reply_to_id IS NULL WHERE length(c.body) > 60 GROUP BY 1),
m AS (SELECT g.thread_id, coalesce(mb, 0) AS mb, ma, coalesce(mb, 0) / nullif(ns, 0) AS p, ma / nullif(na, 0) AS r FROM g LEFT JOIN b ON b.thread_id = g.thread_id)
SELECT thread_id, mb AS matched_suggestions, ma AS matched_actions, round(p, 6) AS "precision", round(r, 6) AS recall, CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 6) END AS f_beta FROM m""",
    "suggestion_summary": f"""WITH {v.COMMENTS}, k AS (SELECT pr_id, coalesce(nullif(regexp_extract(path, '\\.([a-z]+)$', 1), ''), 'other') AS c, CASE WHEN length(body) > 100 THEN 'high' WHEN length(body) > 60 THEN 'low' ELSE 'medium' END AS s FROM tc),
x AS (SELECT pr_id, c AS n, c || '(' || count(*) || ')' AS t FROM k GROUP BY pr_id, c), y AS (SELECT pr_id, s AS n, s || '(' || count(*) || ')' AS t FROM k GROUP BY pr_id, s),
z AS (SELECT pr_id, count(*) AS total, (SELECT count(DISTINCT in_reply_to_id) FROM tc WHERE tc.pr_id = k.pr_id) AS matched, (SELECT string_agg(t, ', ' ORDER BY n) FROM x WHERE x.pr_id = k.pr_id) AS categories, (SELECT string_agg(t, ', ' ORDER BY n) FROM y WHERE y.pr_id = k.pr_id) AS severities FROM k GROUP BY 1)
SELECT *, 'Total suggestions: ' || total || ', matched: ' || matched || chr(10) || 'Categories: ' || categories || chr(10) || 'Severities: ' || severities AS summary FROM z""",
    "file_list_distinct": f"WITH {v.COMMENTS} SELECT pr_id, path AS filename, min(comment_id) AS commit_idx FROM tc WHERE path IS NOT NULL GROUP BY 1, 2",
    "commits_text": f"""{_TL}, {_FILES}, {_COMMITS}, cm AS (SELECT pr_id, sha, arg_min({{'idx': coalesce(order_index, 0), 'ts': ts, 'event_id': event_id, 'message': message, 'actor': actor}}, (coalesce(order_index, 0), ts, event_id)) AS r FROM t WHERE event_type = 'commit' AND sha IS NOT NULL GROUP BY 1, 2),
de AS (SELECT t.pr_id, t.sha, max(fx.event_id) AS event_id FROM fx JOIN t ON t.event_id = fx.event_id WHERE t.event_type = 'commit' AND t.sha IS NOT NULL GROUP BY 1, 2),
fl AS (SELECT de.pr_id, de.sha, string_agg('  ' || upper(coalesce(status, '')) || ' ' || file_name || ' (+' || coalesce(additions, 0) || '/-' || coalesce(deletions, 0) || ')' || chr(10), '' ORDER BY ix) AS l FROM de JOIN fx ON fx.event_id = de.event_id GROUP BY 1, 2)
SELECT cm.pr_id, string_agg('COMMIT ' || substr(cm.sha, 1, 12) || ' by ' || coalesce(r.actor, 'unknown') || ' [' || strftime(r.ts, '%Y-%m-%d') || ']' || chr(10) || '  Message: ' || coalesce(r.message, '') || chr(10) || coalesce(l, ''), chr(10) ORDER BY r.idx, cm.sha) AS text
FROM cm LEFT JOIN fl ON fl.pr_id = cm.pr_id AND fl.sha = cm.sha GROUP BY 1""",
    "locks_taken": f"""WITH {v.PRS} SELECT id, 'worker-1' AS locked_by, 'enriching' AS status FROM p WHERE id % 3 = 0 OR discovered_at < TIMESTAMP '2025-06-01' - INTERVAL 30 MINUTE ORDER BY discovered_at, id LIMIT 60""",
    "missing_sizes": f"""WITH {v.PRS} SELECT count(*) AS n FROM p WHERE diff_lines IS NULL AND enrichment_step IN ('details', 'done')""",
    "column_updates": f"""WITH {v.PRS}, a AS (SELECT pr_id, max(analyzed_at) AS tm, CAST(arg_max(total_bot_comments, (analyzed_at, id, total_bot_comments)) AS BIGINT) AS n FROM llm_analyses GROUP BY 1)
SELECT id, CASE WHEN pr_id IS NULL THEN diff_lines ELSE n END AS diff_lines, strftime(CASE WHEN pr_id IS NULL THEN analyzed_at ELSE tm END, '%Y-%m-%d %H:%M:%S') AS analyzed_at FROM p LEFT JOIN a ON pr_id = id""",
    "point_lookup": f"""WITH {v.PRS} SELECT id, repo_name, status FROM p WHERE chatbot_id = 1 AND pr_number = 1""",
    "pending_since": f"""WITH {v.PRS} SELECT id, status FROM p WHERE status IN ('enriched', 'assembled', 'pending') AND discovered_at >= TIMESTAMP '2025-03-01' ORDER BY discovered_at DESC, id LIMIT 80""",
    "resume_after_errors": f"""WITH {v.PRS}, {v.ANALYSES} SELECT id, status FROM p WHERE id NOT IN (SELECT pr_id FROM a WHERE total_bot_comments - matched_bot_comments - 2 <= 0)""",
    "discovery_summary": f"""WITH f AS (SELECT DISTINCT repo_name, pr_number FROM prs WHERE pr_number IS NOT NULL), k AS (SELECT DISTINCT repo_name, pr_number FROM prs WHERE pr_number IS NOT NULL AND discovered_at < TIMESTAMP '{CUT}')
SELECT count(*) AS discovered, (SELECT count(*) FROM k) AS known, count(*) - (SELECT count(*) FROM k) AS inserted FROM f""",
    "archive_scan": f"""WITH {v.EVENTS} SELECT event_id, bot, repo, number, day FROM ev WHERE day BETWEEN DATE '{FIRST}' AND DATE '{LAST}'""",
    "archive_event_numbers": f"""WITH {P2_EVENTS}, k AS (SELECT DISTINCT pr_id, event_id, json_extract_string(e, '$.type') AS type, json_extract_string(e, '$.repo_name') AS repo, p FROM ev WHERE event_id IS NOT NULL),
n AS (SELECT *, TRY_CAST(CASE WHEN type = 'IssueCommentEvent' THEN json_extract_string(p, '$.issue.number') ELSE json_extract_string(p, '$.pull_request.number') END AS BIGINT) AS number FROM k)
SELECT DISTINCT pr_id, event_id, type, number, coalesce(json_extract_string(p, '$.pull_request.html_url'), json_extract_string(p, '$.issue.pull_request.html_url'), 'https://github.com/' || repo || '/pull/' || number) AS url,
 coalesce(type <> 'IssueCommentEvent' OR json_extract(p, '$.issue.pull_request') IS NOT NULL, false) AS on_pr FROM n""",
    "thread_summaries": """SELECT pr_id, thread_id, list_filter(list_transform(comments, lambda c: c.path), lambda x: x IS NOT NULL)[1] AS path, coalesce(is_resolved, false) AS is_resolved, CAST(coalesce(len(comments), 0) AS INTEGER) AS n_comments FROM review_threads""",
    "thread_comment_lines": f"""WITH {_THREADS.split(', en AS')[0].split(chr(10) + 'en AS')[0].rstrip(',')} SELECT pr_id, comment_id, thread_id, path, line, author FROM rc""",
    "file_list_text": f"""{_TL}, {_FILES}, k AS (SELECT fx.pr_id, file_name, arg_min({{'o': coalesce(order_index, 0), 'e': fx.event_id, 'i': ix, 'l': file_name || ' (' || coalesce(fx.status, '') || ', +' || coalesce(additions, 0) || '/-' || coalesce(deletions, 0) || ')'}}, (coalesce(order_index, 0), fx.event_id, ix)) AS r
 FROM fx JOIN t ON t.event_id = fx.event_id AND event_type = 'commit' AND sha IS NOT NULL WHERE file_name <> '' GROUP BY 1, 2) SELECT pr_id, string_agg(r.l, chr(10) ORDER BY r.o, r.e, r.i) AS text FROM k GROUP BY 1""",
    "bot_comments_text": f"""{_ACTS}, k AS (SELECT pr_id, ts, event_id, CASE WHEN event_type = 'review' THEN '[' || stamp || '] REVIEW (' || coalesce(state, '') || '):' || chr(10) || bd WHEN event_type IN ('review_comment', 'issue_comment') THEN '[' || stamp || '] ' || upper(event_type) || place || ':' || chr(10) || bd END AS l FROM ac WHERE own)
SELECT pr_id, string_agg(l, chr(10) ORDER BY ts, event_id) AS text FROM k WHERE l IS NOT NULL GROUP BY 1""",
    "post_review_text": f"""{_ACTS}, st AS (SELECT pr_id, min(ts) AS start FROM ac WHERE own AND event_type IN ('review', 'review_comment', 'issue_comment') GROUP BY 1),
k AS (SELECT ac.pr_id, ts, event_id, CASE WHEN event_type IN ('review_comment', 'issue_comment') THEN '[' || stamp || '] ' || upper(event_type) || ' by ' || actor || place || ':' || chr(10) || bd WHEN event_type = 'review' THEN '[' || stamp || '] REVIEW by ' || actor || ': ' || coalesce(state, '') || chr(10) || bd
 WHEN event_type IN ('pr_merged', 'pr_closed', 'pr_reopened') THEN '[' || stamp || '] ' || upper(event_type) || ' by ' || actor || chr(10) END AS l FROM ac LEFT JOIN st USING (pr_id) WHERE NOT own AND (start IS NULL OR ts > start))
SELECT pr_id, string_agg(l, chr(10) ORDER BY ts, event_id) AS text FROM k WHERE l IS NOT NULL GROUP BY 1""",
    "host_commits": f"""{_TL} SELECT event_id, pr_id, sha, coalesce(message, '') AS message, strftime(ts, '%Y-%m-%d') AS date, actor AS author FROM t WHERE event_type = 'commit'""",
    "host_reviews": f"""{_TL} SELECT event_id, review_id AS id, actor AS author, coalesce(state, '') AS state, coalesce(body, '') AS body, strftime(ts, '%Y-%m-%d') AS submitted_at FROM t WHERE event_type = 'review'""",
    "host_details": f"""{_TL}, {_FILES} SELECT t.event_id, t.sha, CAST(count(*) AS INTEGER) AS n_files, CAST(sum(coalesce(additions, 0) + coalesce(deletions, 0)) AS BIGINT) AS diff_lines FROM fx JOIN t ON t.event_id = fx.event_id AND event_type = 'commit' AND sha IS NOT NULL GROUP BY 1, 2""",
    "three_endpoints": f"""{_TL}, k AS (SELECT *, strftime(ts, '%Y-%m-%d') AS created_at FROM t) SELECT event_id AS key, 0 AS endpoint, path, CASE WHEN line <> 0 THEN line WHEN line % 2 = 0 THEN line END AS line, body, created_at FROM k WHERE event_type = 'review_comment'
UNION ALL SELECT event_id, 1, NULL, NULL, body, created_at FROM k WHERE event_type = 'review' AND body <> '' UNION ALL SELECT event_id, 2, NULL, NULL, body, created_at FROM k WHERE event_type = 'issue_comment'""",
    "reference_addresses": f"""WITH {v.PRS}, g AS (SELECT regexp_extract(pr_url, '/([^/]+)/pull/([0-9]+)$', 1) AS repo, CAST(regexp_extract(pr_url, '/([^/]+)/pull/([0-9]+)$', 2) AS BIGINT) AS number, min(pr_url) AS url FROM p WHERE status = 'analyzed' GROUP BY 1, 2)
SELECT id, url FROM p LEFT JOIN g ON g.repo = split_part(repo_name, '/', -1) AND g.number = pr_number""",
    "assembled_summary": f"""{_stats_sql("exact")}, {v.PRS}, he AS (SELECT id FROM prs GROUP BY 1 HAVING count(bq_events) > 0), tp AS (SELECT pr_id, arg_min(list_filter(list_transform(comments, lambda c: c.path), lambda x: x IS NOT NULL)[1], thread_id) AS first_path, arg_min(coalesce(list_filter(list_transform(comments, lambda c: c.path), lambda x: x IS NOT NULL)[1], ''), thread_id) AS fp, CAST(count(*) AS INTEGER) AS n FROM review_threads GROUP BY 1),
ne AS (SELECT pr_id, CAST(count(*) AS INTEGER) AS n FROM en GROUP BY 1)
SELECT p.id AS pr_id, pr_url, pr_title, p.pr_author, pr_merged, roles, coalesce(ne.n, 0) AS n_events, coalesce(tp.n, 0) AS n_threads, nullif(fp, '') AS first_path, n_commits, n_resolved, n_target_comments
FROM p JOIN he ON he.id = p.id LEFT JOIN st ON st.pr_id = p.id LEFT JOIN rl ON rl.pr_id = p.id LEFT JOIN tp ON tp.pr_id = p.id LEFT JOIN ne ON ne.pr_id = p.id""",
    "extracted_suggestions": f"""WITH {v.COMMENTS}, {_SUGGEST} SELECT pr_id, issue_id, description, category, severity, file_path FROM sg""",
    "extracted_actions": f"""{_TL}, {v.COMMENTS}, cm AS (SELECT pr_id, sha, min(message) AS message FROM t WHERE event_type = 'commit' AND sha IS NOT NULL GROUP BY 1, 2)
SELECT pr_id, 'C' || substr(sha, 1, 12) AS action_id, message AS description, {_keyword("message", scorers.CATEGORIES, "other")} AS category, CAST(NULL AS VARCHAR) AS file_path, sha AS commit_sha, 'code_change' AS action_type FROM cm
UNION ALL SELECT pr_id, 'R' || comment_id, trim(regexp_extract(body, '^([^.!?\\n]+)', 1), ' '), {_keyword("body", scorers.CATEGORIES, "other")}, path, NULL, 'discussion' FROM tc WHERE in_reply_to_id IS NOT NULL AND regexp_matches(body, '\\S')""",
    "matched_actions": f"""WITH {v.COMMENTS}, {_SUGGEST}, s AS (SELECT pr_id, issue_id, {_WORDS.format("description")} AS sw FROM sg), a AS (SELECT pr_id, 'R' || comment_id AS aid, {_WORDS.format("body")} AS aw FROM tc WHERE in_reply_to_id IS NOT NULL),
b AS (SELECT s.pr_id, issue_id, len(sw) AS n, coalesce(len(list_intersect(sw, aw)), 0) AS shared, aid FROM s LEFT JOIN a ON a.pr_id = s.pr_id), k AS (SELECT pr_id, issue_id, n, shared, aid, row_number() OVER (PARTITION BY pr_id, issue_id ORDER BY shared DESC, aid) AS rn FROM b)
SELECT pr_id, issue_id AS bot_issue_id, CASE WHEN shared >= 3 THEN aid ELSE '' END AS human_action_id, shared >= 3 AS matched, round(coalesce(shared / nullif(n, 0), 0), 6) AS confidence FROM k WHERE rn = 1""",
    "timeline_stats_by_bot": _stats_sql("loose") + " SELECT * FROM st",
    "timeline_roles_by_bot": _stats_sql("loose") + " SELECT * FROM rl",
    "hash_x_by_bot": f"{_BY_BOT} SELECT pr_id, substr(sha, 1, 10) AS sha FROM h",
    "pre_post_split_by_bot": f"""{_BY_BOT}, k AS (SELECT c.pr_id, min(CASE WHEN starts_with(c.sha, h.sha) OR starts_with(h.sha, c.sha) THEN idx END) AS cut FROM c JOIN h ON h.pr_id = c.pr_id GROUP BY 1)
SELECT c.pr_id, count(*) FILTER (NOT coalesce(idx > cut, false)) AS n_pre, count(*) FILTER (coalesce(idx > cut, false)) AS n_post FROM c JOIN k ON k.pr_id = c.pr_id GROUP BY 1""",
}
