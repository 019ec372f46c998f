"""Model views over the given tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import labels
from tallyspark.operators.lifecycle import latest
from tallyspark.sources.tables import table

_DOMAINS = ["frontend", " Infrastructure", "full-stack", "Documentation", "backend", "weird", "", None]
_TYPES = ["feature", "Bug", "refactoring", "tests", "chore", "odd", None]


def _pick(values: list, index):
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (index + 1).cast("int"))


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Fact rows: pr, bot, day, precision, recall, diff_lines and the label dimensions (with NULLs in all of them)."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("l_orderkey").alias("pr"), F.col("l_suppkey").alias("bot"), F.when(F.col("l_linenumber") != 7, F.to_date("l_shipdate")).alias("day"),
        F.when(F.col("l_returnflag") != "N", F.col("l_discount") * 10).alias("precision"), F.when(~((F.col("l_linestatus") == "F") & (F.col("l_tax") <= 0.01)), F.col("l_tax") * 12.5).alias("recall"),
        F.when(F.col("l_quantity") < 49, (F.col("l_quantity") * 60).cast("bigint")).alias("diff_lines"), labels.clean(F.col("p_brand")).alias("language"),
        labels.domain(_pick(_DOMAINS, F.col("p_size") % 8)).alias("domain"), labels.pr_type(_pick(_TYPES, F.col("p_size") % 7)).alias("pr_type"),
        labels.severity(F.regexp_replace("o_orderpriority", "^[0-9]-", "")).alias("severity"),
    )


FACTS = """
facts AS (SELECT l_orderkey AS pr, l_suppkey AS bot, CASE WHEN l_linenumber <> 7 THEN CAST(l_shipdate AS DATE) END AS day,
 CASE WHEN l_returnflag <> 'N' THEN l_discount * 10 END AS "precision", CASE WHEN NOT (l_linestatus = 'F' AND l_tax <= 0.01) THEN l_tax * 12.5 END AS recall,
 CASE WHEN l_quantity < 49 THEN CAST(l_quantity * 60 AS BIGINT) END AS diff_lines, lower(trim(p_brand)) AS language,
 CASE p_size % 8 WHEN 0 THEN 'frontend' WHEN 1 THEN 'infra' WHEN 2 THEN 'fullstack' WHEN 3 THEN 'docs' WHEN 4 THEN 'backend' WHEN 5 THEN 'other' END AS domain,
 CASE p_size % 7 WHEN 0 THEN 'feature' WHEN 1 THEN 'bugfix' WHEN 2 THEN 'refactor' WHEN 3 THEN 'test' WHEN 4 THEN 'chore' WHEN 5 THEN 'other' END AS pr_type,
 CASE WHEN lower(substr(o_orderpriority, 3)) IN ('low', 'medium', 'high', 'critical') THEN lower(substr(o_orderpriority, 3)) END AS severity
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def bots(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("bot"), F.col("s_name").alias("username"), F.concat(F.lit("Bot "), F.col("s_suppkey").cast("string")).alias("display_name"), (F.col("s_suppkey") % 10 == 0).alias("ignored"))


BOTS = "bots AS (SELECT s_suppkey AS bot, s_name AS username, 'Bot ' || s_suppkey AS display_name, s_suppkey % 10 = 0 AS ignored FROM supplier)"


def raw_events(spark: SparkSession, d: str) -> DataFrame:
    """Archive events: event_id, ts, day, bot, actor, repo, event_type, number (NULL for a tenth)."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, d, "events").select(
        "event_id", "ts", F.to_date("ts").alias("day"), (F.col("user_id") % 15).alias("bot"), F.concat(F.lit("bot"), (F.col("user_id") % 15).cast("string")).alias("actor"),
        F.concat(F.lit("org/repo"), (F.col("user_id") % 7).cast("string")).alias("repo"), "event_type", F.when(k % 10 != 0, k).alias("number"),
        F.concat(F.lit("https://github.com/org/repo"), (F.col("user_id") % 7).cast("string"), F.lit("/pull/"), k.cast("string")).alias("url"), "value",
    )


EVENTS = """
ev AS (SELECT event_id, ts, CAST(ts AS DATE) AS day, user_id % 15 AS bot, 'bot' || (user_id % 15) AS actor, 'org/repo' || (user_id % 7) AS repo, event_type,
 CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 10 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS number,
 'https://github.com/org/repo' || (user_id % 7) || '/pull/' || CAST(json_extract(props, '$.k') AS BIGINT) AS url, value FROM events)"""


def volumes(spark: SparkSession, d: str) -> DataFrame:
    from tallyspark.operators.discovery import first_seen_volume

    return first_seen_volume(raw_events(spark, d))


VOLUMES = """
vol AS (SELECT bot, day, count(*) AS pr_count FROM (SELECT bot, repo, number, min(day) AS day FROM ev WHERE number IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


def prs(spark: SparkSession, d: str) -> DataFrame:
    """One row per pull request: the last delivery, without the event document."""
    rows = table(spark, d, "prs").select("id", "chatbot_id", "repo_name", "pr_number", "pr_url", "pr_title", "pr_author", "pr_merged", "status", "enrichment_step", "diff_lines", "error_message", "discovered_at", "analyzed_at")
    return latest(rows, ["id"], ["discovered_at"])


PRS = "p AS (SELECT * EXCLUDE (rn, bq_events) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY discovered_at DESC, chatbot_id DESC, repo_name DESC) AS rn FROM prs) WHERE rn = 1)"


def analyses(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "llm_analyses").withColumn("precision", F.nanvl("precision", F.lit(None))).withColumn("recall", F.nanvl("recall", F.lit(None))), ["id"], ["analyzed_at"])


ANALYSES = """a AS (SELECT * EXCLUDE (rn) REPLACE (CASE WHEN NOT isnan("precision") THEN "precision" END AS "precision", CASE WHEN NOT isnan(recall) THEN recall END AS recall)
 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY analyzed_at DESC) AS rn FROM llm_analyses) WHERE rn = 1)"""


def timeline(spark: SparkSession, d: str) -> DataFrame:
    """One row per timeline event: the first delivery, with its ingestion time as the ordering time."""
    rows = table(spark, d, "timeline_events").select("event_id", "pr_id", "event_type", "actor", "data", F.col("ingested_at").alias("ts"))
    return rows.groupBy("event_id").agg(F.min(F.struct("ts", "pr_id", "event_type", "actor", "data")).alias("r")).select("event_id", "r.*")


TIMELINE = "tl AS (SELECT event_id, pr_id, event_type, actor, data, ingested_at AS ts FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ingested_at) AS rn FROM timeline_events) WHERE rn = 1)"


def comments(spark: SparkSession, d: str) -> DataFrame:
    """One row per archived message, by its first delivery."""
    rows = table(spark, d, "thread_comments").select("comment_id", "thread_id", "pr_id", "in_reply_to_id", "author", "body", "path", F.col("ingested_at").alias("ts"))
    return rows.groupBy("comment_id").agg(F.min(F.struct("ts", "thread_id", "pr_id", "in_reply_to_id", "author", "body", "path")).alias("r")).select("comment_id", "r.*")


COMMENTS = "tc AS (SELECT comment_id, thread_id, pr_id, in_reply_to_id, author, body, path, ingested_at AS ts FROM (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY ingested_at) AS rn FROM thread_comments) WHERE rn = 1)"


def pr_labels(spark: SparkSession, d: str) -> DataFrame:
    """Label documents of four in five analysed pull requests: ``pr_id, chatbot_id, labels``, written by a rule on their numbers."""
    p = prs(spark, d).where("id % 5 <> 0")
    one = lambda n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("id") % n + 1).cast("int"))
    doc = F.format_string(
        '{"language": %s, "domain": "%s", "pr_type": "%s", "severity": "%s", "tags": ["%s", 7, null]}',
        one(4, '" Python "', '"GO"', "5", '""'), one(3, "Infrastructure", "docs", "games"), one(4, "Bug", "tests", "feature", " "), one(3, "HIGH", " low", "urgent"), one(2, "Big", "SMALL"),
    )
    return p.select(F.col("id").alias("pr_id"), "chatbot_id", F.when(F.col("id") % 7 == 0, '{"language": "Go"').otherwise(doc).alias("labels"))


LABELS = """lb AS (SELECT id AS pr_id, chatbot_id, CASE WHEN id % 7 <> 0 THEN ['python', 'go', NULL, NULL][id % 4 + 1] END AS language, CASE WHEN id % 7 <> 0 THEN ['infra', 'docs', 'other'][id % 3 + 1] END AS domain,
 CASE WHEN id % 7 <> 0 THEN ['bugfix', 'test', 'feature', NULL][id % 4 + 1] END AS pr_type, CASE WHEN id % 7 <> 0 THEN ['high', 'low', NULL][id % 3 + 1] END AS severity FROM p WHERE id % 5 <> 0)"""
