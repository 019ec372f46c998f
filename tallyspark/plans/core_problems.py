"""Queries of the core operators for training-data preparation (problems 1, 2 and 4) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import flatten, timestamps
from tallyspark.operators.tree_aggregate import heavy_keys, normal_repo, tree_aggregate
from tallyspark.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    prs = table(spark, d, "prs")
    return heavy_keys(prs, {"chatbot_id": F.col("chatbot_id"), "repo_name": normal_repo(F.col("repo_name"))})


_P1_STATES = [("n_rows", "count", None), ("n_sized", "count", F.col), ("diff_sum", "sum", F.col), ("diff_min", "min", F.col), ("diff_max", "max", F.col)]


def _p1_states():
    return [(n, k, None if c is None else c("diff_lines")) for n, k, c in _P1_STATES] + [("n_merged", "count", F.when(F.col("pr_merged"), 1))]


def p1_bot_figures(spark: SparkSession, d: str) -> DataFrame:
    return tree_aggregate(table(spark, d, "prs"), ["chatbot_id"], _p1_states())


def p1_repo_figures(spark: SparkSession, d: str) -> DataFrame:
    prs = table(spark, d, "prs").withColumn("repo_key", normal_repo(F.col("repo_name")))
    return tree_aggregate(prs, ["repo_key"], _p1_states())


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return flatten.child_links(table(spark, d, "prs"), table(spark, d, "timeline_events"), table(spark, d, "review_threads"))


def p2_events(spark: SparkSession, d: str) -> DataFrame:
    return flatten.event_table(table(spark, d, "prs"))


def p2_labels(spark: SparkSession, d: str) -> DataFrame:
    return flatten.label_table(table(spark, d, "prs"))


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    return flatten.file_table(table(spark, d, "timeline_events"))


def p2_reactions(spark: SparkSession, d: str) -> DataFrame:
    return flatten.reaction_table(table(spark, d, "review_threads"))


def p2_reviews(spark: SparkSession, d: str) -> DataFrame:
    return flatten.review_table(table(spark, d, "prs"))


def p2_comments(spark: SparkSession, d: str) -> DataFrame:
    return flatten.comment_table(table(spark, d, "prs"))


def p2_thread_comments(spark: SparkSession, d: str) -> DataFrame:
    return flatten.thread_comment_table(table(spark, d, "review_threads"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.stamp_instants(table(spark, d, "prs"), table(spark, d, "timeline_events"), table(spark, d, "collector_zones"))


def p4_zone_estimates(spark: SparkSession, d: str) -> DataFrame:
    stamps = timestamps.bot_stamps(table(spark, d, "prs"), table(spark, d, "timeline_events"))
    return timestamps.resolve_zones(stamps, table(spark, d, "collector_zones"))


QUERIES = {
    "p1_found": p1_found, "p1_bot_figures": p1_bot_figures, "p1_repo_figures": p1_repo_figures,
    "p2_found": p2_found, "p2_events": p2_events, "p2_labels": p2_labels, "p2_files": p2_files, "p2_reactions": p2_reactions,
    "p2_reviews": p2_reviews, "p2_comments": p2_comments, "p2_thread_comments": p2_thread_comments,
    "p4_found": p4_found, "p4_zone_estimates": p4_zone_estimates,
}

_FIGURES = """count(*) AS n_rows, count(diff_lines) AS n_sized, CAST(sum(diff_lines) AS BIGINT) AS diff_sum,
 min(diff_lines) AS diff_min, max(diff_lines) AS diff_max, count(CASE WHEN pr_merged THEN 1 END) AS n_merged"""
_REPO = r"regexp_replace(lower(trim(repo_name)), '\.git$', '')"

#: Events of a pull request from whatever form holds them: every value is a JSON text; a string is opened up to twice.
_JSON = "CASE WHEN json_valid({0}) AND json_type({0}) = 'VARCHAR' THEN json_extract_string({0}, '$') ELSE {0} END"
_OK = "CASE WHEN json_valid({0}) THEN {0} END"
_EVS = f"""
r0 AS (SELECT id AS pr_id, bq_events AS raw, {_OK.format("bq_events")} AS j FROM (SELECT DISTINCT id, bq_events FROM prs)),
r1 AS (SELECT pr_id, raw, j IS NOT NULL AS whole, {_OK.format("k")} AS j FROM (SELECT *, {_JSON.format("j")} AS k FROM r0)),
r2 AS (SELECT pr_id, raw, whole, {_OK.format("k")} AS j FROM (SELECT *, {_JSON.format("j")} AS k FROM r1)),
ln AS (SELECT pr_id, list_filter(regexp_split_to_array(raw, '\\r?\\n'), lambda x: trim(x) <> '') AS l FROM r2 WHERE NOT whole),
vs AS (SELECT pr_id, CASE WHEN json_type(j) = 'ARRAY' THEN CAST(j AS JSON[]) WHEN json_type(j, '$.events') = 'ARRAY' THEN CAST(json_extract(j, '$.events') AS JSON[]) WHEN json_extract(j, '$.event_id') IS NOT NULL THEN [CAST(j AS JSON)] END AS v FROM r2 WHERE whole
 UNION ALL SELECT pr_id, CAST(l AS JSON[]) FROM ln WHERE len(list_filter(l, lambda x: NOT json_valid(x))) = 0),
ex AS (SELECT pr_id, unnest(v) AS e, unnest(range(len(v))) AS ix FROM vs),
ey AS (SELECT pr_id, ix, CASE WHEN json_type(e) = 'VARCHAR' THEN {_OK.format("json_extract_string(e, '$')")} ELSE e END AS e FROM ex),
ez AS (SELECT pr_id, ix, e, json_extract_string(e, '$.event_id') AS event_id, json_extract(e, '$.payload') AS p FROM ey),
ev AS (SELECT pr_id, ix, row_number() OVER (PARTITION BY pr_id, event_id IS NULL ORDER BY ix) - 1 AS fix, event_id, e, CASE WHEN json_type(p) = 'VARCHAR' THEN {_OK.format("json_extract_string(p, '$')")} ELSE p END AS p FROM ez)"""


P2_EVENTS = _EVS
#: Entries of the file lists of timeline rows: ``f3(pr_id, event_id, f, ix, file_name)``.
P2_FILES = f"""d0 AS (SELECT DISTINCT pr_id, event_id, {_OK.format("data")} AS j FROM timeline_events), d1 AS (SELECT pr_id, event_id, {_OK.format("k")} AS j FROM (SELECT *, {_JSON.format("j")} AS k FROM d0)),
f0 AS (SELECT pr_id, event_id, json_extract(j, '$.files_detail') AS k FROM d1), f1 AS (SELECT pr_id, event_id, {_OK.format("k")} AS k FROM (SELECT pr_id, event_id, {_JSON.format("k")} AS k FROM f0)),
f2 AS (SELECT pr_id, event_id, CASE WHEN json_type(k) = 'ARRAY' THEN CAST(k AS JSON[]) WHEN json_extract(k, '$.filename') IS NOT NULL THEN [CAST(k AS JSON)] WHEN json_type(k) = 'OBJECT' THEN list_transform(json_keys(k), lambda n: json_extract(k, '$."' || n || '"')) END AS fs,
 CASE WHEN json_type(k) = 'OBJECT' AND json_extract(k, '$.filename') IS NULL THEN json_keys(k) END AS ns FROM f1),
f3 AS (SELECT pr_id, event_id, unnest(fs) AS f, unnest(range(len(fs))) AS ix, unnest(coalesce(ns, list_transform(fs, lambda x: CASE WHEN json_type(x) = 'VARCHAR' THEN json_extract_string(x, '$') ELSE json_extract_string(x, '$.filename') END))) AS file_name FROM f2 WHERE fs IS NOT NULL)"""


def _payload_sql(part: str, texts: tuple[str, ...], numbers: tuple[str, ...] = ()) -> str:
    cols = [f"json_extract_string(p, '$.{part}.{n}') AS {n}" for n in texts] + [f"CAST(json_extract_string(p, '$.{part}.{n}') AS BIGINT) AS {n}" for n in numbers]
    picked = "CAST(fix AS INTEGER) AS event_ix, " + ", ".join([*texts, *numbers])
    return f"""WITH {_EVS}, x AS (SELECT DISTINCT pr_id, fix, event_id, json_extract_string(p, '$.{part}.id') AS {part}_id, {", ".join(cols)} FROM ev WHERE event_id IS NOT NULL AND json_extract_string(p, '$.{part}.id') IS NOT NULL)
SELECT pr_id, event_id, {part}_id, {picked} FROM (SELECT *, row_number() OVER (PARTITION BY pr_id, event_id, {part}_id ORDER BY fix) AS rn FROM x) WHERE rn = 1"""


_LINKS = f"""WITH {_EVS}, {P2_FILES}, l0 AS (SELECT pr_id, event_id, CASE WHEN json_type(p, '$.pull_request.labels') = 'ARRAY' THEN CAST(json_extract(p, '$.pull_request.labels') AS JSON[]) WHEN json_type(p, '$.pull_request.labels.nodes') = 'ARRAY' THEN CAST(json_extract(p, '$.pull_request.labels.nodes') AS JSON[]) END AS ls FROM ev WHERE event_id IS NOT NULL),
l1 AS (SELECT pr_id, event_id, unnest(ls) AS x FROM l0), th AS (SELECT pr_id, thread_id, unnest(comments) AS c FROM review_threads), re AS (SELECT pr_id, c.id AS id, unnest(map_entries(c.reactions)) AS e FROM th),
k AS (SELECT pr_id, CAST(pr_id AS VARCHAR) AS parent_id, 'event' AS child_kind, event_id AS child_id FROM ev
 UNION ALL SELECT pr_id, event_id, 'review', json_extract_string(p, '$.review.id') FROM ev UNION ALL SELECT pr_id, event_id, 'comment', json_extract_string(p, '$.comment.id') FROM ev
 UNION ALL SELECT pr_id, event_id, 'label', CASE WHEN json_type(x) = 'VARCHAR' THEN json_extract_string(x, '$') ELSE json_extract_string(x, '$.name') END FROM l1
 UNION ALL SELECT pr_id, CAST(event_id AS VARCHAR), 'file', file_name FROM f3 UNION ALL SELECT pr_id, thread_id, 'thread_comment', CAST(c.id AS VARCHAR) FROM th UNION ALL SELECT pr_id, CAST(id AS VARCHAR), 'reaction', e.key FROM re WHERE e.value > 0)"""

SQL = {
    "p2_found": f"{_LINKS} SELECT DISTINCT * FROM k WHERE parent_id IS NOT NULL AND child_id IS NOT NULL",
    "p2_events": f"""WITH {_EVS}
SELECT pr_id, CAST(min(ix) AS INTEGER) AS event_ix, event_id, any_value(json_extract_string(e, '$.type')) AS type, any_value(json_extract_string(e, '$.actor')) AS actor, any_value(json_extract_string(e, '$.created_at')) AS created_at,
 any_value(CAST(coalesce(json_extract_string(e, '$.pr_number'), json_extract_string(p, '$.pull_request.number'), json_extract_string(p, '$.issue.number')) AS BIGINT)) AS pr_number FROM ev WHERE event_id IS NOT NULL GROUP BY pr_id, event_id""",
    "p2_labels": f"""WITH {_EVS}, l0 AS (SELECT pr_id, ix, event_id, CASE WHEN json_type(p, '$.pull_request.labels') = 'ARRAY' THEN CAST(json_extract(p, '$.pull_request.labels') AS JSON[]) WHEN json_type(p, '$.pull_request.labels.nodes') = 'ARRAY' THEN CAST(json_extract(p, '$.pull_request.labels.nodes') AS JSON[]) END AS ls FROM ev WHERE event_id IS NOT NULL),
l1 AS (SELECT pr_id, ix, event_id, unnest(ls) AS x, unnest(range(len(ls))) AS label_ix FROM l0), l2 AS (SELECT *, CASE WHEN json_type(x) = 'VARCHAR' THEN json_extract_string(x, '$') ELSE json_extract_string(x, '$.name') END AS label FROM l1)
SELECT pr_id, CAST(min(ix) AS INTEGER) AS event_ix, event_id, CAST(arg_min(label_ix, (ix, label_ix)) AS INTEGER) AS label_ix, label FROM l2 WHERE label IS NOT NULL GROUP BY pr_id, event_id, label""",
    "p2_files": f"""WITH {P2_FILES}
SELECT pr_id, event_id, CAST(ix AS INTEGER) AS file_ix, file_name, json_extract_string(f, '$.status') AS status, TRY_CAST(json_extract_string(f, '$.additions') AS BIGINT) AS additions, TRY_CAST(json_extract_string(f, '$.deletions') AS BIGINT) AS deletions
FROM (SELECT *, row_number() OVER (PARTITION BY pr_id, event_id, file_name ORDER BY ix) AS rn FROM f3 WHERE file_name IS NOT NULL) WHERE rn = 1""",
    "p2_reviews": _payload_sql("review", ("state", "body", "commit_id")),
    "p2_comments": _payload_sql("comment", ("body", "path"), ("line",)),
    "p2_thread_comments": """WITH c AS (SELECT pr_id, thread_id, unnest(comments) AS c, unnest(range(len(comments))) AS ix FROM review_threads)
SELECT pr_id, thread_id, CAST(ix AS INTEGER) AS comment_ix, c.id AS comment_id, c.body AS body, c.path AS path, c.line AS line, c.original_line AS original_line, c.diff_hunk AS diff_hunk, c.author AS author, c.created_at AS created_at,
 CAST(coalesce(len(list_filter(map_values(c.reactions), lambda n: n > 0)), 0) AS INTEGER) AS n_reactions
FROM (SELECT *, row_number() OVER (PARTITION BY pr_id, thread_id, c.id ORDER BY ix) AS rn FROM c WHERE c.id IS NOT NULL) WHERE rn = 1""",
    "p1_found": f"""
WITH k AS (SELECT 'chatbot_id' AS field_name, CAST(chatbot_id AS VARCHAR) AS key_value FROM prs
           UNION ALL SELECT 'repo_name', {_REPO} FROM prs)
SELECT field_name, key_value FROM k WHERE key_value IS NOT NULL GROUP BY 1, 2
HAVING count(*) * 50 >= (SELECT count(*) FROM prs)""",
    "p1_bot_figures": f"SELECT chatbot_id, {_FIGURES} FROM prs GROUP BY 1",
    "p1_repo_figures": f"SELECT {_REPO} AS repo_key, {_FIGURES} FROM prs GROUP BY 1",
    "p2_reactions": """
WITH c AS (SELECT pr_id, thread_id, unnest(comments) AS c, unnest(range(len(comments))) AS comment_ix FROM review_threads),
r AS (SELECT pr_id, thread_id, comment_ix, c.id AS comment_id, unnest(map_entries(c.reactions)) AS e FROM c)
SELECT pr_id, thread_id, CAST(min(comment_ix) AS INTEGER) AS comment_ix, comment_id, e.key AS reaction, max(e.value) AS n
FROM r WHERE e.value > 0 AND comment_id IS NOT NULL GROUP BY 1, 2, 4, 5""",
}
