"""Queries of the serving surface."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import labels
from tallyspark.functions.scores import f_beta
from tallyspark.operators import filters, metrics
from tallyspark.operators import lifecycle as life
from tallyspark.operators.filters import FilterSpec, apply_filters, spec_from_query
from tallyspark.plans import views as v
from tallyspark.session import ensure_checkpoint_dir
from tallyspark.sources.tables import read_version, table, write_version

FILTERED = FilterSpec(start=date(1995, 1, 1), end=date(1996, 12, 31), domains=("frontend", "infra", "other"), severities=("high", "medium"), diff_min=300, diff_max=2000, beta=1.0)
_FILTER_SQL = """day BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND domain IN ('frontend', 'infra', 'other') AND severity IN ('high', 'medium')
 AND (diff_lines IS NULL OR diff_lines BETWEEN 300 AND 2000)"""


def _found(spark, d, spec):
    return apply_filters(v.facts(spark, d), v.bots(spark, d), v.volumes(spark, d), spec)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _board(spec):
    return lambda spark, d: _rounded(metrics.leaderboard(_found(spark, d, spec)), "precision", "recall", "f_score")


def _daily(spec):
    return lambda spark, d: _rounded(metrics.daily_metrics(_found(spark, d, spec)), "avg_precision", "avg_recall", "avg_f_beta")


def daily_mean_f_vs_f_of_means(spark, d):
    return _rounded(metrics.mean_f_and_f_of_means(v.facts(spark, d)), "mean_f", "f_of_means")


def volumes_zero_fill(spark, d):
    return metrics.volume_series(v.volumes(spark, d), v.bots(spark, d).where("not ignored"), FilterSpec(start=date(2024, 1, 5), end=date(2024, 1, 20)))


def volume_totals(spark, d):
    return filters.volume_totals(v.volumes(spark, d), FilterSpec(end=date(2024, 1, 20)))


def eligible_bots_min_total(spark, d):
    return _found(spark, d, FilterSpec(min_total=40, include_ignored=True)).bots.select("bot", "username")


def filter_options_long(spark, d):
    return metrics.options_long(v.facts(spark, d))


def filter_options(spark, d):
    wide = metrics.filter_options(v.facts(spark, d), v.bots(spark, d))
    return wide.select(*[F.array_join(c, ",").alias(c) for c in ("languages", "domains", "pr_types", "severitys", "chatbots")], "first_day", "last_day")


def date_bounds(spark, d):
    return metrics.date_bounds(v.facts(spark, d))


def label_normalise(spark, d):
    raw = table(spark, d, "part").select("p_partkey", F.to_json(F.struct(
        F.col("p_brand").alias("language"), F.when(F.col("p_size") % 3 == 0, "Infrastructure").when(F.col("p_size") % 3 == 1, "docs ").alias("domain"),
        F.when(F.col("p_size") % 4 == 0, "Bug").when(F.col("p_size") % 4 == 1, "strange").alias("pr_type"), F.when(F.col("p_size") % 2 == 0, " HIGH").otherwise("urgent").alias("severity"), F.col("p_size").alias("size"))).alias("doc"))
    parsed = labels.parsed_labels(F.col("doc"))
    return raw.select("p_partkey", *[c.alias(n) for n, c in parsed.items()], labels.string_field(F.col("doc"), "size").alias("size_label"))


def status_counts(spark, d):
    bots = table(spark, d, "chatbots").select(F.col("id").alias("bot"), F.col("github_username").alias("username"))
    return metrics.status_counts(v.prs(spark, d).withColumnRenamed("chatbot_id", "bot"), bots)


def bot_scatter(spark, d):
    a = v.analyses(spark, d).where("precision is not null and recall is not null")
    m = a.groupBy("chatbot_id").agg(F.avg(F.col("precision").cast("double")).alias("p"), F.avg(F.col("recall").cast("double")).alias("r"), F.count(F.lit(1)).alias("n"))
    return _rounded(m.select("chatbot_id", "p", "r", f_beta(F.col("p"), F.col("r")).alias("f"), "n"), "p", "r", "f")


def _labelled(spark, d):
    """Analyses with their pull request, bot and labels: the joins behind every served figure; an analysis without labels stays."""
    bots = table(spark, d, "chatbots").select(F.col("id").alias("chatbot_id"), "github_username")
    p = v.prs(spark, d).select(F.col("id").alias("pr_id"), "repo_name", "pr_number", "pr_url", "status", "diff_lines", F.col("discovered_at").alias("reviewed_at"))
    rows = v.analyses(spark, d).join(p, "pr_id").join(F.broadcast(bots), "chatbot_id")
    parsed = labels.parsed_labels(F.col("labels"))
    return rows.join(v.pr_labels(spark, d), ["pr_id", "chatbot_id"], "left").withColumns({n: c for n, c in parsed.items()})


def analysis_facts(spark, d):
    keys = ["github_username", "status", "domain", "severity"]
    return _labelled(spark, d).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("precision").alias("n_precision"), F.count("language").alias("n_language"), F.sum("total_bot_comments").alias("comments"), F.sum("diff_lines").alias("diff_lines"))


def labelled_facts(spark, d):
    return _labelled(spark, d).select("id", "pr_id", "chatbot_id", "language", "domain", "pr_type", "severity")


def detail_table(spark, d):
    """The sixteen columns of the analysis table; a missing label is empty text."""
    shown = {f"label_{n}": labels.display_label(F.col("labels"), n) for n in ("language", "domain", "pr_type", "severity")}
    rows = _labelled(spark, d).withColumns(shown)
    figures = [F.round(F.col(c).cast("double"), 4).alias(c) for c in ("precision", "recall", "f_beta")]
    return rows.select("github_username", "repo_name", "pr_number", "pr_url", "diff_lines", "total_bot_comments", "matched_bot_comments", *figures, *shown, "model_name", F.date_format("analyzed_at", "yyyy-MM-dd HH:mm:ss").alias("analyzed_at"))


def labels_lowered(spark, d):
    low = F.col("low")
    rows = v.pr_labels(spark, d).select("pr_id", labels.lowered(F.col("labels")).alias("low"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return rows.select("pr_id", *[text(F.try_element_at(low, F.lit(n))).alias(n) for n in ("language", "domain", "severity")], text(F.try_variant_get(F.try_element_at(low, F.lit("tags")), "$[0]", "string")).alias("tag"))


def status_counts_filtered(spark, d):
    """Status counts of the pull requests whose labels pass a filter; unlabelled ones do not."""
    p = v.prs(spark, d).join(v.pr_labels(spark, d).select(F.col("pr_id").alias("id"), "labels"), "id", "left").withColumns(labels.parsed_labels(F.col("labels")))
    return p.where(filters.dims_match({"domain": ["infra", "docs"], "severity": ["high"]})).groupBy("chatbot_id", "status").agg(F.count(F.lit(1)).alias("n"))


def analyses_newest_first(spark, d):
    return v.analyses(spark, d).orderBy(F.desc("analyzed_at"), "id").limit(150).select("id", "pr_id", "model_name")


def bot_order(spark, d):
    """Bots numbered by first appearance in load order: rows without a review time come first, then by time."""
    rows = _labelled(spark, d).groupBy("github_username").agg(F.min(F.struct(F.col("reviewed_at").isNotNull().alias("dated"), "reviewed_at", "id")).alias("first"))
    return rows.select("github_username", (F.row_number().over(Window.orderBy("first")) - 1).alias("position"))  # one row per bot


def load_order(spark, d):
    return v.analyses(spark, d).join(v.prs(spark, d).select(F.col("id").alias("pr_id"), F.when(F.col("id") % 50 != 0, F.col("discovered_at")).alias("reviewed_at")), "pr_id").orderBy(F.asc_nulls_first("reviewed_at"), "id").limit(120).select("id", "pr_id")


def client_sort(spark, d):
    return metrics.sorted_metrics(_board(FilterSpec())(spark, d), "sampled_prs").limit(25)


def first_repo_per_tool(spark, d):
    """Test mode: the first repository of each tool by name, three tools."""
    first = v.prs(spark, d).groupBy("chatbot_id").agg(F.min("repo_name").alias("repo_name"))
    return first.orderBy("chatbot_id").limit(3)


def labels_upsert(spark, d):
    """Labels written again for even pull requests replace the old ones."""
    old = v.pr_labels(spark, d).withColumn("labeled_at", F.lit("2025-01-01").cast("timestamp_ntz"))
    new = old.where("pr_id % 2 = 0").withColumns({"labels": F.lit("{}"), "labeled_at": F.lit("2025-02-01").cast("timestamp_ntz")})
    return life.upsert(old, new, ["pr_id", "chatbot_id"], ["labeled_at"]).select("pr_id", "chatbot_id", F.col("labels").eqNullSafe("{}").alias("replaced"))


def volumes_upsert(spark, d):
    """Volumes of a later run replace those of the same bot and day and add the others."""
    all_ = v.volumes(spark, d).withColumn("created_at", F.lit(1))
    return life.upsert(all_.where("day < DATE '2024-01-20'"), all_.where("day > DATE '2024-01-10'").withColumns({"pr_count": F.col("pr_count") + 1, "created_at": F.lit(2)}), ["bot", "day"], ["created_at"]).select("bot", "day", "pr_count")


def analysed_status(spark, d):
    """Saving an analysis moves its pull request to ``analyzed``."""
    done = table(spark, d, "llm_analyses").select(F.col("pr_id").alias("id")).distinct().withColumn("status", F.lit("analyzed"))
    return life.update_columns(v.prs(spark, d).select("id", "status"), done, ["id"], ["status"])


def version_swap(spark, d):
    """A table replaced as a whole is read back from its new version."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/versions-{uuid.uuid4().hex}"
    write_version(table(spark, d, "chatbots").limit(0).select("id", "github_username"), root, "bots")
    write_version(table(spark, d, "chatbots").select("id", "github_username"), root, "bots")
    return read_version(spark, root, "bots")


def size_filter_dashboard(spark, d):
    f = v.facts(spark, d)
    modes = {"default": filters.dashboard_size_ok(0, 2000, False), "above": filters.dashboard_size_ok(500, 1500, True), "inside": filters.dashboard_size_ok(500, 1500, False)}
    kept = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in modes.items()]), lambda x: x.isNotNull())
    return f.select("pr", "bot", F.explode(kept).alias("mode")).groupBy("mode", "pr", "bot").agg(F.count(F.lit(1)).alias("n"))


def request_filter(spark, d):
    spec = spec_from_query({"start_date": "1993-01-01", "end_date": "bad", "chatbot": "supplier#000000003, bot 5,supplier#000000010,Bot 12", "severity": "unknown", "domain": "infrastructure,zzz", "include_ignored": "true"})
    return _found(spark, d, spec).facts.select("username", "pr", "day", "domain", "severity")


QUERIES = {
    "leaderboard_all": _board(FilterSpec()), "leaderboard_filtered": _board(FILTERED), "leaderboard_min_day": _board(FilterSpec(min_per_day=2)),
    "leaderboard_beta2": _board(FilterSpec(beta=2.0, include_ignored=True)),
    "daily_metrics": _daily(FilterSpec()), "daily_metrics_min_day": _daily(FilterSpec(min_per_day=2, beta=0.5)), "daily_filtered": _daily(FILTERED),
    "daily_mean_f_vs_f_of_means": daily_mean_f_vs_f_of_means, "volumes_zero_fill": volumes_zero_fill, "volume_totals": volume_totals, "eligible_bots_min_total": eligible_bots_min_total,
    "filter_options_long": filter_options_long, "filter_options": filter_options, "date_bounds": date_bounds, "label_normalise": label_normalise, "status_counts": status_counts,
    "labelled_facts": labelled_facts, "detail_table": detail_table, "labels_lowered": labels_lowered, "status_counts_filtered": status_counts_filtered, "analyses_newest_first": analyses_newest_first, "bot_order": bot_order,
    "load_order": load_order, "client_sort": client_sort, "first_repo_per_tool": first_repo_per_tool, "labels_upsert": labels_upsert, "volumes_upsert": volumes_upsert, "analysed_status": analysed_status, "version_swap": version_swap,
    "bot_scatter": bot_scatter, "analysis_facts": analysis_facts, "size_filter_dashboard": size_filter_dashboard, "request_filter": request_filter,
}

_WITH = f"WITH {v.FACTS}, {v.BOTS}, {v.EVENTS}, {v.VOLUMES}"


def _f(p: str, r: str, beta: float) -> str:
    b2 = beta * beta
    return f"CASE WHEN {b2} * {p} + {r} > 0 THEN round((1 + {b2}) * {p} * {r} / ({b2} * {p} + {r}), 6) END"


def _board_sql(where: str, beta: float = 1.0, least: int = 0) -> str:
    return f"""{_WITH},
k AS (SELECT f.*, username FROM facts f JOIN bots b USING (bot) WHERE day IS NOT NULL AND {where}),
g AS (SELECT bot, username, day, count(*) AS rows, count(CASE WHEN "precision" IS NOT NULL AND recall IS NOT NULL THEN 1 END) AS n,
 sum(CASE WHEN recall IS NOT NULL THEN "precision" END) AS p, sum(CASE WHEN "precision" IS NOT NULL THEN recall END) AS r FROM k GROUP BY 1, 2, 3),
s AS (SELECT bot, username, sum(rows) AS sampled, coalesce(sum(CASE WHEN n >= {least} THEN n END), 0) AS scored, sum(CASE WHEN n >= {least} THEN p END) AS sp, sum(CASE WHEN n >= {least} THEN r END) AS sr FROM g GROUP BY 1, 2),
t AS (SELECT bot, sum(pr_count) AS total FROM vol GROUP BY 1),
m AS (SELECT s.*, sp / nullif(scored, 0) AS ap, sr / nullif(scored, 0) AS ar FROM s)
SELECT username AS chatbot, round(coalesce(ap, 0.0), 6) AS "precision", round(coalesce(ar, 0.0), 6) AS recall, {_f("ap", "ar", beta)} AS f_score,
 CAST(sampled AS BIGINT) AS sampled_prs, CAST(scored AS BIGINT) AS scored_prs, CAST(coalesce(total, 0) AS BIGINT) AS total_prs FROM m LEFT JOIN t USING (bot)"""


def _daily_sql(where: str, beta: float = 1.0, least: int = 0) -> str:
    return f"""{_WITH}
SELECT day, username AS chatbot, round(avg("precision"), 6) AS avg_precision, round(coalesce(avg(recall), 0.0), 6) AS avg_recall, {_f('avg("precision")', "avg(recall)", beta)} AS avg_f_beta, count(*) AS pr_count
FROM facts JOIN bots USING (bot) WHERE "precision" IS NOT NULL AND day IS NOT NULL AND {where} GROUP BY 1, 2 HAVING count(*) >= {least}"""


SQL = {
    "client_sort": _board_sql("NOT ignored") + " ORDER BY sampled_prs DESC NULLS LAST, chatbot LIMIT 25",
    "leaderboard_all": _board_sql("NOT ignored"),
    "leaderboard_filtered": _board_sql(f"NOT ignored AND {_FILTER_SQL}").replace("FROM vol GROUP", "FROM vol WHERE day BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' GROUP"),
    "leaderboard_min_day": _board_sql("NOT ignored", least=2),
    "leaderboard_beta2": _board_sql("true", beta=2.0),
    "daily_metrics": _daily_sql("NOT ignored"),
    "daily_metrics_min_day": _daily_sql("NOT ignored", 0.5, 2),
    "daily_filtered": _daily_sql(f"NOT ignored AND {_FILTER_SQL}"),
    "daily_mean_f_vs_f_of_means": f"""{_WITH}
SELECT day, bot, round(avg({_f('"precision"', "recall", 1.0).replace("round(", "(").replace(", 6)", ")")}), 6) AS mean_f, {_f('avg("precision")', "avg(recall)", 1.0)} AS f_of_means, count(*) AS n
FROM facts WHERE day IS NOT NULL GROUP BY 1, 2""",
    "volumes_zero_fill": f"""{_WITH},
i AS (SELECT vol.* FROM vol JOIN bots USING (bot) WHERE NOT ignored AND day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'),
c AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-20', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT c.day, b.bot, coalesce(pr_count, 0) AS pr_count FROM c CROSS JOIN (SELECT DISTINCT bot FROM i) b LEFT JOIN i ON i.bot = b.bot AND i.day = c.day""",
    "volume_totals": f"{_WITH} SELECT bot, CAST(sum(pr_count) AS BIGINT) AS total_prs FROM vol WHERE day <= DATE '2024-01-20' GROUP BY 1",
    "eligible_bots_min_total": f"{_WITH} SELECT bot, username FROM bots LEFT JOIN (SELECT bot, sum(pr_count) AS t FROM vol GROUP BY 1) USING (bot) WHERE coalesce(t, 0) >= 40",
    "filter_options_long": f"""{_WITH}, u AS (SELECT 'language' AS dim, language AS value FROM facts UNION ALL SELECT 'domain', domain FROM facts UNION ALL SELECT 'pr_type', pr_type FROM facts UNION ALL SELECT 'severity', severity FROM facts)
SELECT dim, value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY 1, 2 HAVING dim <> 'language' OR count(*) >= 5""",
    "filter_options": f"""{_WITH}
SELECT (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT language AS x FROM facts WHERE language IS NOT NULL GROUP BY 1 HAVING count(*) >= 5)) AS languages,
 (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT domain AS x FROM facts WHERE domain IS NOT NULL)) AS domains, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT pr_type AS x FROM facts WHERE pr_type IS NOT NULL)) AS pr_types,
 (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT severity AS x FROM facts WHERE severity IS NOT NULL)) AS severitys,
 (SELECT string_agg(username, ',' ORDER BY username) FROM bots WHERE NOT ignored AND bot IN (SELECT bot FROM facts)) AS chatbots, (SELECT min(day) FROM facts) AS first_day, (SELECT max(day) FROM facts) AS last_day""",
    "date_bounds": f"{_WITH} SELECT min(day) AS first_day, max(day) AS last_day, count(day) AS dated, count(*) - count(day) AS undated FROM facts",
    "label_normalise": """SELECT p_partkey, lower(trim(p_brand)) AS language, CASE p_size % 3 WHEN 0 THEN 'infra' WHEN 1 THEN 'docs' END AS domain, CASE p_size % 4 WHEN 0 THEN 'bugfix' WHEN 1 THEN 'other' END AS pr_type,
 CASE WHEN p_size % 2 = 0 THEN 'high' END AS severity, CAST(NULL AS VARCHAR) AS size_label FROM part""",
    "status_counts": "SELECT github_username AS username, status, count(DISTINCT p.id) AS n FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY discovered_at DESC) AS rn FROM prs) WHERE rn = 1) p JOIN chatbots c ON p.chatbot_id = c.id GROUP BY 1, 2",
    "bot_scatter": f"""WITH {v.ANALYSES} SELECT chatbot_id, round(avg(CAST("precision" AS DOUBLE)), 6) AS p, round(avg(CAST(recall AS DOUBLE)), 6) AS r, {_f('avg(CAST("precision" AS DOUBLE))', "avg(CAST(recall AS DOUBLE))", 1.0)} AS f, count(*) AS n
FROM a WHERE "precision" IS NOT NULL AND recall IS NOT NULL GROUP BY 1""",
    "analysis_facts": f"""WITH {v.PRS}, {v.ANALYSES}, {v.LABELS}, x AS (SELECT a.*, github_username, repo_name, pr_number, pr_url, p.status, diff_lines, p.discovered_at AS reviewed_at, language, domain, pr_type, severity, lb.pr_id IS NOT NULL AS has FROM a JOIN p ON a.pr_id = p.id JOIN chatbots c ON a.chatbot_id = c.id LEFT JOIN lb ON lb.pr_id = a.pr_id AND lb.chatbot_id = a.chatbot_id) SELECT github_username, status, domain, severity, count(*) AS n, count("precision") AS n_precision, count(language) AS n_language, CAST(sum(total_bot_comments) AS BIGINT) AS comments, CAST(sum(diff_lines) AS BIGINT) AS diff_lines FROM x GROUP BY 1, 2, 3, 4""",
    "size_filter_dashboard": f"""{_WITH} SELECT 'default' AS mode, pr, bot, count(*) AS n FROM facts WHERE diff_lines IS NULL OR diff_lines BETWEEN 0 AND 2000 GROUP BY 2, 3
UNION ALL SELECT 'above', pr, bot, count(*) FROM facts WHERE diff_lines >= 500 GROUP BY 2, 3 UNION ALL SELECT 'inside', pr, bot, count(*) FROM facts WHERE diff_lines BETWEEN 500 AND 1500 GROUP BY 2, 3""",
    "request_filter": f"""{_WITH} SELECT username, pr, day, domain, severity FROM facts JOIN bots USING (bot)
WHERE day >= DATE '1993-01-01' AND (lower(username) IN ('supplier#000000003', 'supplier#000000010') OR lower(display_name) IN ('bot 5', 'bot 12')) AND domain IN ('infra', 'other')""",
    "labelled_facts": f"""WITH {v.PRS}, {v.ANALYSES}, {v.LABELS}, x AS (SELECT a.*, github_username, repo_name, pr_number, pr_url, p.status, diff_lines, p.discovered_at AS reviewed_at, language, domain, pr_type, severity, lb.pr_id IS NOT NULL AS has FROM a JOIN p ON a.pr_id = p.id JOIN chatbots c ON a.chatbot_id = c.id LEFT JOIN lb ON lb.pr_id = a.pr_id AND lb.chatbot_id = a.chatbot_id) SELECT id, pr_id, chatbot_id, language, domain, pr_type, severity FROM x""",
    "detail_table": f"""WITH {v.PRS}, {v.ANALYSES}, {v.LABELS}, x AS (SELECT a.*, github_username, repo_name, pr_number, pr_url, p.status, diff_lines, p.discovered_at AS reviewed_at, language, domain, pr_type, severity, lb.pr_id IS NOT NULL AS has FROM a JOIN p ON a.pr_id = p.id JOIN chatbots c ON a.chatbot_id = c.id LEFT JOIN lb ON lb.pr_id = a.pr_id AND lb.chatbot_id = a.chatbot_id) SELECT github_username, repo_name, pr_number, pr_url, diff_lines, total_bot_comments, matched_bot_comments, round(CAST("precision" AS DOUBLE), 4) AS "precision", round(CAST(recall AS DOUBLE), 4) AS recall, round(CAST(f_beta AS DOUBLE), 4) AS f_beta,
 CASE WHEN has AND pr_id % 7 <> 0 THEN [' python ', 'go', '', ''][pr_id % 4 + 1] ELSE '' END AS label_language, CASE WHEN has AND pr_id % 7 <> 0 THEN ['infrastructure', 'docs', 'games'][pr_id % 3 + 1] ELSE '' END AS label_domain,
 CASE WHEN has AND pr_id % 7 <> 0 THEN ['bug', 'tests', 'feature', ' '][pr_id % 4 + 1] ELSE '' END AS label_pr_type, CASE WHEN has AND pr_id % 7 <> 0 THEN ['high', ' low', 'urgent'][pr_id % 3 + 1] ELSE '' END AS label_severity, model_name, strftime(analyzed_at, '%Y-%m-%d %H:%M:%S') AS analyzed_at FROM x""",
    "labels_lowered": f"""WITH {v.PRS} SELECT id AS pr_id, CASE WHEN id % 7 <> 0 THEN [' python ', 'go', '5', ''][id % 4 + 1] ELSE '' END AS language, CASE WHEN id % 7 <> 0 THEN ['infrastructure', 'docs', 'games'][id % 3 + 1] ELSE '' END AS domain, CASE WHEN id % 7 <> 0 THEN ['high', ' low', 'urgent'][id % 3 + 1] ELSE '' END AS severity,
 CASE WHEN id % 7 <> 0 THEN ['big', 'small'][id % 2 + 1] ELSE '' END AS tag FROM p WHERE id % 5 <> 0""",
    "status_counts_filtered": f"""WITH {v.PRS}, {v.LABELS} SELECT p.chatbot_id, status, count(*) AS n FROM p JOIN lb ON lb.pr_id = p.id WHERE domain IN ('infra', 'docs') AND severity = 'high' GROUP BY 1, 2""",
    "analyses_newest_first": f"""WITH {v.ANALYSES} SELECT id, pr_id, model_name FROM a ORDER BY analyzed_at DESC, id LIMIT 150""",
    "bot_order": f"""WITH {v.PRS}, {v.ANALYSES}, {v.LABELS}, x AS (SELECT a.*, github_username, repo_name, pr_number, pr_url, p.status, diff_lines, p.discovered_at AS reviewed_at, language, domain, pr_type, severity, lb.pr_id IS NOT NULL AS has FROM a JOIN p ON a.pr_id = p.id JOIN chatbots c ON a.chatbot_id = c.id LEFT JOIN lb ON lb.pr_id = a.pr_id AND lb.chatbot_id = a.chatbot_id), f AS (SELECT github_username, min({{'d': reviewed_at IS NOT NULL, 'r': reviewed_at, 'i': id}}) AS k FROM x GROUP BY 1) SELECT github_username, CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS position FROM f""",
    "load_order": f"""WITH {v.PRS}, {v.ANALYSES} SELECT a.id, a.pr_id FROM a JOIN p ON a.pr_id = p.id ORDER BY CASE WHEN p.id % 50 <> 0 THEN discovered_at END NULLS FIRST, a.id LIMIT 120""",
    "first_repo_per_tool": f"""WITH {v.PRS} SELECT chatbot_id, min(repo_name) AS repo_name FROM p GROUP BY 1 ORDER BY 1 LIMIT 3""",
    "labels_upsert": f"""WITH {v.PRS} SELECT id AS pr_id, chatbot_id, id % 2 = 0 AS replaced FROM p WHERE id % 5 <> 0""",
    "volumes_upsert": f"""{_WITH} SELECT bot, day, CASE WHEN day > DATE '2024-01-10' THEN pr_count + 1 ELSE pr_count END AS pr_count FROM vol""",
    "analysed_status": f"""WITH {v.PRS} SELECT id, CASE WHEN id IN (SELECT pr_id FROM llm_analyses) THEN 'analyzed' ELSE status END AS status FROM p""",
    "version_swap": """SELECT id, github_username FROM chatbots""",
}
