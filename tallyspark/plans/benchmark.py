"""Queries of the benchmark half: matching, scores, slices, reports, text functions, set operations, streams, scorers."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.functions import scorers, text
from tallyspark.functions.scores import percent
from tallyspark.operators import catalogue as cat
from tallyspark.operators import matching as mat
from tallyspark.operators import outcomes as out
from tallyspark.operators import reports as rep
from tallyspark.operators.filters import dims_match
from tallyspark.operators.tree_aggregate import normal_repo
from tallyspark.plans import views as v
from tallyspark.session import cut_lineage
from tallyspark.sources.tables import table
from tallyspark.streaming import incremental as inc

DIMS = ["language", "pr_size", "domain", "change_type", "complexity", "difficulty", "risk", "context", "concern"]


def _comments(spark, d):
    """The messages, one row per comment, from one scan: every side of the matching reads them again."""
    return cut_lineage(v.comments(spark, d).select("thread_id", "comment_id", "in_reply_to_id", "author", "body", "path"))


def _golden(c):
    """Opening comments of a thread are its reference texts."""
    c = c.where("in_reply_to_id is null and body is not null")
    return c.select(F.col("thread_id").alias("url"), F.col("comment_id").alias("golden_idx"), F.col("body").alias("golden"))


def _candidates(c):
    """Replies are the candidates of their author as tool."""
    c = c.where("in_reply_to_id is not null and body is not null")
    return c.select(F.col("thread_id").alias("url"), F.lower(F.coalesce("author", F.lit("none"))).alias("tool"), F.col("comment_id").alias("cand_idx"), F.col("body").alias("candidate"))


def _all_reviews(c):
    """Everyone who took part in a thread reviewed it, also those without a reply of their own."""
    return c.select(F.col("thread_id").alias("url"), F.lower(F.coalesce("author", F.lit("none"))).alias("tool")).distinct()


def _judge(p):
    """Word overlap; very long candidates cannot be judged."""
    return mat.lexical_judge(0.1)(p).withColumn("error", F.when(F.length("candidate") > 250, "too long"))


def _scores_of(c):
    return mat.review_scores(_all_reviews(c), _golden(c), _candidates(c), _judge)


def _accepted(c):
    return mat.accepted(_judge(mat.pairs(_golden(c), _candidates(c))))


def match_matrix(spark, d):
    return _accepted(_comments(spark, d)).select("url", "tool", "golden_idx", "cand_idx", F.round("confidence", 6).alias("confidence"), "match", "accepted", "failed")


def golden_matches(spark, d):
    return mat.golden_matches(_accepted(_comments(spark, d))).select("url", "tool", "golden_idx", "matched", F.coalesce("candidate", F.lit("")).alias("candidate"))


def match_review_metrics(spark, d):
    return _scores_of(_comments(spark, d)).withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


def match_micro_avg(spark, d):
    return mat.micro_average(_scores_of(_comments(spark, d))).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def dashboard_averages(spark, d):
    """Percentages to six digits here, as the display's one digit hides and flips nothing else."""
    rows = mat.micro_average(_scores_of(_comments(spark, d)), keep_skipped=True)
    return rows.select("tool", F.col("reviews").alias("num_prs"), *[percent(F.col(c), 4).alias(c) for c in ("precision", "recall", "f1")])


def chosen_candidates(spark, d):
    c = _candidates(v.comments(spark, d))
    raw = c.groupBy("url", "tool").agg(F.sort_array(F.collect_list("candidate")).alias("bodies"))
    cached = c.where("cand_idx % 4 = 0").groupBy("url", "tool").agg(F.collect_list(F.when(F.col("cand_idx") % 8 == 0, F.col("candidate"))).alias("texts"))
    return mat.chosen_candidates(raw, cached).select("url", "tool", F.size("candidates").alias("n"))


def export_report(spark, d):
    own = _comments(spark, d)
    g = _golden(own).join(own.select(F.col("comment_id").alias("golden_idx"), F.when(F.col("path").isNotNull(), "High").alias("severity")), "golden_idx")
    c = _candidates(own)
    bodies = c.groupBy("url", "tool").agg(F.sort_array(F.collect_list(F.struct("cand_idx", "candidate"))).alias("x")).select("url", "tool", F.transform("x", lambda e: e.candidate).alias("bodies"))
    reviews = _all_reviews(own).join(bodies, ["url", "tool"], "left").withColumns({"bodies": F.coalesce("bodies", F.array().cast("array<string>")), "original_url": F.lit(""), "review_url": F.concat("url", F.lit("/"), "tool")})
    scores = _scores_of(own).where("tool <> 'none'")
    return rep.export_rows(reviews, g, c, scores, mat.golden_matches(mat.accepted(_judge(mat.pairs(g.drop("severity"), c)))))


def _labels(spark, d):
    """Offline labels of five in six pull requests, by rules on their numbers."""
    p, one = v.prs(spark, d).where("id % 6 <> 0"), lambda c, n, *names: F.element_at(F.array(*[F.lit(x).cast("string") for x in names]), (c % n + 1).cast("int"))
    i, k = F.col("id"), F.col("pr_number")
    return p.select(
        "id", one(k, 4, "Python", "Go", "Java", None).alias("language"), F.when(F.col("diff_lines") < 100, "small").when(F.col("diff_lines") < 500, "medium").when(F.col("diff_lines").isNotNull(), "large").alias("pr_size"),
        one(F.col("chatbot_id"), 4, "backend", "frontend", "infra", None).alias("domain"), one(i, 5, "bug_fix", "feature", "refactoring", "performance", None).alias("change_type"), one(i, 3, "simple", "moderate", "complex").alias("complexity"),
        one(i, 4, "obvious", "moderate", "subtle", "very_subtle").alias("difficulty"), one(k, 4, "low", "medium", "high", "critical").alias("risk"), one(k, 3, "local", "file", "system").alias("context"), F.col("status").alias("concern"),
    )


def _evals(spark, d):
    """Evaluations with the labels of their pull request; an unlabelled one reads ``unknown``, its language ``Unknown``."""
    e = v.prs(spark, d).select("id", F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("model"), F.concat(F.lit("tool"), F.col("chatbot_id").cast("string")).alias("tool"), (F.col("id") % 5).alias("tp"), (F.col("id") % 3).alias("fp"), (F.col("id") % 7 % 4).alias("fn"))
    return cat.with_labels(e, _labels(spark, d), "id", DIMS, {"language": "Unknown"})


def _scores(spark, d):
    return cat.slice_scores(_evals(spark, d), DIMS)


def _r(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def filtered_micro_average(spark, d):
    rows = _evals(spark, d).where(dims_match({"pr_size": ["small", "medium"], "risk": ["high", "low"]})).withColumn("skipped", F.lit(False))
    return _r(mat.micro_average(rows), "precision", "recall", "f1")


def predefined_filters(spark, d):
    """Every filter of the catalogue with its best model, tool, score and label."""
    return _r(cat.predefined_filters(_scores(spark, d), DIMS, [("language", "pr_size")]), "score")


def labelled_evaluations(spark, d):
    return _evals(spark, d).select("id", "model", "tool", *DIMS)


def diversity_order(spark, d):
    best = cat.best_model(_scores(spark, d)).select("tool", F.round("score", 6).alias("score"), "dims", "values")
    return cat.diversity_order(best)


def missing_tool_slices(spark, d):
    s = _scores(spark, d)
    return _r(cat.missing_tools(s, cat.best_model(s)), "score")


def tool_repo_crosstab(spark, d):
    bots = [str(r.id) for r in table(spark, d, "chatbots").select("id").orderBy("id").collect()]
    return rep.crosstab(v.prs(spark, d).select(normal_repo(F.col("repo_name")).alias("repo"), F.col("chatbot_id").cast("string").alias("tool")), "repo", "tool", bots)


def tool_repo_rollup(spark, d):
    return rep.totals(v.prs(spark, d).withColumn("repo", normal_repo(F.col("repo_name"))), "chatbot_id", "repo")


def severity_mix(spark, d):
    return rep.value_mix(table(spark, d, "eval_items"), "suite", "severity")


def files_touched(spark, d):
    return rep.files_touched(v.comments(spark, d), "pr_id")


def label_frequencies(spark, d):
    return rep.frequencies(_evals(spark, d), DIMS)


def repo_languages(spark, d):
    name = F.element_at(F.array(*[F.lit(x) for x in ("sentry.json", "grafana.json", "calcom.json", "cal.com.json", "cal_dot_com.json", "Keycloak.json", "keycloak", "discourse.json", "")]), (F.col("id") % 9 + 1).cast("int"))
    return v.prs(spark, d).select("id", rep.repo_language(name).alias("language"))


def parse_pr_url(spark, d):
    url = F.regexp_replace("pr_url", r"https://[^/]+/", "https://github.com/")
    return v.prs(spark, d).select("id", *[c.alias(n) for n, c in text.pr_url_parts(url).items()])


def parse_repo_name(spark, d):
    name = F.when(F.col("id") % 6 == 0, "broken_name").otherwise(F.concat(F.lit("cfg__"), F.regexp_replace("repo_name", "/", "-"), F.lit("__tool"), F.col("chatbot_id").cast("string"), F.lit("__PR"), F.col("pr_number").cast("string"), F.lit("__20240101")))
    return v.prs(spark, d).select("id", *[c.alias(n) for n, c in text.review_repo_parts(name).items()])


def review_repo_names(spark, d):
    name = text.review_repo_name(F.regexp_replace("repo_name", "/", "-"), F.col("pr_number"), F.col("pr_title"), F.col("discovered_at"), F.when(F.col("id") % 2 == 0, "cfg"))
    return v.prs(spark, d).select("id", name.alias("name"))


def unfenced_text(spark, d):
    t = F.concat(F.when(F.col("id") % 3 == 0, "```json\n").when(F.col("id") % 3 == 1, "say ```\n").otherwise(""), "pr_title", F.when(F.col("id") % 3 == 2, "").otherwise("\n``` end"))
    return v.prs(spark, d).select("id", text.unfenced(t).alias("text"))


def bug_types(spark, d):
    """Types of the comments of a thread by position, where every third thread has fewer types than comments."""
    c = v.comments(spark, d).groupBy("thread_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    given = F.when(F.length("thread_id") % 3 == 0, F.array(F.lit("logic"))).otherwise(F.array(F.lit("logic"), F.lit("style"), F.lit("race")))
    return c.select("thread_id", F.posexplode(out.bug_types(given, F.col("n"))).alias("pos", "t")).select("thread_id", "pos", "t.bug_type", F.coalesce("t.error", F.lit("")).alias("error"))


def dimension_labels(spark, d):
    rows = cat.dimension_domains(_evals(spark, d), DIMS)
    return rows.select("dim", "value", text.dimension_label(F.col("dim"), F.col("value")).alias("label"))


def palette(spark, d):
    rank = F.row_number().over(Window.orderBy("github_username"))  # the bots are a fixed table of 30 rows
    return table(spark, d, "chatbots").select("github_username", text.palette_index(rank, 10).alias("colour"))


def closed_labels(spark, d):
    raw = F.element_at(F.array(*[F.lit(x) for x in (" Cross File", "cross-file", "SYSTEM", "local", "galaxy", "")]), (F.col("id") % 6 + 1).cast("int"))
    return v.prs(spark, d).select("id", scorers.closed_label(raw, "context").alias("context"))


def slugify(spark, d):
    return v.prs(spark, d).select("id", text.slug(F.col("pr_title")).alias("slug"), text.short_label(F.col("repo_name"), F.col("pr_number")).alias("label"))


def csv_params(spark, d):
    line = F.concat(F.lit(" "), F.upper("p_brand"), F.lit(" ,, "), "p_type", F.lit(",X"))
    return table(spark, d, "part").select("p_partkey", F.array_join(text.csv_values(line), "|").alias("values"))


def suffix_date(spark, d):
    s = text.suffix_of(F.col("discovered_at"))
    return v.prs(spark, d).select("id", s.alias("suffix"), text.day_of_suffix(s).alias("day"))


def model_names(spark, d):
    name = F.concat(F.lit("vendor/"), "model_name")
    return v.analyses(spark, d).groupBy(text.safe_model_name(name).alias("model"), text.title_label(F.col("model_name")).alias("title")).agg(F.count(F.lit(1)).alias("n"))


def prefix_match(spark, d):
    a = v.prs(spark, d).select(F.col("id"), F.md5(F.col("id").cast("string")).alias("sha"))
    short = F.when(F.col("id") % 4 == 0, "").when(F.col("id") % 4 == 1, F.substring("sha", 1, 7)).when(F.col("id") % 4 == 2, F.concat("sha", F.lit("ff"))).otherwise("zz")
    return a.select("id", text.same_sha(F.col("sha"), short).alias("same"))


def set_ops_bots(spark, d):
    known = table(spark, d, "chatbots").select(F.col("github_username").alias("name"))
    extra = spark.createDataFrame([("quillwarden",), ("newbot",), ("unknown",)], "name string")
    every = known.union(extra).distinct().where("name <> 'unknown'")
    return every.select("name", F.lit("all").alias("op")).union(extra.subtract(known).select("name", F.lit("new"))).union(known.intersect(extra).select("name", F.lit("both")))


def scorer_udf_pairs(spark, d):
    c = _comments(spark, d)
    p = mat.pairs(_golden(c), _candidates(c))
    verdict = p.select("url", "tool", "golden_idx", "cand_idx", scorers.pair_verdict(F.col("golden"), F.col("candidate")).alias("verdict"))
    return verdict.select("url", "tool", "golden_idx", "cand_idx", "verdict.match", F.round("verdict.confidence", 6).alias("confidence"))


def _stream(spark, d):
    like = table(spark, d, "events")
    e = inc.event_stream(spark, f"{d}/events.parquet*", like)
    return e.withColumns({"bot": F.col("user_id") % 15, "pr_key": F.concat((F.col("user_id") % 7).cast("string"), F.lit("#"), F.get_json_object("props", "$.k"))})


def stream_first_seen(spark, d):
    rows = _stream(spark, d).where("props is not null")
    return inc.first_seen_volumes(inc.first_seen(rows, _scratch(spark)))


def stream_daily_window(spark, d):
    return inc.settled(inc.daily_counts(_stream(spark, d), "event_type"), ["day", "event_type"], _scratch(spark))


def _scratch(spark):
    import uuid

    from tallyspark.session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


QUERIES = {
    "golden_matches": golden_matches, "dashboard_averages": dashboard_averages, "predefined_filters": predefined_filters, "labelled_evaluations": labelled_evaluations, "review_repo_names": review_repo_names, "unfenced_text": unfenced_text,
    "bug_types": bug_types, "dimension_labels": dimension_labels, "palette": palette, "closed_labels": closed_labels,
    "match_matrix": match_matrix, "match_review_metrics": match_review_metrics, "match_micro_avg": match_micro_avg, "chosen_candidates": chosen_candidates, "export_report": export_report,
    "slice_scores": lambda s, d: _r(_scores(s, d), "precision", "recall", "f1"), "best_tool_per_slice": lambda s, d: _r(cat.best_tool(_scores(s, d)), "score"),
    "best_model_per_slice": lambda s, d: _r(cat.best_model(_scores(s, d)), "score"), "missing_tool_slices": missing_tool_slices, "diversity_order": diversity_order,
    "dimension_domains": lambda s, d: cat.dimension_domains(_evals(s, d), DIMS), "filtered_micro_average": filtered_micro_average,
    "tool_repo_crosstab": tool_repo_crosstab, "tool_repo_rollup": tool_repo_rollup, "severity_mix": severity_mix, "files_touched": files_touched, "label_frequencies": label_frequencies,
    "repo_languages": repo_languages, "parse_pr_url": parse_pr_url, "parse_repo_name": parse_repo_name, "slugify": slugify, "csv_params": csv_params, "suffix_date": suffix_date,
    "model_names": model_names, "prefix_match": prefix_match, "set_ops_bots": set_ops_bots, "scorer_udf_pairs": scorer_udf_pairs, "stream_first_seen": stream_first_seen, "stream_daily_window": stream_daily_window,
}

_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> ''))"
_MATCH = f"""WITH {v.COMMENTS}, g AS (SELECT thread_id AS url, comment_id AS golden_idx, body AS golden FROM tc WHERE in_reply_to_id IS NULL AND body IS NOT NULL),
c AS (SELECT thread_id AS url, lower(coalesce(author, 'none')) AS tool, comment_id AS cand_idx, body AS candidate FROM tc WHERE in_reply_to_id IS NOT NULL AND body IS NOT NULL),
w AS (SELECT c.url, tool, golden_idx, cand_idx, golden, candidate, {_WORDS.format("golden")} AS a, {_WORDS.format("candidate")} AS b FROM g JOIN c ON g.url = c.url WHERE regexp_replace(candidate, '\\s+', '', 'g') <> ''),
j AS (SELECT url, tool, golden_idx, cand_idx, golden, candidate, length(candidate) > 250 AS failed, coalesce(len(list_intersect(a, b)) / nullif(len(a) + len(b) - len(list_intersect(a, b)), 0), 0) AS confidence FROM w),
k AS (SELECT *, confidence > 0.1 AS match, CASE WHEN confidence > 0.1 AND NOT failed THEN confidence END AS score FROM j),
m AS (SELECT *, coalesce(score > coalesce(max(score) OVER (PARTITION BY url, tool, golden ORDER BY golden_idx, cand_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), false) AS accepted FROM k),
rv AS (SELECT DISTINCT thread_id AS url, lower(coalesce(author, 'none')) AS tool FROM tc)"""
_REV = f"""{_MATCH}, fa AS (SELECT url, tool, count(DISTINCT CASE WHEN accepted THEN golden END) AS tp, count(DISTINCT golden) AS dg, count(DISTINCT CASE WHEN accepted THEN candidate END) AS used, count(DISTINCT candidate) AS dc, count(*) FILTER (failed) AS errors FROM m GROUP BY 1, 2),
nc AS (SELECT url, tool, count(*) AS n FROM c WHERE regexp_replace(candidate, '\\s+', '', 'g') <> '' GROUP BY 1, 2), ng AS (SELECT url, count(*) AS n FROM g GROUP BY 1),
r AS (SELECT rv.url, rv.tool, ng.n IS NULL AS skipped, coalesce(tp, 0) AS tp, coalesce(dc, 0) - coalesce(used, 0) AS fp, CASE WHEN coalesce(nc.n, 0) = 0 THEN coalesce(ng.n, 0) ELSE coalesce(dg, 0) - coalesce(tp, 0) END AS fn, coalesce(errors, 0) AS errors_count, coalesce(nc.n, 0) AS total_candidates, coalesce(ng.n, 0) AS total_golden,
 round(coalesce(coalesce(tp, 0) / nullif(nc.n, 0), 0), 6) AS "precision", round(coalesce(coalesce(tp, 0) / nullif(ng.n, 0), 0), 6) AS recall
 FROM rv LEFT JOIN ng ON ng.url = rv.url LEFT JOIN nc ON nc.url = rv.url AND nc.tool = rv.tool LEFT JOIN fa ON fa.url = rv.url AND fa.tool = rv.tool)"""
_EV = f"""WITH {v.PRS}, lb AS (SELECT id, ['Python', 'Go', 'Java', NULL][pr_number % 4 + 1] AS language, CASE WHEN diff_lines < 100 THEN 'small' WHEN diff_lines < 500 THEN 'medium' WHEN diff_lines IS NOT NULL THEN 'large' END AS pr_size, ['backend', 'frontend', 'infra', NULL][chatbot_id % 4 + 1] AS domain,
 ['bug_fix', 'feature', 'refactoring', 'performance', NULL][id % 5 + 1] AS change_type, ['simple', 'moderate', 'complex'][id % 3 + 1] AS complexity, ['obvious', 'moderate', 'subtle', 'very_subtle'][id % 4 + 1] AS difficulty, ['low', 'medium', 'high', 'critical'][pr_number % 4 + 1] AS risk,
 ['local', 'file', 'system'][pr_number % 3 + 1] AS context, status AS concern FROM p WHERE id % 6 <> 0),
ev AS (SELECT p.id, 'm' || (p.id % 3) AS model, 'tool' || chatbot_id AS tool, p.id % 5 AS tp, p.id % 3 AS fp, p.id % 7 % 4 AS fn, coalesce(language, 'Unknown') AS language, {", ".join(f"coalesce({c}, 'unknown') AS {c}" for c in DIMS[1:])} FROM p LEFT JOIN lb ON lb.id = p.id)"""


def _prf(tp="tp", fp="fp", fn="fn") -> str:
    return f"coalesce({tp} / nullif({tp} + {fp}, 0), 0) AS \"precision\", coalesce({tp} / nullif({tp} + {fn}, 0), 0) AS recall, coalesce(2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0) AS f1"


def _slices() -> str:
    sets = [[a] for a in DIMS] + [[a, b] for i, a in enumerate(DIMS) for b in DIMS[i + 1 :]]
    one = "SELECT '{n}' AS dims, {v} AS \"values\", model, tool, count(*) AS n_prs, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM ev WHERE {w} GROUP BY ALL"
    parts = [one.format(n="+".join(s), v=" || '+' || ".join(s), w=" AND ".join(f"{c} <> 'unknown'" for c in s)) for s in sets]
    return f"{_EV}, sl0 AS ({' UNION ALL '.join(parts)}), sl AS (SELECT *, {_prf()} FROM sl0)"


def _label_sql(dim: str, value: str) -> str:
    cases = " ".join(f"WHEN {dim} = '{d}' AND {value} = '{x}' THEN '{t}'" for (d, x), t in text.TITLES.items())
    title = f"list_aggregate(list_transform(string_split(regexp_replace({value}, '[_-]+', ' ', 'g'), ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ')"
    return f"CASE {cases} ELSE {title} END"


_BEST = """, bt AS (SELECT dims, "values", model, arg_min(tool, (-f1, tool)) AS tool, max(f1) AS score, arg_min(n_prs, (-f1, tool)) AS n_prs FROM sl WHERE n_prs >= 5 AND f1 > 0 GROUP BY 1, 2, 3),
bm AS (SELECT dims, "values", arg_min(model, (-score, model)) AS model, arg_min(tool, (-score, model)) AS tool, max(score) AS score, arg_min(n_prs, (-score, model)) AS n_prs FROM bt GROUP BY 1, 2)"""

SQL = {
    "match_matrix": f"""{_MATCH} SELECT url, tool, golden_idx, cand_idx, round(confidence, 6) AS confidence, match, accepted, failed FROM m""",
    "match_review_metrics": f"{_REV} SELECT * FROM r",
    "match_micro_avg": f"""{_REV}, s AS (SELECT tool, count(*) AS reviews, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM r WHERE NOT skipped GROUP BY 1), q AS (SELECT *, {_prf()} FROM s)
SELECT tool, reviews, tp, fp, fn, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM q""",
    "chosen_candidates": f"""{_MATCH}, q AS (SELECT url, tool, count(*) FILTER (regexp_replace(candidate, '\\s+', '', 'g') <> '') AS bodies, count(*) FILTER (cand_idx % 4 = 0) AS k, count(*) FILTER (cand_idx % 8 = 0 AND regexp_replace(candidate, '\\s+', '', 'g') <> '') AS texts FROM c GROUP BY 1, 2)
SELECT url, tool, CAST(CASE WHEN k > 0 THEN texts ELSE bodies END AS INTEGER) AS n FROM q""",
    "export_report": f"""{_REV}, gs AS (SELECT g.*, CASE WHEN path IS NOT NULL THEN 'High' END AS severity FROM g JOIN tc ON comment_id = golden_idx), ga AS (SELECT url, string_agg('[' || coalesce(severity, 'Unknown') || '] ' || golden, chr(10) || chr(10) ORDER BY golden_idx) AS golden_comments FROM gs GROUP BY 1),
ca AS (SELECT url, tool, string_agg(candidate, chr(10) || chr(10) ORDER BY cand_idx) AS candidates, string_agg(CASE WHEN candidate <> '' THEN candidate END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY cand_idx) AS review_text, arg_max(candidate, cand_idx) AS last_comment FROM c GROUP BY 1, 2),
gt AS (SELECT url, golden, arg_max(coalesce(severity, ''), golden_idx) AS severity, min(golden_idx) AS first FROM gs GROUP BY 1, 2), gm AS (SELECT url, tool, golden, bool_or(accepted) AS hit FROM m GROUP BY 1, 2, 3), ok AS (SELECT * FROM r WHERE tool <> 'none'),
vd AS (SELECT ok.url, ok.tool, string_agg((CASE WHEN coalesce(hit, false) THEN '[FOUND] [' ELSE '[MISSED] [' END) || coalesce(nullif(severity, ''), '?') || '] ' || gt.golden, chr(10) ORDER BY NOT coalesce(hit, false), first) AS verdicts FROM ok JOIN gt ON gt.url = ok.url LEFT JOIN gm ON gm.url = ok.url AND gm.tool = ok.tool AND gm.golden = gt.golden WHERE NOT skipped GROUP BY 1, 2)
SELECT rv.url, rv.tool, rv.url AS pr_id, rv.url || '/' || rv.tool AS review_url, coalesce(review_text, '') AS review_text, coalesce(candidates, '') AS candidates, coalesce(last_comment, '') AS last_comment, coalesce(golden_comments, '') AS golden_comments,
 CASE WHEN ok.url IS NULL THEN 'Not evaluated' WHEN skipped THEN 'No golden comments' ELSE coalesce(verdicts, '') END AS judge_results, CASE WHEN NOT skipped THEN tp END AS found_issues, CASE WHEN NOT skipped THEN total_golden END AS total_issues
FROM rv LEFT JOIN ga ON ga.url = rv.url LEFT JOIN ca ON ca.url = rv.url AND ca.tool = rv.tool LEFT JOIN ok ON ok.url = rv.url AND ok.tool = rv.tool LEFT JOIN vd ON vd.url = rv.url AND vd.tool = rv.tool""",
    "slice_scores": f'{_slices()} SELECT dims, "values", model, tool, n_prs, tp, fp, fn, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM sl',
    "best_tool_per_slice": f'{_slices()}{_BEST} SELECT dims, "values", model, tool, round(score, 6) AS score, n_prs FROM bt',
    "best_model_per_slice": f'{_slices()}{_BEST} SELECT dims, "values", model, tool, round(score, 6) AS score, n_prs FROM bm',
    "diversity_order": f"""{_slices()}{_BEST}, r AS (SELECT tool, round(score, 6) AS score, dims, "values" FROM bm), k AS (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY score DESC, dims, "values") > 1 AS later FROM r)
SELECT tool, score, dims, "values", CAST(row_number() OVER (ORDER BY later, score DESC, tool, dims, "values") AS INTEGER) AS position FROM k""",
    "missing_tool_slices": f"""{_slices()}{_BEST}, lo AS (SELECT dims, "values", model, tool, n_prs, unnest([0, 1, 2]) AS no, unnest(['f1', 'precision', 'recall']) AS metric, unnest([f1, "precision", recall]) AS score FROM sl WHERE n_prs >= 5),
tp AS (SELECT *, max(score) OVER (PARTITION BY dims, "values", model, no) AS top FROM lo), ms AS (SELECT * FROM tp WHERE score = top AND score > 0 AND tool NOT IN (SELECT tool FROM bm)),
rk AS (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY no, len(string_split(dims, '+')), score DESC, dims, "values", model) AS rn FROM ms)
SELECT tool, metric, dims, "values", model, round(score, 6) AS score, n_prs FROM rk WHERE rn = 1""",
    "dimension_domains": f"{_EV} SELECT DISTINCT dim, value FROM (SELECT unnest([{', '.join(repr(x) for x in DIMS)}]) AS dim, unnest([{', '.join(DIMS)}]) AS value FROM ev) WHERE value <> 'unknown'",
    "filtered_micro_average": f"""{_EV}, s AS (SELECT tool, count(*) AS reviews, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM ev WHERE pr_size IN ('small', 'medium') AND risk IN ('high', 'low') GROUP BY 1), q AS (SELECT *, {_prf()} FROM s)
SELECT tool, reviews, tp, fp, fn, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM q""",
    "tool_repo_crosstab": f"""WITH {v.PRS}, k AS (SELECT *, regexp_replace(lower(trim(repo_name)), '\\.git$', '') AS repo FROM p) SELECT repo, {', '.join(f'count(*) FILTER (chatbot_id = {i}) AS "{i}"' for i in range(1, 31))}, count(*) AS total FROM k GROUP BY 1""",
    "tool_repo_rollup": f"""WITH {v.PRS}, k AS (SELECT *, regexp_replace(lower(trim(repo_name)), '\\.git$', '') AS repo FROM p) SELECT CASE WHEN grouping(chatbot_id) = 1 THEN '(all)' ELSE CAST(chatbot_id AS VARCHAR) END AS chatbot_id, CASE WHEN grouping(repo) = 1 THEN '(all)' ELSE repo END AS repo, count(*) AS n FROM k GROUP BY CUBE (chatbot_id, repo)""",
    "severity_mix": "SELECT suite, string_agg(v || ':' || n, ',' ORDER BY v || ':' || n) AS mix FROM (SELECT suite, coalesce(severity, 'Unknown') AS v, count(*) AS n FROM eval_items GROUP BY 1, 2) GROUP BY 1",
    "files_touched": f"WITH {v.COMMENTS} SELECT pr_id, count(DISTINCT nullif(path, '')) AS n_files FROM tc GROUP BY 1",
    "label_frequencies": f"{_EV} SELECT dim, value, count(*) AS n FROM (SELECT unnest([{', '.join(repr(x) for x in DIMS)}]) AS dim, unnest([{', '.join(DIMS)}]) AS value FROM ev) WHERE value IS NOT NULL GROUP BY 1, 2",
    "repo_languages": f"""WITH {v.PRS} SELECT id, ['Python', 'Go', 'TypeScript', 'TypeScript', 'TypeScript', 'Unknown', 'Java', 'Ruby', 'Unknown'][id % 9 + 1] AS language FROM p""",
    "parse_pr_url": f"""WITH {v.PRS}, u AS (SELECT id, regexp_extract(pr_url, 'https://[^/]+/([^/]+)/([^/]+)/pull/([0-9]+)', ['o', 'r', 'n']) AS x FROM p)
SELECT id, nullif(x.o, '') AS owner, nullif(regexp_replace(x.r, '\\.git$', ''), '') AS repo, TRY_CAST(nullif(x.n, '') AS INTEGER) AS number FROM u""",
    "parse_repo_name": f"""WITH {v.PRS} SELECT id, CASE WHEN id % 6 <> 0 THEN 'cfg' END AS prefix, CASE WHEN id % 6 <> 0 THEN replace(repo_name, '/', '-') END AS source_repo, CASE WHEN id % 6 <> 0 THEN 'tool' || chatbot_id END AS tool,
 CASE WHEN id % 6 <> 0 THEN CAST(pr_number AS VARCHAR) END AS pr_number, CASE WHEN id % 6 <> 0 THEN '20240101' END AS stamp FROM p""",
    "slugify": f"WITH {v.PRS} SELECT id, substr(regexp_replace(regexp_replace(lower(pr_title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 30) AS slug, split_part(repo_name, '/', -1) || '#' || pr_number AS label FROM p",
    "csv_params": "SELECT p_partkey, lower(p_brand) || '|' || lower(trim(p_type)) || '|x' AS \"values\" FROM part",
    "suffix_date": f"WITH {v.PRS} SELECT id, strftime(discovered_at, '%y%m%d') AS suffix, CAST(discovered_at AS DATE) AS day FROM p",
    "model_names": f"""WITH {v.ANALYSES}, m AS (SELECT model_name, count(*) AS n FROM a GROUP BY 1)
SELECT replace('vendor/' || model_name, '/', '_') AS model, list_aggregate(list_transform(string_split(regexp_replace(model_name, '[_-]+', ' ', 'g'), ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ') AS title, n FROM m""",
    "prefix_match": f"""WITH {v.PRS} SELECT id, id % 4 IN (1, 2) AS same FROM p""",
    "set_ops_bots": """WITH k AS (SELECT github_username AS name FROM chatbots), e AS (SELECT unnest(['quillwarden', 'newbot', 'unknown']) AS name)
SELECT name, 'all' AS op FROM (FROM k UNION FROM e) WHERE name <> 'unknown' UNION ALL SELECT name, 'new' FROM (FROM e EXCEPT FROM k) UNION ALL SELECT name, 'both' FROM (FROM k INTERSECT FROM e)""",
    "golden_matches": f"""{_MATCH} SELECT url, tool, min(golden_idx) AS golden_idx, bool_or(accepted) AS matched, coalesce(arg_max(candidate, (confidence, -golden_idx, -cand_idx)) FILTER (accepted), '') AS candidate FROM m GROUP BY url, tool, golden""",
    "dashboard_averages": f"""{_REV}, s AS (SELECT tool, count(*) AS num_prs, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM r GROUP BY 1), q AS (SELECT *, {_prf()} FROM s)
SELECT tool, num_prs, round("precision" * 100, 4) AS "precision", round(recall * 100, 4) AS recall, round(f1 * 100, 4) AS f1 FROM q""",
    "labelled_evaluations": f"""{_EV} SELECT id, model, tool, {', '.join(DIMS)} FROM ev""",
    "review_repo_names": f"""WITH {v.PRS} SELECT id, (CASE WHEN id % 2 = 0 THEN 'cfg__' ELSE '' END) || replace(repo_name, '/', '-') || '__' || substr(regexp_replace(regexp_replace(lower(pr_title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 30) || '__PR' || pr_number || '__' || strftime(discovered_at, '%Y%m%d') AS name FROM p""",
    "unfenced_text": f"""WITH {v.PRS} SELECT id, pr_title AS text FROM p""",
    "bug_types": f"""WITH {v.COMMENTS}, n AS (SELECT thread_id, count(*) AS n FROM tc GROUP BY 1), e AS (SELECT thread_id, unnest(range(n)) AS pos FROM n), k AS (SELECT *, CASE WHEN length(thread_id) % 3 = 0 THEN ['logic'] ELSE ['logic', 'style', 'race'] END[pos + 1] AS t FROM e)
SELECT thread_id, CAST(pos AS INTEGER) AS pos, coalesce(t, 'other') AS bug_type, CASE WHEN t IS NULL THEN 'not_labeled' ELSE '' END AS error FROM k""",
    "palette": """SELECT github_username, CAST((row_number() OVER (ORDER BY github_username) - 1) % 10 AS INTEGER) AS colour FROM chatbots""",
    "closed_labels": f"""WITH {v.PRS} SELECT id, ['cross_file', 'cross_file', 'system', 'local', 'unknown', 'unknown'][id % 6 + 1] AS context FROM p""",
    "scorer_udf_pairs": f"""{_MATCH} SELECT url, tool, golden_idx, cand_idx, confidence > 0.05 AS match, round(confidence, 6) AS confidence FROM m""",
    "stream_first_seen": """WITH e AS (SELECT user_id % 15 AS bot, (user_id % 7) || '#' || CAST(json_extract(props, '$.k') AS BIGINT) AS k, min(ts) AS ts FROM events WHERE props IS NOT NULL GROUP BY 1, 2) SELECT bot, CAST(ts AS DATE) AS day, count(*) AS pr_count FROM e GROUP BY 1, 2""",
    "stream_daily_window": """SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""",
    "predefined_filters": f"""{_slices()}{_BEST}, k AS (SELECT * FROM bm WHERE dims NOT LIKE '%+%' OR dims = 'language+pr_size'), l AS (SELECT *, string_split(dims, '+') AS ds, string_split("values", '+') AS vs FROM k)
SELECT dims, "values", model, tool, round(score, 6) AS score, n_prs, {_label_sql("ds[1]", "vs[1]")} || CASE WHEN len(ds) > 1 THEN ' + ' || {_label_sql("ds[2]", "vs[2]")} ELSE '' END AS label FROM l""",
    "dimension_labels": f"""{_EV}, u AS (SELECT DISTINCT dim, value FROM (SELECT unnest([{', '.join(repr(x) for x in DIMS)}]) AS dim, unnest([{', '.join(DIMS)}]) AS value FROM ev) WHERE value <> 'unknown') SELECT dim, value, {_label_sql("dim", "value")} AS label FROM u""",
}
