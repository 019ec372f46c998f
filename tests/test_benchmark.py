from pyspark.sql import functions as F

from tallyspark.functions import scorers
from tallyspark.operators import catalogue, matching, reports

G, C = "url string, golden_idx int, golden string", "url string, tool string, cand_idx int, candidate string"


def test_running_best_acceptance(frame):
    rows = [("u", "t", 0, "g0", i, True, c, None) for i, c in enumerate((0.7, 0.6, 0.9, 0.9))] + [("u", "t", 1, "g1", 0, True, 0.0, None), ("u", "t", 1, "g1", 1, False, 0.9, None), ("u", "t", 1, "g1", 2, True, None, None), ("u", "t", 1, "g1", 3, True, 0.9, "timeout")]
    judged = frame(rows, "url string, tool string, golden_idx int, golden string, cand_idx int, match boolean, confidence double, error string").withColumn("candidate", F.concat(F.lit("c"), F.col("cand_idx").cast("string")))
    acc = matching.accepted(judged)
    assert [r.accepted for r in acc.orderBy("golden_idx", "cand_idx").collect()] == [True, False, True, False, False, False, False, False]
    best = {r.golden_idx: (r.matched, r.candidate) for r in matching.golden_matches(acc).collect()}
    assert best == {0: (True, "c2"), 1: (False, None)}
    # equal reference texts are one sequence: the second one must beat the best of the first
    twice = frame([("u", "t", g, "same", c, True, x) for g, c, x in ((0, 0, 0.5), (0, 1, 0.8), (1, 0, 0.7), (1, 1, 0.9))], "url string, tool string, golden_idx int, golden string, cand_idx int, match boolean, confidence double")
    assert [r.accepted for r in matching.accepted(twice).orderBy("golden_idx", "cand_idx").collect()] == [True, True, False, True]


def fixed(pairs):
    return lambda p: p.withColumn("match", F.concat_ws("|", "golden", "candidate").isin(pairs)).withColumn("confidence", F.lit(0.9))


R = "url string, tool string"


def test_review_scores(frame):
    g = frame([("u", 0, "g0"), ("u", 1, "g1"), ("w", 0, "g")], G)
    c = frame([("u", "t", 0, "c0"), ("u", "t", 1, "c1"), ("v", "t", 0, "c"), ("w", "t", 0, "  ")], C)
    reviews = frame([("u", "t"), ("v", "t"), ("w", "t"), ("u", "silent")], R)
    scores = matching.review_scores(reviews, g, c, fixed(["g0|c0"]))
    got = {(r.url, r.tool): r for r in scores.collect()}
    one = got["u", "t"]
    assert (one.tp, one.fp, one.fn, one.precision, one.recall) == (1, 1, 1, 0.5, 0.5)
    assert got["v", "t"].skipped and (got["w", "t"].fn, got["w", "t"].precision, got["w", "t"].recall) == (1, 0.0, 0.0)
    silent = got["u", "silent"]  # a review without any candidate misses everything
    assert (silent.skipped, silent.tp, silent.fp, silent.fn, silent.total_candidates, silent.recall) == (False, 0, 0, 2, 0, 0.0)
    micro = {r.tool: r for r in matching.micro_average(scores).collect()}
    assert (micro["t"].reviews, micro["t"].tp, micro["t"].fp, micro["t"].fn, micro["t"].precision) == (2, 1, 1, 2, 0.5) and abs(micro["t"].f1 - 0.4) < 1e-9
    board = {r.tool: r for r in matching.dashboard_average(scores).collect()}
    assert (board["t"].num_prs, board["t"].precision, board["t"].recall, board["t"].f1) == (3, 50.0, 33.3, 40.0)


def test_equal_texts_are_one_in_counts_and_many_in_totals(frame):
    g, c = frame([("u", 0, "a"), ("u", 1, "a")], G), frame([("u", "t", 0, "a"), ("u", "t", 1, "z"), ("u", "t", 2, "z")], C)
    r = matching.review_scores(frame([("u", "t")], R), g, c, fixed(["a|a"])).first()
    assert (r.tp, r.fp, r.fn, r.total_golden, r.total_candidates, r.recall) == (1, 1, 0, 2, 3, 0.5) and abs(r.precision - 1 / 3) < 1e-9


def test_pairs_that_could_not_be_judged_count_as_errors(frame):
    g, c = frame([("u", 0, "a"), ("u", 1, "b")], G), frame([("u", "t", 0, "x"), ("u", "t", 1, "y")], C)
    judge = lambda p: fixed(["a|x", "b|y"])(p).withColumn("error", F.when(F.col("candidate") == "y", "timeout"))
    r = matching.review_scores(frame([("u", "t")], R), g, c, judge).first()
    assert (r.tp, r.fp, r.fn, r.errors_count) == (1, 1, 1, 2)


def test_one_candidate_for_several_texts_can_exceed_one(frame):
    g = frame([("u", 0, "a"), ("u", 1, "b")], G)
    r = matching.review_scores(frame([("u", "t")], R), g, frame([("u", "t", 0, "c")], C), fixed(["a|c", "b|c"])).first()
    assert (r.tp, r.fp, r.precision) == (2, 0, 2.0)


def test_cached_candidates(frame):
    raw = frame([("u", "t", ["raw", " "]), ("v", "t", ["raw"])], "url string, tool string, bodies array<string>")
    cached = frame([("u", "t", [])], "url string, tool string, texts array<string>")
    assert {r.url: r.candidates for r in matching.chosen_candidates(raw, cached).collect()} == {"u": [], "v": ["raw"]}


def test_scorer_udf_equals_the_expression(frame):
    df = frame([("a b c", "b c d"), (None, "x"), ("", "")], "golden string, candidate string")
    udf = df.select(scorers.pair_verdict(F.col("golden"), F.col("candidate")).alias("v")).select("v.confidence").collect()
    expr = matching.lexical_judge()(df.fillna("")).select("confidence").collect()
    assert [round(r.confidence, 9) for r in udf] == [round(r.confidence, 9) for r in expr] == [0.5, 0.0, 0.0]
    got = frame([("one\n---\n" + "x" * 25,)], "t string").select(scorers.split_extractor(F.col("t")).alias("x"), scorers.keyword_label(F.lit("A race here"), {"concurrency": ("race", "lock")}, "other").alias("l")).first()
    assert got.x == ["x" * 25] and got.l == "concurrency"


EV = "model string, tool string, lang string, size string, tp long, fp long, fn long"


def evals(frame):
    rows = [("m1", t, lang, size, tp, 1, 1) for t, tp in (("a", 3), ("b", 1)) for lang in ("go", "py", "unknown") for size in ("s", "l") for _ in range(5)]
    return frame(rows + [("m1", "c", "go", "s", 3, 1, 1)] * 5 + [("m2", "z", "go", "s", 9, 0, 0)] * 4, EV)


def test_slices_match_filtered_sums(frame):
    e = evals(frame)
    s = catalogue.slice_scores(e, ["lang", "size"])
    for r in s.collect():
        cond = F.lit(True)
        for d, v in zip(r.dims.split("+"), r["values"].split("+")):
            cond &= F.col(d) == v
        own = e.where(cond & (F.col("model") == r.model) & (F.col("tool") == r.tool)).agg(F.sum("tp"), F.count("*")).first()
        assert (own[0], own[1]) == (r.tp, r.n_prs)
    assert s.where("values like '%unknown%'").count() == 0


def test_winners_missing_and_order(frame):
    s = catalogue.slice_scores(evals(frame), ["lang", "size"])
    best = catalogue.best_model(s)
    assert {r.model for r in best.collect()} == {"m1"} and {r.tool for r in best.collect()} == {"a"}  # m2 has too few rows; a wins the tie with c by name
    lost = {r.tool: r for r in catalogue.missing_tools(s, best).collect()}
    assert set(lost) == {"c"} and lost["c"].metric == "f1"
    order = catalogue.diversity_order(frame([("a", 0.9, "d", "1"), ("a", 0.8, "d", "2"), ("b", 0.5, "d", "3")], "tool string, score double, dims string, values string"))
    assert [(r.tool, r.score) for r in order.orderBy("position").collect()] == [("a", 0.9), ("b", 0.5), ("a", 0.8)]
    assert {"language": ["go"], "pr_size": ["s"]} in catalogue.filter_catalogue({"language": ["go", "unknown"], "pr_size": ["s"]})
    assert {r.value for r in catalogue.dimension_domains(frame([("unknown",), ("Unknown",), ("x",), (None,)], "d string"), ["d"]).collect()} == {"Unknown", "x"}


def test_reports(frame):
    df = frame([("t1", "r1"), ("t1", "r2"), ("t1", "r1"), ("t2", "r2")], "tool string, repo string")
    assert sorted(map(tuple, reports.crosstab(df, "tool", "repo", ["r1", "r2"]).collect())) == [("t1", 2, 1, 3), ("t2", 0, 1, 1)]
    cube = {(r.tool, r.repo): r.n for r in reports.totals(df, "tool", "repo").collect()}
    assert cube["(all)", "(all)"] == 4 and cube["t1", "(all)"] == 3 and len(cube) == 8
    mix = frame([("u", "High"), ("u", "Low"), ("u", "High"), ("v", None)], "url string, severity string")
    assert {r.url: r.mix for r in reports.value_mix(mix, "url", "severity").collect()} == {"u": "High:2,Low:1", "v": "Unknown:1"}
    paths = frame([("u", "a"), ("u", "b"), ("u", "a"), ("u", ""), ("u", None)], "url string, path string")
    assert reports.files_touched(paths, "url").first().n_files == 2


def test_export_rows(frame):
    reviews = frame([("u", "t", None, "ru", ["x", "", "y"]), ("u", "s", "o", None, []), ("v", "t", "ov", "rv", ["b"]), ("w", "t", "", "", None)], "url string, tool string, original_url string, review_url string, bodies array<string>")
    golden = frame([("u", 0, "g0", "High"), ("u", 1, "g1", None), ("u", 2, "g0", "Low"), ("w", 0, "g", "Low")], "url string, golden_idx int, golden string, severity string")
    cands = frame([("u", "t", 1, "c1"), ("u", "t", 0, "c0")], C)
    scores = frame([("u", "t", False, 1, 3), ("u", "s", False, 0, 3), ("v", "t", True, 0, 0)], "url string, tool string, skipped boolean, tp long, total_golden long")
    matches = frame([("u", "t", "g0", False), ("u", "t", "g1", True)], "url string, tool string, golden string, matched boolean")
    got = {(r.url, r.tool): r for r in reports.export_rows(reviews, golden, cands, scores, matches).collect()}
    assert tuple(got["u", "t"])[2:] == ("u", "ru", "x\n\n---\n\ny", "c0\n\nc1", "y", "[High] g0\n\n[Unknown] g1\n\n[Low] g0", "[FOUND] [?] g1\n[MISSED] [Low] g0", 1, 3)
    assert got["u", "s"].judge_results == "[MISSED] [Low] g0\n[MISSED] [?] g1" and got["u", "s"].pr_id == "o" and got["u", "s"].last_comment == ""
    assert (got["v", "t"].judge_results, got["v", "t"].found_issues) == ("No golden comments", None) and got["w", "t"].judge_results == "Not evaluated"
    assert reports.EXPORT == list(got["u", "t"].asDict())[2:]


def test_languages_of_reference_sets(frame):
    names = [("calcom.json", "TypeScript"), ("cal.com", "TypeScript"), ("sentry.json", "Python"), ("Sentry.json", "Unknown"), (None, "Unknown")]
    assert [r.x for r in frame([(n,) for n, _ in names], "n string").select(reports.repo_language(F.col("n")).alias("x")).collect()] == [w for _, w in names]


def test_labels_of_evaluations_and_filters(frame):
    e = frame([(1, "m", "a", 3, 0, 0), (2, "m", "a", 1, 1, 1)] * 5, "id int, model string, tool string, tp long, fp long, fn long")
    labelled = catalogue.with_labels(e, frame([(1, None, "small")], "id int, language string, pr_size string"), "id", ["language", "pr_size"], {"language": "Unknown"})
    assert {(r.id, r.language, r.pr_size) for r in labelled.collect()} == {(1, "Unknown", "small"), (2, "Unknown", "unknown")}
    got = {r.dims: (r["values"], r.tool, r.label) for r in catalogue.predefined_filters(catalogue.slice_scores(labelled, ["language", "pr_size"]), ["language", "pr_size"], [("language", "pr_size")]).collect()}
    assert got == {"language": ("Unknown", "a", "Unknown"), "pr_size": ("small", "a", "Small PRs"), "language+pr_size": ("Unknown+small", "a", "Unknown + Small PRs")}


def test_default_extractors(frame):
    comments = frame([(1, 7, "Wrong name. Fix it", "a.py", 3), (1, 8, "  ", None, None)], "pr_id int, comment_id long, body string, path string, line int")
    (s,) = scorers.suggestion_extractor(comments).collect()
    assert (s.issue_id, s.description, s.category, s.severity, s.file_path, s.line_number) == ("S7", "Wrong name", "bug", "low", "a.py", 3)
    actions = scorers.action_extractor(frame([(1, "abcdefabcdef99", "rename wrong name")], "pr_id int, sha string, message string"), frame([(1, 9, "Done, thanks.", None)], "pr_id int, comment_id long, body string, path string"))
    assert {(r.action_id, r.action_type) for r in actions.collect()} == {("Cabcdefabcdef", "code_change"), ("R9", "discussion")}
    (m,) = scorers.action_matcher(scorers.suggestion_extractor(comments), actions).collect()
    assert (m.bot_issue_id, m.human_action_id, m.matched, m.confidence) == ("S7", "Cabcdefabcdef", True, 1.0)
    (none,) = scorers.action_matcher(scorers.suggestion_extractor(comments), actions.limit(0)).collect()
    assert (none.human_action_id, none.matched, none.confidence) == (None, False, 0.0)
    tries = []
    assert scorers.with_retries(lambda: tries.append(1) or (len(tries) == 3 or 1 / 0), 3) and len(tries) == 3
