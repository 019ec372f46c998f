import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.scores import f_beta
from tallyspark.operators import filters, metrics
from tallyspark.operators.filters import FilterSpec, apply_filters, spec_from_query

FACT = "bot long, day date, precision float, recall float, diff_lines long, language string, domain string, pr_type string, severity string"
BOT = "bot long, username string, display_name string, ignored boolean"
VOL = "bot long, day date, pr_count long"
D = lambda n: date(2026, 2, n)


def fact(bot=1, day=D(1), p=0.5, r=0.5, diff=100, lang="go", dom="backend", kind="feature", sev="high"):
    return (bot, day, p, r, diff, lang, dom, kind, sev)


def found(frame, rows, spec=FilterSpec(), vols=(), bots=((1, "alpha", "Alpha Bot", False), (2, "beta", None, False), (3, "gone", None, True))):
    return apply_filters(frame(list(rows), FACT), frame(list(bots), BOT), frame(list(vols), VOL), spec)


@pytest.mark.parametrize(("p", "r", "b", "want"), [(0.6, 0.8, 1.0, 0.6857), (0.0, 0.0, 1.0, None), (0.6, 0.8, 2.0, 0.75), (None, 0.5, 1.0, None), (0.5, 0.0, 0.0, None), (0.5, 0.5, 0.0, None)])
def test_f_beta(frame, p, r, b, want):
    got = frame([(p, r)], "p double, r double").select(f_beta(F.col("p"), F.col("r"), b).alias("f")).first().f
    if (p, r, b) == (0.5, 0.5, 0.0):
        assert got == 0.5
    else:
        assert got is None if want is None else abs(got - want) < 1e-3


def test_daily_recall_is_averaged_over_rows_with_precision(frame):
    (row,) = metrics.daily_metrics(found(frame, [fact(p=0.5, r=0.8), fact(p=0.7, r=None), fact(p=0.9, r=None), fact(p=None, r=0.1)])).collect()
    assert row.pr_count == 3 and abs(row.avg_precision - 0.7) < 1e-6 and abs(row.avg_recall - 0.8) < 1e-6


def test_daily_without_recall(frame):
    (row,) = metrics.daily_metrics(found(frame, [fact(p=0.5, r=None)])).collect()
    assert row.avg_recall == 0.0 and row.avg_f_beta is None


def test_daily_threshold_and_undated(frame):
    rows = [fact(), fact(), fact(day=D(2)), fact(day=None)]
    assert [r.day for r in metrics.daily_metrics(found(frame, rows, FilterSpec(min_per_day=2))).collect()] == [D(1)]


def test_leaderboard(frame):
    rows = [fact(p=0.4, r=0.6), fact(day=D(2), p=0.6, r=0.8), fact(bot=2, p=None, r=None), fact(bot=3)]
    board = metrics.leaderboard(found(frame, rows, vols=[(1, D(1), 5), (1, D(2), 6)])).collect()
    assert [(r.chatbot, r.sampled_prs, r.scored_prs, r.total_prs) for r in board] == [("alpha", 2, 2, 11), ("beta", 1, 0, 0)]
    assert abs(board[0].precision - 0.5) < 1e-6 and abs(board[0].recall - 0.7) < 1e-6 and board[1].f_score is None


def test_leaderboard_threshold_keeps_sampled(frame):
    rows = [fact(p=0.4, r=0.6), fact(p=0.6, r=0.8), fact(day=D(2), p=1.0, r=1.0)]
    (row,) = metrics.leaderboard(found(frame, rows, FilterSpec(min_per_day=2))).collect()
    assert (row.sampled_prs, row.scored_prs) == (3, 2) and abs(row.precision - 0.5) < 1e-6


def test_filters(frame):
    rows = [fact(diff=d) for d in (50, 500, 3000, None)]
    assert found(frame, rows, FilterSpec(diff_min=100, diff_max=2000)).facts.count() == 2
    labelled = [fact(sev="high"), fact(sev=None), fact(sev="low", lang="py"), fact(dom="infra", lang=None)]
    assert found(frame, labelled, FilterSpec(severities=("high",))).facts.count() == 2
    assert found(frame, labelled, FilterSpec(languages=("go",), domains=("backend",))).facts.count() == 2
    assert found(frame, [fact(), fact(day=D(3)), fact(day=D(5))], FilterSpec(start=D(3), end=D(4))).facts.count() == 1
    assert found(frame, [fact()], FilterSpec(start=D(4), end=D(3))).facts.count() == 0
    assert found(frame, [fact(bot=3)], FilterSpec(include_ignored=True)).facts.count() == 1
    assert found(frame, [fact(), fact(bot=2)], FilterSpec(bots=("alpha bot",))).facts.count() == 1
    assert {r.bot for r in found(frame, [fact()], FilterSpec(min_total=5), [(1, D(1), 4), (2, D(1), 5)]).bots.collect()} == {2}


def test_more_filters_never_give_more_rows(frame):
    rows = [fact(bot=b, day=D(1 + d), diff=100 * d, sev=s) for b in (1, 2) for d in range(5) for s in ("high", "low", None)]
    sizes = [found(frame, rows, s).facts.count() for s in (FilterSpec(), FilterSpec(start=D(2)), FilterSpec(start=D(2), severities=("high",)), FilterSpec(start=D(2), severities=("high",), diff_max=200))]
    assert sizes == sorted(sizes, reverse=True)


def test_spec_from_query():
    s = spec_from_query({"start_date": "2026-02-01", "end_date": "soon", "chatbot": " A, ,b", "severity": "weird", "domain": "Infrastructure,zzz", "pr_type": "fix", "beta": "x", "diff_lines_min": "7"})
    assert s.start == D(1) and s.end is None and s.bots == ("a", "b") and s.severities == () and s.domains == ("infra", "other") and s.pr_types == ("bugfix",) and s.beta == 1.0 and s.diff_min == 7


def test_volume_series_is_zero_filled(frame):
    vols = frame([(1, D(1), 2), (1, D(4), 3), (2, D(2), 1)], VOL)
    bots = frame([(1, "a", None, False), (2, "b", None, False), (3, "c", None, False)], BOT)
    rows = metrics.volume_series(vols, bots, FilterSpec()).collect()
    assert len(rows) == 4 * 2 and sum(r.pr_count for r in rows) == 6
    assert metrics.volume_series(vols, bots, FilterSpec(start=D(5), end=D(1))).collect() == []
    assert metrics.volume_series(vols.limit(0), bots, FilterSpec()).collect() == []
    assert {(r.day, r.pr_count) for r in metrics.volume_series(vols, bots.where("bot = 1"), FilterSpec(start=D(3))).collect()} == {(D(3), 0), (D(4), 3)}


def test_options(frame):
    rows = [fact(lang="go")] * 5 + [fact(lang="py")] * 4 + [fact(day=None, sev=None)]
    bots = frame([(1, "alpha", None, False), (3, "gone", None, True)], BOT)
    (o,) = metrics.filter_options(frame(rows, FACT), bots).collect()
    assert o.languages == ["go"] and o.severitys == ["high"] and o.chatbots == ["alpha"] and o.first_day == D(1)


def test_dashboard_size_rule(frame):
    df = frame([(50,), (2500,), (None,)], "diff_lines long")
    n = lambda *a: df.where(filters.dashboard_size_ok(*a)).count()
    assert (n(0, 2000, False), n(0, 2000, True), n(10, 100, False)) == (2, 2, 1)


def tenths(bots):
    """320 measures per bot in tenths, in another order for each bot; their mean 0.5040625 lies halfway between two figures of six digits."""
    values = [0.1] * 40 + [0.3] * 71 + [0.6] * 156 + [0.8] * 53
    for bot in bots:
        random.Random(bot).shuffle(values)
        yield from (fact(bot=bot, day=D(1 + i % 2), p=p, r=r) for i, (p, r) in enumerate(zip(values, reversed(values), strict=True)))


def board_of(frame, rows, spec, bots):
    names = frame([(b, f"bot {b}", None, b % 2 == 0) for b in bots], BOT)
    return metrics.leaderboard(apply_filters(frame(list(rows), FACT.replace("float", "double")), names, frame([], VOL), spec)).collect()


@pytest.mark.parametrize("spec", [FilterSpec(), FilterSpec(min_per_day=2)])
def test_leaderboard_means_do_not_depend_on_the_order_of_rows(frame, spec):
    board = board_of(frame, tenths(range(1, 40, 2)), spec, range(1, 40, 2))
    assert len(board) == 20 and {(r.precision, r.recall) for r in board} == {(0.5040625, 0.5040625)}


def test_leaderboard_sums_measures_that_are_no_decimals(frame):
    rows = [fact(p=float("nan")), fact(p=0.5, r=1e300), fact(bot=3, p=0.5, r=0.25)]
    board = {r.chatbot: r for r in board_of(frame, rows, FilterSpec(), [1, 3])}
    assert math.isnan(board["bot 1"].precision) and board["bot 1"].recall == 5e299 and board["bot 3"].recall == 0.25


def test_leaderboard_f_of_halfway_means_with_beta_and_ignored_bots(frame):
    board = board_of(frame, tenths(range(1, 21)), FilterSpec(beta=2.0, include_ignored=True), range(1, 21))
    assert len(board) == 20 and {(r.precision, r.recall, r.f_score) for r in board} == {(0.5040625, 0.5040625, 0.5040625)}
