"""Exact percentiles per group by bisection over mergeable day states.

The state of a day (or partition) lists how often each value of a group occurs; states of any days are combined by
adding counts. With a ``grid`` values are first cut down to its multiples, so a state has at most one row per group and
grid step, however many rows the day had, and the percentiles are off by less than one step.

A percentile is found by narrowing an interval per (group, quantile): each pass counts the rows below the midpoints of
four successive halvings of every open interval and keeps the part that holds the target rank, shrunk to the smallest
and largest value met in it. An interval closes when it holds one value, or is no wider than ``tolerance``. Values that
lie in no open interval any more are left behind, so the passes read ever fewer of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.joins import sized_join
from tallyspark.session import cut_lineage

SECTIONS = 16  # parts of an interval after the four halvings of one pass
_FEW = 100_000  # intervals that may be broadcast: about 10 MB
_LIMIT = 8e307  # infinite values count as the largest finite ones of this size


def day_states(df: DataFrame, group: str, measures: Sequence[str], record: str, day: Column, grid: float = 0.0) -> DataFrame:
    """Mergeable states ``<group>, measure, day, value, n``; ``grid`` 0 keeps every value as it is.

    Repeated deliveries of a record (equal ``record``) count once, on their earliest day. Null and NaN are no values;
    a null group forms no state; infinities count as very large finite values. An empty table gives no states.
    """
    once = df.groupBy(F.col(record).alias("__id")).agg(F.min(F.struct(day.alias("day"), F.col(group).alias("g"), *[F.col(m).cast("double").alias(m) for m in measures])).alias("r"))
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), _bounded(F.col(f"r.{m}")).alias("value")) for m in measures])
    rows = once.select(F.col("r.g").alias(group), F.col("r.day").alias("day"), F.inline(pairs))
    if grid:
        rows = rows.withColumn("value", F.floor(F.col("value") / grid).cast("double") * grid)
    return rows.where(f"value is not null and `{group}` is not null").groupBy(group, "measure", "day", "value").agg(F.count(F.lit(1)).alias("n"))


def _bounded(value: Column) -> Column:
    """NULL for NULL and NaN, infinities as the largest values (``least`` and ``greatest`` alone would skip NULL)."""
    return F.when(value.isNotNull() & ~F.isnan(value), F.greatest(F.lit(-_LIMIT), F.least(F.lit(_LIMIT), value)))


def merge_states(states: DataFrame, group: str) -> DataFrame:
    """Counts per value over all days of ``states``."""
    return states.groupBy(group, "measure", "value").agg(F.sum("n").alias("n"))


def percentiles(states: DataFrame, group: str, per_mille: Sequence[int], tolerance: float = 0.0) -> DataFrame:
    """``<group>, measure, per_mille, n, value`` of the states of any days.

    The target rank is ceil(n * per_mille / 1000), at least 1: the value is one that occurs. With ``tolerance`` 0 it is
    exact; otherwise it lies at most ``tolerance`` above the exact one. Each pass reads the counts that lie in open
    intervals once; the intervals (one row per group and quantile) are joined by their counted number and checkpointed, so
    that a lost executor repeats one pass at most.
    """
    keys = [group, "measure"]
    merged = cut_lineage(merge_states(states, group).select(F.struct(*keys).alias("g"), "value", "n"))
    whole = merged.groupBy("g").agg(F.sum("n").alias("total"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    quantiles = F.array(*[F.lit(int(q)) for q in per_mille])
    rank = F.greatest(F.lit(1), F.expr("(total * per_mille + 999) div 1000"))
    spans = whole.withColumn("per_mille", F.explode(quantiles)).select("g", "per_mille", "total", rank.alias("rank"), F.lit(0).cast("bigint").alias("below"), "lo", "hi")
    spans = cut_lineage(spans)
    is_open = F.col("hi") - F.col("lo") > tolerance
    few, work, step = spans.limit(_FEW + 1).count() <= _FEW, merged, 0
    while spans.where(is_open).limit(1).count():
        if step and step % 2 == 0:  # two passes leave about one value in forty: worth a table of its own
            work = cut_lineage(_inside(work, spans.where(is_open), few))
        spans, step = cut_lineage(_narrow(work, spans.where(is_open), few).unionByName(spans.where(~is_open))), step + 1
    return spans.select(*[F.col(f"g.{k}").alias(k) for k in keys], "per_mille", F.col("total").alias("n"), F.col("hi").alias("value"))


def _with_lists(rows: DataFrame, lists: DataFrame, few: bool) -> DataFrame:
    """Each row with the list of its group: broadcast where the intervals were counted to be few, else salted."""
    return rows.join(F.broadcast(lists), "g") if few else sized_join(rows, lists, "g", F.col("value"), "inner")


def _inside(work: DataFrame, spans: DataFrame, few: bool) -> DataFrame:
    """The counts that lie in at least one interval of their group."""
    lists = spans.groupBy("g").agg(F.collect_list(F.struct("lo", "hi")).alias("s"))
    rows = _with_lists(work, lists, few)
    return rows.where(F.exists("s", lambda x: F.col("value").between(x.lo, x.hi))).select("g", "value", "n")


def _narrow(merged: DataFrame, spans: DataFrame, few: bool) -> DataFrame:
    """One pass: the section of each open interval in which its target rank lies."""
    lists = spans.groupBy("g").agg(F.collect_list(F.struct("per_mille", "total", "rank", "below", "lo", "hi")).alias("s"))
    rows = _with_lists(merged, lists, few)
    near = rows.select("g", "value", "n", F.inline("s")).where("value between lo and hi")
    at = F.floor(F.try_divide(F.col("value") - F.col("lo"), (F.col("hi") - F.col("lo")) / SECTIONS))
    section = F.when(F.col("value") >= F.col("hi"), SECTIONS - 1).otherwise(F.least(F.coalesce(at, F.lit(0)), F.lit(SECTIONS - 1)))
    target = ["g", "per_mille", "total", "rank", "below"]
    counted = near.groupBy(*target, section.alias("section")).agg(F.sum("n").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    running = F.sum("n").over(Window.partitionBy(*target).orderBy("section"))
    upto = counted.withColumn("upto", F.col("below") + running)
    kept = upto.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
    return kept.select("g", "per_mille", "total", "rank", (F.col("upto") - F.col("n")).alias("below"), "lo", "hi")
