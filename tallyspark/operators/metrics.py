"""Aggregates of the serving surface: daily metrics, leaderboard, volumes, options, status counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.scores import f_beta
from tallyspark.operators.filters import Filtered, FilterSpec, day_in_range


def daily_metrics(found: Filtered) -> DataFrame:
    """Per day and bot over rows with a precision: means, F of the means, rows; recall 0.0 and no F if no row has one.

    Ordered by day, then name.
    """
    p, r = F.col("precision").cast("double"), F.col("recall").cast("double")
    daily = (
        found.facts.where(p.isNotNull())
        .groupBy("day", "username")
        .agg(F.avg(p).alias("avg_precision"), F.avg(r).alias("r"), F.count(F.lit(1)).alias("pr_count"))
    )
    if found.spec.min_per_day is not None:
        daily = daily.where(F.col("pr_count") >= found.spec.min_per_day)
    shown = daily.select(
        "day", F.col("username").alias("chatbot"), "avg_precision", F.coalesce("r", F.lit(0.0)).alias("avg_recall"),
        f_beta(F.col("avg_precision"), F.col("r"), found.spec.beta).alias("avg_f_beta"), "pr_count",
    )
    return shown.orderBy("day", "chatbot")


def sorted_metrics(rows: DataFrame, by: str, ascending: bool = False, tie: str = "chatbot") -> DataFrame:
    """A metric table by any of its columns, NULL last either way, then by name."""
    return rows.orderBy(F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by), tie)


def mean_f_and_f_of_means(facts: DataFrame, beta: float = 1.0) -> DataFrame:
    """Per day and bot both figures that pass as "average F": the mean of the rows' F, and F of the mean P and R."""
    p, r = F.col("precision").cast("double"), F.col("recall").cast("double")
    means = facts.where("day is not null").groupBy("day", "bot").agg(F.avg(p).alias("p"), F.avg(r).alias("r"), F.avg(f_beta(p, r, beta)).alias("mean_f"), F.count(F.lit(1)).alias("n"))
    return means.select("day", "bot", "mean_f", f_beta(F.col("p"), F.col("r"), beta).alias("f_of_means"), "n")


def _exact(x: Column) -> Column:
    """``x`` as a decimal, so that sums do not depend on the order of rows; NULL where it is no finite number of that size."""
    return x.try_cast("decimal(38,24)")


def _exact_sum(x: Column, of: Column) -> Column:
    """Sum of the decimals ``x``; NULL if one of the values ``of`` has none."""
    return F.when(F.count(x) == F.count(of), F.try_sum(x))


def leaderboard(found: Filtered) -> DataFrame:
    """Per bot: sampled and scored rows, means over rows with both measures, F of the means, volume total.

    With a day threshold, days of fewer scored rows do not enter the means; sums and counts are carried, not means.
    Sums are decimal, so a mean on a rounding boundary comes out the same in every order of rows; measures that are not
    finite or too large for that are summed as doubles. Ordered by F, NULL last, then name.
    """
    spec = found.spec
    both = F.col("precision").isNotNull() & F.col("recall").isNotNull()
    p, r = F.when(both, F.col("precision").cast("double")), F.when(both, F.col("recall").cast("double"))
    if spec.min_per_day is None:
        part = found.facts.groupBy("bot", "username").agg(
            F.count(F.lit(1)).alias("sampled_prs"), F.count(p).alias("scored"), F.sum(p).alias("sp"), F.sum(r).alias("sr"), _exact_sum(_exact(p), p).alias("xp"), _exact_sum(_exact(r), r).alias("xr")
        )
    else:
        kept = lambda c: F.when(F.col("n") >= spec.min_per_day, F.col(c))
        part = (
            found.facts.groupBy("bot", "username", "day")
            .agg(
                F.count(F.lit(1)).alias("rows"), F.count(p).alias("n"), F.sum(p).alias("p"), F.sum(r).alias("r"),
                _exact_sum(_exact(p), p).alias("xp"), _exact_sum(_exact(r), r).alias("xr"),
            )
            .groupBy("bot", "username")
            .agg(
                F.sum("rows").alias("sampled_prs"), F.coalesce(F.sum(kept("n")), F.lit(0)).alias("scored"), F.sum(kept("p")).alias("sp"), F.sum(kept("r")).alias("sr"),
                _exact_sum(kept("xp"), kept("p")).alias("xp"), _exact_sum(kept("xr"), kept("r")).alias("xr"),
            )
        )
    mean = lambda x, s: F.coalesce(F.try_divide(x, "scored").cast("double"), F.try_divide(s, "scored"))
    ap, ar = mean("xp", "sp"), mean("xr", "sr")
    shown = part.join(found.totals, "bot", "left").select(
        F.col("username").alias("chatbot"), F.coalesce(ap, F.lit(0.0)).alias("precision"), F.coalesce(ar, F.lit(0.0)).alias("recall"), f_beta(ap, ar, spec.beta).alias("f_score"),
        "sampled_prs", F.col("scored").alias("scored_prs"), F.coalesce("total_prs", F.lit(0)).alias("total_prs"),
    )
    return shown.orderBy(F.desc_nulls_last("f_score"), "chatbot")


def volume_series(volumes: DataFrame, bots: DataFrame, spec: FilterSpec) -> DataFrame:
    """``day, bot, pr_count`` for every day of the range and every eligible bot with a volume in it, 0 where none.

    Open ends of the range come from the volumes of all bots. A reversed range and an empty table give nothing. The
    calendar is one row per bot exploded over days, so no product of two tables is formed.
    """
    if spec.empty_range:
        return volumes.select("day", "bot", "pr_count").limit(0)
    bounds = volumes.agg(F.coalesce(F.lit(spec.start), F.min("day")).alias("lo"), F.coalesce(F.lit(spec.end), F.max("day")).alias("hi"))
    inside = volumes.where(day_in_range(F.col("day"), spec)).join(bots.select("bot"), "bot", "left_semi").groupBy("bot", "day").agg(F.max("pr_count").alias("pr_count"))
    span = bounds.select(F.when(F.col("lo") <= F.col("hi"), F.sequence("lo", "hi")).alias("days"))
    counts = inside.groupBy("bot").agg(F.map_from_entries(F.collect_list(F.struct("day", "pr_count"))).alias("known"))
    days = counts.withColumn("day", F.explode(span.scalar()))
    return days.select("day", "bot", F.coalesce(F.try_element_at("known", F.col("day")), F.lit(0)).alias("pr_count"))


def options_long(facts: DataFrame, min_language: int = 5) -> DataFrame:
    """Values of each filter dimension with their rows: ``dim, value, n``; rare languages are left out."""
    dims = ["language", "domain", "pr_type", "severity"]
    pairs = facts.select(F.inline(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in dims]))).where("value is not null")
    counted = pairs.groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.col("dim") != "language") | (F.col("n") >= min_language))


def date_bounds(facts: DataFrame) -> DataFrame:
    return facts.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("day").alias("dated"), F.count(F.when(F.col("day").isNull(), 1)).alias("undated"))


def filter_options(facts: DataFrame, bots: DataFrame, min_language: int = 5) -> DataFrame:
    """One row of sorted arrays per dimension, the date bounds, and the bots that are not ignored and have facts.

    One pass over the facts: every row is counted once per dimension, with its day and its bot as two more of them.
    """
    dims = ["language", "domain", "pr_type", "severity"]
    pairs = [F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims]
    pairs += [F.struct(F.lit("day").alias("dim"), F.col("day").cast("string").alias("value")), F.struct(F.lit("bot").alias("dim"), F.col("bot").cast("string").alias("value"))]
    counted = facts.select(F.inline(F.array(*pairs))).where("value is not null").groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"))
    kept = counted.where((F.col("dim") != "language") | (F.col("n") >= min_language))
    names = bots.where("not ignored").select(F.lit("bot").alias("dim"), F.col("bot").cast("string").alias("value"), "username")
    of = lambda d, c="value": F.array_sort(F.collect_set(F.when(F.col("dim") == d, F.col(c))))
    day = lambda f: f(F.when(F.col("dim") == "day", F.to_date("value")))
    return kept.join(names, ["dim", "value"], "left").groupBy().agg(*[of(d).alias(f"{d}s") for d in dims], of("bot", "username").alias("chatbots"), day(F.min).alias("first_day"), day(F.max).alias("last_day"))


def status_counts(prs: DataFrame, bots: DataFrame) -> DataFrame:
    """``username, status, n`` over distinct pull requests."""
    return prs.join(bots, "bot").groupBy("username", "status").agg(F.count_distinct("id").alias("n"))
