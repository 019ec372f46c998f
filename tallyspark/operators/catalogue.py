"""Slices of evaluation results: scores of every one- and two-dimension slice in one pass, best tools and models, order."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.scores import ratio
from tallyspark.functions.text import dimension_label

MIN_PRS = 5
_KEYS = ["dims", "values", "model", "tool"]


def with_labels(evals: DataFrame, labels: DataFrame, key: str, dims: Sequence[str], defaults: dict[str, str], unknown: str = "unknown") -> DataFrame:
    """Evaluations with the ``dims`` of their labels; where there is no label, or no value in it, the dimension's default."""
    both = evals.join(labels.select(key, *dims), key, "left")
    return both.withColumns({d: F.coalesce(d, F.lit(defaults.get(d, unknown))) for d in dims})


def slice_scores(evals: DataFrame, dims: Sequence[str], pairs: bool = True, unknown: str = "unknown") -> DataFrame:
    """``dims, values, model, tool, n_prs, tp, fp, fn, precision, recall, f1`` of every slice of one or two dimensions.

    One aggregation over grouping sets instead of a loop over slices. Slices of the value ``unknown`` are left out.
    """
    sets = [[d] for d in dims] + ([list(p) for p in combinations(dims, 2)] if pairs else [])
    grouped = evals.groupingSets([[F.col("model"), F.col("tool"), *[F.col(c) for c in s]] for s in sets], F.col("model"), F.col("tool"), *[F.col(d) for d in dims]).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n_prs"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    )
    shown = lambda i: F.bitwise_not(F.col("gid")).bitwiseAND(F.lit(1 << (len(dims) - 1 - i))) != 0
    names = F.filter(F.array(*[F.when(shown(i), F.lit(d)) for i, d in enumerate(dims)]), lambda x: x.isNotNull())
    values = F.filter(F.array(*[F.when(shown(i), F.coalesce(F.col(d).cast("string"), F.lit(unknown))) for i, d in enumerate(dims)]), lambda x: x.isNotNull())
    rows = grouped.select("model", "tool", "n_prs", "tp", "fp", "fn", names.alias("n"), values.alias("v")).where(~F.array_contains("v", unknown))
    return with_scores(rows.select(F.array_join("n", "+").alias("dims"), F.array_join("v", "+").alias("values"), "model", "tool", "n_prs", "tp", "fp", "fn"))


def with_scores(rows: DataFrame) -> DataFrame:
    """Precision, recall and F1 from counts; F1 as one fraction of whole numbers, so that equal scores are equal."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rows.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def best_tool(scores: DataFrame, metric: str = "f1", least: int = MIN_PRS) -> DataFrame:
    """Per slice and model the tool of the highest score; ties go to the first name; needs ``least`` rows and a positive score."""
    order = F.struct(-F.col(metric), "tool")
    top = scores.where((F.col("n_prs") >= least) & (F.col(metric) > 0)).groupBy("dims", "values", "model").agg(F.min(F.struct(order.alias("o"), F.col(metric).alias("score"), "n_prs")).alias("b"))
    return top.select("dims", "values", "model", F.col("b.o.tool").alias("tool"), F.col("b.score").alias("score"), F.col("b.n_prs").alias("n_prs"))


def best_model(scores: DataFrame, metric: str = "f1", least: int = MIN_PRS) -> DataFrame:
    """Per slice the model whose best tool scores highest, with that tool; ties go to the first model."""
    top = best_tool(scores, metric, least)
    pick = F.min(F.struct((-F.col("score")).alias("neg"), "model", "tool", "n_prs")).alias("b")
    return top.groupBy("dims", "values").agg(pick).select("dims", "values", F.col("b.model").alias("model"), F.col("b.tool").alias("tool"), (-F.col("b.neg")).alias("score"), F.col("b.n_prs").alias("n_prs"))


def missing_tools(scores: DataFrame, winners: DataFrame, least: int = MIN_PRS) -> DataFrame:
    """For every tool that wins no slice of ``winners``: the slice in which it is top or tied for the top.

    Precision and recall are tried where F1 gives none; fewer dimensions come first, then the higher score, then names.
    """
    metrics = F.array(*[F.struct(F.lit(i).alias("metric_no"), F.lit(m).alias("metric"), F.col(m).alias("score")) for i, m in enumerate(("f1", "precision", "recall"))])
    long = scores.where(F.col("n_prs") >= least).select(*_KEYS, "n_prs", F.inline(metrics))
    top = Window.partitionBy("dims", "values", "model", "metric_no")
    tops = long.withColumn("top", F.max("score").over(top)).where((F.col("score") == F.col("top")) & (F.col("score") > 0))
    lost = tops.join(winners.select("tool").distinct(), "tool", "left_anti")
    order = F.struct("metric_no", F.size(F.split("dims", r"\+")).alias("k"), (-F.col("score")).alias("neg"), "dims", "values", "model", "metric", "n_prs")
    return lost.groupBy("tool").agg(F.min(order).alias("b")).select("tool", "b.metric", "b.dims", "b.values", "b.model", (-F.col("b.neg")).alias("score"), "b.n_prs")


def diversity_order(filters: DataFrame) -> DataFrame:
    """``filters`` (tool, score, dims, values) with ``position``: each tool's best first, then the rest, by score."""
    own = Window.partitionBy("tool").orderBy(F.desc("score"), "dims", "values")
    ranked = filters.withColumn("later", F.row_number().over(own) > 1)
    # the catalogue has one row per slice of a few dimensions: a single small ordering
    return ranked.withColumn("position", F.row_number().over(Window.orderBy("later", F.desc("score"), "tool", "dims", "values"))).drop("later")


def predefined_filters(scores: DataFrame, dims: Sequence[str], pairs: Sequence[tuple[str, str]] = (), metric: str = "f1") -> DataFrame:
    """Slices of one dimension, and of the given pairs, that have a best model: its tool and score, and a readable label."""
    best = best_model(scores, metric).where(F.col("dims").isin(*dims, *["+".join(p) for p in pairs]))
    names = F.zip_with(F.split("dims", r"\+"), F.split("values", r"\+"), dimension_label)
    return best.withColumn("label", F.array_join(names, " + "))


def filter_catalogue(domains: dict[str, Sequence[str]], combos: Sequence[dict[str, str]] = ()) -> list[dict[str, list[str]]]:
    """Predefined filters: every value of every dimension, language with size, and given combinations."""
    single = [{d: [v]} for d, vs in domains.items() for v in vs if v != "unknown"]
    cross = [{"language": [a], "pr_size": [b]} for a in domains.get("language", ()) for b in domains.get("pr_size", ()) if "unknown" not in (a, b)]
    return single + cross + [{k: [v] for k, v in c.items()} for c in combos]


def dimension_domains(rows: DataFrame, dims: Sequence[str], unknown: str = "unknown") -> DataFrame:
    """``dim, value``: distinct values per dimension without the unknown one (its capitalised form stays)."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])
    return rows.select(F.inline(pairs)).where((F.col("value") != unknown) & F.col("value").isNotNull()).distinct()
