"""Reference findings against candidates: judged pairs, acceptance by running best, scores.

Findings and candidates are known by their text: equal texts of a review are one finding and one candidate in all
counts, while the totals are the lengths of the lists. The list of reviews is an input of its own, so that a review
that brought nothing still misses every finding.

The judge is any function from the pair table to ``match`` and ``confidence`` columns: a column expression such as
:func:`lexical_judge`, or a scorer of :mod:`tallyspark.functions.scorers` behind an Arrow UDF.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.scores import percent, ratio


def _has_text(x: Column) -> Column:
    return F.regexp_replace(x, r"\s+", "") != ""


def pairs(golden: DataFrame, candidates: DataFrame) -> DataFrame:
    """All pairs of a reference text and a candidate of the same url and tool: the matrix that has to be judged.

    ``golden``: url, golden_idx, golden; ``candidates``: url, tool, cand_idx, candidate. The join is on the url, so the
    pairs of one pull request are all that meets; blank candidates are dropped.
    """
    real = candidates.where(_has_text(F.col("candidate")))
    return golden.join(real, "url")


def lexical_judge(threshold: float = 0.05) -> Callable[[DataFrame], DataFrame]:
    """Deterministic judge: Jaccard similarity of the word sets is the confidence, a match above ``threshold``."""

    def judge(p: DataFrame) -> DataFrame:
        words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""))
        both = p.withColumns({"__g": words("golden"), "__c": words("candidate")})
        shared = F.size(F.array_intersect("__g", "__c"))
        score = ratio(shared, F.size("__g") + F.size("__c") - shared)
        return both.withColumn("confidence", score).withColumn("match", F.col("confidence") > threshold).drop("__g", "__c")

    return judge


def accepted(judged: DataFrame) -> DataFrame:
    """Pairs with ``accepted``: matched without error, with a confidence above 0 and above every accepted one before it.

    Order is by reference text, then candidate; pairs of equal reference texts form one sequence.
    """
    failed = F.col("error").isNotNull() if "error" in judged.columns else F.lit(False)
    score = F.when(F.coalesce(F.col("match"), F.lit(False)) & ~failed & (F.coalesce("confidence", F.lit(0.0)) > 0), F.col("confidence"))
    before = Window.partitionBy("url", "tool", "golden").orderBy("golden_idx", "cand_idx").rowsBetween(Window.unboundedPreceding, -1)
    scored = judged.withColumn("__score", score)
    best = F.coalesce(F.max("__score").over(before), F.lit(0.0))
    return scored.withColumns({"accepted": F.coalesce(F.col("__score") > best, F.lit(False)), "failed": failed}).drop("__score")


def golden_matches(acc: DataFrame) -> DataFrame:
    """Per reference text its first place, whether it is matched, and its best accepted candidate, the earliest on ties."""
    best = F.max_by("candidate", F.when(F.col("accepted"), F.struct("confidence", -F.col("golden_idx"), -F.col("cand_idx"))))
    return acc.groupBy("url", "tool", "golden").agg(F.min("golden_idx").alias("golden_idx"), F.bool_or("accepted").alias("matched"), best.alias("candidate"))


def review_scores(reviews: DataFrame, golden: DataFrame, candidates: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``url, tool, skipped, tp, fp, fn, errors_count, total_candidates, total_golden, precision, recall`` per review.

    ``reviews``: url, tool. Reviews without reference texts are skipped; without candidates all reference texts are
    missed. Precision divides the matched reference texts by all candidates, so it can exceed 1 if one candidate serves
    several. Pairs that could not be judged count as errors and match nothing. One aggregation of the judged pairs
    yields all counts.
    """
    acc = accepted(judge(pairs(golden, candidates)))
    hit = lambda c: F.count_distinct(F.when(F.col("accepted"), F.col(c)))
    found = acc.groupBy("url", "tool").agg(
        hit("golden").alias("tp"), F.count_distinct("golden").alias("__golden"), hit("candidate").alias("__used"), F.count_distinct("candidate").alias("__texts"), F.count_if("failed").alias("errors_count")
    )
    n_cand = candidates.where(_has_text(F.col("candidate"))).groupBy("url", "tool").agg(F.count(F.lit(1)).alias("total_candidates"))
    n_gold = golden.groupBy("url").agg(F.count(F.lit(1)).alias("total_golden"))
    rows = reviews.select("url", "tool").distinct().join(n_cand, ["url", "tool"], "left").join(n_gold, "url", "left").join(found, ["url", "tool"], "left")
    zero = F.lit(0).cast("bigint")
    n = {c: F.coalesce(c, zero) for c in ("tp", "total_candidates", "total_golden", "errors_count", "__used", "__texts", "__golden")}
    missed = F.when(n["total_candidates"] == 0, n["total_golden"]).otherwise(n["__golden"] - n["tp"])
    skipped = F.col("total_golden").isNull()
    return rows.select(
        "url", "tool", skipped.alias("skipped"), n["tp"].alias("tp"), (n["__texts"] - n["__used"]).alias("fp"), missed.alias("fn"), n["errors_count"].alias("errors_count"), n["total_candidates"].alias("total_candidates"), n["total_golden"].alias("total_golden"),
        ratio(n["tp"], n["total_candidates"]).alias("precision"), ratio(n["tp"], n["total_golden"]).alias("recall"),
    )


def micro_average(reviews: DataFrame, by: str = "tool", keep_skipped: bool = False) -> DataFrame:
    """Sums, then ratios: precision, recall and F1 per ``by``; 0 where a denominator is 0."""
    rows = reviews if keep_skipped else reviews.where(~F.col("skipped"))
    s = rows.groupBy(by).agg(F.count(F.lit(1)).alias("reviews"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return s.select(by, "reviews", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def chosen_candidates(reviews: DataFrame, cached: DataFrame) -> DataFrame:
    """Candidates per (url, tool): the extracted ones where the key is cached, even if empty, else the raw bodies."""
    keyed = reviews.join(cached.select("url", "tool", "texts", F.lit(True).alias("has_key")), ["url", "tool"], "left")
    return keyed.select("url", "tool", F.filter(F.when(F.col("has_key"), F.coalesce("texts", F.array().cast("array<string>"))).otherwise(F.col("bodies")), _has_text).alias("candidates"))


def dashboard_average(reviews: DataFrame, by: str = "tool") -> DataFrame:
    """As :func:`micro_average` with skipped reviews counted in, as percentages of one decimal, and ``num_prs``."""
    rows = micro_average(reviews, by, keep_skipped=True)
    return rows.select(by, F.col("reviews").alias("num_prs"), "tp", "fp", "fn", *[percent(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])
