"""One filter specification for every aggregate of the serving surface."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.labels import DOMAINS, PR_TYPES, SEVERITIES


@dataclass(frozen=True)
class FilterSpec:
    """Optional predicates and parameters; the defaults let everything pass except ignored bots."""

    start: date | None = None
    end: date | None = None
    bots: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    pr_types: tuple[str, ...] = ()
    severities: tuple[str, ...] = ()
    diff_min: int | None = None
    diff_max: int | None = None
    min_total: int | None = None
    min_per_day: int | None = None
    beta: float = 1.0
    include_ignored: bool = False

    @property
    def empty_range(self) -> bool:
        return self.start is not None and self.end is not None and self.start > self.end


def _day(text: str | None) -> date | None:
    try:
        return date.fromisoformat(text.strip()) if text else None
    except ValueError:
        return None


def _entries(text: str | None) -> tuple[str, ...]:
    return tuple(x for x in (p.strip().lower() for p in (text or "").split(",")) if x)


def _number(text: str | None, kind=int):
    try:
        return kind(text) if text not in (None, "") else None
    except ValueError:
        return None


def spec_from_query(params: dict[str, str]) -> FilterSpec:
    """A specification from request parameters.

    Lists are comma separated; bad dates and numbers are ignored; unknown severities vanish, and if none is left the
    filter is off; unknown domains and types count as ``other`` and do filter.
    """
    return FilterSpec(
        start=_day(params.get("start_date")),
        end=_day(params.get("end_date")),
        bots=_entries(params.get("chatbot")),
        languages=_entries(params.get("language")),
        domains=tuple(DOMAINS.get(x, "other") for x in _entries(params.get("domain"))),
        pr_types=tuple(PR_TYPES.get(x, "other") for x in _entries(params.get("pr_type"))),
        severities=tuple(SEVERITIES[x] for x in _entries(params.get("severity")) if x in SEVERITIES),
        diff_min=_number(params.get("diff_lines_min")),
        diff_max=_number(params.get("diff_lines_max")),
        min_total=_number(params.get("min_total_prs")),
        min_per_day=_number(params.get("min_prs_per_day")),
        beta=_number(params.get("beta"), float) or 1.0,
        include_ignored=params.get("include_ignored", "").lower() in ("1", "true", "yes"),
    )


def day_in_range(day: Column, spec: FilterSpec) -> Column:
    """Inclusive range, each end optional; a row without a day never qualifies, a reversed range lets nothing pass."""
    cond = day.isNotNull() & F.lit(not spec.empty_range)
    if spec.start:
        cond &= day >= F.lit(spec.start)
    if spec.end:
        cond &= day <= F.lit(spec.end)
    return cond


def bot_matches(username: Column, display: Column, ignored: Column, spec: FilterSpec) -> Column:
    """Name (user or display name, without case) and ignored flag."""
    cond = F.lit(True) if spec.include_ignored else ~F.coalesce(ignored, F.lit(False))
    if spec.bots:
        names = [b.lower() for b in spec.bots]
        cond &= F.lower(username).isin(names) | F.coalesce(F.lower(display).isin(names), F.lit(False))
    return cond


def record_matches(spec: FilterSpec) -> Column:
    """Label and size predicates: an active label filter excludes NULL labels, the size range lets NULL pass."""
    cond = F.lit(True)
    for column, values in (("language", spec.languages), ("domain", spec.domains), ("pr_type", spec.pr_types), ("severity", spec.severities)):
        if values:
            cond &= F.coalesce(F.col(column).isin(list(values)), F.lit(False))
    if spec.diff_min is not None:
        cond &= F.col("diff_lines").isNull() | (F.col("diff_lines") >= spec.diff_min)
    if spec.diff_max is not None:
        cond &= F.col("diff_lines").isNull() | (F.col("diff_lines") <= spec.diff_max)
    return cond


def dims_match(dims: dict[str, list[str]]) -> Column:
    """Membership in every named dimension's allowed values."""
    cond = F.lit(True)
    for name, values in dims.items():
        cond &= F.coalesce(F.col(name).isin(list(values)), F.lit(False))
    return cond


def dashboard_size_ok(low: int, high: int, above: bool, default: tuple[int, int] = (0, 2000)) -> Column:
    """The dashboard's variant: NULL passes only at the default range with the switch for larger ones off."""
    if (low, high) == default and not above:
        return F.col("diff_lines").isNull() | F.col("diff_lines").between(low, high)
    inside = F.col("diff_lines").between(low, high)
    return F.coalesce(inside | (F.col("diff_lines") > high) if above else inside, F.lit(False))


@dataclass(frozen=True)
class Filtered:
    """What one filter pass yields: eligible bots, matching facts, volume totals."""

    bots: DataFrame
    facts: DataFrame
    totals: DataFrame
    spec: FilterSpec = field(default_factory=FilterSpec)


def volume_totals(volumes: DataFrame, spec: FilterSpec) -> DataFrame:
    """``bot, total_prs`` over the date range."""
    return volumes.where(day_in_range(F.col("day"), spec)).groupBy("bot").agg(F.sum("pr_count").alias("total_prs"))


def apply_filters(facts: DataFrame, bots: DataFrame, volumes: DataFrame, spec: FilterSpec) -> Filtered:
    """``facts``: bot, day, precision, recall, diff_lines, labels; ``bots``: bot, username, display_name, ignored."""
    totals = volume_totals(volumes, spec)
    eligible = bots.where(bot_matches(F.col("username"), F.col("display_name"), F.col("ignored"), spec))
    if spec.min_total is not None:
        eligible = eligible.join(totals, "bot", "left").where(F.coalesce("total_prs", F.lit(0)) >= spec.min_total).drop("total_prs")
    kept = facts.where(day_in_range(F.col("day"), spec) & record_matches(spec)).join(eligible, "bot")
    return Filtered(eligible, kept, totals, spec)


def with_range(spec: FilterSpec, start: str | None, end: str | None) -> FilterSpec:
    return replace(spec, start=_day(start), end=_day(end))
