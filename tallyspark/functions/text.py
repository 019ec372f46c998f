"""String functions on names, urls and lists."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shapes of addresses and of benchmark repository names that are recognised.
_PR_URL = r"github\.com/([^/]+)/([^/]+)/pull/([0-9]+)"
_REVIEW_REPO = r"^(.+?)__(.+?)__(.+?)__PR([0-9]+)__([0-9]+)$"


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, i))


def pr_url_parts(url: Column) -> dict[str, Column]:
    """Owner, repository (without any ``.git`` in it) and number of a pull-request address; NULL if it is none."""
    repo = F.replace(_group(url, _PR_URL, 2), F.lit(".git"), F.lit(""))
    return {"owner": _group(url, _PR_URL, 1), "repo": repo, "number": _group(url, _PR_URL, 3).try_cast("int")}


def review_repo_parts(name: Column) -> dict[str, Column]:
    """Parts of a name like ``prefix__repo__tool__PR12__20240101``; NULL if it has another shape."""
    keys = ["prefix", "source_repo", "tool", "pr_number", "stamp"]
    return {k: _group(name, _REVIEW_REPO, i) for i, k in enumerate(keys, 1)}


def review_repo_name(repo: Column, number: Column, tool: Column, day: Column, prefix: Column | None = None) -> Column:
    """``prefix__repo__tool__PR12__20240101``; the tool as a slug, without prefix where that is NULL or empty."""
    parts = [repo, slug(tool), F.concat(F.lit("PR"), number.cast("string")), F.date_format(day, "yyyyMMdd")]
    return F.concat_ws("__", *([] if prefix is None else [F.nullif(prefix, F.lit(""))]), *parts)


def slug(text: Column, limit: int = 30) -> Column:
    """Lower case, runs of other characters as one hyphen, none at the ends, at most ``limit`` characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, limit)


def csv_values(text: Column) -> Column:
    """Trimmed lower-case entries of a comma list, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def suffix_of(day: Column) -> Column:
    return F.date_format(day, "yyMMdd")


def day_of_suffix(suffix: Column) -> Column:
    return F.to_date(F.concat(F.lit("20"), suffix), "yyyyMMdd")


def same_sha(a: Column, b: Column) -> Column:
    """Equal, or one a prefix of the other; empty names match nothing."""
    return (F.length(a) > 0) & (F.length(b) > 0) & (a.startswith(b) | b.startswith(a))


def unfenced(text: Column) -> Column:
    """Content of the first code fence, or the text itself."""
    pattern = r"(?s)```[A-Za-z]*\s*(.*?)```"
    return F.regexp_replace(F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text), r"^\s+|\s+$", "")


def safe_model_name(name: Column) -> Column:
    return F.replace(F.trim(name), F.lit("/"), F.lit("_"))


def short_label(repo: Column, number: Column) -> Column:
    """``name#12`` for ``owner/name`` and 12."""
    return F.concat(F.element_at(F.split(repo, "/"), -1), F.lit("#"), number.cast("string"))


#: Labels of dimension values that are not their title-cased form.
TITLES = {
    ("pr_size", "small"): "Small PRs", ("pr_size", "medium"): "Medium PRs", ("pr_size", "large"): "Large PRs",
    ("complexity", "simple"): "Simple Code", ("complexity", "moderate"): "Moderate Code", ("complexity", "complex"): "Complex Code",
    ("difficulty", "obvious"): "Obvious Bugs", ("difficulty", "moderate"): "Moderate Bugs", ("difficulty", "subtle"): "Subtle Bugs", ("difficulty", "very_subtle"): "Very Subtle Bugs",
    ("risk", "low"): "Low Risk", ("risk", "medium"): "Medium Risk", ("risk", "high"): "High Risk", ("risk", "critical"): "Critical Risk",
    ("context", "local"): "Local Context", ("context", "file"): "File Context", ("context", "cross_file"): "Cross-File", ("context", "system"): "System-Wide",
    ("change_type", "bug_fix"): "Bug Fixes", ("change_type", "feature"): "Features", ("change_type", "refactoring"): "Refactoring", ("change_type", "security_patch"): "Security Patches",
    ("change_type", "performance"): "Performance Optimization", ("change_type", "migration"): "Migration", ("change_type", "test_update"): "Test Updates",
}


def dimension_label(dim: Column, value: Column) -> Column:
    """Readable label of a dimension's value: one of :data:`TITLES`, else the value in title case."""
    table = F.create_map(*[F.lit(x) for (d, v), t in TITLES.items() for x in (f"{d}/{v}", t)])
    return F.coalesce(F.try_element_at(table, F.concat_ws("/", dim, value)), title_label(value))


def title_label(value: Column) -> Column:
    return F.initcap(F.regexp_replace(value, "[_-]+", " "))


def palette_index(name_rank: Column, size: int) -> Column:
    return (name_rank - 1) % size


def since_day(text: str | None, now: datetime) -> str | None:
    """Start of a window as an ISO stamp: ``7d`` counts days back from ``now``, other text passes as it is."""
    if not text:
        return None
    back = re.fullmatch(r"(\d+)d", text)
    return (now - timedelta(days=int(back[1]))).isoformat() if back else text


def backoff_seconds(attempt: int) -> int:
    """Pause before try ``attempt`` + 1 of a call: 1, 2, 4, ... seconds."""
    return 2**attempt
