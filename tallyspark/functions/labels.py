"""Normal forms of the label dimensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.jsonx import parse_strict

#: Spellings of each dimension and the form they count as.
DOMAINS = {
    "frontend": "frontend", "backend": "backend", "infra": "infra", "infrastructure": "infra", "fullstack": "fullstack", "full-stack": "fullstack",
    "docs": "docs", "documentation": "docs", "other": "other",
}
PR_TYPES = {
    "feature": "feature", "bugfix": "bugfix", "bug": "bugfix", "fix": "bugfix", "refactor": "refactor", "refactoring": "refactor", "docs": "docs",
    "documentation": "docs", "test": "test", "tests": "test", "testing": "test", "chore": "chore", "other": "other",
}
SEVERITIES = {"low": "low", "medium": "medium", "high": "high", "critical": "critical"}


def clean(text: Column) -> Column:
    """Trimmed and lower-cased; an empty result is NULL."""
    return F.nullif(F.lower(F.trim(text)), F.lit(""))


def _mapped(text: Column, forms: dict[str, str], default: str | None) -> Column:
    key = clean(text)
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in forms.items() for x in kv]), key)
    return F.when(key.isNotNull(), F.coalesce(found, F.lit(default))) if default else found


def domain(text: Column) -> Column:
    """Known spellings to their form, other text to ``other``, NULL and blank to NULL."""
    return _mapped(text, DOMAINS, "other")


def pr_type(text: Column) -> Column:
    return _mapped(text, PR_TYPES, "other")


def severity(text: Column) -> Column:
    """One of four levels, else NULL."""
    return _mapped(text, SEVERITIES, None)


def string_field(json_text: Column, name: str) -> Column:
    """A field of a JSON object, NULL unless its value is a string: numbers and nested values do not count."""
    value = F.try_variant_get(parse_strict(json_text), f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))


def parsed_labels(json_text: Column) -> dict[str, Column]:
    """The four label dimensions of a label document."""
    return {
        "language": clean(string_field(json_text, "language")),
        "domain": domain(string_field(json_text, "domain")),
        "pr_type": pr_type(string_field(json_text, "pr_type")),
        "severity": severity(string_field(json_text, "severity")),
    }


def lowered(json_text: Column) -> Column:
    """``map<string, variant>`` of a label document: text and lists of text in lower case, other values as they are."""
    fields = F.try_variant_get(parse_strict(json_text), "$", "map<string,variant>")

    def low(value: Column) -> Column:
        kind = F.schema_of_variant(value)
        one = F.lower(value.cast("string")).cast("variant")
        many = F.to_variant_object(F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.lower(x.cast("string")).cast("variant")).otherwise(x)))
        return F.when(kind == "STRING", one).when(kind.startswith("ARRAY"), many).otherwise(value)

    return F.transform_values(fields, lambda _, v: low(v))


def display_label(json_text: Column, name: str) -> Column:
    """A label for tables: lower case, empty text where there is none."""
    return F.coalesce(F.lower(string_field(json_text, name)), F.lit(""))
