"""Strict JSON handling on VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_END = "end-of-value"


def parse_strict(text: Column) -> Column:
    """VARIANT of a text that is exactly one complete JSON value, else NULL.

    The parser stops after the first value, so the text is read as the first element of an array whose second element
    is a sentinel: trailing content, a missing bracket or an empty text all break that shape.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))
    whole = F.try_variant_get(wrapped, "$[1]", "string") == F.lit(_END)
    return F.when(whole & F.try_variant_get(wrapped, "$[2]", "variant").isNull(), F.try_variant_get(wrapped, "$[0]", "variant"))


def is_string(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def unwrap(value: Column) -> Column:
    """A VARIANT string holding JSON is replaced by that JSON (NULL if it is none); other values pass."""
    return F.when(is_string(value), parse_strict(value.cast("string"))).otherwise(value)


def as_array(value: Column) -> Column:
    """``array<variant>`` of an array value, else NULL."""
    return F.try_variant_get(value, "$", "array<variant>")


def as_map(value: Column) -> Column:
    """``map<string, variant>`` of an object value, else NULL."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def scalar_text(value: Column, path: str) -> Column:
    """Text of a scalar at ``path``; objects, arrays and nulls give NULL."""
    got = F.try_variant_get(value, path, "variant")
    kind = F.schema_of_variant(got)
    return F.when(~(kind.startswith("OBJECT") | kind.startswith("ARRAY") | (kind == "VOID")), got.cast("string"))
