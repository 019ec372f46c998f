"""Score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def f_beta(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    """F-beta; NULL where either input is NULL or the denominator is not positive."""
    b2 = beta * beta
    denominator = precision * b2 + recall
    return F.when(denominator > 0, (1 + b2) * precision * recall / denominator)


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as double, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def percent(share: Column, digits: int = 1) -> Column:
    """``share`` times 100, rounded half up: a figure for display, never for further computing."""
    return F.round(share * 100, digits)
