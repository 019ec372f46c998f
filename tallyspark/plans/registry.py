"""All registered queries and the SQL they are checked against, without the optional subpackage for text data."""

from __future__ import annotations

import importlib

MODULES = ["core_problems", "serving", "pipeline", "benchmark"]


def collect() -> tuple[dict, dict]:
    queries: dict = {}
    sql: dict = {}
    for name in MODULES:
        module = importlib.import_module(f"tallyspark.plans.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
