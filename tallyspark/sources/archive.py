"""Archive scans: day-partitioned events, and paging sources behind the Python data source interface."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def read_archive(spark: SparkSession, root: str, first: date, last: date) -> DataFrame:
    """Events of an archive partitioned by ``event_date``; days outside the inclusive range are never opened."""
    return spark.read.parquet(root).where(F.col("event_date").between(F.lit(first), F.lit(last)))


def write_archive(events: DataFrame, root: str, day: str = "day") -> None:
    """Write events partitioned by day; only the days present are replaced."""
    parts = events.withColumn("event_date", F.col(day)).repartition("event_date")
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(root)


class PagedFixture(DataSource):
    """Pages of a REST or cursor interface from files: ``page-*.json`` in ``path``, each ``{"items": [...], "next": n}``.

    The reader follows ``next`` from the page that no other page names, as a client follows its links, so order and
    end of the pages come from the data. ``spark.read.format("paged").schema(...).load(path)``.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "item string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PagedReader(self.options["path"], schema)


class _PagedReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.columns = path, schema.fieldNames()

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pathlib import Path

        pages = {int(re.findall(r"\d+", p.stem)[-1]): json.loads(p.read_text()) for p in Path(self.path).glob("page-*.json")}
        named = {p.get("next") for p in pages.values()}
        at, seen = min((n for n in pages if n not in named), default=None), set()
        while at is not None and at in pages and at not in seen:
            seen.add(at)
            for item in pages[at].get("items") or []:
                yield (json.dumps(item),) if self.columns == ["item"] else tuple(item.get(c) for c in self.columns)
            at = pages[at].get("next")
