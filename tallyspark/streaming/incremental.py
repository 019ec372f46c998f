"""Streaming twins of the incremental operators; each equals its batch form on the same input within the late limit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LATE = "7 days"  # rows later than this behind the newest are dropped, as the default discovery window does


def event_stream(spark: SparkSession, path: str, like: DataFrame, per_trigger: int = 100) -> DataFrame:
    """File stream of events with the schema of ``like``; ``ts`` becomes a zoned timestamp, as watermarks need."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def once_per_key(stream: DataFrame, *keys: str) -> DataFrame:
    """First write wins: later rows of a key are dropped while its state is kept."""
    return stream.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(list(keys))


def daily_counts(stream: DataFrame, *keys: str) -> DataFrame:
    """Tumbling day windows in UTC per key."""
    return stream.withWatermark("ts", LATE).groupBy(F.window("ts", "1 day"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("window.start").alias("day"), *keys, "n")


def first_seen(stream: DataFrame, root: str) -> DataFrame:
    """``bot, pr_key, first_ts``: earliest time per pull request of what is there now.

    Every micro-batch is reduced to its own earliest times and appended to a table under ``root``; the earliest of those
    is taken on reading. The stream keeps no state, so its memory does not grow with the keys, and a row that comes late
    by any time still counts. A batch that is repeated after a failure writes its own part again.
    """

    def part(batch: DataFrame, number: int) -> None:
        batch.groupBy("bot", "pr_key").agg(F.min("ts").alias("first_ts")).write.mode("overwrite").parquet(f"{root}/parts/batch={number}")

    upsert_stream(stream, part, f"{root}/checkpoint").awaitTermination()
    return stream.sparkSession.read.parquet(f"{root}/parts").groupBy("bot", "pr_key").agg(F.min("first_ts").alias("first_ts"))


def first_seen_volumes(first: DataFrame) -> DataFrame:
    """``bot, day, pr_count`` from the state of :func:`first_seen`."""
    return first.groupBy("bot", F.to_date("first_ts").alias("day")).agg(F.count(F.lit(1)).alias("pr_count"))


def settled(stream: DataFrame, keys: list[str], root: str) -> DataFrame:
    """Run an aggregating stream over what is there; the last row of each of its keys.

    Changed rows of every micro-batch go to a table under ``root``, nothing is held by the driver; windows that the
    watermark has passed leave the state.
    """

    def part(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/parts/batch={number}")

    writer = stream.writeStream.foreachBatch(part).outputMode("update").option("checkpointLocation", f"{root}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{root}/parts")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def upsert_stream(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Feed micro-batches to ``merge``; ``every`` polls on, without it what is there is processed once."""
    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every).start() if every else writer.trigger(availableNow=True).start()
