"""Readers for the engine's Parquet tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of the data directory; Spark prunes columns and pushes filters into this scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def write_version(rows: DataFrame, root: str, name: str) -> None:
    """Replace a table as a whole: write a new version beside the old one, then point to it.

    Readers take the version that the pointer names, so they see the old or the new table, never a part. The pointer is
    one small file, written last.
    """
    spark = rows.sparkSession
    version = uuid.uuid4().hex
    rows.write.parquet(f"{root}/{name}/version={version}")
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/CURRENT")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    out.write(bytearray(version.encode()))
    out.close()


def read_version(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The current version of a table written by :func:`write_version`."""
    version = spark.read.text(f"{root}/{name}/CURRENT").first().value
    return spark.read.parquet(f"{root}/{name}/version={version}")


#: Tables of the engine: name to schema.
SCHEMAS = {
    "chatbots": "id bigint, github_username string, display_name string, created_at timestamp_ntz",
    "prs": "id bigint, chatbot_id bigint, repo_name string, pr_number bigint, pr_url string, pr_title string, pr_author string, pr_created_at timestamp_ntz, pr_merged boolean, status string, enrichment_step string, bq_events string, commits string, reviews string, review_threads string, commit_details string, assembled string, diff_lines bigint, locked_by string, locked_at timestamp_ntz, error_message string, bot_reviewed_at timestamp_ntz, discovered_at timestamp_ntz, enriched_at timestamp_ntz, assembled_at timestamp_ntz, analyzed_at timestamp_ntz",
    "llm_analyses": "id bigint, pr_id bigint, chatbot_id bigint, bot_suggestions string, human_actions string, matching_results string, total_bot_comments int, matched_bot_comments int, precision float, recall float, f_beta float, model_name string, analyzed_at timestamp_ntz",
    "pr_labels": "id bigint, pr_id bigint, chatbot_id bigint, labels string, model_name string, labeled_at timestamp_ntz",
    "pr_volumes": "id bigint, chatbot_id bigint, date date, pr_count int, created_at timestamp_ntz",
}


def create_tables(spark: SparkSession, database: str) -> None:
    """Create the engine's tables where they are missing; columns that a table lacks are added to it."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, schema in SCHEMAS.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema}) USING parquet")
        have = set(spark.table(f"{database}.{name}").columns)
        for column in schema.split(", "):
            if column.split(" ")[0] not in have:
                spark.sql(f"ALTER TABLE {database}.{name} ADD COLUMNS ({column})")
