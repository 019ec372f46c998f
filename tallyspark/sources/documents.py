"""Readers for JSON documents: reference sets, keyed maps, model directories, legacy trees, configuration."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLDEN = "pr_title string, url string, pr_url string, original_url string, az_comment string, comments array<struct<comment:string,severity:string>>"
CANDIDATES = "map<string,map<string,array<struct<text:string,path:string,line:int,source:string>>>>"
EVALUATIONS = "map<string,map<string,struct<skipped:boolean,tp:bigint,fp:bigint,fn:bigint,errors_count:bigint,total_candidates:bigint,total_golden:bigint,precision:double,recall:double>>>"
REVIEWS = (
    "map<string,struct<pr_title:string,original_url:string,source_repo:string,golden_source_file:string,az_comment:string,golden_comments:array<struct<comment:string,severity:string>>,"
    "reviews:array<struct<tool:string,repo_name:string,pr_url:string,review_comments:array<struct<path:string,line:int,body:string,created_at:string>>>>>>"
)


def read_golden(spark: SparkSession, folder: str) -> DataFrame:
    """Reference sets of a folder of JSON arrays; for an address in several files the last file by name counts."""
    rows = spark.read.schema(GOLDEN).option("multiLine", "true").json(f"{folder}/*.json").withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    key = F.coalesce(F.nullif("url", F.lit("")), F.nullif("pr_url", F.lit("")))
    keyed = rows.withColumn("key", key).where("key is not null")
    return keyed.groupBy("key").agg(F.max_by(F.struct("pr_title", "original_url", "az_comment", "comments", "source_file"), "source_file").alias("g")).select(F.col("key").alias("url"), "g.*")


def golden_rows(golden: DataFrame) -> DataFrame:
    """One row per reference text: ``url, golden_idx, golden, severity``."""
    return golden.select("url", F.posexplode("comments").alias("golden_idx", "c")).select("url", "golden_idx", F.col("c.comment").alias("golden"), F.col("c.severity").alias("severity"))


def pr_urls(golden_files: DataFrame) -> DataFrame:
    """Addresses of reference records: ``url``, else ``pr_url``; only non-empty text."""
    return golden_files.select(F.coalesce(F.nullif(F.trim("url"), F.lit("")), F.nullif(F.trim("pr_url"), F.lit(""))).alias("url")).where("url is not null")


def read_map(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A JSON document that is one map: ``key, value`` rows. ``kind`` is one of the map types above."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.from_json("value", kind).alias("m")).select(F.explode("m"))


def candidate_rows(spark: SparkSession, path: str) -> DataFrame:
    """``url, tool, cand_idx, candidate, path, line, source`` of a candidates document; an empty list gives no row."""
    tools = read_map(spark, path, CANDIDATES).select(F.col("key").alias("url"), F.explode("value").alias("tool", "items"))
    return tools.select("url", "tool", F.posexplode("items").alias("cand_idx", "c")).select("url", "tool", "cand_idx", F.col("c.text").alias("candidate"), "c.path", "c.line", "c.source")


def candidate_keys(spark: SparkSession, path: str) -> DataFrame:
    """``url, tool, texts``: every cached key, empty ones included."""
    tools = read_map(spark, path, CANDIDATES).select(F.col("key").alias("url"), F.explode("value").alias("tool", "items"))
    return tools.select("url", "tool", F.transform("items", lambda c: c.text).alias("texts"))


def evaluation_rows(spark: SparkSession, path: str) -> DataFrame:
    return read_map(spark, path, EVALUATIONS).select(F.col("key").alias("url"), F.explode("value").alias("tool", "e")).select("url", "tool", "e.*")


def review_rows(spark: SparkSession, path: str) -> DataFrame:
    """``url, source_repo, tool, bodies``: raw review texts of a benchmark document."""
    rows = read_map(spark, path, REVIEWS).select(F.col("key").alias("url"), F.col("value.source_repo").alias("source_repo"), F.explode("value.reviews").alias("r"))
    return rows.select("url", "source_repo", F.col("r.tool").alias("tool"), F.transform("r.review_comments", lambda c: c.body).alias("bodies"))


def read_models(spark: SparkSession, root: str, models: Sequence[str]) -> DataFrame:
    """Evaluations of several model directories with their ``model``."""
    parts = [evaluation_rows(spark, f"{root}/{m}/evaluations.json").withColumn("model", F.lit(m)) for m in sorted(models)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def model_names(spark: SparkSession, root: str) -> DataFrame:
    """Sorted names of the directories below ``root`` that hold an evaluations document."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "evaluations.json").load(root)
    return found.select(F.element_at(F.split("path", "/"), -2).alias("model")).distinct().orderBy("model")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Records of a legacy tree ``user/owner/repo/number/stage.json``: the path parts and the raw text."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True).withColumn("p", F.split(F.input_file_name(), "/"))
    part = lambda i: F.element_at("p", i)
    return files.select(part(-5).alias("user"), part(-4).alias("owner"), part(-3).alias("repo"), part(-2).try_cast("bigint").alias("number"), F.regexp_replace(part(-1), r"\.json$", "").alias("stage"), F.col("value").alias("raw"))


def token_list(value: str) -> list[str]:
    """Tokens of a comma list, or of a file with one per line."""
    if os.path.isfile(value):
        with open(value, encoding="utf-8") as f:
            lines = f.read().splitlines()
    else:
        lines = value.split(",")
    return [x.strip() for x in lines if x.strip() and not x.strip().startswith("#")]


def seed_bots(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """Bots of a configuration list as a table: ``username, display_name``; repeated names count once."""
    rows = [(n, n) for n in dict.fromkeys(x.strip() for x in names if x.strip())]
    return spark.createDataFrame(rows, "username string, display_name string")


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A relational source by query; partitioning options pass through."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def table_or_empty(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """A catalogue table, or no rows where it does not exist."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)
