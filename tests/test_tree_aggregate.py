import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.tree_aggregate import NODE, heavy_keys, leaf_states, normal_repo, rounds, tree_aggregate



def _states():
    v = F.col("v")
    return [("n", "count", None), ("k", "count", v), ("s", "sum", v), ("lo", "min", v), ("hi", "max", v)]


@pytest.mark.parametrize(("fan_in", "chunk"), [(2, 1), (3, 7), (8, 65_536)])
def test_equals_plain_aggregation_with_a_hot_key(frame, fan_in, chunk):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([None, *range(9)]), "x") for _ in range(700)]
    df = frame(rows, "key string, v int, n string").repartition(7)  # n clashes with an output name
    got = {r.key: (r.n, r.k, r.s, r.lo, r.hi) for r in tree_aggregate(df, ["key"], _states(), fan_in, chunk).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        own = [r[1] for r in rows if r[0] == key]
        vs = [x for x in own if x is not None]
        want[key] = (len(own), len(vs), sum(vs), min(vs), max(vs))
    assert got == want


def test_empty_table_and_all_null_group(frame):
    assert tree_aggregate(frame([], "key string, v int"), ["key"], _states()).collect() == []
    (row,) = tree_aggregate(frame([("a", None)] * 3, "key string, v int"), ["key"], _states()).collect()
    assert (row.n, row.k, row.s, row.lo, row.hi) == (3, 0, None, None, None)


def test_bad_tree_is_refused(frame):
    with pytest.raises(ValueError):
        tree_aggregate(frame([], "key string, v int"), ["key"], _states(), fan_in=1)


def test_heavy_keys_threshold_ties_and_nulls(frame):
    rows = [(1, "A/b.git")] * 2 + [(2, " a/B ")] + [(None, None)] * 47 + [(100 + i, f"r{i}") for i in range(50)]
    found = heavy_keys(frame(rows, "chatbot_id long, repo_name string"), {"chatbot_id": F.col("chatbot_id"), "repo_name": normal_repo(F.col("repo_name"))})
    assert {tuple(r) for r in found.collect()} == {("chatbot_id", "1"), ("repo_name", "a/b")}  # 2 of 100 is exactly 2 %


def test_repo_names(frame):
    names = [("  Org/Repo.GIT\t", "org/repo"), ("x.git.git", "x.git"), (" a ", "a"), (None, None), ("", "")]
    got = frame([(n,) for n, _ in names], "n string").select(normal_repo(F.col("n")).alias("x")).collect()
    assert [r.x for r in got] == [w for _, w in names]


def test_no_task_merges_more_than_fan_in_partials(spark):
    df = spark.range(0, 50_000, numPartitions=8).select(F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("key"), F.col("id").alias("v"))
    leaves = leaf_states(df, ["key"], _states(), chunk_rows=5)
    assert leaves.where("key = 'hot'").count() == 10_000
    levels, below = rounds(leaves, ["key"], _states(), fan_in=10), leaves
    assert len(levels) == 4  # log10 of 10,000 chunks
    for level in levels:
        last = NODE not in level.columns
        parents = below.groupBy("key", *([] if last else [F.floor(F.col(NODE) / 10)])).count()
        assert parents.agg(F.max("count")).first()[0] <= 10
        below = level
    assert levels[-1].where("key = 'hot'").first().n == 33_333


def test_the_input_is_read_once(spark, tmp_path):
    spark.range(1000).select((F.col("id") % 7).alias("a"), F.lit("r").alias("b")).write.parquet(str(tmp_path / "t"))
    plan = heavy_keys(spark.read.parquet(str(tmp_path / "t")), {"a": F.col("a"), "b": F.col("b")})._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and plan.count("Scan ExistingRDD") >= 2
