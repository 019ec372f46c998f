from pyspark.sql import functions as F

from tallyspark.operators.joins import sized_join


def test_both_strategies_agree(frame):
    big = frame([(k, i) for i, k in enumerate(["a"] * 40 + ["b", None, "c"])], "k string, i int")
    small = frame([("a", 1), ("b", 2), ("d", 3)], "k string, v int")
    rows = lambda limit, how: sorted(map(str, sized_join(big, small, "k", F.col("i"), how, max_rows=limit, salts=5).select("k", "i", "v").collect()))
    for how in ("left", "inner"):
        assert rows(10, how) == rows(1, how)
    assert len(rows(1, "left")) == 43 and len(rows(1, "inner")) == 41
    assert "BroadcastHashJoin" not in sized_join(big, small, "k", F.col("i"), max_rows=1).hint("merge")._jdf.queryExecution().logical().toString()
