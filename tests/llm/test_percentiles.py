import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import percentiles as pc

Q = (0, 10, 250, 500, 750, 990, 1000)
S = "id long, g string, p float, r double, at date, value string"


def rows(n=900):
    rng = random.Random(4)
    out = [(i, rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice([None, math.nan, 0.25, 0.25, rng.random(), rng.random() * 1e-30]), rng.choice([None, -5.0, rng.uniform(-1e6, 1e6)]), date(2026, 1, 1 + i % 5), "clash") for i in range(n)]
    return out + out[::7]


def exact(data, m, q):
    want = {}
    once = {r[0]: r for r in data}.values()
    for g in {r[1] for r in once} - {None}:
        import numpy as np

        vs = sorted(float(np.float32(r[2])) if m == 2 else r[3] for r in once if r[1] == g and r[m] is not None and not math.isnan(r[m]))
        if vs:
            want[g] = (len(vs), vs[max(1, (len(vs) * q + 999) // 1000) - 1])
    return want


def states(df):
    return pc.day_states(df, "g", ["p", "r"], "id", F.col("at"))


def test_exact_on_skewed_groups(frame):
    data = rows()
    got = {(r.g, r.measure, r.per_mille): (r.n, r.value) for r in pc.percentiles(states(frame(data, S)), "g", Q).collect()}
    for m, name in ((2, "p"), (3, "r")):
        for q in Q:
            want = exact(data, m, q)
            assert {g: v for (g, k, p), v in got.items() if k == name and p == q} == want


def test_states_of_days_combine(frame):
    df = frame(rows(300), S).dropDuplicates(["id"])
    whole = sorted(map(str, pc.percentiles(states(df), "g", (500,)).collect()))
    parts = [states(df.where(F.dayofmonth("at") == d)) for d in range(1, 6)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    assert sorted(map(str, pc.percentiles(union, "g", (500,)).collect())) == whole


def test_tolerance_bounds_the_error(frame):
    df = frame(rows(), S)
    true = {(r.g, r.measure, r.per_mille): r.value for r in pc.percentiles(states(df), "g", Q).collect()}
    for r in pc.percentiles(states(df), "g", Q, tolerance=0.01).collect():
        assert 0 <= r.value - true[r.g, r.measure, r.per_mille] <= 0.01


@pytest.mark.parametrize("values", [[1.0], [2.0] * 50, [-math.inf, 0.0, math.inf], [5e-324, 0.0, 1e-323], [1e308, -1e308, 3.0]])
def test_odd_values(frame, values):
    df = frame([(i, "g", None, v, date(2026, 1, 1), None) for i, v in enumerate(values)], S)
    got = {r.per_mille: r.value for r in pc.percentiles(states(df), "g", (0, 500, 1000)).collect()}
    clip = sorted(max(-8e307, min(8e307, v)) for v in values)
    assert got == {0: clip[0], 500: clip[(len(clip) + 1) // 2 - 1], 1000: clip[-1]}


def test_nothing(frame):
    assert pc.percentiles(states(frame([], S)), "g", Q).collect() == []
    assert states(frame([(1, None, 1.0, 1.0, None, None), (2, "g", math.nan, None, None, None)], S)).collect() == []


def test_grid_bounds_states_and_error(frame):
    rng = random.Random(9)
    rows = [(i, "g", rng.uniform(-2, 2)) for i in range(3000)] + [(5000, "g", None), (5001, "g", float("nan")), (5002, "h", 0.3)]
    df = frame(rows, "id long, grp string, v double").withColumn("day", F.col("id") % 3)
    exact = {(r.grp, r.per_mille): r.value for r in pc.percentiles(pc.day_states(df, "grp", ["v"], "id", F.col("day")), "grp", [10, 500, 990]).collect()}
    states = pc.day_states(df, "grp", ["v"], "id", F.col("day"), 1 / 16)
    assert states.groupBy("grp", "day").count().agg(F.max("count")).first()[0] <= 4 * 16
    for r in pc.percentiles(states, "grp", [10, 500, 990]).collect():
        assert 0 <= exact[r.grp, r.per_mille] - r.value < 1 / 16
