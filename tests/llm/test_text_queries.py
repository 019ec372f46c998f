import math
import os
from pathlib import Path

import duckdb
import pytest

from tallyspark.llm.queries import QUERIES, SQL

DATA = Path(os.environ.get("TALLYSPARK_TEST_DATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


def ordered(rows):
    value = lambda v: round(v, 5) if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted((tuple(map(value, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = ordered([tuple(r[c] for c in columns) for r in df.collect()])
    assert got
    if name in SQL:
        con = duckdb.connect()
        for p in DATA.glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        res = con.execute(SQL[name])
        names = [c[0] for c in res.description]
        assert got == ordered([tuple(r[names.index(c)] for c in columns) for r in res.fetchall()])
