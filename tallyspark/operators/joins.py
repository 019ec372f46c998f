"""Joins that choose their strategy by a measured size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sized_join(big: DataFrame, small: DataFrame, key: str, spread: Column, how: str = "left", max_rows: int = 200_000, max_bytes: int = 64 << 20, salts: int = 16) -> DataFrame:
    """Join ``small`` (unique per ``key``) to ``big`` without ever gathering a hot key in one task.

    ``small`` is measured first, by rows up to ``max_rows`` and by the length of its values written out: within both
    bounds it is broadcast, beyond them the rows of a key are spread by ``spread`` over ``salts`` copies of the small
    side. Rows of ``big`` with a null key are kept by a left join.
    ``small`` should be cheap to read (a table or a checkpoint), as it is counted first.
    """
    rows, size = small.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()
    if rows <= max_rows and size <= max_bytes:
        return big.join(F.broadcast(small), key, how)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("__salt", F.pmod(F.hash(spread), F.lit(salts))).join(salted, [key, "__salt"], how).drop("__salt")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its input has fewer splits than the cluster has cores; larger inputs stay as read.

    Meant before narrow, compute-bound passes: a few small files would otherwise leave most cores idle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
