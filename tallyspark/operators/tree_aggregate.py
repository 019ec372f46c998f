"""Per-key aggregates when a few keys hold most rows: a tree of partial states instead of one reducer per key.

Every row belongs to a fixed-size chunk of its input partition, and each map task combines its own chunks to one state
per (key, chunk) before anything moves. These leaves are checkpointed, so the input is read once whatever is asked of
them. Rounds then merge ``fan_in`` neighbouring nodes of a key each, as many as the number of chunks has digits to the
base ``fan_in``: no task ever receives more than ``fan_in`` partials of one key, at any size of the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.session import cut_lineage

NODE = "__tree_node"
#: How a partial state of each kind is opened from rows and merged with others.
OPEN = {
    "count": lambda c: F.count(F.lit(1)) if c is None else F.count(c),
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
}
MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def leaf_states(df: DataFrame, keys: Sequence[str], states: Sequence[tuple[str, str, Column | None]], chunk_rows: int = 65_536) -> DataFrame:
    """One state per (key, chunk of ``chunk_rows`` rows of an input partition), with the chunk's number, checkpointed.

    Chunks are numbered densely enough for a tree: partition number times the most chunks of any partition, plus the
    chunk's place in its partition.
    """
    row = F.monotonically_increasing_id()
    block = F.floor(row.bitwiseAND(F.lit((1 << 33) - 1)) / F.lit(chunk_rows))
    inputs = [(F.lit(1) if c is None else c).alias(f"__in_{i}") for i, (_, _, c) in enumerate(states)]
    opened = df.select(*keys, *inputs, F.shiftright(row, 33).alias("__part"), block.alias("__block"))
    parts = cut_lineage(opened.groupBy(*keys, "__part", "__block").agg(*[OPEN[kind](F.col(f"__in_{i}")).alias(name) for i, (name, kind, _) in enumerate(states)]))
    width = parts.agg((F.coalesce(F.max("__block"), F.lit(0)) + 1).alias("width")).scalar()
    return parts.withColumn(NODE, F.col("__part") * width + F.col("__block")).drop("__part", "__block")


def rounds(leaves: DataFrame, keys: Sequence[str], states: Sequence[tuple[str, str, Column | None]], fan_in: int = 32) -> list[DataFrame]:
    """The rounds of the merge tree over ``leaves``, the last of them with one state per key."""
    if fan_in < 2:
        raise ValueError("a merge tree needs fan_in >= 2")
    top = leaves.agg(F.max(NODE)).first()[0] or 0
    merged = [MERGE[kind](F.col(name)).alias(name) for name, kind, _ in states]
    out, parts = [], leaves
    while top >= fan_in:
        parts = parts.groupBy(*keys, F.floor(F.col(NODE) / fan_in).alias(NODE)).agg(*merged)
        top //= fan_in
        out.append(parts)
    return [*out, parts.groupBy(*keys).agg(*merged)]


def tree_aggregate(df: DataFrame, keys: Sequence[str], states: Sequence[tuple[str, str, Column | None]], fan_in: int = 32, chunk_rows: int = 65_536) -> DataFrame:
    """Aggregate ``df`` per ``keys`` by rounds of a merge tree, logarithmically many in the number of chunks.

    ``states`` lists ``(output name, kind, input column)`` with kind ``count``, ``sum``, ``min`` or ``max``; a count
    without a column counts rows.

    Null keys form a group of their own, as in SQL. Null inputs are skipped; a group with only nulls has null states
    (count 0). An empty input gives no rows. Further columns of ``df`` are pruned, whatever their names. Repeated rows
    count as often as they occur.
    """
    return rounds(leaf_states(df, keys, states, chunk_rows), keys, states, fan_in)[-1]


def normal_repo(name: Column) -> Column:
    """Trimmed, lower-cased, without one final ``.git``: the form under which spellings of a repository agree."""
    trimmed = F.regexp_replace(name, r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.lower(trimmed), r"\.git$", "")


def field_keys(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """One row per (row, field): ``field_name``, ``key_value``; a single narrow pass over the input for all fields."""
    pairs = F.array(*[F.struct(F.lit(n).alias("field_name"), c.cast("string").alias("key_value")) for n, c in fields.items()])
    return df.select(F.inline(pairs))


def heavy_keys(df: DataFrame, fields: dict[str, Column], share: int = 50, fan_in: int = 32, chunk_rows: int = 65_536) -> DataFrame:
    """Keys holding at least one ``share``-th (1/50 = 2 %) of all rows, per field: ``field_name, key_value``.

    The total counts every row, those with a null key included; a null key is no key and is never reported. An empty
    table has no heavy keys. Keys tying with the threshold are reported. One pass over the input feeds both the counts
    and the totals; the totals are one row per field, so the broadcast they allow is bounded by the number of fields.
    """
    keys, states = ["field_name", "key_value"], [("n", "count", None)]
    leaves = leaf_states(field_keys(df, fields), keys, states, chunk_rows)
    totals = leaves.groupBy("field_name").agg(F.sum("n").alias("total"))
    found = rounds(leaves, keys, states, fan_in)[-1].where("key_value is not null").join(F.broadcast(totals), "field_name")
    return found.where(F.col("n") * share >= F.col("total")).select("field_name", "key_value")
