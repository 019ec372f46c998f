"""Table mutations and work queues as pure functions on snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The steps of enrichment in their order.
STEPS = ("bq_events", "commits", "reviews", "threads", "details", "done")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key by ``order``; equal rows collapse. Combines before the shuffle, so a hot key costs little."""
    rest = [c for c in rows.columns if c not in keys]
    lead = [*order, *[c for c in rest if c not in order]]
    return rows.groupBy(*keys).agg(F.max(F.struct(*lead)).alias("r")).select(*[c if c in keys else F.col(f"r.{c}").alias(c) for c in rows.columns])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """New rows replace old ones of the same key; within the new rows the last one wins."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns).unionByName(latest(new, keys, order).select(*old.columns))


def update_columns(rows: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``rows`` with ``columns`` taken from ``changes`` (unique per key) where the key is there; no row is added."""
    new = changes.select(*keys, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in columns])
    both = rows.join(new, list(keys), "left")
    return both.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else c for c in rows.columns])


def take_lock(rows: DataFrame, owner: str, now: Column, limit: int, *order: Column, stale_minutes: int = 30) -> DataFrame:
    """The first ``limit`` rows of the queue that are free or held too long, now held by ``owner`` and in status ``enriching``."""
    free = rows.where(lockable(F.col("locked_at"), now, stale_minutes))
    return queue(free, limit, *order).withColumns({"locked_by": F.lit(owner), "locked_at": now, "status": F.lit("enriching")})


def resume(rows: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that still have work: absent from ``state``, or there with errors (``errors_count`` above 0)."""
    done = state.where(F.coalesce("errors_count", F.lit(0)) == 0)
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def by_key(rows: DataFrame, **values: object) -> DataFrame:
    """Point look-up: the rows whose columns equal all ``values``; the predicates reach the scan."""
    for c, v in values.items():
        rows = rows.where(F.col(c) == F.lit(v))
    return rows


def pending(rows: DataFrame, statuses: Sequence[str], since: object, limit: int) -> DataFrame:
    """Work queue: status in ``statuses``, reviewed at or after ``since`` (all if None), newest first, at most ``limit``."""
    kept = rows.where(F.col("status").isin(list(statuses)))
    if since is not None:
        kept = kept.where(F.col("reviewed_at") >= F.lit(since))
    return queue(kept, limit, F.desc_nulls_last("reviewed_at"), F.asc("id"))


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``old`` yet; of several the first by ``order``."""
    fresh = new.join(old.select(*keys), list(keys), "left_anti")
    rest = [*order, *[c for c in fresh.columns if c not in keys and c not in order]]
    return fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*[c if c in keys else F.col(f"r.{c}").alias(c) for c in fresh.columns])


def delete_cascade(tables: dict[str, tuple[DataFrame, str]], doomed: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows that refer to a doomed key: ``tables`` maps a name to (table, its column)."""
    gone = doomed.select(F.col(key).alias("__gone")).distinct()
    return {n: t.join(gone, t[c] == gone["__gone"], "left_anti") for n, (t, c) in tables.items()}


def lockable(locked_at: Column, now: Column, stale_minutes: int = 30) -> Column:
    """Free, or locked longer ago than the stale cutoff."""
    return locked_at.isNull() | (locked_at < now - F.expr(f"INTERVAL '{stale_minutes}' MINUTE"))


def status_log(events: DataFrame, key: str) -> DataFrame:
    """Current status per key from an append-only log of (key, at, status)."""
    return events.groupBy(key).agg(F.max_by("status", F.struct("at", "status")).alias("status"), F.max("at").alias("at"))


def without(rows: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows with no partner in ``done``."""
    return rows.join(done.select(*on), list(on), "left_anti")


def queue(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first rows of a work queue: a top-k without a full sort."""
    return rows.orderBy(*order).limit(limit)


def size_gate(commits: Column, lines: Column, max_commits: int = 50, max_lines: int = 2000) -> dict[str, Column]:
    """Status and reason of an oversized pull request; NULL inputs pass."""
    many, large = commits > max_commits, lines > max_lines
    reason = F.when(many, F.concat(F.lit("commits "), commits.cast("string"), F.lit(f" > {max_commits}"))).when(large, F.concat(F.lit("lines "), lines.cast("string"), F.lit(f" > {max_lines}")))
    return {"status": F.when(F.coalesce(many | large, F.lit(False)), "skipped").otherwise("enriching"), "reason": reason}


def step_index(step: Column) -> Column:
    """Position of an enrichment step, 0 for none or an unknown one; a step is still to do if its index is not below."""
    names = F.array(*[F.lit(s) for s in STEPS])
    return F.greatest(F.coalesce(F.array_position(names, step), F.lit(0)), F.lit(0)).cast("int")


def remaining_steps(step: Column) -> Column:
    """Steps still to do after ``step``, in order; all of them where it is none."""
    return F.slice(F.array(*[F.lit(x) for x in STEPS]), step_index(step) + 1, F.lit(len(STEPS)))


def inferred_step(has: dict[str, Column]) -> Column:
    """Enrichment step of an imported record by the furthest stage present; NULL before the first one."""
    #: Stages from the last to the first, and the step each completes.
    ladder = [("analysis", "done"), ("assembled", "done"), ("details", "done"), ("threads", "threads"), ("reviews", "reviews"), ("commits", "commits"), ("events", "bq_events")]
    out = F.lit(None).cast("string")
    for stage, step in reversed(ladder):
        if stage in has:
            out = F.when(has[stage], step).otherwise(out)
    return out


def inferred_status(has: dict[str, Column]) -> Column:
    """Status of an imported record by the stages present, the furthest first; ``has`` maps a stage to a condition."""
    #: Stage files from the last to the first, and the status each implies.
    ladder = [("analysis", "analyzed"), ("assembled", "assembled"), ("details", "enriched"), ("threads", "enriching"), ("reviews", "enriching"), ("commits", "enriching"), ("events", "pending")]
    out = F.lit(None).cast("string")
    for stage, status in reversed(ladder):
        if stage in has:
            out = F.when(has[stage], status).otherwise(out)
    return F.coalesce(out, F.lit("pending"))


def backfill_diff_lines(rows: DataFrame, computed: Column) -> DataFrame:
    """Missing sizes filled in one vectorised pass."""
    return rows.withColumn("diff_lines", F.coalesce("diff_lines", computed))


def incremental_merge(old: DataFrame, new: DataFrame, keys: Sequence[str], force: bool = False) -> DataFrame:
    """Add records whose key is absent; with ``force`` the new ones replace the old."""
    if force:
        return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti"))


def missing_sizes(rows: DataFrame) -> DataFrame:
    """``n``: rows without a size whose details are there."""
    return rows.where("diff_lines is null and has_details").agg(F.count(F.lit(1)).alias("n"))
