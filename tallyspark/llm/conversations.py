"""Conversations rebuilt from message rows: reply graphs, order, roles, completeness.

Messages, and the timeline rows that can name a missing author, meet in one aggregation by comment id, which also
merges repeated deliveries before the shuffle. Threads are then judged together: Kahn's algorithm peels the reply
graphs of all threads of a batch at once, from the comments that reply to none along the reply edges, each round in
time order; whatever is left over lies on a cycle or hangs on a missing comment. A thread too large for one task is
peeled in the same way block by block: blocks are stretches of time, and what a block frees is told to the blocks that
hold the replies, until nothing new is freed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.jsonx import parse_strict, unwrap
from tallyspark.functions.stamps import with_instant
from tallyspark.operators.joins import sized_join
from tallyspark.session import cut_lineage, ship_package

#: White space and characters that do not show.
_BLANK = r"[\s\p{Z}\p{C}͏ᅟᅠ឴឵᠋-᠏︀-️⠀ㅤﾠ]+"
ROLES = ("bot", "author", "reviewer")
COLUMNS = ["thread_id", "turn_no", "comment_id", "speaker_role", "depth", "kahn_no", "roles_alternate"]
_OUT = "thread_id string, turn_no bigint, comment_id bigint, speaker_role string, depth bigint, kahn_no bigint, roles_alternate boolean"


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.regexp_replace(text, _BLANK, "") == "")


def speaker_key(name: Column) -> Column:
    """Form under which names of one speaker agree; NULL for a blank name and for ``unknown``."""
    key = F.regexp_replace(F.lower(F.regexp_replace(name, rf"^{_BLANK}|{_BLANK}$", "")), r"\[bot\]$", "")
    return F.when(~key.isin("", "unknown"), key)


def messages(comments: DataFrame, timeline: DataFrame, prs: DataFrame, bots: DataFrame) -> DataFrame:
    """One row per comment: ``thread_id, comment_id, parent_id, at_us, has_text, speaker, role``.

    Of repeated deliveries the first by ingestion counts, whole; of several actors that name a missing author the first
    by name.
    """
    own = with_instant(comments.where("thread_id is not null and comment_id is not null").select("thread_id", "pr_id", "comment_id", "in_reply_to_id", "author", "body", "created_at", "ingested_at"), "created_at", "1970-01-01", "2200-01-01")
    fields = {
        "seen": F.col("ingested_at"), "thread_id": F.col("thread_id"), "pr_id": F.col("pr_id"), "parent_id": F.col("in_reply_to_id"), "at_us": F.coalesce("epoch_us", "wall_us"),
        "has_text": ~is_blank(F.col("body")), "author": speaker_key(F.col("author")),
    }
    own = own.select("comment_id", F.struct(*[c.alias(n) for n, c in fields.items()]).alias("own"))
    data = timeline.where("event_type = 'review_comment' and data is not null").select(speaker_key(F.col("actor")).alias("actor"), unwrap(unwrap(parse_strict(F.col("data")))).alias("data"))
    named = data.select(F.try_variant_get("data", "$.comment_id", "bigint").alias("comment_id"), "actor").where("actor is not null and comment_id is not null")
    met = own.unionByName(named, allowMissingColumns=True).groupBy("comment_id").agg(F.min("own").alias("own"), F.min("actor").alias("actor")).where("own is not null")
    met = met.select("comment_id", "own.*", "actor").drop("seen").withColumn("speaker", F.coalesce("author", "actor"))
    owner = prs.groupBy(F.col("id").alias("pr_id")).agg(F.min(speaker_key(F.col("pr_author"))).alias("owner"))
    bot_keys = bots.select(speaker_key(F.col("github_username")).alias("speaker")).where("speaker is not null").distinct().withColumn("is_bot", F.lit(True))
    met = sized_join(met.join(owner, "pr_id", "left"), bot_keys, "speaker", F.col("comment_id"))
    role = F.when(F.col("speaker").isNull(), None).when(F.col("is_bot"), "bot").when(F.col("speaker") == F.col("owner"), "author").otherwise("reviewer")
    return met.select("thread_id", "comment_id", "parent_id", "at_us", "has_text", "speaker", role.alias("role"))


def peel(thread: np.ndarray, ident: np.ndarray, parent: np.ndarray, has_parent: np.ndarray, at: np.ndarray, given: np.ndarray | None = None) -> np.ndarray:
    """Kahn's algorithm on the reply graphs of many threads: round in which each comment is freed, -1 if never.

    ``thread`` numbers the threads from 0. A comment is freed by the comment it replies to, in the same thread; those
    replying to none are free at once. ``given`` holds the round of comments freed from outside these rows, -1 for the
    others. Within a round comments are freed in time order, then by id. The work is linear in the comments, each round
    touching its frontier only.
    """
    n = len(ident)
    order = np.lexsort((ident, thread))
    key_t, key_i = thread[order], ident[order]
    source = np.full(n, -1, np.int64)
    want = np.flatnonzero(has_parent)
    if len(want):
        # ids rank alike in all threads: search (thread, rank) as one number
        ranks = np.unique(ident)
        code = key_t * (len(ranks) + 1) + np.searchsorted(ranks, key_i)
        r = np.searchsorted(ranks, parent[want])
        known = (r < len(ranks)) & (ranks[np.minimum(r, len(ranks) - 1)] == parent[want])
        look = thread[want] * (len(ranks) + 1) + r
        p = np.searchsorted(code, look)
        known &= (p < n) & (code[np.minimum(p, n - 1)] == look)
        source[want[known]] = order[p[known]]
    freed = np.full(n, -1, np.int64)
    child = np.flatnonzero(source >= 0)
    child = child[np.lexsort((ident[child], at[child], source[child]))]
    begin = np.searchsorted(source[child], np.arange(n + 1))
    if given is None:
        given = np.where(has_parent, -1, 0)
    front = np.flatnonzero(given >= 0)
    freed[front] = given[front]
    while len(front):
        count = begin[front + 1] - begin[front]
        total = int(count.sum())
        offset = np.repeat(begin[front] - (np.cumsum(count) - count), count)
        reply, step = child[offset + np.arange(total)], np.repeat(freed[front] + 1, count)
        fresh = freed[reply] < 0
        front = reply[fresh]
        freed[front] = step[fresh]
    return freed


def judge(t: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Rows of the kept threads' non-blank comments in order, with ``turn_no, depth, kahn_no, roles_alternate``."""
    thread = t["thread"]
    threads = int(thread.max()) + 1 if len(thread) else 0
    freed = peel(thread, t["comment_id"], t["parent_id"], t["has_parent"], t["at_us"])
    roots = np.bincount(thread[~t["has_parent"]], minlength=threads)
    bad = np.bincount(thread[(freed < 0) | (t["speaker"] < 0)], minlength=threads)
    low, high = np.full(threads, np.iinfo(np.int64).max), np.full(threads, -1)
    said = np.flatnonzero(t["has_text"])
    np.minimum.at(low, thread[said], t["speaker"][said])
    np.maximum.at(high, thread[said], t["speaker"][said])
    kept = (roots == 1) & (bad == 0) & (high > low)
    rows = said[kept[thread[said]]]
    rows = rows[np.lexsort((t["comment_id"][rows], t["at_us"][rows], thread[rows]))]
    own = thread[rows]
    place = np.arange(len(rows)) - np.searchsorted(own, own) + 1
    kahn = np.empty(len(rows), np.int64)
    kahn[np.lexsort((t["comment_id"][rows], t["at_us"][rows], freed[rows], own))] = place  # threads are in the same order
    again = (own[1:] == own[:-1]) & (t["role"][rows][1:] == t["role"][rows][:-1])
    repeats = np.bincount(own[1:][again], minlength=threads) if len(rows) else np.zeros(threads)
    return {"rows": rows, "turn_no": place, "depth": freed[rows], "kahn_no": kahn, "roles_alternate": repeats[own] == 0}


def _judge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by thread; the last thread of a batch may go on in the next one and is carried over."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if not table.num_rows:
            continue
        names = table.column("thread_id").combine_chunks().dictionary_encode()
        codes = names.indices.to_numpy()
        cut = int(np.searchsorted(codes, codes[-1]))
        rest = table.slice(cut)
        if cut:
            yield from _judged(table.slice(0, cut))
    if rest is not None and rest.num_rows:
        yield from _judged(rest)


def _judged(table: pa.Table) -> Iterator[pa.RecordBatch]:
    col = {n: table.column(n).combine_chunks() for n in table.column_names}
    late = np.iinfo(np.int64).max
    names, speakers = col["thread_id"].dictionary_encode(), col["speaker"].dictionary_encode()
    got = judge(
        {
            "thread": names.indices.to_numpy().astype(np.int64),
            "comment_id": col["comment_id"].to_numpy(),
            "parent_id": col["parent_id"].fill_null(0).to_numpy(),
            "has_parent": col["parent_id"].is_valid().to_numpy(zero_copy_only=False),
            "at_us": col["at_us"].fill_null(late).to_numpy(),
            "has_text": col["has_text"].fill_null(False).to_numpy(zero_copy_only=False),
            "speaker": speakers.indices.fill_null(-1).to_numpy().astype(np.int64),
            "role": col["role"].dictionary_encode().indices.fill_null(-1).to_numpy(),
        }
    )
    at = pa.array(got["rows"], pa.int64())
    numbers = [pa.array(got[c], pa.int64()) for c in ("turn_no", "depth", "kahn_no")]
    yield pa.RecordBatch.from_arrays(
        [col["thread_id"].take(at), numbers[0], col["comment_id"].take(at), col["role"].take(at), numbers[1], numbers[2], pa.array(got["roles_alternate"], pa.bool_())], names=COLUMNS
    )


_FREED = "thread_id string, comment_id bigint, depth bigint"


def _peel_block(nodes: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    """Comments of one block that are freed by what other blocks have told, with their round."""
    above = nodes.merge(told, how="left", on=["thread_id", "parent_id"])["depth"].to_numpy()
    has_parent = nodes["has_parent"].to_numpy(bool)
    given = np.where(has_parent, np.where(np.isnan(above), -1, np.nan_to_num(above) + 1), 0).astype(np.int64)
    thread = pd.factorize(nodes["thread_id"])[0].astype(np.int64)
    depth = peel(thread, nodes["comment_id"].to_numpy(), nodes["parent_id"].to_numpy(), has_parent, nodes["at_us"].to_numpy(), given)
    out = nodes.loc[depth >= 0, ["thread_id", "comment_id"]]
    return out.assign(depth=depth[depth >= 0])


def _freed_by_blocks(rows: DataFrame, task_rows: int) -> DataFrame:
    """``thread_id, comment_id, depth`` of every comment that Kahn's algorithm frees, threads spread over blocks.

    Blocks are ranges of (thread, time, id) of about ``task_rows`` comments. Each round peels the blocks that were told
    of newly freed comments, then tells each of those comments once to every other block with replies to it. A chain of
    replies costs one round per change of block, and replies mostly follow in time, so rounds are about as many as a
    thread has blocks. State is checkpointed every round.
    """
    blocks = max(2, rows.count() // task_rows + 1)
    late = F.coalesce("at_us", F.lit(2**63 - 1))
    nodes = rows.select("thread_id", "comment_id", F.coalesce("parent_id", F.lit(0)).alias("parent_id"), F.col("parent_id").isNotNull().alias("has_parent"), late.alias("at_us"))
    nodes = cut_lineage(nodes.repartitionByRange(blocks, "thread_id", "at_us", "comment_id").withColumn("block", F.spark_partition_id()))
    # which other blocks have replies to a comment: at most one row per comment and block
    wanted = nodes.where("has_parent").select("thread_id", "parent_id", F.col("block").alias("to_block")).distinct()
    homes = nodes.select("thread_id", F.col("comment_id").alias("parent_id"), "block")
    routes = cut_lineage(wanted.join(homes, ["thread_id", "parent_id"]).where("block <> to_block").select("thread_id", "parent_id", "to_block"))
    told = rows.sparkSession.createDataFrame([], "block int, thread_id string, parent_id bigint, depth bigint")
    freed = rows.sparkSession.createDataFrame([], _FREED)
    active = nodes.select("block").distinct()
    while True:
        # a block is peeled anew with all it was told so far; blocks that were told nothing new stay as they are
        work = nodes.join(F.broadcast(active), "block", "left_semi")
        now = work.groupBy("block").cogroup(told.join(F.broadcast(active), "block", "left_semi").groupBy("block")).applyInPandas(lambda a, b: _peel_block(a, b[["thread_id", "parent_id", "depth"]]), _FREED)
        freed = cut_lineage(freed.unionByName(now).distinct())
        heard = routes.join(freed.withColumnRenamed("comment_id", "parent_id"), ["thread_id", "parent_id"]).select(F.col("to_block").alias("block"), "thread_id", "parent_id", "depth")
        fresh = cut_lineage(heard.join(told, ["block", "thread_id", "parent_id"], "left_anti"))
        if not fresh.limit(1).count():
            return freed
        told, active = cut_lineage(told.unionByName(fresh)), fresh.select("block").distinct()


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: the place of each in its thread by ``order``; a thread may span many tasks."""
    part = cut_lineage(rows.repartitionByRange("thread_id", *order).withColumn("part", F.spark_partition_id()))
    number = part.withColumn("k", F.row_number().over(Window.partitionBy("part", "thread_id").orderBy(*order)))
    before = part.groupBy("thread_id", "part").count()
    before = before.select("thread_id", "part", (F.sum("count").over(Window.partitionBy("thread_id").orderBy("part")) - F.col("count")).alias("before"))
    return number.join(before, ["thread_id", "part"]).withColumn(name, (F.col("k") + F.col("before")).cast("bigint")).drop("k", "part", "before")


def _judge_large(rows: DataFrame, task_rows: int) -> DataFrame:
    """The same judgement for threads too large for one task."""
    ends = _freed_by_blocks(rows, task_rows)
    full = rows.join(ends, ["thread_id", "comment_id"], "left")
    voices = F.when(F.col("has_text"), F.col("speaker"))
    verdict = full.groupBy("thread_id").agg(
        F.count(F.when(F.col("parent_id").isNull(), 1)).alias("roots"), F.count(F.when(F.col("depth").isNull() | F.col("speaker").isNull(), 1)).alias("bad"), F.min(voices).alias("a"), F.max(voices).alias("b")
    )
    kept = verdict.where("roots = 1 and bad = 0 and a <> b").select("thread_id")
    said = full.join(kept, "thread_id", "left_semi").where("has_text").select("thread_id", "comment_id", F.coalesce("at_us", F.lit(2**63 - 1)).alias("at_us"), "depth", F.col("role").alias("speaker_role"))
    turns = cut_lineage(_numbered(_numbered(said, ["at_us", "comment_id"], "turn_no"), ["depth", "at_us", "comment_id"], "kahn_no"))
    last = turns.select("thread_id", (F.col("turn_no") + 1).alias("turn_no"), F.col("speaker_role").alias("last_role"))
    repeats = turns.join(last, ["thread_id", "turn_no"]).where("speaker_role = last_role").select("thread_id").distinct().withColumn("roles_alternate", F.lit(False))
    return turns.join(F.broadcast(repeats), "thread_id", "left").select(*COLUMNS[:-1], F.coalesce("roles_alternate", F.lit(True)).alias("roles_alternate"))


def conversations(comments: DataFrame, timeline: DataFrame, prs: DataFrame, bots: DataFrame, task_rows: int = 200_000) -> DataFrame:
    """The non-blank comments of every kept thread, in order: :data:`COLUMNS`.

    A thread is kept if exactly one of its comments replies to none, all others lead to that one within the thread,
    every comment has a speaker, and its non-blank comments come from at least two speakers. Turns are ordered by
    instant, then id (``turn_no``); an unreadable instant sorts last. ``kahn_no`` is the place in the topological order:
    by steps to the first comment (``depth``), within a step by instant and id. The two differ where a branch goes on
    while another one opens, and where a clock is wrong, so that a reply bears an earlier instant than what it replies
    to; only ``kahn_no`` never puts a reply first. ``roles_alternate`` tells of the conversation whether no two turns
    in a row have the same role; it is a mark, not a reason to drop.

    Threads of more than ``task_rows`` comments are peeled in blocks over the cluster, the others in batches; the limit
    decides where the work is done, not its result. Rows without thread or comment id belong to no thread; an empty
    table gives no conversations; further columns are ignored; a comment id delivered for several threads belongs to
    the one delivered first.
    """
    ship_package(comments.sparkSession)
    rows = cut_lineage(messages(comments, timeline, prs, bots))
    large = rows.groupBy("thread_id").count().where(F.col("count") > task_rows).select("thread_id")
    if not large.limit(1).count():
        return _judge_small(rows)
    large = cut_lineage(large)
    small = sized_join(rows, large.withColumn("is_large", F.lit(True)), "thread_id", F.col("comment_id"))
    small = cut_lineage(small)
    return _judge_small(small.where("is_large is null").drop("is_large")).unionByName(_judge_large(small.where("is_large").drop("is_large"), task_rows))


def _judge_small(rows: DataFrame) -> DataFrame:
    return rows.repartition("thread_id").sortWithinPartitions("thread_id").mapInArrow(_judge_batches, _OUT)
