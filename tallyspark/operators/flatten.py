"""Nested records to related flat tables that keep their parent-child links.

Each source is turned into arrays of flat structs by nested ``transform`` calls, which attach the keys and positions of
all ancestors; ``flatten`` joins the arrays of inner levels, and one ``inline`` per target table emits its rows. The
record is parsed once, everything stays in the JVM, and no row leaves its partition before the final distinct.

Defined results: null, empty, cut-off or otherwise invalid JSON yields no child; a double-encoded value counts as the
value it holds; a child without an id, or whose parent has none, yields no row; null and empty arrays and maps yield
nothing; repeated deliveries and repeated children give one row; further input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.jsonx import as_array, as_map, is_string, parse_strict, scalar_text, unwrap

LINK_COLUMNS = ["pr_id", "parent_id", "child_kind", "child_id"]


def _json_lines(text: Column) -> Column:
    """``array<variant>`` of a text of JSON lines; NULL if any line is not a complete value."""
    lines = F.transform(F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != ""), parse_strict)
    return F.when(F.forall(lines, lambda v: v.isNotNull()), lines)


def with_events(prs: DataFrame, text: str = "bq_events") -> DataFrame:
    """``pr_id`` and ``evs``: the events of a pull request as ``array<struct<event_id, body, payload>>``.

    Accepts an array of events, an object with ``events``, a single event, JSON lines, and any of these encoded as a
    JSON string. A payload may be encoded as a string as well.
    """
    root = prs.select(F.col("id").alias("pr_id"), F.col(text).alias("raw"), parse_strict(F.col(text)).alias("root"))
    root = root.select("pr_id", "raw", unwrap(unwrap(F.col("root"))).alias("root"))
    one = F.when(F.try_variant_get("root", "$.event_id", "variant").isNotNull(), F.array(F.col("root")))
    events = F.coalesce(as_array(F.col("root")), as_array(F.try_variant_get("root", "$.events", "variant")), one)
    found = root.select("pr_id", F.when(F.col("root").isNotNull(), events).otherwise(_json_lines(F.col("raw"))).alias("vs"))
    bodies = found.select("pr_id", F.transform("vs", unwrap).alias("vs"))
    return bodies.select(
        "pr_id",
        F.transform(
            "vs",
            lambda v: F.struct(
                scalar_text(v, "$.event_id").alias("event_id"), v.alias("body"), unwrap(F.try_variant_get(v, "$.payload", "variant")).alias("payload")
            ),
        ).alias("evs"),
    )


def _label_names(payload: Column) -> Column:
    """Names of the labels of a payload's pull request: objects with a name, plain strings, or either under ``nodes``."""
    labels = F.coalesce(
        F.try_variant_get(payload, "$.pull_request.labels", "array<variant>"), F.try_variant_get(payload, "$.pull_request.labels.nodes", "array<variant>")
    )
    return F.transform(labels, lambda x: F.coalesce(scalar_text(x, "$.name"), F.when(is_string(x), x.cast("string"))))


def _link(parent: Column, kind: str, child: Column) -> Column:
    return F.struct(parent.alias("parent_id"), F.lit(kind).alias("child_kind"), child.alias("child_id"))


def event_links(prs: DataFrame) -> DataFrame:
    """Links of the kinds ``event``, ``review``, ``comment`` and ``label`` from one parse of ``bq_events``."""
    evs = with_events(prs)
    shaped = evs.select(
        "pr_id",
        F.transform(
            F.filter("evs", lambda e: e.event_id.isNotNull()),
            lambda e: F.concat(
                F.array(
                    _link(F.lit(None).cast("string"), "event", e.event_id),
                    _link(e.event_id, "review", scalar_text(e.payload, "$.review.id")),
                    _link(e.event_id, "comment", scalar_text(e.payload, "$.comment.id")),
                ),
                F.coalesce(F.transform(_label_names(e.payload), lambda n: _link(e.event_id, "label", n)), F.array().cast("array<struct<parent_id:string,child_kind:string,child_id:string>>")),
            ),
        ).alias("per_event"),
    )
    rows = shaped.select("pr_id", F.inline(F.flatten("per_event")))
    return rows.where("child_id is not null").select("pr_id", F.coalesce("parent_id", F.col("pr_id").cast("string")).alias("parent_id"), "child_kind", "child_id")


def event_table(prs: DataFrame) -> DataFrame:
    """Flat table of events: ``pr_id, event_ix, event_id, type, actor, created_at, pr_number``."""
    evs = with_events(prs)
    rows = F.transform(
        "evs",
        lambda e, i: F.struct(
            i.alias("event_ix"),
            e.event_id.alias("event_id"),
            *[scalar_text(e.body, f"$.{n}").alias(n) for n in ("type", "actor", "created_at")],
            F.coalesce(
                F.try_variant_get(e.body, "$.pr_number", "bigint"), F.try_variant_get(e.payload, "$.pull_request.number", "bigint"), F.try_variant_get(e.payload, "$.issue.number", "bigint")
            ).alias("pr_number"),
        ),
    )
    return evs.select("pr_id", F.inline(rows)).where("event_id is not null").transform(_first, ["pr_id", "event_id"])


def label_table(prs: DataFrame) -> DataFrame:
    """Flat table of labels: ``pr_id, event_ix, event_id, label_ix, label``; both positions keep the original order."""
    evs = with_events(prs)
    rows = F.flatten(
        F.transform(
            "evs",
            lambda e, i: F.coalesce(
                F.transform(_label_names(e.payload), lambda n, k: F.struct(i.alias("event_ix"), e.event_id.alias("event_id"), k.alias("label_ix"), n.alias("label"))),
                F.array().cast("array<struct<event_ix:int,event_id:string,label_ix:int,label:string>>"),
            ),
        )
    )
    return evs.select("pr_id", F.inline(rows)).where("event_id is not null and label is not null").transform(_first, ["pr_id", "event_id", "label"])


def with_files(timeline: DataFrame) -> DataFrame:
    """``pr_id, event_id``, ``files`` and ``names``: entries of ``data.files_detail`` (array, single object, or map by name)."""
    # the key is written plainly, or with at least one escaped letter: all other texts are spared the parse
    named = F.col("data").contains("files_detail") | F.col("data").contains("\\u")
    data = timeline.where(named).select("pr_id", "event_id", unwrap(unwrap(parse_strict(F.col("data")))).alias("data"))
    detail = data.select("pr_id", "event_id", unwrap(F.try_variant_get("data", "$.files_detail", "variant")).alias("fd"))
    entries = as_array(F.col("fd"))
    single = scalar_text(F.col("fd"), "$.filename")
    names = (
        F.when(entries.isNotNull(), F.transform(entries, lambda f: F.coalesce(scalar_text(f, "$.filename"), F.when(is_string(f), f.cast("string")))))
        .when(single.isNotNull(), F.array(single))
        .otherwise(F.map_keys(as_map(F.col("fd"))))
    )
    files = F.when(entries.isNotNull(), entries).when(single.isNotNull(), F.array("fd")).otherwise(F.map_values(as_map(F.col("fd"))))
    return detail.select("pr_id", "event_id", names.alias("names"), files.alias("files"))


def file_table(timeline: DataFrame) -> DataFrame:
    """Flat table of files: ``pr_id, event_id, file_ix, file_name, status, additions, deletions``; of repeated names the first."""
    rows = F.transform(
        "names",
        lambda n, i: F.struct(
            i.alias("file_ix"), n.alias("file_name"), scalar_text(F.get("files", i), "$.status").alias("status"),
            *[F.try_variant_get(F.get("files", i), f"$.{c}", "bigint").alias(c) for c in ("additions", "deletions")],
        ),
    )
    keys = ["pr_id", "event_id", "file_name"]
    return _first(with_files(timeline).select("pr_id", "event_id", F.inline(rows)).where("file_name is not null"), keys)


def _first(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, the least by the other columns in their order; combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r")).select(*[c if c in keys else F.col(f"__r.{c}").alias(c) for c in rows.columns])


def payload_table(prs: DataFrame, part: str, texts: tuple[str, ...], numbers: tuple[str, ...] = ()) -> DataFrame:
    """Flat table of one object of each event's payload: ``pr_id, event_ix, event_id, <part>_id`` and the fields named."""
    evs = with_events(prs)
    rows = F.transform(
        F.filter("evs", lambda e: e.event_id.isNotNull()),
        lambda e, i: F.struct(
            i.alias("event_ix"), e.event_id.alias("event_id"), scalar_text(e.payload, f"$.{part}.id").alias(f"{part}_id"),
            *[scalar_text(e.payload, f"$.{part}.{n}").alias(n) for n in texts], *[F.try_variant_get(e.payload, f"$.{part}.{n}", "bigint").alias(n) for n in numbers],
        ),
    )
    keys = ["pr_id", "event_id", f"{part}_id"]
    return _first(evs.select("pr_id", F.inline(rows)).where(F.col(f"{part}_id").isNotNull()), keys)


def review_table(prs: DataFrame) -> DataFrame:
    """Flat table of payload reviews: ``pr_id, event_ix, event_id, review_id, state, body, commit_id``."""
    return payload_table(prs, "review", ("state", "body", "commit_id"))


def comment_table(prs: DataFrame) -> DataFrame:
    """Flat table of payload comments: ``pr_id, event_ix, event_id, comment_id, body, path, line``."""
    return payload_table(prs, "comment", ("body", "path"), ("line",))


def thread_comment_table(threads: DataFrame) -> DataFrame:
    """Flat table of archived comments: ``pr_id, thread_id, comment_ix, comment_id, body, path, line, original_line, diff_hunk, author, created_at, n_reactions``.

    A comment listed twice in its thread keeps its first place; reactions count where their number is above 0.
    """
    rows = F.transform(
        "comments",
        lambda c, i: F.struct(
            i.alias("comment_ix"), c.id.alias("comment_id"), *[c[n].alias(n) for n in ("body", "path", "line", "original_line", "diff_hunk", "author", "created_at")],
            F.coalesce(F.size(F.map_filter(c.reactions, lambda _, n: n > 0)), F.lit(0)).alias("n_reactions"),
        ),
    )
    return _first(threads.select("pr_id", "thread_id", F.inline(rows)).where("thread_id is not null and comment_id is not null"), ["pr_id", "thread_id", "comment_id"])


def file_links(timeline: DataFrame) -> DataFrame:
    """Links of the kind ``file``: timeline event to file name."""
    rows = F.transform("names", lambda n: _link(F.col("event_id").cast("string"), "file", n))
    return with_files(timeline).select("pr_id", F.inline(rows)).where("child_id is not null")


def thread_links(threads: DataFrame) -> DataFrame:
    """Links of the kinds ``thread_comment`` and ``reaction`` (names with a count above 0) of archived threads."""
    per_comment = F.transform(
        F.filter("comments", lambda c: c.id.isNotNull()),
        lambda c: F.concat(
            F.array(_link(F.col("thread_id"), "thread_comment", c.id.cast("string"))),
            F.coalesce(
                F.transform(F.map_keys(F.map_filter(c.reactions, lambda _, n: n > 0)), lambda r: _link(c.id.cast("string"), "reaction", r)),
                F.array().cast("array<struct<parent_id:string,child_kind:string,child_id:string>>"),
            ),
        ),
    )
    return threads.select("pr_id", F.inline(F.flatten(per_comment))).where("parent_id is not null and child_id is not null")


def reaction_table(threads: DataFrame) -> DataFrame:
    """Flat table of reactions: ``pr_id, thread_id, comment_ix, comment_id, reaction, n`` (counts above 0 only)."""
    rows = F.flatten(
        F.transform(
            "comments",
            lambda c, i: F.coalesce(
                F.transform(F.map_entries(c.reactions), lambda e: F.struct(i.alias("comment_ix"), c.id.alias("comment_id"), e.key.alias("reaction"), e.value.alias("n"))),
                F.array().cast("array<struct<comment_ix:int,comment_id:bigint,reaction:string,n:int>>"),
            ),
        )
    )
    return threads.select("pr_id", "thread_id", F.inline(rows)).where("n > 0 and comment_id is not null").transform(_first, ["pr_id", "thread_id", "comment_id", "reaction"])


def child_links(prs: DataFrame, timeline: DataFrame, threads: DataFrame) -> DataFrame:
    """All parent-child links of the three sources, distinct; the distinct combines copies before its one shuffle."""
    links = event_links(prs).unionByName(file_links(timeline)).unionByName(thread_links(threads))
    return links.select(*LINK_COLUMNS).dropDuplicates(LINK_COLUMNS)
