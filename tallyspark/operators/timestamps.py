"""One unambiguous instant per stamp; missing zones come from aligning wall times with ingestion times.

A stamp without zone is wall time on the clock of its source. For every source the candidate zones, each a history of
offsets, are scored by the violations they cause: rows whose instant would lie after their ingestion, or earlier than
it by more than the usual delay. The candidates are all offset histories of the zone database, declared or not, and the
one with the fewest violations wins; a declared zone decides between equals, and where there is too little evidence.

Sessions run in UTC, as everywhere in the engine.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.stamps import wall_to_instant, with_instant
from tallyspark.operators.joins import sized_join
from tallyspark.session import cut_lineage

_QUARTER = 900_000_000  # offsets change on no finer grid than a quarter of an hour
_DAY = 96 * _QUARTER
_MINUTE = 60_000_000
_COLUMNS = ["table_name", "record_id", "field_name", "bot", "seen", "epoch_us", "wall_us"]


def bot_stamps(prs: DataFrame, timeline: DataFrame) -> DataFrame:
    """Parsed stamps with their source: ``table_name, record_id, field_name, bot, seen, epoch_us, wall_us``.

    Both stamps of a pull request carry its bot. Timeline stamps without zone are matched to the bot through ``pr_id``;
    the others need none and get a spread join key, so that a hot pull request receives only the rows that need it.
    Stamps that denote neither instant nor wall time are dropped.
    """
    pr_rows = prs.select(
        F.lit("prs").alias("table_name"), F.col("id").alias("record_id"), F.col("chatbot_id").alias("bot"), F.col("discovered_at").alias("seen"),
        F.inline(F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(n).alias("stamp")) for n in ("pr_created_at", "bot_reviewed_at")])),
    )
    pr_rows = with_instant(pr_rows, "stamp").where("epoch_us is not null or wall_us is not null").select(*_COLUMNS)
    events = timeline.select(
        F.lit("timeline_events").alias("table_name"), F.col("event_id").alias("record_id"), "pr_id", F.col("ingested_at").alias("seen"), F.lit("timestamp").alias("field_name"), F.col("timestamp").alias("stamp")
    )
    events = with_instant(events, "stamp").where("epoch_us is not null or wall_us is not null")
    events = events.withColumn("pr_key", F.when(F.col("wall_us").isNotNull(), F.col("pr_id")).otherwise(-1 - F.abs(F.hash("record_id").cast("bigint"))))
    owner = prs.groupBy(F.col("id").alias("pr_key")).agg(F.min("chatbot_id").alias("bot"))
    return pr_rows.unionByName(events.join(owner, "pr_key", "left").select(*_COLUMNS))


def _known(zone: Column) -> Column:
    """Whether the session's own zone database has the name."""
    return F.try_make_timestamp_ltz(F.lit(2025), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"), zone).isNotNull()


def valid_zones(zones: DataFrame) -> DataFrame:
    """``bot, declared``: the declared zones that name a known offset history."""
    return zones.where("chatbot_id is not null").where(_known(F.trim("zone_name"))).groupBy(F.col("chatbot_id").alias("bot")).agg(F.min(F.trim("zone_name")).alias("declared"))


@lru_cache(maxsize=4)
def offset_histories(first: str = "2024-09-01", last: str = "2026-07-01") -> tuple[list[int], dict[str, tuple[int, ...]], dict[str, str]]:
    """All offset histories of the zone database between two days, as seen by a clock on the wall.

    Returns the wall times (microseconds) at which any history changes; per history, under the first of its names, the
    offset in minutes before the first change and after each; and the name of the history of every zone. A wall time
    that occurs twice has the offset of its first occurrence, a skipped one that before the gap. Their number is that
    of the database (some 80 histories with some 60 changes), whatever the data.
    """
    low, high = (int(datetime.fromisoformat(x).replace(tzinfo=timezone.utc).timestamp()) * 1_000_000 for x in (first, last))
    origin = datetime(1970, 1, 1)

    def offset(zone: ZoneInfo, wall: int) -> int:
        return int((origin + timedelta(microseconds=wall)).replace(tzinfo=zone).utcoffset().total_seconds()) // 60

    changes: dict[str, tuple] = {}
    for name in sorted(available_timezones() - {"localtime", "posixrules"}):
        zone = ZoneInfo(name)
        found = [(low, offset(zone, low))]
        for week in range(low + 7 * _DAY, high + 1, 7 * _DAY):  # no zone changes back within a week
            if offset(zone, week) != found[-1][1]:
                for w in range(week - 7 * _DAY + _QUARTER, week + 1, _QUARTER):
                    if (now := offset(zone, w)) != found[-1][1]:
                        found.append((w, now))
        changes[name] = tuple(found)
    same: dict[tuple, list[str]] = {}
    for name, found in changes.items():
        same.setdefault(found, []).append(name)
    cuts = sorted({w for found in same for w, _ in found[1:]})
    chosen = {found: min(names, key=lambda n: ("/" not in n or n.startswith("Etc/"), n)) for found, names in same.items()}
    spans = {chosen[found]: tuple([o for w, o in found if w <= at][-1] for at in [low, *cuts]) for found in same}
    return cuts, spans, {name: chosen[found] for name, found in changes.items()}


def _span(wall: Column, cuts: list[int], first: int = 0) -> Column:
    """Number of ``cuts`` at or before ``wall``, by binary search."""
    if not cuts:
        return F.lit(first)
    k = len(cuts) // 2
    return F.when(wall < cuts[k], _span(wall, cuts[:k], first)).otherwise(_span(wall, cuts[k + 1 :], first + k + 1))


def zone_violations(stamps: DataFrame, usual_delay_us: int = 20 * _MINUTE) -> DataFrame:
    """``bot, zone_name, n, violations`` of every offset history for every bot with wall times in its timeline.

    Rows are first counted per (bot, span between two changes of any history, delay in minutes). Only these counts meet
    the histories, in a join on the span with one small row per history and span; a delay beyond two days is the same
    violation in every zone, so the counts of a bot are bounded as well, however many rows it has.
    """
    cuts, spans, _ = offset_histories()
    wall = stamps.where("wall_us is not null and bot is not null and table_name = 'timeline_events' and seen is not null")
    two_days = 2 * 24 * 60
    delay = F.floor((F.unix_micros(F.col("seen").cast("timestamp")) - F.col("wall_us")) / _MINUTE)
    counts = wall.select("bot", _span(F.col("wall_us"), cuts).alias("span"), F.greatest(F.lit(-two_days), F.least(F.lit(two_days), delay)).cast("int").alias("delay"))
    counts = counts.groupBy("bot", "span", "delay").agg(F.count(F.lit(1)).alias("n"))
    offsets = stamps.sparkSession.createDataFrame([(k, name, o) for name, own in spans.items() for k, o in enumerate(own)], "span int, zone_name string, offset int").where(_known(F.col("zone_name")))
    true_delay = F.col("delay") + F.col("offset")
    bad = (true_delay < 0) | (true_delay > usual_delay_us / _MINUTE)
    scored = counts.join(F.broadcast(offsets), "span")
    return scored.groupBy("bot", "zone_name").agg(F.sum("n").alias("n"), F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("violations"))


def resolve_zones(stamps: DataFrame, zones: DataFrame, least: int = 20, most_bad: float = 0.5) -> DataFrame:
    """``bot, zone_name, declared, n, violations``: the offset history chosen for each bot.

    The fewest violations decide. Ties go to the declared zone, then to the first name; a declared zone of the chosen
    history gives its name. A bot with fewer than ``least`` wall times, or whose best history is still violated by more
    than the share ``most_bad`` of them, has no estimate: its declared zone stands (``n`` 0 where it has no wall times
    at all), and without a declaration it does not occur.
    """
    declared = valid_zones(zones)
    _, _, history = offset_histories()
    names = stamps.sparkSession.createDataFrame(list(history.items()), "declared string, history string")
    declared = declared.join(F.broadcast(names), "declared", "left")
    scores = zone_violations(stamps).join(declared, "bot", "left")
    order = F.struct("violations", (~F.coalesce(F.col("zone_name") == F.col("history"), F.lit(False))).alias("other"), "zone_name")
    best = scores.groupBy("bot").agg(F.min_by(F.struct("zone_name", "n", "violations"), order).alias("b"))
    found = F.when((F.col("b.n") >= least) & (F.col("b.violations") <= F.col("b.n") * most_bad), F.col("b.zone_name"))
    zone = F.when(found.isNull() | F.coalesce(found == F.col("history"), F.lit(False)), F.col("declared")).otherwise(found)
    every = declared.join(best, "bot", "full").select("bot", zone.alias("zone_name"), "declared", F.coalesce("b.n", F.lit(0)).alias("n"), F.coalesce("b.violations", F.lit(0)).alias("violations"))
    return every.where("zone_name is not null")


def stamp_instants(prs: DataFrame, timeline: DataFrame, zones: DataFrame) -> DataFrame:
    """``table_name, record_id, field_name, epoch_us``: one row per stamp that denotes an instant.

    Of repeated deliveries the earliest instant counts. A wall time whose source has no zone, and a stamp without id,
    yield no row. The chosen zones (one row per bot) are checkpointed and joined by measured size.
    """
    stamps = bot_stamps(prs, timeline)
    chosen = cut_lineage(resolve_zones(stamps, zones).select("bot", "zone_name"))
    placed = sized_join(stamps, chosen, "bot", F.col("record_id"))
    instant = F.coalesce("epoch_us", F.when(F.col("zone_name").isNotNull(), wall_to_instant(F.col("wall_us"), F.col("zone_name"))))
    found = placed.select("table_name", "record_id", "field_name", instant.alias("epoch_us")).where("epoch_us is not null and record_id is not null")
    return found.groupBy("table_name", "record_id", "field_name").agg(F.min("epoch_us").alias("epoch_us"))
