from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.stamps import wall_to_instant, with_instant
from tallyspark.operators import timestamps


def us(y, mo, d, h=0, mi=0, s=0, frac=0, minutes=0):
    return int((datetime(y, mo, d, h, mi, s, tzinfo=timezone.utc) - timedelta(minutes=minutes) - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()) * 1_000_000 + frac


FIXED = {
    "2025-09-29 15:33:09-0400": us(2025, 9, 29, 19, 33, 9), "1755047814": 1755047814000000, "1754068801798": 1754068801798000, "1763065962999127": 1763065962999127,
    "1763065962999127999": 1763065962999127, "1763065962.9991279": 1763065962999127, "20250905T150241Z": us(2025, 9, 5, 15, 2, 41), "  2025-11-23T18:54:33,885Z ": us(2025, 11, 23, 18, 54, 33, 885000),
    "2025-05-03t06:31:39z": us(2025, 5, 3, 6, 31, 39), "Wed, 16 Jul 2025 02:27:44 GMT": us(2025, 7, 16, 2, 27, 44), "Mon, 05 May 2025 16:12:33 +0530": us(2025, 5, 5, 16, 12, 33, 0, 330),
    "2026-01-25T14:20:33-05:00[America/New_York]": us(2026, 1, 25, 19, 20, 33), "2026-01-25T14:20:33[America/New_York]": us(2026, 1, 25, 19, 20, 33), "2025-11-02 01:30:00 EST": us(2025, 11, 2, 6, 30),
    "2025-11-02 01:30:00 EDT": us(2025, 11, 2, 5, 30), "2025-07-18T22:29:05.785123999-03:30": us(2025, 7, 19, 1, 59, 5, 785123), "2025-12-31T10:00:00+00": us(2025, 12, 31, 10), "2024-10-01T00:00:00Z": us(2024, 10, 1),
}
WALL = {
    "2025-08-01T03:24:33.798": us(2025, 8, 1, 3, 24, 33, 798000), "2024-10-30 23:34": us(2024, 10, 30, 23, 34), "11/02/2025 02:35:07 AM": us(2025, 11, 2, 2, 35, 7), "12/02/2025 12:35:07 PM": us(2025, 12, 2, 12, 35, 7),
    "12/02/2025 12:35:07 AM": us(2025, 12, 2, 0, 35, 7), "9 Nov 2025 18:19:53": us(2025, 11, 9, 18, 19, 53), "29 September 2025 17:01:39": us(2025, 9, 29, 17, 1, 39), "Jul 5, 2025 3:04 PM": us(2025, 7, 5, 15, 4), "2025-01-25 14:20:33 XYZ": us(2025, 1, 25, 14, 20, 33),
}
NEITHER = [None, "", " ", "unknown", "null", "-", "yesterday", "2025-06-06", "2025-06-", "T12:30:00Z", "2025-02-30 10:00:00Z", "2025-13-01T00:00:00Z", "2025-01-01T25:00:00Z", "2025-01-01T10:61:00Z", "2025-01-01T10:00:61Z",
           "2025-01-01T10:00:00+25:00", "2025-01-01T10:00:00[No/Where]", "13/13/2025 01:00:00 AM", "11/02/2025 13:00:00 PM", "1999-01-01T00:00:00Z", "2026-06-01T00:00:00Z", "123456", "9" * 500, "2025-01-01T10:00:00Z" + "x" * 10_000]


def test_spellings(frame):
    rows = [(s, e, None) for s, e in FIXED.items()] + [(s, None, w) for s, w in WALL.items()] + [(s, None, None) for s in NEITHER]
    got = with_instant(frame(rows, "s string, e long, w long"), "s").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.epoch_us, r.wall_us) == (r.e, r.w), r.s


@pytest.mark.parametrize(
    ("zone", "wall", "instant"),
    [
        ("America/New_York", us(2025, 11, 2, 1, 30), us(2025, 11, 2, 5, 30)),  # occurs twice: the first
        ("America/New_York", us(2025, 3, 9, 2, 30), us(2025, 3, 9, 7, 30)),  # skipped: moved forward by the gap
        ("Australia/Sydney", us(2025, 4, 6, 2, 30), us(2025, 4, 5, 15, 30)),
        ("Asia/Kolkata", us(2025, 4, 6, 2, 30), us(2025, 4, 5, 21, 0)),
    ],
)
def test_wall_times_around_changes(frame, zone, wall, instant):
    assert frame([(wall, zone)], "w long, z string").select(wall_to_instant(F.col("w"), F.col("z")).alias("x")).first().x == instant


PRS = "id long, chatbot_id long, pr_created_at string, bot_reviewed_at string, discovered_at timestamp_ntz"
EVENTS = "event_id long, pr_id long, timestamp string, ingested_at timestamp_ntz"
ZONES = "chatbot_id long, zone_name string"


def scene(frame, declared):
    """Three bots in New York, Kolkata and Berlin; bot 2 may be undeclared, bot 3 declares a zone that does not exist."""
    homes = {1: "America/New_York", 2: "Asia/Kolkata", 3: "Europe/Berlin"}
    prs = [(b, b, "2025-02-01 10:00:00", None, datetime(2025, 2, 2)) for b in homes]
    events, want = [], {}
    for b, z in homes.items():
        for i in range(60):
            at = datetime(2025, 1, 5, 7, 13, 21, tzinfo=timezone.utc) + timedelta(days=5 * i, minutes=17 * i)
            late = timedelta(days=30) if i % 20 == 0 else timedelta(minutes=1 + i % 9)
            events.append((100 * b + i, b, at.astimezone(ZoneInfo(z)).strftime("%Y-%m-%d %H:%M:%S"), (at + late).replace(tzinfo=None)))
            want["timeline_events", 100 * b + i, "timestamp"] = int(at.timestamp()) * 1_000_000
    return frame(prs, PRS), frame(events, EVENTS), frame(declared, ZONES), want


def chosen_zones(prs, events, zones):
    return {r.bot: r for r in timestamps.resolve_zones(timestamps.bot_stamps(prs, events), zones).collect()}


def test_missing_and_wrong_zones_are_found_from_ingestion_times(frame):
    _, _, history = timestamps.offset_histories()
    prs, events, zones, want = scene(frame, [(1, "Asia/Tokyo"), (3, "Mars/Base"), (8, "Asia/Kolkata"), (9, "Europe/Berlin"), (None, "UTC"), (7, None)])
    chosen = chosen_zones(prs, events, zones)
    for bot, zone in {1: "America/New_York", 2: "Asia/Kolkata", 3: "Europe/Berlin"}.items():
        assert history[chosen[bot].zone_name] == history[zone]
        assert chosen[bot].n == 60 and chosen[bot].violations == 3  # the three late rows violate every zone
    assert (chosen[8].zone_name, chosen[8].n, chosen[9].zone_name) == ("Asia/Kolkata", 0, "Europe/Berlin")
    got = {(r.table_name, r.record_id, r.field_name): r.epoch_us for r in timestamps.stamp_instants(prs, events, zones).collect()}
    assert {k: v for k, v in got.items() if k[0] != "prs"} == want
    assert got["prs", 2, "pr_created_at"] == us(2025, 2, 1, 4, 30)


def test_a_zone_nobody_declares_is_a_candidate(frame):
    prs, events, zones, want = scene(frame, [(b, "UTC") for b in (1, 2, 3)])
    got = {(r.table_name, r.record_id, r.field_name): r.epoch_us for r in timestamps.stamp_instants(prs, events, zones).collect()}
    assert {k: v for k, v in got.items() if k[0] != "prs"} == want


def test_declared_name_of_the_same_history_is_kept(frame):
    prs, events, zones, _ = scene(frame, [(1, "US/Eastern"), (2, "Asia/Kolkata"), (3, "Europe/Paris")])
    assert {b: r.zone_name for b, r in chosen_zones(prs, events, zones).items()} == {1: "US/Eastern", 2: "Asia/Kolkata", 3: "Europe/Paris"}


def test_too_little_evidence_leaves_the_declared_zone(frame):
    prs, events, zones, _ = scene(frame, [(1, "America/New_York"), (2, "Europe/Berlin")])
    few = chosen_zones(prs, events.where("event_id % 100 < 5"), zones)
    assert few[2].zone_name == "Europe/Berlin" and 3 not in few
    # stamps that no zone explains: an undeclared source has no estimate, a declared one keeps its own
    late = events.withColumn("ingested_at", F.expr("ingested_at + interval 40 days"))
    odd = chosen_zones(prs, late, zones)
    assert odd[2].zone_name == "Europe/Berlin" and 3 not in odd


@pytest.mark.parametrize("zone", ["America/New_York", "Africa/Casablanca", "Australia/Lord_Howe", "Asia/Kolkata"])
def test_histories_agree_with_the_session_clock(spark, zone):
    cuts, spans, history = timestamps.offset_histories()
    walls = [w + d for w in cuts for d in (-900_000_000, 0, 900_000_000)]
    df = spark.createDataFrame([(w,) for w in walls], "w long").select("w", timestamps._span(F.col("w"), cuts).alias("k"), wall_to_instant(F.col("w"), F.lit(zone)).alias("x"))
    for r in df.collect():
        assert r.k == sum(c <= r.w for c in cuts)
        assert r.w - r.x == spans[history[zone]][r.k] * 60_000_000, r


def test_deliveries_nulls_and_empty_tables(frame):
    prs = frame([(1, 1, "2025-01-01T00:00:00Z", "2025-01-01 05:30:00", datetime(2025, 1, 2)), (1, 1, "1735689600", "pending", datetime(2025, 1, 9)), (None, 1, "1735689600", None, None), (2, None, "2025-01-01 00:00:00", None, None)], PRS)
    events = frame([(5, 77, "2025-01-01 00:00:00", None), (5, None, "2025-01-01T00:00:01Z", None), (None, 1, None, None)], EVENTS)
    got = {tuple(r) for r in timestamps.stamp_instants(prs, events, frame([(1, "Asia/Kolkata")], ZONES)).collect()}
    assert got == {("prs", 1, "pr_created_at", 1735689600000000), ("prs", 1, "bot_reviewed_at", 1735689600000000), ("timeline_events", 5, "timestamp", 1735689601000000)}
    assert timestamps.stamp_instants(frame([], PRS), frame([], EVENTS), frame([], ZONES)).collect() == []
