"""Free-text time stamps to instants, or to wall time where no zone is written.

Each family of spellings is recognised by one pattern whose replacement lists the parts in one fixed order, so a stamp
costs one match per family and no Python. Digits finer than a microsecond are cut off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SEP = "\x01"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"([A-Za-z]{1,5}|[+-]\d{2}(?::?\d{2})?)?"
#: family pattern -> groups for year, month, day, hour, minute, second, fraction, zone, region in brackets, AM/PM
FAMILIES = [
    (r"^(\d{4})-?(\d{2})-?(\d{2})[Tt ]+(\d{2}):?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)? *" + _ZONE + r"(?:\[([A-Za-z0-9_+/-]+)\])?$", "$1 $2 $3 $4 $5 $6 $7 $8 $9 -"),
    (r"^(?:[A-Za-z]{3,9},? +)?(\d{1,2})[ -]([A-Za-z]{3,9})\.?[ -](\d{4}),? +" + _TIME + " *" + _ZONE + "$", "$3 $2 $1 $4 $5 $6 $7 $8 - -"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4}),? +" + _TIME + r" *([AaPp][Mm])? *" + _ZONE + "$", "$3 $1 $2 $4 $5 $6 $7 $9 - $8"),
    (r"^(?:[A-Za-z]{3,9},? +)?([A-Za-z]{3,9})\.? +(\d{1,2}),? +(\d{4}),? +" + _TIME + r" *([AaPp][Mm])? *" + _ZONE + "$", "$3 $1 $2 $4 $5 $6 $7 $9 - $8"),
]
#: seconds, then up to 9 further digits: epoch counts in seconds (with fraction), milli-, micro- or nanoseconds
EPOCH = r"^(\d{10})(?:(?:\.(\d{1,9}))|(\d{3})|(\d{6})|(\d{9}))?$"
#: Offsets of the zone abbreviations in use.
ABBREVIATIONS = {
    "Z": "+00:00", "UTC": "+00:00", "UT": "+00:00", "GMT": "+00:00", "BST": "+01:00", "CET": "+01:00", "CEST": "+02:00", "IST": "+05:30",
    "JST": "+09:00", "AEST": "+10:00", "AEDT": "+11:00", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00",
    "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00", "BRT": "-03:00", "BRST": "-02:00",
}
MONTHS = {m: str(i) for i, m in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split(), 1)}


def with_instant(df: DataFrame, stamp: str, earliest: str = "2024-10-01", latest: str = "2026-06-01") -> DataFrame:
    """Add ``epoch_us`` (the instant, where the stamp fixes one) or ``wall_us`` (wall time, where it has no zone).

    ``wall_us`` counts the microseconds from 1970-01-01 00:00 on the writer's clock. Both are NULL for null, empty or
    other text, a date alone, an impossible date or time, and an instant outside [``earliest``, ``latest``). An
    abbreviation that is not in the fixed list is one of the writer's own zone, so the stamp counts as wall time.

    Every intermediate value is a column used as few times as possible: the generated code stays small.
    """
    t = F.regexp_replace(F.col(stamp), r"(?U)^[\s\uFEFF\u200B]+|[\s\uFEFF\u200B]+$", "")
    for pattern, order in FAMILIES:
        t = F.regexp_replace(t, pattern, _SEP + order.replace(" ", _SEP))
    keep = list(df.columns)
    part = lambda i: F.get("__p", F.lit(i))
    split = df.withColumn("__p", F.split(t, _SEP, -1))
    month = F.when(part(2).rlike("^[0-9]"), part(2)).otherwise(F.try_element_at(_literal_map(MONTHS), F.upper(F.substring(part(2), 1, 3))))
    zone = F.upper(part(8))
    named = split.select(
        *keep,
        F.when(F.size("__p") == 1, F.regexp_replace(part(0), EPOCH, "$1:$2:$3:$4:$5")).alias("__epoch"),
        part(1).try_cast("int").alias("__y"), month.try_cast("int").alias("__mo"), part(3).try_cast("int").alias("__d"), part(4).try_cast("int").alias("__h"), part(5).try_cast("int").alias("__mi"),
        F.concat(F.lpad(part(6), 2, "0"), F.lit("."), F.rpad(F.substring(part(7), 1, 6), 6, "0")).alias("__sec"),
        F.when(zone.rlike("^[+-]"), zone).when(part(9).isin("", "-"), F.try_element_at(_literal_map(ABBREVIATIONS), zone)).otherwise(part(9)).alias("__zone"),
        F.upper(part(10)).alias("__half"),
    )
    hour = F.when(~F.col("__half").isin("AM", "PM"), F.col("__h")).when(F.col("__h").between(1, 12), F.col("__h") % 12 + (F.col("__half") == "PM").cast("int") * 12)
    second = F.when(F.col("__sec") < "60", F.col("__sec").try_cast("decimal(8,6)"))
    civil = F.unix_micros(F.try_make_timestamp_ltz("__y", "__mo", "__d", hour, "__mi", second, F.coalesce("__zone", F.lit("UTC"))))
    unit = F.split("__epoch", ":", -1)
    digits = F.concat(F.get(unit, F.lit(0)), F.rpad(F.substring(F.concat(F.get(unit, F.lit(1)), F.get(unit, F.lit(2)), F.get(unit, F.lit(3)), F.get(unit, F.lit(4))), 1, 6), 6, "0"))
    us = pinned(F.coalesce(digits.try_cast("bigint"), civil))
    timed = named.select(*keep, "__zone", us.alias("__us"), F.col("__epoch").isNotNull().alias("__counted"))
    low, high, day = (int(_utc_seconds(x)) * 1_000_000 for x in (earliest, latest, "1970-01-02"))
    fixed = F.col("__counted") | F.col("__zone").isNotNull()
    return timed.select(
        *keep,
        F.when(fixed & F.col("__us").between(low, high - 1), F.col("__us")).alias("epoch_us"),
        F.when(~fixed & F.col("__us").between(low - day, high + day), F.col("__us")).alias("wall_us"),
    )


def pinned(value: Column) -> Column:
    """``value``, computed once: filters on it are not pushed below, where they would repeat the whole expression.

    The condition always holds; being non-deterministic to the optimiser, it keeps predicates above this projection.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _utc_seconds(day: str) -> float:
    from datetime import datetime, timezone

    return datetime.fromisoformat(day).replace(tzinfo=timezone.utc).timestamp()


def wall_to_instant(wall_us: Column, zone: Column) -> Column:
    """Instant of a wall time in a zone: the first of two if it occurs twice, moved forward by the gap if skipped."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall_us), zone))
