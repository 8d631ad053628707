"""Wall-clock columns by zone id (never by fixed offset), independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NEW_YORK = "America/New_York"
PACIFIC = "America/Los_Angeles"
DAY_US = 86_400_000_000


def second_of_day(ts: Column, zone: str) -> Column:
    wall = F.unix_micros(F.from_utc_timestamp(ts, zone))
    return F.pmod(wall, F.lit(DAY_US)) / F.lit(1_000_000.0)


def session_elapsed(ts: Column, open_sec: int = 14_400, floor_sec: float = 60.0) -> Column:
    """Seconds since the premarket open in New York, wrapping to the previous day, at least a minute."""
    wall = F.unix_micros(F.from_utc_timestamp(ts, NEW_YORK))
    since = F.pmod(wall - F.lit(open_sec * 1_000_000), F.lit(DAY_US)) / F.lit(1_000_000.0)
    return F.greatest(F.lit(floor_sec), since)


def is_pre_session(ts: Column, end_sec: int = 25_200) -> Column:
    return second_of_day(ts, NEW_YORK) < F.lit(float(end_sec))


def hour_of_day(ts: Column, zone: str) -> Column:
    return F.floor(second_of_day(ts, zone) / 3600).cast("int")


def session_date(ts: Column, zone: str = NEW_YORK) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(
        F.unix_micros(F.from_utc_timestamp(ts, zone)) / F.lit(float(DAY_US))).cast("int"))
