"""Times of day as integer seconds, and dates written in the formats the files use."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tickloom.session import MARKET_HOURS, SessionSpec


def hms_to_sec(text: Column) -> Column:
    """B17: 'H:MM:SS' -> seconds since midnight; anything else -> null."""
    parts = F.split(F.trim(text), ":")
    ok = F.trim(text).rlike(r"^\d{1,2}:\d{1,2}:\d{1,2}$")
    h, m, s = (F.try_element_at(parts, F.lit(i)).try_cast("int") for i in (1, 2, 3))
    return F.when(ok & (h < 24) & (m < 60) & (s < 60), h * 3600 + m * 60 + s)


def sec_to_hms(sec: Column) -> Column:
    """Seconds -> 'HH:MM:SS', null stays null."""
    s = sec.cast("int")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(
        s.isNotNull(),
        F.concat(
            two(F.floor(s / 3600).cast("int")), F.lit(":"),
            two(F.floor(F.pmod(s, F.lit(3600)) / 60).cast("int")), F.lit(":"),
            two(F.pmod(s, F.lit(60))),
        ),
    )


def minutes_since_open(sec: Column, session: SessionSpec = MARKET_HOURS) -> Column:
    """Whole minutes since the open, rounded half to even."""
    return F.rint((sec - F.lit(session.open_sec)) / F.lit(60.0)).cast("int")


def minutes_since_open_floor(sec: Column, session: SessionSpec = MARKET_HOURS) -> Column:
    """Clock minute minus the minute of the open."""
    return (F.floor(sec / F.lit(60)) - F.lit(session.open_minute)).cast("int")


def seconds_since_open(sec: Column, session: SessionSpec = MARKET_HOURS) -> Column:
    """B16."""
    return (sec - F.lit(session.open_sec)).cast("int")


def parse_mdy(text: Column) -> Column:
    """Month, day, year with '-' or '/', padded or not, 2- or 4-digit year -> date, else null."""
    pattern = r"^\s*(\d{1,2})[-/](\d{1,2})[-/](\d{2}|\d{4})\s*$"
    month = F.regexp_extract(text, pattern, 1).try_cast("int")
    day = F.regexp_extract(text, pattern, 2).try_cast("int")
    year = F.regexp_extract(text, pattern, 3).try_cast("int")
    year = F.when(year < 100, year + 2000).otherwise(year)
    return F.to_date(F.try_to_timestamp(
        F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")),
        F.lit("yyyy-MM-dd"),
    ))


def normalize_date_text(text: Column) -> Column:
    """The same date written MM-DD-YYYY."""
    return F.date_format(parse_mdy(text), "MM-dd-yyyy")
