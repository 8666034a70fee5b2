"""Time stamps kept as text, ages and decay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
FRACTIONAL = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSS")


def parse_time(text: Column, strict: bool = False) -> Column:
    """The instant of an ISO text in one of a few forms, else null; ``strict`` leaves fractional seconds unread."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in (FORMATS if strict else FORMATS + FRACTIONAL)))


def age_days(at: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(at)) / F.lit(86_400_000_000)


def decay(at: Column, now: Column, half_life_days: float) -> Column:
    """2^(-age / half-life); unknown or future times count in full."""
    age = age_days(at, now)
    return F.when(at.isNull() | (age < 0), F.lit(1.0)).otherwise(F.pow(F.lit(2.0), -age / F.lit(float(half_life_days))))


def path_date(path: Column) -> Column:
    """A date in a path, as YYYY-MM-DD or YYYYMMDD, else null."""
    a, b = F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})", 1), F.regexp_extract(path, r"(?<!\d)(\d{8})(?!\d)", 1)
    return F.coalesce(F.try_to_date(F.nullif(a, F.lit("")), "yyyy-MM-dd"), F.try_to_date(F.nullif(b, F.lit("")), "yyyyMMdd"))


def unix_iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_micros((seconds * 1_000_000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def store_date_iso(value: Column) -> Column:
    """ISO text of an extended-JSON date, whose milliseconds come as text or number; other text stays as it is."""
    ms = F.coalesce(F.get_json_object(value, "$['$date']['$numberLong']"), F.get_json_object(value, "$['$date']"))
    return F.when(ms.rlike(r"^-?\d+$"), F.date_format(F.timestamp_millis(ms.try_cast("long")), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.coalesce(ms, value))


def in_cycle_window(at: Column, period: float = 3.236, start: float = 0.236, stop: float = 0.618) -> Column:
    """Whether an instant falls in a part of a repeating cycle."""
    part = F.pmod(F.unix_micros(at) / F.lit(1e6), F.lit(period)) / F.lit(period)
    return (part >= start) & (part <= stop)


_CLOCK = r"(\d{1,2}):(\d{2})\s*([AaPp][Mm])"
_DAYS = ("MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy")


def activity_date(text: Column, reference: Column) -> Column:
    """ISO text of an activity log's date: "Nov 30, 2025 at 1:58 AM", without a year (that of ``reference``, or the one before for a later month), yesterday or today; '' for what is none."""
    t = F.trim(F.translate(text, "\u202f\u00a0", "  "))
    day = F.trim(F.regexp_extract(t, r"^(.*?) at ", 1))
    hour = F.regexp_extract(t, _CLOCK, 1).try_cast("int") % 12 + F.when(F.lower(F.regexp_extract(t, _CLOCK, 3)) == "pm", 12).otherwise(0)
    minute = F.regexp_extract(t, _CLOCK, 2).try_cast("int")
    year = F.year(reference)
    bare = F.coalesce(*(F.try_to_date(F.concat(day, F.lit(" "), year.cast("string")), f) for f in ("MMMM d yyyy", "MMM d yyyy")))
    bare = F.when(F.month(bare) > F.month(reference), F.add_months(bare, -12)).otherwise(bare)
    full = F.coalesce(*(F.try_to_date(day, f) for f in _DAYS))
    d = F.when(F.lower(day) == "yesterday", F.date_sub(reference, 1)).when(F.lower(day) == "today", reference).otherwise(F.coalesce(full, bare))
    at = F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T"), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0"), F.lit(":00Z"))
    return F.coalesce(F.when(hour.isNotNull(), at), F.lit(""))
