"""Dates and times. Instants are UTC; "now" is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The offset that source times without one have, and the zone that people see.
SOURCE_OFFSET, SHOWN_ZONE = "+03:00", "Europe/Moscow"
#: An import's cutoff, the queue's grace, and how long payment links live.
IMPORT_GRACE_HOURS, QUEUE_GRACE_HOURS, LINK_AFTER_START_HOURS, LINK_UNDATED_HOURS = 6, 3, 3, 24
_DAY, _TIME, _OFFSET = r"([0-9]{4}-[0-9]{2}-[0-9]{2})", r"([0-9]{2}:[0-9]{2})(:[0-9]{2})?([.][0-9]{1,6})?", r"(Z|[+-][0-9]{2}:?[0-9]{2}(:[0-9]{2})?)"
_NAIVE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm")


def parse_source_time(text: Column) -> Column:
    """An instant: times with an offset are converted, those without have SOURCE_OFFSET, anything else is null.

    Seconds may be missing, and so may the time, which is midnight then.
    """
    text = F.trim(text)
    part = lambda i, else_: F.coalesce(F.nullif(F.regexp_extract(text, f"^{_DAY}(?:[T ]{_TIME}{_OFFSET}?)?$", i), F.lit("")), F.lit(else_))
    offset = F.regexp_replace(part(5, SOURCE_OFFSET), "^([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    whole = F.concat(part(1, ""), F.lit("T"), part(2, "00:00"), part(3, ":00"), part(4, ""), offset)
    return F.when(text.rlike(f"^{_DAY}([T ]{_TIME}{_OFFSET}?)?$"), F.try_to_timestamp(whole))


def parse_naive_time(text: Column) -> Column:
    """A time without zone in one of the editors' formats, fractions of a second kept; an offset at its end is dropped, other forms are null."""
    text = F.regexp_replace(F.trim(text), r"(Z|[+-][0-9]{2}:?[0-9]{2})$", "")
    fraction = F.coalesce(F.rpad(F.nullif(F.regexp_extract(text, r"[.]([0-9]{1,6})$", 1), F.lit("")), 6, "0").try_cast("int"), F.lit(0))
    whole = F.regexp_replace(text, r"(:[0-9]{2})[.][0-9]{1,6}$", "$1")
    parsed = F.coalesce(*[F.try_to_timestamp(whole, F.lit(f)) for f in _NAIVE_FORMATS])
    return F.timestamp_micros(F.unix_micros(parsed) + fraction)


def to_second(ts: Column) -> Column:
    return F.date_trunc("second", ts)


def shown(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, SHOWN_ZONE)


def shown_text(ts: Column, missing: str = "") -> Column:
    return F.coalesce(F.date_format(shown(ts), "dd.MM.yyyy HH:mm"), F.lit(missing))


def shown_date(ts: Column) -> Column:
    return F.to_date(shown(ts))


def date_labels(text: Column) -> Column:
    """(shown, iso) of a date text; both are the text itself where it is no date."""
    day = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.try_to_timestamp(text, F.lit("dd.MM.yyyy")), F.try_to_timestamp(text)).cast("date")
    return F.struct(F.coalesce(F.date_format(day, "dd.MM.yyyy"), text).alias("shown"), F.coalesce(F.date_format(day, "yyyy-MM-dd"), text).alias("iso"))


def hours(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(n))


def link_expiry(starts_at: Column, as_of: Column) -> Column:
    """Some hours after an event that is still ahead, else a day from now."""
    return F.when(starts_at > as_of, starts_at + hours(LINK_AFTER_START_HOURS)).otherwise(as_of + hours(LINK_UNDATED_HOURS))


def age_hours(then: Column, now: Column) -> Column:
    return F.floor((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(then.cast("timestamp"))) / 3600)
