"""Dates and timestamps stored as text."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: the shapes of a stored timestamp, tried on the whole text, its first 19 and its first 10 characters.
ISO_FULL = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?$"
ISO_DAY = r"^\d{4}-\d\d-\d\d$"


def _shape(c: Column) -> Column:
    return F.when(c.rlike(ISO_FULL) | c.rlike(ISO_DAY), c)


def parse_instant(text: Column) -> Column:
    """The instant of an ISO text, naive ones in UTC; falls back to its first 19, then 10 characters; else null."""
    t = F.trim(text)
    return F.coalesce(*[_shape(c).try_cast("timestamp") for c in (t, F.substring(t, 1, 19), F.substring(t, 1, 10))])


def local_day(text: Column) -> Column:
    """The date that an ISO text shows, in its own offset; null if it shows none."""
    t = F.trim(text)
    return F.when(parse_instant(text).isNotNull(), F.substring(t, 1, 10).try_cast("date"))


def posted_week(text: Column) -> Column:
    """ISO year and week of the shown date, such as 2026-W07; '' if there is none."""
    d = local_day(text)
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))
    return F.coalesce(week, F.lit(""))


def day_part(text: Column) -> Column:
    """The date of a date or timestamp in full ISO shape, else null."""
    return F.substring(_shape(text), 1, 10).try_cast("date")


def epoch_ms_iso(ms: Column) -> Column:
    """ISO text of milliseconds since 1970, in UTC."""
    return F.regexp_replace(F.date_format(F.timestamp_millis(ms.try_cast("bigint")), "yyyy-MM-dd'T'HH:mm:ssxxx"), r"^\+", "")


def add_business_days(day: Column, n: int) -> Column:
    """day plus n weekdays, Saturdays and Sundays skipped."""
    weekday = F.weekday(day)  # Monday is 0
    start = F.when(weekday > 4, F.lit(4)).otherwise(weekday)
    weekend = F.when(weekday > 4, weekday - 4).otherwise(0)
    steps = start + F.lit(n)
    whole = F.floor(steps / 5).cast("int")
    return F.when(F.lit(n) <= 0, day).otherwise(F.date_add(day, (F.lit(n) - weekend + whole * 2).cast("int")))


def days_ago(text: Column, now: datetime) -> Column:
    """Whole days from the instant of text until now, cut toward zero."""
    seconds = F.lit(int(now.timestamp())) - F.unix_seconds(parse_instant(text))
    return (F.when(seconds >= 0, F.floor(seconds / 86400)).otherwise(F.ceil(seconds / 86400))).cast("bigint")


def parse_since(value: str, now: datetime) -> datetime | None:
    """The instant that '7d', '48h', '2w' or a date looks back to; None for an empty value."""
    value = value.strip()
    if not value:
        return None
    if m := re.fullmatch(r"(\d+)([hdw])", value):
        return now - timedelta(**{{"h": "hours", "d": "days", "w": "weeks"}[m[2]]: int(m[1])})
    try:
        return datetime.fromisoformat(value[:10]).replace(tzinfo=now.tzinfo) if re.match(ISO_FULL[:-1] + "$|" + ISO_DAY, value) else _bad(value)
    except ValueError:
        return _bad(value)


def _bad(value: str):
    raise ValueError(f"bad lookback {value!r}: want 7d, 48h, 2w or a date")


@F.pandas_udf(StringType())
def _rfc(texts: pd.Series) -> pd.Series:
    def one(t):
        try:
            d = parsedate_to_datetime(t)
        except (TypeError, ValueError, IndexError):
            return None
        return d.isoformat(timespec="seconds") + ("" if d.tzinfo else "+00:00")

    return texts.map(lambda t: None if t is None else one(t))


def to_iso(text: Column) -> Column:
    """ISO text of an RFC 2822 or ISO date, its own offset kept; null if it is neither."""
    t = F.trim(text)
    iso = F.regexp_replace(t, r"^(\d{4}-\d\d-\d\d) ", "$1T")
    shown = F.when(parse_instant(iso).isNotNull(), F.regexp_replace(F.when(iso.rlike(ISO_DAY), F.concat(iso, F.lit("T00:00:00+00:00"))).when(iso.rlike(r"(Z|[+-]\d\d:\d\d)$"), F.regexp_replace(iso, "Z$", "+00:00")).otherwise(F.concat(F.substring(iso, 1, 19), F.lit("+00:00"))), r"\.\d+", ""))
    return F.coalesce(shown, _rfc(F.when(shown.isNull() & (t != ""), t)))
