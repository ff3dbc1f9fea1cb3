"""Time buckets, epoch conversions and text forms. All columns are UTC timestamps."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_MS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def at_ms(value: int | Column) -> Column:
    """The timestamp at `value` unix milliseconds. A plain int folds to a literal and pushes down."""
    if isinstance(value, Column):
        return F.timestamp_millis(value)
    seconds, millis = divmod(int(value), 1000)
    moment = datetime.fromtimestamp(seconds, timezone.utc).replace(microsecond=millis * 1000)
    return F.lit(moment)


def at_s(value: int | Column) -> Column:
    return F.timestamp_seconds(value) if isinstance(value, Column) else at_ms(int(value) * 1000)


def ms(ts: Column | str) -> Column:
    return F.unix_millis(ts)


def seconds(ts: Column | str) -> Column:
    return F.unix_seconds(ts)


def nanos(ts: Column | str) -> Column:
    return F.unix_micros(ts) * F.lit(1000)


def minute(ts: Column | str) -> Column:
    return F.date_trunc("minute", ts)


def hour(ts: Column | str) -> Column:
    return F.date_trunc("hour", ts)


def day_start_s(ts: Column | str) -> Column:
    return seconds(F.date_trunc("day", ts))


def ceil_hour(ts: Column) -> Column:
    """The first whole hour at or after `ts`."""
    return F.when(hour(ts) == ts, ts).otherwise(hour(ts) + F.expr("INTERVAL 1 HOUR"))


def yyyymm(ts: Column | str) -> Column:
    return (F.year(ts) * 100 + F.month(ts)).cast("int")


def lag_ms(earlier: Column | str, later: Column | str) -> Column:
    """Whole milliseconds between two millisecond timestamps."""
    return ms(later) - ms(earlier)


def iso(ts: Column | str) -> Column:
    """ISO-8601 UTC with milliseconds, e.g. 2024-01-30T23:57:12.194Z."""
    return F.date_format(ts, ISO_MS)


def month_start(ts: Column | str) -> Column:
    return F.trunc(F.to_date(ts), "MM")


def days_in_month(ts: Column | str) -> Column:
    return F.day(F.last_day(F.to_date(ts)))


def day_of_ms(value: int) -> date:
    return datetime.fromtimestamp(value // 1000, timezone.utc).date()


def day_start_of(day: date) -> int:
    """Unix seconds at the start of a UTC day."""
    return int(datetime(day.year, day.month, day.day, tzinfo=timezone.utc).timestamp())
