"""Nanosecond wall-clock time: integers in, integers out; the zone-less exchange clock is never converted."""

from __future__ import annotations

from datetime import date, datetime, time

from pyspark.sql import Column, functions as F

DAY_NS = 86_400_000_000_000
MINUTE_NS = 60_000_000_000
MAX_NS = (1 << 63) - 1


def day_of(ns: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.call_function("div", ns, F.lit(DAY_NS).cast("long")).cast("int"))


def bucket(ns: Column, size: int) -> Column:
    """Start of the bucket of ``size`` ns that holds the (non-negative) time."""
    return ns - ns % F.lit(size).cast("long")


def parse_ns(text: Column) -> Column:
    """``dd/MM/yyyy HH:mm:ss`` with ``.`` or ``:`` and one to six digits of fraction; null if it isn't that."""
    shape = r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}[.:]\d{1,6}$"
    base = F.try_to_timestamp(F.substring(text, 1, 19), F.lit("dd/MM/yyyy HH:mm:ss"))
    micros = F.rpad(F.substring(text, 21, 6), 6, "0").cast("long")
    return F.when(text.rlike(shape), (F.unix_micros(base) + micros) * 1000)


def format_ns(ns: Column) -> Column:
    """``dd/MM/yyyy HH:mm:ss.SSS``, cut off below the millisecond; null for negative times."""
    return F.when(ns >= 0, F.date_format(F.timestamp_micros(F.call_function("div", ns, F.lit(1000).cast("long"))), "dd/MM/yyyy HH:mm:ss.SSS"))


def to_ns(value: datetime | date, end: bool = False) -> int:
    """Python time to ns; a date is its first (or last) microsecond; zones are stripped; far futures are clamped."""
    if not isinstance(value, datetime):
        value = datetime.combine(value, time.max if end else time.min)
    delta = value.replace(tzinfo=None) - datetime(1970, 1, 1)
    return min(((delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds) * 1000, MAX_NS)


def date_to_ns(day: Column) -> Column:
    """First ns of a date, clamped to what a long holds."""
    days = F.unix_date(day).cast("long")
    return F.when(days >= MAX_NS // DAY_NS, F.lit(MAX_NS).cast("long")).otherwise(days * F.lit(DAY_NS).cast("long"))


def to_datetime(ns: Column) -> Column:
    """Zone-less time of the ns, cut off below the microsecond."""
    return F.timestamp_micros(F.call_function("div", ns, F.lit(1000).cast("long"))).cast("timestamp_ntz")
