"""Dates, hashes and bounded scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(c: Column) -> Column:
    """ISO text or a timestamp to a UTC timestamp; anything else to null."""
    return F.try_to_timestamp(c.cast("string"))


def week_start(ts: Column) -> Column:
    """Monday of the week as text."""
    return F.date_format(F.date_trunc("week", ts), "yyyy-MM-dd")


def tuesday_week(ts: Column) -> Column:
    """Start of the week that ends on Monday."""
    return F.date_trunc("week", ts - F.expr("INTERVAL 1 DAY")) + F.expr("INTERVAL 1 DAY")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c.cast("double")))


def ratio(part: Column, whole: Column, digits: int | None = None) -> Column:
    """Part of a whole; zero for an empty whole."""
    value = F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
    return value if digits is None else F.round(value, digits)


def short_id(key: Column, prefix: str = "t_", size: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(key), 1, size))


def hash_pick(key: Column, n: int) -> Column:
    """A stable number below ``n`` from the first four hex digits of SHA-1."""
    return (F.conv(F.substring(F.sha1(key), 1, 4), 16, 10).cast("int") % n).cast("int")


def log_likes(likes: Column) -> Column:
    """Likes on a scale from 0 to 10."""
    return clamp(F.log10(1 + F.greatest(F.coalesce(likes.cast("double"), F.lit(0.0)), F.lit(0.0))) * 4, 0, 10)
