"""Version-1 UUIDs as time keys, in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 100-nanosecond steps between the UUID epoch (1582-10-15) and 1970.
GREGORIAN = 122192928000000000


def uuid_of_time(ts: Column, seed: Column) -> Column:
    """A version-1 UUID of the timestamp, its clock and node taken from a hash of the seed."""
    x = F.lpad(F.hex(F.unix_micros(ts) * 10 + F.lit(GREGORIAN)), 15, "0")
    tail = F.lpad(F.hex(F.xxhash64(seed)), 16, "0")
    clock = F.concat(F.lit("8"), F.substring(tail, 1, 3))
    return F.lower(F.concat_ws("-", F.substring(x, 8, 8), F.substring(x, 4, 4), F.concat(F.lit("1"), F.substring(x, 1, 3)), clock, F.substring(tail, 4, 12)))


def time_of_uuid(u: Column) -> Column:
    ticks = F.conv(F.concat(F.substring(u, 16, 3), F.substring(u, 10, 4), F.substring(u, 1, 8)), 16, 10).cast("bigint")
    return F.timestamp_micros(F.call_function("div", ticks - F.lit(GREGORIAN), F.lit(10)))


def in_range(ts: Column, start: object, end: object, end_inclusive: bool = False) -> Column:
    """Whether a time lies within bounds, of which either can be None."""
    ok = F.lit(True)
    if start is not None:
        ok = ok & (ts >= F.lit(start).cast("timestamp"))
    if end is not None:
        ok = ok & ((ts <= F.lit(end).cast("timestamp")) if end_inclusive else (ts < F.lit(end).cast("timestamp")))
    return ok


def week_bucket(ts: Column, days: int = 7) -> Column:
    """Number of the storage partition of so many days since 1970."""
    return F.floor(F.unix_seconds(ts) / F.lit(days * 86400)).cast("bigint")
