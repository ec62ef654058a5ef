"""Column helpers: time in whole milliseconds, guarded arithmetic, rounding, null-safe predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND, MINUTE, HOUR, DAY = 1000, 60_000, 3_600_000, 86_400_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def millis(ts: str | Column) -> Column:
    """Epoch milliseconds of a zone-less UTC timestamp, whatever the session's zone."""
    name = ts if isinstance(ts, str) else None
    stamp = f"cast(`{name}` as timestamp_ntz)" if name else None
    if stamp is None:
        raise TypeError("millis takes a column name")
    return F.expr(f"cast(floor(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {stamp}) / 1000) as bigint)")


def bucket(ms: str | Column, width: int) -> Column:
    """Start of the bucket of the given width in ms."""
    return (F.floor(col(ms) / width) * width).cast("long")


def local_minute(ms: str | Column, zone: str) -> Column:
    """Minute of the day of a UTC time in an IANA zone."""
    local = F.from_utc_timestamp(F.timestamp_millis(col(ms)), zone)
    return F.hour(local) * 60 + F.minute(local)


def rounded(c: str | Column, digits: int = 6) -> Column:
    """A double rounded for comparison across engines; NaN becomes null, -0.0 becomes 0.0."""
    return F.round(finite(c), digits) + F.lit(0.0)


def finite(c: str | Column) -> Column:
    """Null for NaN: the one spelling of a missing value."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x), x)


def yes(predicate: Column) -> Column:
    """A predicate that is false, not null, where an operand is missing."""
    return F.coalesce(predicate, F.lit(False))


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b where b is not 0."""
    return F.when(col(b) != 0, col(a) / col(b))


def half_up(value: str | Column, tick: Column | float) -> Column:
    """Rounds to a multiple of the tick, halves upwards."""
    step = tick if isinstance(tick, Column) else F.lit(tick)
    return F.floor(col(value) / step + 0.5) * step
