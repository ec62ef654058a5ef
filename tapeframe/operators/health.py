"""Health of feeds and instruments, and what is said about it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear_instrument(point_value: Column, ticker: Column, base: str = "BTC") -> Column:
    """A point value of 1 (unknown allowed) and the base asset in the ticker."""
    return (point_value.isNull() | (F.abs(point_value - 1) < 1e-9)) & F.upper(ticker).contains(base)


def core_ok(*statuses: Column) -> Column:
    out = F.lit(True)
    for s in statuses:
        out = out & (s >= 3)
    return out


def connected(*statuses: Column) -> Column:
    """How many feeds are usable."""
    out = F.lit(0)
    for s in statuses:
        out = out + F.when(s >= 3, 1).otherwise(0)
    return out


def issues(pairs: list[tuple[Column, str]]) -> Column:
    """The texts whose condition holds, one a line."""
    return F.concat_ws("\n", *[F.when(when, F.lit(text)) for when, text in pairs])


def first_issue(pairs: list[tuple[Column, str]]) -> Column:
    """The first text whose condition holds."""
    return F.coalesce(*[F.when(when, F.lit(text)) for when, text in pairs])


def reconnect_delay(attempt: int, first_ms: int = 500, most_ms: int = 30_000) -> int:
    """Pause before the next connection attempt."""
    return min(most_ms, first_ms * 2 ** min(attempt, 6))


def is_stale(last_ms: Column, now_ms: Column, limit_ms: int) -> Column:
    """Nothing came for longer than the limit."""
    return F.coalesce(now_ms - last_ms > limit_ms, F.lit(True))
