"""Clock sessions in a time zone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeframe.functions.columns import local_minute


@dataclass(frozen=True)
class Session:
    """A half-open window of wall time, in minutes of the day; an end at or before the start wraps midnight."""

    name: str
    start: int
    end: int
    zone: str = "America/New_York"

    def holds(self, ms: str) -> Column:
        m = local_minute(ms, self.zone)
        return (m >= self.start) & (m < self.end) if self.end > self.start else (m >= self.start) | (m < self.end)


# The four sessions, New York wall time.
SESSIONS = (Session("asia", 20 * 60, 0), Session("london", 3 * 60, 5 * 60), Session("ny_am", 8 * 60 + 30, 11 * 60), Session("london_close", 10 * 60, 12 * 60))


def check_timeframe(width_ms: int) -> None:
    """Sessions need intraday bars of four hours at most."""
    if not 0 < width_ms <= 14_400_000:
        raise ValueError("sessions need a timeframe of at most four hours")


def track(bars: DataFrame, keys: list[str], session: Session) -> DataFrame:
    """bars with i, inside, edge (session starts), instance, run_high, run_high_i, run_low, run_low_i, held_high, held_low.

    A session starts where a bar is inside and the one before was not. run_* follow the
    session's extremes (first occurrence); held_* are those of the last inside bar, carried on
    to the next start. Bars are taken as given: a session without a bar leaves no trace.
    """
    w = W.partitionBy(*keys).orderBy("t")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    rows = bars.withColumn("i", (F.row_number().over(w) - 1).cast("long")).withColumn("inside", session.holds("t"))
    rows = rows.withColumn("edge", F.col("inside") & ~F.coalesce(F.lag("inside").over(w), F.lit(False)))
    rows = rows.withColumn("instance", F.sum(F.col("edge").cast("long")).over(upto))
    run = W.partitionBy(*keys, "instance", "inside").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    top = F.max(F.struct(F.col("high"), (-F.col("i")).alias("i"))).over(run)
    bottom = F.min(F.struct(F.col("low"), F.col("i"))).over(run)
    for name, value in (("run_high", top["high"]), ("run_high_i", -top["i"]), ("run_low", bottom["low"]), ("run_low_i", bottom["i"])):
        rows = rows.withColumn(name, F.when(F.col("inside"), value))
    return rows.withColumn("held_high", F.last("run_high", ignorenulls=True).over(upto)).withColumn("held_low", F.last("run_low", ignorenulls=True).over(upto))


def instances(tracked: DataFrame, keys: list[str]) -> DataFrame:
    """One row per session instance: first and last bar, levels and their bars."""
    inside = tracked.filter("inside")
    return inside.groupBy(*keys, "instance").agg(
        F.min("t").alias("started"), F.max("t").alias("ended"), F.max("high").alias("high"), F.min("low").alias("low"), F.count("*").alias("n_bars"), F.max_by("run_high_i", "t").alias("high_i"), F.max_by("run_low_i", "t").alias("low_i")
    )
