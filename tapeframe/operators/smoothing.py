"""Audit of smoothed states: how long labels last, what smoothing delays, loses and flattens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeframe.functions.columns import DAY, rounded, yes
from tapeframe.operators import scans, state, windows

# Taps of the exponential averages that compete (1 is none), tiers of |z|, and what a candidate must meet.
TAPS, TIERS = (1, 2, 3, 4), (1.0, 1.5, 2.0, 2.5)
MEDIAN_RUN, MEDIAN_DELAY, LATE_DELAY, RETENTION = 3, 1, 2, 0.9


def states(df: DataFrame, keys: list[str], rungs: tuple[float, float, float, float], taps: tuple[int, ...] = TAPS, block: int = 10 * DAY) -> DataFrame:
    """keys, taps, t, i, z, s and level: z (null where missing) smoothed by each candidate, and the ladder's level on it."""
    rows = df.select(*keys, "t", "z").withColumn("i", F.row_number().over(windows.by(*keys)))
    found = [scans.smoothed(rows, keys, "t", "z", 1, 2 / (k + 1), "s", block=block).withColumn("taps", F.lit(k)) for k in taps]
    all_ = reduce(DataFrame.unionByName, found).withColumn("s", F.when(F.col("z").isNotNull(), rounded("s")))
    return state.ladder(all_, [*keys, "taps"], "s", *rungs)


def label_runs(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, taps: runs of one engaged label (level and side), their median length, engaged episodes and those of a single bar."""
    w = windows.by(*keys, "taps")
    label = (F.col("level") * F.signum(F.coalesce("s", F.lit(0.0)))).cast("int")
    new = lambda x: F.coalesce((x != F.lag(x).over(w)).cast("int"), F.lit(1))
    rows = found.withColumn("label", label).withColumn("on", (F.col("level") > 0).cast("int"))
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("a", new(F.col("label"))).withColumn("b", new(F.col("on"))).withColumn("run", F.sum("a").over(upto)).withColumn("episode", F.sum("b").over(upto)).filter("on = 1")
    runs = rows.groupBy(*keys, "taps", "run").agg(F.count("*").alias("n")).groupBy(*keys, "taps").agg(F.count("*").alias("n_runs"), F.percentile("n", F.lit(0.5)).alias("median_run"))
    episodes = rows.groupBy(*keys, "taps", "episode").agg(F.count("*").alias("n")).groupBy(*keys, "taps").agg(F.count("*").alias("n_episodes"), F.sum((F.col("n") == 1).cast("long")).alias("n_false"))
    return runs.join(episodes, [*keys, "taps"])


def tiers(found: DataFrame, keys: list[str], lag: int, levels: tuple[float, ...] = TIERS) -> DataFrame:
    """keys, taps, tier: raw events (runs of |z| at the tier), the share that the smoothed state meets by `lag` rows after their end,
    median and ninth decile of the rows until then, and the median of the smoothed peak in parts of the raw one.

    The next engaged row is carried backwards, so events meet states without a join.
    """
    back = W.partitionBy(*keys, "taps").orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, 0)
    rows = found.withColumn("next", F.min(F.when(F.col("level") > 0, F.col("i"))).over(back))
    rows = rows.withColumn("tier", F.explode(F.array(*map(F.lit, levels)))).withColumn("on", yes(F.abs("z") >= F.col("tier")))
    w = windows.by(*keys, "taps", "tier")
    rows = rows.withColumn("starts", (F.col("on") & ~F.coalesce(F.lag("on").over(w), F.lit(False))).cast("int")).withColumn("event", F.sum("starts").over(w.rowsBetween(W.unboundedPreceding, 0)))
    events = rows.filter("on").groupBy(*keys, "taps", "tier", "event").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.min("next").alias("next"), F.max(F.abs("s")).alias("s"), F.max(F.abs("z")).alias("z"))
    met = yes(F.col("next") <= F.col("last") + lag)
    delay = F.when(met, F.col("next") - F.col("first"))
    return events.groupBy(*keys, "taps", "tier").agg(
        F.count("*").alias("n_events"), F.avg(met.cast("double")).alias("retention"), F.percentile(delay, F.lit(0.5)).alias("median_delay"), F.percentile(delay, F.lit(0.9)).alias("late_delay"),
        F.percentile(F.col("s") / F.col("z"), F.lit(0.5)).alias("attenuation"),
    )


def choice(runs: DataFrame, by_tier: DataFrame, keys: list[str], enter: float) -> DataFrame:
    """keys, taps: which candidates pass (duration, delay, retention at every tier from the entry on), and the fewest taps that do; null if none."""
    from_entry = by_tier.filter(F.col("tier") >= enter).groupBy(*keys, "taps").agg(
        F.min("retention").alias("least_retention"), F.max(F.when(F.col("tier") == enter, F.col("median_delay"))).alias("median_delay"), F.max(F.when(F.col("tier") == enter, F.col("late_delay"))).alias("late_delay")
    )
    rows = runs.join(from_entry, [*keys, "taps"], "left")
    rows = rows.withColumn("duration_ok", F.col("median_run") >= MEDIAN_RUN).withColumn("delay_ok", yes((F.col("median_delay") <= MEDIAN_DELAY) & (F.col("late_delay") <= LATE_DELAY))).withColumn("retention_ok", yes(F.col("least_retention") >= RETENTION))
    passes = F.col("duration_ok") & F.col("delay_ok") & F.col("retention_ok")
    return rows.withColumn("passes", passes).withColumn("chosen", F.min(F.when(passes, F.col("taps"))).over(W.partitionBy(*keys)))
