"""Books of a feed without sequence ids: snapshots and deltas, rebuilt segment by segment, and their reconciliation.

A snapshot replaces the whole book, so what lies between two snapshots is a segment that
needs nothing from before it, and all segments are rebuilt in parallel. The first delta
after a snapshot makes the book valid; deltas before any snapshot are dropped. Times that
go back are counted. Crossing is asked for only where the book is read; a crossed book is
invalid until the next snapshot. Levels further than a share of the mid are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeframe.operators import alignment, book, stats
from tapeframe.sources.shared import cut


def segments(events: DataFrame, keys: list[str], block: int) -> DataFrame:
    """events (keys, arrival, ts, is_snapshot, one row an event) with segment: how many snapshots had begun; 0 before the first.

    Rows of one snapshot follow each other. Counted in runs of the order of arrival, with each
    run's count carried to the next ones.
    """
    placed = stats.in_runs(stats.numbered(events, keys, "arrival", block), 1)
    w = W.partitionBy(*keys, "__run").orderBy("__i")
    begins = F.col("is_snapshot") & ~F.coalesce(F.lag("is_snapshot").over(w), F.lit(False))
    rows = cut(placed.withColumn("__begins", begins.cast("long")).where("__own"))
    counts = rows.groupBy(*keys, "__run").agg(F.sum("__begins").alias("__c"))
    before = F.coalesce(F.sum("__c").over(W.partitionBy(*keys).orderBy("__run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(counts.select(*keys, "__run", before.alias("__before")), [*keys, "__run"])
    return rows.withColumn("segment", F.col("__before") + F.sum("__begins").over(w)).drop("__run", "__own", "__begins", "__before", "__i", "__n")


def clocked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows of segments() with t (the largest ts of the segment so far), went_back, and valid (a delta came)."""
    w = W.partitionBy(*keys, "segment").orderBy("arrival")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    back = ~F.col("is_snapshot") & F.coalesce(F.col("ts") < F.lag("ts").over(w), F.lit(False)) & (F.col("segment") > 0)
    valid = (F.col("segment") > 0) & F.max(~F.col("is_snapshot")).over(upto)
    return rows.withColumn("t", F.max("ts").over(upto)).withColumn("went_back", back).withColumn("valid", valid)


def counters(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, snapshots (that a delta followed), applied, dropped, regressions of rows of clocked()."""
    delta = ~F.col("is_snapshot")
    return rows.groupBy(*keys).agg(
        F.countDistinct(F.when(F.col("valid"), F.col("segment"))).alias("snapshots"),
        F.count(F.when(delta & (F.col("segment") > 0), 1)).alias("applied"),
        F.count(F.when(delta & (F.col("segment") == 0), 1)).alias("dropped"),
        F.count(F.when(F.col("went_back"), 1)).alias("regressions"),
    )


def near(measure: Callable, share: float) -> Callable:
    """The measure on levels within `share` of the mid, for a book that isn't crossed: with a last column that says whether it is."""

    def run(bid_price: np.ndarray, bid_qty: np.ndarray, ask_price: np.ndarray, ask_qty: np.ndarray) -> list[tuple]:
        if not len(bid_price) or not len(ask_price):
            return []
        mid = (bid_price[0] + ask_price[0]) / 2
        b, a = bid_price >= mid * (1 - share), ask_price <= mid * (1 + share)
        crossed = bool(bid_price[0] >= ask_price[0])
        sides = (bid_price, bid_qty, ask_price, ask_qty) if crossed else (bid_price[b], bid_qty[b], ask_price[a], ask_qty[a])
        return [(*found, crossed) for found in measure(*sides)]

    return run


def seconds(events: DataFrame, levels: DataFrame, keys: list[str], samples: DataFrame, block: int, block_ms: int, share: float = 0.02, measure: Callable = book.measured, schema: str = book.FEATURES, every_ms: int = 1) -> DataFrame:
    """keys, at, segment and `schema` of the book at each sample (keys, at) at which it is valid and was not crossed since its snapshot.

    events: keys, arrival, ts, is_snapshot; levels: keys, arrival, side, price, qty.
    every_ms: what all sample times are multiples of.
    """
    rows = cut(clocked(segments(events, keys, block), keys))
    state = rows.where("segment > 0").select(*keys, F.col("t").alias("__rt"), F.struct("arrival", "segment", "valid").alias("__state"))
    # of events of one instant the last to arrive is the largest
    asked = alignment.as_of(samples.select(*keys, "at"), state, keys, "at", "__rt", ["__state"], block=block_ms).where("__state.valid")
    asked = asked.select(*keys, F.col("__state.segment").alias("segment"), "at")
    own = [*keys, "segment"]
    updates = levels.join(rows.where("segment > 0").select(*keys, "arrival", "segment", "t"), [*keys, "arrival"]).withColumnRenamed("arrival", "seq")
    found = cut(book.sampled(updates, own, asked, near(measure, share), f"{schema}, crossed boolean", block_ms, every_ms))
    ends = found.where("crossed").groupBy(*own).agg(F.min("at").alias("__end"))
    return found.join(ends, own, "left").where("__end is null or at < __end").drop("__end", "crossed")


def reconciled(a: DataFrame, b: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """A row for each column of the rows that both have: n, n_equal, median, p99 and largest relative difference, correlation; and how many only one has."""
    left, right = (df.select(*on, F.lit(1).alias(f"__{name}"), *[F.col(c).alias(f"{name}_{c}") for c in columns]) for df, name in ((a, "a"), (b, "b")))
    both = cut(left.join(right, on, "full"))
    lone = both.agg(F.count(F.when(F.col("__b").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("__a").isNull(), 1)).alias("only_b"))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").cast("double").alias("x"), F.col(f"b_{c}").cast("double").alias("y")) for c in columns]))
    long = both.where("__a is not null and __b is not null").select(cells.alias("c")).select("c.*")
    apart = F.abs(F.col("x") - F.col("y")) / F.greatest(F.abs("x"), F.abs("y"), F.lit(1e-12))
    long = long.withColumn("rel", F.when(F.col("x") == F.col("y"), 0.0).otherwise(F.round(apart, 9)))
    spread = F.stddev_pop("x") * F.stddev_pop("y")
    found = long.groupBy("column").agg(F.count("*").alias("n"), F.count(F.when(F.col("rel") == 0, 1)).alias("n_equal"), F.max("rel").alias("largest"), F.when(spread > 0, F.covar_pop("x", "y") / spread).alias("corr"))
    for p, to in ((0.5, "median"), (0.99, "p99")):
        found = found.join(stats.nearest_rank(long, ["column"], "rel", p, to), "column")
    return found.join(F.broadcast(lone))  # one row
