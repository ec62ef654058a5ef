"""Rolling and ordered window operators; rows are ordered by t within keys.

Frames are rows unless said otherwise, and a missing value occupies its row.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeframe.functions.columns import DAY, col, yes
from tapeframe.operators.blocks import paced


def by(*keys: str, order: str = "t"):
    return W.partitionBy(*keys).orderBy(order)


def frame(w, n: int, current: bool = True):
    """The last n rows, with or without the current one."""
    return w.rowsBetween(-(n - 1), 0) if current else w.rowsBetween(-n, -1)


def full(x: Column, value: Column, n: int, w, current: bool = True) -> Column:
    """x where the frame of n rows holds n values."""
    return F.when(F.count(value).over(frame(w, n, current)) == n, x)


def sma(value: Column, n: int, w) -> Column:
    return full(F.avg(value).over(frame(w, n)), value, n, w)


def deviation(value: Column, n: int, w) -> Column:
    """Population standard deviation of n rows."""
    return full(F.stddev_pop(value).over(frame(w, n)), value, n, w)


def log_return(close: Column, w) -> Column:
    """ln(close / previous close); the first row's is 0."""
    before = F.lag(close).over(w)
    return F.when(F.row_number().over(w) == 1, F.lit(0.0)).when((close > 0) & (before > 0), F.log(close / before))


def true_range(w) -> Column:
    c = F.lag("close").over(w)
    h, low = F.col("high"), F.col("low")
    return F.when(c.isNull(), h - low).otherwise(F.greatest(h - low, F.abs(h - c), F.abs(low - c)))


#: Rows of a key that one task ranks.
RUN = 20_000


def ranked(df: DataFrame, keys: list[str], value: str, n: int, present: str, at_most: str, current: str | None = None) -> DataFrame:
    """df (keys, t, ..) with how many of the n previous rows have a value, and how many of those are at most `current` (default: the value).

    A key's rows are cut into runs with a halo of n rows; each run keeps its window sorted, so a
    row costs a logarithm of the window and no list of it is made.
    """
    size = max(RUN, n)
    rows = df.withColumn("__i", F.row_number().over(by(*keys)) - 1)
    run = F.floor(F.col("__i") / size)
    rows = rows.withColumn("__run", F.explode(F.array_compact(F.array(run, F.when(F.col("__i") % size >= size - n, run + 1)))))
    names = [*df.columns, "__i", "__run", present, at_most]
    schema = T.StructType([*rows.schema.fields, T.StructField(present, T.LongType()), T.StructField(at_most, T.LongType())])

    def counted(table: pa.Table) -> pa.Table:
        table = table.sort_by("__i")
        numbers = lambda name: table.column(name).cast(pa.float64()).to_numpy()
        x, cur = numbers(value), numbers(current or value)
        window: list[float] = []
        there, below = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for i in range(len(x)):
            if i and x[i - 1] == x[i - 1]:
                insort(window, x[i - 1])
            if i > n and x[i - 1 - n] == x[i - 1 - n]:
                del window[bisect_left(window, x[i - 1 - n])]
            there[i] = len(window)
            below[i] = bisect_right(window, cur[i]) if cur[i] == cur[i] else 0
        return pa.table([*table.columns, pa.array(there), pa.array(below)], names=names)

    found = rows.groupBy(*keys, "__run").applyInArrow(counted, schema)
    return found.filter(F.col("__run") == run).drop("__i", "__run")


def percent_rank(df: DataFrame, keys: list[str], value: str, n: int, to: str) -> DataFrame:
    """df with the percent of the n previous values that are at most the current one; null before n of them."""
    found = ranked(df, keys, value, n, "__there", "__below")
    return found.withColumn(to, F.when((F.col("__there") == n) & F.col(value).isNotNull(), F.col("__below") * 100.0 / n)).drop("__there", "__below")


def valid_norm(df: DataFrame, keys: list[str], value: str, n: int = 180, least: int = 45, current: str | None = None) -> DataFrame:
    """df with z, pct and n_valid of `current` (default: the value) against the last n rows.

    Missing values are skipped but occupy rows. The mean, deviation and count include the
    row's own value, the percentile counts the other valid values at most the current one.
    A zero deviation gives z 0. Fewer than `least` values give nothing.
    """
    w = by(*keys)
    x, cur = F.col(value), F.col(current or value)
    stats = ranked(df, keys, value, n - 1, "__there", "__below", current).withColumn("n_valid", F.count(x).over(frame(w, n))).withColumn("__m", F.avg(x).over(frame(w, n))).withColumn("__s", F.stddev_pop(x).over(frame(w, n)))
    ok = (F.col("n_valid") >= least) & (F.col("n_valid") > 1) & cur.isNotNull()
    return (
        stats.withColumn("z", F.when(ok, F.when(F.col("__s") > 0, (cur - F.col("__m")) / F.col("__s")).otherwise(0.0)))
        .withColumn("pct", F.when(ok, F.col("__below") * 100.0 / (F.col("n_valid") - 1)))
        .drop("__m", "__s", "__there", "__below")
    )


def slot_relative_volume(volume: Column, w, step: int = 6, slots: int = 28, least: int = 5) -> Column:
    """Volume over the mean of the positive volumes step, 2*step, .. rows before."""
    past = F.filter(F.array(*[F.lag(volume, step * k).over(w) for k in range(1, slots + 1)]), lambda v: v > 0)
    total = F.aggregate(past, F.lit(0.0), lambda a, v: a + v)
    return F.when((F.size(past) >= least) & (total > 0), volume / (total / F.size(past)))


def sum_last_valid(value: Column, k: int, back: int, w) -> Column:
    """Sum of the last k values among the last `back` rows; null with fewer."""
    seen = F.collect_list(value).over(frame(w, back))
    last = F.slice(F.reverse(seen), 1, k)
    return F.when(F.size(seen) >= k, F.aggregate(last, F.lit(0.0), lambda a, v: a + v))


def strided_sum(value: Column, step: int, terms: int, w) -> Column:
    """x[0] + x[step] + ..; null if one is missing."""
    out = value
    for k in range(1, terms):
        out = out + F.lag(value, step * k).over(w)
    return out


def running_extremes(df: DataFrame, partition: list[str], order: str = "t", index: str = "i") -> DataFrame:
    """df with run_high, run_low and the index of the first row that reached each."""
    w = W.partitionBy(*partition).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    top = F.max(F.struct(F.col("high"), (-F.col(index)).alias("i"))).over(w)
    bottom = F.min(F.struct(F.col("low"), F.col(index).alias("i"))).over(w)
    return df.withColumn("run_high", top["high"]).withColumn("run_high_i", -top["i"]).withColumn("run_low", bottom["low"]).withColumn("run_low_i", bottom["i"])


def pivots(df: DataFrame, keys: list[str], left: int, right: int) -> DataFrame:
    """df with pivot_high, pivot_low of `right` rows ago, confirmed at this row."""
    w = by(*keys)
    candidate_h, candidate_l = F.lag("high", right).over(w), F.lag("low", right).over(w)
    n = F.count("*").over(w.rowsBetween(-(left + right), 0)) == left + right + 1
    others = lambda f, c: F.greatest(f(c).over(w.rowsBetween(-(left + right), -right - 1)), f(c).over(w.rowsBetween(-right + 1, 0))) if f is F.max else F.least(f(c).over(w.rowsBetween(-(left + right), -right - 1)), f(c).over(w.rowsBetween(-right + 1, 0)))
    return df.withColumn("pivot_high", F.when(n & (candidate_h > others(F.max, "high")), candidate_h)).withColumn("pivot_low", F.when(n & (candidate_l < others(F.min, "low")), candidate_l))


def relative_strength(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """df with rsi: 100 * mean gain / (mean gain + mean loss) of the last n changes, simple means."""
    w = by(*keys)
    change = F.col("close") - F.lag("close").over(w)
    rows = df.withColumn("__d", change)
    gain = F.sum(F.greatest(F.col("__d"), F.lit(0.0))).over(frame(w, n))
    loss = F.sum(F.greatest(-F.col("__d"), F.lit(0.0))).over(frame(w, n))
    return rows.withColumn("rsi", F.when((F.count("__d").over(frame(w, n)) == n) & (gain + loss > 0), 100 * gain / (gain + loss))).drop("__d")


def anchored_vwap(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Per-bar volume-weighted price since the UTC day began, from bars with t, close, volume."""
    day = (F.floor(F.col("t") / DAY)).cast("long")
    w = W.partitionBy(*keys, "day").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    rows = trades.withColumn("day", day)
    return rows.withColumn("vwap", F.sum(F.col("close") * F.col("volume")).over(w) / F.sum("volume").over(w))


def rolling_median_clamped(value: Column, n: int, w, low: float, high: float) -> Column:
    """Rolling median of n rows over the value, clamped."""
    median = full(F.percentile(value, F.lit(0.5)).over(frame(w, n)), value, n, w)
    return F.least(F.greatest(median / value, F.lit(low)), F.lit(high))


def forward_excursions(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """df with mae and mfe of a long position over the next k rows, as fractions of the close."""
    ahead = by(*keys).rowsBetween(1, k)
    enough = F.count("*").over(ahead) == k
    return df.withColumn("mae", F.when(enough, F.min("low").over(ahead) / F.col("close") - 1)).withColumn("mfe", F.when(enough, F.max("high").over(ahead) / F.col("close") - 1))


#: Rows of a key that one task of flow() reads, unless the widest window holds more.
CROWD = 100_000


def window_sums(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Sums of values[start:stop] of each pair, from sums of 1, 2, 4, .. neighbours: a logarithm of the window for each, and nothing is subtracted."""
    start, stop, out = start.copy(), stop.copy(), np.zeros(len(start))
    while len(at := np.flatnonzero(start < stop)):
        odd = at[start[at] & 1 == 1]
        out[odd] += values[start[odd]]
        start[odd] += 1
        odd = at[stop[at] & 1 == 1]
        stop[odd] -= 1
        out[odd] += values[stop[odd]]
        start, stop = start >> 1, stop >> 1
        values = np.append(values, 0.0) if len(values) % 2 else values
        values = values[::2] + values[1::2]
    return out


def flow(trades: DataFrame, keys: list[str], widths_ms: list[int], samples: DataFrame | None = None, block_ms: int = 3_600_000) -> DataFrame:
    """trades, or samples (keys, t), with buy_<w>, sell_<w>, n_<w> and afi_<w>: notional of each side in the last w ms, and its imbalance.

    Both ends of a window count. Trades are dealt by blocks of time, each with a halo of the
    widest window before it, so that a busy key is many tasks; busy blocks are cut finer. A row
    costs a logarithm of its window.
    """
    quote = F.col("px") * F.col("qty")
    sides = {"__buy": F.when(F.col("aggressive_buy"), quote).otherwise(0.0), "__sell": F.when(~F.col("aggressive_buy"), quote).otherwise(0.0), "__one": F.lit(1)}
    rows = trades.withColumns(sides | {"__own": F.lit(samples is None)})
    if samples is not None:
        rows = rows.select(*keys, "t", *sides, "__own").unionByName(samples.withColumns({"__buy": F.lit(0.0), "__sell": F.lit(0.0), "__one": F.lit(0), "__own": F.lit(True)}), allowMissingColumns=True)
    widest = max(widths_ms)
    block_ms = max(paced(rows, keys, "t", max(block_ms, 4 * widest), CROWD), widest)
    block = F.floor(F.col("t") / block_ms)
    shown = [c for c in rows.columns if c not in (*sides, "__own")]
    fields = [f for ms in widths_ms for f in (T.StructField(f"buy_{ms}", T.DoubleType()), T.StructField(f"sell_{ms}", T.DoubleType()), T.StructField(f"n_{ms}", T.LongType()))]
    schema = T.StructType([*rows.select(*shown).schema.fields, *fields])
    rows = rows.withColumn("__block", F.explode(F.array_compact(F.array(block, F.when(F.col("t") + widest >= (block + 1) * block_ms, block + 1)))))
    rows = rows.withColumn("__own", F.col("__own") & (F.col("__block") == block))

    def summed(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        t, own = table.column("t").to_numpy(), table.column("__own").to_numpy()
        found, ends = [], np.searchsorted(t, t[own], side="right")
        ones = np.append(0, np.cumsum(table.column("__one").to_numpy().astype(np.int64)))
        for ms in widths_ms:
            starts = np.searchsorted(t, t[own] - ms, side="left")
            for side in ("__buy", "__sell"):
                column = table.column(side)
                there = np.append(0, np.cumsum(column.is_valid().to_numpy()))
                sums = window_sums(column.fill_null(0.0).to_numpy(), starts, ends)
                found.append(pa.array(sums, mask=there[ends] == there[starts]))  # null where all are missing
            found.append(pa.array(ones[ends] - ones[starts]))
        return pa.table([*table.select(shown).filter(table.column("__own")).columns, *found], names=schema.names)

    out = rows.groupBy(*keys, "__block").applyInArrow(summed, schema)
    for ms in widths_ms:
        total = F.col(f"buy_{ms}") + F.col(f"sell_{ms}")
        out = out.withColumn(f"afi_{ms}", F.when(total > 0, (F.col(f"buy_{ms}") - F.col(f"sell_{ms}")) / total).otherwise(0.0))
    return out.select(*shown, *[f"{c}_{ms}" for ms in widths_ms for c in ("buy", "sell", "n", "afi")])


def autocovariances(df: DataFrame, keys: list[str], value: str, lags: int) -> DataFrame:
    """keys, n, and acov_0 .. acov_<lags>: mean product of deviations at each lag over all n rows."""
    w = by(*keys)
    e = F.col(value) - F.avg(value).over(W.partitionBy(*keys))
    rows = df.withColumn("__e", e)
    for lag in range(lags + 1):
        rows = rows.withColumn(f"__p{lag}", F.col("__e") * F.lag("__e", lag).over(w) if lag else F.col("__e") * F.col("__e"))
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), *[(F.sum(f"__p{k}") / F.count(value)).alias(f"acov_{k}") for k in range(lags + 1)])


def demeaned(df: DataFrame, keys: list[str], value: str) -> Column:
    return col(value) - F.avg(value).over(W.partitionBy(*keys))


def breakout(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """df with prev_high, prev_low of the n rows before, and breakout 1, -1 or 0."""
    w = by(*keys)
    out = df.withColumn("prev_high", full(F.max("high").over(frame(w, n, False)), F.col("high"), n, w, False)).withColumn("prev_low", full(F.min("low").over(frame(w, n, False)), F.col("low"), n, w, False))
    return out.withColumn("breakout", F.when(yes(F.col("close") > F.col("prev_high")), 1).when(yes(F.col("close") < F.col("prev_low")), -1).otherwise(0))
