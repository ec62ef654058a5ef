"""Stateful sequential operators as window decompositions; rows are ordered by t within keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeframe.functions.columns import yes


def _w(keys: list[str], order: str = "t"):
    return W.partitionBy(*keys).orderBy(order)


def context_clock(df: DataFrame, keys: list[str], context_time: str) -> DataFrame:
    """df with new_context: the context time is there and differs from the row before's."""
    w = _w(keys)
    return df.withColumn("new_context", F.col(context_time).isNotNull() & ~F.col(context_time).eqNullSafe(F.lag(context_time).over(w)))


def unchanged(df: DataFrame, keys: list[str], value: str, to: str = "unchanged", start: int = 999) -> DataFrame:
    """df with the number of rows since the value last changed; frozen where either side is missing."""
    w = _w(keys)
    before = F.lag(value).over(w)
    frozen = F.col(value).isNull() | before.isNull()
    reset = ~frozen & (F.col(value) != before)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    rows = df.withColumn("__r", F.sum(F.when(reset, 1).otherwise(0)).over(upto)).withColumn("__i", F.when(frozen | reset, 0).otherwise(1))
    run = W.partitionBy(*keys, "__r").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(to, (F.sum("__i").over(run) + F.when(F.col("__r") == 0, start).otherwise(0)).cast("long")).drop("__r", "__i")


def since_value(df: DataFrame, keys: list[str], value: str, to: str = "since", start: int = 999) -> DataFrame:
    """df with the number of rows since the value was last there."""
    w = _w(keys)
    rows = df.withColumn("__n", F.row_number().over(w))
    last = F.max(F.when(F.col(value).isNotNull(), F.col("__n"))).over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn(to, F.when(last.isNull(), F.col("__n") + start).otherwise(F.col("__n") - last).cast("long")).drop("__n")


def ladder(df: DataFrame, keys: list[str], z: str, enter: float, exit: float, enter2: float, exit2: float, to: str = "level") -> DataFrame:
    """df with a two-level hysteresis of |z| and the level before (`to`_before).

    A missing z and |z| below `exit` reset to 0, |z| of `enter2` or more to 2; between resets
    the level rises to 1 at `enter` and falls from 2 to 1 below `exit2`.
    """
    w = _w(keys)
    a = F.abs(F.col(z))
    reset = F.when(a.isNull() | (a < exit), 0).when(a >= enter2, 2)
    rows = df.withColumn("__a", a).withColumn("__reset", reset)
    rows = rows.withColumn("__g", F.count("__reset").over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = W.partitionBy(*keys, "__g").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    base = F.coalesce(F.max("__reset").over(g), F.lit(0))
    rose, fell = F.max(yes(F.col("__a") >= enter)).over(g), F.max(yes(F.col("__a") < exit2)).over(g)
    level = F.when(base == 2, F.when(fell, 1).otherwise(2)).otherwise(F.when(rose, 1).otherwise(0))
    rows = rows.withColumn(to, level)
    return rows.withColumn(f"{to}_before", F.coalesce(F.lag(to).over(w), F.lit(0))).drop("__a", "__reset", "__g")


def schmitt_step(enter: float, exit: float):
    """The step of a signed trigger with states -1, 0, 1; a jump to the other sign passes 0 first."""

    def step(state: int, x: float) -> int:
        if x != x:
            return 0
        if state == 0:
            return 1 if x >= enter else -1 if x <= -enter else 0
        return 0 if state * x < exit else state

    return step


def impulse(value: Column, first: float, second: float) -> Column:
    """0, 1 or 2 by |value|, without memory."""
    return F.when(F.abs(value) >= second, 2).when(F.abs(value) >= first, 1).otherwise(0)


def change_kind(level: Column, direction: Column, level_before: Column, direction_before: Column) -> Column:
    """0 none, 1 appeared, 2 gone, 3 changed in level or direction."""
    return (
        F.when((level > 0) & (level_before == 0), 1)
        .when((level == 0) & (level_before > 0), 2)
        .when((level > 0) & ((level != level_before) | (direction != direction_before)), 3)
        .otherwise(0)
    )


def status_transitions(df: DataFrame, keys: list[str], status: str) -> DataFrame:
    """df with moved: "down" where the status falls to 2, "up" where it comes to 3 or more from below."""
    before = F.lag(status).over(_w(keys))
    return df.withColumn("moved", F.when(yes((F.col(status) == 2) & (before != 2)), "down").when(yes((F.col(status) >= 3) & (before < 3)), "up"))


def deduplicated_events(events: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """events with accepted (differs from the line before) and the running counts of accepted and suppressed ones."""
    w = W.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    rows = events.withColumn("accepted", ~F.lag(text).over(w).eqNullSafe(F.col(text)))
    return rows.withColumn("n_accepted", F.sum(F.col("accepted").cast("long")).over(upto)).withColumn("n_suppressed", F.sum((~F.col("accepted")).cast("long")).over(upto))


def latched_alerts(df: DataFrame, keys: list[str], level: str) -> DataFrame:
    """df with touched and fired: the first touch of a level fires, later ones are suppressed until the level changes.

    A missing level neither fires nor re-arms.
    """
    w = _w(keys)
    touched = yes((F.col("low") <= F.col(level)) & (F.col(level) <= F.col("high")) & F.col("confirmed"))
    before = F.last(level, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.col(level).isNotNull() & ~F.col(level).eqNullSafe(before)
    rows = df.withColumn("touched", touched).withColumn("__run", F.sum(new.cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    nth = F.sum(F.col("touched").cast("long")).over(W.partitionBy(*keys, "__run").orderBy("t").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("fired", F.col("touched") & (nth == 1)).drop("__run")


def freshness(context_ms: Column, seen_ms: Column, width: int, four: int, three: int) -> Column:
    """4 fresh, 3 usable, 2 stale, 0 absent, by whole periods behind."""
    behind = F.floor((context_ms - seen_ms) / width)
    return F.when(seen_ms.isNull(), 0).when(behind <= four, 4).when(behind <= three, 3).otherwise(2)


def adapter_status(enabled: Column, value: Column, wired: Column, held: Column, stale_after: int) -> Column:
    """0 off or no reading, 1 not wired, 2 stale, 3 held, 4 new. A missing reading comes before the wiring."""
    return F.when(~enabled | value.isNull(), 0).when(~F.coalesce(wired, F.lit(False)), 1).when(held > stale_after, 2).when(held > 0, 3).otherwise(4)


def ever(condition: Column, rows: int, w) -> Column:
    """Whether the condition held in one of the last `rows` rows; false while there are fewer."""
    frame = w.rowsBetween(-(rows - 1), 0)
    return (F.count(F.lit(1)).over(frame) == rows) & F.coalesce(F.max(condition).over(frame), F.lit(False))


def gated_status(enabled: Column, wired: Column, age: Column, stale_after: int) -> Column:
    """The status of a source that has a value only where something new came: 0 off, 1 not wired, then by the rows since the last value.

    wired: it left the close, or was missing, which the close never is.
    """
    return F.when(~enabled, 0).when(~F.coalesce(wired, F.lit(False)), 1).when(age > stale_after, 2).when(age >= 1, 3).otherwise(4)


# Words of the states of feeds, daily feeds and adapters.
FEED_WORDS = {4: "FRESH", 3: "1 BAR OLD", 2: "STALE", 1: "MISCONFIGURED", 0: "UNAVAILABLE"}
DAILY_WORDS = FEED_WORDS | {3: "1D OLD"}
ADAPTER_WORDS = {4: "ACTIVE", 3: "UNCHANGED 1 BAR", 2: "LIKELY STALE", 1: "MISCONFIGURED", 0: "UNAVAILABLE"}


def feed_word(status: Column, words: dict[int, str] = FEED_WORDS) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in words.items() for x in p]), status)


def spaced_drawdowns(df: DataFrame, keys: list[str], depth: str, threshold: float, spacing: int) -> DataFrame:
    """Rows whose drawdown exceeds the threshold, each at least `spacing` rows after the last accepted one.

    Acceptance depends on the last accepted row; candidates of a key (few by nature) are walked once, in order.
    """
    rows = df.withColumn("i", F.row_number().over(_w(keys))).filter(F.col(depth) <= -threshold)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, taken, last = pdf.sort_values("i"), [], None
        for i in pdf["i"]:
            taken.append(last is None or i - last >= spacing)
            last = i if taken[-1] else last
        return pdf[taken]

    return rows.groupBy(*keys).applyInPandas(run, rows.schema)


def non_overlapping(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Rows taken in order of start, then end, each only if the last one taken has ended: one position at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, taken, free = pdf.sort_values([start, end]), [], None
        for a, b in zip(pdf[start], pdf[end], strict=True):
            taken.append(free is None or a >= free)
            free = b if taken[-1] else free
        return pdf[taken]

    return df.groupBy(*keys).applyInPandas(run, df.schema)


TRADE = "signal_t long, entry_t long, exit_t long, entry double, exit double, initial_stop double, how string, r double, mae double, mfe double"


def simulated(bars: DataFrame, keys: list[str]) -> DataFrame:
    """keys and TRADE: long trades, one position at a time, of bars (keys, t, open, high, low, close, signal, stop, trail).

    A signal at a close enters at the next open, with that bar's `stop` as the initial one. A bar that
    opens at or below the stop in force leaves at its open ("gap"), one whose low reaches it at the stop
    ("stop"); the stop moves up only, to `trail` of each close, after the entry bar's close first. The last
    bar closes what is open ("end"). Signals in a position are ignored. r is in initial risks from the
    signal's close; mae and mfe are the worst and best of the bars held, as fractions of the entry.
    """
    from pyspark.sql import types as T

    columns = [f for f in bars.select(*keys).schema.fields]
    schema = T.StructType([*columns, *T._parse_datatype_string(TRADE).fields])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        waiting = position = None
        rows = list(pdf.sort_values("t").itertuples())
        for n, bar in enumerate(rows):
            if waiting is not None:
                position = {"signal": waiting, "entry": bar.open, "t": bar.t, "stop": waiting.stop, "mae": 0.0, "mfe": 0.0}
                waiting = None
            if position is not None:
                how = "gap" if bar.open <= position["stop"] else "stop" if bar.low <= position["stop"] else None
                left = {"gap": bar.open, "stop": position["stop"]}.get(how)
                if how is None:
                    position["mae"] = min(position["mae"], bar.low / position["entry"] - 1)
                    position["mfe"] = max(position["mfe"], bar.high / position["entry"] - 1)
                    if bar.trail == bar.trail and bar.trail is not None:
                        position["stop"] = max(position["stop"], bar.trail)
                    if n == len(rows) - 1:
                        how, left = "end", bar.close
                if how is not None:
                    signal = position["signal"]
                    out.append((*key, signal.t, position["t"], bar.t, position["entry"], left, signal.stop, how, (left - position["entry"]) / (signal.close - signal.stop), position["mae"], position["mfe"]))
                    position = None
            if position is None and bar.signal and bar.stop < bar.close:
                waiting = bar
        return pd.DataFrame(out, columns=schema.names)

    return bars.groupBy(*keys).applyInPandas(run, schema)
