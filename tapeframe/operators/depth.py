"""Depth curves of sampled books, and what orders cost on them now and later.

A record is a book at an instant: FEATURES, and for each side a curve: prices from the
best, with the notional and the base quantity from the best up to each. An order of any
size up to `most` is walked on the curve alone, so costs at many sizes and at later
instants need no book.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeframe.operators import alignment, book, stats, windows
from tapeframe.sources.shared import cut

#: Taker fee in bp, the saving that matters, seconds of the error's kernel.
TAKER_BP, MATERIAL_BP, KERNEL_S = 5.0, 0.5, 60
SIDES = ("BUY", "SELL")

_CURVES = ", ".join(f"{side}_{part} array<double>" for side in ("bid", "ask") for part in ("prices", "values", "bases"))
RECORD = f"{book.FEATURES}, bid_levels int, ask_levels int, {_CURVES}"


def curve(price: np.ndarray, qty: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prices, cumulative notionals and base quantities of the levels until they hold `most`."""
    held = 64
    while True:  # more levels only where the first don't reach
        values = np.cumsum(price[:held] * qty[:held])
        if held >= len(price) or values[-1] >= most:
            break
        held *= 4
    n = min(int(np.searchsorted(values, most)) + 1, len(values))
    return price[:n], values[:n], np.cumsum(qty[:n])


def recorded(most: float) -> Callable:
    """A measure for book.sampled that gives RECORD."""

    def measure(*sides: np.ndarray) -> list[tuple]:
        found = book.measured(*sides)
        return [(*f, len(sides[0]), len(sides[2]), *curve(*sides[:2], most), *curve(*sides[2:], most)) for f in found]

    return measure


def records(updates: DataFrame, trades: DataFrame, keys: list[str], samples: DataFrame, most: float | None, block_ms: int, every_ms: int = 1) -> DataFrame:
    """keys, at, RECORD, flow of 1, 5 and 30 s and the interactions of the book at each sample (keys, at).

    Without `most` there are no curves and no numbers of levels, only book.FEATURES.
    """
    measure, schema = (book.measured, book.FEATURES) if most is None else (recorded(most), RECORD)
    found = book.sampled(updates, keys, samples, measure, schema, block_ms, every_ms)
    flow = windows.flow(trades, keys, list(book.FLOW_MS), samples.withColumnRenamed("at", "t")).withColumnRenamed("t", "at")
    return book.interactions(found.join(flow, [*keys, "at"]), "buy_5000", "sell_5000", "afi_5000")


def vwap(side: str, notional: float) -> Column:
    """The average price of a market order on a record's curve; null where the curve can't fill it."""
    part = "ask" if side == "BUY" else "bid"
    whole = F.col(f"{part}_values")
    level = F.size(F.filter(whole, lambda v: v < notional - 1e-9))  # full levels; the next is taken in part
    last = F.least(level, F.size(whole) - 1)
    before = lambda c: F.when(last > 0, F.get(c, last - 1)).otherwise(0.0)
    spent = F.least(F.lit(float(notional)), F.get(whole, last))
    base = before(F.col(f"{part}_bases")) + (spent - before(whole)) / F.get(F.col(f"{part}_prices"), last)
    return F.when(F.element_at(whole, -1) >= notional - 1e-6, spent / base)


def priced(found: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """Records with vwap_<side>_<size>."""
    return found.withColumns({f"vwap_{s}_{n}": vwap(s, n) for s in SIDES for n in sizes})


def later(rows: DataFrame, found: DataFrame, keys: list[str], columns: dict[str, tuple[str, int]], block_ms: int, stale_ms: int | None = None) -> DataFrame:
    """rows (keys, at, ..) with, by their new names, columns of the record in force exactly so many ms later (below 0: earlier).

    A book stands until its next record; what is after a key's last record is not known.
    stale_ms: how old a record in force may be. All times are asked for in one as-of join of
    narrow rows; joins of one time each on top of each other would be planned, and in part
    run, twice as often with every further time.
    """
    payload, times = sorted({c for c, _ in columns.values()}), sorted({ms for _, ms in columns.values()})
    asks = rows.select(*keys, "at", F.explode(F.array(*[F.lit(ms).cast("long") for ms in times])).alias("__ms")).withColumn("__then", F.col("at") + F.col("__ms"))
    held = alignment.as_of(asks, found.select(*keys, F.col("at").alias("__rt"), *payload), keys, "__then", "__rt", payload, block=block_ms)
    known = F.col("__then") <= F.col("__end")
    if stale_ms is not None:
        known = known & (F.col("__then") - F.col("matched_t") <= stale_ms)
    held = held.join(found.groupBy(*keys).agg(F.max("at").alias("__end")), keys).where(known)
    picks = [F.max(F.when(F.col("__ms") == ms, F.col(c))).alias(name) for name, (c, ms) in columns.items()]
    return rows.join(held.groupBy(*keys, "at").agg(*picks), [*keys, "at"], "left")


def decisions(found: DataFrame, keys: list[str], step_s: int) -> DataFrame:
    """The first record of each step_s seconds."""
    rest = [c for c in found.columns if c not in keys]
    first = found.groupBy(*keys, F.floor(F.col("at") / (1000 * step_s)).alias("__step")).agg(F.min_by(F.struct(*rest), "at").alias("__r"))
    return first.select(*keys, "__r.*")


def costs(found: DataFrame, keys: list[str], sizes: tuple[int, ...], waits: tuple[int, ...], step_s: int, block_ms: int, carry: list[str] | None = None, stale_ms: int | None = None) -> DataFrame:
    """keys, at, order_side, size, wait, now_bp, later_bp and `carry` of every decision that can be filled at once.

    Costs are against the mid at the decision, fees included; later_bp is of the same order
    `wait` seconds later, null where it can't be filled then.
    """
    names = [f"vwap_{s}_{n}" for s in SIDES for n in sizes]
    rows = priced(found, sizes).select(*keys, "at", "mid", *names, *[c for c in carry or [] if c != "mid"])
    out = later(cut(decisions(rows, keys, step_s)), rows, keys, {f"{c}_{w}": (c, 1000 * w) for w in waits for c in names}, block_ms, stale_ms)
    cells = []
    for s in SIDES:
        cost = lambda c, s=s: (1.0 if s == "BUY" else -1.0) * (F.col(c) - F.col("mid")) / F.col("mid") * 1e4 + TAKER_BP
        cells += [F.struct(F.lit(s).alias("order_side"), F.lit(n).alias("size"), F.lit(w).alias("wait"), cost(f"vwap_{s}_{n}").alias("now_bp"), cost(f"vwap_{s}_{n}_{w}").alias("later_bp")) for n in sizes for w in waits]
    return out.select(*keys, "at", *(carry or []), F.explode(F.array(*cells)).alias("c")).select(*keys, "at", *(carry or []), "c.*").where("now_bp is not null")


def _means(rows: DataFrame, by: list[str], values: dict[str, str], lag: int) -> DataFrame:
    """by and <name>_n, _mean, _t of each value, in one pass over the rows."""
    long = rows.select(*by, "at", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(v).alias("v")) for name, v in values.items()])).alias("x")).select(*by, "at", "x.*")
    found = stats.hac_mean(long, [*by, "name"], "at", "v", lag)
    pick = lambda name, c: F.max(F.when(F.col("name") == name, F.col(c))).alias(f"{name}_{c}")
    return found.groupBy(*by).agg(*[pick(name, c) for name in values for c in ("n", "mean", "t")])


def shortfall(priced_rows: DataFrame, keys: list[str], step_s: int) -> DataFrame:
    """keys, order_side, size, wait and, over decisions: immediate and waiting cost with HAC t, their paired difference with its tail and spread, and whether it matters.

    The difference is above 0 where waiting cost more.
    """
    by = [*keys, "order_side", "size", "wait"]
    lag = max(1, KERNEL_S // step_s)
    paired = priced_rows.withColumn("d", F.round(F.col("later_bp") - F.col("now_bp"), 9))
    out = _means(paired, by, {"now": "now_bp", "later": "later_bp", "diff": "d"}, lag)
    out = out.join(stats.nearest_rank(paired, by, "d", 0.95, "p95"), by, "left").join(paired.groupBy(*by).agg(F.stddev_pop("d").alias("dispersion")), by)
    better = (F.col("diff_mean") > MATERIAL_BP) & (F.col("diff_t") > 2)
    worse = (F.col("diff_mean") < -MATERIAL_BP) & (F.col("diff_t") < -2)
    return out.withColumn("act_now", F.coalesce(better, F.lit(False))).withColumn("wait_instead", F.coalesce(worse, F.lit(False)))


#: Records' columns that the states need.
STATE_COLUMNS = ["mid", "spread_bp", "bid_within5bp", "ask_within5bp", "buy_5000"]


def book_states(rows: DataFrame, keys: list[str], step_s: int, blocks: int) -> DataFrame:
    """rows of BUY decisions with a wait that was filled, with the five states they are told apart by.

    Replenishment is the near depth less that of the decision before, looked for in the same or the
    `blocks` steps before; 0 for the first.
    """
    near = F.col("bid_within5bp") + F.col("ask_within5bp")
    out = rows.where("order_side = 'BUY' and later_bp is not null").withColumn("near", near)
    previous = alignment.as_of(out, out.select(*keys, F.col("at").alias("__rt"), F.col("near").alias("__near")), keys, "at", "__rt", ["__near"], strict=True, block=1000 * step_s * blocks)
    return previous.drop("matched_t").withColumns({
        "E1_spread": F.round("spread_bp", 6),
        "E1_depth": F.round(-F.col("near"), 6),
        "E2_pressure": F.round(F.col("buy_5000") / F.greatest(F.lit(1.0), F.col("ask_within5bp")), 6),
        "E3_replenishment": F.round(F.coalesce(F.col("near") - F.col("__near"), F.lit(0.0)), 6),
        "E4_fragility": F.round(F.col("spread_bp") / F.greatest(F.lit(1e-9), F.col("near") / 1e6), 6),
    })


STATES = ("E1_spread", "E1_depth", "E2_pressure", "E3_replenishment", "E4_fragility")


def by_state(rows: DataFrame, keys: list[str], least: int = 100) -> DataFrame:
    """keys, state, tercile: number, costs and tail of waiting of the decisions in each third of each state; nothing below `least` decisions."""
    long = rows.select(*keys, "at", "now_bp", F.round(F.col("later_bp") - F.col("now_bp"), 9).alias("d"), F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.col(s).alias("x")) for s in STATES])).alias("s")).select(*keys, "at", "now_bp", "d", "s.*")
    by = [*keys, "state"]
    edges = stats.picked(long, by, "x", 3)
    enough = rows.groupBy(*keys).agg(F.count("*").alias("__all")).where(F.col("__all") >= least).select(*keys)
    cells = long.join(enough, keys).join(edges, by).withColumn("tercile", stats.bucket_of(F.col("x"), [F.col("e1"), F.col("e2")]) + 1)
    of = [*by, "tercile"]
    out = _means(cells, of, {"now": "now_bp", "diff": "d"}, 2)
    return out.join(stats.nearest_rank(cells, of, "d", 0.95, "p95"), of).join(cells.groupBy(*of).agg(F.stddev_pop("d").alias("dispersion")), of)


def drift(found: DataFrame, keys: list[str], waits: tuple[int, ...], step_s: int, block_ms: int, stale_ms: int | None = None) -> DataFrame:
    """keys, order_side, wait, n, mean, t: where the mid is `wait` seconds after an order rested at the best price, in bp in its favour.

    A measurement of prices only: no fill is assumed.
    """
    rows = found.select(*keys, "at", "bid", "ask", "mid")
    out = later(cut(decisions(rows, keys, step_s)), rows, keys, {f"mid_{w}": ("mid", 1000 * w) for w in waits}, block_ms, stale_ms)
    cells = [F.struct(F.lit(s).alias("order_side"), F.lit(w).alias("wait"), c.alias("d")) for w in waits for s, c in (("BUY", (F.col(f"mid_{w}") - F.col("bid")) / F.col("bid") * 1e4), ("SELL", (F.col("ask") - F.col(f"mid_{w}")) / F.col("ask") * 1e4))]
    long = out.select(*keys, "at", F.explode(F.array(*cells)).alias("c")).select(*keys, "at", "c.*")
    return stats.hac_mean(long, [*keys, "order_side", "wait"], "at", "d", 2)
