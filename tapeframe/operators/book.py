"""Order-book reconstruction, depth features and walking the book."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeframe.operators.blocks import paced
from tapeframe.sources.shared import cut

#: Frozen constants: bands in bp, top levels, flow windows in ms.
BANDS, TOPS, FLOW_MS = (1, 2, 5, 10), (1, 5, 10), (1000, 5000, 30000)
#: Buffered events of a book that waits for its snapshot; the oldest go first.
BUFFER = 20_000


# ---------------------------------------------------------------- books at a time


#: Updates and samples of a key that one task rebuilds at once.
CROWD = 50_000


def carried(updates: DataFrame, keys: list[str], blocks: DataFrame, block_ms: int) -> DataFrame:
    """keys, block, side, price, qty: the levels in force when each of the blocks (keys, block) begins.

    A level is carried from the block of its last update (by time, then by seq) to the next block
    that updates it, so the rows follow the levels in force, and no key's history is one task.
    """
    last = updates.groupBy(*keys, "side", "price", F.floor(F.col("t") / block_ms).alias("b")).agg(F.max_by("qty", F.struct("t", "seq")).alias("qty"))
    w = W.partitionBy(*keys, "side", "price").orderBy("b")
    ends = blocks.groupBy(*keys).agg(F.max("block").alias("__end"))
    spans = last.withColumn("until", F.lead("b").over(w)).filter("qty > 0").join(ends, keys)
    spans = spans.withColumn("until", F.least(F.coalesce("until", "__end"), "__end")).filter("until > b")
    return spans.select(*keys, F.explode(F.sequence(F.col("b") + 1, F.col("until"))).alias("block"), "side", "price", "qty").join(blocks, [*keys, "block"])


def settled(updates: DataFrame, keys: list[str], every_ms: int) -> DataFrame:
    """keys, t, seq, side, price, qty: of a level's updates between two multiples of every_ms only the last, at the later one."""
    at = (F.ceil(F.col("t") / every_ms) * every_ms).cast("long")
    last = F.max_by(F.struct("seq", "qty"), F.struct("t", "seq"))
    return updates.groupBy(*keys, at.alias("__at"), "side", "price").agg(last.alias("__r")).select(*keys, F.col("__at").alias("t"), "__r.seq", "side", "price", "__r.qty")


def sampled(updates: DataFrame, keys: list[str], samples: DataFrame, measure: Callable, schema: str, block_ms: int = 3_600_000, every_ms: int = 1) -> DataFrame:
    """keys, at and `schema`: what measure(bids, asks) says of the book at each sample time (keys, at).

    updates: keys, t, seq, side, price, qty (0 removes); those at the sample time are in force.
    every_ms: what all sample times are multiples of. Updates that no sample tells apart are
    dropped first. Time is cut into blocks, busy ones finer, each with the levels carried into
    it; a block's books are rebuilt in one task from its own updates, so its memory is bounded
    by levels and by about CROWD updates and samples.
    measure gets bid prices and sizes and ask prices and sizes, best first, as arrays, and
    returns a list of tuples.
    """
    from pyspark.sql import types as T

    updates = cut(settled(updates, keys, every_ms))
    asked = samples.select(*keys, F.col("at").alias("t"))
    block_ms = max(paced(updates.select(*keys, "t").unionByName(asked), keys, "t", block_ms, CROWD), every_ms)
    asked = asked.withColumn("block", F.floor(F.col("t") / block_ms))
    blocks = asked.select(*keys, "block").distinct()
    shown = [*keys, "block", "t", (F.col("side") == "ask").alias("is_ask"), "price", "qty"]
    blank = {"is_ask": F.lit(None).cast("boolean"), "price": F.lit(None).cast("double"), "qty": F.lit(None).cast("double")}
    rows = updates.withColumn("block", F.floor(F.col("t") / block_ms)).select(*shown, F.lit(1).alias("kind")).join(blocks, [*keys, "block"], "left_semi")
    rows = rows.unionByName(carried(updates, keys, blocks, block_ms).withColumn("t", F.col("block") * block_ms).select(*shown, F.lit(0).alias("kind")))
    rows = rows.unionByName(asked.withColumns(blank | {"kind": F.lit(2)}))
    key_fields = [f for f in updates.select(*keys).schema.fields]
    out_schema = T.StructType([*key_fields, T.StructField("at", T.LongType()), *T._parse_datatype_string(schema).fields])
    names = out_schema.names

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["kind", "t"])
        events, times = pdf[pdf["kind"] < 2], pdf.loc[pdf["kind"] == 2, "t"].to_numpy(np.int64)
        t = np.where(events["kind"] == 0, np.iinfo(np.int64).min, events["t"].to_numpy(np.int64))
        price, qty, is_ask = events["price"].to_numpy(float), events["qty"].to_numpy(float), events["is_ask"].to_numpy(bool)
        # each side's prices of the block, best first, and the size at each of them
        ladder = [np.unique(-price[~is_ask]), np.unique(price[is_ask])]
        place = np.where(is_ask, np.searchsorted(ladder[1], price), np.searchsorted(ladder[0], -price))
        ladder[0], sizes = -ladder[0], [np.zeros(len(x)) for x in ladder]
        out, start = [], 0
        for at, stop in zip(times.tolist(), np.searchsorted(t, times, side="right").tolist(), strict=True):
            for side, own in ((0, ~is_ask[start:stop]), (1, is_ask[start:stop])):
                sizes[side][place[start:stop][own]] = qty[start:stop][own]  # of several for a price the last stays
            start = stop
            held = [np.flatnonzero(s > 0) for s in sizes]
            out += [(*key[:-1], at, *found) for found in measure(ladder[0][held[0]], sizes[0][held[0]], ladder[1][held[1]], sizes[1][held[1]])]
        return pd.DataFrame(out, columns=names)

    return rows.groupBy(*keys, "block").applyInPandas(run, out_schema)


class Ladder:
    """One side of a book: quantities by price, with the prices in order from the best."""

    def __init__(self, side: str) -> None:
        self.sign = -1 if side == "bid" else 1
        self.qty: dict[float, float] = {}
        self.order: list[float] = []  # signed prices, ascending

    def set(self, price: float, qty: float) -> bool:
        """Whether the level was there or is now."""
        known = price in self.qty
        if qty > 0:
            if not known:
                insort(self.order, self.sign * price)
            self.qty[price] = qty
            return True
        if known:
            del self.qty[price]
            del self.order[bisect_left(self.order, self.sign * price)]
        return known

    def best(self) -> float | None:
        return self.sign * self.order[0] if self.order else None

    def levels(self) -> list[tuple[float, float]]:
        return [(self.sign * p, self.qty[self.sign * p]) for p in self.order]

    def __len__(self) -> int:
        return len(self.order)


#: What features() returns for a book with both sides.
FEATURES = ", ".join(
    f"{c} double"
    for c in (
        *("bid", "ask", "mid", "bid_qty", "ask_qty", "spread", "spread_bp", "microprice", "displacement_bp"),
        *(f"{side}_{part}" for side in ("bid", "ask") for part in (*(f"top{k}" for k in TOPS), *(f"within{k}bp" for k in BANDS), "weighted", "slope")),
        *(f"imbalance_{k}" for k in (*(f"top{k}" for k in TOPS), "weighted")),
    )
)


_NAMES = [c.split()[0] for c in FEATURES.split(", ")]


def measured(bid_price: np.ndarray, bid_qty: np.ndarray, ask_price: np.ndarray, ask_qty: np.ndarray) -> list[tuple]:
    """FEATURES of one book, best levels first; nothing for a book with an empty side."""
    if not len(bid_price) or not len(ask_price):
        return []
    bid, ask = float(bid_price[0]), float(ask_price[0])
    mid = (bid + ask) / 2
    near_bid = max(TOPS[-1], int(np.searchsorted(-bid_price, -mid * (1 - 0.0051))))  # what no measure reaches is left out
    near_ask = max(TOPS[-1], int(np.searchsorted(ask_price, mid * (1 + 0.0051))))
    micro = (bid * ask_qty[0] + ask * bid_qty[0]) / (bid_qty[0] + ask_qty[0])
    out: dict[str, float] = {"bid": bid, "ask": ask, "mid": mid, "bid_qty": bid_qty[0], "ask_qty": ask_qty[0], "spread": ask - bid, "spread_bp": (ask - bid) / mid * 1e4, "microprice": micro, "displacement_bp": (micro - mid) / mid * 1e4}
    for side, price, qty in (("bid", bid_price[:near_bid], bid_qty[:near_bid]), ("ask", ask_price[:near_ask], ask_qty[:near_ask])):
        value, away = price * qty, np.abs(price - mid) / mid * 1e4
        out |= {f"{side}_top{k}": value[:k].sum() for k in TOPS} | {f"{side}_within{k}bp": value[away <= k].sum() for k in BANDS}
        out[f"{side}_weighted"] = (value / (1 + away))[away <= 50].sum()
        out[f"{side}_slope"] = out[f"{side}_within{BANDS[-1]}bp"] / BANDS[-1]
    for k in (*(f"top{k}" for k in TOPS), "weighted"):
        both = out[f"bid_{k}"] + out[f"ask_{k}"]
        out[f"imbalance_{k}"] = (out[f"bid_{k}"] - out[f"ask_{k}"]) / both if both > 0 else 0.0
    return [tuple(float(out[c]) for c in _NAMES)]


def features(bids: list[tuple[float, float]], asks: list[tuple[float, float]]) -> list[tuple]:
    """FEATURES of one book given as lists of (price, qty), best first."""
    sides = [np.array(x, float).reshape(-1, 2).T for x in (bids, asks)]
    return measured(*sides[0], *sides[1])


def depth_features(levels: DataFrame, keys: list[str]) -> DataFrame:
    """One row per book with a bid and an ask: prices, top and band notionals, imbalances, slopes."""
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    best = levels.groupBy(*keys).agg(
        F.max(F.when(bid, F.col("price"))).alias("bid"),
        F.min(F.when(ask, F.col("price"))).alias("ask"),
    ).filter("bid is not null and ask is not null").withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    rows = levels.join(best, keys)
    away = F.when(bid, -F.col("price")).otherwise(F.col("price"))
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy(*keys, "side").orderBy(away))).withColumn("bp", F.abs(F.col("price") - F.col("mid")) / F.col("mid") * 1e4)
    notional = F.col("price") * F.col("qty")
    total = lambda when: F.coalesce(F.sum(F.when(when, notional)), F.lit(0.0))
    near = F.when(F.col("bp") <= 50, notional / (1 + F.col("bp")))
    aggregates = [F.max(F.when(bid & (F.col("n") == 1), F.col("qty"))).alias("bid_qty"), F.max(F.when(ask & (F.col("n") == 1), F.col("qty"))).alias("ask_qty")]
    for name, side in (("bid", bid), ("ask", ask)):
        aggregates += [total(side & (F.col("n") <= k)).alias(f"{name}_top{k}") for k in TOPS]
        aggregates += [total(side & (F.col("bp") <= k)).alias(f"{name}_within{k}bp") for k in BANDS]
        aggregates += [F.count(F.when(side, 1)).alias(f"{name}_levels"), F.coalesce(F.sum(F.when(side, near)), F.lit(0.0)).alias(f"{name}_weighted")]
    out = rows.groupBy(*keys, "bid", "ask", "mid").agg(*aggregates)
    out = out.withColumn("spread", F.col("ask") - F.col("bid")).withColumn("spread_bp", F.col("spread") / F.col("mid") * 1e4)
    out = out.withColumn("microprice", (F.col("bid") * F.col("ask_qty") + F.col("ask") * F.col("bid_qty")) / (F.col("bid_qty") + F.col("ask_qty")))
    out = out.withColumn("displacement_bp", (F.col("microprice") - F.col("mid")) / F.col("mid") * 1e4)
    for k in [*(f"top{k}" for k in TOPS), "weighted"]:
        out = out.withColumn(f"imbalance_{k}", imbalance(F.col(f"bid_{k}"), F.col(f"ask_{k}")))
    return out.withColumn("bid_slope", F.col("bid_within10bp") / 10).withColumn("ask_slope", F.col("ask_within10bp") / 10)


def imbalance(bid: Column, ask: Column) -> Column:
    return F.when(bid + ask > 0, (bid - ask) / (bid + ask)).otherwise(F.lit(0.0))


def interactions(features: DataFrame, buy: str, sell: str, afi: str) -> DataFrame:
    """The four flow-depth interactions of buy and sell notional and their imbalance.

    Near depth is that within 2 bp, or of the top five levels where there is none.
    """
    near = lambda side: F.when(F.col(f"{side}_within2bp") > 0, F.col(f"{side}_within2bp")).otherwise(F.col(f"{side}_top5"))
    at_least = lambda side: F.greatest(near(side), F.lit(1.0))
    signed = F.col(buy) - F.col(sell)
    some = (near("ask") > 0) | (near("bid") > 0)
    return (
        features.withColumn("pressure_to_capacity", F.when(some, F.col(buy) / at_least("ask") - F.col(sell) / at_least("bid")).otherwise(0.0))
        .withColumn("flow_over_opposite", F.when(signed >= 0, signed / at_least("ask")).otherwise(signed / at_least("bid")))
        .withColumn("flow_imbalance", F.col(afi) * F.col("imbalance_top5"))
        .withColumn("flow_fragility", F.col(afi) * (F.col("spread_bp") / F.greatest((near("bid") + near("ask")) / 1e6, F.lit(1e-9))))
    )


def liquidity(spread_bp: Column, near: Column) -> Column:
    """The state of a book by its spread and the notional within 5 bp of its mid; later rules override earlier ones."""
    return (
        F.when((spread_bp <= 1) & (near > 2_000_000), "DEEP")
        .when((spread_bp > 8) | (near < 75_000), "VERY THIN")
        .when((spread_bp > 3) | (near < 250_000), "THIN")
        .otherwise("NORMAL")
    )


def pressure(value: Column) -> Column:
    """What rests in the book by the imbalance of the top five levels: context, not a direction."""
    return F.when(value > 0.15, "MORE RESTING BIDS").when(value < -0.15, "MORE RESTING ASKS").otherwise("BALANCED")


def walk(levels: DataFrame, keys: list[str], orders: DataFrame) -> DataFrame:
    """A row per order (keys, order_side, notional): what it costs as a market order against the levels.

    A BUY takes asks upwards, a SELL bids downwards. ok is false, with a reason and no figures,
    where the book has an empty side or the notional is not positive. An order that the side
    can't fill is incomplete: it has the average and the worst price so far, but no costs.
    consumed_pct is the percentage of the side's notional that is taken.
    """
    side_of = F.when(F.col("order_side") == "BUY", "ask").otherwise("bid")
    value = F.col("price") * F.col("qty")
    best = levels.groupBy(*keys).agg(F.max(F.when(F.col("side") == "bid", F.col("price"))).alias("bid"), F.min(F.when(F.col("side") == "ask", F.col("price"))).alias("ask"))
    best_price = F.when(F.col("order_side") == "BUY", F.col("ask")).otherwise(F.col("bid"))
    w = W.partitionBy(*keys, "order_side", "notional").orderBy(F.when(F.col("side") == "ask", F.col("price")).otherwise(-F.col("price"))).rowsBetween(W.unboundedPreceding, -1)
    rows = orders.filter("notional > 0").withColumn("side", side_of).join(levels, [*keys, "side"])
    left = F.col("notional") - F.coalesce(F.sum(value).over(w), F.lit(0.0))
    rows = rows.withColumn("take", F.when(left > 1e-9, F.least(value, left)).otherwise(0.0))
    used = F.col("take") > 0
    taken = rows.groupBy(*keys, "order_side", "notional").agg(
        F.sum("take").alias("filled"), F.sum(F.col("take") / F.col("price")).alias("base"), F.count(F.when(used, 1)).alias("levels_used"), F.sum(value).alias("side_notional"),
        F.max(F.when(used & (F.col("side") == "ask"), F.col("price"))).alias("worst_ask"), F.min(F.when(used & (F.col("side") == "bid"), F.col("price"))).alias("worst_bid"),
    )
    out = orders.join(best, keys, "left").join(taken, [*keys, "order_side", "notional"], "left")
    empty = F.col("bid").isNull() | F.col("ask").isNull()
    reason = F.when(empty, "book empty").when(~F.coalesce(F.col("notional") > 0, F.lit(False)), "notional must be positive")
    out = out.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())
    ok = lambda c: F.when(F.col("ok"), c)
    out = out.withColumn("mid", ok((F.col("bid") + F.col("ask")) / 2)).withColumn("best", ok(best_price)).withColumn("unfilled", ok(F.col("notional") - F.col("filled")))
    out = out.withColumn("complete", F.coalesce(F.col("unfilled") <= 1e-6, F.lit(False))).withColumn("vwap", ok(F.col("filled") / F.col("base")))
    done = lambda c: F.when(F.col("complete"), c)
    sign = F.when(F.col("order_side") == "BUY", 1.0).otherwise(-1.0)
    out = out.withColumn("worst", ok(F.coalesce("worst_ask", "worst_bid", "best"))).withColumn("half_spread_bp", ok((F.col("ask") - F.col("bid")) / 2 / F.col("mid") * 1e4))
    out = out.withColumn("slippage_bp", done(sign * (F.col("vwap") - F.col("mid")) / F.col("mid") * 1e4)).withColumn("impact_bp", F.col("slippage_bp") - F.col("half_spread_bp"))
    out = out.withColumn("consumed_pct", ok(F.when(F.col("side_notional") > 0, F.col("filled") / F.col("side_notional") * 100).otherwise(0.0)))
    return out.drop("worst_ask", "worst_bid", "base")


#: Fee profiles, round trip in bp; M is for makers and decides nothing.
PROFILES = {"A": 10.0, "B": 14.0, "C": 20.0, "M": 4.0}


def with_fees(walked: DataFrame, taker_bp: float = 5.0) -> DataFrame:
    """all_in_bp and all_in_usd of one order, round_trip_bp of opening and closing it, and each profile's cost, where complete."""
    out = walked.withColumn("all_in_bp", F.col("slippage_bp") + taker_bp).withColumn("all_in_usd", F.col("all_in_bp") / 1e4 * F.col("notional")).withColumn("round_trip_bp", 2 * F.col("all_in_bp"))
    for name, fee in PROFILES.items():
        out = out.withColumn(f"cost_{name}", F.when(F.col("complete"), F.lit(fee) + (2 * F.col("slippage_bp") if name == "A" else F.lit(0.0))))
    return out


def cost_band(bp: Column) -> Column:
    return F.when(bp.isNull(), "UNKNOWN").when(bp <= 6, "LOW").when(bp <= 12, "NORMAL").otherwise("HIGH")


def verdict(ok: Column, complete: Column, all_in_bp: Column, limit_bp: Column) -> Column:
    """The order against the user's own limit; without one there is no grade."""
    return F.when(~ok, "UNKNOWN").when(~complete, "POOR").when(limit_bp.isNull(), "NOT GRADED").when(all_in_bp <= limit_bp, "GOOD").otherwise("POOR")


def audit(levels: DataFrame, keys: list[str]) -> DataFrame:
    """keys and whether the book is strict (by distinct prices), uncrossed and of positive sizes.

    levels: keys, side, price, qty, of each book in no order. A price twice on a side breaks strictness.
    """
    on = lambda name: F.col("side") == name
    per_price = levels.groupBy(*keys, "side", "price").agg(F.count("*").alias("n"), F.min("qty").alias("least"))
    rows = per_price.groupBy(*keys).agg(
        (F.max("n") == 1).alias("strict"),
        (~F.coalesce(F.max(F.when(on("bid"), F.col("price"))) >= F.min(F.when(on("ask"), F.col("price"))), F.lit(False))).alias("uncrossed"),
        F.coalesce(F.min("least") > 0, F.lit(False)).alias("positive"),
        F.count(F.when(on("bid"), 1)).alias("bid_levels"),
        F.count(F.when(on("ask"), 1)).alias("ask_levels"),
    )
    return rows.withColumn("ok", F.col("strict") & F.col("uncrossed") & F.col("positive"))


def pruned(levels: DataFrame, keys: list[str], share: float = 0.02) -> DataFrame:
    """Bids not further than `share` below the mid, asks not further above; a one-sided book stays as it is."""
    mid = levels.groupBy(*keys).agg(((F.max(F.when(F.col("side") == "bid", F.col("price"))) + F.min(F.when(F.col("side") == "ask", F.col("price")))) / 2).alias("__mid"))
    far = F.when(F.col("side") == "bid", F.col("price") < F.col("__mid") * (1 - share)).otherwise(F.col("price") > F.col("__mid") * (1 + share))
    return levels.join(mid, keys).filter(~F.coalesce(far, F.lit(False))).drop("__mid")


# ---------------------------------------------------------------- the sequence machine


@dataclass
class Book:
    """One book: levels, sequence id, validity, reason, counters, buffered events.

    awaiting: a snapshot is in place and the first event that covers its id makes the book valid.
    """

    bids: Ladder = field(default_factory=lambda: Ladder("bid"))
    asks: Ladder = field(default_factory=lambda: Ladder("ask"))
    last_id: int | None = None
    valid: bool = False
    awaiting: bool = False
    reason: str = "no snapshot"
    applied: int = 0
    dropped: int = 0
    gaps: int = 0
    crossed: int = 0
    resyncs: int = 0
    unknown_removals: int = 0
    regressions: int = 0
    opening: bool = False
    last_ms: int | None = None
    pending: list = field(default_factory=list)

    def invalidate(self, reason: str) -> None:
        """Forgets the sequence id, not the levels; only a valid book counts as resynchronised."""
        self.resyncs += self.valid
        self.valid = self.awaiting = False
        self.reason, self.last_id = reason, None

    def _set(self, levels) -> None:
        for side, price, qty in levels:
            if not (self.bids if side == "bid" else self.asks).set(price, qty):
                self.unknown_removals += 1

    def _take(self, event) -> None:
        self.valid, self.awaiting, self.reason = True, False, ""
        self._set(event["levels"])
        self.last_id = event["last_id"]
        self.applied += 1

    def _covers(self, event) -> bool:
        return event["first_id"] <= self.last_id <= event["last_id"]

    def snapshot(self, last_id: int, levels) -> None:
        """Replaces the levels and replays what was buffered and is not older."""
        self.bids, self.asks = Ladder("bid"), Ladder("ask")
        self._set([x for x in levels if x[2] > 0])
        later = [e for e in self.pending if e["last_id"] >= last_id]
        self.dropped += len(self.pending) - len(later)
        self.pending = []
        self.valid, self.awaiting, self.last_id, self.reason = False, True, last_id, "awaiting first event"
        if not later:
            return
        if not self._covers(later[0]):
            self.invalidate("first event does not cover the snapshot")
            return
        self._take(later[0])
        for event in later[1:]:
            self.update(event)
            if not self.valid:
                return

    def update(self, event) -> None:
        if self.valid:
            if event["last_id"] <= self.last_id:
                self.dropped += 1
                return
            if event["prev_id"] != self.last_id:
                self.gaps += 1
                self.invalidate("sequence gap")
                return
        elif self.awaiting:
            if event["last_id"] < self.last_id:
                self.dropped += 1
                return
            if not self._covers(event):
                self.invalidate("first event does not cover the snapshot")
                return
        else:
            self.pending.append(event)
            del self.pending[:-BUFFER]
            return
        self._take(event)
        self.uncrossed()

    def uncrossed(self) -> bool:
        """Whether the best bid is below the best ask; a crossed book is invalidated."""
        if len(self.bids) and len(self.asks) and self.bids.best() >= self.asks.best():
            self.crossed += 1
            self.invalidate("crossed")
            return False
        return True

    def vendor(self, ts: int, is_snapshot: bool, levels) -> None:
        """An event of a feed without sequence ids: rows of a snapshot, then deltas.

        The first delta after a snapshot makes the book valid; deltas before any are dropped.
        Time going back is counted. Crossing is asked for by uncrossed(), where the book is read.
        """
        if is_snapshot:
            if not self.opening:
                self.bids, self.asks, self.opening = Ladder("bid"), Ladder("ask"), True
            self._set(levels)
            self.last_ms = ts
            return
        if self.opening:
            self.opening, self.valid, self.reason = False, True, ""
        if not self.valid:
            self.dropped += 1
            return
        self.regressions += self.last_ms is not None and ts < self.last_ms
        self._set(levels)
        self.last_ms = ts
        self.applied += 1

    def prune(self, share: float = 0.02) -> int:
        """Drops levels further than `share` from the mid; how many."""
        bid, ask = self.bids.best(), self.asks.best()
        if bid is None or ask is None:
            return 0
        mid = (bid + ask) / 2
        far = [(self.bids, p) for p in self.bids.qty if p < mid * (1 - share)] + [(self.asks, p) for p in self.asks.qty if p > mid * (1 + share)]
        for side, price in far:
            side.set(price, 0)
        return len(far)

    def row(self) -> dict:
        return {
            "valid": self.valid, "reason": self.reason, "last_id": self.last_id, "bid": self.bids.best(), "ask": self.asks.best(), "bid_levels": len(self.bids), "ask_levels": len(self.asks),
            "applied": self.applied, "dropped": self.dropped, "gaps": self.gaps, "crossed": self.crossed, "resyncs": self.resyncs, "unknown_removals": self.unknown_removals,
        }


BOOK_ROW = "valid boolean, reason string, last_id long, bid double, ask double, bid_levels int, ask_levels int, applied long, dropped long, gaps long, crossed long, resyncs long, unknown_removals long"


def fed(book: Book, kind: str, row) -> None:
    """Feeds one row of the event stream to the book."""
    levels = [(x["side"], x["price"], x["qty"]) for x in row["levels"]]
    if kind == "snapshot":
        book.snapshot(row["last_id"], levels)
    elif kind == "update":
        book.update({"first_id": row["first_id"], "last_id": row["last_id"], "prev_id": row["prev_id"], "levels": levels})
    else:
        book.invalidate(kind)


#: Events of a symbol that a chunk of replay() has about.
CHUNK = 100_000
#: Counters of a book: they only add up.
COUNTERS = ("applied", "dropped", "gaps", "crossed", "resyncs", "unknown_removals")


def chunked(events: DataFrame, rows: int = CHUNK) -> DataFrame:
    """events with chunk, the arrival of the snapshot that the chunk begins with; null before the first such one.

    A snapshot ends what came before it: only buffered events that are not older are replayed
    on it. Where no update since the snapshot before reaches its id, the book after it follows
    from what comes later alone. The first such snapshot in each block of arrivals begins a
    chunk; where a block has none, the chunk goes on.
    """
    span = events.agg((F.max("arrival") - F.min("arrival") + 1).alias("span")).first().span or 1
    block = paced(events, ["symbol"], "arrival", span, rows)
    ids = events.select("symbol", "arrival", "kind", "last_id", F.floor(F.col("arrival") / block).alias("__block"))
    is_snapshot = F.col("kind") == "snapshot"
    inside = W.partitionBy("symbol", "__block").orderBy("arrival")
    ids = ids.withColumn("__n", F.count(F.when(is_snapshot, 1)).over(inside.rowsBetween(W.unboundedPreceding, -1)))  # snapshots before the row, in its block
    since = W.partitionBy("symbol", "__block", "__n").orderBy("arrival").rowsBetween(W.unboundedPreceding, -1)
    reached = F.max(F.when(F.col("kind") == "update", F.col("last_id"))).over(since)
    clean = is_snapshot & (F.col("__n") > 0) & F.coalesce(reached < F.col("last_id"), reached.isNull())
    blocks = ids.withColumn("__clean", clean).groupBy("symbol", "__block").agg(F.min(F.when(F.col("__clean"), F.col("arrival"))).alias("__cut"))
    before = F.last("__cut", ignorenulls=True).over(W.partitionBy("symbol").orderBy("__block").rowsBetween(W.unboundedPreceding, -1))  # a row a block
    rows_of = events.withColumn("__block", F.floor(F.col("arrival") / block)).join(blocks.withColumn("__before", before), ["symbol", "__block"])
    return rows_of.withColumn("chunk", F.when(F.col("arrival") >= F.col("__cut"), F.col("__cut")).otherwise(F.col("__before"))).drop("__block", "__cut", "__before")


def replay(events: DataFrame, rows: int = CHUNK) -> DataFrame:
    """The book after each event: symbol, arrival, and BOOK_ROW.

    events: symbol, arrival (order), kind ("snapshot", "update", or a reason to invalidate),
    first_id, last_id, prev_id, levels (array of side, price, qty). Chunks of about `rows`
    events are read batch by batch, each with its book as the only state, and the counters of
    the chunks before are added. A symbol without a snapshot that ends a chunk is one stream.
    """
    from pyspark.sql import types as T

    schema = T._parse_datatype_string("symbol string, chunk long, arrival long, waiting long, " + BOOK_ROW)
    names = schema.names

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, book = None, Book()
        for pdf in frames:
            out = []
            for row in pdf.to_dict("records"):
                own = (row["symbol"], row["chunk"] if row["chunk"] == row["chunk"] else None)
                if own != at:
                    at, book = own, Book()
                fed(book, row["kind"], row)
                out.append({"symbol": at[0], "chunk": at[1], "arrival": row["arrival"], "waiting": len(book.pending)} | book.row())
            frame = pd.DataFrame(out, columns=names)
            for c in ("last_id", "chunk"):
                frame[c] = frame[c].astype("Int64")
            yield frame

    own = ["symbol", "chunk"]
    parts = -(-events.count() // rows) or 1  # a number that adaptive execution keeps: small rows are much work
    found = cut(chunked(events, rows).repartition(parts, *own).sortWithinPartitions(*own, "arrival").mapInPandas(run, schema))
    # what a chunk leaves in the buffer is older than the next one's snapshot, which drops it
    ends = found.groupBy(*own).agg(*[F.max(c).alias(c) for c in COUNTERS], F.max_by("waiting", "arrival").alias("waiting"))
    ends = ends.withColumn("dropped", F.col("dropped") + F.col("waiting"))
    upto = W.partitionBy("symbol").orderBy(F.col("chunk").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)  # a row a chunk
    sums = ends.select(F.col("symbol").alias("__symbol"), F.col("chunk").alias("__chunk"), *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"__{c}") for c in COUNTERS])
    whole = found.join(F.broadcast(sums), (F.col("symbol") == F.col("__symbol")) & F.col("chunk").eqNullSafe(F.col("__chunk")))
    shown = [c.split()[0] for c in BOOK_ROW.split(", ")]
    return whole.select("symbol", "arrival", *[(F.col(c) + F.col(f"__{c}")).alias(c) if c in COUNTERS else F.col(c) for c in shown])


class Sampler:
    """A book and the clock that reads it: a record for each `every_ms` of receipt time while the book is valid.

    A book of which nothing came for stale_ms is invalidated at the next tick, and no record is
    given until a snapshot and a covering event have made it valid again.
    """

    def __init__(self, book: Book, every_ms: int, stale_ms: int, last_ms: int | None = None) -> None:
        self.book, self.every_ms, self.stale_ms, self.last_ms = book, every_ms, stale_ms, last_ms

    def ticks(self, now: int) -> Iterator[tuple]:
        """(at, *FEATURES) of the ticks after the last event and not after now."""
        if self.last_ms is None:
            return
        at = (self.last_ms // self.every_ms + 1) * self.every_ms
        while at <= now and self.book.valid:
            if at - self.last_ms > self.stale_ms:
                self.book.invalidate("stale")
                return
            if self.book.uncrossed():
                for found in features(self.book.bids.levels(), self.book.asks.levels()):
                    yield (at, *found)
            at += self.every_ms

    def feed(self, row: dict) -> Iterator[tuple]:
        """Records due before the event (kind, recv_ms, ..), which is then taken."""
        yield from self.ticks(row["recv_ms"] - 1)
        fed(self.book, row["kind"], row)
        self.last_ms = row["recv_ms"]


def second_features(events: DataFrame, every_ms: int = 1000, stale_ms: int = 5000) -> DataFrame:
    """symbol, at and FEATURES at each second while a symbol's book is valid and fresh.

    events: as for replay(), with recv_ms, the time of receipt.
    """
    schema = f"symbol string, at long, {FEATURES}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, sampler = None, Sampler(Book(), every_ms, stale_ms)
        for pdf in frames:
            out = []
            for row in pdf.to_dict("records"):
                if row["symbol"] != symbol:
                    symbol, sampler = row["symbol"], Sampler(Book(), every_ms, stale_ms)
                out += [(symbol, *found) for found in sampler.feed(row)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return events.repartition("symbol").sortWithinPartitions("symbol", "arrival").mapInPandas(run, schema)


def sequence_epochs(updates: DataFrame, keys: list[str], block: int = 1_000_000) -> DataFrame:
    """Continuity of update ids: duplicates dropped, then runs between gaps, one row per run.

    Ids are cut into blocks; the last id and the number of gaps of those before are carried into each.
    """
    distinct = updates.groupBy(*keys, "last_id").agg(F.min("prev_id").alias("prev_id"), F.count("*").alias("copies")).withColumn("b", F.floor(F.col("last_id") / block))
    over = W.partitionBy(*keys).orderBy("b")
    ends = distinct.groupBy(*keys, "b").agg(F.max("last_id").alias("end")).select(*keys, "b", F.lag("end").over(over).alias("end_before"))
    inside = W.partitionBy(*keys, "b").orderBy("last_id")
    marked = distinct.join(ends, [*keys, "b"]).withColumn("gap", F.coalesce(F.col("prev_id") != F.coalesce(F.lag("last_id").over(inside), "end_before"), F.lit(False)).cast("long"))
    gaps = marked.groupBy(*keys, "b").agg(F.sum("gap").alias("n")).select(*keys, "b", F.coalesce(F.sum("n").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("gaps_before"))
    marked = marked.join(gaps, [*keys, "b"]).withColumn("epoch", F.col("gaps_before") + F.sum("gap").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "epoch").agg(F.min("last_id").alias("first_id"), F.max("last_id").alias("last_id"), F.count("*").alias("n"), F.sum(F.col("copies") - 1).alias("n_duplicates"))
