"""A second sampler on a stream of book events and trades, driven by processing time.

A symbol's book is read at each tick of the clock, whether or not something came since:
a timer of processing time is set for each next tick while the book is valid. A book of
which nothing came for stale_ms is invalidated at the tick that finds it, and a snapshot
is asked for, once, as it is after a gap, a crossed book or a lost connection. A tick is
given once, also where events come late or a batch catches up on several.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessorHandle

from tapeframe.operators.book import BANDS, FEATURES, FLOW_MS, TOPS, Book, fed, features
from tapeframe.operators.depth import SIDES, TAKER_BP, curve
from tapeframe.streaming.book import EVENT, BookProcessor

#: Rows of the stream: book events, and trades (kind "trade": t, px, qty, buy of the aggressor).
LIVE = EVENT + ", recv_ms long, t long, px double, qty double, buy boolean"

_DEPTH = ", ".join(f"{n}: double" for n in (*(f"top{k}" for k in TOPS), *(f"within{k}bp" for k in BANDS)))
_IMBALANCE = ", ".join(f"{n}: double" for n in (*(f"top{k}" for k in TOPS), "weighted"))
RECORD = (
    "struct<bid: double, ask: double, bid_qty: double, ask_qty: double, mid: double, spread: double, spread_bp: double, microprice: double, displacement_bp: double, bid_levels: int, ask_levels: int, "
    f"depth: struct<bid: struct<{_DEPTH}>, ask: struct<{_DEPTH}>>, imbalance: struct<{_IMBALANCE}>, slope: struct<bid: double, ask: double>, "
    "flow: map<string, struct<buy: double, sell: double, signed: double, trades: int, afi: double>>, "
    "interaction: struct<pressure_to_capacity: double, flow_over_opposite: double, flow_imbalance: double, flow_fragility: double>, "
    "exec: map<string, map<int, struct<vwap: double, slippage_bp: double, all_in_bp: double, complete: boolean, levels: int>>>>"
)
#: kind: "record" at a tick, "valid", "invalid" or "request" (of a snapshot) when the book changes.
OUTPUT = f"symbol string, at long, kind string, reason string, last_id long, record {RECORD}"

_NAMES = [c.split()[0] for c in FEATURES.split(", ")]


def flows(trades: list[tuple[int, float, bool]], at: int) -> dict[str, dict]:
    """Buying, selling, their difference and imbalance in the last 1, 5 and 30 s."""
    out = {}
    for w in FLOW_MS:
        inside = [(quote, buy) for t, quote, buy in trades if t >= at - w]
        bought, sold = (sum(q for q, b in inside if b == side) for side in (True, False))
        out[f"{w}ms"] = {"buy": float(bought), "sell": float(sold), "signed": float(bought - sold), "trades": len(inside), "afi": (bought - sold) / (bought + sold) if bought + sold > 0 else 0.0}
    return out


def order(levels: list[tuple[float, float]], mid: float, side: str, notional: float) -> dict:
    """What a market order costs on the levels it meets, best first."""
    price, qty = np.array(levels, float).T
    prices, values, bases = curve(price, qty, notional - 1e-9)
    if values[-1] < notional - 1e-6:
        return {"vwap": None, "slippage_bp": None, "all_in_bp": None, "complete": False, "levels": len(prices)}
    spent = min(notional, float(values[-1]))
    before = (float(values[-2]), float(bases[-2])) if len(values) > 1 else (0.0, 0.0)
    vwap = spent / (before[1] + (spent - before[0]) / float(prices[-1]))
    slip = (1 if side == "BUY" else -1) * (vwap - mid) / mid * 1e4
    return {"vwap": vwap, "slippage_bp": slip, "all_in_bp": slip + TAKER_BP, "complete": True, "levels": len(prices)}


def record(book: Book, trades: list[tuple[int, float, bool]], at: int, sizes: tuple[int, ...]) -> dict | None:
    """The nested record of a book at an instant; None with an empty side."""
    bids, asks = book.bids.levels(), book.asks.levels()
    for found in features(bids, asks):
        f = dict(zip(_NAMES, found, strict=True))
        flow = flows(trades, at)
        five, near = flow["5000ms"], {s: f[f"{s}_within2bp"] or f[f"{s}_top5"] for s in ("bid", "ask")}
        parts = [n.split(":")[0] for n in _DEPTH.split(", ")]
        return {
            **{k: f[k] for k in ("bid", "ask", "bid_qty", "ask_qty", "mid", "spread", "spread_bp", "microprice", "displacement_bp")},
            "bid_levels": len(bids),
            "ask_levels": len(asks),
            "depth": {s: {p: f[f"{s}_{p}"] for p in parts} for s in ("bid", "ask")},
            "imbalance": {n.split(":")[0]: f[f"imbalance_{n.split(':')[0]}"] for n in _IMBALANCE.split(", ")},
            "slope": {s: f[f"{s}_slope"] for s in ("bid", "ask")},
            "flow": flow,
            "interaction": {
                "pressure_to_capacity": five["buy"] / max(1.0, near["ask"]) - five["sell"] / max(1.0, near["bid"]) if near["ask"] > 0 or near["bid"] > 0 else 0.0,
                "flow_over_opposite": five["signed"] / max(1.0, near["ask" if five["signed"] >= 0 else "bid"]),
                "flow_imbalance": five["afi"] * f["imbalance_top5"],
                "flow_fragility": five["afi"] * f["spread_bp"] / max(1e-9, (near["bid"] + near["ask"]) / 1e6),
            },
            "exec": {s: {n: order(asks if s == "BUY" else bids, f["mid"], s, float(n)) for n in sizes} for s in SIDES},
        }
    return None


class Clock:
    """A book, its recent trades, and the ticks at which it is read.

    heard: when the last book event came; ticked: the last tick given; asked: a snapshot is on its way.
    """

    def __init__(self, book: Book, trades: list, every_ms: int, stale_ms: int, sizes: tuple[int, ...], heard: int | None = None, ticked: int | None = None, asked: bool = False):
        self.book, self.trades, self.every_ms, self.stale_ms, self.sizes = book, trades, every_ms, stale_ms, sizes
        self.heard, self.ticked, self.asked = heard, ticked, asked

    def _lost(self, at: int, reason: str) -> Iterator[tuple]:
        yield at, "invalid", reason, None, None
        if not self.asked:
            self.asked = True
            yield at, "request", reason, None, None

    def upto(self, now: int) -> Iterator[tuple]:
        """(at, kind, reason, last_id, record) of the ticks due by now."""
        while self.book.valid and self.heard is not None:
            at = (max(self.heard, self.ticked or 0) // self.every_ms + 1) * self.every_ms
            if at > now:
                return
            self.ticked = at
            self.trades = [x for x in self.trades if x[0] >= at - FLOW_MS[-1]]
            if at - self.heard > self.stale_ms:
                self.book.invalidate("stale")
                yield from self._lost(at, "stale")
            elif not self.book.uncrossed():
                yield from self._lost(at, "crossed")
            elif (found := record(self.book, self.trades, at, self.sizes)) is not None:
                yield at, "record", None, self.book.last_id, found

    def feed(self, row: dict) -> Iterator[tuple]:
        """What is due before the row, and what the row changes."""
        yield from self.upto(int(row["recv_ms"]) - 1)
        if row["kind"] == "trade":
            self.trades.append((int(row["t"]), float(row["px"] * row["qty"]), bool(row["buy"])))
            return
        before, reason = self.book.valid, self.book.reason
        fed(self.book, row["kind"], row)
        self.heard, self.asked = int(row["recv_ms"]), self.asked and row["kind"] != "snapshot"
        if self.book.valid and not before:
            yield self.heard, "valid", None, self.book.last_id, None
        elif not self.book.valid and (before or self.book.reason != reason and not self.book.awaiting):
            yield from self._lost(self.heard, self.book.reason)


class SecondSampler(BookProcessor):
    """OUTPUT of a symbol's LIVE rows. live: ticks come by timers too, else by the rows' times of receipt only."""

    def __init__(self, every_ms: int, stale_ms: int, sizes: tuple[int, ...], live: bool):
        super().__init__(0)
        self.every_ms, self.limit_ms, self.sizes, self.live = every_ms, stale_ms, sizes, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.clock = handle.getValueState("clock", "ticked long, asked boolean")
        self.recent = handle.getListState("recent", "t long, quote double, buy boolean")

    def _clock(self) -> Clock:
        self.before: dict = {}
        book, heard = self._load()
        ticked, asked = self.clock.get() if self.clock.exists() else (None, False)
        trades = [(int(t), float(q), bool(b)) for t, q, b in self.recent.get()] if self.recent.exists() else []
        return Clock(book, trades, self.every_ms, self.limit_ms, self.sizes, heard, ticked, bool(asked))

    def _done(self, key, clock: Clock, out: list, now: int | None) -> Iterator[pd.DataFrame]:
        self._save(clock.book, clock.heard, self.before)
        self.clock.update((clock.ticked, clock.asked))
        if clock.trades:
            self.recent.put(clock.trades)
        else:
            self.recent.clear()
        if now is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if clock.book.valid:
                self.handle.registerTimer((now // self.every_ms + 1) * self.every_ms)
        if out:
            frame = pd.DataFrame([(key[0], *x) for x in out], columns=["symbol", "at", "kind", "reason", "last_id", "record"])
            frame["last_id"] = frame["last_id"].astype("Int64")
            yield frame

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        clock, out = self._clock(), []
        for row in pd.concat(list(rows)).sort_values("arrival").to_dict("records"):
            out += clock.feed(row)
        now = timerValues.getCurrentProcessingTimeInMs() if self.live else None
        if now is not None:
            out += clock.upto(now)
        yield from self._done(key, clock, out, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        clock, now = self._clock(), timerValues.getCurrentProcessingTimeInMs()
        yield from self._done(key, clock, list(clock.upto(now)), now)


def sampled_seconds(events: DataFrame, every_ms: int = 1000, stale_ms: int = 5000, sizes: tuple[int, ...] = (10_000, 50_000), live: bool = True) -> DataFrame:
    """OUTPUT of a stream of LIVE rows. Needs the RocksDB state store; with live, a trigger shorter than every_ms."""
    return events.groupBy("symbol").transformWithStateInPandas(SecondSampler(every_ms, stale_ms, sizes, live), OUTPUT, "Append", "ProcessingTime" if live else "None")
