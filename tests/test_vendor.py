"""Books of a feed without ids against a plain replay of all its events."""

import random

import pytest
from pyspark.sql import functions as F

from tapeframe.operators import book, vendor


def feed(seed, n=400):
    """Events of two symbols: deltas before any snapshot, snapshots of several rows, times that go back, a crossed book."""
    r = random.Random(seed)
    out = []
    for symbol in ("A", "B"):
        ts, held = 0, {}
        for k in range(n):
            ts += r.choice([0, 100, 300, 700]) if r.random() > 0.03 else -200
            arrival = k * 10
            if k == 30 or (k > 30 and r.random() < 0.03):
                for j, (side, price) in enumerate((s, p) for s in ("bid", "ask") for p in ((99.0, 98.5) if s == "bid" else (101.0, 101.5))):
                    out.append((symbol, arrival + j % 2, ts, True, side, price, float(r.randint(1, 5))))  # a snapshot of two events
                continue
            crossing = symbol == "A" and k == 200
            told = set()  # an event names a price once
            for _ in range(r.randint(1, 3)):
                side = "bid" if crossing else r.choice(["bid", "ask"])
                price = 101.5 if crossing else (99.0 - r.randint(0, 40) / 10 if side == "bid" else 101.0 + r.randint(0, 40) / 10)
                if (side, price) not in told:
                    told.add((side, price))
                    out.append((symbol, arrival, ts, False, side, price, float(r.choice([0, 1, 3]))))
    return out


def replayed(rows, samples, share):
    """Per symbol: (at, bid, ask, levels within share) at each valid, uncrossed sample; and the counters."""
    found, counts = [], {}
    for symbol in sorted({x[0] for x in rows}):
        events = {}
        for _, arrival, ts, snap, side, price, qty in (x for x in rows if x[0] == symbol):
            events.setdefault(arrival, (ts, snap, []))[2].append((side, price, qty))
        held, state, last, opening, valid, clock = {}, [], None, False, False, None
        count = dict(snapshots=0, applied=0, dropped=0, regressions=0)
        seen = False
        for arrival in sorted(events):
            ts, snap, levels = events[arrival]
            if snap:
                if not opening:
                    held, opening, valid, seen, clock = {}, True, False, True, None
            else:
                if opening:
                    opening, valid = False, True
                    count["snapshots"] += 1
                if not seen:
                    count["dropped"] += 1
                    continue
                count["regressions"] += last is not None and ts < last
                count["applied"] += 1
            last = ts
            clock = ts if clock is None else max(clock, ts)
            for side, price, qty in levels:
                held.pop((side, price), None)
                if qty > 0:
                    held[side, price] = qty
            state.append((clock, arrival, valid, dict(held)))
        counts[symbol] = count
        segment_bad = None
        for at in samples:
            before = [s for s in state if s[0] <= at]
            if not before:
                continue
            # the last of the largest time, as the feed is read in order of time
            clock, arrival, valid, held = max(before, key=lambda s: (s[0], s[1]))
            if not valid:
                continue
            bids, asks = ([p for (s, p) in held if s == side] for side in ("bid", "ask"))
            start = max(a for a in events if events[a][1] and a <= arrival)
            if not bids or not asks or segment_bad == (symbol, start // 10):
                continue
            if max(bids) >= min(asks):
                segment_bad = (symbol, start // 10)
                continue
            mid = (max(bids) + min(asks)) / 2
            near = sum(q * p for (s, p), q in held.items() if (p >= mid * (1 - share) if s == "bid" else p <= mid * (1 + share)))
            found.append((symbol, at, max(bids), min(asks), round(near, 6)))
    return found, counts


def near_value(bp, bq, ap, aq):
    return [(float(bp[0]), float(ap[0]), float((bp * bq).sum() + (ap * aq).sum()))]


@pytest.mark.parametrize(("seed", "block", "run", "block_ms"), [(1, 10**6, 50_000, 10**9), (2, 70, 7, 5000)])
def test_vendor_books_equal_a_plain_replay(spark, monkeypatch, seed, block, run, block_ms):
    monkeypatch.setattr(vendor.stats, "RUN", run)
    monkeypatch.setattr(vendor.stats.in_runs, "__defaults__", (run,))
    rows = feed(seed)
    df = spark.createDataFrame(rows, "symbol string, arrival long, ts long, is_snapshot boolean, side string, price double, qty double").repartition(4)
    events, levels = df.select("symbol", "arrival", "ts", "is_snapshot").distinct(), df.select("symbol", "arrival", "side", "price", "qty")
    times = list(range(0, max(x[2] for x in rows) + 2000, 1000))
    samples = spark.createDataFrame([(s, t) for s in ("A", "B") for t in times], "symbol string, at long")
    want, counts = replayed(rows, times, 0.02)
    found = vendor.seconds(events, levels, ["symbol"], samples, block, block_ms, 0.02, near_value, "bid double, ask double, value double").collect()
    assert sorted((r.symbol, r.at, r.bid, r.ask, round(r.value, 6)) for r in found) == sorted(want) and len(want) > 50
    got = {r.symbol: r.asDict() for r in vendor.counters(vendor.clocked(vendor.segments(events, ["symbol"], block), ["symbol"]), ["symbol"]).collect()}
    assert {s: {k: v for k, v in c.items() if k != "symbol"} for s, c in got.items()} == counts


def test_reconciliation_tells_differences_and_lone_seconds(spark):
    a = spark.createDataFrame([(k, float(k), 1.0) for k in range(1, 101)], "at long, x double, y double")
    b = spark.createDataFrame([(k, float(k) * (1.1 if k > 98 else 1.0), 1.0) for k in range(11, 121)], "at long, x double, y double")
    found = {r.column: r for r in vendor.reconciled(a, b, ["at"], ["x", "y"]).collect()}
    assert (found["x"].n, found["x"].n_equal, found["x"].only_a, found["x"].only_b) == (90, 88, 10, 20)
    assert found["x"].median == 0.0 and abs(found["x"].p99 - 1 / 11) < 1e-6 and found["y"].corr is None and 0.9 < found["x"].corr < 1


def test_sampling_needs_no_order_of_rows(spark):
    """Equal instants: the last sequence number of a price is in force; what comes at the sample's instant counts."""
    rows = [("S", 1, 100, "bid", 9.0, 1.0), ("S", 2, 100, "bid", 9.0, 0.0), ("S", 3, 100, "bid", 8.0, 2.0), ("S", 4, 200, "ask", 10.0, 1.0), ("S", 5, 200, "bid", 8.0, 5.0)]
    df = spark.createDataFrame(rows, "symbol string, seq long, t long, side string, price double, qty double").orderBy(F.rand(3))
    samples = spark.createDataFrame([("S", 100), ("S", 200)], "symbol string, at long")
    found = book.sampled(df, ["symbol"], samples, lambda bp, bq, ap, aq: [(len(bp), len(ap), float(bq.sum()))], "b int, a int, q double", 150).orderBy("at").collect()
    assert [(r.b, r.a, r.q) for r in found] == [(1, 0, 2.0), (1, 1, 5.0)]
