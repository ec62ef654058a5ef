"""Scalar models, invariants and edge cases of the operators."""

import json
import math
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tapeframe.functions import normal, text
from tapeframe.operators import alignment, book, planner, scans, state, stats, windows
from tapeframe.operators.bars import resample
from tapeframe.sources import io, tables
from tapeframe.streaming import book as streaming


def series(spark, values, key="a"):
    return spark.createDataFrame([(key, k * 1000, v) for k, v in enumerate(values)], "k string, t long, z double")


def randoms(n, seed, missing=0.1):
    r = random.Random(seed)
    return [None if r.random() < missing else r.gauss(0, 1.3) for _ in range(n)]


def test_ladder_equals_fold(spark):
    values = randoms(800, 1)
    level, want = 0, []
    for z in values:
        a = abs(z) if z is not None else None
        if a is None or a < 0.6:
            level = 0
        elif a >= 2.0:
            level = 2
        elif level == 2:
            level = 1 if a < 1.25 else 2
        elif level == 0:
            level = 1 if a >= 1.0 else 0
        want.append(level)
    got = [r.level for r in state.ladder(series(spark, values), ["k"], "z", 1.0, 0.6, 2.0, 1.25).orderBy("t").collect()]
    assert got == want and {0, 1, 2} <= set(got)


@pytest.mark.parametrize("block", [1_000, 37_000, 10_000_000])
def test_schmitt_equals_fold_for_any_block(spark, block):
    values, step, s, want = randoms(500, 2), state.schmitt_step(0.5, 0.2), 0, []
    for z in values:
        s = step(s, float("nan") if z is None else z)
        want.append(s)
    got = [r.s for r in scans.automaton(series(spark, values), ["k"], "t", "z", [-1, 0, 1], 0, step, "s", block).orderBy("t").collect()]
    assert got == want


def test_schmitt_jump_passes_zero():
    step = state.schmitt_step(0.5, 0.2)
    assert [step(-1, 0.9), step(step(-1, 0.9), 0.9)] == [0, 1]


@pytest.mark.parametrize("block", [3_000, 50_000, 10_000_000])
def test_smoothing_equals_recurrence_for_any_block(spark, block):
    values, n, alpha = randoms(300, 3), 14, 1 / 14
    seen, y, want = [], None, []
    for z in values:
        if z is not None:
            seen.append(z)
            y = None if len(seen) < n else sum(seen) / n if len(seen) == n else y + alpha * (z - y)
        want.append(y)
    got = [r.y for r in scans.smoothed(series(spark, values), ["k"], "t", "z", n, alpha, "y", block).orderBy("t").collect()]
    assert all((a is None and b is None) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) for a, b in zip(got, want, strict=True))
    assert got[-1] is not None


def test_prefix_invariance_and_partition_invariance(spark, sf):
    """Cutting the future off or dealing rows otherwise changes no past value."""
    bars = tables.bars(spark, sf, "4h").cache()
    full = windows.valid_norm(bars, ["symbol"], "close", n=40, least=10).select("symbol", "t", F.round("z", 9).alias("z"))
    cut = 1_705_500_000_000
    part = windows.valid_norm(bars.filter(F.col("t") < cut).repartition(7), ["symbol"], "close", n=40, least=10).select("symbol", "t", F.round("z", 9).alias("z"))
    assert full.filter(F.col("t") < cut).exceptAll(part).count() == 0 and part.filter("z is not null").count() > 0


@pytest.mark.parametrize("block", [10_000, 86_400_000 * 365])
def test_as_of_inclusive_and_strict(spark, block):
    left = spark.createDataFrame([("a", 5), ("a", 10), ("a", 100_000), ("b", 7)], "k string, t long")
    right = spark.createDataFrame([("a", 5, 1.0), ("a", 9, 2.0), ("a", 30_000, 3.0)], "k string, rt long, v double")
    of = lambda strict: {(r.k, r.t): r.v for r in alignment.as_of(left, right, ["k"], "t", "rt", ["v"], strict, block).collect()}
    assert of(False) == {("a", 5): 1.0, ("a", 10): 2.0, ("a", 100_000): 3.0, ("b", 7): None}
    assert of(True)[("a", 5)] is None


def test_constant_window_has_z_zero_and_unique_extremes(spark):
    flat = windows.valid_norm(series(spark, [1.0] * 20).withColumnRenamed("z", "x"), ["k"], "x", n=10, least=3).orderBy("t").collect()
    assert flat[-1].z == 0.0
    rising = windows.valid_norm(series(spark, [float(k) for k in range(20)]).withColumnRenamed("z", "x"), ["k"], "x", n=10, least=3).orderBy("t").collect()
    assert rising[-1].pct == 100.0


@pytest.mark.parametrize("run", [7, 10**6])
def test_ranks_of_runs_equal_loops(spark, monkeypatch, run):
    monkeypatch.setattr(windows, "RUN", run)
    values, n = randoms(120, 6, missing=0.2), 9
    values[10:14] = [0.5, 0.5, None, 0.5]
    found = windows.ranked(series(spark, values).withColumn("extra", F.lit("kept")), ["k"], "z", n, "there", "below").orderBy("t").collect()
    for i, r in enumerate(found):
        past = [v for v in values[max(0, i - n) : i] if v is not None]
        assert r.there == len(past) and (values[i] is None or r.below == sum(v <= values[i] for v in past)) and r.extra == "kept"
    assert len(found) == len(values)


def test_zero_and_null_trades_resample(spark):
    rows = spark.createDataFrame([("a", 0, 1, 0.0, 1.0), ("a", 1, 2, None, 1.0)], "symbol string, t long, trade_id long, px double, qty double")
    got = resample(rows, 60_000, ["symbol"], "t", "px", "qty", "trade_id").collect()
    assert len(got) == 1 and got[0].open == 0.0 and got[0].trades == 1
    assert resample(rows.limit(0), 60_000, ["symbol"], "t", "px", "qty", "trade_id").count() == 0


# ---------------------------------------------------------------- books


def event(first, last, prev, *levels):
    return {"first_id": first, "last_id": last, "prev_id": prev, "levels": list(levels)}


def fresh():
    b = book.Book()
    b.snapshot(100, [("bid", 99.0, 10.0), ("ask", 101.0, 10.0)])
    b.update(event(99, 101, 98, ("bid", 98.0, 5.0)))
    return b


def test_book_normal_duplicate_gap():
    b = fresh()
    assert b.valid and b.bids.qty == {99.0: 10.0, 98.0: 5.0}
    b.update(event(100, 101, 99))
    assert b.valid and b.dropped == 1
    b.update(event(105, 106, 104, ("bid", 97.0, 1.0)))
    assert not b.valid and b.gaps == 1 and 97.0 not in b.bids.qty and b.pending == [] and b.resyncs == 1
    b.update(event(107, 107, 106))
    assert len(b.pending) == 1


def test_book_snapshot_race_and_unbracketed():
    b = book.Book()
    for k in (99, 100, 101):
        b.update(event(k, k, k - 1, ("bid", float(k), 1.0)))
    b.snapshot(100, [("ask", 200.0, 1.0)])
    assert b.valid and b.last_id == 101 and b.dropped == 1 and b.bids.qty == {100.0: 1.0, 101.0: 1.0}
    b = book.Book()
    b.update(event(150, 151, 149))
    b.snapshot(100, [])
    assert not b.valid and b.last_id is None and b.pending == []


def test_book_crossed_unknown_removal_and_disconnect():
    b = fresh()
    b.update(event(102, 102, 101, ("bid", 90.0, 0.0)))
    assert b.unknown_removals == 1 and b.valid
    b.update(event(103, 103, 102, ("ask", 99.0, 1.0)))
    assert not b.valid and b.crossed == 1
    b = fresh()
    b.invalidate("disconnect")
    assert b.resyncs == 1 and b.last_id is None and len(b.bids)


def test_ladder_is_a_sorted_map():
    r, side, plain = random.Random(3), book.Ladder("bid"), {}
    for _ in range(3000):
        price, qty = float(r.randint(1, 60)), float(r.choice([0, 0, 1, 2]))
        assert side.set(price, qty) == (price in plain or qty > 0)
        plain.pop(price, None) if not qty else plain.__setitem__(price, qty)
        assert side.best() == max(plain, default=None)
    assert side.levels() == sorted(plain.items(), reverse=True)


def test_vendor_feed_and_pruning():
    b = book.Book()
    b.vendor(1, False, [("bid", 90.0, 1.0)])
    assert not b.valid and b.dropped == 1
    b.vendor(2, True, [("bid", 99.0, 1.0)])
    b.vendor(2, True, [("ask", 101.0, 1.0), ("ask", 150.0, 1.0), ("bid", 98.0, 1.0)])
    assert not b.valid and len(b.bids) == 2
    b.vendor(3, False, [("bid", 98.0, 0.0)])
    assert b.valid and b.applied == 1 and len(b.bids) == 1
    b.vendor(1, False, [("bid", 90.0, 5.0)])
    assert b.valid and b.regressions == 1
    assert b.prune() == 2 and b.bids.levels() == [(99.0, 1.0)] and b.asks.levels() == [(101.0, 1.0)]
    b.vendor(4, False, [("bid", 102.0, 1.0)])
    assert b.valid and not b.uncrossed() and not b.valid and b.crossed == 1
    b.vendor(5, True, [("bid", 1.0, 1.0)])
    assert b.bids.levels() == [(1.0, 1.0)] and not len(b.asks)


def test_walk_partial_and_complete(spark):
    levels = spark.createDataFrame([("X", s, float(p), 10.0) for s, p in (("bid", 99), ("bid", 98), ("bid", 97), ("ask", 101), ("ask", 102), ("ask", 103))] + [("Y", "bid", 5.0, 1.0)], "symbol string, side string, price double, qty double")
    orders = spark.createDataFrame([("X", "BUY", n) for n in (500.0, 1520.0, 1e9, 0.0, -5.0)] + [("X", "SELL", 990.0), ("Y", "BUY", 1.0)], "symbol string, order_side string, notional double")
    found = book.with_fees(book.walk(levels, ["symbol"], orders)).withColumn("v", book.verdict(F.col("ok"), F.col("complete"), F.col("all_in_bp"), F.lit(106.0))).withColumn("u", book.verdict(F.col("ok"), F.col("complete"), F.col("all_in_bp"), F.lit(None).cast("double")))
    got = {(r.symbol, r.order_side, r.notional): r for r in found.collect()}
    a, b, c = (got["X", "BUY", n] for n in (500.0, 1520.0, 1e9))
    assert a.vwap == 101.0 and a.levels_used == 1 and b.levels_used == 2 and math.isclose(b.vwap, 1520 / (10 + 510 / 102))
    assert math.isclose(a.slippage_bp, 100.0) and math.isclose(a.half_spread_bp, 100.0) and math.isclose(a.impact_bp, 0, abs_tol=1e-9) and math.isclose(a.all_in_usd, 105.0 / 1e4 * 500)
    assert math.isclose(a.consumed_pct, 500 / 3060 * 100) and (a.v, a.u, b.v, b.u) == ("GOOD", "NOT GRADED", "POOR", "NOT GRADED")
    assert c.ok and not c.complete and c.slippage_bp is None and c.cost_B is None and c.levels_used == 3 and c.worst == 103.0 and math.isclose(c.vwap, 3060 / 30) and math.isclose(c.consumed_pct, 100) and (c.v, c.u) == ("POOR", "POOR")
    assert math.isclose(got["X", "SELL", 990.0].vwap, 99.0)
    assert {(got[k].ok, got[k].reason, got[k].v) for k in (("X", "BUY", 0.0), ("X", "BUY", -5.0))} == {(False, "notional must be positive", "UNKNOWN")}
    assert (got["Y", "BUY", 1.0].ok, got["Y", "BUY", 1.0].reason, got["Y", "BUY", 1.0].mid) == (False, "book empty", None)


def test_audit_finds_what_is_wrong(spark):
    rows = [("ok", "bid", 1.0, 1.0), ("ok", "ask", 2.0, 1.0), ("twice", "bid", 1.0, 1.0), ("twice", "bid", 1.0, 2.0), ("crossed", "bid", 3.0, 1.0), ("crossed", "ask", 3.0, 1.0), ("zero", "bid", 1.0, 0.0)]
    found = {r.symbol: (r.strict, r.uncrossed, r.positive, r.ok) for r in book.audit(spark.createDataFrame(rows, "symbol string, side string, price double, qty double"), ["symbol"]).collect()}
    assert found == {"ok": (True, True, True, True), "twice": (False, True, True, False), "crossed": (True, False, True, False), "zero": (True, True, False, False)}


def test_features_equal_the_declarative_ones(spark, sf):
    levels = tables.book_levels(spark, sf).withColumn("symbol", F.lit("PART"))
    want = book.depth_features(levels, ["symbol"]).first().asDict()
    side = lambda name, down: sorted(((r.price, r.qty) for r in levels.filter(F.col("side") == name).collect()), reverse=down)
    (got,) = book.features(side("bid", True), side("ask", False))
    names = [c.split()[0] for c in book.FEATURES.split(", ")]
    assert all(math.isclose(x, want[n], rel_tol=1e-9, abs_tol=1e-9) for n, x in zip(names, got, strict=True)) and book.features([], [(1.0, 1.0)]) == []


def timed(spark):
    """Events of a book that is fed for three seconds, falls silent, and is synchronised again."""
    level = lambda side, price, qty=1.0: {"side": side, "price": price, "qty": qty}
    rows = [("A", 1, "snapshot", 10, 10, 9, [level("bid", 99.0), level("ask", 101.0)], 500), ("A", 2, "update", 10, 11, 9, [level("bid", 99.5)], 900), ("A", 3, "update", 12, 12, 11, [level("ask", 100.5)], 2500)]
    rows += [("A", 4, "update", 13, 13, 12, [level("bid", 40.0)], 20_000), ("A", 5, "snapshot", 13, 13, 12, [level("bid", 50.0), level("ask", 60.0)], 20_100), ("A", 6, "update", 14, 14, 13, [], 20_200), ("A", 7, "update", 15, 15, 14, [], 21_500)]
    return spark.createDataFrame(rows, streaming.TIMED).coalesce(1)


def test_second_features_while_valid_and_fresh(spark, tmp_path):
    got = [(r.at, r.bid, r.ask) for r in book.second_features(timed(spark), 1000, 3000).orderBy("at").collect()]
    assert got == [(1000, 99.5, 101.0), (2000, 99.5, 101.0), (3000, 99.5, 100.5), (4000, 99.5, 100.5), (5000, 99.5, 100.5), (21_000, 50.0, 60.0)]
    timed(spark).filter("arrival <= 3").write.parquet(f"{tmp_path}/in/a")
    stream = lambda: spark.readStream.schema(streaming.TIMED).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    streaming.run_to_end(spark, streaming.second_features(stream(), 1000, 3000), f"{tmp_path}/s")
    timed(spark).filter("arrival > 3").write.parquet(f"{tmp_path}/in/b")
    streaming.run_to_end(spark, streaming.second_features(stream(), 1000, 3000), f"{tmp_path}/s")
    assert [(r.at, r.bid, r.ask) for r in spark.read.parquet(f"{tmp_path}/s/out").orderBy("at").collect()] == got


def test_flow_of_blocks_equals_loops(spark):
    r = random.Random(4)
    trades = [("a", t, float(r.randint(1, 9)), 1.0, r.random() < 0.5) for t in sorted(r.randrange(0, 20_000) for _ in range(300))]
    df = spark.createDataFrame(trades, "k string, t long, px double, qty double, aggressive_buy boolean")
    samples = spark.createDataFrame([("a", t) for t in range(0, 21_000, 500)], "k string, t long")
    for block in (1000, 10**9):
        for row in windows.flow(df, ["k"], [500, 3000], samples, block).collect():
            for w in (500, 3000):
                inside = [x for x in trades if row.t - w <= x[1] <= row.t]
                buy, sell = (sum(x[2] for x in inside if x[4] == side) for side in (True, False))
                assert (row[f"n_{w}"], row[f"buy_{w}"], row[f"sell_{w}"]) == (len(inside), buy, sell) and math.isclose(row[f"afi_{w}"], (buy - sell) / (buy + sell) if buy + sell else 0, abs_tol=1e-12)
        assert windows.flow(df, ["k"], [500], block_ms=block).count() == len(trades)


class FakeHandle:
    """State and timers of one key, as the processor sees them."""

    def __init__(self):
        self.timers, self.value, self.levels = set(), None, {}

    def getValueState(self, name, schema):
        handle = self
        return type("Value", (), {"exists": lambda s: handle.value is not None, "get": lambda s: handle.value, "update": lambda s, v: setattr(handle, "value", v)})()

    def getMapState(self, name, keys, values):
        levels = self.levels
        return type("Map", (), {"iterator": lambda s: iter(list(levels.items())), "removeKey": lambda s, k: levels.pop(k), "updateValue": lambda s, k, v: levels.__setitem__(k, v)})()

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def registerTimer(self, at):
        self.timers.add(at)


def test_stale_timer_follows_the_last_batch():
    """A busy book is not invalidated by timers of earlier batches; a silent one is."""
    import pandas as pd

    level = lambda side, price, qty=1.0: {"side": side, "price": price, "qty": qty}
    rows = [(1, "snapshot", 10, 10, 9, [level("bid", 99.0), level("bid", 98.0), level("ask", 101.0)]), (2, "update", 10, 11, 9, [level("bid", 98.0, 0.0)]), (3, "update", 12, 12, 11, [level("ask", 100.5)])]
    frame = lambda k: iter([pd.DataFrame(rows[k : k + 1], columns=["arrival", "kind", "first_id", "last_id", "prev_id", "levels"])])
    at = lambda now: type("Now", (), {"getCurrentProcessingTimeInMs": lambda s: now})()
    due = lambda when: type("Due", (), {"getExpiryTimeInMs": lambda s: when})()
    processor, handle = streaming.BookProcessor(100), FakeHandle()
    processor.init(handle)
    for k, now in enumerate((1000, 1050, 1140)):
        (out,) = processor.handleInputRows(("A",), frame(k), at(now))
        assert handle.timers == {now + 100}
    assert out.valid[0] and handle.levels == {("bid", 99.0): (1.0,), ("ask", 101.0): (1.0,), ("ask", 100.5): (1.0,)}
    assert list(processor.handleExpiredTimer(("A",), at(1150), due(1150))) == []
    (out,) = processor.handleExpiredTimer(("A",), at(1241), due(1240))
    assert (out.valid[0], out.reason[0], out.arrival[0]) == (False, "stale", -1) and len(handle.levels) == 3


def test_streaming_bars_flow_and_alerts(spark, tmp_path):
    """Late rows are left out, bars and flow come once the watermark has passed, an alert is written once."""
    put = lambda name, rows: spark.createDataFrame([("A", s, k, p, q, b) for s, k, p, q, b in rows], "symbol string, s long, trade_id long, px double, qty double, aggressive_buy boolean").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    trades = lambda: spark.readStream.schema("symbol string, s long, trade_id long, px double, qty double, aggressive_buy boolean").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in").withColumn("ts", F.timestamp_seconds("s"))
    for name, rows in (("a", [(10, 1, 5.0, 1.0, True), (50, 2, 7.0, 2.0, False), (55, 3, 4.0, 1.0, True)]), ("b", [(200, 4, 9.0, 1.0, True)]), ("c", [(20, 5, 99.0, 1.0, True), (400, 6, 9.0, 1.0, True)])):
        put(name, rows)
        streaming.run_to_end(spark, streaming.bars(trades(), "60 seconds", "10 seconds"), f"{tmp_path}/bars")
        streaming.run_to_end(spark, streaming.flow(trades(), {"30s": "30 seconds", "5s": "5 seconds"}, "5 seconds", "10 seconds"), f"{tmp_path}/flow")
    found = [(r.t.timestamp(), r.open, r.high, r.low, r.close, r.volume) for r in spark.read.parquet(f"{tmp_path}/bars/out").orderBy("t").collect()]
    assert found == [(0, 5.0, 7.0, 4.0, 4.0, 4.0), (180, 9.0, 9.0, 9.0, 9.0, 1.0)]
    flow = {(r.width, int(r["at"].timestamp())): (r.buy, r.sell, r.n) for r in spark.read.parquet(f"{tmp_path}/flow/out").collect()}
    assert flow["30s", 60] == (4.0, 14.0, 2) and flow["5s", 60] == (4.0, 0.0, 1) and flow["30s", 30] == (5.0, 0.0, 1) and ("5s", 70) not in flow
    for epoch, texts in ((0, ["x", "x", "y"]), (1, ["y", "z"]), (1, ["y", "z"]), (2, ["x"])):
        streaming.alerts(spark.createDataFrame([(1, t) for t in texts], "t long, text string"), f"{tmp_path}/alerts", epoch)
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/alerts").collect()) == ["x", "y", "z"]
    later = spark.createDataFrame([(1, "x"), (90_000_000, "x"), (90_000_000, "w"), (None, "v")], "t long, text string")
    for _ in range(2):  # the second run repeats the epoch
        streaming.alerts(later, f"{tmp_path}/alerts", 9)
    streaming.alerts(later.filter("text = 'none'"), f"{tmp_path}/alerts", 10)
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/alerts").collect()) == ["v", "w", "x", "x", "y", "z"]


def test_stream_equals_batch(spark, sf, tmp_path):
    from tapeframe.plans.microstructure import _stream

    events = _stream(spark, sf).select(*[c.split()[0] for c in ("symbol", "arrival", "kind", "first_id", "last_id", "prev_id", "levels")])
    parts = events.orderBy("arrival").coalesce(1)
    parts.filter("arrival < 1500").write.parquet(f"{tmp_path}/in/a")
    stream = lambda: spark.readStream.schema(streaming.EVENT).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    streaming.run_to_end(spark, streaming.books(stream()), f"{tmp_path}/s")
    parts.filter("arrival >= 1500").write.parquet(f"{tmp_path}/in/b")  # a restart: state comes from the checkpoint
    streaming.run_to_end(spark, streaming.books(stream()), f"{tmp_path}/s")
    got, want = spark.read.parquet(f"{tmp_path}/s/out"), book.replay(_stream(spark, sf))
    assert got.count() == want.count() > 0
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_stream_high_water_survives_restart(spark, tmp_path):
    def put(name, ids):
        spark.createDataFrame([("t", i, k) for k, i in enumerate(ids)], "k string, id long, n long").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    rows = lambda: spark.readStream.schema("k string, id long, n long").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    put("a", [1, 2, 5, 3, 3, 4])
    streaming.run_to_end(spark, streaming.advancing(rows(), "k", "id", "n"), f"{tmp_path}/s")
    put("b", [2, 7, 6, 5, 8])
    streaming.run_to_end(spark, streaming.advancing(rows(), "k", "id", "n"), f"{tmp_path}/s")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/s/out").collect()) == [1, 2, 5, 7, 8]


# ---------------------------------------------------------------- plans, statistics, texts


def test_plan_identities(spark):
    rows = planner.grid(spark, [{"entry": 100.0, "stop": 90.0}, {"dir": "Short", "entry": 100.0, "stop": 90.0}]).withColumn("close", F.lit(104.0)).withColumn("atr", F.lit(2.0))
    ok, void = planner.planned(rows).orderBy("plan").collect()
    assert ok.ok and math.isclose(ok.to_stop_r - ok.live_r, 1.0) and math.isclose(ok.r2, 120.0) and ok.capped is True or ok.qty <= ok.qty_cap
    assert void.ok is False and void.qty is None and void.live_r is None


def test_effective_trials_of_correlated_configurations():
    import numpy as np

    pair = lambda rho: np.array([[1, rho], [rho, 1]])  # noqa: E731  eigenvalues 1 + rho and 1 - rho
    assert math.isclose(stats.effective_trials(pair(0.6)), 2.0) and math.isclose(stats.effective_trials(pair(0.2)), 2.0)
    three = np.full((3, 3), 0.9) + 0.1 * np.eye(3)  # eigenvalues 2.8, 0.1, 0.1
    assert math.isclose(stats.effective_trials(three), 2.0)
    four = np.kron(np.eye(2), np.full((2, 2), 1.0))  # 2, 2, 0, 0: two clusters
    assert math.isclose(stats.effective_trials(four), 2.0)


def test_deflated_sharpe_by_simulation():
    import numpy as np

    best, p = stats.deflated_sharpe(0.1, 101, 0.0, 3.0, 1, 0.01)
    assert best == 0.0 and math.isclose(p, normal.cdf(0.1 * 10 / math.sqrt(1.005)))
    best, p = stats.deflated_sharpe(0.3, 401, 0.0, 3.0, 20, 0.01)
    simulated = np.random.default_rng(3).normal(0, 0.1, (40_000, 20)).max(1).mean()
    assert abs(best - simulated) < 0.005 and math.isclose(p, normal.cdf((0.3 - best) * 20 / math.sqrt(1 + 0.5 * 0.09)))
    assert stats.deflated_sharpe(0.3, 401, -1.0, 6.0, 20, 0.01)[1] < p, "fat left tails lower it"


def test_effective_trials_and_threshold():
    import numpy as np

    assert stats.effective_trials(np.eye(4)) == 4.0
    assert math.isclose(normal.inverse(0.975), 1.959964, abs_tol=1e-6) and math.isclose(normal.bonferroni_threshold(131), 3.5524, abs_tol=1e-3)


def test_regression_recovers_planted_effect(spark):
    r = random.Random(5)
    rows = [(k, x := r.gauss(0, 1), 0.5 + 2.0 * x + r.gauss(0, 0.1), 7.0) for k in range(600)]
    df = spark.createDataFrame(rows, "t long, x double, y double, c double").withColumn("g", F.lit(1))
    found = {f.term: f for f in stats.regressions(df, ["g"], "t", "y", ["x", "c"], 4, 1000).collect()}
    assert set(found) == {"intercept", "x"} and abs(found["x"].beta - 2) < 0.02 and found["x"].t > 50
    assert stats.regressions(df, ["g"], "t", "y", ["c"], 4, 1000).collect() == []


@pytest.mark.parametrize("block", [7, 10**9])
def test_regression_errors_equal_numpy(spark, block):
    """Newey-West errors against the matrix formula, whatever the blocks and runs."""
    import numpy as np

    r = random.Random(8)
    rows, e = [], 0.0
    for k in range(400):
        e = 0.6 * e + r.gauss(0, 1)
        rows.append((k * 3, r.gauss(0, 1) + 0.5 * e, r.gauss(0, 2), 1.0 + e))
    df = spark.createDataFrame(rows, "t long, a double, b double, y double").repartition(5)
    x = np.array([[1.0, a, b] for _, a, b, _ in rows])
    y = np.array([row[3] for row in rows])
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    g = x * (y - x @ beta)[:, None]
    meat = g.T @ g
    for lag in range(1, 6):
        cross = g[lag:].T @ g[:-lag]
        meat = meat + (1 - lag / 6) * (cross + cross.T)
    se = np.sqrt(np.diag(inverse @ meat @ inverse))
    found = [f.asDict() for f in stats.regressions(df.withColumn("k", F.lit(1)), ["k"], "t", "y", ["a", "b"], 5, block, 0, 50).collect()]
    assert [f["term"] for f in found] == ["intercept", "a", "b"]
    assert all(math.isclose(f["beta"], b, rel_tol=1e-8) and math.isclose(f["se"], s, rel_tol=1e-8) for f, b, s in zip(found, beta, se, strict=True))
    (fit,) = stats.slope(df.withColumn("k", F.lit(1)), ["k"], "t", "a", "y", 5).collect()
    (plain,) = [f for f in stats.regressions(df.withColumn("k", F.lit(1)), ["k"], "t", "y", ["a"], 5, block).collect() if f["term"] == "a"]
    assert math.isclose(fit.beta, plain["beta"], rel_tol=1e-8) and math.isclose(fit.t, plain["t"], rel_tol=1e-8)


def test_regression_leaves_out_what_is_not_finite(spark):
    rows = [(k, float(k % 7), 2.0 * (k % 7)) for k in range(60)] + [(60, float("inf"), 1.0), (61, 1.0, float("nan")), (62, None, 1.0), (63, 1.0, float("-inf"))]
    (x,) = stats.regressions(spark.createDataFrame(rows, "t long, x double, y double").withColumn("g", F.lit(1)), ["g"], "t", "y", ["x"], 2, 50).where("term = 'x'").collect()
    assert x["n"] == 60 and math.isclose(x["beta"], 2.0)


def test_details_of_the_panel_change_no_value(spark):
    """What a line says is the same at every detail, and a richer detail has every line of a poorer one."""
    from tapeframe.plans import context

    said = {}
    for r in context.dashboard(spark, "/root/testdata/sf0.001").collect():
        said.setdefault(r.detail, {})[r.measure] = (r.phrase, r.value)
    full = said["full"]
    assert all(full[m] == v for detail in said.values() for m, v in detail.items()) and set(said.get("compact", {})) <= set(said.get("standard", {})) <= set(full)


def test_volatility_coverage_needs_sixty_seconds_of_24_hours(spark):
    r = random.Random(1)
    rows = [("a", h * 3_600_000 + k * 1000, 100 * math.exp(r.gauss(0, 1e-4 * (1 + h % 5)))) for h in range(30) for k in range(60 if h != 3 else 59)]
    df = spark.createDataFrame(rows, "k string, t long, mid double")
    (found,) = stats.volatility_coverage(df, ["k"], "t", "mid", 3_600_000, 60, 24, 60 * 1e4).collect()
    vols = []
    for h in range(30):
        x = [math.log(m) for _, t, m in rows if t // 3_600_000 == h]
        d = [b - a for a, b in zip(x, x[1:], strict=False)]
        if len(x) >= 60:
            vols.append(math.sqrt(sum((v - sum(d) / len(d)) ** 2 for v in d) / len(d)) * 60 * 1e4)
    vols.sort()
    assert found.periods == 29 and math.isclose(found.p10, vols[2]) and math.isclose(found.p90, vols[26]) and math.isclose(found.spread, vols[26] / vols[2])
    (few,) = stats.volatility_coverage(df.filter("t < 23 * 3600000"), ["k"], "t", "mid", 3_600_000, 60, 24, 1.0).collect()
    assert few.periods == 22 and few.spread is None


def test_simulated_trades_by_hand(spark):
    bar = lambda t, o, h, low, c, signal=False, stop=None, trail=None: ("a", t, float(o), float(h), float(low), float(c), signal, stop, trail)
    rows = [bar(0, 10, 11, 9, 10, True, 8.0), bar(1, 10, 12, 9, 11, True, 9.0, 8.5), bar(2, 11, 14, 10, 13, False, None, 10.5), bar(3, 12, 13, 10, 12, False)]  # leaves at the trail; the signal inside is ignored
    rows += [bar(4, 12, 12, 11, 12, True, 11.0), bar(5, 10, 12, 9, 11), bar(6, 11, 12, 10, 11, True, 10.0), bar(7, 11, 13, 10.5, 12)]  # opens below its stop; the last is open at the end
    df = spark.createDataFrame(rows, "k string, t long, open double, high double, low double, close double, signal boolean, stop double, trail double")
    got = [(r.signal_t, r.entry_t, r.exit_t, r.exit, r.how, r.r) for r in state.simulated(df, ["k"]).orderBy("entry_t").collect()]
    assert got == [(0, 1, 3, 10.5, "stop", 0.25), (4, 5, 5, 10.0, "gap", 0.0), (6, 7, 7, 12.0, "end", 1.0)]


def test_ols_hac_has_every_symbol(spark):
    import numpy as np

    from tapeframe.plans import research

    sf = "/root/testdata/sf0.01"
    found = {(r.symbol, r.model, r.term): r for r in research.ols_hac(spark, sf).collect()}
    rows = research._returns(spark, sf).filter("x1 is not null and x2 is not null and y is not null").select("symbol", "x1", "x2", "y").collect()
    symbols = {r.symbol for r in rows}
    assert len(symbols) > 1 and set(found) == {(s, m, x) for s in symbols for m, xs in (("one", ["intercept", "x1"]), ("two", ["intercept", "x1", "x2"])) for x in xs}
    for s in symbols:
        x = np.array([[1.0, r.x1, r.x2] for r in rows if r.symbol == s])
        beta = np.linalg.lstsq(x, np.array([r.y for r in rows if r.symbol == s]), rcond=None)[0]
        assert all(abs(found[s, "two", t].beta - b) < 1e-4 and found[s, "two", t].n == len(x) for t, b in zip(["intercept", "x1", "x2"], beta, strict=True))


def test_texts(spark):
    row = spark.createDataFrame([(1234567.0, None)], "x double, n double").select(text.compact(F.col("x")).alias("a"), text.number(F.col("n")).alias("b"), text.grouped(F.col("x")).alias("c"), text.signed(F.col("x") * 0).alias("d")).first()
    assert tuple(row) == ("1.23M", "n/a", "1,234,567", "+0")


# ---------------------------------------------------------------- sources and sinks


def test_ndjson_round_trip_drops_torn_lines(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2.5", 1_700_000_000_000, "trades"), (2, "bad", 1_700_086_400_000, "trades")], "a long, p string, recvMs long, kind string")
    io.write_ndjson(rows, f"{tmp_path}/d")
    io.write_ndjson(rows.limit(1), f"{tmp_path}/d")
    with open(f"{tmp_path}/d/date=2023-11-14/kind=trades/torn.json", "w") as f:
        f.write('{"a": 9, "p": "1"}\n{"a": 1')
    got = io.read_ndjson(spark, f"{tmp_path}/d", io.TRADE)
    assert sorted(r.a for r in got.collect()) == [1, 1, 2, 9], "the torn line gives no row"
    assert io.disk_usage(spark, f"{tmp_path}/d").first().files >= 3
    seals = io.sealed(spark, f"{tmp_path}/d", "2023-11-15").cache()
    assert seals.count() > 0 and seals.filter("day >= '2023-11-15'").count() == 0
    assert io.tampered(seals, seals.withColumn("sha256", F.lit("x"))).count() == seals.count() and io.tampered(seals, seals).count() == 0


def test_stream_of_ndjson_and_seals_once(spark, tmp_path):
    put = lambda name, ids: spark.createDataFrame([(i, 1_700_000_000_000 + i, "trades") for i in ids], "a long, recvMs long, kind string").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    stream = lambda: spark.readStream.schema("a long, recvMs long, kind string").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    for name, ids in (("x", [1, 2]), ("y", [3])):
        put(name, ids)
        io.stream_ndjson(stream(), f"{tmp_path}/out", f"{tmp_path}/c")
    got = spark.read.schema("a long, recvMs long").option("basePath", f"{tmp_path}/out").json(f"{tmp_path}/out/date=*/kind=trades")
    assert sorted(r.a for r in got.collect()) == [1, 2, 3]
    seals = spark.createDataFrame([("f", "first", "2023-11-14")], "path string, sha256 string, day string")
    io.write_seals(seals, f"{tmp_path}/seals")
    io.write_seals(spark.createDataFrame([("f", "second", "2023-11-14"), ("g", "new", "2023-11-15")], seals.schema), f"{tmp_path}/seals")
    kept = spark.read.parquet(f"{tmp_path}/seals")
    assert sorted((r.path, r.sha256) for r in kept.collect()) == [("f", "first"), ("g", "new")]
    assert [r.path for r in io.tampered(kept, spark.createDataFrame([("f", "second"), ("g", "new")], "path string, sha256 string")).collect()] == ["f"]


def test_zipped_csv(spark, tmp_path):
    with zipfile.ZipFile(f"{tmp_path}/x.zip", "w") as z:
        z.writestr("x.csv", "oi,t,extra\n1.5,10,a\nnan,20,b\n2.5,,c\n3.5,40,d\n")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("t", T.LongType()), T.StructField("oi", T.DoubleType())])
    assert sorted(map(tuple, io.read_zipped_csv(spark, f"{tmp_path}/*.zip", schema, ["t", "oi"]).collect())) == [(10, 1.5), (40, 3.5)]


def test_paged_feed_and_retries(spark, tmp_path):
    for a in range(0, 6):
        page = [{"t": (2 * a + k) * 43_200_000 // 2, "open": 1.0, "high": 2.0, "low": 0.5, "close": 1.5, "volume": 3.0} for k in (0, 1)]
        with open(os.path.join(tmp_path, f"{page[0]['t']}.json"), "w") as f:
            json.dump(page, f)
    spark.dataSource.register(io.PagedFeed)
    got = spark.read.format("pagedfeed").option("path", str(tmp_path)).option("start", 0).option("end", 172_800_000).option("step", 21_600_000).load()
    assert [r.t for r in got.orderBy("t").collect()] == [k * 21_600_000 for k in range(8)]
    answers, slept = iter([(429, None), (503, None), (200, "ok")]), []
    assert io.retrying(lambda: next(answers), sleep=slept.append) == "ok" and slept == [1.0, 2.0]
    assert io.retrying(lambda: (404, None)) is None
    with pytest.raises(RuntimeError):
        io.retrying(lambda: (400, None))
    assert list(io.paged(lambda c: [{"t": 5}], 5, 100, "t", 0)) == [{"t": 5}]


def test_cache_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert io.cached(spark, f"{tmp_path}/c", build).count() == io.cached(spark, f"{tmp_path}/c", build).count() == 3 and len(calls) == 1
    assert "| 0 |" in io.to_markdown(spark.range(1))
