"""The second sampler: clock, stream against plain replay, silent seconds by timers."""

import math
import time

import pytest

from tapeframe.operators.book import Book
from tapeframe.streaming import book as streaming, sampler


def level(side, price, qty=10.0):
    return {"side": side, "price": price, "qty": qty}


def event(arrival, kind, first, last, prev, levels, recv):
    return ("A", arrival, kind, first, last, prev, levels, recv, None, None, None, None)


def trade(arrival, recv, px, qty, buy):
    return ("A", arrival, "trade", None, None, None, [], recv, recv, px, qty, buy)


def story(t0=0):
    """Snapshot, covering update, trades, a gap, silence, and a second snapshot."""
    return [
        event(1, "snapshot", 10, 10, 9, [level("bid", 99.0), level("ask", 101.0), level("ask", 102.0, 50.0)], t0 + 500),
        event(2, "update", 10, 11, 9, [level("bid", 99.5)], t0 + 900),
        trade(3, t0 + 1200, 101.0, 2.0, True),
        trade(4, t0 + 1900, 99.5, 1.0, False),
        event(5, "update", 12, 12, 11, [level("ask", 100.5)], t0 + 2500),
        event(6, "update", 14, 14, 13, [level("ask", 100.0)], t0 + 3400),
        event(7, "snapshot", 14, 14, 13, [level("bid", 98.0), level("ask", 99.0)], t0 + 3600),
        event(8, "update", 14, 15, 13, [], t0 + 3700),
        event(9, "update", 16, 16, 15, [], t0 + 9700),
    ]


COLUMNS = [c.split()[0] for c in ("symbol", "arrival", "kind", "first_id", "last_id", "prev_id", "levels", "recv_ms", "t", "px", "qty", "buy")]


def replayed(rows, now=None):
    clock, out = sampler.Clock(Book(), [], 1000, 3000, (500, 1_000_000)), []
    for row in rows:
        out += clock.feed(dict(zip(COLUMNS, row, strict=True)))
    return out + (list(clock.upto(now)) if now else [])


def test_clock_tells_ticks_changes_and_requests():
    got = [(at, kind, reason) for at, kind, reason, _, _ in replayed(story())]
    assert got == [
        (900, "valid", None), (1000, "record", None), (2000, "record", None), (3000, "record", None),
        (3400, "invalid", "sequence gap"), (3400, "request", "sequence gap"), (3700, "valid", None),
        (4000, "record", None), (5000, "record", None), (6000, "record", None), (7000, "invalid", "stale"), (7000, "request", "stale"),
    ]
    assert [x[0] for x in replayed(story()[:5], 4600) if x[1] == "record"] == [1000, 2000, 3000, 4000]


def test_records_are_nested_and_right():
    (two,) = [r for at, kind, _, _, r in replayed(story()) if kind == "record" and at == 2000]
    assert two["flow"]["1000ms"] == {"buy": 202.0, "sell": 99.5, "signed": 102.5, "trades": 2, "afi": 102.5 / 301.5}
    assert (two["bid"], two["ask"], two["bid_levels"], two["ask_levels"]) == (99.5, 101.0, 2, 2)
    buy, sell = two["exec"]["BUY"], two["exec"]["SELL"]
    assert buy[500]["vwap"] == 101.0 and math.isclose(buy[500]["slippage_bp"], (101 - 100.25) / 100.25 * 1e4) and math.isclose(buy[500]["all_in_bp"], buy[500]["slippage_bp"] + 5)
    assert not buy[1_000_000]["complete"] and buy[1_000_000]["vwap"] is None and math.isclose(sell[500]["slippage_bp"], (100.25 - 99.5) / 100.25 * 1e4)
    assert set(two["depth"]["bid"]) == {"top1", "top5", "top10", "within1bp", "within2bp", "within5bp", "within10bp"} and two["depth"]["ask"]["top5"] == 1010 + 5100
    deep = sampler.order([(100.0, 1.0), (101.0, 1.0), (110.0, 5.0)], 99.0, "BUY", 250.0)
    assert deep["levels"] == 3 and math.isclose(deep["vwap"], 250 / (2 + 49 / 110))


def test_stream_equals_replay_across_restarts(spark, tmp_path):
    """In three runs of the stream, each from the state that the one before left."""
    rows = story()
    stream = lambda: spark.readStream.schema(sampler.LIVE).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    for k, part in enumerate((rows[:3], rows[3:7], rows[7:])):
        spark.createDataFrame(part, sampler.LIVE).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        streaming.run_to_end(spark, sampler.sampled_seconds(stream(), 1000, 3000, (500, 1_000_000), live=False), f"{tmp_path}/s")
    got = sorted((r.asDict(recursive=True) for r in spark.read.parquet(f"{tmp_path}/s/out").collect()), key=lambda r: (r["at"], r["kind"]))
    want = sorted(replayed(rows), key=lambda x: (x[0], x[1]))
    assert [(r["at"], r["kind"], r["reason"], r["last_id"]) for r in got] == [x[:4] for x in want]
    for r, x in zip(got, want, strict=True):
        assert r["record"] == x[4]


def test_silent_seconds_tick_by_timers(spark, tmp_path):
    """One batch of events; then the book is read each second without any, until it is stale."""
    now = int(time.time() * 1000)
    spark.createDataFrame([r for r in story(now - 1500)[:2]], sampler.LIVE).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streaming.ROCKSDB)
    events = spark.readStream.schema(sampler.LIVE).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = sampler.sampled_seconds(events, 1000, 60_000, (500,), live=True)
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="300 milliseconds").start()
    try:
        ticks, end = [], time.time() + 90
        while len(ticks) < 6 and time.time() < end:
            time.sleep(2)
            assert query.exception() is None
            try:
                ticks = sorted(r.at for r in spark.read.schema(sampler.OUTPUT).parquet(f"{tmp_path}/out").where("kind = 'record'").select("at").collect())
            except Exception:  # the sink has not written yet
                continue
    finally:
        query.stop()
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert len(ticks) >= 6 and all(b - a == 1000 and a % 1000 == 0 for a, b in zip(ticks, ticks[1:], strict=False)), "every second once"
    assert ticks[-1] > now + 1000, "seconds after the batch"


@pytest.mark.parametrize("at", [7000, 20_000])
def test_a_stale_book_asks_once(at):
    found = [x[:3] for x in replayed(story()[:8], at)]
    assert found[-2:] == [(7000, "invalid", "stale"), (7000, "request", "stale")] and sum(x[1] == "request" for x in found) == 2
