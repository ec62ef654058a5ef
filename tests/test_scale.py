"""Ties of rounded texts, and operators on crowded inputs: windows, books and streams that must not depend on how they are cut."""

import random

import duckdb
import harness
import pytest
from pyspark.sql import functions as F

from tapeframe.functions import text
from tapeframe.operators import book, windows
from tapeframe.plans import panel, registry


def test_formatted_numbers_rounds_halves_as_its_sql_does(spark, tmp_path):
    prices = [(k, float(p)) for k, p in enumerate(range(1005, 27_000, 10))]  # 37 times each ends in 5: a half in thousands
    spark.createDataFrame(prices, "o_orderkey long, o_totalprice double").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    assert harness.mismatch(spark, con, registry.queries()["formatted_numbers"], registry.oracle_sql()["formatted_numbers"], str(tmp_path)) == ""


def test_texts_of_a_panel_round_halves_as_its_sql_does(spark):
    values = [(float(x),) for x in (-2135, 2135, 1025, 1035, 1_005_000, -4_345_000, 999, 0)]
    got = [r[0] for r in spark.createDataFrame(values, "x double").select(text.compact(F.col("x"))).collect()]
    want = [duckdb.execute(f"select {panel._big('x')} from (select {x}::double as x)").fetchone()[0] for (x,) in values]
    assert got == want and got[:3] == ["-2.14K", "2.14K", "1.03K"]


def test_the_sentence_of_a_panel_is_of_the_smallest_key_also_where_keys_lie_close(spark):
    rows = [("d", 2000 - 100 * 145 / 146, 1, "24 hours", 1, 1.0), ("d", 2000 - 100 * 146 / 147, 2, "4 hours", 1, 1.0), ("e", 1900.5, 1, "first", 1, 1.0), ("e", 1900.5, 2, "second", 1, 1.0), ("e", 1.0, 3, "calm", 0, 1.0), ("f", 1.0, 3, "calm", 0, 1.0)]
    names = ("t", "key", "place", "sentence", "level", "z")
    df = spark.createDataFrame(rows, "t string, key double, place int, sentence string, level int, z double")
    query = df.groupBy("t").agg(F.min(F.when(F.col("level") > 0, F.struct("key", "place", "sentence"))).alias("best")).select("t", "best.sentence").collect()
    values = ", ".join(f"('{t}', {k!r}, {p}, '{s}', {level}, {z})" for t, k, p, s, level, z in rows)
    want = duckdb.execute(f"select t, {panel._BEST} from (values {values}) v({', '.join(names)}) group by t").fetchall()
    assert dict(want) == {r.t: r.sentence for r in query} == {"d": "4 hours", "e": "first", "f": None}
    assert panel._BEST in panel.SQL["panel_rows"]


def test_flow_has_no_frame_that_is_summed_anew_for_each_row(spark, monkeypatch):
    monkeypatch.setattr(windows, "CROWD", 50)  # cuts busy blocks
    r = random.Random(7)
    trades = [("a", r.randrange(3000) if k % 3 else 1500, round(r.uniform(0, 50), 2), float(r.randrange(1, 5)), r.random() < 0.5) for k in range(600)]
    found = windows.flow(spark.createDataFrame(trades, "k string, t long, px double, qty double, aggressive_buy boolean"), ["k"], [20, 200], block_ms=1000)
    assert "RangeFrame" not in found._jdf.queryExecution().toString()
    rows = found.collect()
    assert len(rows) == len(trades)
    for row in rows:
        for ms in (20, 200):
            near = [x for x in trades if row.t - ms <= x[1] <= row.t]
            buy, sell = (sum(x[2] * x[3] for x in near if x[4] == side) for side in (True, False))
            assert row[f"n_{ms}"] == len(near) and row[f"buy_{ms}"] == pytest.approx(buy) and row[f"sell_{ms}"] == pytest.approx(sell)
            assert row[f"afi_{ms}"] == pytest.approx((buy - sell) / (buy + sell))


def test_books_of_a_crowded_instant_do_not_depend_on_the_cut(spark, monkeypatch):
    r = random.Random(3)
    updates = [("a", r.choice([5, 5, 700, r.randrange(2000)]), k, r.choice(["bid", "ask"]), float(r.randrange(10)), float(r.randrange(3))) for k in range(3000)]  # times go back
    df = spark.createDataFrame(updates, "symbol string, t long, seq long, side string, price double, qty double")
    samples = spark.createDataFrame([("a", at) for at in range(0, 2100, 100)], "symbol string, at long")
    want = []
    for at in range(0, 2100, 100):
        held = {}
        for _, t, _, side, price, qty in sorted(updates, key=lambda u: (u[1], u[2])):
            if t <= at:
                held[side, price] = qty
        want += [(at, *(sum(held.get((side, p), 0) * (p + 1) for p in range(10)) for side in ("bid", "ask")))]
    measure = lambda bp, bq, ap, aq: [(float(((bp + 1) * bq).sum()), float(((ap + 1) * aq).sum()))]
    for crowd, every in ((40, 1), (40, 100), (50_000, 100)):
        monkeypatch.setattr(book, "CROWD", crowd)
        found = book.sampled(df, ["symbol"], samples, measure, "b double, a double", 1000, every).orderBy("at").collect()
        assert [(x.at, x.b, x.a) for x in found] == want
    assert book.settled(df, ["symbol"], 100).count() <= 20 * 21


def machine_story(seed: int):
    """Losses, repetitions, late snapshots with buffered updates, disconnects, crossings."""
    r = random.Random(seed)
    rows, n = [], 0
    for k in range(1, 900):
        level = lambda: {"side": (side := r.choice(["bid", "ask"])), "price": float(r.randrange(40, 52) if side == "bid" else r.randrange(51, 60)), "qty": float(r.randrange(3))}
        for _ in range(r.choice([0, 1, 1, 1, 1, 1, 1, 1, 1, 2])):
            rows.append(("A", n := n + 1, "update", k, k, k - 1, [level()]))
        if r.random() < 0.08:
            back = r.choice([0, 0, 0, 1, 4])
            rows.append(("A", n := n + 1, "snapshot", k - back, k - back, k - back - 1, [level(), level()]))
        if r.random() < 0.02:
            rows.append(("A", n := n + 1, "disconnect", 0, 0, 0, []))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_the_sequence_machine_in_chunks_equals_one_stream(spark, seed):
    rows, state, want = machine_story(seed), book.Book(), []
    for _, arrival, kind, first, last, prev, levels in rows:
        book.fed(state, kind, {"first_id": first, "last_id": last, "prev_id": prev, "levels": levels})
        want.append({"symbol": "A", "arrival": arrival} | state.row())
    assert {"gaps", "crossed", "dropped", "resyncs"} <= {c for c, v in want[-1].items() if v}
    events = spark.createDataFrame(rows, "symbol string, arrival long, kind string, first_id long, last_id long, prev_id long, levels array<struct<side:string,price:double,qty:double>>")
    assert book.chunked(events, 60).select("chunk").distinct().count() > 5
    assert [r.asDict() for r in book.replay(events, 60).orderBy("arrival").collect()] == want
