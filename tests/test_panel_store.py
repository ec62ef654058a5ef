"""Panels by state, the audit of smoothing against plain loops, and a store that refuses what is changed."""

import glob
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from tapeframe.operators import context, panel, planner, smoothing, windows
from tapeframe.sources import store

def _laid(spark, rows, parts, most=panel.ROWS):
    df = spark.createDataFrame(rows, "id int, a string, on boolean")
    return [(r.id, r.row, r.label, r["class"]) for r in panel.laid_out(df, ["id"], parts, most).orderBy("id", "row").collect()]


def test_rows_are_there_by_predicate_and_numbered(spark):
    parts = [F.array(panel.row("wide", "head"), panel.row("state", "x", F.col("a"), when=F.col("on"))), F.array(panel.row("measure", "y", "1", F.col("a")))]
    got = _laid(spark, [(1, "EXTREME INFLOW [σ]", True), (2, "stale", False), (3, None, None)], parts)
    assert got == [(1, 1, "head", None), (1, 2, "x", "extreme"), (1, 3, "y", "extreme"), (2, 1, "head", None), (2, 2, "y", "bad"), (3, 1, "head", None), (3, 2, "y", "plain")]


def test_a_panel_is_cut_at_its_most_rows_and_none_is_made_of_no_state(spark):
    parts = [F.array(*[panel.row("wide", f"r{k}") for k in range(100)])]
    assert len(_laid(spark, [(1, "", True)], parts)) == panel.ROWS
    assert _laid(spark, [], parts) == []


def test_table_of_a_plan_alone(spark):
    bars = spark.createDataFrame([(50.0, 2.0, 51.0, 49.0, 48.0)], "close double, atr double, high double, low double, trail double")
    plans = planner.planned(bars.join(planner.grid(spark, [{"entry": 50.0, "stop": 45.0}, {"entry": 50.0, "stop": 55.0}, {"entry": 40.0, "stop": 39.9, "risk_pct": 50.0}])))
    got = {}
    for r in panel.plain(plans, ["plan"]).orderBy("plan", "row").collect():
        got.setdefault(r.plan, []).append((r.label, r.value))
    assert ("PLAN", "INVALID — stop is on the wrong side of entry") in got[1] and len(got[1]) == 5
    assert ("INVALIDATION", "45  (10%, 2.5 ATR)") in got[0] and ("ENTRY", "50  (pinned)") in got[0] and ("TRAIL REF (10)", "48") in got[0]
    assert ("TRAIL REF (10)", "48  past entry") in got[2] and any(v.startswith("size capped at 1x") for _, v in got[2])


@pytest.mark.parametrize(("said", "shade"), [("LONG", "up"), ("Strong downtrend", "down"), ("EXTREME LONG FUNDING", "extreme"), ("DATA UNAVAILABLE", "muted"), ("LIKELY STALE", "bad"), ("High", "unusual"), ("OK", "normal"), ("ABOVE 200D", "plain")])
def test_colour_classes(spark, said, shade):
    from tapeframe.functions import text

    assert spark.range(1).select(text.colour_class(F.lit(said + " [σ]"))).first()[0] == shade


def test_shapes_of_a_flow_have_their_own_clocks(spark):
    values = [float(k) if k % 3 else None for k in range(40)]
    df = spark.createDataFrame([(s, t, v) for s in context.ETF_SHAPES for t, v in enumerate(values)], "shape string, t long, x double")
    flow, label, sample = context.etf_flow(F.col("x"), F.col("shape"), windows.by("shape"))
    got = {(r.shape, r.t): r for r in df.select("shape", "t", flow.alias("flow"), label.alias("label"), sample.alias("sample")).collect()}
    last = got["gated", 39]
    assert last.flow == sum([v for v in values if v is not None][-5:]) and last.sample is None and last.label == "ETF LAST 5 OBS"
    assert got["gated", 38].sample == got["gated", 38].flow and got["repeated", 39].flow is None
    assert got["repeated", 38].flow == 38 + 32 + 26 + 20 + 14 and got["increments", 39].flow == sum(v or 0 for v in values[10:])


def test_audit_of_smoothing_equals_loops(spark):
    rng = random.Random(5)
    x, z = 0.0, []
    for _ in range(300):
        x = 0.7 * x + rng.gauss(0, 1)
        z.append(None if rng.random() < 0.05 else round(x, 3))
    df = spark.createDataFrame([("s", 1000 * k, v) for k, v in enumerate(z)], "k string, t long, z double")
    found = smoothing.states(df, ["k"], (1.0, 0.6, 2.0, 1.25), block=70_000)
    got = {(r.taps, r.tier): r for r in smoothing.tiers(found, ["k"], 2).collect()}
    for taps in smoothing.TAPS:
        y, on, engaged, s = None, False, [], []
        for v in z:
            if v is not None:
                y = v if y is None else y + 2 / (taps + 1) * (v - y)
            s.append(None if v is None else round(y, 6))
            on = s[-1] is not None and (abs(s[-1]) >= 1.0 or (on and abs(s[-1]) >= 0.6))
            engaged.append(on)
        for tier in smoothing.TIERS:
            events, k = [], 0
            while k < len(z):
                if z[k] is not None and abs(z[k]) >= tier:
                    e = k
                    while e + 1 < len(z) and z[e + 1] is not None and abs(z[e + 1]) >= tier:
                        e += 1
                    events.append((k, e))
                    k = e
                k += 1
            met = [next((j for j in range(a, min(b + 2, len(z) - 1) + 1) if engaged[j]), None) for a, b in events]
            r = got[taps, tier]
            assert r.n_events == len(events) and math.isclose(r.retention, sum(m is not None for m in met) / len(events))
            delays = sorted(m - a for m, (a, _) in zip(met, events, strict=True) if m is not None)
            assert r.median_delay == (delays[(len(delays) - 1) // 2] + delays[len(delays) // 2]) / 2


COLUMNS = ["at", "x"]


def _rows(spark, day, n=20):
    return spark.range(n).select(F.col("id").alias("at"), (F.col("id") * 1.5).alias("x"), F.lit(day).alias("date"))


def test_store_keeps_order_and_files(spark, tmp_path):
    path = str(tmp_path / "fs")
    store.append(_rows(spark, "2026-01-01"), path, "fs1", COLUMNS)
    store.append(_rows(spark, "2026-01-02", 5), path, "fs1", COLUMNS)
    assert store.read(spark, path, "fs1", COLUMNS).count() == 25
    with pytest.raises(store.StoreError, match="columns"):
        store.append(_rows(spark, "2026-01-03"), path, "fs1", ["x", "at"])
    with pytest.raises(store.StoreError, match="order"):
        store.read(spark, path, "fs1", ["x", "at"])
    with pytest.raises(store.StoreError, match="no version"):
        store.read(spark, path, "fs2")
    store.append(_rows(spark, "2026-01-03"), path, "fs2", ["x", "at"])
    assert store.read(spark, path, "fs2", ["x", "at"]).count() == 20 and store.read(spark, path, "fs1").count() == 25


def test_store_refuses_changed_missing_and_unlisted_files(spark, tmp_path):
    path = str(tmp_path / "fs")
    store.append(_rows(spark, "2026-01-01"), path, "fs1", COLUMNS)
    store.append(_rows(spark, "2026-01-02"), path, "fs1", COLUMNS)
    file = sorted(glob.glob(f"{path}/data/fs1/date=2026-01-01/*.parquet"))[0]
    whole = open(file, "rb").read()
    for name in glob.glob(f"{os.path.dirname(file)}/.*.crc"):
        os.unlink(name)
    with open(file, "wb") as f:
        f.write(whole[:40] + bytes([whole[40] ^ 1]) + whole[41:])
    with pytest.raises(store.StoreError, match="changed"):
        store.read(spark, path, "fs1")
    with pytest.raises(store.StoreError, match="changed or missing"):
        store.append(_rows(spark, "2026-01-03"), path, "fs1", COLUMNS)
    with open(file, "wb") as f:
        f.write(whole)
    with open(f"{os.path.dirname(file)}/part-more.parquet", "wb") as f:
        f.write(whole)
    with pytest.raises(store.StoreError, match="unlisted"):
        store.read(spark, path, "fs1")
    os.unlink(f"{os.path.dirname(file)}/part-more.parquet")
    os.unlink(file)
    with pytest.raises(store.StoreError, match="missing"):
        store.read(spark, path, "fs1")
