"""Depth curves, costs and grouped regressions against plain models."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeframe.operators import book, depth, stats
from tapeframe.plans import study


def naive_walk(levels, notional):
    left, spent, base = notional, 0.0, 0.0
    for p, q in levels:
        if left <= 1e-9:
            break
        take = min(p * q, left)
        spent, base, left = spent + take, base + take / p, left - take
    return spent / base if left <= 1e-6 else None


def books(spark, n=40):
    """Updates of one symbol that never cross, and what the book is after each second."""
    r = random.Random(4)
    rows, held, after = [], {"bid": {}, "ask": {}}, {}
    for seq in range(n * 6):
        side = r.choice(["bid", "ask"])
        price = (100 - r.randint(1, 30) / 10) if side == "bid" else (100 + r.randint(1, 30) / 10)
        qty = r.choice([0, 1, 2, 5])
        t = seq * 170 + 1
        rows.append(("S", seq, t, side, price, float(qty)))
        held[side].pop(price, None) if qty == 0 else held[side].__setitem__(price, float(qty))
        after[t // 1000 * 1000 + 1000] = {s: dict(x) for s, x in held.items()}
    df = spark.createDataFrame(rows, "symbol string, seq long, t long, side string, price double, qty double").repartition(3)
    ordered = {at: (sorted(x["bid"].items(), reverse=True), sorted(x["ask"].items())) for at, x in after.items()}
    return df, ordered


def test_curves_price_orders_like_walking_the_book(spark):
    df, after = books(spark)
    samples = df.select("symbol", (F.floor(F.col("t") / 1000) * 1000 + 1000).alias("at")).distinct()
    sizes = (150, 900, 4000)
    found = depth.priced(book.sampled(df, ["symbol"], samples, depth.recorded(4000.0), depth.RECORD, 7000), sizes).collect()
    assert {r.at for r in found} == {at for at, (b, a) in after.items() if b and a}
    for r in found:
        bids, asks = after[r.at]
        assert (r.bid, r.ask, r.bid_levels, r.ask_levels) == (bids[0][0], asks[0][0], len(bids), len(asks))
        for side, levels in (("BUY", asks), ("SELL", bids)):
            for n in sizes:
                want, got = naive_walk(levels, n), r[f"vwap_{side}_{n}"]
                assert (want is None) == (got is None) and (want is None or math.isclose(want, got, rel_tol=1e-12))
        assert len(r.ask_prices) <= len(asks) and (r.ask_values[-1] >= 4000 or len(r.ask_prices) == len(asks))
        assert all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(book.features(bids, asks)[0], r[2 : 2 + len(book._NAMES)], strict=True))


def test_costs_shortfall_and_drift(spark):
    """A mid that rises by 1 bp a second: waiting costs a buyer the rise and saves a seller as much."""
    rows = []
    for s in range(1, 601):
        mid = 100 * (1 + 1e-4 * s)
        rows.append(("S", s * 1000, mid, mid - 0.01, mid + 0.01, [mid + 0.01], [1e6], [1e6 / (mid + 0.01)], [mid - 0.01], [1e6], [1e6 / (mid - 0.01)]))
    found = spark.createDataFrame(rows, "symbol string, at long, mid double, bid double, ask double, ask_prices array<double>, ask_values array<double>, ask_bases array<double>, bid_prices array<double>, bid_values array<double>, bid_bases array<double>").repartition(4)
    costs = depth.costs(found, ["symbol"], (1000,), (5, 30), 30, 60_000)
    out = {(r.order_side, r.wait): r for r in depth.shortfall(costs, ["symbol"], 30).collect()}
    assert len(out) == 4 and out["BUY", 5].now_n == 21
    for wait in (5, 30):
        assert math.isclose(out["BUY", wait].diff_mean, -out["SELL", wait].diff_mean, rel_tol=1e-6) and 0.93 * wait < out["BUY", wait].diff_mean < wait
        assert out["BUY", wait].act_now and not out["BUY", wait].wait_instead and out["SELL", wait].wait_instead
        assert out["BUY", wait].p95 >= out["BUY", wait].diff_mean and abs(out["BUY", wait].now_mean - 6) < 0.05
    drift = {(r.order_side, r.wait): r for r in depth.drift(found, ["symbol"], (1, 30), 30, 60_000).collect()}
    assert 0 < drift["BUY", 1].mean < drift["BUY", 30].mean and drift["SELL", 30].mean < 0
    stale = depth.costs(found.where("at <= 300000"), ["symbol"], (1000,), (30,), 30, 60_000, stale_ms=1000)
    assert stale.where("order_side = 'BUY' and later_bp is null").count() == 1, "the last decision's later book is not known"
    gaps = depth.costs(found.where("at % 30000 < 10000"), ["symbol"], (1000,), (15,), 30, 60_000, stale_ms=3000)
    assert gaps.count() > 30 and gaps.where("later_bp is not null").count() == 0, "all later books are too old"


def test_states_are_cut_at_terciles(spark):
    r = random.Random(2)
    rows = [("S", k * 30_000, "BUY", 1000, 30, 5.0, 5.0 + (k % 3), 100.0, float(k % 3), 1e5 + k, 1e5, r.random() * 1e4) for k in range(120)]
    df = spark.createDataFrame(rows, "symbol string, at long, order_side string, size int, wait int, now_bp double, later_bp double, mid double, spread_bp double, bid_within5bp double, ask_within5bp double, buy_5000 double")
    found = depth.by_state(depth.book_states(df, ["symbol"], 30, 10), ["symbol"]).collect()
    spread = {x.tercile: x for x in found if x.state == "E1_spread"}
    assert {k: (x.now_n, x.diff_mean) for k, x in spread.items()} == {1: (80, 0.5), 2: (40, 2.0)}, "a value at an edge is below it"
    assert {x.state for x in found} == set(depth.STATES)
    assert depth.by_state(depth.book_states(df.limit(90), ["symbol"], 30, 10), ["symbol"]).count() == 0


def newey_west(x, y, lags):
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    u = y - x @ beta
    g = x * u[:, None]
    meat = g.T @ g
    for lag in range(1, lags + 1):
        cross = g[lag:].T @ g[:-lag]
        meat = meat + (1 - lag / (lags + 1)) * (cross + cross.T)
    return beta, np.sqrt(np.diag(inverse @ meat @ inverse)), 1 - (u @ u) / ((y - y.mean()) ** 2).sum()


@pytest.mark.parametrize(("lags", "run", "block"), [(0, 1000, 10**9), (4, 40, 7), (20, 60, 90), (20, 10**6, 10**9)])
def test_grouped_regressions_equal_numpy(spark, lags, run, block):
    """Groups of unlike sizes, with dependent errors, nulls, infinities, and a regressor that doesn't vary in one of them."""
    r = random.Random(8)
    rows, groups = [], {}
    for name, n in (("a", 400), ("b", 130), ("c", 9), ("few", 2)):
        e = 0.0
        for k in range(n):
            e = 0.6 * e + r.gauss(0, 1)
            row = (name, k * 3, r.gauss(0, 1) + 0.5 * e, 7.0 if name == "b" else r.gauss(0, 2), 1.0 + e)
            groups.setdefault(name, []).append(row)
            rows.append(row)
    rows += [("a", 5000, None, 1.0, 1.0), ("a", 5001, float("nan"), 1.0, 1.0), ("b", 5002, 1.0, 7.0, float("inf"))]
    df = spark.createDataFrame(rows, "g string, t long, x double, c double, y double").repartition(5)
    found = stats.regressions(df, ["g"], "t", "y", ["x", "c"], lags, block, 3, run).collect()
    assert {(f.g, f.term) for f in found} == {("a", "intercept"), ("a", "x"), ("a", "c"), ("b", "intercept"), ("b", "x"), ("c", "intercept"), ("c", "x"), ("c", "c")}
    for name, terms in (("a", ["intercept", "x", "c"]), ("b", ["intercept", "x"]), ("c", ["intercept", "x", "c"])):
        if lags >= len(groups[name]):
            continue
        x = np.array([[1.0, q[2], q[3]][: len(terms)] for q in groups[name]])
        beta, se, r2 = newey_west(x, np.array([q[4] for q in groups[name]]), lags)
        for i, term in enumerate(terms):
            (f,) = [f for f in found if (f.g, f.term) == (name, term)]
            assert math.isclose(f.beta, beta[i], rel_tol=1e-7) and math.isclose(f.se, se[i], rel_tol=1e-7) and math.isclose(f.r2, r2, rel_tol=1e-7)
            assert f.n == len(groups[name]) and f.dropped == ("c" if name == "b" else "")
    assert stats.regressions(df, ["g"], "t", "y", ["c"], lags, block, 300).where("g = 'b'").count() == 0
    assert stats.regressions(df.limit(0), ["g"], "t", "y", ["x"], lags, block).collect() == []


def test_fixed_effects_are_group_dummies(spark):
    r = random.Random(3)
    rows = [("g", k, k % 4, x := r.gauss(0, 1), 2.0 * x + 10 * (k % 4) + r.gauss(0, 0.1)) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, t long, hour int, x double, y double")
    fits = stats.regressions(stats.without_effects(df, ["g"], "hour", ["x", "y"]), ["g"], "t", "y", ["x"], 3, 10**6)
    (fit,) = fits.where("term = 'x'").collect()
    dummies = np.array([[row[3], *(float(row[2] == h) for h in range(4))] for row in rows])
    beta = np.linalg.lstsq(dummies, np.array([row[4] for row in rows]), rcond=None)[0]
    assert math.isclose(fit.beta, beta[0], rel_tol=1e-9)


def test_long_run_mean_equals_hac_mean(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(k % 3, k, r.gauss(1, 2)) for k in range(500)] + [(9, 1, 4.0)], "g int, t long, v double")
    a = {x.g: x for x in stats.hac_mean(df, ["g"], "t", "v", 7).collect()}
    b = {x.g: x for x in stats.long_run_mean(df, ["g"], "t", "v", 7, 31, 20).collect()}
    assert set(a) == set(b) and all(math.isclose(a[g].se, b[g].se, rel_tol=1e-9, abs_tol=1e-12) and a[g].n == b[g].n for g in a) and b[9].t is None


def test_volatility_spread_without_volatility_is_infinite(spark):
    rows = [("s", h * 3_600_000 + k * 1000, 100.0 if h < 15 else 100.0 + (k % 2)) for h in range(30) for k in range(60)]
    found = stats.volatility_coverage(spark.createDataFrame(rows, "symbol string, t long, px double"), ["symbol"], "t", "px", 3_600_000, 60, 24, 1.0).first()
    assert found.p10 == 0 and found.spread == float("inf")


def test_long_kernels_have_no_frame_that_is_summed_anew_for_each_row(spark):
    r = random.Random(6)
    values = [r.gauss(0, 1) for _ in range(150)]
    for n in (1, 2, 5, 61, 64, 200):
        want = [sum(values[max(0, i - n + 1) : i + 1]) for i in range(150)]
        assert np.allclose(stats.moving_sums(np.array(values), n), want, rtol=1e-12, atol=1e-12)
    df = spark.createDataFrame([("g", k, v, r.gauss(0, 1)) for k, v in enumerate(values)], "g string, t long, y double, x double")
    for found in (stats.regressions(df, ["g"], "t", "y", ["x"], 60, 40, 0, 70), stats.long_run_mean(df, ["g"], "t", "y", 60, 40, 70)):
        assert "-60" not in found._jdf.queryExecution().toString() and found.count()


def test_average_ranks_sort_each_side_once(spark):
    df = spark.createDataFrame([("g", x) for x in (3.0, 1.0, 3.0, 2.0, 3.0, 1.0)] + [("h", 5.0)], "g string, x double")
    found = stats.average_ranks(df, ["g"], "x", "r")
    assert sorted((q.g, q.x, q.r) for q in found.collect()) == [("g", 1.0, 1.5)] * 2 + [("g", 2.0, 3.0)] + [("g", 3.0, 5.0)] * 3 + [("h", 5.0, 1.0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1


def test_later_answers_all_times_in_one_join_in_time(spark):
    r = random.Random(9)
    at = {"S": sorted(r.sample(range(0, 900), 300)), "T": [5, 700]}
    rows = [(s, 1000 * t, float(k), -float(k)) for s, times in at.items() for k, t in enumerate(times)]
    df = spark.createDataFrame(rows, "symbol string, at long, a double, b double").repartition(4)
    asked = {"a_5": ("a", 5000), "a_300": ("a", 300_000), "a_before": ("a", -30_000), "b_last": ("b", -1), "b_30": ("b", 30_000)}
    found = depth.later(df, df, ["symbol"], asked, 60_000)
    got = {(x.symbol, x.at): x for x in found.collect()}
    assert len(got) == found.count() == len(rows)
    for symbol, t, _, _ in rows:
        own = [x for x in rows if x[0] == symbol]
        for name, (c, ms) in asked.items():
            held = [x for x in own if x[1] <= t + ms]
            want = held[-1][2 if c == "a" else 3] if held and t + ms <= own[-1][1] else None
            assert got[symbol, t][name] == want, (symbol, t, name)
    stale = {x.at: x.a_30 for x in depth.later(df, df, ["symbol"], {"a_30": ("a", 30_000)}, 60_000, 2000).where("symbol = 'S'").collect()}
    assert all((v is not None) == (1000 * at["S"][-1] >= t + 30_000 and any(0 <= t + 30_000 - 1000 * x <= 2000 for x in at["S"])) for t, v in stale.items())
    windows = lambda times: depth.later(df, df, ["symbol"], {f"a_{h}": ("a", h) for h in times}, 60_000)._jdf.queryExecution().optimizedPlan().toString().count("Window [")
    assert windows([5, 30, 300, -30, -1]) == windows([5]), "one time more is no join more"


def test_the_study_reads_no_curves_and_is_cut_at_thirds_of_its_records(spark, sf):
    records = study._records(spark, sf, None)
    assert not [c for c in records.columns if c.endswith(("_prices", "_values", "_bases"))]
    whole = study._records(spark, sf).select(*records.columns)
    assert records.exceptAll(whole).count() == 0 == whole.exceptAll(records).count()
    rows = study._observations(spark, sf).select("symbol", "at", "split").orderBy("at").collect()
    third = len(rows) // 3
    assert len(rows) == whole.count() and [x.split for x in rows] == ["dev"] * third + ["val"] * third + ["test"] * (len(rows) - 2 * third)
    few = spark.createDataFrame([("a", 1000), ("b", 1000), ("b", 2000), ("b", 3000)], "symbol string, at long")
    assert sorted(tuple(x) for x in study._thirds(few).collect()) == [("a", 1000, 1000), ("b", 2000, 3000)]
