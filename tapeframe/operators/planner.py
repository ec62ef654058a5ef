"""Position arithmetic: sizes, costs, break-even, targets and live results of a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeframe.functions.columns import half_up

#: Plan inputs and their defaults; a plan table has these columns and any others.
DEFAULTS = {
    "dir": "Long", "active": False, "entry": 0.0, "fill": 0.0, "stop": 0.0, "use_atr_stop": False, "atr_mult": 1.5, "target": 0.0, "use_target": False, "target_r": 2.0,
    "equity": 10_000.0, "risk_pct": 1.0, "risk_cash": 0.0, "fixed_cash": False, "max_lev": 1.0, "use_cost": True, "entry_bp": 5.0, "exit_bp": 5.0, "min_qty": 0.0, "tick": 0.0,
    "standard_chart": True, "point_value": 1.0,
}


def planned(rows: DataFrame) -> DataFrame:
    """rows (plan inputs, close, atr) with entry, stop, states, sizes, costs and results.

    A stop on the wrong side voids the plan, it never flips; what a void plan leaves
    undefined is null. R is the gross distance to the stop.
    """
    c = F.col
    positive = lambda name: F.when(c(name) > 0, c(name))
    long = c("dir") == "Long"
    out = rows.withColumn("sign", F.when(long, 1.0).otherwise(-1.0)).withColumn("entry_live", ~c("active") & (c("entry") <= 0))
    out = out.withColumn("entry_px", F.when(c("active"), positive("fill")).otherwise(F.coalesce(positive("entry"), c("close"))))
    out = out.withColumn("stop_px", F.when(c("use_atr_stop"), c("entry_px") - c("sign") * c("atr_mult") * c("atr")).otherwise(positive("stop")))
    out = out.withColumn("need_fill", c("active") & c("entry_px").isNull())
    out = out.withColumn("need_stop", ~c("need_fill") & c("entry_px").isNotNull() & c("stop_px").isNull())
    linear = c("point_value").isNull() | (F.abs(c("point_value") - 1) < 1e-9)
    out = out.withColumn("fatal", (~c("standard_chart") & c("entry_live")) | ~linear)
    side = F.when(long, c("stop_px") < c("entry_px")).otherwise(c("stop_px") > c("entry_px"))
    out = out.withColumn("side_ok", F.coalesce(side, F.lit(False))).withColumn("ok", ~c("fatal") & c("side_ok"))
    ok = lambda x: F.when(c("ok"), x)
    rate = lambda name: F.when(c("use_cost"), c(name) / 10_000).otherwise(0.0)
    steps: list[tuple[str, Column]] = [
        ("e_rate", rate("entry_bp")), ("x_rate", rate("exit_bp")),
        ("stop_dist", ok(F.abs(c("entry_px") - c("stop_px")))),
        ("cost_unit", ok(c("entry_px") * c("e_rate") + c("stop_px") * c("x_rate"))),
        ("risk_unit", c("stop_dist") + c("cost_unit")),
        ("budget", F.when(c("fixed_cash"), c("risk_cash")).otherwise(c("equity") * c("risk_pct") / 100)),
        ("qty_raw", c("budget") / c("risk_unit")),
        ("qty_cap", ok(c("max_lev") * c("equity") / c("entry_px"))),
        ("qty", F.when(c("qty_raw").isNotNull(), F.least("qty_raw", "qty_cap"))),
        ("capped", F.coalesce(c("qty_raw") > c("qty_cap"), F.lit(False))),
        ("notional", c("qty") * c("entry_px")), ("actual_risk", c("qty") * c("risk_unit")), ("required_lev", c("qty_raw") * c("entry_px") / c("equity")),
        ("risk_r", c("risk_unit") / c("stop_dist")), ("cost_load_r", c("cost_unit") / c("stop_dist")), ("cost_stop", c("qty") * c("cost_unit")),
        ("break_even", ok(F.when(long, c("entry_px") * (1 + c("e_rate")) / (1 - c("x_rate"))).otherwise(c("entry_px") * (1 - c("e_rate")) / (1 + c("x_rate"))))),
        ("break_even_bp", F.abs(c("break_even") - c("entry_px")) / c("entry_px") * 10_000),
        *[(f"r{k}", c("entry_px") + c("sign") * k * c("stop_dist")) for k in (1, 2, 3)],
        ("target_px", ok(F.when(c("use_target"), positive("target")).otherwise(c("entry_px") + c("sign") * c("target_r") * c("stop_dist")))),
        ("target_ok", F.coalesce(F.when(long, c("target_px") > c("entry_px")).otherwise(c("target_px") < c("entry_px")), F.lit(False))),
        ("target_gross_r", F.when(c("target_ok"), F.abs(c("target_px") - c("entry_px")) / c("stop_dist"))),
        ("target_cost", F.when(c("target_ok"), c("entry_px") * c("e_rate") + c("target_px") * c("x_rate"))),
        ("target_net_r", c("target_gross_r") - c("target_cost") / c("stop_dist")),
        ("target_pnl", F.when(c("target_ok"), c("qty") * (F.abs(c("target_px") - c("entry_px")) - c("target_cost")))),
        ("live_r", c("sign") * (c("close") - c("entry_px")) / c("stop_dist")),
        ("live_gross", c("qty") * c("sign") * (c("close") - c("entry_px"))),
        ("live_net", c("live_gross") - c("qty") * (c("entry_px") * c("e_rate") + c("close") * c("x_rate"))),
        ("to_stop_r", F.abs(c("close") - c("stop_px")) / c("stop_dist")),
        ("to_target_r", F.when(c("target_ok"), F.abs(c("target_px") - c("close")) / c("stop_dist"))),
        ("to_entry_r", (c("close") - c("entry_px")) / c("stop_dist")),
        ("too_small", F.coalesce((c("min_qty") > 0) & (c("qty") < c("min_qty")), F.lit(False))),
        ("entry_ticked", F.when(c("tick") > 0, half_up("entry_px", c("tick"))).otherwise(c("entry_px"))),
    ]
    for name, value in steps:
        out = out.withColumn(name, value)
    return out


def zones(plans: DataFrame, bars: int = 16) -> DataFrame:
    """Edges of the risk and reward zones of valid plans and how many bars they reach."""
    reward = F.when(F.col("target_ok"), F.col("target_px"))
    return plans.withColumn("risk_top", F.greatest("entry_px", "stop_px")).withColumn("risk_bottom", F.least("entry_px", "stop_px")).withColumn("reward_top", F.greatest(F.col("entry_px"), reward)).withColumn("reward_bottom", F.least(F.col("entry_px"), reward)).withColumn("extent", F.lit(bars))


def grid(spark, plans: list[dict]) -> DataFrame:
    """A plan table from dictionaries over DEFAULTS, numbered."""
    rows = [{"plan": k} | DEFAULTS | p for k, p in enumerate(plans)]
    kinds = {bool: "boolean", float: "double", str: "string", int: "int"}
    schema = ", ".join(f"{name} {kinds[type(value)]}" for name, value in ({"plan": 0} | DEFAULTS).items())
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema)


def trailing_reference(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """rows with trail_long and trail_short: extremes of the n rows before, and lock_long: the best of them so far."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy("t")
    before = w.rowsBetween(-n, -1)
    full = F.count("*").over(before) == n
    out = rows.withColumn("trail_long", F.when(full, F.min("low").over(before))).withColumn("trail_short", F.when(full, F.max("high").over(before)))
    return out.withColumn("lock_long", F.max("trail_long").over(w.rowsBetween(W.unboundedPreceding, 0)))
