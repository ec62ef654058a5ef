"""Panels: ordered rows of texts, each there only where the state of plan, feeds and context asks for it.

A layout is a list of parts, a part an array of rows that a predicate may leave out; the parts
are joined, cut at ROWS and numbered in one projection, so a panel of a million states is a
million rows of one task's work each, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeframe.functions import text
from tapeframe.operators import context, health, state

#: Rows that a panel has at most, and entries that its lists have at most.
ROWS, MOST = 76, 5
DETAILS = ("decision", "detailed", "debug")

# Words of the panel.
FOOTER = "DISCRETIONARY MODE · NO AUTO ENTRIES"
BLOCKED_CHART = "Non-standard chart type. Its prices are synthetic — switch on Use manual entry to size from a real price."
BLOCKED_INSTRUMENT = "Non-linear instrument — sizing assumes one quote unit per unit of price. Point value "
NOTIONAL = "Open interest feed looks USD-denominated. Positioning readings are switched off — point the OI input at a base-unit symbol."
SUPPRESSED = "A core data feed is missing or stale. Readings from it are suppressed."
SET_STOP = "SET STOP · enter your invalidation price in the settings"
SET_FILL = "SET ACTUAL FILL PRICE · the price you actually got, in Advanced — plan"
DERIVATIVES = {"oi6": "OI 24H", "oi1": "OI 4H *", "funding": "FUNDING", "premium": "PREMIUM *", "long_liq": "LONG LIQ *", "short_liq": "SHORT LIQ *"}
PARTICIPATION = {"spot_rvol": "SPOT RVOL *", "perp_rvol": "PERP RVOL *", "participation": "RELATIVE"}
CODES = {"oi24": "oi6", "oi4": "oi1", "prem": "premium", "fund": "funding", "etf": "etf", "part": "participation"}

c = F.col


def said(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _half(x: str | Column, digits: int) -> Column:
    """Rounded half away from zero in doubles, so that a value given to four digits rounds alike everywhere."""
    x = c(x) if isinstance(x, str) else x
    return F.signum(x) * F.floor(F.abs(x) * float(10**digits) + 0.5) / float(10**digits) + 0.0


def _num(x: Column, digits: int = 2) -> Column:
    return text.number(_half(x, digits), digits)


def _signed(x: Column, digits: int = 2) -> Column:
    return text.signed(_half(x, digits), digits)


def _percent(x: Column, digits: int = 2) -> Column:
    return F.when(x.isNull(), "n/a").otherwise(said(_signed(x * 100, digits), "%"))


def _price(x: Column) -> Column:
    return text.grouped(_half(x, 2))


def _money(x: Column, sign: bool = False) -> Column:
    return text.dollars(_half(x, 0), sign)


def _r(x: Column, sign: bool = False) -> Column:
    return text.r_units(_half(x, 2), sign)


def _ticked(name: str) -> Column:
    return _price(F.when(c("tick") > 0, F.floor(c(name) / c("tick") + 0.5) * c("tick")).otherwise(c(name)))


def _text(x: str | Column) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def row(kind: str, label: str | Column, value: str | Column = "", note: str | Column = "", when: Column | None = None) -> Column:
    """One row; null, and so left out, where `when` does not hold."""
    made = F.struct(F.lit(kind).alias("kind"), _text(label).alias("label"), _text(value).alias("value"), _text(note).alias("note"))
    return made if when is None else F.when(F.coalesce(when, F.lit(False)), made)


def laid_out(df: DataFrame, keys: list[str], parts: list[Column], most: int = ROWS) -> DataFrame:
    """keys, row (from 1), kind, label, value, note and class of the colour of each row of the panel of each row of df."""
    rows = F.slice(F.array_compact(F.concat(*parts)), 1, most)
    out = df.select(*keys, F.posexplode(rows).alias("at", "r")).select(*keys, (c("at") + 1).alias("row"), "r.*")
    shade = text.colour_class(F.when(c("kind") == "state", c("value")).otherwise(c("note")))
    return out.withColumn("class", F.when(c("kind").isin("state", "measure"), shade))


def _listed(items: str, make: Callable[[Column], Column], when: Column) -> Column:
    """Rows of a list, none where the list is missing or not asked for."""
    return F.transform(F.slice(F.coalesce(F.when(when, c(items)), F.array()), 1, MOST), make)


def watched(sentence: Column) -> Column:
    """The watch line: what is wrong with the data comes before anything that the data say."""
    return F.when(c("notional"), NOTIONAL).when(~c("core_ok"), SUPPRESSED).otherwise(sentence)


def _val3(raw: Column, m: str) -> Column:
    """Raw value, rank, deviations."""
    return F.concat_ws("  ", raw, text.rank(_half(c(m)["pct"], 1)), F.when(c(m)["z"].isNull(), "").otherwise(said(_signed(c(m)["z"]), "σ")))


def _decision(here: Column) -> list[Column]:
    plan, sized = c("has_plan"), c("has_plan") & c("ok")
    live, waiting = sized & c("active"), sized & ~c("active")
    market, stopped = here & ~plan, plan & ~c("fatal")
    r = lambda *a, when, kind="row": row(kind, *a, when=here & when)
    wide = lambda label, when: row("wide", label, when=here & when)
    context_line = F.concat_ws(" · ", c("trend_word"), F.when(c("vol_pct").isNull(), "vol n/a").otherwise(said(F.lower("vol_word"), " vol")), said("OI ", F.lower("pos_word")))
    net = F.when(c("target_net_r").isNull() | (c("target_gross_r") - c("target_net_r") < 0.10), "").otherwise(said(" · net ", _r(c("target_net_r"))))
    side = F.when(c("entry_px").isNull(), "Set a manual entry price.").otherwise(said("The stop is on the wrong side of entry for a ", F.lower("dir"), "."))
    blocked = F.when(F.abs(c("point_value") - 1) >= 1e-9, said(BLOCKED_INSTRUMENT, _num(c("point_value"), 4), ".")).otherwise(BLOCKED_CHART)
    stage = said(F.upper("dir"), " · ", F.when(c("active"), "ACTIVE").otherwise("PLANNING"))
    return [
        wide("MARKET CONTEXT", ~plan),
        wide(F.concat_ws(" · ", F.lit("4H CONTEXT"), c("health_word"), c("age")), ~plan),
        row("state", "MARKET", c("trend_word"), F.when(c("trend_known"), F.lower("trend_phrase")).otherwise(""), when=market),
        row("state", "VOLATILITY", c("vol_word"), F.when(c("atr_pct").isNull(), "").otherwise(said("ATR ", _num(c("atr_pct") * 100), "%")), when=market),
        row("state", "POSITIONING", c("pos_word"), F.when(c("oi6")["x"].isNull(), "").otherwise(said("OI ", _percent(c("oi6")["x"]), " / 24H")), when=market),
        r("WATCH", "", c("watch"), when=~plan & (F.length("watch") > 0)),
        wide(said("Chart is not the reference asset. Market context is always ", c("reference"), "."), ~plan & ~c("same_asset")),
        r("SET A PLAN", "", "Enable Trade plan to size a trade", when=~plan),
        wide("TRADE PLAN", plan), wide(stage, plan), wide(blocked, plan & c("fatal")),
        wide(SET_FILL, stopped & c("need_fill")), wide(SET_STOP, stopped & c("need_stop")),
        wide(side, stopped & ~c("need_fill") & ~c("need_stop") & ~c("side_ok")),
        r("LIVE", _r(c("live_r"), True), when=live),
        r("NET P&L", _money(c("live_net"), True), said("gross ", _money(c("live_gross"), True)), when=live),
        r("ENTRY", _ticked("entry_px"), F.when(c("entry_live"), "live").when(c("active"), "filled").otherwise("planned"), when=sized),
        r("STOP", _ticked("stop_px"), said(_num(c("stop_dist") / c("entry_px") * 100), "%"), when=sized),
        r("TARGET", _ticked("target_px"), said(_r(c("target_gross_r")), net), when=sized & c("target_ok")),
        r("TARGET", "not set", F.when(c("use_target"), "set a custom target price").otherwise(""), when=sized & ~c("target_ok")),
        r("TO STOP", _r(c("to_stop_r")), when=live), r("TO TARGET", _r(c("to_target_r")), when=live & c("target_ok")),
        r("PRICE→ENTRY", _r(c("to_entry_r"), True), said(_money(c("close") - c("entry_px"), True), " · ", _num((c("close") / c("entry_px") - 1) * 100), "%"), when=waiting & ~c("entry_live")),
        r("POSITION", _money(c("notional_usd")), said(_num(c("qty"), 4), " ", c("base")), when=sized),
        r("MAX LOSS", _money(c("actual_risk")), said(_num(c("actual_risk") / c("equity") * 100), "%", F.when(c("capped"), "  ·  SIZE CAPPED").otherwise("")), when=sized),
        r("", said("requested ", _money(c("budget"))), said("capped at ", _num(c("max_lev"), 1), "x equity"), when=sized & c("capped")),
        r("COST", _money(c("cost_stop")), said(_r(c("cost_load_r")), F.when(c("use_cost"), "  ·  in sizing").otherwise("  ·  not in sizing")), when=sized),
        r("BREAKEVEN", _ticked("break_even"), said(_num(c("break_even_bp"), 1), " bp"), when=sized),
        wide(said("Size is below this instrument's minimum order of ", _num(c("min_qty"), 8), "."), sized & c("too_small")),
        wide(said("Chart is not the reference asset. Market context is always ", c("reference"), "; the plan uses this chart's price."), sized & ~c("same_asset")),
        r("4H CONTEXT", "", context_line, when=plan), r("DATA", "", c("watch"), when=plan & (~c("core_ok") | c("notional"))),
        wide(FOOTER, F.lit(True)),
    ]


def _measure_rows(here: Column) -> tuple[list[Column], list[Column]]:
    m = lambda label, value, note: row("measure", label, value, note, when=here)
    raw = {"oi6": _percent(c("oi6")["x"]), "oi1": _percent(c("oi1")["x"]), "funding": _percent(c("funding")["x"], 4), "premium": _percent(c("premium")["x"], 4)}
    raw |= {k: text.compact(_half(c(k)["x"], 2)) for k in ("long_liq", "short_liq")} | {k: said(_num(c(k)["x"]), "x") for k in ("spot_rvol", "perp_rvol")} | {"participation": _signed(c("participation")["x"])}
    lack = {"oi6": "no OI", "oi1": "no OI", "premium": "no spot/ref", "spot_rvol": "no volume", "perp_rvol": "no volume", "participation": "no volume"}

    def line(k: str, label: str) -> Column:
        marked = said(c(k)["phrase"], " [σ]")
        if k not in lack:  # an adapter
            status, on = c(f"a_{k}"), c(f"on_{k}")
            return m(label, F.when(status >= 3, _val3(raw[k], k)).when(on, "check adapter").otherwise("adapter off"), F.when(status >= 3, marked).otherwise(state.feed_word(status, state.ADAPTER_WORDS)))
        known = c(k)["x"].isNotNull() & (c(k)["z"].isNotNull() if k.endswith("rvol") else F.lit(True))
        value = F.when(c(k)["x"].isNull(), lack[k]).otherwise(_val3(raw[k], k))
        if k == "oi6":
            value = F.when(c("notional"), said("REJECTED [", F.coalesce("currency", F.lit("?")), "]")).otherwise(value)
        return m(label, value, F.when(known, marked).otherwise("DATA UNAVAILABLE"))

    both = (c("a_long_liq") >= 3) & (c("a_short_liq") >= 3)
    balance = m(
        "LIQ BALANCE", F.when(both & c("paired"), _signed(c("balance"))).when(~both, "both sides needed").otherwise("declare shared unit"),
        F.when(~both, "DATA UNAVAILABLE").when(~c("paired"), "DATA INCOMPARABLE").when(c("balance") > 0, "MORE LONG LIQUIDATIONS").when(c("balance") < 0, "MORE SHORT LIQUIDATIONS").otherwise("BALANCED"),
    )
    etf = m(c("etf_label"), F.when(c("a_etf") >= 3, _val3(text.compact(_half(c("etf")["x"], 2)), "etf")).otherwise("check adapter"), F.when(c("a_etf") >= 3, said(c("etf")["phrase"], " [σ]")).otherwise(state.feed_word(c("a_etf"), state.ADAPTER_WORDS)))
    return [*[line(k, v) for k, v in DERIVATIVES.items()], balance, etf], [line(k, v) for k, v in PARTICIPATION.items()]


def _plan_rows(here: Column) -> list[Column]:
    plan, sized = c("has_plan"), c("has_plan") & c("ok")
    m = lambda label, value, note="", when=sized: row("measure", label, value, note, when=here & when)
    blocked = F.when(F.abs(c("point_value") - 1) >= 1e-9, said(BLOCKED_INSTRUMENT, _num(c("point_value"), 4), ".")).otherwise(BLOCKED_CHART)
    stage = said(F.when(c("active"), "ACTIVE").otherwise("PLANNING"), F.when(c("entry_live"), "  ·  live entry").when(c("active"), "  ·  actual fill").otherwise("  ·  manual entry"))
    share, away = said(_num(c("actual_risk") / c("equity") * 100), "% · ", _r(c("risk_r"))), said(_num(c("stop_dist") / c("entry_px") * 100), "% · ", _num(c("stop_dist") / c("atr")), " ATR")
    return [
        m("PLAN", "enable it in Trade plan", "NOT SET", ~plan), m("PLAN", blocked, "BLOCKED", plan & c("fatal")),
        m("PLAN", "entry and stop disagree with the direction", "INVALID", plan & ~c("fatal") & ~c("side_ok")),
        m("STAGE", stage, F.upper("dir")), m("ENTRY", _ticked("entry_px")),
        m("INVALIDATION", said(_ticked("stop_px"), "  (", away, ")"), F.when(c("use_atr_stop"), "ATR STOP").otherwise("MANUAL STOP")),
        m("TARGET", F.when(c("target_ok"), said(_ticked("target_px"), "  (Gross ", _r(c("target_gross_r")), " · Net ", _r(c("target_net_r")), ")")).otherwise("not set"), F.when(c("use_target"), "CUSTOM TARGET").otherwise("R MULTIPLE")),
        m("RISK PER UNIT", said(_num(c("risk_unit")), "  = stop ", _num(c("stop_dist")), " + cost ", _num(c("cost_unit"))), F.when(c("use_cost"), "COSTS IN SIZING").otherwise("COSTS EXCLUDED")),
        m("SIZE", said(_num(c("qty"), 4), " ", c("base"), "  (", _money(c("notional_usd")), ")"), F.when(c("too_small"), "BELOW MIN ORDER").otherwise("")),
        m("RISK", said(_money(c("actual_risk")), " = ", share, "  (asked ", _money(c("budget")), ")"), F.when(c("capped"), "SIZE CAPPED").otherwise("FULL BUDGET")),
        m("COST IF STOPPED", said(_money(c("cost_stop")), "  (", _r(c("cost_load_r")), ")")),
        m("BREAK-EVEN", said(_ticked("break_even"), "  (", _num(c("break_even_bp"), 1), " bp)")),
        m("REQUIRED LEVERAGE", said(_num(c("required_lev")), "x  (cap ", _num(c("max_lev"), 1), "x)"), F.when(c("capped"), "CAPPED").otherwise("WITHIN CAP")),
        m("1R / 2R / 3R", F.concat_ws(" / ", *[_ticked(f"r{k}") for k in (1, 2, 3)])),
        m("LIVE", said(_r(c("live_r"), True), "  ·  net ", _money(c("live_net"), True), "  ·  gross ", _money(c("live_gross"), True)), F.when(c("active"), "ACTIVE").otherwise("PLANNING")),
        m("DISTANCE", said("stop ", _r(c("to_stop_r")), F.when(c("target_ok"), said("  ·  target ", _r(c("to_target_r")))).otherwise(""), "  ·  entry ", _r(c("to_entry_r"), True))),
    ]


def age_text(ms: Column) -> Column:
    """How long ago the context's bar closed."""
    hours, minutes = F.floor(ms / 3_600_000), F.floor(ms % 3_600_000 / 60_000)
    return F.when(ms >= 0, said("closed ", F.when(hours > 0, said(hours.cast("string"), "h ")).otherwise(""), minutes.cast("string"), "m ago")).otherwise("live bar")


def issues() -> Column:
    """What is wrong with feeds and adapters, a line each."""
    word = lambda name, words=None: F.lower(state.feed_word(c(name), *([words] if words else [])))
    feeds = [
        F.when(c("notional"), F.lit("Open interest feed looks USD-denominated — OI readings off")),
        F.when(c("s_reference") < 3, said("Reference price ", word("s_reference"))), F.when(c("s_spot") < 3, said("Spot price ", word("s_spot"))),
        F.when((c("s_interest") < 3) & ~c("notional"), said("Open interest ", word("s_interest"))), F.when(c("s_daily") < 3, said("Daily 200MA ", word("s_daily", state.DAILY_WORDS))),
    ]
    names = {"funding": "Funding", "etf": "ETF", "long_liq": "Long liquidation", "short_liq": "Short liquidation"}
    old = [F.when(c(f"a_{k}") == 2, F.lit(f"{n} source may be stale")) for k, n in names.items()]
    pairing = F.when((c("a_long_liq") >= 3) & (c("a_short_liq") >= 3) & ~c("paired"), F.lit("Liquidation pairing not declared — balance withheld"))
    return F.concat_ws("\n", *[said("⚠ ", x) for x in (*feeds, *old, pairing)])


def _detailed(here: Column, debug: Column) -> list[Column]:
    derivatives, participation = _measure_rows(here)
    wide = lambda label, when=F.lit(True): row("wide", label, when=here & when)
    m = lambda label, value, note="": row("measure", label, value, note, when=here)
    d = lambda label, value, note: row("measure", label, value, note, when=debug)
    on = [c("a_funding"), c("a_etf"), c("a_long_liq"), c("a_short_liq")]
    unwired = F.concat_ws("\n", *[F.when(a == 1, F.lit(f"{n} source not connected")) for a, n in zip(on, ("Funding", "ETF", "Long liquidation", "Short liquidation"), strict=True)])
    direction = F.coalesce(F.signum("px6"), F.lit(0.0))
    codes = lambda names: F.concat_ws(" · ", *[said(f"{k} ", c(v).cast("string") if isinstance(v, str) else v) for k, v in names.items()])
    head = F.array(
        wide("MARKET CONTEXT — DETAILED"), wide(F.concat_ws(" · ", F.lit("4H CONTEXT"), c("health_word"), c("age"))),
        wide("RECENT EVENTS", F.size("events") > 0),
    )
    changed = F.array(
        wide("WHAT CHANGED — since the last confirmed 4H bar", F.length("changes") > 0), wide(c("changes"), F.length("changes") > 0),
        wide(said("CURRENT ANOMALIES: ", c("n_anomalies").cast("string")), c("n_anomalies") > 0),
    )
    rest = [
        wide("SETUP REQUIRED", F.length(unwired) > 0), wide(unwired, F.length(unwired) > 0),
        wide("MARKET MECHANICS — description, not implication"),
        m("PRICE 24H", _percent(c("px6")), F.when(direction > 0, "UP").when(direction < 0, "DOWN").otherwise("FLAT")),
        m("OI 24H", _val3(_percent(c("oi6")["x"]), "oi6"), F.when(c("oi6")["x"].isNull(), "DATA UNAVAILABLE").otherwise(said(c("oi6")["phrase"], " [σ]"))),
        wide(c("mech_label")), wide(c("mech_sentence"), F.length("mech_sentence") > 0), wide(c("mech_note")),
        wide("TREND / VOLATILITY — persistent regime"),
        m("TREND", F.when(c("trend_known"), said(_signed(c("trend_dist")), " ATR from 200D")).otherwise("no daily"), F.when(c("trend_known"), c("trend_phrase")).otherwise("DATA UNAVAILABLE")),
        m("VOLATILITY", said("ATR ", _percent(c("atr_pct")), "  ", text.rank(_half("vol_pct", 1))), F.when(c("vol_pct").isNull(), "DATA UNAVAILABLE").when(c("vol_word") == "Low", "COMPRESSED").otherwise(F.upper("vol_word"))),
        m("MOMENTUM 12W", F.when(c("momentum").isNull(), "no daily").otherwise(_percent(c("momentum"))), F.when(c("momentum").isNull(), "DATA UNAVAILABLE").when(c("momentum") > 0, "UP OVER 12 WEEKS").when(c("momentum") < 0, "DOWN OVER 12 WEEKS").otherwise("FLAT")),
        m("MARKET (combined)", said("200D ", F.when(c("trend_state") > 0, "above").when(c("trend_state") < 0, "below").otherwise("near"), " + 12W ", F.when(c("momentum").isNull(), "n/a").when(c("momentum") > 0, "up").when(c("momentum") < 0, "down").otherwise("flat")), c("trend_word")),
        wide("DERIVATIVES"), *derivatives,
        wide("PARTICIPATION — volume vs the same UTC slot on prior days"), *participation,
        wide("TRADE PLAN — mechanical arithmetic, not a signal"), *_plan_rows(here),
        wide("DATA HEALTH — timestamp-verified (lag is measured)"),
        m("Reference", c("reference"), state.feed_word(c("s_reference"))), m("Spot", c("spot_name"), state.feed_word(c("s_spot"))),
        m("Open interest", F.when(c("notional"), "REJECTED — looks USD").otherwise(c("oi_name")), F.when(c("notional"), "UNAVAILABLE").otherwise(state.feed_word(c("s_interest")))),
        m("Daily 200MA", "1D on reference", state.feed_word(c("s_daily"), state.DAILY_WORDS)),
        wide("DATA HEALTH — external adapters (update activity only, no upstream timestamp)"),
        m("External context", F.when(c("n_on") > 0, said(health.connected(*on).cast("string"), " of ", c("n_on").cast("string"), " connected")).otherwise("off"), F.when(c("n_on") > 0, "ENABLED").otherwise("NONE ENABLED")),
        m("Funding", F.when(c("on_funding"), c("funding_unit")).otherwise("off"), state.feed_word(c("a_funding"), state.ADAPTER_WORDS)),
        m("ETF flow", c("etf_shape"), state.feed_word(c("a_etf"), state.ADAPTER_WORDS)),
        m("Long liquidations", F.when(c("on_long_liq"), "adapter").otherwise("off"), state.feed_word(c("a_long_liq"), state.ADAPTER_WORDS)),
        m("Short liquidations", F.when(c("on_short_liq"), "adapter").otherwise("off"), state.feed_word(c("a_short_liq"), state.ADAPTER_WORDS)),
        m("Liq pairing", F.when(c("paired"), "declared same unit").otherwise("not declared"), F.when(c("paired"), "BALANCE ENABLED").otherwise("BALANCE WITHHELD")),
        wide(c("issue_text"), F.length("issue_text") > 0),
        row("wide", "DEBUG — internals; not a reading", when=debug),
        d("Valid samples", codes({k: c(v)["n_valid"].cast("string") for k, v in {"oi4": "oi1", "oi24": "oi6", "prem": "premium", "part": "participation"}.items()}), "n IN WINDOW"),
        d("Feed status codes", codes({"ref": "s_reference", "spot": "s_spot", "oi": "s_interest", "daily": "s_daily"}), "0..4"),
        d("Adapter status codes", codes({"fd": "a_funding", "etf": "a_etf", "liqL": "a_long_liq", "liqS": "a_short_liq"}), "0..4"),
        d("Intensity levels", codes({k: c(v)["level"].cast("string") for k, v in CODES.items()}), "0/1/2"),
        d("Regime codes", codes({"trSt": "trend_state", "oi24St": (c("oi6")["level"] * c("oi6")["sign"]).cast("string")}), "signed"),
        d("Exact z", codes({k: _signed(c(v)["z"]) for k, v in {"oi24": "oi6", "prem": "premium", "part": "participation"}.items()}), "σ, unrounded"),
        wide("CONTEXT IS DESCRIPTIVE   PLAN IS ARITHMETIC   NEITHER IS A SIGNAL"),
        wide(f"{FOOTER} · Direction from raw values, abnormality from percentiles."),
    ]
    event = lambda e: row("wide", e["age"], e["line"])
    odd = lambda e: row("measure", e["name"], said(text.rank(_half(e["pct"], 1)), "  ", _signed(e["z"]), "σ"))
    return [head, _listed("events", event, here), changed, _listed("anomalies", odd, here), F.array(*rest)]


def panels(states: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the panel of every state at every detail.

    A state has the words and numbers of the context, a struct for each measure (x, z, pct, n_valid,
    level, sign, phrase), statuses of feeds (s_) and adapters (a_, on_), lists of events and
    anomalies, and a plan's columns, null where has_plan is false. A state that lacks all of them
    still has its headings and footer.
    """
    rows = states.withColumn("issue_text", issues()).withColumn("watch", F.coalesce(watched(c("sentence")), F.lit("")))
    rows = rows.withColumn("health_word", F.when(~c("core_ok") | c("notional"), "DATA ISSUE").otherwise("DATA OK"))
    rows = rows.withColumn("detail", F.explode(F.array(*map(F.lit, DETAILS))))
    decision, debug = c("detail") == "decision", c("detail") == "debug"
    return laid_out(rows, [*keys, "detail"], [F.array(*_decision(decision)), *_detailed(~decision, debug)])


def plain(plans: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """The small table of a plan alone; plans carry trail (the extreme of the last n bars on the stop's side), high and low."""
    ok, up = c("ok"), c("sign") > 0
    lock = F.when(up, c("trail") > c("entry_px")).otherwise(c("trail") < c("entry_px"))
    pinned = c("entry") > 0
    pct = lambda x: said(_num(x * 100), "%")
    r = lambda label, value, when=ok: row("row", label, value, when=when)
    parts = [
        row("row", "PLAN AND RISK", F.upper("dir")), r("PLAN", "INVALID — stop is on the wrong side of entry", ~ok),
        r("ENTRY", said(_num(c("entry_px")), F.when(pinned, "  (pinned)").otherwise("  (live)"))),
        r("INVALIDATION", said(_num(c("stop_px")), "  (", pct(c("stop_dist") / c("entry_px")), ", ", _num(c("stop_dist") / c("atr"), 1), " ATR)")),
        r("RISK", said(pct(c("actual_risk") / c("equity")), " = ", _num(c("actual_risk")))),
        r("SIZE", said(_num(c("qty"), 6), "  (", _num(c("notional"), 0), ")")),
        r("EXPOSURE", said(_num(c("notional") / c("equity")), "x equity", F.when(c("capped"), "  CAPPED").otherwise(""))),
        r("", said("size capped at ", _num(c("max_lev"), 1), "x — actual risk ", pct(c("actual_risk") / c("equity")), " < ", pct(c("risk_pct") / 100)), ok & c("capped")),
        r("1R / 2R / 3R", F.concat_ws(" / ", *[_num(c(f"r{k}")) for k in (1, 2, 3)])),
        r(f"TRAIL REF ({n})", said(_num(c("trail")), F.when(lock, "  past entry").otherwise(""))),
        r("PRICE VS ENTRY", pct((c("close") - c("entry_px")) / c("entry_px")), ok & pinned),
        row("row", "BAR RANGE", said(_num((c("high") - c("low")) / c("atr"), 1), "x ATR14")),
        row("row", "EVIDENCE", "96 entry rules tested, 0 validated"), row("row", "", "sizes risk — does not predict"),
    ]
    return laid_out(plans, keys, [F.array(*parts)], 14).drop("kind", "note", "class")
