"""Queries on flows by the clock of their arrivals, on what smoothing does to states, and on a store of features."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeframe.functions.columns import DAY, bucket, rounded
from tapeframe.operators import context, smoothing, state as state_ops, windows
from tapeframe.plans import sqltext as q, state
from tapeframe.sources import shared, store, tables

#: Rows of the comparison, the fewest samples in it, and the rows after which a feed is old.
NORM, OLD = (60, 20), 12
#: The ladder that smoothed states climb, and the rows after an event in which it may still be met.
RUNGS, LAG = (1.0, 0.6, 2.0, 1.25), 2


def etf_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flow in three shapes on 4h bars: sum, label, sample, rarity among samples projected back to the bars, and the adapter's state.

    gated has the volume of two bars of three, repeated the day's first volume, increments the volume, missing on every fourth.
    """
    c = F.col
    rows = tables.bars(spark, sf_dir, "4h").withColumn("day", bucket("t", DAY))
    rows = rows.withColumn("first", F.first("volume").over(W.partitionBy("symbol", "day").orderBy("t")))
    values = {"gated": F.when(c("trades") % 3 != 0, c("volume")), "repeated": c("first"), "increments": F.when(c("trades") % 4 != 0, c("volume"))}
    rows = rows.select("symbol", "t", "close", F.explode(F.array(*[F.struct(F.lit(k).alias("shape"), v.alias("src")) for k, v in values.items()])).alias("f")).select("symbol", "t", "close", "f.*")
    keys = ["symbol", "shape"]
    w = windows.by(*keys)
    flow, label, sample = context.etf_flow(c("src"), c("shape"), w)
    rows = rows.withColumns({"flow": flow, "label": label, "sample": sample})
    off = F.coalesce(F.abs(c("src") - c("close")) > 0, F.lit(False))
    rows = rows.withColumn("wired", state_ops.ever(off, 50, w)).withColumn("absent", state_ops.ever(c("src").isNull(), 200, w))
    rows = state_ops.since_value(state_ops.unchanged(rows, keys, "src", "held"), keys, "src", "age")
    gated = state_ops.gated_status(F.lit(True), c("wired") | c("absent"), c("age"), OLD)
    status = F.when(c("shape") == "gated", gated).otherwise(state_ops.adapter_status(F.lit(True), c("src"), c("wired"), c("held"), OLD))
    found = windows.valid_norm(rows.withColumn("status", status), keys, "sample", n=NORM[0], least=NORM[1], current="flow")
    word = state_ops.feed_word(c("status"), state_ops.ADAPTER_WORDS)
    return found.select(*keys, "t", rounded("flow", 4).alias("flow"), "label", rounded("sample", 4).alias("sample"), "n_valid", rounded("z", 4).alias("z"), rounded("pct", 4).alias("pct"), "status", word.alias("word"))


def _smoothed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = shared.cut(smoothing.states(state._z(spark, sf_dir), ["symbol"], RUNGS))
    return smoothing.label_runs(found, ["symbol"]), smoothing.tiers(found, ["symbol"], LAG)


def smoothing_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each candidate of smoothing keeps, delays and flattens of the raw events of each tier."""
    _, found = _smoothed(spark, sf_dir)
    return found.select("symbol", "taps", "tier", "n_events", *[rounded(x, 4).alias(x) for x in ("retention", "median_delay", "late_delay", "attenuation")])


def smoothing_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, false flips and gates of each candidate, and the least smoothing that passes."""
    found = smoothing.choice(*_smoothed(spark, sf_dir), ["symbol"], RUNGS[0])
    return found.select("symbol", "taps", "n_runs", "median_run", "n_episodes", "n_false", rounded("least_retention", 4).alias("least_retention"), "duration_ok", "delay_ok", "retention_ok", "passes", "chosen")


def feature_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4h bars written to a store by day and read back, every file verified."""
    path = f"{shared.folder(spark)}/store-{uuid.uuid4().hex}"
    columns = ["symbol", "t", "close", "volume", "trades"]
    bars = tables.bars(spark, sf_dir, "4h").withColumn("date", F.date_format(F.timestamp_millis("t"), "yyyy-MM-dd"))
    store.append(bars, path, "fs1", columns)
    return store.read(spark, path, "fs1", columns).select(*columns, "date")


QUERIES = {f.__name__: f for f in (etf_flows, smoothing_tiers, smoothing_choice, feature_store)}

_V = "(values (1), (2), (3), (4)) v(k)"
_S = f"""zv as (select symbol, i, z, row_number() over (partition by symbol order by i) as j from zz where z is not null),
em as (select symbol, k, j, z as s from zv, {_V} where j = 1 union all select e.symbol, e.k, v.j, e.s + 2.0::double / (e.k + 1) * (v.z - e.s) from em e join zv v on v.symbol = e.symbol and v.j = e.j + 1),
ss as (select z.symbol, v.k as taps, z.i, z.z, {q.r('e.s')} as s from zz z cross join {_V} left join zv on zv.symbol = z.symbol and zv.i = z.i left join em e on e.symbol = zv.symbol and e.j = zv.j and e.k = v.k),
sl as (select *, case when s is null then 0 when abs(s) >= 2.0 then 2 when abs(s) >= 1.0 then 1 else 0 end as level from ss where i = 1
 union all select n.symbol, n.taps, n.i, n.z, n.s, case when n.s is null or abs(n.s) < 0.6 then 0 when abs(n.s) >= 2.0 then 2 when l.level = 2 then case when abs(n.s) < 1.25 then 1 else 2 end when l.level = 1 or abs(n.s) >= 1.0 then 1 else 0 end from sl l join ss n on n.symbol = l.symbol and n.taps = l.taps and n.i = l.i + 1),
la as (select *, level * coalesce(sign(s), 0)::int as label from sl), lb as (select *, label is distinct from lag(label) over w as a, (level > 0) is distinct from (lag(level) over w > 0) as b from la window w as (partition by symbol, taps order by i)),
lc as (select *, sum(a::int) over w as run, sum(b::int) over w as episode from lb window w as (partition by symbol, taps order by i)),
lr as (select symbol, taps, count(*) as n_runs, quantile_cont(n, 0.5) as median_run from (select symbol, taps, run, count(*) as n from lc where level > 0 group by all) group by all),
le as (select symbol, taps, count(*) as n_episodes, count(*) filter (where n = 1) as n_false from (select symbol, taps, episode, count(*) as n from lc where level > 0 group by all) group by all),
ta as (select l.*, tier, coalesce(abs(z) >= tier, false) as hit from sl l, (values (1.0::double), (1.5), (2.0), (2.5)) r(tier)), tb as (select *, hit and not coalesce(lag(hit) over (partition by symbol, taps, tier order by i), false) as starts from ta),
tc as (select *, sum(starts::int) over (partition by symbol, taps, tier order by i) as event from tb), td as (select symbol, taps, tier, event, min(i) as f, max(i) as l, max(abs(s)) / max(abs(z)) as flat from tc where hit group by all),
te as (select td.*, (select min(x.i) from sl x where x.symbol = td.symbol and x.taps = td.taps and x.level > 0 and x.i >= td.f and x.i <= td.l + {LAG}) as met from td),
tg as (select symbol, taps, tier, count(*) as n_events, avg((met is not null)::int) as retention, quantile_cont(met - f, 0.5) as median_delay, quantile_cont(met - f, 0.9) as late_delay, quantile_cont(flat, 0.5) as attenuation from te group by all)"""
_SM = q.with_(q.TAPE, q.B4H, state._Z, _S, recursive=True)
SQL = {
    "etf_flows": q.with_(q.TAPE, q.B4H, recursive=True)
    + f""", v0 as (select *, row_number() over (partition by symbol order by t) as i, first(volume) over (partition by symbol, t // 86400000 order by t) as fv from b4h),
v as (select symbol, t, close, i, unnest([{{'shape': 'gated', 'src': case when trades % 3 <> 0 then volume end}}, {{'shape': 'repeated', 'src': fv}}, {{'shape': 'increments', 'src': case when trades % 4 <> 0 then volume end}}]) as f from v0),
r as (select symbol, t, close, i, f.shape as shape, f.src as src from v), k as (select a.symbol, a.i, b.src as x, row_number() over (partition by a.symbol, a.i order by b.i desc) as n from r a join r b on a.shape = 'gated' and b.shape = 'gated' and a.symbol = b.symbol and b.i between a.i - 89 and a.i and b.src is not null),
g as (select symbol, i, sum(x) as last5 from k where n <= 5 group by symbol, i having count(*) = 5),
h as (select r.*, case shape when 'gated' then last5 when 'repeated' then src + lag(src, 6) over w + lag(src, 12) over w + lag(src, 18) over w + lag(src, 24) over w else sum(coalesce(src, 0)) over (partition by symbol, shape order by t rows between 29 preceding and current row) end as flow,
 count(*) over c = 50 and max(case when abs(src - close) > 0 then 1 else 0 end) over c = 1 as wired, count(*) over d = 200 and max((src is null)::int) over d = 1 as absent, i - coalesce(max(case when src is not null then i end) over w, -999) as age
 from r left join g using (symbol, i) window w as (partition by symbol, shape order by t), c as (partition by symbol, shape order by t rows between 49 preceding and current row), d as (partition by symbol, shape order by t rows between 199 preceding and current row)),
u as (select symbol, shape, i, src, 999::bigint as held from r where i = 1 union all select n.symbol, n.shape, n.i, n.src, case when n.src is null or u.src is null then u.held when n.src <> u.src then 0 else u.held + 1 end from u join r n on n.symbol = u.symbol and n.shape = u.shape and n.i = u.i + 1),
s as (select h.*, case when shape <> 'gated' or h.src is not null then flow end as sample, case when shape = 'gated' then case when not (wired or absent) then 1 when age > {OLD} then 2 when age >= 1 then 3 else 4 end when h.src is null then 0 when not wired then 1 when held > {OLD} then 2 when held > 0 then 3 else 4 end as status from h join u using (symbol, shape, i)),
n as (select a.symbol, a.shape, a.t, a.flow, a.sample, a.status, count(b.sample) as n_valid, case when a.flow is not null and count(b.sample) >= {NORM[1]} then case when stddev_pop(b.sample) > 0 then (a.flow - avg(b.sample)) / stddev_pop(b.sample) else 0 end end as z,
 case when a.flow is not null and count(b.sample) >= {NORM[1]} then count(*) filter (where b.i < a.i and b.sample <= a.flow) * 100.0::double / (count(b.sample) - 1) end as pct
 from s a join s b on a.symbol = b.symbol and a.shape = b.shape and b.i between a.i - {NORM[0] - 1} and a.i group by a.symbol, a.shape, a.t, a.i, a.flow, a.sample, a.status)
select symbol, shape, t, {q.r('flow', 4)} as flow, case shape when 'gated' then 'ETF LAST 5 OBS' when 'repeated' then 'ETF 5 CAL-DAY' else 'ETF 30-BAR SUM' end as label, {q.r('sample', 4)} as sample, n_valid, {q.r('z', 4)} as z, {q.r('pct', 4)} as pct, status,
 case status when 4 then 'ACTIVE' when 3 then 'UNCHANGED 1 BAR' when 2 then 'LIKELY STALE' when 1 then 'MISCONFIGURED' else 'UNAVAILABLE' end as word from n""",
    "smoothing_tiers": _SM + f"select symbol, taps, tier, n_events, {q.r('retention', 4)} as retention, {q.r('median_delay', 4)} as median_delay, {q.r('late_delay', 4)} as late_delay, {q.r('attenuation', 4)} as attenuation from tg",
    "smoothing_choice": _SM
    + f""", m as (select symbol, taps, min(retention) as rt, max(case when tier = 1 then median_delay end) as md, max(case when tier = 1 then late_delay end) as ld from tg group by all),
p as (select symbol, taps, n_runs, median_run, n_episodes, n_false, {q.r('rt', 4)} as least_retention, median_run >= 3 as duration_ok, coalesce(md <= 1 and ld <= 2, false) as delay_ok, coalesce(rt >= 0.9, false) as retention_ok from lr join le using (symbol, taps) left join m using (symbol, taps))
select *, duration_ok and delay_ok and retention_ok as passes, min(case when duration_ok and delay_ok and retention_ok then taps end) over (partition by symbol) as chosen from p""",
    "feature_store": q.with_(q.TAPE, q.B4H) + "select symbol, t, close, volume, trades, strftime(make_timestamp(t * 1000), '%Y-%m-%d') as date from b4h",
}
