"""SQL of the derived tables, for the oracles: each is a common table expression."""

from __future__ import annotations

TAPE = "tape as (select event_type as symbol, epoch_us(ts) // 1000 as t, event_id as trade_id, value as px, (1 + user_id % 7)::double as qty, user_id % 2 = 0 as aggressive_buy, user_id from events)"


def bars(name: str, width: int) -> str:
    return f"""{name} as (select symbol, (t // {width}) * {width} as t, first(px order by t, trade_id) as open, max(px) as high, min(px) as low,
  last(px order by t, trade_id) as close, sum(qty) as volume, count(*) as trades from tape group by 1, 2)"""


B30, B1H, B4H, B1D = bars("b30m", 1_800_000), bars("b1h", 3_600_000), bars("b4h", 14_400_000), bars("b1d", 86_400_000)

DAILY = """daily as (select (epoch_ms(o_orderdate) // 86400000) * 86400000 as t, first(o_totalprice order by o_orderdate, o_orderkey) as open, max(o_totalprice) as high,
  min(o_totalprice) as low, last(o_totalprice order by o_orderdate, o_orderkey) as close, count(*)::double as volume from orders group by 1)"""

LEGS = """legs as (select leg, t, first(px order by o1, o2, o3, o4, o5, o6, o7) as open, max(px) as high, min(px) as low, last(px order by o1, o2, o3, o4, o5, o6, o7) as close, sum(qty) as volume
  from (select l_returnflag as leg, (epoch_ms(l_shipdate) // 86400000) * 86400000 as t, l_extendedprice / l_quantity as px, l_quantity as qty,
  l_shipdate as o1, l_orderkey as o2, l_linenumber as o3, l_partkey as o4, l_suppkey as o5, l_extendedprice as o6, l_quantity as o7 from lineitem) group by 1, 2)"""

SECONDS = "secs as (select symbol, t // 1000 as s, last(px order by t, trade_id) as px, last(qty order by t, trade_id) as qty, last(aggressive_buy order by t, trade_id) as aggressive_buy from tape group by 1, 2)"

LEVELS = """levels as (select case when p_retailprice < (select median(p_retailprice) from part) then 'bid' else 'ask' end as side, p_retailprice as price, sum(p_size)::double as qty from part group by 1, 2)"""

UPDATES = """updates as (select 'BOOK' as symbol, event_id as seq, epoch_us(ts) // 1000 as t, case when user_id % 2 = 0 then 'bid' else 'ask' end as side,
  case when user_id % 2 = 0 then 1000 - round(value) else 1001 + round(value) end as price, (user_id % 5)::double as qty from events)"""


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def with_(*parts: str, recursive: bool = False) -> str:
    return ("with recursive " if recursive else "with ") + ",\n".join(parts) + "\n"
