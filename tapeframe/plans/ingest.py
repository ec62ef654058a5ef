"""Queries on ingest: high-water marks, manifests, wire parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeframe.functions.columns import rounded
from tapeframe.plans import sqltext as q
from tapeframe.sources import io, tables


def _received(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades as received: some come twice, some late."""
    rows = tables.tape(spark, sf_dir).withColumn("kind", F.lit("trades")).withColumn("phase", F.when(F.col("trade_id") % 5 == 0, "warmup").otherwise("prospective"))
    rows = rows.withColumn("recvMs", F.col("t") + 5).withColumn("arrival", F.col("trade_id") * 10)
    late = rows.filter("trade_id % 53 = 0").withColumn("arrival", F.col("arrival") + 25)
    return rows.unionByName(late)


def ingest_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What restart-safe ingest keeps when ids up to 100 are already stored."""
    known = spark.createDataFrame([("trades", 100)], "kind string, high long")
    kept = io.advancing(_received(spark, sf_dir).select("kind", "arrival", "trade_id"), ["kind"], "arrival", "trade_id", known)
    return kept


def partition_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = io.manifest(_received(spark, sf_dir))
    return found.select("day", "kind", "events", "first_ms", "last_ms", F.col("phases")["warmup"].alias("n_warmup"), F.col("phases")["prospective"].alias("n_prospective"))


def wire_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades written as wire JSON, parsed with the explicit schema; malformed numbers become null."""
    t = tables.tape(spark, sf_dir)
    price = F.when(F.col("trade_id") % 101 == 0, F.lit("oops")).otherwise(F.col("px").cast("string"))
    wire = F.to_json(F.struct(F.col("trade_id").alias("a"), price.alias("p"), F.col("qty").cast("string").alias("q"), F.col("t").alias("T"), (~F.col("aggressive_buy")).alias("m"), F.lit("x").alias("extra")))
    parsed = t.select(F.from_json(wire, io.TRADE).alias("r")).select("r.*")
    return io.parsed_trades(parsed, "BTC").select("trade_id", "t", "px", "qty", rounded("quote").alias("quote"), "aggressive_buy")


def phase_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _received(spark, sf_dir).withColumn("schemaVersion", F.when(F.col("trade_id") % 2 == 0, "1").otherwise("2"))
    return io.of_version(rows, "prospective", "1").groupBy("symbol").agg(F.count("*").alias("n"), F.max("trade_id").alias("last_id"))


QUERIES = {f.__name__: f for f in (ingest_high_water, partition_manifest, wire_trades, phase_filter)}

_RX = "rx as (select *, 'trades' as kind, case when trade_id % 5 = 0 then 'warmup' else 'prospective' end as phase, t + 5 as recv, trade_id * 10 as arrival from tape), ra as (select * from rx union all select * replace (arrival + 25 as arrival) from rx where trade_id % 53 = 0)"
SQL = {
    "ingest_high_water": q.with_(q.TAPE, _RX) + "select kind, arrival, trade_id from (select *, greatest(coalesce(max(trade_id) over (order by arrival rows between unbounded preceding and 1 preceding), 0), 100) as b from ra) where trade_id > b",
    "partition_manifest": q.with_(q.TAPE, _RX) + "select strftime(make_timestamp(recv * 1000), '%Y-%m-%d') as day, kind, count(*) as events, min(recv) as first_ms, max(recv) as last_ms, nullif(count(*) filter (where phase = 'warmup'), 0) as n_warmup, nullif(count(*) filter (where phase = 'prospective'), 0) as n_prospective from ra group by 1, 2",
    "wire_trades": q.with_(q.TAPE) + f"select trade_id, t, case when trade_id % 101 <> 0 then px end as px, qty, {q.r('case when trade_id % 101 <> 0 then px * qty end')} as quote, aggressive_buy from tape",
    "phase_filter": q.with_(q.TAPE, _RX) + "select symbol, count(*) as n, max(trade_id) as last_id from ra where phase = 'prospective' and trade_id % 2 = 0 group by symbol",
}
