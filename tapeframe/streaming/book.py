"""Structured Streaming: books from update streams, restart-safe ingest, bars."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import fields

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeframe.functions.columns import DAY
from tapeframe.operators.book import BOOK_ROW, FEATURES, Book, Sampler, fed

EVENT = "symbol string, arrival long, kind string, first_id long, last_id long, prev_id long, levels array<struct<side:string,price:double,qty:double>>"
TIMED = EVENT + ", recv_ms long"
OUTPUT = "symbol string, arrival long, " + BOOK_ROW
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class BookProcessor(StatefulProcessor):
    """Keeps one book per symbol; emits its state after each event, in order of arrival.

    Levels are a map state of which a batch writes those it changed. A book of which nothing
    came for stale_ms of processing time is invalidated by a timer; each batch replaces the
    timer of the one before.
    """

    def __init__(self, stale_ms: int = 0):
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scalars = handle.getValueState("scalars", "text string, seen long")
        self.levels = handle.getMapState("levels", "side string, price double", "qty double")

    def _load(self) -> tuple[Book, int | None]:
        if not self.scalars.exists():
            return Book(), None
        text, seen = self.scalars.get()
        book = Book(**json.loads(text))
        for (side, price), (qty,) in self.levels.iterator():
            (book.bids if side == "bid" else book.asks).set(price, qty)
        self.before = {"bid": dict(book.bids.qty), "ask": dict(book.asks.qty)}
        return book, seen

    def _save(self, book: Book, seen: int | None, before: dict) -> None:
        for side, ladder in (("bid", book.bids), ("ask", book.asks)):
            for price in before.get(side, {}).keys() - ladder.qty.keys():
                self.levels.removeKey((side, price))
            for price, qty in ladder.qty.items() - before.get(side, {}).items():
                self.levels.updateValue((side, price), (qty,))
        scalars = {f.name: getattr(book, f.name) for f in fields(book) if f.name not in ("bids", "asks")}
        self.scalars.update((json.dumps(scalars), seen))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.before: dict = {}
        (book, _), out = self._load(), []
        for row in pd.concat(list(rows)).sort_values("arrival").to_dict("records"):
            fed(book, row["kind"], row)
            out.append({"symbol": key[0], "arrival": row["arrival"]} | book.row())
        now = timerValues.getCurrentProcessingTimeInMs() if self.stale_ms else None
        self._save(book, now, self.before)
        if now is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now + self.stale_ms)
        yield _typed(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.before = {}
        book, seen = self._load()
        if seen is None or seen + self.stale_ms > expiredTimerInfo.getExpiryTimeInMs():  # a later batch has its own timer
            return
        book.invalidate("stale")
        self._save(book, seen, self.before)
        yield _typed([{"symbol": key[0], "arrival": -1} | book.row()])

    def close(self) -> None:
        pass


def _typed(rows: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(rows)
    frame["last_id"] = frame["last_id"].astype("Int64")
    return frame


def books(events: DataFrame, stale_ms: int = 0) -> DataFrame:
    """The stream of book states of a stream of EVENT rows. Needs the RocksDB state store."""
    return events.groupBy("symbol").transformWithStateInPandas(BookProcessor(stale_ms), OUTPUT, "Append", "ProcessingTime" if stale_ms else "None")


class FeatureProcessor(BookProcessor):
    """Emits FEATURES at each second of receipt time while a symbol's book is valid and fresh."""

    def __init__(self, every_ms: int, stale_ms: int):
        super().__init__(0)
        self.every_ms, self.limit_ms = every_ms, stale_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.before: dict = {}
        book, seen = self._load()
        sampler, out = Sampler(book, self.every_ms, self.limit_ms, seen), []
        for row in pd.concat(list(rows)).sort_values("arrival").to_dict("records"):
            out += [(key[0], *found) for found in sampler.feed(row)]
        self._save(book, sampler.last_ms, self.before)
        yield pd.DataFrame(out, columns=["symbol", "at", *[c.split()[0] for c in FEATURES.split(", ")]])


def second_features(events: DataFrame, every_ms: int = 1000, stale_ms: int = 5000) -> DataFrame:
    """symbol, at, FEATURES of a stream of TIMED rows, as the batch operator of this name gives them."""
    return events.groupBy("symbol").transformWithStateInPandas(FeatureProcessor(every_ms, stale_ms), f"symbol string, at long, {FEATURES}", "Append", "None")


class HighWater(StatefulProcessor):
    """Passes rows whose id is above all ids that arrived before, across restarts."""

    def __init__(self, identifier: str, order: str, columns: list[str]):
        self.identifier, self.order, self.columns = identifier, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.high = handle.getValueState("high", "id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        high = self.high.get()[0] if self.high.exists() else None
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        frame = frame[frame[self.identifier].notna()]
        before = frame[self.identifier].cummax().shift()
        if high is not None:
            before = before.fillna(high).clip(lower=high)
        frame = frame[before.isna() | (frame[self.identifier] > before)]
        if len(frame):
            self.high.update((int(frame[self.identifier].max()),))
            yield frame[self.columns]

    def close(self) -> None:
        pass


def advancing(rows: DataFrame, key: str, identifier: str, order: str) -> DataFrame:
    """Restart-safe deduplication of a stream by an id, in the order of arrival: after 5 a 3 is dropped.

    order: a column that grows with arrival, such as the time of receipt or an offset.
    """
    return rows.groupBy(key).transformWithStateInPandas(HighWater(identifier, order, rows.columns), rows.schema, "Append", "None")


def flow(trades: DataFrame, widths: dict[str, str], every: str, delay: str) -> DataFrame:
    """Sliding flow of a stream of (symbol, ts, px, qty, aggressive_buy): for each width of `widths`
    (name: duration) a row per window that ends on a multiple of `every`, once the watermark has passed it."""
    quote = F.col("px") * F.col("qty")
    out = None
    for name, width in widths.items():
        grouped = trades.withWatermark("ts", delay).groupBy("symbol", F.window("ts", width, every))
        one = grouped.agg(F.sum(F.when(F.col("aggressive_buy"), quote).otherwise(0.0)).alias("buy"), F.sum(F.when(~F.col("aggressive_buy"), quote).otherwise(0.0)).alias("sell"), F.count("*").alias("n"))
        one = one.select("symbol", F.lit(name).alias("width"), F.col("window.end").alias("at"), "buy", "sell", "n")
        out = one if out is None else out.unionByName(one)
    total = F.col("buy") + F.col("sell")
    return out.withColumn("afi", F.when(total > 0, (F.col("buy") - F.col("sell")) / total).otherwise(0.0))


def bars(trades: DataFrame, width: str, delay: str) -> DataFrame:
    """Streaming bars of (symbol, ts, trade_id, px, qty), emitted when the watermark has passed them."""
    order = F.struct("ts", "trade_id")
    grouped = trades.withWatermark("ts", delay).groupBy("symbol", F.window("ts", width))
    return grouped.agg(F.min_by("px", order).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", order).alias("close"), F.sum("qty").alias("volume")).select("symbol", F.col("window.start").alias("t"), "open", "high", "low", "close", "volume")


def alerts(batch: DataFrame, path: str, epoch: int) -> None:
    """foreachBatch sink that writes each (t, text) once, also across epochs and restarts.

    Alerts lie by day and epoch. A batch reads the days between its first and its last t only, so what it
    reads doesn't grow with the age of the log; run again, it overwrites what it wrote.
    """
    spark = batch.sparkSession
    new = batch.dropDuplicates(["t", "text"]).withColumn("day", F.floor(F.col("t") / DAY).cast("long")).withColumn("epoch", F.lit(epoch).cast("long"))
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
        first, last = new.agg(F.min("day"), F.max("day")).first()
        old = spark.read.schema(new.schema).option("basePath", path).parquet(path).filter((F.col("epoch") < epoch) & F.col("day").between(first, last))
        new = new.join(old.select("t", "text"), ["t", "text"], "left_anti")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "epoch").parquet(path)


def run_to_end(spark: SparkSession, stream: DataFrame, path: str) -> None:
    """Runs a stream over all there is and stops; output and checkpoint go below path."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
