"""Readers and writers of captured data: NDJSON partitions, zipped CSV, paged feeds, manifests, seals."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LEVELS = T.ArrayType(T.ArrayType(T.StringType()))

#: Explicit schemas of the wire records; unknown fields are ignored.
DEPTH = T.StructType(
    [T.StructField("e", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("E", "T", "U", "u", "pu")], T.StructField("b", LEVELS), T.StructField("a", LEVELS), T.StructField("recvMs", T.LongType()), T.StructField("phase", T.StringType())]
)
TRADE = T.StructType(
    [T.StructField("a", T.LongType()), T.StructField("p", T.StringType()), T.StructField("q", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("f", "l", "T", "E")], T.StructField("m", T.BooleanType()), T.StructField("recvMs", T.LongType()), T.StructField("phase", T.StringType())]
)
META = T.StructType(
    [
        T.StructField("type", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("at", "recvMs", "attempt", "delayMs", "ageMs", "lastUpdateId", "bids", "asks", "applied", "expected", "got")],
        *[T.StructField(n, T.StringType()) for n in ("phase", "stream", "reason", "note", "error")],
    ]
)


# ---------------------------------------------------------------- NDJSON partitions


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of date=../kind=.. partitions; lines that do not parse are dropped, as are torn last lines."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("basePath", path).json(path)


def write_ndjson(df: DataFrame, path: str, received: str = "recvMs", kind: str = "kind") -> None:
    """Appends gzip NDJSON, partitioned by the UTC day of receipt and kind."""
    dated = df.withColumn("date", F.to_date(F.timestamp_millis(received)).cast("string"))
    dated.write.mode("append").partitionBy("date", kind).option("compression", "gzip").json(path)


def stream_ndjson(df: DataFrame, path: str, checkpoint: str, received: str = "recvMs", kind: str = "kind") -> None:
    """Appends all that a stream has to the partitions that write_ndjson makes; its checkpoint keeps a restart from writing rows again."""
    dated = df.withColumn("date", F.to_date(F.timestamp_millis(received)).cast("string"))
    sink = dated.writeStream.format("json").partitionBy("date", kind).option("compression", "gzip").option("path", path).option("checkpointLocation", checkpoint)
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def levels(column: str, side: str):
    """Price-quantity string pairs as structs; what is no number is null."""
    return F.transform(F.coalesce(F.col(column), F.array().cast(LEVELS.simpleString())), lambda x: F.struct(F.lit(side).alias("side"), x[0].try_cast("double").alias("price"), x[1].try_cast("double").alias("qty")))


def parsed_depth(raw: DataFrame, symbol: str) -> DataFrame:
    """Wire depth updates as events of the book's sequence machine."""
    return raw.select(F.lit(symbol).alias("symbol"), F.lit("update").alias("kind"), F.col("U").alias("first_id"), F.col("u").alias("last_id"), F.col("pu").alias("prev_id"), F.concat(levels("b", "bid"), levels("a", "ask")).alias("levels"), "recvMs", "phase")


def parsed_trades(raw: DataFrame, symbol: str) -> DataFrame:
    px, qty = F.col("p").try_cast("double"), F.col("q").try_cast("double")
    return raw.select(F.lit(symbol).alias("symbol"), F.col("T").alias("t"), F.col("a").alias("trade_id"), px.alias("px"), qty.alias("qty"), (px * qty).alias("quote"), (~F.col("m")).alias("aggressive_buy"), "recvMs", "phase")


def of_version(df: DataFrame, phase: str, version: str) -> DataFrame:
    """Rows of one phase and schema version; versions never merge."""
    return df.filter((F.col("phase") == phase) & (F.col("schemaVersion") == version))


# ---------------------------------------------------------------- restart-safe ingest


def advancing(df: DataFrame, keys: list[str], arrival: str, identifier: str, known: DataFrame | None = None, block: int = 3_600_000) -> DataFrame:
    """Rows whose id is above every id that arrived before, and above the stored high-water mark (keys, high).

    Arrivals are cut into blocks, whose largest ids are carried forward, so a busy key is many tasks.
    """
    rows = df.withColumn("__b", F.floor(F.col(arrival) / block))
    tops = rows.groupBy(*keys, "__b").agg(F.max(identifier).alias("__top"))
    w = W.rowsBetween(W.unboundedPreceding, -1)
    tops = tops.select(*keys, "__b", F.max("__top").over(w.partitionBy(*keys).orderBy("__b")).alias("__carried"))
    own = F.max(identifier).over(w.partitionBy(*keys, "__b").orderBy(arrival))
    rows = rows.join(tops, [*keys, "__b"]).withColumn("__before", F.greatest(own, "__carried"))
    if known is not None:
        rows = rows.join(known.select(*keys, "high"), keys, "left").withColumn("__before", F.greatest("__before", "high")).drop("high")
    return rows.filter(F.col("__before").isNull() | (F.col(identifier) > F.col("__before"))).select(*df.columns)


# ---------------------------------------------------------------- manifests and seals


def manifest(df: DataFrame, received: str = "recvMs", kind: str = "kind") -> DataFrame:
    """day, kind: events, first and last receipt, and how many of each phase."""
    day = F.date_format(F.timestamp_millis(received), "yyyy-MM-dd")
    counts = df.groupBy(day.alias("day"), kind, "phase").agg(F.count("*").alias("n"), F.min(received).alias("a"), F.max(received).alias("b"))
    phases = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("phase", F.lit("")), "n"))))
    return counts.groupBy("day", kind).agg(F.sum("n").alias("events"), F.min("a").alias("first_ms"), F.max("b").alias("last_ms"), phases.alias("phases"))


def sealed(spark: SparkSession, path: str, today: str) -> DataFrame:
    """Files of finished days with size and sha256; open days are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    day = F.regexp_extract("path", r"date=(\d{4}-\d{2}-\d{2})", 1)
    return files.select("path", day.alias("day"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).filter((F.col("day") != "") & (F.col("day") < today))


def write_seals(seals: DataFrame, path: str) -> None:
    """Adds the seals of files that have none yet; an earlier seal is never replaced."""
    spark = seals.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        seals = seals.join(spark.read.schema(seals.schema).parquet(path).select("path"), "path", "left_anti")
    seals.write.mode("append").parquet(path)


def tampered(seals: DataFrame, now: DataFrame) -> DataFrame:
    """Sealed files that are gone or differ."""
    there = now.select("path", F.col("sha256").alias("sha_now"))
    return seals.join(there, "path", "left").filter(~F.col("sha256").eqNullSafe(F.col("sha_now")))


def disk_usage(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))


# ---------------------------------------------------------------- zipped CSV, cache, columnar store


def read_zipped_csv(spark: SparkSession, path: str, schema: T.StructType, required: list[str]) -> DataFrame:
    """Single-entry ZIP archives of CSV with a header; columns by name, rows without a required number dropped."""
    names = schema.names

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(archive.namelist()[0]) as f:
                    for part in pd.read_csv(f, dtype=str, chunksize=50_000):
                        yield part.reindex(columns=names)

    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, text)
    typed = raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema])
    for c in required:
        typed = typed.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return typed


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, built and written first if there is none."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_store(df: DataFrame, path: str, version: str) -> None:
    """Feature records by date, in a fixed column order, with the schema version in every row."""
    df.select(*sorted(c for c in df.columns if c != "date"), "date").withColumn("schemaVersion", F.lit(version)).write.mode("append").partitionBy("date").parquet(path)


# ---------------------------------------------------------------- paged feeds


def backoff(k: int, first: float, most: float) -> float:
    return min(most, first * 2**k)


def retrying(get: Callable[[], tuple[int, object]], tries: int = 6, sleep: Callable[[float], None] = time.sleep) -> object | None:
    """The body of a GET: None for 404, retried for 418, 429 and 5xx with growing pauses, else an error."""
    for k in range(tries):
        status, body = get()
        if status == 200:
            return body
        if status == 404:
            return None
        if status not in (418, 429) and status < 500:
            raise RuntimeError(f"status {status}")
        sleep(backoff(k, 1.0, 60.0))
    raise RuntimeError("no answer")


def paged(get: Callable[[int], list[dict] | None], start: int, end: int, time_field: str, step: int) -> Iterable[dict]:
    """Rows of pages from a moving cursor; stops on an empty page or one that does not advance, cuts at end."""
    cursor = start
    while cursor < end:
        page = get(cursor)
        if not page:
            return
        for row in page:
            if row[time_field] < end:
                yield row
        following = page[-1][time_field] + step
        if following <= cursor:
            return
        cursor = following


class PagedFeed(DataSource):
    """Batch source of paged bars, one partition a day; pages come from JSON files named by their cursor.

    Options: path, start, end (ms), step (ms).
    """

    @classmethod
    def name(cls) -> str:
        return "pagedfeed"

    def schema(self) -> str:
        return "t long, open double, high double, low double, close double, volume double"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PagedReader({k: self.options[k] for k in ("path", "start", "end", "step")})


class _Day(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        start, end = int(self.options["start"]), int(self.options["end"])
        return [_Day(a, min(a + 86_400_000, end)) for a in range(start, end, 86_400_000)]

    def read(self, partition: _Day) -> Iterator[tuple]:
        import json
        import os

        def get(cursor: int) -> list[dict] | None:
            name = f"{self.options['path']}/{cursor}.json"

            def once() -> tuple[int, object]:
                if not os.path.exists(name):
                    return 404, None
                with open(name) as f:
                    return 200, json.load(f)

            return retrying(once)

        for row in paged(get, partition.start, partition.end, "t", int(self.options["step"])):
            yield tuple(row.get(c) for c in ("t", "open", "high", "low", "close", "volume"))


def to_markdown(df: DataFrame, rows: int = 100) -> str:
    """The first rows as a Markdown table."""
    body = df.limit(rows).collect()
    line = lambda values: "| " + " | ".join("" if v is None else str(v) for v in values) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, body)])
