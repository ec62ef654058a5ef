"""A streaming source over captured NDJSON partitions on storage that driver and executors share.

Files lie below date=<day>/kind=<kind>/ and only grow: by lines at the end of a file, and
by files whose path sorts after those there are of the same kind. An offset says, for each
kind, up to which file and byte it was read, so the log of a query has one entry a kind
and batch. A batch takes whole lines only; what a writer has begun waits for the next one.
A file is cut into partitions of so many bytes; a partition begins with the first line
that begins in it. Compressed files are read whole, and are closed when they appear.

Paths are of Arrow's file systems (a local or mounted folder, file://, hdfs://, s3:// ..).
"""

from __future__ import annotations

import gzip
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a partition, and of the reads that look for the end of a line.
PART_BYTES, LOOK_BYTES = 16 << 20, 1 << 16

_PLACE = re.compile(r"date=(\d{4}-\d{2}-\d{2})/kind=([^/]+)/[^/]+\.(?:nd)?json(\.gz)?$")


def _files(path: str):
    """The file system, and (day, kind, path, size) of the captured files below path, in order."""
    from pyarrow import fs

    system, root = _opened(path)
    found = []
    for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        if info.type == fs.FileType.File and (m := _PLACE.search(info.path)):
            found.append((m[1], m[2], info.path, info.size))
    return system, sorted(found, key=lambda f: (f[1], f[0], f[2]))


def last_line_end(system, path: str, size: int) -> int:
    """The byte after the last line end of a file of `size` bytes; 0 without any."""
    with system.open_input_file(path) as f:
        stop = size
        while stop > 0:
            start = max(0, stop - LOOK_BYTES)
            at = f.read_at(stop - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            stop = start
    return 0


def lines(system, path: str, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(byte, line) of the lines that begin in [start, stop); the last may end behind it."""
    if path.endswith(".gz"):
        with system.open_input_stream(path, compression=None) as f, gzip.open(f) as text:
            yield from enumerate(line.rstrip(b"\n") for line in text)
        return
    with system.open_input_file(path) as f:
        at = start
        if start and f.read_at(1, start - 1) != b"\n":  # the line before reaches in here
            at = _line_end(f, start)
        while at < stop:
            end = _line_end(f, at)
            yield at, f.read_at(end - at, at).rstrip(b"\n")
            at = end


def _line_end(f, at: int) -> int:
    """The byte after the next line end."""
    size = f.size()
    while at < size:
        found = f.read_at(min(LOOK_BYTES, size - at), at)
        k = found.find(b"\n")
        if k >= 0:
            return at + k + 1
        at += len(found)
    return size


class CapturedFeed(DataSource):
    """Rows day, kind, file, byte, line. Options: path; kinds (comma-joined, else all); partBytes."""

    @classmethod
    def name(cls) -> str:
        return "capturedfeed"

    def schema(self) -> str:
        return "day string, kind string, file string, byte long, line string"

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _FeedReader(self.options["path"], self.options.get("kinds"), int(self.options.get("partBytes", PART_BYTES)))


class _Span(InputPartition):
    def __init__(self, day: str, kind: str, file: str, start: int, stop: int):
        self.day, self.kind, self.file, self.start, self.stop = day, kind, file, start, stop


class _FeedReader(DataSourceStreamReader):
    def __init__(self, path: str, kinds: str | None, part_bytes: int):
        self.path, self.kinds, self.part_bytes = path, set(kinds.split(",")) if kinds else None, part_bytes

    def initialOffset(self) -> dict:
        return {"kinds": json.dumps({})}

    def latestOffset(self) -> dict:
        system, files = _files(self.path)
        ends: dict[str, list] = {}
        for _, kind, file, size in files:
            if self.kinds is None or kind in self.kinds:
                # of the last file of a kind only whole lines, of those before all
                ends[kind] = [file, size]
        for kind, (file, size) in ends.items():
            ends[kind] = [file, size if file.endswith(".gz") else last_line_end(system, file, size)]
        return {"kinds": json.dumps(ends, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        done, until = json.loads(start["kinds"]), json.loads(end["kinds"])
        out = []
        for day, kind, file, size in _files(self.path)[1]:
            if kind not in until or self._after(file, until[kind][0]):
                continue
            low = 0
            if kind in done:
                if self._after(done[kind][0], file):
                    continue
                low = done[kind][1] if done[kind][0] == file else 0
            high = until[kind][1] if until[kind][0] == file else size
            if file.endswith(".gz"):
                out += [_Span(day, kind, file, 0, 1)] if low == 0 and high > 0 else []
                continue
            out += [_Span(day, kind, file, a, min(a + self.part_bytes, high)) for a in range(low, high, self.part_bytes)]
        return out

    @staticmethod
    def _after(a: str, b: str) -> bool:
        """Whether file a of a kind comes after b: paths of a kind sort by day, then by name."""
        return _PLACE.search(a)[1] > _PLACE.search(b)[1] or _PLACE.search(a)[1] == _PLACE.search(b)[1] and a > b

    def read(self, partition: _Span) -> Iterator[tuple]:
        system, _ = _opened(self.path)
        for byte, line in lines(system, partition.file, partition.start, partition.stop):
            yield partition.day, partition.kind, partition.file, byte, line.decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        pass


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def captured(spark: SparkSession, path: str, kinds: list[str] | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """The stream of captured lines below path."""
    spark.dataSource.register(CapturedFeed)
    reader = spark.readStream.format("capturedfeed").option("path", path).option("partBytes", str(part_bytes))
    return (reader.option("kinds", ",".join(kinds)) if kinds else reader).load()


def parsed(rows: DataFrame, kind: str, schema: T.StructType) -> DataFrame:
    """A kind's lines as records with their place (file, byte); lines that are no record are dropped."""
    found = rows.where(F.col("kind") == kind).withColumn("r", F.from_json("line", schema, {"mode": "PERMISSIVE"}))
    known = F.lit(False)
    for name in schema.names:
        known = known | F.col(f"r.{name}").isNotNull()
    return found.where(known).select("day", "file", "byte", "r.*")


def attempts(meta: DataFrame) -> DataFrame:
    """Each resynchronisation of a meta stream or table (type, at, reason, attempt, applied): begun, attempt, outcome.

    An attempt is a row of type snapshot or snapshot_error; it belongs to the last resync_begin
    before it. Numbers count the attempts of a resynchronisation in the order of `at`.
    """
    from pyspark.sql import Window as W

    order = W.partitionBy("day").orderBy("at", "byte").rowsBetween(W.unboundedPreceding, 0)
    begun = F.when(F.col("type") == "resync_begin", F.struct("at", "reason"))
    rows = meta.withColumn("begin", F.last(begun, ignorenulls=True).over(order)).where("type in ('snapshot', 'snapshot_error')")
    nth = F.row_number().over(W.partitionBy("day", "begin").orderBy("at", "byte"))
    outcome = F.when(F.col("type") == "snapshot_error", "error").when(F.coalesce(F.col("applied"), F.lit(False)), "applied").otherwise("refused")
    return rows.select("day", F.col("begin.at").alias("begun"), F.col("begin.reason").alias("reason"), "at", nth.alias("nth"), outcome.alias("outcome"), F.coalesce("note", "error").alias("said"))
