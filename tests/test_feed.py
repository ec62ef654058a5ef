"""The captured feed as a stream: torn lines, growth in the middle of a file, restarts, rotation, attempts."""

import gzip
import json
import os

from pyspark.sql import types as T

from tapeframe.sources import feed, io

META = T.StructType([*[f for f in io.META.fields if f.name != "applied"], T.StructField("applied", T.BooleanType())])


def put(path, text, mode="a"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(text)


def run(spark, root, out, part_bytes=40, kinds=None):
    """One run of the query to the end of what there is."""
    rows = feed.captured(spark, f"{root}", kinds, part_bytes)
    rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("day string, kind string, file string, byte long, line string").parquet(f"{out}/rows")


def test_stops_in_the_middle_of_a_file_and_loses_and_repeats_nothing(spark, tmp_path):
    root, out = tmp_path / "cap", tmp_path / "out"
    day1 = f"{root}/date=2024-01-01/kind=depth"
    line = lambda k: json.dumps({"u": k, "x": "é" * (k % 7)})
    put(f"{day1}/a.ndjson", "".join(line(k) + "\n" for k in range(50)) + line(50)[:9])
    want = [line(k) for k in range(50)]
    assert sorted(r.line for r in run(spark, root, out).collect()) == sorted(want), "the torn line waits"
    put(f"{day1}/a.ndjson", line(50)[9:] + "\n" + line(51) + "\n")
    put(f"{root}/date=2024-01-01/kind=meta/a.ndjson", '{"type": "ws_rotate", "at": 5}\n')
    want += [line(50), line(51), '{"type": "ws_rotate", "at": 5}']
    assert sorted(r.line for r in run(spark, root, out).collect()) == sorted(want)
    assert sorted(r.line for r in run(spark, root, out).collect()) == sorted(want), "a run without growth adds nothing"
    put(f"{day1}/a.ndjson", line(52) + "\n")
    put(f"{root}/date=2024-01-02/kind=depth/a.ndjson", line(53) + "\n" + line(54) + "\n")  # rotation by day
    with gzip.open(os.path.join(str(root), "date=2024-01-02/kind=depth/b.ndjson.gz"), "wt") as f:
        f.write(line(55) + "\n" + line(56) + "\n")
    want += [line(k) for k in (52, 53, 54, 55, 56)]
    found = run(spark, root, out).collect()
    assert sorted(r.line for r in found) == sorted(want)
    assert len({(r.file, r.byte) for r in found}) == len(found) and {r.day for r in found} == {"2024-01-01", "2024-01-02"}


def test_partitions_cut_files_between_lines(tmp_path):
    path = f"{tmp_path}/date=2024-01-01/kind=trades/a.ndjson"
    texts = ["", "a", "b" * 100, "é" * 20, "", "c"]
    put(path, "".join(t + "\n" for t in texts), "w")
    for size in (1, 2, 7, 64, 10**6):
        reader = feed._FeedReader(str(tmp_path), None, size)
        spans = reader.partitions(reader.initialOffset(), reader.latestOffset())
        assert [line for s in spans for *_, line in reader.read(s)] == texts
        assert len(spans) == -(-os.path.getsize(path) // size)
    assert reader.partitions(reader.latestOffset(), reader.latestOffset()) == []
    other = feed._FeedReader(str(tmp_path), "depth", 10)
    assert other.partitions(other.initialOffset(), other.latestOffset()) == []


def test_records_and_attempts_of_a_meta_stream(spark, tmp_path):
    rows = [
        {"type": "resync_begin", "reason": "startup", "at": 10}, {"type": "snapshot_error", "attempt": 1, "error": "HTTP 418", "at": 11},
        {"type": "snapshot", "at": 12, "applied": False, "note": "too old"}, {"type": "snapshot", "at": 15, "applied": True},
        {"type": "ws_stale", "stream": "depth", "at": 90, "ageMs": 6000}, {"type": "resync_begin", "reason": "stale", "at": 91}, {"type": "snapshot", "at": 92, "applied": True},
    ]
    put(f"{tmp_path}/cap/date=2024-01-01/kind=meta/a.ndjson", "".join(json.dumps(r) + "\n" for r in rows) + "no record\n{}\n")
    found = feed.parsed(run(spark, tmp_path / "cap", tmp_path / "out", 10**6, ["meta"]), "meta", META)
    assert found.count() == len(rows)
    got = [(r.begun, r.reason, r.at, r.nth, r.outcome, r.said) for r in feed.attempts(found).orderBy("at").collect()]
    assert got == [(10, "startup", 11, 1, "error", "HTTP 418"), (10, "startup", 12, 2, "refused", "too old"), (10, "startup", 15, 3, "applied", None), (91, "stale", 92, 1, "applied", None)]
