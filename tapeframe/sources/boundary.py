"""A boundary between warm-up and prospective data that is written once, on storage that all writers share."""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def first_after(valid: DataFrame, keys: list[str], frozen_ms: int, at: str = "at") -> DataFrame:
    """keys and boundary: the first instant after the freeze at which a book is valid; none before one is."""
    return valid.where(F.col(at) > frozen_ms).groupBy(*keys).agg(F.min(at).alias("boundary"))


def phase(at: Column, boundary: Column) -> Column:
    return F.when(F.coalesce(at >= boundary, F.lit(False)), "prospective").otherwise("warmup")


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _read(spark: SparkSession, path: str, tries: int = 20) -> dict | None:
    """The JSON object at path; waits for a writer that has begun it."""
    fs, jpath = _fs(spark, path)
    for _ in range(tries):
        if not fs.exists(jpath):
            return None
        stream = fs.open(jpath)
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            time.sleep(0.1)
    raise ValueError(f"{path} is no marker")


def create(spark: SparkSession, path: str, content: dict) -> dict:
    """Writes content to path if nothing is there; what is there afterwards, of whichever writer came first."""
    fs, jpath = _fs(spark, path)
    body = json.dumps(content, sort_keys=True).encode()
    try:
        if fs.getScheme() == "file":  # a mounted folder: creating there is not atomic, linking a whole file is
            _linked(jpath.toUri().getPath(), body)
        else:
            stream = fs.create(jpath, False)  # fails where the file exists
            try:
                stream.write(bytearray(body))
            finally:
                stream.close()
    except Exception:
        found = _read(spark, path)
        if found is None:
            raise
        return found
    return content


def _linked(path: str, body: bytes) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.write(body)
    try:
        os.link(own, path)  # fails where the file exists
    finally:
        os.unlink(own)


def freeze(spark: SparkSession, folder: str, version: str, frozen_ms: int) -> dict:
    """The freeze of a schema version: set once; a later call gets the first one."""
    return create(spark, f"{folder}/freeze-{version}.json", {"schemaVersion": version, "frozenAtMs": frozen_ms})


def boundary(spark: SparkSession, folder: str, version: str, valid: DataFrame, at: str = "at", last_id: str = "last_id") -> dict | None:
    """The boundary of a version: that on record, else the first valid book (at, last_id) after its freeze, which is recorded.

    None without a freeze of this version, and as long as no book is valid after it: then the data
    stay warm-up. A new version has a boundary of its own and inherits none.
    """
    known = _read(spark, f"{folder}/prospective-{version}.json")
    if known is not None:
        return known
    frozen = _read(spark, f"{folder}/freeze-{version}.json")
    if frozen is None or frozen.get("schemaVersion") != version:
        return None
    first = valid.where(F.col(at) > frozen["frozenAtMs"]).agg(F.min(F.struct(at, last_id)).alias("r")).first().r
    if first is None:
        return None
    return create(spark, f"{folder}/prospective-{version}.json", {"schemaVersion": version, "startedAtMs": first[at], "lastUpdateId": first[last_id], "frozenAtMs": frozen["frozenAtMs"]})
