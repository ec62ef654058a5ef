"""A columnar store of features: a column order for each version, kept beside the data, and a checksum for each file.

Layout: columns-<version>.json, data/<version>/<day>=../*.parquet, manifest/<version>/*.parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeframe.sources.boundary import _read, create

#: Rows of a file at most, so that a task hashes a file of bounded size.
ROWS_A_FILE = 1_000_000
_MANIFEST = "file string, bytes long, sha256 string"


class StoreError(ValueError):
    """The store is not what its version says."""


def _declared(schema: T.StructType) -> list[list[str]]:
    return [[f.name, f.dataType.simpleString()] for f in schema]


def _there(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def _hashed(spark: SparkSession, path: str, version: str) -> DataFrame:
    """file, bytes and sha256 of the data files of a version, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{path}/data/{version}")
    return files.select(F.regexp_extract("path", r"/data/(.*)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest(spark: SparkSession, path: str, version: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/{version}")


def append(df: DataFrame, path: str, version: str, columns: list[str], day: str = "date") -> None:
    """Adds rows in the order of `columns`, by day. The first writer of a version fixes its names, order and types;
    anything else under that version is an error: a changed order needs a new version."""
    spark = df.sparkSession
    rows = df.select(*columns, day)
    ours = {"schemaVersion": version, "columns": _declared(rows.schema)}
    kept = create(spark, f"{path}/columns-{version}.json", ours)
    if kept["columns"] != ours["columns"]:
        raise StoreError(f"version {version} has the columns {kept['columns']}")
    if _there(spark, f"{path}/data/{version}") and not problems(spark, path, version).filter("problem <> 'unlisted'").isEmpty():
        raise StoreError(f"version {version} has files that are changed or missing")
    rows.write.mode("append").option("maxRecordsPerFile", ROWS_A_FILE).partitionBy(day).parquet(f"{path}/data/{version}")
    found = _hashed(spark, path, version)
    if _there(spark, f"{path}/manifest/{version}"):
        found = found.join(manifest(spark, path, version).select("file"), "file", "left_anti")
    found.write.mode("append").parquet(f"{path}/manifest/{version}")


def problems(spark: SparkSession, path: str, version: str) -> DataFrame:
    """file and problem of each file that is changed, missing, or in no manifest."""
    listed = manifest(spark, path, version).select("file", F.struct("bytes", "sha256").alias("want"))
    rows = _hashed(spark, path, version).select("file", F.struct("bytes", "sha256").alias("have")).join(listed, "file", "full")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("have") != F.col("want"), "changed")
    return rows.select("file", problem.alias("problem")).filter("problem is not null")


def read(spark: SparkSession, path: str, version: str, columns: list[str] | None = None, verify: bool = True) -> DataFrame:
    """The rows of a version. An error if it is unknown, if `columns` (names in their order) or the files' own columns
    are not the recorded ones, or, with verify, if a file is changed, missing or unlisted."""
    kept = _read(spark, f"{path}/columns-{version}.json")
    if kept is None:
        raise StoreError(f"no version {version}")
    names, day = [n for n, _ in kept["columns"][:-1]], kept["columns"][-1][0]
    if columns is not None and columns != names:
        raise StoreError(f"version {version} has the order {names}")
    found = spark.read.option("mergeSchema", "true").option("basePath", f"{path}/data/{version}").parquet(f"{path}/data/{version}")
    own = [c for c in _declared(found.schema) if c[0] != day]
    if own != kept["columns"][:-1]:
        raise StoreError(f"files of version {version} have the columns {own}")
    if verify and (bad := problems(spark, path, version).limit(20).collect()):
        raise StoreError("; ".join(f"{r.file} {r.problem}" for r in bad))
    return found.withColumn(day, F.col(day).cast(kept["columns"][-1][1]))
