"""Tables in the folder that all executors share, for results that several branches of a plan read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir, deleted when it ends.

    Where that is unset a local session gets a temporary folder, and a cluster an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if context.applicationId not in _local:
            _local[context.applicationId] = tempfile.mkdtemp(prefix="tapeframe-")
        base = _local[context.applicationId]
    found = f"{base.rstrip('/')}/tapeframe-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(found)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df written as a table and read again: it is computed once and survives lost executors."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
