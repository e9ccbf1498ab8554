"""A folder for round trips that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset (local mode), under a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vqaspark-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _filesystem(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark knows."""
    store, found = _filesystem(spark, path)
    return store.exists(found)


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file unless it is there already: of several writers one succeeds."""
    store, found = _filesystem(spark, path)
    if store.exists(found):
        return False
    try:
        out = store.create(found, False)
    except Exception as e:
        if store.exists(found):  # another writer was quicker
            return False
        raise e
    out.write(bytearray(text.encode()))
    out.close()
    return True


def told(spark: SparkSession, path: str) -> str:
    """What a small file says; nothing if it is not there or not written to its end."""
    store, found = _filesystem(spark, path)
    return "".join(r.value for r in spark.read.text(path).collect()) if store.exists(found) and store.getFileStatus(found).getLen() else ""


def discard(spark: SparkSession, path: str) -> None:
    store, found = _filesystem(spark, path)
    store.delete(found, True)
