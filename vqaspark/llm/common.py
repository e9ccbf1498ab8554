"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text): a null text as the empty one, bytes that are no UTF-8 as U+FFFD; whatever else the table holds is pruned from the scan."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), valid(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))


def valid(text: Column) -> Column:
    """The text with each wrong byte sequence replaced by U+FFFD; the scan of a valid one costs no copy."""
    return F.make_valid_utf8(text)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="vqaspark-"))
    return context.getCheckpointDir().rstrip("/")


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: later jobs neither repeat the work nor depend on an executor."""
    path = path or f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500, column: int | None = None, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to a bounded number of rows, so that Python objects of one slice live at a time.

    column: a string column, of which a slice holds ``most`` bytes at most, or one row.
    """
    for batch in batches:
        if column is None:
            ends = range(rows, batch.num_rows + rows, rows)
        else:
            ends, held, at = [], 0, 0
            for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
                if i > at and (held + size > most or i - at == rows):
                    ends.append(i)
                    held, at = 0, i
                held += size
            ends.append(batch.num_rows)
        at = 0
        for end in ends:
            if end > at:
                yield batch.slice(at, end - at)
            at = end


#: What operators remember in a Python worker from one task to the next: module and cached function, by owner.
REMEMBERED = {"units": ("encoders", "encoder"), "counts": ("token_counts", "counter_of"), "shingles": ("near_duplicates", "shingles_of")}


def keep_only(owner: str) -> None:
    """Forgets what other operators have left in this worker, as workers outlive the jobs that they first ran for."""
    for name, (module, cached) in REMEMBERED.items():
        loaded = sys.modules.get(f"{__package__}.{module}")
        if name != owner and loaded is not None:
            getattr(loaded, cached).cache_clear()
