"""A list of files read row by row in order, resumable at any row.

The state folder holds the list of files as it was at the start (file, rows, rows before it), the output of each batch, and a ledger
with a line for each batch that is done: where it ended, as file and row.  A batch is a range of row numbers, so it gives the same
rows however often it is tried; its output is written first and counts only with its line in the ledger.  A job that dies at any
place therefore goes on at the row after the last ledger line, and no row is lost or seen twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from ..sources.scratch import exists

LEDGER = "batch long, file string, row long, upto long"


@dataclass
class RowReader:
    """source: Parquet files, read in the order of their paths; state: a folder of this reader alone; rows: of a batch."""

    spark: SparkSession
    source: str
    state: str
    rows: int

    def __post_init__(self) -> None:
        if self.rows < 1:
            raise ValueError("a batch has one row at least")

    def files(self) -> DataFrame:
        """(file, rows, before): counted once, when the first batch begins; files that come later are for another list."""
        path = f"{self.state}/files"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            counted = self.spark.read.parquet(self.source).select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count("*").alias("rows"))
            placed = numbered(counted, [], ["file"], "before", F.col("rows"))
            placed.select("file", "rows", "before").write.mode("overwrite").parquet(path)
        return self.spark.read.schema("file string, rows long, before long").parquet(path)

    def ledger(self) -> DataFrame:
        path = f"{self.state}/ledger"
        return self.spark.read.schema(LEDGER).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], LEDGER)

    def position(self) -> tuple[int, int]:
        """(batches done, rows done)."""
        last = self.ledger().agg(F.max("batch"), F.max("upto")).first()
        return (0, 0) if last[0] is None else (last[0] + 1, last[1])

    def between(self, first: int, end: int) -> DataFrame:
        """Rows number first to end - 1 with their ``file`` and ``row``; only the files that hold them are opened."""
        touched = self.files().where((F.col("before") < end) & (F.col("before") + F.col("rows") > first)).orderBy("before").collect()  # those of one batch
        if not touched:
            return self.spark.read.parquet(self.source).limit(0).withColumns({"file": F.lit("").cast("string"), "row": F.lit(0).cast("long")})
        found = self.spark.read.parquet(*[f.file for f in touched]).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        head, tail = touched[0], touched[-1]
        early = (F.col("file") == head.file) & (F.col("row") < first - head.before)
        late = (F.col("file") == tail.file) & (F.col("row") >= end - tail.before)
        return found.where(~early & ~late)

    def step(self, work: Callable[[DataFrame], DataFrame] | None = None) -> bool:
        """Reads, works on and writes one batch; False if there is none left."""
        batch, first = self.position()
        total = self.files().agg(F.sum("rows")).first()[0] or 0
        if first >= total:
            return False
        end = min(total, first + self.rows)
        rows = self.between(first, end)
        (work(rows) if work else rows).write.mode("overwrite").parquet(f"{self.state}/out/batch={batch}")  # what a try that died has left goes
        last = self.files().where((F.col("before") < end) & (F.col("before") + F.col("rows") >= end)).select("file", F.lit(end).alias("upto"), (F.lit(end) - F.col("before") - 1).alias("row"))
        last.select(F.lit(batch).cast("long").alias("batch"), "file", "row", F.col("upto").cast("long")).coalesce(1).write.mode("append").parquet(f"{self.state}/ledger")
        return True

    def run(self, work: Callable[[DataFrame], DataFrame] | None = None, batches: int | None = None) -> int:
        """Steps until all is read, or so many batches; returns their number."""
        n = 0
        while (batches is None or n < batches) and self.step(work):
            n += 1
        return n

    def output(self) -> DataFrame:
        """All rows of the batches in the ledger."""
        out = self.spark.read.option("basePath", f"{self.state}/out").parquet(f"{self.state}/out")
        return out.join(F.broadcast(self.ledger().select(F.col("batch").cast(dict(out.dtypes)["batch"]))), "batch", "left_semi")
