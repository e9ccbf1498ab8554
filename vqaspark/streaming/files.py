"""Files read one after another as a stream, with a place to go on from."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends all that is there now to Parquet; run again with the same checkpoint, it takes only new files."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination()


def running_metrics(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Count and total of each metric so far, kept as stream state; each batch leaves a snapshot under its number."""
    totals = stream.groupBy("metric").agg(F.count("value").alias("n"), F.sum("value").alias("total"))

    def snapshot(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    totals.writeStream.outputMode("complete").foreachBatch(snapshot).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Meter(StreamingQueryListener):
    """Hears what each batch has observed, and tells the sums of every ``every`` batches, and of the rest when the stream ends."""

    def __init__(self, name: str, every: int, tell: Callable[[dict], None]):
        self.name, self.every, self.tell = name, every, tell
        self.held: list[tuple[int, dict]] = []
        self.last, self.lock = -1, threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        found = event.progress.observedMetrics.get(self.name)
        if found is None or event.progress.numInputRows == 0:
            return
        with self.lock:
            if event.progress.batchId <= self.last:
                return  # told already
            self.last = event.progress.batchId
            self.held.append((event.progress.batchId, found.asDict()))
            if len(self.held) == self.every:
                self._out()

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def _out(self) -> None:
        if self.held:
            sums = {k: sum(m[k] or 0 for _, m in self.held) for k in self.held[0][1]}
            self.tell({"batch": self.held[-1][0], "batches": len(self.held), **sums})
            self.held = []

    def close(self) -> None:
        with self.lock:
            self._out()


def metered(stream: DataFrame, path: str, checkpoint: str, metrics: dict[str, Column], every: int, tell: Callable[[dict], None]) -> None:
    """Appends a stream to Parquet; its metrics, sums or counts, are taken while each batch is written and told every so many batches.

    The rows are not read for it, neither again nor from the output.
    """
    spark, name = stream.sparkSession, "metered"
    meter = Meter(name, every, tell)
    spark.streams.addListener(meter)
    try:
        seen = stream.observe(name, *(c.alias(n) for n, c in metrics.items()))
        query = seen.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
        query.awaitTermination()
        last = max((p["batchId"] for p in map(lambda p: json.loads(p.json) if hasattr(p, "json") else p, query.recentProgress) if p["numInputRows"] > 0), default=-1)
        until = time.monotonic() + 30
        while meter.last < last and time.monotonic() < until:  # progress is told by another thread
            time.sleep(0.05)
        if meter.last < last:
            raise TimeoutError("the last batch's metrics did not come")
    finally:
        spark.streams.removeListener(meter)
    meter.close()
