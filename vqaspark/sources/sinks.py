"""Sinks.  All write through Spark's committers, so a lost task leaves nothing behind; none overwrites its own input."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import outer_merge
from ..operators.ranking import numbered
from . import readers
from .scratch import claim, discard, exists, told


def write_tasks(df: DataFrame, path: str, tasks: list[str], splits: list[str]) -> DataFrame:
    """JSON by task and split (only those with rows get a folder); returns (task, split, n) of what was written.

    Rows are counted while they are written, and nothing is read again; a task or split that is not named stops the job.
    """
    pairs = [(t, s) for t in tasks for s in splits]
    unknown = F.raise_error(F.concat(F.lit("unknown task or split: "), F.coalesce("task", F.lit("null")), F.lit(", "), F.coalesce("split", F.lit("null")))).cast("string")
    known = df.withColumn("task", F.when(F.col("task").isin(tasks) & F.col("split").isin(splits), F.col("task")).otherwise(unknown))
    seen = Observation()
    counts = [F.count_if((F.col("task") == t) & (F.col("split") == s)).alias(f"n{i}") for i, (t, s) in enumerate(pairs)]
    known.observe(seen, *counts).write.partitionBy("task", "split").json(path)
    found = [(t, s, seen.get[f"n{i}"]) for i, (t, s) in enumerate(pairs)]
    return df.sparkSession.createDataFrame([x for x in found if x[2]], "task string, split string, n long")


def write_index(df: DataFrame, path: str) -> None:
    df.write.json(f"{path}/json")
    df.write.option("header", True).csv(f"{path}/csv")


def write_new(df: DataFrame, path: str, key: str, folders: bool = False) -> None:
    """Appends the rows whose key is not there yet: a job that is run again adds nothing.  folders: each key has a folder of its own."""
    spark = df.sparkSession
    done = spark.read.parquet(path).select(key) if exists(spark, path) else df.select(key).limit(0)
    new = df.join(done.distinct() if folders else done, key, "left_anti").write.mode("append")
    (new.partitionBy(key) if folders else new).parquet(path)


def write_json_arrays(df: DataFrame, path: str, order: list[str], rows: int = 1000) -> None:
    """Files that each hold one JSON array of at most so many records, in order; no task holds more than one file's records."""
    file = F.floor(F.col("_pos") / rows).alias("_file")
    record = F.struct("_pos", F.struct(*df.columns).alias("r"))
    files = numbered(df, [], order, "_pos").select(file, record.alias("x")).groupBy("_file").agg(F.array_sort(F.collect_list("x")).alias("x"))
    files.select(F.to_json(F.transform("x", lambda x: x["r"])).alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_progress(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def merge_history(spark: SparkSession, old_path: str, new: DataFrame, keys: list[str], new_path: str) -> None:
    """The history with new rows winning, written to a new path."""
    outer_merge(spark.read.parquet(old_path), new, keys).write.parquet(new_path)


def write_corpus(df: DataFrame, path: str, links: int = 200) -> None:
    """Tasks (category, link, task, description, actions, required_status) as nested JSON, {category: {link: {task: ..}}}, of a class and so many of its links by hash a file."""
    told = F.struct(F.col("task").alias("key"), F.struct("description", "actions", "required_status").alias("value"))
    sizes = df.groupBy("category").agg(F.ceil(F.count_distinct("link") / links).cast("int").alias("_files"))
    by_link = df.groupBy("category", "link").agg(F.map_from_entries(F.collect_list(told)).alias("value")).join(sizes, "category")
    file = F.pmod(F.xxhash64("link"), F.col("_files")).alias("_file")
    files = by_link.groupBy("category", file).agg(F.map_from_entries(F.collect_list(F.struct(F.col("link").alias("key"), "value"))).alias("value"))
    files.select(F.to_json(F.create_map("category", "value")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def merge_corpus(spark: SparkSession, old_path: str, new_path: str, merged_path: str) -> None:
    """Two corpora as one: links and tasks of either, where both have a task the new one's; files that do not parse stop the job."""
    sides = []
    for path in (old_path, new_path):
        rows, bad = readers.task_corpus(spark, path)
        if not bad.isEmpty():
            raise ValueError(f"{path} holds files that do not parse")
        sides.append(rows.select("category", "link", "task", F.struct("description", "actions", "required_status").alias("told")))
    merged = outer_merge(*sides, ["category", "link", "task"])
    write_corpus(merged.select("category", "link", "task", "told.description", "told.actions", "told.required_status"), merged_path)


def rewrite_lines(df: DataFrame, path: str, line: str = "line") -> None:
    df.select(F.col(line).alias("value")).write.text(path)


def is_ready(spark: SparkSession, path: str) -> bool:
    return bool(told(spark, f"{path}/ready"))


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame] | None = None, wait: float = 0.0) -> DataFrame:
    """The table at path: built once, and marked ready only after its last row was committed.

    Whoever gives ``build`` builds into a folder of their own; of several at once the first to end sets the mark, which names its
    folder, and the others throw theirs away.  Those who leave it out wait up to so many seconds for the mark.
    """
    until = time.monotonic() + wait
    while not is_ready(spark, path):
        if build is not None:
            folder = f"data-{uuid.uuid4().hex}"
            build().write.parquet(f"{path}/{folder}")
            if not claim(spark, f"{path}/ready", folder):
                discard(spark, f"{path}/{folder}")
        elif time.monotonic() >= until:
            raise TimeoutError(f"{path} is not ready")
        else:
            time.sleep(0.2)
    return spark.read.parquet(f"{path}/{told(spark, f'{path}/ready')}")


def write_predictions(df: DataFrame, path: str) -> None:
    """Predictions as JSON lines in UTF-8, beside those of earlier runs."""
    df.write.mode("append").json(path)
