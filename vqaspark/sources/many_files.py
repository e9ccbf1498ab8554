"""Very many files, written, listed and read by tasks: the driver learns the names of a path's own folders and nothing of each file.

Spark's writers tell the driver each folder that a row went to, and its index of a path holds each file.  Here a task writes its files
beside their place and moves them into it in one folder when all are there, so a lost task leaves nothing that is read; in stores of
objects, whose files appear whole and whose folders cannot be moved, a repeated task writes the same files over those of a lost one.
Paths are URIs of any store that Arrow knows, or local paths that driver and executors share.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cloud_files import filesystem

#: Bytes of content that a task hands over at a time, and paths.
BATCH_BYTES, BATCH_PATHS = 16 << 20, 4096
TEMPORARY = "_temporary"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """Local paths are taken as Spark writes them, with blanks and all, which a URI must not have."""
    return (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if path.startswith("file:") else filesystem(path)


def write_files(df: DataFrame, path: str, name: str, content: str, suffix: str, tasks: int) -> None:
    """A file for each name, ``set=<task>/part-<task>-<name><suffix>``, of the bytes of its content; rows of one name follow each other in it."""
    store, root = _store(path)
    store.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        task = f"{TaskContext.get().partitionId():05d}"
        place, beside = f"{root}/set={task}", store.type_name in ("local", "hdfs")
        folder = f"{root}/{TEMPORARY}/{uuid.uuid4().hex}" if beside else place
        store.create_dir(folder, recursive=True)
        there: set[str] = set()
        for b in batches:
            for own, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                file = f"{folder}/part-{task}-{quote(own, safe=' =,')}{suffix}"
                held = b""
                if own in there:
                    with store.open_input_stream(file, compression=None) as f:
                        held = f.read()
                there.add(own)
                with store.open_output_stream(file, compression=None) as f:
                    f.write(held + data.as_py())
        if beside and store.get_file_info(place).type == fs.FileType.NotFound:
            store.move(folder, place)
        elif beside:  # another attempt at this task was through before
            store.delete_dir(folder)
        yield pa.RecordBatch.from_arrays([pa.array([len(there)], pa.int64())], ["n"])

    rows = df.select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content")).repartition(tasks, "name")
    rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()
    if store.get_file_info(f"{root}/{TEMPORARY}").type != fs.FileType.NotFound:
        store.delete_dir(f"{root}/{TEMPORARY}")


def read_files(spark: SparkSession, path: str, suffix: str, tasks: int) -> DataFrame:
    """(path, length, content) of the files below a path whose names end so; each of the path's own folders is listed by a task."""
    store, root = _store(path)
    own = [f.path for f in store.get_file_info(fs.FileSelector(root)) if not f.path.endswith(f"/{TEMPORARY}")]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(path)
        for b in batches:
            for folder in b.column(0).to_pylist():
                info = store.get_file_info(folder)
                found = [info] if info.is_file else store.get_file_info(fs.FileSelector(folder, recursive=True))
                found = [f for f in found if f.is_file and f.path.endswith(suffix)]
                for k in range(0, len(found), BATCH_PATHS):
                    part = found[k : k + BATCH_PATHS]
                    yield pa.RecordBatch.from_arrays([pa.array([f.path for f in part]), pa.array([f.size for f in part], pa.int64())], ["path", "length"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(path)
        held, size = [], 0
        whole = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], ["path", "length", "content"])
        for b in batches:
            for file in b.column(0).to_pylist():
                with store.open_input_stream(file, compression=None) as f:
                    data = f.read()
                held.append((file, len(data), data))
                size += len(data)
                if size >= BATCH_BYTES:
                    yield whole()
                    held, size = [], 0
        if held:
            yield whole()

    folders = spark.createDataFrame([(p,) for p in own], "folder string").repartition(max(1, min(len(own), tasks)))
    return folders.mapInArrow(listed, "path string, length long").repartition(tasks).mapInArrow(read, "path string, length long, content binary")
