"""Point clouds as PLY and NPY files: a data source that Spark reads and writes ("cloud_files").

Reading: the files below a path are dealt into partitions of about the same size; NPY files, whose rows have a fixed width, are cut
into ranges of rows.  Writing: each task writes whole files beside their place, under a name of its own; only when all tasks are
through does the driver move them into place, so a lost or repeated task leaves nothing behind and a failed job shows nothing.
Paths are URIs of any store that Arrow knows, or local paths that driver and executors share.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

COLUMNS = ("x", "y", "z", "nx", "ny", "nz", "r", "g", "b")
#: The property of a PLY file that holds each column.
PROPERTIES = dict(zip(COLUMNS, ("x", "y", "z", "nx", "ny", "nz", "red", "green", "blue"), strict=True))
SCHEMA = "cloud string, part int, idx long, " + ", ".join(f"{c} double" for c in COLUMNS)
#: Bytes of files that a task reads, rows that it hands over at a time, and points of a file.
PARTITION_BYTES, BATCH_ROWS, FILE_POINTS = 64 << 20, 1 << 16, 1 << 20


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def header_of(columns: list[str], n: int) -> str:
    kinds = "".join(f"property {'uchar' if c in 'rgb' else 'float'} {PROPERTIES[c]}\n" for c in columns)
    return f"ply\nformat ascii 1.0\nelement vertex {n}\n{kinds}end_header\n"


def ply_bytes(columns: list[str], data: np.ndarray) -> bytes:
    """An ASCII PLY file: coordinates and normals with six decimals, colours as whole numbers."""
    line = " ".join("%d" if c in "rgb" else "%.6f" for c in columns) + "\n"
    return (header_of(columns, len(data)) + "".join([line % tuple(row) for row in data.tolist()])).encode()


def npy_bytes(columns: list[str], data: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, data)
    return out.getvalue()


def ply_header(f) -> tuple[list[str], int]:
    """The properties of a PLY file's vertices and their number; f is left at the first vertex."""
    columns, n, inside = [], 0, False
    for line in iter(f.readline, b""):
        word = line.decode("ascii").split()
        if word[:1] == ["format"] and word[1] != "ascii":
            raise ValueError(f"PLY in format {word[1]} is not read")
        if word[:1] == ["element"]:
            inside = word[1] == "vertex"
            n = int(word[2]) if inside else n
        elif word[:1] == ["property"] and inside:
            columns.append(word[-1])
        elif word == ["end_header"]:
            return columns, n
    raise ValueError("a PLY file without an end of its header")


def read_ply(f) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(first row, columns) of at most BATCH_ROWS vertices at a time."""
    names, n = ply_header(f)
    at = 0
    while at < n:
        lines = [f.readline().split()[: len(names)] for _ in range(min(BATCH_ROWS, n - at))]
        data = np.array(lines, float).reshape(len(lines), len(names))
        yield at, {c: data[:, names.index(p)] for c, p in PROPERTIES.items() if p in names}
        at += len(lines)


def npy_header(f) -> tuple[tuple[int, ...], np.dtype]:
    """Shape and type of an array's rows; f is left at the first row."""
    version = np.lib.format.read_magic(f)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if fortran or len(shape) != 2 or shape[1] not in (3, 6, 9):
        raise ValueError(f"a cloud is an array of rows of 3, 6 or 9 numbers, not {shape}")
    return shape, kind


def npy_columns(width: int) -> tuple[str, ...]:
    """Nine columns are places, normals and colours; six are places and colours, as data sets take them, unless normals are written."""
    return COLUMNS if width == 9 else COLUMNS[:3] if width == 3 else (*COLUMNS[:3], *COLUMNS[6:])


def read_npy(f, first: int, end: int | None) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    shape, kind = npy_header(f)
    at, end = first, shape[0] if end is None else min(end, shape[0])
    width = shape[1] * kind.itemsize
    f.seek(f.tell() + first * width)
    names = npy_columns(shape[1])
    while at < end:
        data = np.frombuffer(f.read(min(BATCH_ROWS, end - at) * width), kind).reshape(-1, shape[1]).astype(float)
        yield at, {c: data[:, i] for i, c in enumerate(names)}
        at += len(data)


def place_of(file: str) -> tuple[str, int]:
    """(cloud, part) from a file's name."""
    name, _, part = unquote(file.rsplit("/", 1)[-1]).rpartition(".")[0].rpartition("#")
    return (name, int(part)) if name and part.isdigit() else (unquote(file.rsplit("/", 1)[-1]).rpartition(".")[0], 0)


@dataclass
class Files(InputPartition):
    """(file, first row, end or None) for each piece that a task reads."""

    pieces: list[tuple[str, int, int | None]]


class CloudReader(DataSourceReader):
    def __init__(self, path: str, kind: str, partition_bytes: int):
        self.path, self.kind, self.bytes = path, kind, partition_bytes

    def partitions(self) -> list[Files]:
        store, path = filesystem(self.path)
        info = store.get_file_info(path)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        pieces = []
        for f in sorted((f for f in found if f.is_file and f.path.endswith(f".{self.kind}") and "/_temporary/" not in f.path), key=lambda f: f.path):
            if self.kind == "npy" and f.size > self.bytes:
                with store.open_input_file(f.path) as opened:
                    shape, kind = npy_header(opened)
                step = max(1, self.bytes // (shape[1] * kind.itemsize))
                pieces += [(f.path, a, min(a + step, shape[0]), self.bytes) for a in range(0, shape[0], step)]
            else:
                pieces.append((f.path, 0, None, f.size))
        out, held = [Files([])], 0
        for file, a, b, size in pieces:
            if held and held + size > self.bytes:
                out.append(Files([]))
                held = 0
            out[-1].pieces.append((file, a, b))
            held += size + 1024  # opening a file has its cost too
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(self.path)
        for file, first, end in partition.pieces:
            cloud, part = place_of(file)
            with store.open_input_file(file) as opened:
                f = opened if self.kind == "npy" else io.BufferedReader(opened)
                for at, data in read_npy(f, first, end) if self.kind == "npy" else read_ply(f):
                    n = len(next(iter(data.values())))
                    columns = [pa.array(data[c]) if c in data else pa.nulls(n, pa.float64()) for c in COLUMNS]
                    yield pa.RecordBatch.from_arrays([pa.array([cloud] * n), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), *columns], names=["cloud", "part", "idx", *COLUMNS])


@dataclass
class Written(WriterCommitMessage):
    """(file beside its place, its name, points) for each file of a task."""

    files: list[tuple[str, str, int]]


class CloudWriter(DataSourceArrowWriter):
    """Rows of a file come one after another; a file is as much as write_clouds() puts into one."""

    def __init__(self, path: str, kind: str, overwrite: bool):
        self.path, self.kind, self.overwrite, self.job = path, kind, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = filesystem(self.path)
        folder = f"{path}/_temporary/{self.job}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        files, held, at = [], [], None

        def put() -> None:
            if not held:
                return
            rows = pa.Table.from_batches(held)
            columns = [c for c in COLUMNS if c in rows.column_names and rows.column(c).null_count < rows.num_rows]
            data = np.column_stack([rows.column(c).to_numpy() for c in columns])
            name = quote(at[0] if not at[1] else f"{at[0]}#{at[1]:05d}", safe=" #=,") + f".{self.kind}"
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write((ply_bytes if self.kind == "ply" else npy_bytes)(columns, data))
            files.append((f"{folder}/{name}", name, len(data)))
            held.clear()

        for batch in iterator:
            clouds, parts = batch.column("cloud").to_pylist(), batch.column("part").to_numpy()
            edges = [0, *[i for i in range(1, len(clouds)) if clouds[i] != clouds[i - 1] or parts[i] != parts[i - 1]], len(clouds)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a < b:
                    if at != (clouds[a], int(parts[a])):
                        put()
                        at = clouds[a], int(parts[a])
                    held.append(batch.slice(a, b - a))
        put()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = filesystem(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        there = {f.path.rsplit("/", 1)[-1]: f.path for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.is_file}
        both = [n for _, n, _ in files if n in there]
        if both and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{len(both)} clouds are there already, {both[0]} among them")
        if self.overwrite:
            for old in there.values():
                store.delete_file(old)
        for temporary, name, _ in files:
            store.move(temporary, f"{path}/{name}")
        with store.open_output_stream(f"{path}/_SUCCESS") as out:
            out.write(json.dumps({"files": len(files), "points": sum(n for _, _, n in files)}).encode())
        self._clear(store, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*filesystem(self.path))

    def _clear(self, store: fs.FileSystem, path: str) -> None:
        if store.get_file_info(f"{path}/_temporary/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{path}/_temporary/{self.job}")
        if store.get_file_info(f"{path}/_temporary").type != fs.FileType.NotFound and not store.get_file_info(fs.FileSelector(f"{path}/_temporary")):
            store.delete_dir(f"{path}/_temporary")


class CloudFiles(DataSource):
    """Options: path; kind, ply or npy; partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "cloud_files"

    def _told(self) -> tuple[str, str]:
        kind = self.options.get("kind", "ply")
        if kind not in ("ply", "npy"):
            raise ValueError(f"unknown kind of cloud {kind!r}")
        return self.options["path"].rstrip("/"), kind

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> CloudReader:
        return CloudReader(*self._told(), int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> CloudWriter:
        return CloudWriter(*self._told(), overwrite)


def write_clouds(df: DataFrame, path: str, cloud: str, idx: str, kind: str = "ply", mode: str = "append", file_points: int = FILE_POINTS) -> None:
    """One file for each cloud, points in the order of ``idx`` (numbered from 0), and for each ``file_points`` of a greater cloud.

    Columns are those of x y z nx ny nz r g b that df has.  No task holds more than the points of one file, so a cloud of any size
    is spread over tasks.  A name that is there already stops the job, unless the mode is overwrite; then the new files replace all.
    """
    df.sparkSession.dataSource.register(CloudFiles)
    points = [F.col(c).cast("double").alias(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in COLUMNS]
    rows = df.select(F.col(cloud).cast("string").alias("cloud"), F.floor(F.col(idx) / file_points).cast("int").alias("part"), F.col(idx).cast("long").alias("idx"), *points)
    if kind == "npy" and "nx" in df.columns and "r" not in df.columns:
        rows = rows.fillna(0.0, ["r", "g", "b"])  # six columns would be read as places and colours
    rows = rows.repartition("cloud", "part").sortWithinPartitions("cloud", "part", "idx")
    rows.write.format("cloud_files").option("kind", kind).option("path", path).mode(mode).save()


def read_clouds(spark: SparkSession, path: str, kind: str = "ply", partition_bytes: int = PARTITION_BYTES, file_points: int = FILE_POINTS) -> DataFrame:
    """(cloud, part, idx, x, y, z, nx, ny, nz, r, g, b) of all files below a path; idx numbers a cloud's points, what a file lacks is null.

    file_points: that of write_clouds(), by which the parts of a greater cloud follow each other.
    """
    spark.dataSource.register(CloudFiles)
    found = spark.read.format("cloud_files").option("kind", kind).option("partitionBytes", partition_bytes).load(path)
    return found.withColumn("idx", F.col("idx") + F.col("part").cast("long") * file_points)
