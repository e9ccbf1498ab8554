"""Exact nearest neighbours in point clouds of any size: a grid, rings of neighbour cells, and a stop that proves itself.

Points are laid into cells; each place looks at its own cell and the ring around it, and is done once its k-th neighbour is nearer
than any cell that it has not seen can be.  The others look again in cells three times as wide, and so on.  The first cells are so
small that none is crowded, so a hot cloud, or a dense corner of one, is spread over tasks; points of the very same place count as
one place with its first keys, as no later key of it can be among the neighbours.

Cells meet, not places: a row holds a piece of a cell and a piece of one beside it.  The rows of a piece come one after another, and
of the distances taken only the least are held, so a task's memory has a bound for any cloud.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import scratch

#: Places that a cell of the first round may hold for each neighbour asked for, levels of cells that are tried for that, and how much wider each next round's are.
CROWD, LEVELS, WIDER = 24, 6, 3.0
#: Places of a cell in a piece that looks and in one that is seen, pairs whose distances are taken at once, and tasks for each core.
LOOKING, SEEN, PAIRS, DEALT = 512, 4096, 1 << 16, 2


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _cells(coordinates: list[str], side: Column) -> list[Column]:
    return [F.floor((F.col(c) - F.col(f"_lo_{c}")) / side).cast("long") for c in coordinates]


def _sides(places: DataFrame, group: str, coordinates: list[str], k: int) -> DataFrame:
    """(group, _lo_*, _reach, _side): the least corner and the greatest extent of each cloud, and the side of its first cells."""
    extents = [F.max(c).cast("double") - F.min(c).cast("double") for c in coordinates]
    sizes = places.groupBy(group).agg(F.count("*").alias("_n"), F.array(*extents).alias("_e"), *(F.min(c).cast("double").alias(f"_lo_{c}") for c in coordinates))
    real = F.filter("_e", lambda e: e > 0)
    volume = F.aggregate(real, F.lit(1.0), lambda a, e: a * e)
    even = F.when(F.size(real) > 0, F.pow(volume * max(1.0, k / 2) / F.col("_n"), 1.0 / F.size(real))).otherwise(1.0)  # half of k in a cell of an even cloud
    sizes = sizes.withColumn("_reach", F.array_max("_e"))
    small = F.col("_n") <= CROWD * k  # then one cell holds the cloud, and its first round is the last
    sizes = sizes.withColumn("_even", F.when(small, 2 * F.col("_reach") + 1).when(even > 0, even).otherwise(1.0)).drop("_e", "_n")
    leveled = places.join(sizes, group).withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    side = F.col("_even") / F.pow(F.lit(4.0), F.col("_level"))
    crowd = leveled.groupBy(group, "_level", *(x.alias(f"_c{i}") for i, x in enumerate(_cells(coordinates, side)))).agg(F.count("*").alias("_n"))
    crowd = crowd.groupBy(group, "_level").agg(F.max("_n").alias("_n"))
    level = crowd.groupBy(group).agg(F.coalesce(F.min(F.when(F.col("_n") <= CROWD * k, F.col("_level"))), F.lit(LEVELS - 1)).alias("_level"))
    return sizes.join(level, group).withColumn("_side", F.col("_even") / F.pow(F.lit(4.0), F.col("_level"))).drop("_even", "_level")


def _kind(df: DataFrame, coordinates: list[str]) -> T.DataType:
    """What distances are: whole for whole coordinates."""
    kinds = [df.schema[c].dataType for c in coordinates]
    return T.LongType() if all(isinstance(x, T.IntegralType) for x in kinds) else T.FloatType() if all(isinstance(x, T.FloatType) for x in kinds) else T.DoubleType()


class _Looking:
    """Some places, and of each the k nearest, by squared distance and least key, of the places that are shown to them bit by bit."""

    def __init__(self, here: pa.StructArray, coordinates: list[str], k: int, kind: type):
        self.here, self.coordinates, self.k, self.kind = here, coordinates, k, kind
        self.at = self._places(here)
        self.limit = np.full(len(here), np.inf if kind != np.int64 else np.iinfo(kind).max, kind)
        self.waiting, self.n, self.near = [], 0, None

    def _places(self, rows: pa.StructArray) -> list[np.ndarray]:
        return [rows.field(c).to_numpy(zero_copy_only=False).astype(self.kind) for c in self.coordinates]

    def show(self, there: pa.StructArray) -> None:
        self.waiting.append(there)
        self.n += len(there)
        if self.n * len(self.here) >= PAIRS:
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        there, k, found = pa.concat_arrays(self.waiting), self.k, []
        self.waiting, self.n = [], 0
        seen, step = self._places(there), max(1, PAIRS // len(there))
        for a in range(0, len(self.here), step):
            gaps = [y - x[a : a + step, None] for x, y in zip(self.at, seen, strict=True)]
            d, limit = reduce(lambda p, q: p + q, [g * g for g in gaps]), self.limit[a : a + step]
            if len(there) > k:
                limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
            i, j = np.nonzero(d <= limit[:, None])  # those as far as the k-th too: keys decide
            found.append((i + a, j, d[i, j]))
        i, j, d = map(np.concatenate, zip(*found, strict=True))
        if self.near is not None:
            i, j, d = (np.concatenate(x) for x in ((self.near[0], i), (np.arange(len(self.near[0])), j + len(self.near[0])), (self.near[2], d)))
            there = pa.concat_arrays([self.near[1], there])
        first = np.unique(there.field("_first").to_numpy(zero_copy_only=False), return_inverse=True)[1]
        order = np.lexsort((first[j], d, i))
        i, j, d = i[order], j[order], d[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        self.limit[i[rank == k - 1]] = d[rank == k - 1]
        kept = rank < k
        self.near = i[kept], there.take(pa.array(j[kept])), d[kept]

    def told(self, chunk: pa.StructArray) -> list[pa.Array]:
        """(chunk, place, its nearest) for each of the places."""
        self.settle()
        i, there, d = self.near
        offsets = pa.array(np.searchsorted(i, np.arange(len(self.here) + 1)).astype(np.int32))
        near = pa.StructArray.from_arrays([pa.array(d), there], ["d", "place"])
        return [chunk.take(pa.array(np.zeros(len(self.here), np.int64))), self.here, pa.ListArray.from_arrays(offsets, near)]


def _looked(met: DataFrame, coordinates: list[str], k: int, kind: T.DataType) -> DataFrame:
    """(chunk, place, near) from rows (_chunk, _here, _there), those of a chunk one after another."""
    chunk, here, there = (f.dataType for f in met.schema)
    near = T.StructType([T.StructField("d", kind), T.StructField("place", there.elementType)])
    names, number = ["_chunk", "_place", "_near"], {T.LongType(): np.int64, T.FloatType(): np.float32}.get(kind, np.float64)
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, (chunk, here.elementType, T.ArrayType(near)), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, now, last, of = [], 0, None, None, None
        whole = lambda: pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*out, strict=True)], names)
        for b in batches:
            for r, said in enumerate(map(repr, b.column(0).to_pylist())):
                if said != last:
                    if now is not None:
                        out.append(now.told(of))
                        n += len(now.here)
                    if n >= SEEN:
                        yield whole()
                        out, n = [], 0
                    now, last, of = _Looking(b.column(1)[r].values, coordinates, k, number), said, b.column(0).slice(r, 1)
                now.show(b.column(2)[r].values)
        if now is not None:
            out.append(now.told(of))
            yield whole()

    return met.mapInArrow(run, schema)


def _pieces(df: DataFrame, cell: list[str], coordinates: list[str], most: int) -> DataFrame:
    """df with _piece: the places of a cell of more than most are dealt out."""
    crowded = df.groupBy(*cell).agg(F.ceil(F.count("*") / most).alias("_n")).where("_n > 1")
    return df.join(crowded, cell, "left").withColumn("_piece", F.coalesce(F.pmod(F.xxhash64(*coordinates), F.col("_n")), F.lit(0).cast("long"))).drop("_n")


def neighbour_lists(points: DataFrame, group: str, key: str, coordinates: list[str], k: int) -> DataFrame:
    """(group, coordinates, near): for each place the k points nearest to it, those at the place among them, as (d, key, at), nearer first, then by key.

    d is the squared distance, at the neighbour's coordinates, which are whole numbers or floats.
    """
    rows = points.select(group, key, *coordinates).dropna(subset=[group, *coordinates])
    kind = _kind(rows, coordinates)
    first = Window.partitionBy(group, *coordinates).orderBy(key)
    places = rows.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).groupBy(group, *coordinates).agg(F.array_sort(F.collect_list(key)).alias("_keys"))
    places = _staged(places, "places")
    sides = _sides(places, group, coordinates, k)
    if isinstance(kind, T.LongType):  # a square beyond 64 bits would wrap around
        far = F.raise_error(F.lit("whole coordinates are too far apart")).cast("boolean")
        sides = sides.where(F.when(F.col("_reach") < (2.0**63 / len(coordinates)) ** 0.5 * (1 - 1e-9), True).otherwise(far))
    laid = _staged(places.join(sides, group), "laid")
    steps = F.array(*[F.array(*[F.lit(x - 1).cast("long") for x in np.unravel_index(i, (3,) * len(coordinates))]) for i in range(3 ** len(coordinates))])
    names, of = [f"_c{i}" for i in range(len(coordinates))], ["_side", "_reach", *(f"_lo_{c}" for c in coordinates)]
    cell, tasks = [group, *names], DEALT * points.sparkSession.sparkContext.defaultParallelism
    rest, done, wide = laid.drop("_keys"), [], 1.0
    while True:
        at = dict(zip(names, _cells(coordinates, F.col("_side") * wide), strict=True))
        there = _pieces(laid.withColumns(at), cell, coordinates, SEEN).groupBy(*cell, "_piece").agg(F.collect_list(F.struct(*coordinates, "_keys", F.get("_keys", F.lit(0)).alias("_first"))).alias("_there"))
        here = _pieces(rest.withColumns(at), cell, coordinates, LOOKING).groupBy(*cell, "_piece", *of).agg(F.collect_list(F.struct(*coordinates)).alias("_here"))
        here = here.select(*cell, F.struct(*cell, "_piece", *of).alias("_chunk"), "_here", F.explode(steps).alias("_step"))
        here = here.withColumns({n: F.col(n) + F.col("_step")[i] for i, n in enumerate(names)}).drop("_step")
        met = here.join(there.drop("_piece"), cell).select("_chunk", "_here", "_there").repartition(tasks, "_chunk").sortWithinPartitions("_chunk")
        # of more places than k none beyond the first k, by distance and least key, has a neighbour
        pairs = F.flatten(F.transform("_near", lambda n: F.transform(n["place"]["_keys"], lambda x: F.struct(n["d"].alias("d"), x.alias("key"), F.array(*(n["place"][c] for c in coordinates)).alias("at")))))
        found = _looked(met, coordinates, k, kind).select(f"_chunk.{group}", *(f"_place.{c}" for c in coordinates), F.slice(F.array_sort(pairs), 1, k).alias("near"), *(f"_chunk.{c}" for c in of))
        proved = (F.size("near") == k) & (F.element_at("near", -1)["d"] < F.pow(F.col("_side") * wide, F.lit(2)) * (1 - 1e-9))
        found = _staged(found.withColumn("_done", proved | (F.col("_reach") < F.col("_side") * wide)), "near")
        done.append(found.where("_done").select(group, *coordinates, "near"))
        rest = found.where("NOT _done").drop("near", "_done")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, done)
        wide *= WIDER


def nearest(points: DataFrame, group: str, key: str, coordinates: list[str], k: int) -> DataFrame:
    """(group, key, neighbour, rank): the k nearest others within a group, nearer first, then by key; keys are unique within a group.

    Rows without a group or a coordinate take no part; a group of fewer points gives fewer neighbours; an empty table gives nothing.
    """
    lists = neighbour_lists(points, group, key, coordinates, k + 1)
    met = points.select(group, key, *coordinates).join(lists, [group, *coordinates])
    others = F.slice(F.filter("near", lambda x: x["key"] != F.col(key)), 1, k)
    return met.select(group, key, F.posexplode(others).alias("_p", "_x")).select(group, key, F.col("_x.key").alias("neighbour"), (F.col("_p") + 1).cast("int").alias("rank"))


def normals(points: DataFrame, group: str, key: str, coordinates: list[str], k: int = 10, camera: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """(group, key, nx, ny, nz): unit normal of the plane through each point and its k nearest neighbours, turned towards the camera.

    Of fewer than three points the normal is the z axis.
    """
    lists = neighbour_lists(points, group, key, coordinates, k + 1).withColumn("near", F.transform("near", lambda x: x["at"].cast("array<double>")))

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            place, sizes = b[coordinates].to_numpy(float), b["near"].map(len).to_numpy()
            out = np.tile([0.0, 0.0, 1.0], (len(b), 1))
            for m in np.unique(sizes[sizes > 2]):
                at = np.flatnonzero(sizes == m)
                near = np.array([np.stack(x) for x in b["near"].iloc[at]], float)
                out[at] = np.linalg.svd(near - near.mean(1, keepdims=True), full_matrices=False)[2][:, -1, :]
            out[((np.array(camera) - place) * out).sum(1) < 0] *= -1
            yield b[[group, *coordinates]].assign(nx=out[:, 0], ny=out[:, 1], nz=out[:, 2])

    types = dict(points.dtypes)
    kinds = ", ".join(f"`{c}` {types[c]}" for c in (group, *coordinates))
    planes = lists.mapInPandas(one, f"{kinds}, nx double, ny double, nz double")
    return points.select(group, key, *coordinates).join(planes, [group, *coordinates]).select(group, key, "nx", "ny", "nz")
