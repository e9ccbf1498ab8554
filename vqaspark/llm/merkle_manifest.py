"""Operator 12: a Merkle manifest of a table, with a proof for each row.

Rows are sorted into indexed partitions (group, order of the group, place).  In each partition a mountain-range stack takes the
leaves one by one: a run of ``fanout`` nodes carries into its parent as a counter of that base does, the last run of a level
ends where the level does, without padding, and each member of a run records its siblings.  Runs that begin or end in another
partition stay behind as peaks.  Peaks of neighbouring partitions are stacked in the same way, 64 partitions at a time, until
each group has its root; proofs are then put together from the top down.  A partition leaves at most
``2 * fanout * log(rows)`` peaks, so no task sees more than 64 times that beyond its own partition.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Partitions whose peaks one task merges.
MERGED = 64
PATH = "array<struct<left:string,right:string>>"
PATH_ARROW = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def encoded_fields(fields: list[Column]) -> Column:
    """The fields of a leaf as one string: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    return F.concat(*[F.coalesce(F.concat(F.octet_length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string")), F.lit("-")) for x in fields])


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(encoded_fields(fields).cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda held, x: F.sha2(F.concat(x["left"], held, x["right"]).cast("binary"), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof in one string, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda x: F.concat(x["left"], x["right"])), "")


class Stack:
    """The mountain range of one group: nodes come in order of the leaves below them, complete runs become their parents."""

    def __init__(self, total: int, fanout: int):
        self.fanout, self.counts = fanout, [total]
        while self.counts[-1] > 1:
            self.counts.append(-(-self.counts[-1] // fanout))
        self.open: dict[int, tuple[int, list[str]]] = {}  # by level: index of the first node of the run at hand, its digests
        self.steps: dict[tuple[int, int], tuple[str, str]] = {}  # siblings on the left and right of each node of a complete run
        self.peaks: list[tuple[int, int, str]] = []

    def _leave(self, level: int) -> None:
        first, run = self.open.pop(level, (0, []))
        self.peaks.extend((level, first + i, x) for i, x in enumerate(run))

    def push(self, level: int, index: int, digest: str) -> None:
        f = self.fanout
        while self.counts[level] > 1:
            first, run = self.open.get(level, (index, []))
            if first + len(run) != index:  # what lies between is in another partition
                self._leave(level)
                first, run = index, []
            run.append(digest)
            self.open[level] = first, run
            if (index + 1) % f and index + 1 != self.counts[level]:
                return
            if first % f:
                self._leave(level)
                return
            del self.open[level]
            if len(run) == 2:
                self.steps[level, first], self.steps[level, first + 1] = ("", run[1]), (run[0], "")
            else:
                for i in range(len(run)):
                    self.steps[level, first + i] = "".join(run[:i]), "".join(run[i + 1 :])
            level, index, digest = level + 1, index // f, hashlib.sha256("".join(run).encode()).hexdigest()
        self.peaks.append((level, 0, digest))

    def close(self) -> list[tuple[int, int, str]]:
        for level in list(self.open):
            self._leave(level)
        return self.peaks

    def path(self, level: int, index: int) -> tuple[int, int, list[tuple[str, str]]]:
        """The peak above a node, and the siblings on the way to it."""
        out = []
        while (step := self.steps.get((level, index))) is not None:
            out.append(step)
            level, index = level + 1, index // self.fanout
        return level, index, out


def _stacks(t: pa.Table, fanout: int) -> list[tuple[str, int, Stack, int, int]]:
    """(group, total, stack, first row, end) of each group of a partition's rows, which are sorted."""
    grp, total, level, index, digest = (t.column(c).to_pylist() for c in ("grp", "total", "level", "index", "digest"))
    out, at = [], 0
    for i in range(len(grp) + 1):
        if i == len(grp) or grp[i] != grp[at]:
            if i > at:
                stack = Stack(total[at], fanout)
                for j in range(at, i):
                    stack.push(level[j], index[j], digest[j])
                stack.close()
                out.append((grp[at], total[at], stack, at, i))
            at = i
    return out


def _in_order(t: pa.Table, fanout: int) -> pa.Table:
    first = pa.array([x * fanout**y for x, y in zip(t.column("index").to_pylist(), t.column("level").to_pylist(), strict=True)], pa.int64())
    t = t.append_column("_first", first).sort_by([("grp", "ascending"), ("_first", "ascending")])
    return t.drop_columns(["_first"])


def _peaks(nodes: DataFrame, fanout: int) -> DataFrame:
    """(grp, total, part, level, index, digest, top): what each partition's stacks leave."""

    def run(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        found = [(g, n, part, *peak, s.counts[peak[0]] == 1) for g, n, s, _, _ in _stacks(_in_order(t, fanout), fanout) for peak in s.peaks]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_())
        names = ("grp", "total", "part", "level", "index", "digest", "top")
        return pa.Table.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)], names=list(names))

    return nodes.select("grp", "total", "part", "level", "index", "digest").groupBy("part").applyInArrow(run, "grp string, total long, part long, level int, index long, digest string, top boolean")


def _paths(nodes: DataFrame, fanout: int) -> DataFrame:
    """nodes with the peak above each and the siblings on the way: up_level, up_index, path."""

    def run(t: pa.Table) -> pa.Table:
        t = _in_order(t, fanout)
        level, index = t.column("level").to_pylist(), t.column("index").to_pylist()
        up = [s.path(level[j], index[j]) for _, _, s, a, b in _stacks(t, fanout) for j in range(a, b)]
        t = t.append_column("up_level", pa.array([x[0] for x in up], pa.int32())).append_column("up_index", pa.array([x[1] for x in up], pa.int64()))
        step = 20_000  # the path of a slice at a time
        return t.append_column("path", pa.chunked_array([pa.array([x[2] for x in up[i : i + step]], PATH_ARROW) for i in range(0, len(up), step)], PATH_ARROW))

    kept = ", ".join(f"`{c}` {k}" for c, k in nodes.dtypes)
    return nodes.groupBy("part").applyInArrow(run, f"{kept}, up_level int, up_index long, path {PATH}")


def indexed(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df (grp, digest, ...) with total, part, level 0 and index: the place in its group by ``order``, rows that are alike in any order."""
    keys = ["grp", *order, "_tie"]
    rows = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = staged(rows.select(*df.columns, F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_row")), name)
    counts = rows.groupBy("grp", "part").agg(F.count("*").alias("_n"), F.min("_row").alias("_least"))
    ordered = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("grp", "part", "_least", F.coalesce(F.sum("_n").over(ordered), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("grp")).alias("total"))
    placed = rows.join(counts, ["grp", "part"]).withColumn("index", F.col("_before") + F.col("_row") - F.col("_least"))
    return placed.select(*df.columns, "total", "part", F.lit(0).alias("level"), "index")


def forest(leaves: DataFrame, fanout: int) -> tuple[DataFrame, DataFrame]:
    """(the leaves with their path to the root of their group, (grp, digest) of the roots)."""
    last = leaves.agg(F.max("part")).first()[0]
    parts = 0 if last is None else last + 1
    layers, roots = [leaves], []
    while True:
        peaks = staged(_peaks(layers[-1], fanout), "merkle-peaks")
        roots.append(peaks.where("top").select("grp", "digest"))
        if parts <= 1:
            break
        parts = -(-parts // MERGED)
        layers.append(peaks.where("NOT top").select("grp", "total", F.expr(f"part div {MERGED}").alias("part"), "level", "index", "digest"))
    above = None
    for layer in reversed(layers):
        here = _paths(layer, fanout)
        if above is not None:
            rest = above.select("grp", F.col("level").alias("up_level"), F.col("index").alias("up_index"), F.col("path").alias("_rest"))
            here = here.join(rest, ["grp", "up_level", "up_index"], "left").withColumn("path", F.concat("path", F.coalesce("_rest", F.array().cast(PATH)))).drop("_rest")
        above = here
    found = roots[0]
    for r in roots[1:]:
        found = found.unionByName(r)
    return above, found


def manifest(df: DataFrame, fields: list[str], group: str, order: str, fanout: int = 2, keep: dict[str, Column] | None = None) -> DataFrame:
    """(order column, leaf, subroot, root, proof, and the columns of ``keep``) for every row of df.

    A leaf is the SHA-256 of the row's ``fields``, null or not; leaves of a group ascend by ``order`` (a long; null first; equal
    ones by their digest) and every ``fanout`` consecutive nodes, fewer at a level's end, become one until one remains, the
    subroot.  Subroots in order of the groups (null first, then by bytes) give the root in the same way.  proof holds the
    siblings on the left and right of each node on the way up.  Repeated rows are leaves of their own; other columns are not
    read; bytes that are no UTF-8 are hashed as they are; an empty table gives an empty result.
    """
    if fanout < 2:
        raise ValueError("fanout must be 2 or more")
    # hexadecimal keeps the order of bytes, and a null group comes before the empty one
    grp = F.coalesce(F.concat(F.lit("="), F.hex(F.col(group).cast("string").cast("binary"))), F.lit(""))
    keep = keep or {}
    leaves = df.select(grp.alias("grp"), F.col(order).cast("long").alias("_order"), leaf_digest([F.col(x) for x in fields]).alias("digest"), *[c.alias(f"keep_{n}") for n, c in keep.items()])
    rows, subroots = forest(indexed(staged(leaves, "merkle-leaves"), ["_order", "digest"], "merkle-sorted"), fanout)
    tops = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("_member"), "digest")
    above, _ = forest(indexed(tops, ["_member"], "merkle-subroots"), fanout)
    above = staged(above.select(F.col("_member").alias("grp"), F.col("digest").alias("subroot"), folded(F.col("digest"), F.col("path")).alias("root"), F.col("path").alias("_rest")), "merkle-roots")
    joined = rows.join(above, "grp")
    return joined.select(F.col("_order").alias(order), F.col("digest").alias("leaf"), "subroot", "root", F.concat("path", "_rest").alias("proof"), *[F.col(f"keep_{n}").alias(n) for n in keep])
