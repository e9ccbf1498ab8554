"""Point-cloud operators that are sequential or need linear algebra, in Arrow-backed pandas groups.

Where a whole cloud is one group (farthest points), it is what one object file holds, bounded by that format and not by the table.
Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import shuffled


def farthest_points(df: DataFrame, group: str, key: str, coordinates: list[str], k: int) -> DataFrame:
    """(group, key, rank): greedy farthest-point samples from the point with the least key; ties by key."""

    def pick(cloud: pd.DataFrame) -> pd.DataFrame:
        cloud = cloud.sort_values(key, kind="stable")
        x = cloud[coordinates].to_numpy(float)
        far, at, chosen = np.full(len(x), np.inf), 0, []
        for _ in range(min(k, len(x))):
            chosen.append(at)
            far = np.minimum(far, ((x - x[at]) ** 2).sum(1))
            far[at] = -1
            at = int(far.argmax())
        return pd.DataFrame({group: cloud[group].iloc[chosen].to_numpy(), key: cloud[key].iloc[chosen].to_numpy(), "rank": np.arange(len(chosen), dtype=np.int32)})

    types = dict(df.dtypes)
    return df.select(group, key, *coordinates).groupBy(group).applyInPandas(pick, f"{group} {types[group]}, {key} {types[key]}, rank int")


def hull(p: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, by monotone chains."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def chain(points):
        out: list[list[float]] = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    rows = p.tolist()  # plain numbers: indexing an array costs more than the arithmetic
    return np.array(chain(rows) + chain(rows[::-1]))


def min_rectangle(p: np.ndarray) -> tuple[float, float, float, float, float]:
    """cx, cy, w, h, angle in degrees of the rectangle of least area; an edge of the hull lies on it."""
    h = hull(p)
    if len(h) < 3:
        lo, hi = p.min(0), p.max(0)
        return (*((lo + hi) / 2), *(hi - lo), 0.0)
    edges = np.diff(np.vstack([h, h[:1]]), axis=0)
    angles = np.unique(np.mod(np.arctan2(edges[:, 1], edges[:, 0]), np.pi / 2))
    c, s = np.cos(angles)[:, None], np.sin(angles)[:, None]
    areas = np.ptp(c * h[:, 0] + s * h[:, 1], axis=1) * np.ptp(c * h[:, 1] - s * h[:, 0], axis=1)
    best = None
    for a in angles[areas <= areas.min() * (1 + 1e-9) + 1e-9]:  # the rest are greater by more than rounding
        turn = np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])
        q = h @ turn.T
        lo, hi = q.min(0), q.max(0)
        area = float(np.prod(hi - lo))
        if best is None or area < best[0] - 1e-12:
            best = (area, (*(((lo + hi) / 2) @ turn), *(hi - lo), float(np.degrees(a))))
    return best[1]


def hulls(df: DataFrame, group: str, x: str, y: str, held: int = 1 << 16) -> DataFrame:
    """(group, x, y): points of each task's share of a group without those inside its hull; the hull of a group is that of what is left.

    A task keeps the hulls of its groups and at most ``held`` points beyond them, whatever the size of a group.
    """
    kind = dict(df.dtypes)[group]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[object, list[np.ndarray]] = {}
        waiting = 0

        def left() -> Iterator[pd.DataFrame]:
            found = [hull(np.concatenate(parts)) for parts in kept.values()]
            if found:  # in one table: a group has few points
                p = np.concatenate(found)
                yield pd.DataFrame({group: pd.Series(list(kept)).repeat([len(f) for f in found]).to_numpy(), x: p[:, 0], y: p[:, 1]})

        for b in batches:
            codes, names = pd.factorize(b[group], use_na_sentinel=False)
            rows = np.argsort(codes, kind="stable")
            cuts = np.flatnonzero(np.diff(codes[rows])) + 1
            for g, part in zip(names, np.split(b[[x, y]].to_numpy(float)[rows], cuts)):
                kept.setdefault(g, []).append(hull(part[~np.isnan(part).any(1)]))
                waiting += len(kept[g][-1])
            if waiting > held:
                kept = {g: [hull(np.concatenate(parts))] for g, parts in kept.items()}
                waiting = sum(len(p[0]) for p in kept.values())
                if waiting > held // 2:  # many groups: they go on as they are
                    yield from left()
                    kept, waiting = {}, 0
        yield from left()

    return df.select(group, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).mapInPandas(run, f"`{group}` {kind}, `{x}` double, `{y}` double")


def oriented_boxes(df: DataFrame, group: str, x: str, y: str, z: str, square: float = 0.1, least: int = 8) -> DataFrame:
    """(group, cx, cy, w, h, angle, zmin, zmax): the least rectangle in x and y with the range of z.

    A nearly square rectangle whose box along the axes has nearly its sides (a circle, not a turned square) falls back to that
    box; so does a cloud of fewer than ``least`` points.  Only hulls are shuffled: first each task's own, then those of a group's
    parts, dealt out by a hash, so that a hot cloud is merged by several tasks before one takes what is left.  Points without a
    coordinate take no part.
    """
    rows = df.select(group, *(F.col(c).cast("double").alias(c) for c in (x, y, z))).dropna(subset=[group, x, y])
    ranges = rows.groupBy(group).agg(*(f(c).alias(f"_{n}_{c}") for c in (x, y, z) for n, f in (("lo", F.min), ("hi", F.max))), F.count("*").alias("_n"))
    shares = hulls(rows, group, x, y).withColumn("_deal", F.pmod(F.xxhash64(x, y), F.lit(16)))
    merged = hulls(shares.repartition(group, "_deal"), group, x, y)

    def one(flat: np.ndarray, n: int, lo: np.ndarray, hi: np.ndarray) -> tuple[float, ...]:
        cx, cy, w, h, angle = min_rectangle(np.asarray(flat).reshape(-1, 2))
        long, short = max(w, h), min(w, h)
        round_ = long - short < square * short and abs(max(hi - lo) - long) < square * long and abs(min(hi - lo) - short) < square * short
        if n < least or round_:
            (cx, cy), (w, h), angle = (lo + hi) / 2, hi - lo, 0.0
        return cx, cy, w, h, angle

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            los, his = (b[[f"_{n}_{c}" for c in (x, y)]].to_numpy(float) for n in ("lo", "hi"))
            boxes = np.array([one(*told) for told in zip(b["_hull"], b["_n"], los, his, strict=True)], float).reshape(-1, 5)
            yield pd.DataFrame({group: b[group]} | {c: boxes[:, k] for k, c in enumerate(("cx", "cy", "w", "h", "angle"))} | {"zmin": b[f"_lo_{z}"], "zmax": b[f"_hi_{z}"]})

    kind = dict(df.dtypes)[group]
    whole = merged.groupBy(group).agg(F.flatten(F.collect_list(F.array(x, y))).alias("_hull")).join(ranges, group)
    return whole.mapInPandas(run, f"`{group}` {kind}, cx double, cy double, w double, h double, angle double, zmin double, zmax double")


def unit_sphere(df: DataFrame, group: str, coordinates: list[str]) -> DataFrame:
    """df with its coordinates relative to the group's mean, in units of the greatest distance from it (a single place gives 0)."""
    means = df.groupBy(group).agg(*(F.avg(c).alias(f"_{c}") for c in coordinates))
    centred = df.join(means, group).withColumns({c: F.col(c) - F.col(f"_{c}") for c in coordinates}).drop(*(f"_{c}" for c in coordinates))
    square = F.col(coordinates[0]) * F.col(coordinates[0])
    for c in coordinates[1:]:
        square = square + F.col(c) * F.col(c)
    radius = centred.groupBy(group).agg(F.max(F.sqrt(square)).alias("_radius"))
    return centred.join(radius, group).withColumns({c: F.coalesce(F.try_divide(c, "_radius"), F.lit(0.0)) for c in coordinates}).drop("_radius")


def unit_colour(df: DataFrame, group: str, colours: list[str]) -> DataFrame:
    """df with its colours within 0..1: those of a cloud with any above 1 are taken as 0..255."""
    most = df.groupBy(group).agg(F.max(F.greatest(*colours)).alias("_most"))
    scaled = {c: F.least(F.greatest(F.when(F.col("_most") > 1, F.col(c) / 255).otherwise(F.col(c)), F.lit(0.0)), F.lit(1.0)) for c in colours}
    return df.join(most, group).withColumns(scaled).drop("_most")


def jittered(df: DataFrame, columns: list[str], spread: float, seed: int = 0) -> DataFrame:
    """Gaussian noise on columns, by Spark's seeded generator."""
    return df.withColumns({c: F.col(c) + spread * F.randn(seed + i) for i, c in enumerate(columns)})


def camera_poses(df: DataFrame, radius: float, seed: int = 0) -> DataFrame:
    """A camera position on a sphere for each row: equal areas, by Spark's seeded generator."""
    polar, azimuth = F.acos(1 - 2 * F.rand(seed)), 2 * np.pi * F.rand(seed + 1)
    return df.withColumns({"camera_x": radius * F.sin(polar) * F.cos(azimuth), "camera_y": radius * F.sin(polar) * F.sin(azimuth), "camera_z": radius * F.cos(polar)})


def point_subset(df: DataFrame, cloud: str, key: str, k: int, seed: object = 0) -> DataFrame:
    """k points of each cloud without replacement (all of a smaller one): the first in the shuffled order; only a cloud's first k of each task are shuffled."""
    order = df.withColumn("_order", shuffled(F.col(key), seed))
    return order.withColumn("_rank", F.row_number().over(Window.partitionBy(cloud).orderBy("_order", key))).where(F.col("_rank") <= k).drop("_order", "_rank")


def exact_points(df: DataFrame, cloud: str, key: str, idx: str, k: int, seed: object = 0) -> DataFrame:
    """Exactly k points of each cloud: a smaller one repeats from its start, a greater one gives a subset.  idx numbers a cloud's points from 0; ``place`` tells the repeats apart."""
    sized = df.join(df.groupBy(cloud).agg(F.count("*").alias("_n")), cloud)
    repeated = sized.where(F.col("_n") < k).where(F.col(idx) < k).withColumn("place", F.explode(F.sequence(F.col(idx).cast("long"), F.lit(k - 1).cast("long"), F.col("_n"))))
    subset = point_subset(sized.where(F.col("_n") >= k), cloud, key, k, seed).withColumn("place", F.col(idx).cast("long"))
    return repeated.unionByName(subset).drop("_n")
