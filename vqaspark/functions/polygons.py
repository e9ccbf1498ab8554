"""Convex polygons as array<struct<x:double,y:double>>, counter-clockwise, all in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import let

POLYGON = "array<struct<x:double,y:double>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rotated_rectangle(cx: Column, cy: Column, w: Column, h: Column, degrees: Column) -> Column:
    """The corners of a rectangle turned counter-clockwise around its centre."""
    cos, sin = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    corner = lambda a, b: point(cx + a * w / 2 * cos - b * h / 2 * sin, cy + a * w / 2 * sin + b * h / 2 * cos)
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)).cast(POLYGON)


def _cross(a: Column, b: Column, p: Column) -> Column:
    """Positive where p lies on the left of the line from a to b."""
    return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])


def _left_of(polygon: Column, a: Column, b: Column) -> Column:
    """The part of a polygon on the left of a line."""

    def edge(p: Column, q: Column) -> Column:
        here, there = _cross(a, b, p), _cross(a, b, q)
        share = F.try_divide(here, here - there)
        cut = point(p["x"] + share * (q["x"] - p["x"]), p["y"] + share * (q["y"] - p["y"]))
        inside, enters = F.when(there >= 0, F.array(p)).otherwise(F.array(p, cut)), F.when(there >= 0, F.array(cut)).otherwise(F.array().cast(POLYGON))
        return F.when(here >= 0, inside).otherwise(enters).cast(POLYGON)

    return F.flatten(F.transform(polygon, lambda p, i: edge(p, F.get(polygon, ((i + 1) % F.size(polygon)).cast("int"))))).cast(POLYGON)


def intersection(a: Column, b: Column) -> Column:
    """The common part of two convex polygons: a, cut along each edge of b; empty if there is none."""
    edges = lambda b: F.transform(b, lambda p, i: F.struct(p.alias("p"), F.get(b, ((i + 1) % F.size(b)).cast("int")).alias("q")))
    return F.aggregate(let(b.cast(POLYGON), edges), a.cast(POLYGON), lambda held, e: _left_of(held, e["p"], e["q"]))


def area(polygon: Column) -> Column:
    turn = lambda p, q: p["x"] * q["y"] - p["y"] * q["x"]
    turns = lambda polygon: F.transform(polygon, lambda p, i: turn(p, F.get(polygon, ((i + 1) % F.size(polygon)).cast("int"))))
    return F.aggregate(let(polygon.cast(POLYGON), turns), F.lit(0.0), lambda a, x: a + x) / 2


def polygon_iou(a: Column, b: Column) -> Column:
    """Common area by joint area of two convex polygons; 0 where neither has an area."""
    areas = F.struct(area(intersection(a, b)).alias("common"), area(a).alias("a"), area(b).alias("b"))
    return let(areas, lambda x: F.coalesce(F.try_divide(x["common"], x["a"] + x["b"] - x["common"]), F.lit(0.0)))


#: Signs of a rectangle's corners along its width and height, counter-clockwise.
CORNERS = ((-1, -1), (1, -1), (1, 1), (-1, 1))


def overlap_terms(df: DataFrame, a: list[Column], b: list[Column], name: str) -> DataFrame:
    """Eight rows for each of df, with the terms that sum up to the common area of two turned rectangles (cx, cy, w, h, degrees).

    A term is half the line integral of x dy - y dx over the part of an edge that lies within the other rectangle, cut in that
    one's frame: first a's edges, then b's, each from the first corner on.
    """
    kept, parts = [F.col(c) for c in df.columns], ("cx", "cy", "w", "h", "cos", "sin")
    turned = lambda r: [*(v.cast("double") for v in r[:4]), F.cos(F.radians(r[4])), F.sin(F.radians(r[4]))]
    edges = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("own", "s0", "t0", "s1", "t1"), (own, *CORNERS[i], *CORNERS[(i + 1) % 4]), strict=True))) for own in (True, False) for i in range(4)))
    d = df.select(*kept, *(v.alias(f"_{k}_{p}") for k, r in (("a", a), ("b", b)) for p, v in zip(parts, turned(r), strict=True)))
    d = d.select("*", F.explode(edges).alias("_e"))
    pick = lambda own, p: F.when(F.col("_e.own") == own, F.col(f"_a_{p}")).otherwise(F.col(f"_b_{p}"))
    d = d.select(*kept, "_e", *(pick(True, p).alias(f"_m_{p}") for p in parts), *(pick(False, p).alias(f"_o_{p}") for p in parts))
    mine, other = ({p: F.col(f"_{k}_{p}") for p in parts} for k in "mo")
    corner = lambda s, t: (mine["cx"] + s * mine["w"] / 2 * mine["cos"] - t * mine["h"] / 2 * mine["sin"], mine["cy"] + s * mine["w"] / 2 * mine["sin"] + t * mine["h"] / 2 * mine["cos"])
    ends = zip(("_x", "_y", "_x1", "_y1"), (*corner(F.col("_e.s0"), F.col("_e.t0")), *corner(F.col("_e.s1"), F.col("_e.t1"))), strict=True)
    others = [F.col(f"_o_{p}") for p in parts]
    d = d.select(*kept, *others, *(v.alias(k) for k, v in ends))
    x, y = F.col("_x"), F.col("_y")
    d = d.select(*kept, *others, x, y, (F.col("_x1") - x).alias("_dx"), (F.col("_y1") - y).alias("_dy"))
    dx, dy = F.col("_dx"), F.col("_dy")
    framed = lambda p, q: (p * other["cos"] + q * other["sin"], q * other["cos"] - p * other["sin"])
    (u, v), (du, dv) = framed(x - other["cx"], y - other["cy"]), framed(dx, dy)
    d = d.select(*kept, x, y, dx, dy, *(c.alias(k) for k, c in {"_u": u, "_v": v, "_du": du, "_dv": dv, "_w": other["w"] / 2, "_h": other["h"] / 2}.items()))
    enter, leave = zip(*(_shares(F.col(f"_{at}"), F.col(f"_d{at}"), F.col(half)) for at, half in (("u", "_w"), ("v", "_h"))), strict=True)
    d = d.select(*kept, x, y, dx, dy, F.greatest(F.lit(0.0), *enter).alias("_in"), F.least(F.lit(1.0), *leave).alias("_out"))
    start, z = F.col("_in"), F.col("_out")
    part = ((x + start * dx) * (y + z * dy) - (y + start * dy) * (x + z * dx)) / 2
    return d.select(*kept, F.when(start < z, part).otherwise(0.0).alias(name))


def _shares(at: Column, step: Column, half: Column) -> tuple[Column, Column]:
    """Where a point that moves by step enters and leaves -half..half; one that stands still is always within, or never."""
    one, other = F.try_divide(-half - at, step), F.try_divide(half - at, step)
    still = lambda low, high: F.when(F.abs(at) <= half, F.lit(low)).otherwise(F.lit(high))
    inf = float("inf")
    return F.when(step == 0, still(-inf, inf)).otherwise(F.least(one, other)), F.when(step == 0, still(inf, -inf)).otherwise(F.greatest(one, other))
