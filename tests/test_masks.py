"""Rectangles of masks and of clouds against dense images and plain code."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vqaspark.operators import clouds, masks
from vqaspark.plans import catalog


def pixels_of(image):
    return [(int(y), int(x)) for y, x in np.argwhere(image)]


def spans_of(image):
    out = []
    for y, row in enumerate(image):
        edge = np.flatnonzero(np.diff(row.astype(int), prepend=0, append=0))
        out += [(y, a, b - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]
    return np.array(out)


def dense_rectangle(image):
    """The same with flood fill, filled holes and the even-odd area of the filled piece's boundary, all on the dense image."""
    image = image.copy()
    on = np.argwhere(image)
    far = lambda key: tuple(map(int, min(on.tolist(), key=key)))
    for a, b in ((far(lambda p: (p[1], p[0])), far(lambda p: (-p[1], p[0]))), (far(lambda p: (p[0], p[1])), far(lambda p: (-p[0], p[1])))):
        for y, x in masks.line_pixels(a, b):
            image[y, x] = True
    best, todo = None, {tuple(p) for p in np.argwhere(image).tolist()}
    while todo:
        first = min(todo)
        piece, stack = {first}, [first]
        while stack:
            y, x = stack.pop()
            for p in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if p in todo and p not in piece:
                    piece.add(p)
                    stack.append(p)
        todo -= piece
        area = filled_area(piece)
        if best is None or area > best[0]:
            best = (area, piece)
    return clouds.min_rectangle(np.array([(x, y) for y, x in best[1]], float))


def filled_area(piece):
    """Unit squares and half squares between pixel centres of the piece with its holes filled (its outer contour's area)."""
    ys, xs = [p[0] for p in piece], [p[1] for p in piece]
    box = [(y, x) for y in range(min(ys) - 1, max(ys) + 2) for x in range(min(xs) - 1, max(xs) + 2)]
    outside, stack = set(), [box[0]]
    inside = set(box)
    while stack:
        p = stack.pop()
        if p in outside or p in piece or p not in inside:
            continue
        outside.add(p)
        stack += [(p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)]
    solid = inside - outside
    total = 0.0
    for y, x in solid:
        corners = sum((y + i, x + j) in solid for i in (0, 1) for j in (0, 1))
        total += 1.0 if corners == 4 else 0.5 if corners == 3 else 0.0
    for y, x in inside - solid:  # squares whose first corner is missing
        corners = sum((y + i, x + j) in solid for i in (0, 1) for j in (0, 1))
        total += 0.5 if corners == 3 else 0.0
    return total


def drawn(seed):
    rnd, image = random.Random(seed), np.zeros((40, 50), bool)
    for _ in range(rnd.randrange(1, 4)):
        y, x, h, w = rnd.randrange(30), rnd.randrange(40), rnd.randrange(1, 10), rnd.randrange(1, 10)
        image[y : y + h, x : x + w] = True
        if h > 4 and w > 4 and rnd.random() < 0.5:
            image[y + 2 : y + h - 2, x + 2 : x + w - 2] = False  # a hole
    for _ in range(rnd.randrange(5)):
        image[rnd.randrange(40), rnd.randrange(50)] = True
    return image


def sides(box):
    """A rectangle whatever the naming of its sides."""
    cx, cy, w, h, angle = box
    return round(cx, 6), round(cy, 6), *sorted((round(w, 6), round(h, 6)))


def test_rectangles_of_drawn_masks():
    for seed in range(150):
        image = drawn(seed)
        got, want = masks.mask_rectangle(spans_of(image)), dense_rectangle(image)
        assert math.isclose(got[2] * got[3], want[2] * want[3], abs_tol=1e-6), seed


def test_contours():
    ring = np.zeros((7, 7), bool)
    ring[1:6, 1:6] = True
    ring[2:5, 2:5] = False
    assert masks.contour_area(masks.contour(spans_of(ring))) == 16.0 and len(set(masks.contour(spans_of(ring)))) == 16
    assert masks.contour(np.array([(3, 4, 4)])) == [(3, 4)] and masks.contour_area([(3, 4)]) == 0
    line = masks.contour(np.array([(0, 0, 3)]))
    assert set(line) == {(0, x) for x in range(4)} and masks.contour_area(line) == 0
    for seed in range(60):
        for piece in masks.pieces(spans_of(drawn(seed))):
            own = {(y, x) for y, a, b in piece.tolist() for x in range(a, b + 1)}
            assert masks.contour_area(masks.contour(piece)) == filled_area(own), seed


def test_two_pieces_are_bridged(spark):
    image = np.zeros((30, 60), bool)
    image[2:6, 2:12] = True
    image[20:26, 40:55] = True
    image[8:10, 50:53] = True  # on neither line: no part of the contour
    rows = [("m", y, x) for y, x in pixels_of(image)] + [("dot", 4, 9), (None, 1, 1), ("m", None, 2)]
    got = {r.mask: r for r in masks.mask_rectangles(spark.createDataFrame(rows * 2, "mask string, y int, x int").repartition(3), "mask").collect()}
    want, least = dense_rectangle(image), clouds.min_rectangle(np.array([(x, y) for y, x in pixels_of(image) if not 8 <= y < 10], float))
    assert least[2] * least[3] <= want[2] * want[3] < 1.05 * least[2] * least[3]  # the lines' pixels lie a little beyond the hull
    assert math.isclose(got["m"].w * got["m"].h, want[2] * want[3], rel_tol=1e-9) and (got["dot"].cx, got["dot"].cy, got["dot"].w) == (9, 4, 0) and len(got) == 2


def test_mask_query(spark):
    """Every mask of the query against its dense image."""
    sf = "/root/testdata/sf0.001"
    from vqaspark.plans.store_queries import mask_pixels

    images = {}
    for r in mask_pixels(spark, sf).collect():
        images.setdefault(r.mask, np.zeros((128, 128), bool))[r.y, r.x] = True
    got = {r.mask: r for r in catalog.QUERIES["mask_rect"](spark, sf).collect()}
    assert set(got) == set(images)
    for m in sorted(images)[:40]:
        want = dense_rectangle(images[m])
        assert abs(got[m].area - want[2] * want[3]) < 0.01


@pytest.mark.parametrize("parts", [1, 7])
def test_boxes_of_split_clouds(spark, parts):
    """The same whether a cloud is in one task or in many."""
    rnd = random.Random(11)
    rows = [("round", math.cos(i / 50) * 5, math.sin(i / 50) * 5, rnd.random()) for i in range(400)] + [("few", float(i), 2.0 * i, 1.0) for i in range(5)]
    rows += [("turned", 9 + 4 * u - v, 4 * v + u, 3.0) for u, v in ((rnd.uniform(-2, 2), rnd.uniform(-1, 1)) for _ in range(500))] + [("few", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double").repartition(parts)
    got = {r.g: r for r in clouds.oriented_boxes(df, "g", "x", "y", "z").collect()}
    assert set(got) == {"round", "few", "turned"} and got["round"].angle == 0 and got["few"].w == 4 and got["few"].h == 8
    want = clouds.min_rectangle(np.array([r[1:3] for r in rows if r[0] == "turned"]))
    assert np.allclose([got["turned"][k] for k in ("cx", "cy", "w", "h", "angle")], want)
    assert clouds.oriented_boxes(df.limit(0), "g", "x", "y", "z").count() == 0


def test_hulls_keep_few_points(spark):
    df = spark.range(200_000, numPartitions=3).select(F.lit(1).alias("g"), F.randn(1).alias("x"), F.randn(2).alias("y"))
    kept = clouds.hulls(df, "g", "x", "y", held=1000)
    assert kept.count() < 300
    pts = np.array(df.select("x", "y").collect())
    assert np.allclose(np.sort(clouds.hull(np.array(kept.select("x", "y").collect())), 0), np.sort(clouds.hull(pts), 0))


def test_runs_are_merged(spark):
    """Runs that repeat, overlap, touch or lie apart, against their pixels; the query explodes no pixel."""
    rnd = random.Random(5)
    rows = [(m, rnd.randrange(12), a, a + rnd.randrange(6)) for m in range(6) for a in (rnd.randrange(40) for _ in range(60))] * 2 + [(1, None, 2, 3), (2, 5, 9, 8)]
    df = spark.createDataFrame(rows, "mask int, y int, a int, b int").repartition(3)
    pixels = df.where("a <= b").selectExpr("mask", "y", "explode(sequence(a, b)) AS x")
    key = lambda d: sorted(map(tuple, d.collect()))
    merged = masks.merged_runs(df, "mask", "y", "a", "b")
    assert key(merged) == key(masks.spans(pixels, "mask", "y", "x"))
    assert key(masks.span_rectangles(merged, "mask")) == key(masks.mask_rectangles(pixels, "mask"))
    for seed in range(60):
        found = spans_of(drawn(seed))
        again = np.concatenate([found, found[::2], found[1::3]])
        assert masks.joined(again).tolist() == found.tolist()
        parts = masks.pieces(found)
        assert masks.largest(parts).tolist() == max(parts, key=lambda p: masks.contour_area(masks.contour(p))).tolist()


def test_many_small_clouds_leave_together(spark):
    """Hulls and rectangles of many clouds come in few tables, not one for each cloud, and are those of the clouds alone."""
    rnd = np.random.default_rng(2)
    p = {f"c{g}": rnd.normal(0, 5, (12, 2)) * (1, 3) for g in range(200)}
    df = spark.createDataFrame([(g, float(a), float(b), float(k)) for g, q in p.items() for k, (a, b) in enumerate(q)], "g string, x double, y double, z double").repartition(2)
    boxes = clouds.oriented_boxes(df, "g", "x", "y", "z")
    assert "InPandas" in (plan := boxes._jdf.queryExecution().optimizedPlan().toString()) and "FlatMapGroupsInPandas" not in plan
    got = {r.g: r for r in boxes.collect()}
    assert set(got) == set(p) and all(r.zmax == 11 for r in got.values())
    for g, q in p.items():
        want = clouds.min_rectangle(q)
        if got[g].angle:  # those that are nearly square keep their axes
            assert np.allclose([got[g][k] for k in ("cx", "cy", "w", "h", "angle")], want)
