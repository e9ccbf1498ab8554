"""Rectangles around the contours of masks.

A mask comes as rows of pixels, (mask, y, x), or of runs of them, (mask, y, first, last).  Either become spans by a window over
that row of the image, so only spans, a few for each row, meet in one place: one image's mask, bounded by the image's height.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .clouds import min_rectangle

#: The eight neighbours of a pixel as (dy, dx), clockwise on an image from the left one.
AROUND = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))


def spans(pixels: DataFrame, mask: str, y: str, x: str) -> DataFrame:
    """(mask, y, first, last): stretches of pixels without a gap; repeated pixels count once."""
    rows = pixels.select(mask, y, x).dropna().distinct()
    gap = F.col(x) - F.row_number().over(Window.partitionBy(mask, y).orderBy(x))
    return rows.withColumn("_gap", gap).groupBy(mask, y, "_gap").agg(F.min(x).alias("first"), F.max(x).alias("last")).select(mask, F.col(y).alias("y"), "first", "last")


def merged_runs(runs: DataFrame, mask: str, y: str, first: str, last: str) -> DataFrame:
    """(mask, y, first, last): the same of runs of pixels, which may repeat, overlap or touch."""
    rows = runs.select(mask, F.col(y).alias("y"), F.col(first).alias("first"), F.col(last).alias("last")).dropna().where("first <= last")
    row = Window.partitionBy(mask, "y").orderBy("first")
    begins = F.col("first") > F.max("last").over(row.rowsBetween(Window.unboundedPreceding, -1)) + 1
    rows = rows.withColumn("_begins", F.when(begins, 1).otherwise(0)).withColumn("_span", F.sum("_begins").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(mask, "y", "_span").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_span")


def line_pixels(a: tuple[int, int], b: tuple[int, int]) -> list[tuple[int, int]]:
    """The pixels (y, x) of a straight line, one for each step along its longer side, halves away from the start."""
    n = max(abs(b[0] - a[0]), abs(b[1] - a[1]))
    step = lambda p, q, i: p + (2 * i * (q - p) + n) // (2 * n)
    return [(step(a[0], b[0], i), step(a[1], b[1], i)) for i in range(n + 1)] if n else [a]


def bridged(found: np.ndarray) -> np.ndarray:
    """The spans (y, first, last) with the lines from the leftmost to the rightmost pixel and from the topmost to the bottommost; of several, the uppermost, then the leftmost."""
    y, first, last = found.T
    at = lambda values: int(np.flatnonzero(values == values.min())[0])
    left, right = at(first * (1 << 32) + y), at(-last * (1 << 32) + y)
    top, bottom = at(y * (1 << 32) + first), at(-y * (1 << 32) + first)
    lines = line_pixels((y[left], first[left]), (y[right], last[right])) + line_pixels((y[top], first[top]), (y[bottom], first[bottom]))
    return np.concatenate([found, np.array([(int(r), int(c), int(c)) for r, c in lines])])


def joined(found: np.ndarray) -> np.ndarray:
    """Spans in order, those of a row that overlap or touch as one."""
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    y, first, last = found.T
    at = (y - y[0]) * (int(last.max() - first.min()) + 2)  # every row on a stretch of its own
    begin = np.flatnonzero(np.append(True, (first + at)[1:] > np.maximum.accumulate(last + at)[:-1] + 1))
    return np.column_stack([y[begin], first[begin], np.maximum.reduceat(last, begin)])


def pieces(found: np.ndarray) -> list[np.ndarray]:
    """Spans by connected piece; pixels touch along sides and corners."""
    found = joined(found)
    owner = list(range(len(found)))

    def top(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    rows = found.tolist()
    above = 0  # the first span of the row above that may touch this one
    for i, (y, first, last) in enumerate(rows):
        while above < i and (rows[above][0] < y - 1 or rows[above][0] == y - 1 and rows[above][2] < first - 1):
            above += 1
        j = above
        while rows[j][0] == y - 1 and rows[j][1] <= last + 1:
            a, b = top(i), top(j)
            owner[max(a, b)] = min(a, b)
            j += 1
    tops = np.array([top(i) for i in range(len(rows))])
    return [found[tops == t] for t in np.unique(tops)]


def contour(piece: np.ndarray) -> list[tuple[int, int]]:
    """The outer boundary pixels (y, x) of a connected piece in order, traced with the background on one side; holes are not entered."""
    top, low = int(piece[:, 0].min()), int(piece[:, 1].min())
    grid = np.zeros((int(piece[:, 0].max()) - top + 3, int(piece[:, 2].max()) - low + 3), bool)
    for y, first, last in piece.tolist():
        grid[y - top + 1, first - low + 1 : last - low + 2] = True
    y = 1
    start = here = (1, int(grid[1].argmax()))
    out, came, seen = [], 0, set()  # came: the direction of the background pixel that the search starts from
    while True:
        out.append((here[0] + top - 1, here[1] + low - 1))
        for k in range(8):
            d = (came + k) % 8
            y, x = here[0] + AROUND[d][0], here[1] + AROUND[d][1]
            if grid[y, x]:
                break
        else:
            return out  # a single pixel
        if here == start and d in seen:
            return out[:-1]
        if here == start:
            seen.add(d)
        here, came = (y, x), (d + 5) % 8 if d % 2 else (d + 6) % 8


def contour_area(points: list[tuple[int, int]]) -> float:
    y, x = np.array(points, float).T
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def largest(parts: list[np.ndarray]) -> np.ndarray:
    """The piece whose contour has the greatest area, the uppermost of equals; one whose box is smaller than an area found is not traced."""
    boxes = [int(np.ptp(p[:, 0])) * int(p[:, 2].max() - p[:, 1].min()) for p in parts]
    best, area = 0, -1.0
    for i in sorted(range(len(parts)), key=lambda i: -boxes[i]) if len(parts) > 1 else ():
        if boxes[i] < area:
            break
        own = contour_area(contour(parts[i]))
        if own > area or own == area and i < best:
            best, area = i, own
    return parts[best]


def mask_rectangle(found: np.ndarray) -> tuple[float, float, float, float, float]:
    """cx, cy, w, h, angle in degrees of the least rectangle around the contour with the greatest area, lines between far pixels added.

    The contour's hull is that of the ends of its piece's spans.
    """
    piece = largest(pieces(bridged(found)))
    row = np.flatnonzero(np.append(True, np.diff(piece[:, 0]) > 0))
    y = piece[row, 0]
    ends = [np.minimum.reduceat(piece[:, 1], row), y], [np.maximum.reduceat(piece[:, 2], row), y]
    return min_rectangle(np.concatenate([np.column_stack(e) for e in ends]).astype(float))


def span_rectangles(found: DataFrame, mask: str) -> DataFrame:
    """(mask, cx, cy, w, h, angle) of each mask, given as spans (mask, y, first, last)."""
    kind = dict(found.dtypes)[mask]
    each = F.array(*(F.col(c).cast("long") for c in ("y", "first", "last")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            boxes = np.array([mask_rectangle(np.asarray(s).reshape(-1, 3)) for s in b["_spans"]], float).reshape(-1, 5)
            yield pd.DataFrame({mask: b[mask]} | {c: boxes[:, k] for k, c in enumerate(("cx", "cy", "w", "h", "angle"))})

    whole = found.groupBy(mask).agg(F.flatten(F.collect_list(each)).alias("_spans"))
    return whole.mapInPandas(run, f"`{mask}` {kind}, cx double, cy double, w double, h double, angle double")


def mask_rectangles(pixels: DataFrame, mask: str, y: str = "y", x: str = "x") -> DataFrame:
    """(mask, cx, cy, w, h, angle) of each mask that has a pixel; rows with a null take no part."""
    return span_rectangles(spans(pixels, mask, y, x), mask)
