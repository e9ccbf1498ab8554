"""Boxes, axes, projections: arithmetic over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def square_offsets(w: Column, h: Column) -> tuple[Column, Column]:
    """What to add to x and y when an image is padded to a square (towards zero)."""
    return F.when(h > w, ((h - w) / 2).cast("int")).otherwise(0), F.when(w > h, ((w - h) / 2).cast("int")).otherwise(0)


def scale_rotated(box: list[Column], width: float, height: float) -> list[Column]:
    """cx, cy, w, h in pixels to shares of the padded square, the angle as it is."""
    cx, cy, w, h, angle = box
    side = max(width, height)
    px, py = (side - width) / 2, (side - height) / 2
    return [(cx + px) / side, (cy + py) / side, w / side, h / side, angle]


def unscale_rotated(box: list[Column], width: float, height: float) -> list[Column]:
    cx, cy, w, h, angle = box
    side = max(width, height)
    px, py = (side - width) / 2, (side - height) / 2
    return [cx * side - px, cy * side - py, w * side, h * side, angle]


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def clamp_box(box: list[Column], width: Column, height: Column, places: int = 3) -> list[Column]:
    """xyxy in pixels to shares within 0..1, rounded half to even."""
    return [F.bround(clamp(v / s), places) for v, s in zip(box, (width, height, width, height), strict=True)]


def quantise(v: Column, low: float, high: float, bins: int = 100) -> Column:
    return F.rint((v - low) / (high - low) * bins).cast("int")


def dequantise(q: Column, low: float, high: float, bins: int = 100) -> Column:
    return q / bins * (high - low) + low


def wrapped_angle(degrees: Column, period: int = 180, step: int = 5) -> Column:
    """Degrees wrapped into [0, period) and rounded to the step, the period itself being 0; in whole degrees."""
    rounded = (F.bround(F.pmod(degrees, F.lit(period)) / step, 0) * step).cast("int")
    return F.when(rounded == period, 0).otherwise(rounded)


def axis_angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees of an axis in pixels, negatives turned by half."""
    a = F.degrees(F.atan2(y2 - y1, x2 - x1))
    return F.when(a < 0, a + 180).otherwise(a)


def axis_box(x1: Column, y1: Column, x2: Column, y2: Column, thick: float = 10.0) -> list[Column]:
    """Midpoint, length and thickness of an axis."""
    length = F.hypot(x2 - x1, y2 - y1)
    return [(x1 + x2) / 2, (y1 + y2) / 2, length, F.least(length, F.lit(thick))]


def project(x: Column, y: Column, z: Column, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column]:
    """Pinhole projection with flipped x, towards zero."""
    return (fx * (-F.try_divide(x, z)) + cx).cast("int"), (fy * F.try_divide(y, z) + cy).cast("int")


def project_share(p: list[Column], fx: float, fy: float, cx: float, cy: float, width: float, height: float, near: Column, far: Column) -> list[Column]:
    """Pinhole projection of a camera point with flipped x as shares of the image, and its depth as a share of the depth range, all within 0..1."""
    u, v = (-F.try_divide(p[0], p[2]) * fx + cx) / width, (F.try_divide(p[1], p[2]) * fy + cy) / height
    return [clamp(u), clamp(v), clamp((F.abs(p[2]) - near) / (far - near + 1e-6))]


def axis_depths(first: Column, second: Column, near: Column, far: Column, flipped: Column) -> list[Column]:
    """Depths of an axis' ends as shares of the depth range, null where the range is empty; swapped where the axis was turned round."""
    a, b = (F.try_divide(F.abs(z) - near, far - near) for z in (first, second))
    return [F.when(flipped, b).otherwise(a), F.when(flipped, a).otherwise(b)]


def place_in_box(p: list[Column], r: list[list[float]], t: list[float], extent: list[Column]) -> list[Column]:
    """x and y of a point in the frame of a box (rotation r, centre t), as shares of its extent from its low corner, within 0..1."""
    return [clamp(q / e + 0.5) for q, e in zip(inverse_rigid(p, r, t)[:2], extent[:2], strict=True)]


def transform_point(p: list[Column], r: list[list[float]], t: list[float]) -> list[Column]:
    return [sum((p[k] * r[i][k] for k in range(1, 3)), p[0] * r[i][0]) + t[i] for i in range(3)]


def inverse_rigid(p: list[Column], r: list[list[float]], t: list[float]) -> list[Column]:
    d = [p[i] - t[i] for i in range(3)]
    return [sum((d[k] * r[k][i] for k in range(1, 3)), d[0] * r[0][i]) for i in range(3)]


def corners(c: list[Column], e: list[Column]) -> Column:
    """Eight corners of an axis-aligned box by centre and extent, x slowest."""
    sign = ((-1, -1, -1), (-1, -1, 1), (-1, 1, -1), (-1, 1, 1), (1, -1, -1), (1, -1, 1), (1, 1, -1), (1, 1, 1))
    return F.array(*[F.array(*[c[k] + s[k] * e[k] / 2 for k in range(3)]) for s in sign])


def z_up(p: list[Column]) -> list[Column]:
    return [-p[2], -p[0], p[1]]


def slab(origin: list[Column], direction: list[Column], low: list[Column], high: list[Column]) -> tuple[Column, Column, Column]:
    """Entry and exit parameters of a ray in a box, and the number of its crossings in front (0, 1 or 2)."""
    inf = F.lit(float("inf"))
    near, far = [], []
    for o, d, a, b in zip(origin, direction, low, high, strict=True):
        inside = (o >= a) & (o <= b)
        t1, t2 = F.try_divide(a - o, d), F.try_divide(b - o, d)
        near.append(F.when(d == 0, F.when(inside, -inf).otherwise(inf)).otherwise(F.least(t1, t2)))
        far.append(F.when(d == 0, F.when(inside, inf).otherwise(-inf)).otherwise(F.greatest(t1, t2)))
    enter, leave = F.greatest(*near), F.least(*far)
    return enter, leave, F.when((enter > leave) | (leave < 0), 0).when(enter < 0, 1).otherwise(2)


def iou(a: list[Column], b: list[Column]) -> Column:
    """Of two xyxy boxes; 0 where neither has an area."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


def learning_rate(step: Column, warmup: float, total: float, top: float, least: float) -> Column:
    """Linear warm-up, then half a cosine down to the least rate."""
    import math

    cosine = least + (top - least) * 0.5 * (1 + F.cos(F.lit(math.pi) * (step - warmup) / (total - warmup)))
    return F.when(step < warmup, top * step / warmup).when(step > total, F.lit(least)).otherwise(cosine)


def spherical(radius: Column, polar: Column, azimuth: Column) -> list[Column]:
    return [radius * F.sin(polar) * F.cos(azimuth), radius * F.sin(polar) * F.sin(azimuth), radius * F.cos(polar)]


def depth_share(d: Column, low: Column, high: Column) -> Column:
    """Inverted depth in 0.1..1 for display; a depth of zero stays."""
    return F.when(d == 0, F.lit(0.0)).otherwise(0.9 * (1 - (d - low) / (high - low + 1e-6)) + 0.1)


def denormalise(v: Column, low: Column, high: Column) -> Column:
    return v * (high - low) + low


def normalise(v: Column, low: Column, high: Column) -> Column:
    return (v - low) / (high - low + 1e-6)


def back_project(u: Column, v: Column, d: Column, fx: float, fy: float, cx: float, cy: float) -> list[Column]:
    """A pixel with depth as a point of the camera's frame."""
    return [(u - cx) * d / fx, (v - cy) * d / fy, d]


def rotation_matrix(v: list[Column]) -> list[list[Column]]:
    """Rotation vector to matrix by Rodrigues' formula; the zero vector gives the identity."""
    angle = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    k = [F.coalesce(F.try_divide(x, angle), F.lit(0.0)) for x in v]
    c, s = F.cos(angle), F.sin(angle)
    cross = [[None, (-1, 2), (1, 1)], [(1, 2), None, (-1, 0)], [(-1, 1), (1, 0), None]]
    return [[k[i] * k[j] * (1 - c) + (c if i == j else cross[i][j][0] * k[cross[i][j][1]] * s) for j in range(3)] for i in range(3)]


def rotation_vector(r: list[list[Column]]) -> list[Column]:
    """Matrix to rotation vector for angles below a half turn."""
    angle = F.acos(clamp((r[0][0] + r[1][1] + r[2][2] - 1) / 2, -1.0, 1.0))
    scale = F.coalesce(F.try_divide(angle, 2 * F.sin(angle)), F.lit(0.5))
    return [(r[2][1] - r[1][2]) * scale, (r[0][2] - r[2][0]) * scale, (r[1][0] - r[0][1]) * scale]


def xyxy(box: list[Column], width: float, height: float) -> list[Column]:
    """x, y, w, h in pixels to the corners' shares of the image."""
    x, y, w, h = box
    return [x / width, y / height, (x + w) / width, (y + h) / height]


def cut_line(x1: Column, y1: Column, x2: Column, y2: Column, low: list[Column], high: list[Column]) -> tuple[Column, Column]:
    """Parameters at which the segment from 1 to 2 enters and leaves a 2-D box, within 0..1; null where it misses."""
    t0, t1, _ = slab([x1, y1], [x2 - x1, y2 - y1], low, high)
    enter, leave = F.greatest(t0, F.lit(0.0)), F.least(t1, F.lit(1.0))
    return F.when(enter <= leave, enter), F.when(enter <= leave, leave)


def joint_frame(direction: list[Column]) -> list[list[Column]]:
    """The x, y and z axes of a right-handed frame whose z is the direction: y stands on z and the first axis, or the second where z lies near the first."""
    least = 1e-6
    norm = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]) + least
    unit = lambda v: [c / norm(v) for c in v]
    z = unit(direction)
    near = F.abs(z[0]) >= 0.9
    y = unit([F.when(near, -z[2]).otherwise(0.0), F.when(near, 0.0).otherwise(z[2]), F.when(near, z[0]).otherwise(-z[1])])
    x = unit([y[1] * z[2] - y[2] * z[1], y[2] * z[0] - y[0] * z[2], y[0] * z[1] - y[1] * z[0]])
    return [x, y, z]


def joint_ends(kind: Column, centre: list[Column], low: Column, high: Column) -> tuple[list[Column], list[Column]]:
    """Both ends of a joint in its frame: a slider runs through its box's centre, any other joint through the origin."""
    x, y = (F.when(kind == "slider", c).otherwise(0.0) for c in centre)
    return [x, y, low], [x, y, high]
