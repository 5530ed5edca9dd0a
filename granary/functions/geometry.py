"""Boxes and points as Column expressions. A box is centre-normalised: cx, cy, w, h in 0..1."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box_columns(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("cx", "cy", "w", "h"))


def corners(box: Box) -> Box:
    cx, cy, w, h = box
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def iou_corners(a: Box, b: Box, epsilon: float = 0.0) -> Column:
    """Intersection over union of corner boxes (any unit). `epsilon` is added to the denominator; without it, an empty
    union gives 0."""
    ax1, ay1, ax2, ay2 = a
    bx1, by1, bx2, by2 = b
    zero = F.lit(0.0)
    iw = F.greatest(zero, F.least(ax2, bx2) - F.greatest(ax1, bx1))
    ih = F.greatest(zero, F.least(ay2, by2) - F.greatest(ay1, by1))
    inter = iw * ih
    union = (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - inter
    if epsilon:
        return inter / (union + F.lit(epsilon))
    return F.when(union > 0, inter / union).otherwise(0.0)


def iou(a: Box, b: Box) -> Column:
    return iou_corners(corners(a), corners(b))


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def yolo_to_xyxy(box: Box, clip: bool = True) -> Box:
    out = corners(box)
    return tuple(clip01(c) for c in out) if clip else out


def xyxy_to_yolo(box: Box) -> Box:
    x1, y1, x2, y2 = box
    return (x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1


def yolo_to_coco(box: Box, width: Column, height: Column) -> Box:
    """COCO's x, y, w, h in pixels, the corner at the top left."""
    cx, cy, w, h = box
    return (cx - w / 2) * width, (cy - h / 2) * height, w * width, h * height


def coco_to_yolo(box: Box, width: Column, height: Column) -> Box:
    x, y, w, h = box
    return (x + w / 2) / width, (y + h / 2) / height, w / width, h / height


def hflip_xyxy(box: Box) -> Box:
    x1, y1, x2, y2 = box
    return clip01(1 - x2), clip01(y1), clip01(1 - x1), clip01(y2)


# Coordinate systems are found out in three ways, which differ on purpose: callers pick the one that their input needs.


def detect_without_size(v: Column) -> Column:
    """Corners (array of 4) of unknown unit, no image size: all in 0..1 stay; all in 0..100 are percent; else null."""
    inside = lambda top: F.forall(v, lambda x: (x >= 0) & (x <= top))
    return F.when(F.size(v) != 4, None).when(inside(1.0), v).when(inside(100.0), F.transform(v, lambda x: x / 100.0))


def detect_with_size(v: Column, width: Column, height: Column) -> Column:
    """Corners of unknown unit, image size known: by their largest value, 0..1, percent, per mille (only if a side of the
    image is over 1000), else pixels; clamped to 0..1."""
    top = F.array_max(F.transform(v, F.abs))
    pixels = F.array(v[0] / width, v[1] / height, v[2] / width, v[3] / height)
    scaled = (
        F.when(top <= 1.0, v)
        .when(top <= 100.0, F.transform(v, lambda x: x / 100.0))
        .when((top <= 1000.0) & (F.greatest(width, height) > 1000), F.transform(v, lambda x: x / 1000.0))
        .otherwise(pixels)
    )
    return F.when(F.size(v) == 4, F.transform(scaled, clip01))


def detect_each(v: Column) -> Column:
    """Each coordinate by itself: over 1 is percent."""
    return F.transform(v, lambda x: F.when(x > 1, x / 100.0).otherwise(x))


def xywh_or_xyxy(v: Column, width: Column, height: Column) -> Column:
    """Four pixel values that are a corner and a size, unless that box would reach out of the image: then two corners.
    Gives the centre-normalised box."""
    a, b, c, d = (v[k] for k in range(4))
    two_corners = (a + c > width) | (b + d > height)
    w, h = F.when(two_corners, c - a).otherwise(c), F.when(two_corners, d - b).otherwise(d)
    return F.array((a + w / 2) / width, (b + h / 2) / height, w / width, h / height)


def polygon_box(points: Column, width: Column, height: Column) -> Column:
    """Array of points (arrays x, y in pixels) to the centre-normalised box around it, clamped; null if it has no area."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    x1, x2 = (clip01(f(xs) / width) for f in (F.array_min, F.array_max))
    y1, y2 = (clip01(f(ys) / height) for f in (F.array_min, F.array_max))
    return F.when((x2 > x1) & (y2 > y1), F.array(*xyxy_to_yolo((x1, y1, x2, y2))))


def plausible(box: Box, profile: str = "open") -> Column:
    """Whether a box is plausible. open: 0 < all < 1; sides: 0 < w, h < 1; inside: w, h > 0 and the centre in 0..1;
    narrow: 0.01 < w, h < 0.98; large: w, h > 0.01."""
    cx, cy, w, h = box
    both = lambda f: f(w) & f(h)
    return {
        "open": reduce(lambda a, b: a & b, [(x > 0) & (x < 1) for x in box]),
        "sides": both(lambda x: (x > 0) & (x < 1)),
        "inside": both(lambda x: x > 0) & cx.between(0, 1) & cy.between(0, 1),
        "narrow": both(lambda x: (x > 0.01) & (x < 0.98)),
        "large": both(lambda x: x > 0.01),
    }[profile]


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def angle(cos: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))


def inside_polygon(x: Column, y: Column, corners: list[tuple[float, float]] | None) -> Column:
    """Even-odd rule over fixed corners; points on an edge are inside; fewer than 3 corners bound nothing (true)."""
    if not corners or len(corners) < 3:
        return F.lit(True)
    crossings, on_edge = [], []
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        cross = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
        on_edge.append((cross == 0) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
        if y1 != y2:
            at = F.lit(float(x1)) + (y - y1) * ((x2 - x1) / (y2 - y1))
            crossings.append((((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < at)).cast("int"))
    odd = reduce(lambda a, b: a + b, crossings) % 2 == 1 if crossings else F.lit(False)
    return odd | reduce(lambda a, b: a | b, on_edge)


def linear_map(x: Column, span: float, top: int = 4095) -> Column:
    """0..span to 0..top, cut off to a whole number and clamped."""
    return F.greatest(F.lit(0), F.least(F.lit(top), (x / F.lit(float(span)) * top).cast("int")))


def zigzag(cx: Column, cy: Column, size: int = 80, density: float = 0.7) -> Column:
    """Array of points (x, y) in rows that change direction, all within `size` of the centre."""
    rows = max(3, int(10 * density))
    step, half = 2 * size // (rows - 1), size
    points = []
    for r in range(rows):
        y = min(half, r * step - half)
        ends = (-half, half) if r % 2 == 0 else (half, -half)
        points += [F.struct((cx + e).alias("x"), (cy + y).alias("y")) for e in ends]
    return F.array(*points)


def circle(cx: Column, cy: Column, size: int = 80, density: float = 0.7) -> Column:
    n = max(8, int(24 * density))
    turn = lambda k, f: (f(F.lit(2 * math.pi) * k / n) * size).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct((cx + turn(k, F.cos)).alias("x"), (cy + turn(k, F.sin)).alias("y")))


def cross(cx: Column, cy: Column, size: int = 80, density: float = 0.7) -> Column:
    n = max(2, int(10 * density))
    at = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: (k * (2 * size) / n).cast("int") - size)
    across = F.transform(at, lambda d: F.struct((cx + d).alias("x"), (cy + F.lit(0)).alias("y")))
    down = F.transform(at, lambda d: F.struct((cx + F.lit(0)).alias("x"), (cy + d).alias("y")))
    return F.concat(across, down)


def pattern(kind: Column, cx: Column, cy: Column, size: int = 80, density: float = 0.7) -> Column:
    """The points of a named pattern; unknown names give the centre alone."""
    alone = F.array(F.struct((cx + F.lit(0)).alias("x"), (cy + F.lit(0)).alias("y")))
    return F.when(kind == "zigzag", zigzag(cx, cy, size, density)).when(kind == "circle", circle(cx, cy, size, density)).when(kind == "cross", cross(cx, cy, size, density)).otherwise(alone)


def fill_frame(points: Column, total: int = 1000) -> Column:
    """Each point max(1, total // n) times, then the last again up to `total`; cut to `total`; empty stays empty."""
    times = lambda p: F.greatest(F.lit(1), F.floor(F.lit(total) / F.size(p))).cast("int")
    spread = lambda p: F.slice(F.flatten(F.transform(p, lambda x: F.array_repeat(x, times(p)))), 1, total)
    rest = lambda p, n: F.array_repeat(F.element_at(p, -1), F.lit(total) - n)
    filled = lambda p: F.when(F.size(p) > 0, F.concat(spread(p), rest(p, F.least(F.lit(total), F.size(p) * times(p))))).otherwise(p)
    # Within a lambda `points` is worked out once, however costly and however often it is named.
    return F.get(F.transform(F.array(points), filled), F.lit(0))
