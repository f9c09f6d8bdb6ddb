"""Boxes as columns: xyxy boxes are four columns or a struct of x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]
# Widths and heights of a body in faces, the part of a face above it, and the fallback region.
FACE_TO_BODY = (4.0, 7.0, 0.75)
FALLBACK = (0.25, 0.25, 0.5, 0.5)


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def field(column: str) -> Box:
    return tuple(F.col(column)[c] for c in ("x1", "y1", "x2", "y2"))


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def centre(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Box, b: Box, eps: float = 0.0) -> Column:
    """Intersection over union; with no eps null where the union is empty."""
    i = intersection(a, b)
    union = area(a) + area(b) - i
    return i / (union + eps) if eps else F.try_divide(i, union)


def giou(a: Box, b: Box) -> Column:
    i = intersection(a, b)
    union = area(a) + area(b) - i
    hull = (F.greatest(a[2], b[2]) - F.least(a[0], b[0])) * (F.greatest(a[3], b[3]) - F.least(a[1], b[1]))
    return F.try_divide(i, union) - F.try_divide(hull - union, hull)


def ioa(a: Box, b: Box) -> Column:
    """Intersection over the area of b, 0 where that is empty."""
    return F.coalesce(F.try_divide(intersection(a, b), area(b)), F.lit(0.0))


def iom(a: Box, b: Box) -> Column:
    """Intersection over the smaller area."""
    return F.coalesce(F.try_divide(intersection(a, b), F.least(area(a), area(b))), F.lit(0.0))


def similarity(a: Box, b: Box, zero: float = 2.0) -> Column:
    """1 at the same centre, falling to 0 at a distance of `zero`."""
    (ax, ay), (bx, by) = centre(a), centre(b)
    return F.greatest(F.lit(0.0), 1 - F.hypot(ax - bx, ay - by) / zero)


def contains(outer: Box, inner: Box) -> Column:
    return (outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (outer[2] >= inner[2]) & (outer[3] >= inner[3])


def holds(b: Box, x: Column, y: Column, closed: bool = False) -> Column:
    """Whether a point is in the box; the right and lower edges count only if closed."""
    right, low = (x <= b[2], y <= b[3]) if closed else (x < b[2], y < b[3])
    return (x >= b[0]) & (y >= b[1]) & right & low


def clip(b: Box, width: Column | float, height: Column | float) -> Box:
    w, h = (F.lit(v) if not isinstance(v, Column) else v for v in (width, height))
    cut = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most)
    return cut(b[0], w), cut(b[1], h), cut(b[2], w), cut(b[3], h)


def normalised(b: Box, width: float, height: float) -> Box:
    one = lambda v, n: F.least(F.greatest(v / n, F.lit(0.0)), F.lit(1.0))
    return one(b[0], width), one(b[1], height), one(b[2], width), one(b[3], height)


def point_distances(b: Box, x: Column, y: Column) -> Box:
    """How far a point is inside each side: left, top, right, bottom."""
    return x - b[0], y - b[1], b[2] - x, b[3] - y


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Box:
    return x, y, x + w, y + h


def from_cxcywh(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def to_xywh(b: Box) -> Box:
    return b[0], b[1], b[2] - b[0], b[3] - b[1]


def to_cxcywh(b: Box) -> Box:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1]


def whole_xywh(b: Box, width: float | None = None, height: float | None = None, pad: float = 0.05) -> Box:
    """x, y, w, h in whole pixels, w and h at least 1; padded and clamped where the frame's size is given."""
    x1, y1, x2, y2 = b
    if width is not None:
        pw, ph = (x2 - x1) * pad, (y2 - y1) * pad
        x1, y1 = F.greatest(F.lit(0.0), x1 - pw), F.greatest(F.lit(0.0), y1 - ph)
        x2, y2 = F.least(F.lit(width - 1.0), x2 + pw), F.least(F.lit(height - 1.0), y2 + ph)
    whole = lambda v: v.cast("int")
    return whole(x1), whole(y1), F.greatest(F.lit(1), whole(x2 - x1)), F.greatest(F.lit(1), whole(y2 - y1))


def body(face: Box, width: float, height: float) -> Box:
    """x, y, w, h of the body that a face suggests, in the frame, at least a pixel."""
    w, h = face[2] - face[0], face[3] - face[1]
    tw, th = w * FACE_TO_BODY[0], h * FACE_TO_BODY[1]
    inside = lambda v, n: F.greatest(F.lit(0.0), F.least(F.lit(n - 1.0), v))
    x, y = inside(face[0] + w / 2 - tw / 2, width), inside(face[1] - h * FACE_TO_BODY[2], height)
    size = lambda room, want: F.greatest(F.lit(1.0), F.least(room, want))
    return x.cast("int"), y.cast("int"), size(width - x, tw).cast("int"), size(height - y, th).cast("int")


def fallback(width: float, height: float) -> Box:
    return tuple(F.lit(int(n * f)) for n, f in zip((width, height, width, height), FALLBACK, strict=True))


def prominence(face: Box, width: float, height: float) -> Column:
    """0.7 of the face's share of the frame in percent, plus up to 30 for being central."""
    cx, cy = centre(face)
    away = F.hypot(cx - width / 2, cy - height / 2) / F.lit((width**2 + height**2) ** 0.5 / 2)
    return 0.7 * (100 * area(face) / (width * height)) + 30 * (1 - F.least(away, F.lit(1.0)))
