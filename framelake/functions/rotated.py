"""Boxes turned about their centre: centre, width, height and angle in degrees, counter-clockwise."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("cx", "cy", "w", "h", "angle")


def normal_angle(angle: Column) -> Column:
    """The same angle from -180 up to 180, that excluded."""
    return F.pmod(angle + 180.0, F.lit(360.0)) - 180.0


def upright(cx: Column, cy: Column, w: Column, h: Column, angle: Column, width: float, height: float, nearly: float = 1.0) -> tuple[Column, ...]:
    """The box cut at the frame where it stands within `nearly` degrees of upright; others stay."""
    a = normal_angle(angle)
    cut = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), F.lit(most))
    x1, y1, x2, y2 = cut(cx - w / 2, width), cut(cy - h / 2, height), cut(cx + w / 2, width), cut(cy + h / 2, height)
    on = F.abs(a) <= nearly
    keep = lambda new, old: F.when(on, new).otherwise(old)
    return keep((x1 + x2) / 2, cx), keep((y1 + y2) / 2, cy), F.least(w, keep(x2 - x1, w)), F.least(h, keep(y2 - y1, h)), a


def corners(boxes: np.ndarray) -> np.ndarray:
    """Corners (n, 4, 2) of boxes (n, 5), in order around."""
    cx, cy, w, h, angle = boxes.T
    c, s = np.cos(np.radians(angle))[:, None], np.sin(np.radians(angle))[:, None]
    x, y = np.stack([-w, w, w, -w], 1) / 2, np.stack([-h, -h, h, h], 1) / 2
    return np.stack([cx[:, None] + c * x + s * y, cy[:, None] - s * x + c * y], 2)


def _cross(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]


def intersections(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The areas that boxes a and b (n, 5) share, pair by pair.

    The shared part's corners are corners of one box in the other and crossings of their sides: 24 candidates, sorted around their mean."""
    p, q = corners(a), corners(b)
    size = np.sqrt(np.maximum(np.abs(a[:, 2:4]).max(1), np.abs(b[:, 2:4]).max(1)))[:, None]
    eps = 1e-9 * (1 + size**4)

    def inside(points: np.ndarray, quad: np.ndarray) -> np.ndarray:
        side = np.roll(quad, -1, 1) - quad
        turn = np.sign(_cross(side[:, 0], side[:, 1]))[:, None, None]
        return (turn * _cross(side[:, None], points[:, :, None] - quad[:, None]) >= -eps[:, :, None]).all(2)

    u, v = np.roll(p, -1, 1) - p, np.roll(q, -1, 1) - q
    gap = q[:, None] - p[:, :, None]
    den = _cross(u[:, :, None], v[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        s, t = _cross(gap, v[:, None]) / den, _cross(gap, u[:, :, None]) / den
        cross = p[:, :, None] + s[..., None] * u[:, :, None]
    met = (np.abs(den) > eps[:, :, None]) & (s >= 0) & (s <= 1) & (t >= 0) & (t <= 1)
    points = np.concatenate([p, q, cross.reshape(len(p), 16, 2)], 1)
    on = np.concatenate([inside(p, q), inside(q, p), met.reshape(len(p), 16)], 1)
    points = np.where(on[..., None], points, 0.0)
    mean = points.sum(1) / np.maximum(on.sum(1), 1)[:, None]
    angle = np.where(on, np.arctan2(points[..., 1] - mean[:, None, 1], points[..., 0] - mean[:, None, 0]), np.inf)
    order = np.argsort(angle, 1, kind="stable")
    points, on = np.take_along_axis(points, order[..., None], 1), np.take_along_axis(on, order, 1)
    points = np.where(on[..., None], points, points[:, :1]) - mean[:, None]  # what is no corner repeats the first
    area = np.abs(_cross(points, np.roll(points, -1, 1)).sum(1)) / 2
    return np.where((on.sum(1) > 2) & (a[:, 2:4] > 0).all(1) & (b[:, 2:4] > 0).all(1), area, 0.0)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two structs of FIELDS, 0 where both are empty. A batch of pairs is one computation."""

    @F.pandas_udf("double")
    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.Series:
        p, q = (t[list(FIELDS)].to_numpy(np.float64) for t in (x, y))
        shared = intersections(p, q)
        union = p[:, 2] * p[:, 3] + q[:, 2] * q[:, 3] - shared
        return pd.Series(np.divide(shared, union, out=np.zeros(len(p)), where=union > 0))

    return run(a, b)


def scaled(cx: Column, cy: Column, w: Column, h: Column, angle: Column, sx: float, sy: float) -> tuple[Column, ...]:
    """The box after its picture is stretched by sx and sy; sides of a turned box change with its angle, which follows them."""
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    length = lambda x, y: F.sqrt((x * sx) ** 2 + (y * sy) ** 2)
    return cx * sx, cy * sy, w * length(c, s), h * length(s, c), F.degrees(F.atan2(s * sx, c * sy))


def inside(cx: Column, cy: Column, w: Column, h: Column, angle: Column, width: float, height: float, margin: float = 0.0) -> Column:
    """Whether the upright box around a turned one lies in a frame, give or take a margin."""
    c, s = F.abs(F.cos(F.radians(angle))), F.abs(F.sin(F.radians(angle)))
    dx, dy = c * w / 2 + s * h / 2, c * h / 2 + s * w / 2
    return (cx - dx >= -margin) & (cy - dy >= -margin) & (cx + dx < width + margin) & (cy + dy < height + margin)
