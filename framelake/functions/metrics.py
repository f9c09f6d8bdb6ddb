"""Frame metrics that are plain arithmetic over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default weights of the quality score, in percent.
QUALITY_WEIGHTS = {"sharpness": 25, "edge_strength": 15, "contrast": 15, "brightness": 10, "entropy": 15, "niqe": 20}


def quality_score(values: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """0 to 100 from normalised values; missing ones count as 0."""
    total = F.lit(0.0)
    for k, w in (weights or QUALITY_WEIGHTS).items():
        if k in values:
            total = total + F.coalesce(values[k], F.lit(0.0)) * (w / 100.0)
    return total * 100


def eyes(blendshapes: Column) -> tuple[Column, Column, Column]:
    """eyes_open, eyes_open_score and blink_prob from a map of face shapes; null without any."""
    blink = F.greatest(F.coalesce(F.element_at(blendshapes, "eyeBlinkLeft"), F.lit(0.0)), F.coalesce(F.element_at(blendshapes, "eyeBlinkRight"), F.lit(0.0)))
    some = F.size(blendshapes) > 0
    return F.when(some, 1 - blink), F.when(some, (1 - blink) * 100), F.when(some, blink)


def head_pose(m: Column) -> tuple[Column, Column, Column]:
    """yaw, pitch and roll in degrees of a rotation matrix (array of rows); roll is 0 where the pose is singular."""
    r = lambda i, j: m[i][j]
    sy = F.sqrt(r(0, 0) * r(0, 0) + r(1, 0) * r(1, 0))
    flat = sy < 1e-6
    pitch = F.when(flat, F.atan2(-r(1, 2), r(1, 1))).otherwise(F.atan2(r(2, 1), r(2, 2)))
    yaw = F.atan2(-r(2, 0), sy)
    roll = F.when(flat, F.lit(0.0)).otherwise(F.atan2(r(1, 0), r(0, 0)))
    return F.degrees(yaw), F.degrees(pitch), F.degrees(roll)


def niqe_score(raw: Column, offset: float = 10.0, scale: float = 10.0) -> Column:
    return F.least(F.greatest((offset - raw) * scale, F.lit(0.0)), F.lit(100.0))


def contrast(mean: Column, std: Column, most: float = 2.0) -> Column:
    """Share of the greatest contrast, 0 to 1."""
    return F.least(F.greatest(std / (mean + 1e-7), F.lit(0.0)), F.lit(most)) / most


def entropy(counts: Column) -> Column:
    """Shannon entropy in bits of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(counts, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / total * F.log2(x / total)).otherwise(0.0))


def mask_yield(frames_with_mask: Column, frames: Column) -> Column:
    return F.try_divide(frames_with_mask * 100.0, frames)
