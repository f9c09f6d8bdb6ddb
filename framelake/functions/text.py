"""Strings, hashes and formats as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TRUE_WORDS = ("1", "true", "yes", "on")
STARS = (20.0, 40.0, 60.0, 80.0, 90.0)
LABELS = {"kept": "Green", "review": "Yellow", "rejected": "Red"}


def sanitised(name: Column, most: int = 50) -> Column:
    """A safe file name: all but word characters, - and . become _."""
    return F.substring(F.regexp_replace(name, r"[^\w\-.]", "_"), 1, most)


def truthy(x: Column) -> Column:
    return F.lower(F.trim(x)).isin(*TRUE_WORDS)


def without_emoji(x: Column) -> Column:
    """Text without leading characters that are neither word characters nor blanks."""
    return F.trim(F.regexp_replace(x, r"^[^\w\s]+\s*", ""))


def eta(seconds: Column, fine: bool = False) -> Column:
    """Seconds as "5s", "2m 5s" or "1h 2m"; fine adds seconds to hours; null is a dash."""
    s = seconds.cast("long")
    m, h = F.floor(s / 60), F.floor(s / 3600)
    long = F.format_string("%dh %dm %ds", h, m % 60, s % 60) if fine else F.format_string("%dh %dm", h, m % 60)
    return F.when(seconds.isNull(), "—").when(s < 60, F.format_string("%ds", s)).when(m < 60, F.format_string("%dm %ds", m, s % 60)).otherwise(long)


def frame_number(name: Column) -> Column:
    return F.try_to_number(F.regexp_extract(name, r"frame_(\d+)", 1), F.lit("999999999999")).cast("long")


def frame_of_time(line: Column, fps: float) -> Column:
    """The frame number of a log line's pts_time, halves to even."""
    t = F.regexp_extract(line, r"pts_time:\s*([0-9.]+)", 1)
    return F.bround(F.when(t != "", t).cast("double") * fps).cast("long")


def settings_hash(*columns: str) -> Column:
    """md5 of a JSON object with its keys in order."""
    return F.md5(F.to_json(F.struct(*sorted(columns))))


def star_rating(score: Column) -> Column:
    """0 to 5: how many rating thresholds a score reaches."""
    return F.size(F.filter(F.array(*[F.lit(s) for s in STARS]), lambda s: score >= s))


def colour_label(status: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in LABELS.items():
        out = F.when(status == k, v).otherwise(out)
    return out


def preview_scale(width: Column, height: Column, pixels: float) -> tuple[Column, Column]:
    """Even width and height of about so many pixels, never larger than they are, 2 at least."""
    k = F.least(F.lit(1.0), F.sqrt(F.lit(pixels) / (width * height)))
    even = lambda v: F.greatest(F.lit(2), (F.floor(v * k / 2) * 2).cast("int"))
    return even(width), even(height)
