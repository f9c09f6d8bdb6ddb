"""The frame filter: definitions compiled to columns, with reasons for every rejection.

A definition names a metric, its thresholds and its reason labels. compile_filters() turns the active ones into
one boolean and one array of reasons, so a filter query is a single projection: no shuffle, no Python, and a
disabled filter leaves no trace in the plan.

Metrics compare as 32-bit floats on both sides. A missing metric counts as the definition's least value, gives no
reason, and so can reject a frame silently.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOAT_MAX = 3.4028234663852886e38


@dataclass(frozen=True)
class Filter:
    key: str
    path: str
    kind: str = "range"
    low: float = 0.0
    high: float = 100.0
    gate: str | None = None
    reason_low: str | None = None
    reason_high: str | None = None
    reason_missing: str | None = None
    histogram: tuple[float, float] = (0.0, 100.0)


# Keys, paths, default thresholds, reason labels and histogram ranges, in the order of reasons.
FILTERS: tuple[Filter, ...] = (
    Filter("face_sim", "face_sim", "min", 0.0, gate="face_sim_enabled", reason_low="face_sim_low", reason_missing="face_missing", histogram=(0.0, 1.0)),
    Filter("entropy", "metrics.entropy_score", reason_low="entropy_low", reason_high="entropy_high"),
    Filter("eyes_open", "metrics.eyes_open", "min", 0.0, reason_low="eyes_closed", histogram=(0.0, 1.0)),
    Filter("yaw", "metrics.yaw", low=-25.0, high=25.0, reason_low="yaw_out_of_range", reason_high="yaw_out_of_range", histogram=(-180.0, 180.0)),
    Filter("pitch", "metrics.pitch", low=-25.0, high=25.0, reason_low="pitch_out_of_range", reason_high="pitch_out_of_range", histogram=(-180.0, 180.0)),
    Filter("mask_area_pct", "mask_area_pct", "min", 1.0, gate="mask_area_enabled", reason_low="mask_too_small"),
    Filter("niqe", "metrics.niqe_score", reason_low="niqe_low", reason_high="niqe_high"),
    Filter("quality_score", "metrics.quality_score", reason_low="quality_score_low", reason_high="quality_score_high"),
    Filter("sharpness", "metrics.sharpness_score", reason_low="sharpness_low", reason_high="sharpness_high"),
    Filter("edge_strength", "metrics.edge_strength_score", reason_low="edge_strength_low", reason_high="edge_strength_high"),
    Filter("contrast", "metrics.contrast_score", reason_low="contrast_low", reason_high="contrast_high"),
    Filter("brightness", "metrics.brightness_score", reason_low="brightness_low", reason_high="brightness_high"),
)
BY_KEY = {f.key: f for f in FILTERS}

# Named threshold bundles. An active preset reads thresholds other than angles as percentiles.
PRESETS: dict[str, dict[str, float]] = {
    "Portrait/Selfie": {"sharpness_min": 60.0, "face_sim_min": 50.0, "eyes_open_min": 60.0, "yaw_min": -15.0, "yaw_max": 15.0, "pitch_min": -15.0, "pitch_max": 15.0},
    "Action/Sports": {"sharpness_min": 10.0, "edge_strength_min": 60.0, "mask_area_pct_min": 20.0},
    "Training Dataset": {"quality_score_min": 80.0, "face_sim_min": 80.0},
    "High Quality": {"quality_score_min": 75.0, "sharpness_min": 75.0},
    "Frontal Faces": {"yaw_min": -10.0, "yaw_max": 10.0, "pitch_min": -10.0, "pitch_max": 10.0, "eyes_open_min": 70.0},
    "Close-up Subject": {"mask_area_pct_min": 60.0, "quality_score_min": 40.0},
}


def metric(f: Filter) -> Column:
    """The metric as a 32-bit float, null where missing: NaN is missing too."""
    x = F.col(f.path).cast("float")
    return F.when(x.isNotNull() & ~F.isnan(x), F.least(F.greatest(x, F.lit(-FLOAT_MAX).cast("float")), F.lit(FLOAT_MAX).cast("float")))


def fetch(frames: DataFrame, key: str) -> Column:
    """A metric by its key: where its definition says, else a column of that name, else metrics.<key>_score; null without any."""
    if key in BY_KEY:
        return metric(BY_KEY[key])
    inner = set(frames.schema["metrics"].dataType.names) if "metrics" in frames.columns else set()
    found = [F.col(f"`{key}`")] if key in frames.columns else []
    found += [F.col("metrics")[n] for n in (f"{key}_score",) if n in inner]
    return F.coalesce(*found).cast("float") if found else F.lit(None).cast("float")


def _number(x: float) -> Column:
    return F.lit(float(x)).cast("float")


def compile_filters(args: Mapping[str, object], columns: set[str] | None = None) -> tuple[Column, Column]:
    """(passes, reasons) for thresholds such as {"quality_score_min": 40, "face_sim_enabled": True}.

    columns: metric keys that the table has; a filter on any other is left out."""
    passes, reasons = F.lit(True), []
    for f in FILTERS:
        if (f.gate and not args.get(f.gate)) or (columns is not None and f.key not in columns):
            continue
        x = metric(f)
        low = _number(args.get(f"{f.key}_min", f.low))
        filled = F.coalesce(x, _number(f.low))
        if f.key == "face_sim":
            required = bool(args.get("require_face_match"))
            passes = passes & F.when(x.isNull(), F.lit(not required)).otherwise(x >= low)
            reasons.append(F.when(x < low, F.lit(f.reason_low)))
            if required:
                reasons.append(F.when(x.isNull(), F.lit(f.reason_missing)))
            continue
        passes = passes & (filled >= low)
        reasons.append(F.when(x < low, F.lit(f.reason_low)))
        if f.kind == "range":
            high = _number(args.get(f"{f.key}_max", f.high))
            passes = passes & (filled <= high)
            reasons.append(F.when(x > high, F.lit(f.reason_high)))
    return passes, F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")


def apply_filters(frames: DataFrame, args: Mapping[str, object], duplicate: Column | None = None) -> DataFrame:
    """frames with kept and reasons; a duplicate's reason comes first."""
    passes, reasons = compile_filters(args)
    if duplicate is not None:
        passes, reasons = passes & ~duplicate, F.concat(F.when(duplicate, F.array(F.lit("duplicate"))).otherwise(F.array().cast("array<string>")), reasons)
    return frames.withColumn("kept", passes).withColumn("reasons", reasons)


def reason_counts(filtered: DataFrame) -> DataFrame:
    """reason, n: the most frequent first."""
    return filtered.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def enable_flags(frames: DataFrame) -> DataFrame:
    """One row: which gates the data can feed."""
    return frames.agg(
        F.coalesce(F.max(F.col("face_sim").isNotNull()), F.lit(False)).alias("face_sim_enabled"),
        F.coalesce(F.max(F.col("mask_area_pct").isNotNull()), F.lit(False)).alias("mask_area_enabled"),
        F.coalesce(F.max(F.col("phash").isNotNull()), F.lit(False)).alias("dedup_enabled"),
    )


def percentiles(frames: DataFrame, wanted: Mapping[str, float]) -> dict[str, float | None]:
    """Of each metric key its percentile (0 to 100, linear), in one pass over the table."""
    if not wanted:
        return {}
    row = frames.agg(*[F.percentile(metric(BY_KEY[k]).cast("double"), F.lit(float(p) / 100)).alias(k) for k, p in wanted.items()]).first()
    return row.asDict()


def reset(sliders: list[str], defaults: Mapping[str, Mapping[str, float]]) -> dict[str, object]:
    """Every slider (<metric>_min or <metric>_max) at its default, 0 without one, and the other settings as at first."""
    side = lambda s: "default_max" if s.endswith("_max") else "default_min"
    name = lambda s: s.removesuffix("_max") if s.endswith("_max") else s.removesuffix("_min")
    return {s: defaults.get(name(s), {}).get(side(s), 0) for s in sorted(sliders)} | {"dedup_thresh": 5, "require_face_match": False, "dedup_method": "Fast (pHash)", "smart_filter_enabled": False}


def with_defaults(args: Mapping[str, object], config: Mapping[str, object]) -> dict[str, object]:
    """Parameters that are absent or null from a config's default_<name>, or filter_default_<name>; labels without emoji."""
    out = dict(args)
    for key, value in config.items():
        for prefix in ("filter_default_", "default_"):
            if key.startswith(prefix):
                name = key.removeprefix(prefix)
                if out.get(name) is None:
                    out[name] = value
                break
    return {k: re.sub(r"^[^\w\s]+\s*", "", v).strip() if isinstance(v, str) else v for k, v in out.items()}


def smart_thresholds(frames: DataFrame, args: Mapping[str, object]) -> dict[str, object]:
    """Thresholds read as percentiles of their metric; angles and metrics without values stay."""
    out = dict(args)
    for side in ("min", "max"):
        wanted = {k: args[f"{k}_{side}"] for k in BY_KEY if f"{k}_{side}" in args and k not in ("yaw", "pitch")}
        out |= {f"{k}_{side}": v for k, v in percentiles(frames, wanted).items() if v is not None}
    return out


def preset(frames: DataFrame, name: str) -> DataFrame:
    """The filter under a named preset, thresholds taken as percentiles."""
    return apply_filters(frames, smart_thresholds(frames, PRESETS[name]) | {"face_sim_enabled": True, "mask_area_enabled": True})


def auto_thresholds(frames: DataFrame, percentile: float, keys: tuple[str, ...] = tuple(BY_KEY)) -> DataFrame:
    """metric, threshold: each metric's percentile rounded to 2 places, null without values."""
    cols = [F.percentile(metric(BY_KEY[k]).cast("double"), F.lit(percentile / 100)).alias(k) for k in keys]
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), F.round(F.col(k), 2).alias("threshold")) for k in keys])
    return frames.agg(*cols).select(F.explode(pairs).alias("p")).select("p.*")


def histograms(frames: DataFrame, bins: int = 50, keys: tuple[str, ...] = tuple(BY_KEY)) -> DataFrame:
    """metric, bin (from 0), n: equal bins over each metric's range, the last closed, empty ones with 0."""
    long = frames.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), metric(BY_KEY[k]).cast("double").alias("x"), F.lit(BY_KEY[k].histogram[0]).alias("lo"), F.lit(BY_KEY[k].histogram[1]).alias("hi")) for k in keys])).alias("m")).select("m.*")
    at = F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int")
    counts = long.filter("x >= lo and x <= hi").groupBy("metric", at.alias("bin")).agg(F.count("*").alias("n"))
    spark = frames.sparkSession
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"), F.explode(F.array(*[F.lit(k) for k in keys])).alias("metric"))
    return every.join(F.broadcast(counts), ["metric", "bin"], "left").select("metric", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def page(frames: DataFrame, order: str, number: int, size: int) -> DataFrame:
    """One page of an ordered gallery with its position; the page number is clamped to those there are."""
    total = frames.count()
    pages = max(1, -(-total // size))
    number = min(max(number, 1), pages)
    return frames.orderBy(order).offset((number - 1) * size).limit(size).withColumn("page", F.lit(number)).withColumn("pages", F.lit(pages))
