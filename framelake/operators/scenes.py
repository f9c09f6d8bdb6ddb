"""Scene tables: views, bulk status rules, counts, captions, status events and history."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.pixels import content_change
from framelake.operators import neighbours

VIEWS = {"All": ("included", "excluded", "pending"), "Kept": ("included",), "Rejected": ("excluded",)}


def view(scenes: DataFrame, name: str) -> DataFrame:
    """Scenes whose status is in the named view; an unknown view has none."""
    return scenes.filter(F.col("status").isin(*VIEWS[name]) if name in VIEWS else F.lit(False))


def bulk_filter(scenes: DataFrame, min_area: float = 0.0, min_face: float = 0.0, min_quality: float = 0.0, use_face: bool = True) -> DataFrame:
    """Scenes with status and rejection_reasons by thresholds; scenes set by hand keep their status and have null reasons.

    A value missing in the seed's metrics is taken from its details, then as 0."""
    area = F.coalesce("seed_mask_area", "detail_mask_area", F.lit(0.0))
    face = F.coalesce("seed_face_sim", "detail_face_sim", F.lit(0.0))
    quality = F.coalesce("seed_quality", "seed_score", F.lit(0.0))
    found = F.array_compact(
        F.array(
            F.when(area < min_area, F.concat(F.format_string("Area %.1f", area), F.lit(f"% < {min_area}%"))) if min_area > 0 else F.lit(None).cast("string"),
            F.when(face < min_face, F.concat(F.format_string("Face %.2f", face), F.lit(f" < {min_face}"))) if use_face and min_face > 0 else F.lit(None).cast("string"),
            F.when(quality < min_quality, F.concat(F.format_string("Quality %.1f", quality), F.lit(f" < {min_quality}"))) if min_quality > 0 else F.lit(None).cast("string"),
        )
    )
    manual = F.coalesce("is_overridden", F.lit(False)) | F.coalesce("manual_status_change", F.lit(False))
    return scenes.withColumn("rejection_reasons", F.when(~manual, found)).withColumn(
        "status", F.when(manual, F.col("status")).otherwise(F.when(F.size("rejection_reasons") > 0, F.lit("excluded")).otherwise(F.lit("included")))
    )


def status_counts(scenes: DataFrame) -> DataFrame:
    """One row: total, included, and ready ones, which are included and have a box."""
    included = F.col("status") == "included"
    return scenes.agg(F.count("*").alias("total"), F.count_if(included).alias("included"), F.count_if(included & F.col("has_bbox")).alias("ready"))


def excluded_reasons(scenes: DataFrame) -> DataFrame:
    """reason, n over excluded scenes."""
    return scenes.filter("status = 'excluded'").select(F.explode("rejection_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def caption() -> Column:
    """Number, range, status sign, reasons where excluded, and seed type if the table has that column."""
    out = F.concat(F.format_string("Scene %d [%d-%d] ", "shot_id", "start_frame", "end_frame"), F.when(F.col("status") == "included", "✅").otherwise("❌"))
    return F.concat(out, F.when((F.col("status") == "excluded") & (F.size("rejection_reasons") > 0), F.concat(F.lit("\n("), F.array_join("rejection_reasons", ", "), F.lit(")"))).otherwise(""))


def status_history(events: DataFrame, key: str, order: str, status: str) -> DataFrame:
    """From status events: the last status of each key and its whole history in order."""
    return events.groupBy(key).agg(F.max_by(status, order).alias("status"), F.transform(F.array_sort(F.collect_list(F.struct(order, status))), lambda x: x[status]).alias("history"))


def undo(snapshots: DataFrame, version: str, depth: int = 10) -> DataFrame:
    """The latest `depth` snapshots, newest first."""
    last = snapshots.select(version).distinct().orderBy(F.desc(version)).limit(depth)
    last = last.withColumn("back", F.row_number().over(Window.orderBy(F.desc(version))))  # `depth` rows
    return snapshots.join(F.broadcast(last), version)


def shots_from_scores(frames: DataFrame, score: str, order: str, video: str, threshold: float = 27.0) -> DataFrame:
    """Frames with shot_id (from 0 in each video): a frame whose content score reaches the threshold opens a shot."""
    w = Window.partitionBy(video).orderBy(order)
    cut = ((F.col(score) >= threshold) & (F.row_number().over(w) > 1)).cast("int")
    return frames.withColumn("cut", cut).withColumn("shot_id", F.sum("cut").over(w).cast("int")).drop("cut")


def content_scores(frames: DataFrame, order: str, video: str, image: str = "image") -> DataFrame:
    """video, order, content: how far the colours of each frame are from those of the frame before, from 0 to 255; 0 for the first."""
    return neighbours.scores(frames, [order], content_change, image, video).select(video, order, F.coalesce("score", F.lit(0.0)).alias("content"))


def cuts(contents: DataFrame, order: str, video: str, threshold: float = 27.0, least: int = 15) -> DataFrame:
    """video, start, end (one beyond the last frame) of the shots of each video.

    A frame whose content score reaches the threshold opens a shot, unless the shot before would have fewer than `least`
    frames. Only the frames over the threshold are gathered, a list a video."""
    over = F.array_sort(F.collect_list(F.when(F.col("content") >= threshold, F.col(order).cast("long"))))
    t = contents.groupBy(video).agg(F.min(order).cast("long").alias("first"), (F.max(order) + 1).cast("long").alias("end"), over.alias("over"))

    @F.pandas_udf("array<bigint>")
    def opened(first: pd.Series, over: pd.Series) -> pd.Series:
        out = []
        for start, some in zip(first, over):
            starts = [start]
            for n in some.tolist():
                if n - starts[-1] >= least:
                    starts.append(n)
            out.append(starts)
        return pd.Series(out, dtype="object")

    t = t.withColumn("opened", opened("first", "over"))
    return t.select(video, F.posexplode("opened").alias("shot_id", "start"), "opened", F.col("end").alias("last")).select(video, "shot_id", "start", F.coalesce(F.get("opened", F.col("shot_id") + 1), F.col("last")).alias("end"))


def best_frames(frames: DataFrame, every: int = 1, count: int = 3) -> DataFrame:
    """Of each scene the best frame and up to `count` seeds by score, each a gap of max(1, frames // 8) apart.

    score = (10 - niqe) + 10 * face_sim over every n-th candidate; ties go to the earlier frame."""
    w = Window.partitionBy("shot_id").orderBy("frame_num")
    score = (F.lit(10.0) - F.coalesce(F.col("niqe"), F.lit(10.0))) + 10 * F.coalesce(F.col("face_sim"), F.lit(0.0))
    some = frames.withColumn("at", F.row_number().over(w) - 1).filter(F.col("at") % every == 0).withColumn("score", score)
    ranked = some.groupBy("shot_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "frame_num"))).alias("c"))
    gap = F.greatest(F.lit(1), F.floor(F.col("n") / 8)).cast("long")
    none = F.array().cast("array<bigint>")

    def pick(acc, x):
        near = F.exists(acc, lambda f: F.abs(f - x["frame_num"]) < gap)
        return F.when((F.size(acc) < count) & ~near, F.concat(acc, F.array(x["frame_num"]))).otherwise(acc)

    return ranked.select("shot_id", F.col("c")[0]["frame_num"].alias("best_frame"), (-F.col("c")[0]["s"]).alias("score"), F.aggregate("c", none, pick).alias("seeds"))
