"""Joins of frames with scenes, masks, maps and sessions, each on the keys the tables share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.numbering import numbered

#: Frames that one bucket of the range join spans.
SPAN = 256


def stem(name: str | Column) -> Column:
    """A file name without its directory and last suffix."""
    base = F.regexp_extract(F.col(name) if isinstance(name, str) else name, r"([^/]*)$", 1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def frames_in_scenes(frames: DataFrame, scenes: DataFrame, span: int = SPAN) -> DataFrame:
    """Each frame with each scene that holds it: start <= frame < end, or frame = start where the scene is empty.

    A range join over buckets: a scene stands in every bucket it touches, so both sides meet on an equal key
    and neither has to be broadcast."""
    last = F.greatest(F.col("end_frame") - 1, F.col("start_frame"))
    s = scenes.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_frame") / span), F.floor(last / span)))).withColumnRenamed("shot_id", "scene_id")
    f = frames.withColumn("bucket", F.floor(F.col("frame_num") / span))
    holds = (F.col("frame_num") >= F.col("start_frame")) & (F.col("frame_num") <= F.greatest(F.col("end_frame") - 1, F.col("start_frame")))
    return f.join(s, "bucket").filter(holds).drop("bucket")


def with_masks(frames: DataFrame, masks: DataFrame) -> DataFrame:
    """Frames with what is known of their masks, by file stem; frames without stay."""
    return frames.withColumn("stem", stem("filename")).join(masks.withColumn("stem", stem("mask_file")), "stem", "left")


def session(scenes: DataFrame, seeds: DataFrame) -> DataFrame:
    """Scenes with their seeds: the best frame falls back to the seed's, the status to included."""
    joined = scenes.join(seeds, "shot_id", "left")
    return joined.withColumn("best_frame", F.coalesce("best_frame", "best_seed_frame")).withColumn("status", F.coalesce("seed_status", F.lit("included")))


def resume(scenes: DataFrame, done: DataFrame) -> DataFrame:
    """Scenes whose ids are not among those done."""
    return scenes.join(done.select("shot_id").distinct(), "shot_id", "left_anti")


def checkpoint_ids(before: DataFrame, now: DataFrame) -> DataFrame:
    """The union of done ids, in order."""
    return before.select("shot_id").union(now.select("shot_id")).distinct().orderBy("shot_id")


def frame_map(frames: DataFrame, suffix: str = ".png", video: str | None = None) -> DataFrame:
    """frame_num, position (from 1) and file name of the sorted distinct frame numbers, of each video or of all frames."""
    if video:
        t = frames.select(video, "frame_num").distinct().withColumn("position", F.row_number().over(Window.partitionBy(video).orderBy("frame_num")))
    else:
        t = numbered(frames.select("frame_num").distinct(), ["frame_num"], "position")
    return t.withColumn("filename", F.format_string(f"frame_%06d{suffix}", "position"))


def export_files(kept: DataFrame, source_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept frames with their sources, and those for which none is known."""
    return kept.join(source_map, "filename"), kept.join(source_map, "filename", "left_anti")


def collision_free(names: DataFrame, column: str, order: str) -> DataFrame:
    """names with `unique_name`: a repeat of a name gets _1, _2 ... before its suffix."""
    k = F.row_number().over(Window.partitionBy(column).orderBy(order)) - 1
    base, suffix = stem(column), F.regexp_extract(column, r"((?<=.)\.[^.]*)$", 1)
    return names.withColumn("k", k).withColumn("unique_name", F.when(F.col("k") == 0, F.col(column)).otherwise(F.concat(base, F.lit("_"), F.col("k"), suffix))).drop("k")


def select_expression(frames: DataFrame) -> DataFrame:
    """One row: the frame-selecting expression over frame numbers in order."""
    return frames.agg(F.array_join(F.transform(F.array_sort(F.collect_set("frame_num")), lambda n: F.format_string("eq(n\\,%d)", n)), "+").alias("expression"))


def nearest_conditioning(frames: DataFrame, most: int = 4, key: str = "video_id", time: str = "frame", marked: str = "conditioning", keep_first: bool = False) -> DataFrame:
    """For each frame that conditions nothing the conditioning frames to use, a row each, ranked from 1.

    First the closest one before, then the closest at or after, then the others by distance in time, the earlier
    first, up to `most`. keep_first: before all of these the first of those before it, or, where there is none, the last of those after it."""
    # Each frame's number of conditioning frames before it; those to use are among the `most` on either side of that.
    each = frames.groupBy(key, time).agg(F.max(marked).alias("c"), F.max(~F.col(marked)).alias("todo"))
    earlier = Window.partitionBy(key).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("n", F.coalesce(F.sum(F.col("c").cast("int")).over(earlier), F.lit(0)))
    cond = each.filter("c").select(key, (F.col("n") + 1).alias("number"), F.col(time).alias("cond"))
    near = F.sequence(F.col("n") - (most - 1), F.col("n") + most)
    pairs = each.filter("todo").select(key, time, "n", F.explode(near).alias("number")).join(cond, [key, "number"])
    if keep_first:
        ends = cond.groupBy(key).agg(F.min("number").alias("one"), F.max("number").alias("all"))
        far = each.filter("todo").select(key, time, "n").join(ends, key).withColumn("number", F.when(F.col("n") > 0, F.col("one")).otherwise(F.col("all")))
        pairs = pairs.unionByName(far.select(key, time, "n", "number").join(cond, [key, "number"])).distinct()
        pairs = pairs.join(ends, key).withColumn("kept", F.col("number") == F.when(F.col("n") > 0, F.col("one")).otherwise(F.col("all")))
    else:
        pairs = pairs.withColumn("kept", F.lit(False))
    first = F.when(F.col("kept"), -1).when(F.col("number") == F.col("n"), 0).when(F.col("number") == F.col("n") + 1, 1).otherwise(2)
    order = Window.partitionBy(key, time).orderBy(first, F.abs(F.col("cond") - F.col(time)), "cond")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select(key, time, "cond", "rank")
