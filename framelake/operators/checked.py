"""Joins that must find their partners, loaders over them, and small tables about a session."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The share of frames taken to be keyframes, artefacts of a session, and waits before a retry in seconds.
KEYFRAMES = 0.15
ARTEFACTS = {"frame_map.json": "extraction", "scene_seeds.json": "pre_analysis", "masks": "propagation", "metadata.db": "analysis"}
WAITS = (1, 5, 15)


def required(left: DataFrame, right: DataFrame, keys: list[str], must: str, message: str) -> DataFrame:
    """left with right's columns; a row that finds none is an error, whatever is computed of the result."""
    out = left.join(right, keys, "left")
    return _must(out, F.col(must).isNotNull(), F.concat_ws(" ", F.lit(message), *[F.col(k).cast("string") for k in keys]))


def _must(rows: DataFrame, holds: Column, message: Column) -> DataFrame:
    """rows; one that does not hold is an error. A filter says so, as an expression on a column goes with the column."""
    return rows.filter(F.when(F.coalesce(holds, F.lit(False)), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def predictions_to_images(predictions: DataFrame, images: DataFrame) -> DataFrame:
    """Rows of tracks (video_id, track_id, category_id, score, boxes, areas) as rows of images: frames without a box, or
    with one of zeros, are left out; the rest must find their image (video_id, frame_index, image_id)."""
    areas = F.coalesce("areas", F.transform("boxes", lambda b: F.lit(None).cast("double")))
    rows = predictions.select("video_id", "track_id", "category_id", "score", F.posexplode(F.arrays_zip(F.col("boxes").alias("box"), areas.alias("area"))).alias("frame_index", "x"))
    rows = rows.select("video_id", "track_id", "category_id", "score", "frame_index", "x.box", "x.area").filter(F.col("box").isNotNull() & F.exists("box", lambda v: v != 0))
    rows = rows.withColumn("area", F.coalesce("area", F.col("box")[2] * F.col("box")[3]))
    return required(rows, images.select("video_id", "frame_index", "image_id"), ["video_id", "frame_index"], "image_id", "prediction without an image:")


def sized(annotations: DataFrame, videos: DataFrame) -> DataFrame:
    """annotations with height and width, from their video where they have none."""
    v = videos.select("video_id", F.col("height").alias("v_height"), F.col("width").alias("v_width"))
    out = annotations.join(v, "video_id", "left")
    return out.withColumn("height", F.coalesce("height", "v_height")).withColumn("width", F.coalesce("width", "v_width")).drop("v_height", "v_width")


def with_video(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """annotations with video_id, from their image where they have none."""
    return annotations.join(images.select("image_id", F.col("video_id").alias("own")), "image_id", "left").withColumn("video_id", F.coalesce("video_id", "own")).drop("own")


def tagged(videos: DataFrame, annotations: DataFrame, tag: str) -> DataFrame:
    """Videos with an annotation of the tag; one that has others too is an error, as tags are of whole videos."""
    has = F.array_contains("tags", tag)
    per = annotations.groupBy("video_id").agg(F.max(has).alias("any"), F.min(has).alias("all")).filter("any")
    per = per.withColumn("any", F.when(~F.col("all"), F.raise_error(F.concat(F.lit(f"not all annotations have the tag {tag}: video "), F.col("video_id").cast("string")))).otherwise(F.col("any"))).filter("any")
    return videos.join(per.select("video_id"), "video_id", "left_semi")


def frame_annotations(videos: DataFrame, annotations: DataFrame, frame: int) -> DataFrame:
    """video_id, file_name, phrase, mask (null where absent) of one frame of every video, in order of phrase."""
    v = videos.select("video_id", F.get("file_names", F.lit(frame)).alias("file_name"))
    a = annotations.select("video_id", "phrase", F.get("masks", F.lit(frame)).alias("mask"))
    return v.join(a, "video_id").select("video_id", "file_name", "phrase", "mask").orderBy("video_id", "phrase")


def image_phrases(images: DataFrame) -> DataFrame:
    """datapoint (from 0, by image), its image and its one query: image_id, file_name, category_id, text."""
    return images.select("image_id", "file_name", F.col("queried_category").cast("int").alias("category_id"), F.col("text_input").alias("text"), F.lit(0).alias("query"), F.lit(True).alias("is_exhaustive"))


def video_phrases(videos: DataFrame, pairs: DataFrame, categories: DataFrame) -> DataFrame:
    """A query for each noun phrase of a video and each of its frames: video_id, category_id, text, frame, file_name.

    pairs: video_id, category_id, noun_phrase; a phrase that is not its category's name is an error."""
    named = pairs.join(categories.select("category_id", F.col("name").alias("text")), "category_id", "left")
    named = _must(named, F.col("text") == F.col("noun_phrase"), F.concat_ws(" ", F.lit("category name does not match:"), "noun_phrase"))
    frames = videos.select("video_id", F.posexplode("file_names").alias("frame", "file_name"))
    return named.select("video_id", "category_id", "text").join(frames, "video_id")


def unique_images(rows: DataFrame, key: str = "image_id", order: str = "shard") -> DataFrame:
    """Of rows gathered from workers the first of each image."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")


def without_excluded(queries: DataFrame, excluded: Column, objects: str = "objects") -> DataFrame:
    """Queries none of whose objects is excluded."""
    return queries.filter(~F.coalesce(F.arrays_overlap(F.col(objects), excluded), F.lit(False)))


def work_totals(frames: Column, method: Column, nth: Column, scenes: DataFrame | None = None) -> tuple[Column, DataFrame | None]:
    """Frames to extract by method, and one row of scenes to look at and frames to follow, ends included."""
    whole = F.coalesce(frames, F.lit(0)).cast("long")
    every = F.greatest(F.lit(1), F.floor(whole / F.greatest(F.lit(1), nth)))
    keys = F.greatest(F.lit(1), F.floor(whole * KEYFRAMES))
    extraction = F.when(method == "every_nth_frame", every).when(method == "keyframes", keys).otherwise(whole)
    rest = None if scenes is None else scenes.agg(F.count("*").alias("pre_analysis"), F.coalesce(F.sum(F.greatest(F.lit(0), F.col("end_frame") - F.col("start_frame") + 1)), F.lit(0)).alias("propagation"))
    return extraction.cast("long"), rest


def session_status(spark: SparkSession, files: DataFrame) -> DataFrame:
    """artefact, step, present, files, bytes of a session's folder; files: path (relative), bytes."""
    each = spark.createDataFrame(list(ARTEFACTS.items()), "artefact string, step string")
    found = files.withColumn("artefact", F.split("path", "/")[0]).groupBy("artefact").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    return each.join(found, "artefact", "left").withColumn("present", F.col("files").isNotNull()).fillna(0, ["files", "bytes"])


def diagnosis(spark: SparkSession, packages: tuple[str, ...] = ("pyarrow", "pandas", "numpy", "duckdb"), paths: tuple[str, ...] = ()) -> DataFrame:
    """section, name, ok, detail: versions, packages and paths, as Spark sees them."""
    import importlib.metadata
    import platform

    rows = [("environment", "python", True, platform.python_version()), ("environment", "spark", True, spark.version)]
    for p in packages:
        try:
            rows.append(("packages", p, True, importlib.metadata.version(p)))
        except importlib.metadata.PackageNotFoundError:
            rows.append(("packages", p, False, "not installed"))
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        there = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
        rows.append(("paths", p, bool(there), "there" if there else "missing"))
    return spark.createDataFrame(rows, "section string, name string, ok boolean, detail string")


def photo_scenes(photos: DataFrame, order: str = "path") -> DataFrame:
    """shot_id, start_frame, end_frame and the photo: every photo is a scene of itself."""
    from framelake.operators.numbering import numbered

    n = numbered(photos, [order], "shot_id", 0)
    return n.withColumn("start_frame", F.col("shot_id")).withColumn("end_frame", F.col("shot_id"))


def probed(lines: DataFrame, column: str = "json") -> DataFrame:
    """width, height, fps, frame_count from a probe's JSON (streams with r_frame_rate as a fraction)."""
    s = F.from_json(column, "struct<streams: array<struct<codec_type: string, width: int, height: int, r_frame_rate: string, nb_frames: string>>>")["streams"]
    video = F.get(F.filter(s, lambda x: x["codec_type"] == "video"), F.lit(0))
    rate = F.split(video["r_frame_rate"], "/")
    fps = F.try_divide(rate[0].cast("double"), F.coalesce(F.get(rate, F.lit(1)).cast("double"), F.lit(1.0)))
    return lines.select("*", video["width"].alias("width"), video["height"].alias("height"), fps.alias("fps"), video["nb_frames"].cast("long").alias("frame_count"))


def retried(run: Callable[[], object], attempts: int = 3, waits: tuple[float, ...] = WAITS, wait: Callable[[float], None] = time.sleep):
    """run(), again after a wait where it fails; the last failure is raised."""
    for k in range(attempts):
        try:
            return run()
        except Exception:
            if k + 1 == attempts:
                raise
            wait(waits[min(k, len(waits) - 1)])


def detector_boxes(raw: DataFrame, size: int, least: float, target: int) -> DataFrame:
    """Boxes of a detector's raw rows (cx, cy, w, h on a letterboxed square of `size`, and an array of class scores): those
    whose best class is the target and scores enough, in whole pixels of the image (width, height)."""
    best = F.array_max("scores")
    w, h = F.col("width"), F.col("height")
    scale = F.lit(float(size)) / F.greatest(w, h)
    pad = lambda v: F.floor((F.lit(size) - F.floor(v * scale)) / 2)
    cut = lambda v, p, n: F.least(F.greatest((v - p) / scale, F.lit(0.0)), n.cast("double")).cast("int")
    out = raw.withColumn("class_id", (F.array_position("scores", best) - 1).cast("int")).withColumn("score", best).filter((F.col("class_id") == target) & (best >= least))
    half = lambda c, n, s: F.col(c) + s * F.col(n) / 2
    return out.select(
        "image_id", "score", "class_id",
        cut(half("cx", "bw", -1), pad(w), w).alias("x1"), cut(half("cy", "bh", -1), pad(h), h).alias("y1"),
        cut(half("cx", "bw", 1), pad(w), w).alias("x2"), cut(half("cy", "bh", 1), pad(h), h).alias("y2"),
    )
