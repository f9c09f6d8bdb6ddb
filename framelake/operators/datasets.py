"""Annotation datasets as tables: grouping, exploding, renumbering, merging, query filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.numbering import numbered


def group_by_image(images: DataFrame, annotations: DataFrame, key: str = "image_id", fields: tuple[str, ...] = ("ann_id", "category_id")) -> DataFrame:
    """Every image with its annotations in order of id; images without any have an empty list."""
    lists = annotations.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("annotations"))
    empty = F.array().cast(lists.schema["annotations"].dataType)
    return images.join(lists, key, "left").withColumn("annotations", F.coalesce("annotations", empty))


def image_queries(images: DataFrame, categories: DataFrame, annotations: DataFrame, negatives: bool = True, key: str = "image_id") -> DataFrame:
    """image, category, objects: a query for each category of an image; with negatives for every category there is.

    categories is a dimension table, and each image needs each of its rows."""
    found = annotations.groupBy(key, "category_id").agg(F.array_sort(F.collect_list("ann_id")).alias("objects"))
    if not negatives:
        return found
    every = images.select(key).join(F.broadcast(categories.select("category_id")))
    return every.join(found, [key, "category_id"], "left").withColumn("objects", F.coalesce("objects", F.array().cast(found.schema["objects"].dataType)))


def explode_tracks(tracks: DataFrame) -> DataFrame:
    """Tracks with parallel arrays boxes and areas (per frame, null where absent) to a row a frame, with dense ids.

    Rows without a box, or with one of zeros, drop out; a missing area is w * h."""
    rows = tracks.select("video_id", "track_id", "category_id", F.posexplode(F.arrays_zip("boxes", "areas")).alias("frame", "a"))
    rows = rows.select("video_id", "track_id", "category_id", "frame", F.col("a.boxes").alias("box"), F.col("a.areas").alias("area"))
    rows = rows.filter(F.col("box").isNotNull() & F.exists("box", lambda v: v != 0))
    return rows.withColumn("area", F.coalesce("area", F.col("box")[2] * F.col("box")[3]))


def dense_ids(rows: DataFrame, order: list[str], name: str, partition: list[str] | None = None, start: int = 1) -> DataFrame:
    """rows with ids start, start + 1, ... in order, within each partition."""
    if not partition:
        return numbered(rows, order, name, start)
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) + (start - 1))


def one_based(rows: DataFrame, column: str, group: str | None = None) -> DataFrame:
    """rows with `column` one higher throughout where it has a 0 anywhere."""
    zero = rows.groupBy(*([group] if group else [])).agg(F.max(F.col(column) == 0).alias("zero"))
    joined = rows.join(zero, group) if group else rows.join(F.broadcast(zero))  # one row
    return joined.withColumn(column, F.col(column) + F.col("zero").cast("int")).drop("zero")


def remap_pairs(positives: DataFrame, negatives: DataFrame, keys: tuple[str, str] = ("video_id", "category_id")) -> DataFrame:
    """An id for each pair: those of positives in order from 0, then the others."""
    pos = positives.select(*keys).distinct().withColumn("later", F.lit(0))
    neg = negatives.select(*keys).distinct().join(pos, list(keys), "left_anti").withColumn("later", F.lit(1))
    return numbered(pos.unionByName(neg), ["later", *keys], "unique_id", 0).drop("later")


def class_agnostic(rows: DataFrame, order: tuple[str, ...] = ("video_id", "category_id")) -> DataFrame:
    """rows with the id of their (video, category) as video_id and category 1."""
    ids = numbered(rows.select(*order).distinct(), list(order), "new_id", 0).withColumn("new_id", F.col("new_id").cast("int"))
    return rows.join(ids, list(order)).withColumn("video_id", F.col("new_id")).withColumn("category_id", F.lit(1)).drop("new_id")


def first_shard(rows: DataFrame, keys: list[str], shard: str = "shard") -> DataFrame:
    """Rows of the first shard that has their key."""
    least = rows.groupBy(*keys).agg(F.min(shard).alias("least"))
    return rows.join(least, keys).filter(F.col(shard) == F.col("least")).drop("least")


def best_of_image(rows: DataFrame, most: int, key: str = "image_id", score: str = "conf", order: str = "idx") -> DataFrame:
    """An image's `most` rows of greatest score, equal ones by order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def merge_shards(rows: DataFrame, most: int, key: str = "image_id") -> DataFrame:
    """Detections of shards: of each (image, category) the first shard's, then each image's best."""
    return best_of_image(first_shard(rows, [key, "category_id"]), most, key)


def timesteps(rows: DataFrame, video: str = "video_id", frame: str = "frame_index") -> DataFrame:
    """rows with timestep, the place of their frame among the video's frames, from 0."""
    steps = rows.select(video, frame).distinct().withColumn("timestep", F.row_number().over(Window.partitionBy(video).orderBy(frame)) - 1)
    return rows.join(steps, [video, frame])


def track_groups(videos: DataFrame, rows: DataFrame, video: str = "video_id", track: str = "track_id") -> DataFrame:
    """Every video with its number of tracks, rows, and the mean of its tracks' mean areas; empty ones stay."""
    per_track = rows.groupBy(video, track).agg(F.avg(F.col("w") * F.col("h")).alias("area"), F.count("*").alias("n"))
    per_video = per_track.groupBy(video).agg(F.count("*").alias("tracks"), F.sum("n").alias("rows"), F.avg("area").alias("area"))
    return videos.join(per_video, video, "left").fillna(0, ["tracks", "rows"])


def merged_categories(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """rows with merged categories (from, to) replaced; others stay."""
    m = merges.select(F.col("from").alias("category_id"), F.col("to").alias("merged"))
    return rows.join(m, "category_id", "left").withColumn("category_id", F.coalesce("merged", "category_id")).drop("merged")


def in_truth(detections: DataFrame, gt: DataFrame, keys: list[str]) -> DataFrame:
    """Detections whose image and category occur in the truth."""
    return detections.join(gt.select(*keys).distinct(), keys, "left_semi")


def known_unknown(rows: DataFrame, known: list[int], distractors: list[int]) -> DataFrame:
    """rows with split: known, distractor or unknown, by category."""
    c = F.col("category_id")
    return rows.withColumn("split", F.when(c.isin(*known), "known").when(c.isin(*distractors), "distractor").otherwise("unknown"))


def subset(gt: DataFrame, detections: DataFrame, keys: list[str], name: str, known: list[int], distractors: list[int]) -> tuple[DataFrame, DataFrame]:
    """Truths of one split (known, distractor, unknown, or all), and the detections of images (keys) that have any of them."""
    left = gt if name == "all" else known_unknown(gt, known, distractors).filter(F.col("split") == name).drop("split")
    return left, detections.join(left.select(*keys).distinct(), keys, "left_semi")


def most_a_frame(queries: DataFrame, most: int, positives: bool = False, seed: int = 0) -> DataFrame:
    """Queries (datapoint, frame, query, objects) of videos whose frames all have the same ones in the same order: the same `most` of each frame.

    They are chosen in frame 0 by a hash, with `positives` those with objects first. A video without a frame of more than `most` keeps all."""
    # All windows read one exchange by datapoint in one order; the choice is made at a datapoint's first row.
    every, frame = Window.partitionBy("datapoint"), Window.partitionBy("datapoint", "frame")
    rank = F.when(F.size("objects") > 0, 0).when(F.size("objects") <= 0, 1).otherwise(2) if positives else F.lit(0)
    t = queries.withColumn("__rank", rank).withColumn("__row", F.row_number().over(every.orderBy("frame", "query")))
    t = t.withColumn("__place", F.col("__row") - F.min("__row").over(frame) + 1)
    mark = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("datapoint").cast("string"), F.col("__place").cast("string")))
    first = F.when(F.col("frame") == 0, F.struct("__rank", mark.alias("mark"), F.col("__place").alias("place")))
    t = t.withColumns({"__large": F.max("__place").over(every) > most, "__first": F.collect_list(first).over(every)})
    chosen = F.transform(F.slice(F.array_sort("__first"), 1, most), lambda x: x["place"])
    t = t.withColumn("__first", F.when(F.col("__large") & (F.col("__row") == 1), chosen)).withColumn("__chosen", F.first("__first", ignorenulls=True).over(every))
    return t.filter(~F.col("__large") | F.array_contains("__chosen", F.col("__place"))).drop("__rank", "__row", "__place", "__large", "__first", "__chosen")


def filter_queries(queries: DataFrame, keep: Column) -> DataFrame:
    """Queries (datapoint, stage, query, objects) that pass, renumbered without gaps, and their objects too.

    Datapoints that lose all queries, or all of stage 0, are dropped."""
    left = queries.filter(keep).withColumn("has_first", F.max(F.col("stage") == 0).over(Window.partitionBy("datapoint"))).filter("has_first").drop("has_first")
    w = Window.partitionBy("datapoint").orderBy("stage", "query")
    left = left.withColumn("new_query", F.row_number().over(w) - 1).withColumn("new_stage", F.dense_rank().over(Window.partitionBy("datapoint").orderBy("stage")) - 1)
    objects = left.select("datapoint", F.explode("objects").alias("object")).distinct()
    objects = objects.withColumn("new_object", F.row_number().over(Window.partitionBy("datapoint").orderBy("object")) - 1)
    rows = left.select("datapoint", "new_stage", "new_query", F.explode_outer("objects").alias("object")).join(objects, ["datapoint", "object"], "left")
    return rows.groupBy("datapoint", "new_stage", "new_query").agg(F.array_sort(F.collect_list("new_object")).alias("objects"))


def positives_first(queries: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """Of each datapoint at most so many queries: those with objects first, then by a hash."""
    order = Window.partitionBy("datapoint").orderBy(F.desc(F.size("objects") > 0), F.xxhash64("datapoint", "query", F.lit(seed)), "query")
    return queries.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).drop("k")


def relative_xywh(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> tuple[Column, ...]:
    """A box in shares of its image; one that is in shares already stays."""
    whole = F.greatest(x, y, w, h) > 1
    return tuple(F.when(whole, F.try_divide(v, n)).otherwise(v) for v, n in ((x, width), (y, height), (w, width), (h, height)))


def without_edges(x: Column, y: Column, margin: float = 0.025) -> Column:
    """Whether a relative centre is further than the margin from every edge."""
    return (x >= margin) & (x <= 1 - margin) & (y >= margin) & (y <= 1 - margin)


def padded(array: Column, size: int, fill: Column) -> Column:
    """A ragged array at one length."""
    return F.slice(F.concat(array, F.array_repeat(fill, F.greatest(F.lit(size) - F.size(array), F.lit(0)))), 1, size)
