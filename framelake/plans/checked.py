"""Queries of joins that must find their partners, of loaders, and of tables about a session."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.operators import checked as C
from framelake.operators import transforms as T
from framelake.plans.adapters import adapted, table, with_
from framelake.plans.registry import near, near_sql, query

_T, _D = with_("tracks"), with_("detections")


def _tracks(spark, d):
    """Tracks with arrays of boxes by frame, absent in every third."""
    box = F.when(F.col("frame") % 3 != 0, F.array("x", "y", "w", "h"))
    t = adapted(spark, d, "tracks").select("video_id", "track_id", "category_id", "score", "frame", box.alias("box"))
    packed = t.groupBy("video_id", "track_id", "category_id").agg(F.array_sort(F.collect_list(F.struct("frame", "box"))).alias("p"), F.max("score").alias("score"))
    return packed.select("video_id", "track_id", "category_id", "score", F.transform("p", lambda x: x["box"]).alias("boxes"), F.lit(None).cast("array<double>").alias("areas"))


def _images(spark, d):
    frames = adapted(spark, d, "tracks").select("video_id", F.col("frame").alias("frame_index")).distinct()
    return frames.withColumn("image_id", F.col("video_id").cast("long") * 1000000 + F.col("frame_index"))


@query("predictions_to_images", f"{_T} SELECT CAST(video_id AS BIGINT) * 1000000 + frame AS image_id, track_id, w * h AS area FROM tracks WHERE frame % 3 <> 0")
def predictions_to_images(spark, d):
    return C.predictions_to_images(_tracks(spark, d), _images(spark, d)).select("image_id", "track_id", "area")


@query("annotation_sizes", "SELECT o_orderkey AS ann_id, CASE WHEN o_orderkey % 3 = 0 THEN 480 ELSE CAST(c_nationkey * 10 AS INT) END AS height, CAST(c_nationkey * 20 AS INT) AS width FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def annotation_sizes(spark, d):
    anns = table(spark, d, "orders").select(F.col("o_orderkey").alias("ann_id"), F.col("o_custkey").alias("video_id"), F.when(F.col("o_orderkey") % 3 == 0, 480).alias("height"), F.lit(None).cast("int").alias("width"))
    videos = table(spark, d, "customer").select(F.col("c_custkey").alias("video_id"), (F.col("c_nationkey") * 10).cast("int").alias("height"), (F.col("c_nationkey") * 20).cast("int").alias("width"))
    return C.sized(anns, videos).select("ann_id", "height", "width")


@query("annotation_videos", "SELECT o_orderkey AS ann_id, CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE c_nationkey END AS video_id FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def annotation_videos(spark, d):
    anns = table(spark, d, "orders").select(F.col("o_orderkey").alias("ann_id"), F.col("o_custkey").alias("image_id"), F.when(F.col("o_orderkey") % 4 == 0, -1).alias("video_id"))
    return C.with_video(anns, table(spark, d, "customer").select(F.col("c_custkey").alias("image_id"), F.col("c_nationkey").alias("video_id"))).select("ann_id", "video_id")


@query("tagged_videos", "SELECT c_custkey AS video_id FROM customer WHERE c_custkey % 5 = 2 AND c_custkey IN (SELECT o_custkey FROM orders)")
def tagged_videos(spark, d):
    anns = table(spark, d, "orders").select(F.col("o_custkey").alias("video_id"), F.when(F.col("o_custkey") % 5 == 2, F.array(F.lit("night"), F.lit("rain"))).otherwise(F.array(F.lit("day"))).alias("tags"))
    return C.tagged(table(spark, d, "customer").select(F.col("c_custkey").alias("video_id")), anns, "night")


@query("frame_annotations", f"{_T} SELECT video_id, concat('v', video_id, '/2.jpg') AS file_name, concat('class ', category_id, ' ', track_id) AS phrase, max(CASE WHEN frame = 2 THEN x END) AS x FROM tracks GROUP BY video_id, category_id, track_id")
def frame_annotations(spark, d):
    anns = _tracks(spark, d).select("video_id", F.concat(F.lit("class "), "category_id", F.lit(" "), "track_id").alias("phrase"), F.col("boxes").alias("masks"))
    videos = anns.select("video_id").distinct().withColumn("file_names", F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit("v"), F.col("video_id"), F.lit("/"), i, F.lit(".jpg"))))
    return C.frame_annotations(videos, anns, 2).select("video_id", "file_name", "phrase", F.col("mask")[0].alias("x"))


@query("image_phrases", "SELECT doc_id AS image_id, concat('img', doc_id, '.jpg') AS file_name, CAST(doc_id % 90 AS INT) AS category_id, lang AS text, 0 AS query, true AS is_exhaustive FROM documents")
def image_phrases(spark, d):
    images = table(spark, d, "documents").select(F.col("doc_id").alias("image_id"), F.concat(F.lit("img"), "doc_id", F.lit(".jpg")).alias("file_name"), (F.col("doc_id") % 90).alias("queried_category"), F.col("lang").alias("text_input"))
    return C.image_phrases(images)


@query("video_phrases", "SELECT s_suppkey AS video_id, n_nationkey AS category_id, n_name AS text, CAST(i AS INT) AS frame, concat('s', s_suppkey, '/', i) AS file_name FROM supplier JOIN nation ON n_nationkey % 5 = s_nationkey % 5, range(3) r(i)")
def video_phrases(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    videos = s.select(F.col("s_suppkey").alias("video_id"), F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.lit("s"), F.col("s_suppkey"), F.lit("/"), i)).alias("file_names"))
    pairs = s.join(n, F.col("n_nationkey") % 5 == F.col("s_nationkey") % 5).select(F.col("s_suppkey").alias("video_id"), F.col("n_nationkey").alias("category_id"), F.col("n_name").alias("noun_phrase"))
    return C.video_phrases(videos, pairs, n.select(F.col("n_nationkey").alias("category_id"), F.col("n_name").alias("name")))


@query("unique_images", f"{_D} SELECT image_id, min(idx) AS idx FROM detections GROUP BY 1")
def unique_images(spark, d):
    return C.unique_images(adapted(spark, d, "detections").select("image_id", "idx"), order="idx")


@query("excluded_objects", f"{_D} SELECT image_id FROM detections GROUP BY 1 HAVING count(*) FILTER (category_id IN (1, 3)) = 0")
def excluded_objects(spark, d):
    t = adapted(spark, d, "detections").groupBy("image_id").agg(F.collect_set("category_id").alias("objects"))
    return C.without_excluded(t, F.array(F.lit(1), F.lit(3))).select("image_id")


@query("work_totals", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN greatest(1, CAST(floor(o_custkey / greatest(1, o_orderkey % 4)) AS BIGINT)) WHEN 'O' THEN greatest(1, CAST(floor(o_custkey * 0.15::DOUBLE) AS BIGINT)) ELSE o_custkey END AS extraction FROM orders")
def work_totals(spark, d):
    method = F.when(F.col("o_orderstatus") == "F", "every_nth_frame").when(F.col("o_orderstatus") == "O", "keyframes").otherwise("all")
    return table(spark, d, "orders").select("o_orderkey", C.work_totals(F.col("o_custkey"), method, F.col("o_orderkey") % 4)[0].alias("extraction"))


@query("scene_totals", "SELECT count(*) AS pre_analysis, CAST(sum(8) AS BIGINT) AS propagation FROM orders")
def scene_totals(spark, d):
    scenes = adapted(spark, d, "scenes")
    return C.work_totals(F.lit(0), F.lit("all"), F.lit(1), scenes)[1]


@query("session_status", "SELECT a AS artefact, count(p_partkey) AS files, CAST(coalesce(sum(p_size), 0) AS BIGINT) AS bytes, count(p_partkey) > 0 AS present FROM (VALUES ('frame_map.json', 0), ('masks', 1), ('scene_seeds.json', 9), ('metadata.db', 9)) v(a, k) LEFT JOIN part ON CASE WHEN p_partkey = 0 THEN 0 ELSE 1 END = k GROUP BY 1")
def session_status(spark, d):
    files = table(spark, d, "part").select(F.when(F.col("p_partkey") == 0, "frame_map.json").otherwise(F.concat(F.lit("masks/"), "p_partkey", F.lit(".png"))).alias("path"), F.col("p_size").cast("long").alias("bytes"))
    return C.session_status(spark, files).select("artefact", "files", "bytes", "present")


@query("photo_scenes", "SELECT p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS shot_id, row_number() OVER (ORDER BY p_partkey) - 1 AS start_frame, row_number() OVER (ORDER BY p_partkey) - 1 AS end_frame FROM part")
def photo_scenes(spark, d):
    return C.photo_scenes(table(spark, d, "part").select("p_name", "p_partkey"), "p_partkey").select("p_name", "shot_id", "start_frame", "end_frame")


@query("video_probe", f"SELECT s_suppkey, CAST(1280 + s_nationkey AS INT) AS width, 720 AS height, {near_sql('30000::DOUBLE / (1001 + s_suppkey)')} AS fps, s_suppkey * 10 AS frame_count FROM supplier")
def video_probe(spark, d):
    stream = '{"streams": [{"codec_type": "audio"}, {"codec_type": "video", "width": %d, "height": 720, "r_frame_rate": "30000/%d", "nb_frames": "%d"}]}'
    t = table(spark, d, "supplier").select("s_suppkey", F.format_string(stream, F.col("s_nationkey") + 1280, F.col("s_suppkey") + 1001, F.col("s_suppkey") * 10).alias("json"))
    return C.probed(t).select("s_suppkey", "width", "height", near(F.col("fps")).alias("fps"), "frame_count")


_RAW = f"{_D}, r AS (SELECT image_id, idx, x1 + 20 AS cx, y1 + 30 AS cy, 40 + idx AS bw, 50.0 AS bh, conf, category_id FROM detections)"
_SCALE = "(640.0::DOUBLE / 800)"


def _cut(v: str, pad: str, most: int) -> str:
    return f"CAST(trunc(least(greatest(({v} - {pad}) / {_SCALE}, 0.0), {most})) AS INT)"


@query("detector_boxes", f"{_RAW} SELECT image_id, idx, conf AS score, {_cut('(cx - bw / 2)', '0', 800)} AS x1, {_cut('(cy - bh / 2)', '80', 600)} AS y1, {_cut('(cx + bw / 2)', '0', 800)} AS x2, {_cut('(cy + bh / 2)', '80', 600)} AS y2 FROM r WHERE category_id = 2 AND conf >= 0.5")
def detector_boxes(spark, d):
    t = adapted(spark, d, "detections")
    scores = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda c: F.when(c == F.col("category_id"), F.col("conf")).otherwise(F.col("conf") / 2 - c / 100))
    raw = t.select(F.struct("image_id", "idx").alias("image_id"), (F.col("x1") + 20).alias("cx"), (F.col("y1") + 30).alias("cy"), (F.col("idx") + 40).alias("bw"), F.lit(50.0).alias("bh"), scores.alias("scores"), F.lit(800).alias("width"), F.lit(600).alias("height"))
    return C.detector_boxes(raw, 640, 0.5, 2).select("image_id.image_id", "image_id.idx", "score", "x1", "y1", "x2", "y2")


@query("query_filters_rest", f"{_D}, q AS (SELECT image_id, category_id, count(*) FILTER (is_gt) AS crowds, min(conf) AS least FROM detections GROUP BY ALL) SELECT image_id, category_id FROM q WHERE crowds = 0 AND category_id <> 4 AND least >= 0.4::DOUBLE")
def query_filters_rest(spark, d):
    """Semantic ones, those with crowds, and those that are not exhaustive go."""
    t = adapted(spark, d, "detections").groupBy("image_id", "category_id").agg(F.count_if("is_gt").alias("n_crowd"), F.min("conf").alias("least"))
    t = t.withColumn("is_semantic", F.col("category_id") == 4).withColumn("is_exhaustive", F.col("least") >= 0.4)
    return t.filter(T.not_semantic() & T.without_crowds() & T.exhaustive()).select("image_id", "category_id")


@query("queries_at_most", f"{_D} SELECT image_id, least(count(*), 2) AS n FROM detections GROUP BY 1")
def queries_at_most(spark, d):
    t = adapted(spark, d, "detections").select("image_id", F.col("idx").alias("query"))
    return T.at_most(t, 2, ["image_id"]).groupBy("image_id").agg(F.count("*").alias("n"))


@query("reworded_queries", f"{_D} SELECT image_id, idx, CASE WHEN category_id = 3 THEN 'visual' ELSE 'a photo of ' || CASE WHEN category_id = 1 THEN 'thing' ELSE concat('class ', category_id) END || '.' END AS text, category_id = 3 AND conf < 0.6::DOUBLE AS box_dropped FROM detections")
def reworded_queries(spark, d):
    t = adapted(spark, d, "detections").withColumn("text", F.concat(F.lit("class "), "category_id"))
    text, box = T.visual(T.reworded(F.col("text"), "a photo of ", ".", {"class 1": "thing"}), F.struct("x1"), F.col("category_id") == 3, F.col("conf") < 0.6)
    return t.select("image_id", "idx", text.alias("text"), box.isNull().alias("box_dropped"))
