"""Annotation-dataset, text and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import metrics, text
from framelake.operators import datasets as D
from framelake.plans.adapters import adapted, table, with_
from framelake.plans.registry import near, near_sql, query

_D, _T = with_("detections"), with_("tracks")


def _annotations(spark, d):
    t = adapted(spark, d, "detections")
    return t.select("image_id", (F.col("image_id") * 100 + F.col("idx")).alias("ann_id"), "category_id", "idx", "x1", "y1", "x2", "y2", "conf", "is_gt")


@query("coco_group", f"{_D}, i AS (SELECT o_orderkey AS image_id FROM orders), a AS (SELECT image_id, string_agg(image_id * 100 + idx || ':' || category_id, ',' ORDER BY idx) AS annotations FROM detections GROUP BY 1) SELECT image_id, coalesce(annotations, '') AS annotations FROM i LEFT JOIN a USING (image_id)")
def coco_group(spark, d):
    images = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"))
    g = D.group_by_image(images, _annotations(spark, d).withColumn("category_id", F.col("category_id")))
    return g.select("image_id", F.array_join(F.transform("annotations", lambda a: F.concat_ws(":", a["ann_id"], a["category_id"])), ",").alias("annotations"))


@query("coco_queries", f"{_D}, i AS (SELECT o_orderkey AS image_id FROM orders), c AS (SELECT CAST(range AS INT) AS category_id FROM range(5)), a AS (SELECT image_id, category_id, count(*) AS n, min(idx) AS first FROM detections GROUP BY ALL) SELECT image_id, category_id, CAST(coalesce(n, 0) AS INT) AS objects FROM (SELECT * FROM i, c) x LEFT JOIN a USING (image_id, category_id)")
def coco_queries(spark, d):
    images = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"))
    categories = spark.range(5).select(F.col("id").cast("int").alias("category_id"))
    return D.image_queries(images, categories, _annotations(spark, d)).select("image_id", "category_id", F.size("objects").alias("objects"))


@query("ytvis_explode", f"{_T} SELECT video_id, track_id, frame, w * h AS area, row_number() OVER (ORDER BY video_id, track_id, frame) AS ann_id FROM tracks WHERE frame % 3 <> 0")
def ytvis_explode(spark, d):
    box = F.when(F.col("frame") % 3 != 0, F.array("x", "y", "w", "h"))
    t = adapted(spark, d, "tracks").select("video_id", "track_id", "category_id", "frame", box.alias("box"))
    packed = t.groupBy("video_id", "track_id", "category_id").agg(F.array_sort(F.collect_list(F.struct("frame", "box"))).alias("p"))
    packed = packed.select("video_id", "track_id", "category_id", F.transform("p", lambda x: x["box"]).alias("boxes"), F.transform("p", lambda x: F.lit(None).cast("double")).alias("areas"))
    rows = D.explode_tracks(packed)
    return D.dense_ids(rows, ["video_id", "track_id", "frame"], "ann_id").select("video_id", "track_id", "frame", "area", F.col("ann_id").cast("long").alias("ann_id"))


@query("reindex", "SELECT doc_id + 1 AS doc_id, lang FROM documents")
def reindex(spark, d):
    return D.one_based(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")


@query("remap_pairs", f"""{_D}, p AS (SELECT DISTINCT image_id % 50 AS video_id, category_id FROM detections WHERE is_gt), n AS (SELECT DISTINCT image_id % 60 AS video_id, category_id FROM detections WHERE NOT is_gt),
u AS (SELECT video_id, category_id, 0 AS later FROM p UNION ALL SELECT video_id, category_id, 1 FROM n WHERE (video_id, category_id) NOT IN (SELECT video_id, category_id FROM p)) SELECT video_id, category_id, row_number() OVER (ORDER BY later, video_id, category_id) - 1 AS unique_id FROM u""")
def remap_pairs(spark, d):
    a = _annotations(spark, d)
    pos = a.filter("is_gt").select((F.col("image_id") % 50).alias("video_id"), "category_id")
    neg = a.filter("not is_gt").select((F.col("image_id") % 60).alias("video_id"), "category_id")
    return D.remap_pairs(pos, neg).withColumn("unique_id", F.col("unique_id").cast("long"))


@query("class_agnostic", f"{_T} SELECT CAST(dense_rank() OVER (ORDER BY video_id, category_id) - 1 AS INT) AS video_id, track_id, frame, 1 AS category_id FROM tracks")
def class_agnostic(spark, d):
    return D.class_agnostic(adapted(spark, d, "tracks").select("video_id", "track_id", "frame", "category_id")).select("video_id", "track_id", "frame", "category_id")


_SHARDS = f"{_D}, s AS (SELECT *, idx % 2 AS shard FROM detections), f AS (SELECT * FROM (SELECT *, min(shard) OVER (PARTITION BY image_id, category_id) AS least FROM s) WHERE shard = least)"


@query("topk_merge", f"{_SHARDS} SELECT image_id, idx, category_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, idx) AS k FROM f) WHERE k <= 3")
def topk_merge(spark, d):
    t = adapted(spark, d, "detections").withColumn("shard", F.col("idx") % 2)
    return D.merge_shards(t, 3).select("image_id", "idx", "category_id")


@query("limit_dets", f"{_D} SELECT image_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, idx) AS k FROM detections) WHERE k <= 2")
def limit_dets(spark, d):
    return D.best_of_image(adapted(spark, d, "detections"), 2).select("image_id", "idx")


@query("image_timestep", "SELECT event_id, user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS timestep FROM events")
def image_timestep(spark, d):
    t = table(spark, d, "events").select("event_id", F.col("user_id").alias("video_id"), F.col("event_id").alias("frame_index"))
    return D.timesteps(t).select("event_id", "video_id", F.col("timestep").cast("long").alias("timestep"))


@query("track_group", f"{_T}, t AS (SELECT video_id, track_id, avg(w * h) AS a, count(*) AS n FROM tracks GROUP BY ALL), v AS (SELECT CAST(range AS INT) AS video_id FROM range(12)) SELECT video_id, count(track_id) AS tracks, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows, {near_sql('avg(a)', 4)} AS area FROM v LEFT JOIN t USING (video_id) GROUP BY 1")
def track_group(spark, d):
    videos = spark.range(12).select(F.col("id").cast("int").alias("video_id"))
    return D.track_groups(videos, adapted(spark, d, "tracks")).select("video_id", "tracks", "rows", near(F.col("area"), 4).alias("area"))


@query("category_merge", f"{_D} SELECT image_id, idx, CASE category_id WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE category_id END AS category_id FROM detections")
def category_merge(spark, d):
    merges = spark.createDataFrame([(3, 1), (4, 1)], "from int, to int")
    return D.merged_categories(adapted(spark, d, "detections"), merges).select("image_id", "idx", "category_id")


@query("positive_split", f"{_D} SELECT image_id, idx FROM detections a WHERE NOT is_gt AND EXISTS (SELECT 1 FROM detections b WHERE b.is_gt AND b.image_id = a.image_id AND b.category_id = a.category_id)")
def positive_split(spark, d):
    a = _annotations(spark, d)
    return D.in_truth(a.filter("not is_gt"), a.filter("is_gt"), ["image_id", "category_id"]).select("image_id", "idx")


@query("known_unknown", f"{_D} SELECT split, count(*) AS n FROM (SELECT CASE WHEN category_id IN (0, 1) THEN 'known' WHEN category_id = 4 THEN 'distractor' ELSE 'unknown' END AS split FROM detections) GROUP BY 1")
def known_unknown(spark, d):
    return D.known_unknown(adapted(spark, d, "detections"), [0, 1], [4]).groupBy("split").agg(F.count("*").alias("n"))


def _queries(spark, d):
    a = _annotations(spark, d)
    q = a.groupBy((F.col("image_id") % 500).alias("datapoint"), F.col("category_id").cast("long").alias("query")).agg(F.array_sort(F.collect_set(F.col("ann_id") % 97)).alias("objects"))
    return q.withColumn("stage", (F.col("query") % 2).cast("int"))


@query("filter_reindex", f"""{_D}, q AS (SELECT image_id % 500 AS datapoint, category_id AS query, category_id % 2 AS stage, list_sort(list(DISTINCT (image_id * 100 + idx) % 97)) AS objects FROM detections GROUP BY 1, 2), l AS (SELECT * FROM q WHERE query <> 2),
k AS (SELECT *, bool_or(stage = 0) OVER (PARTITION BY datapoint) AS ok FROM l), r AS (SELECT datapoint, row_number() OVER (PARTITION BY datapoint ORDER BY stage, query) - 1 AS new_query, dense_rank() OVER (PARTITION BY datapoint ORDER BY stage) - 1 AS new_stage, objects FROM k WHERE ok),
o AS (SELECT datapoint, object, row_number() OVER (PARTITION BY datapoint ORDER BY object) - 1 AS new_object FROM (SELECT DISTINCT datapoint, unnest(objects) AS object FROM r))
SELECT r.datapoint, CAST(new_stage AS INT) AS new_stage, CAST(new_query AS INT) AS new_query, string_agg(CAST(new_object AS VARCHAR), ',' ORDER BY new_object) AS objects FROM (SELECT datapoint, new_stage, new_query, unnest(objects) AS object FROM r) r JOIN o USING (datapoint, object) GROUP BY ALL""")
def filter_reindex(spark, d):
    out = D.filter_queries(_queries(spark, d), F.col("query") != 2)
    return out.withColumn("objects", F.array_join("objects", ","))


@query("bbox_relative", f"{_D} SELECT image_id, idx, {near_sql('x1 / 640')} AS x, {near_sql('y1 / 480')} AS y, {near_sql('(x2 - x1) / 640')} AS w, {near_sql('(y2 - y1) / 480')} AS h, (x1 + x2) / 2 / 640 BETWEEN 0.025 AND 0.975 AND (y1 + y2) / 2 / 480 BETWEEN 0.025 AND 0.975 AS inside FROM detections")
def bbox_relative(spark, d):
    t = adapted(spark, d, "detections")
    box = D.relative_xywh(F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(640.0), F.lit(480.0))
    inside = D.without_edges((F.col("x1") + F.col("x2")) / 2 / 640, (F.col("y1") + F.col("y2")) / 2 / 480)
    return t.select("image_id", "idx", *[near(b).alias(n) for n, b in zip("xywh", box, strict=True)], inside.alias("inside"))


_QUALITY = "coalesce(sharpness_score / 100, 0.0) * (25 / 100.0::DOUBLE) + coalesce(edge_strength_score / 100, 0.0) * (15 / 100.0::DOUBLE) + coalesce(contrast_score / 100, 0.0) * (15 / 100.0::DOUBLE) + coalesce(brightness_score / 100, 0.0) * (10 / 100.0::DOUBLE) + coalesce(entropy_score / 100, 0.0) * (15 / 100.0::DOUBLE) + coalesce(niqe_score / 100, 0.0) * (20 / 100.0::DOUBLE)"


@query("quality_score", f"{with_('frames')} SELECT filename, {near_sql('(' + _QUALITY + ') * 100')} AS quality FROM frames")
def quality_score(spark, d):
    values = {k: F.col(f"metrics.{k}_score") / 100 for k in metrics.QUALITY_WEIGHTS}
    return adapted(spark, d, "frames").select("filename", near(metrics.quality_score(values)).alias("quality"))


@query("star_rating", f"{with_('frames')} SELECT filename, CAST(CASE WHEN quality_score >= 90 THEN 5 WHEN quality_score >= 80 THEN 4 WHEN quality_score >= 60 THEN 3 WHEN quality_score >= 40 THEN 2 WHEN quality_score >= 20 THEN 1 ELSE 0 END AS INT) AS stars, CASE WHEN quality_score >= 80 THEN 'Green' WHEN quality_score >= 30 THEN 'Yellow' ELSE 'Red' END AS label FROM frames")
def star_rating(spark, d):
    q = F.coalesce("metrics.quality_score", F.lit(0.0))
    status = F.when(q >= 80, "kept").when(q >= 30, "review").otherwise("rejected")
    return adapted(spark, d, "frames").select("filename", text.star_rating(q).alias("stars"), text.colour_label(status).alias("label"))


@query("face_pose", f"{with_('frames')}, a AS (SELECT filename, radians(yaw) AS y, radians(pitch) AS p, radians(roll) AS r FROM frames WHERE yaw IS NOT NULL) SELECT filename, {near_sql('degrees(y)', 4)} AS yaw, {near_sql('degrees(p)', 4)} AS pitch, {near_sql('degrees(r)', 4)} AS roll FROM a")
def face_pose(spark, d):
    t = adapted(spark, d, "frames").filter("metrics.yaw is not null")
    y, p, r = (F.radians(f"metrics.{c}") for c in ("yaw", "pitch", "roll"))
    # Rotation about roll, yaw and pitch in turn, as a matrix of rows.
    m = F.array(
        F.array(F.cos(r) * F.cos(y), F.cos(r) * F.sin(y) * F.sin(p) - F.sin(r) * F.cos(p), F.cos(r) * F.sin(y) * F.cos(p) + F.sin(r) * F.sin(p)),
        F.array(F.sin(r) * F.cos(y), F.sin(r) * F.sin(y) * F.sin(p) + F.cos(r) * F.cos(p), F.sin(r) * F.sin(y) * F.cos(p) - F.cos(r) * F.sin(p)),
        F.array(-F.sin(y), F.cos(y) * F.sin(p), F.cos(y) * F.cos(p)),
    )
    yaw, pitch, roll = metrics.head_pose(F.col("m"))
    return t.select("filename", m.alias("m")).select("filename", near(yaw, 4).alias("yaw"), near(pitch, 4).alias("pitch"), near(roll, 4).alias("roll"))


@query("eyes_open", f"{with_('frames')} SELECT filename, {near_sql('1 - greatest(blink_prob, blink_prob / 2)')} AS eyes_open, {near_sql('greatest(blink_prob, blink_prob / 2)')} AS blink FROM frames WHERE blink_prob IS NOT NULL")
def eyes_open(spark, d):
    t = adapted(spark, d, "frames").filter("metrics.blink_prob is not null")
    shapes = F.create_map(F.lit("eyeBlinkLeft"), F.col("metrics.blink_prob"), F.lit("eyeBlinkRight"), F.col("metrics.blink_prob") / 2)
    o, _, b = metrics.eyes(shapes)
    return t.select("filename", near(o).alias("eyes_open"), near(b).alias("blink"))


@query("sanitised_names", "SELECT page_id, substr(regexp_replace(url, '[^\\w\\-.]', '_', 'g'), 1, 50) AS name FROM pages")
def sanitised_names(spark, d):
    return table(spark, d, "pages").select("page_id", text.sanitised(F.col("url")).alias("name"))


@query("eta_format", "SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm ' || s % 60 || 's' ELSE s // 3600 || 'h ' || s // 60 % 60 || 'm' END AS eta FROM (SELECT event_id, CAST(trunc(value * 100) AS BIGINT) AS s FROM events)")
def eta_format(spark, d):
    return table(spark, d, "events").select("event_id", text.eta(F.col("value") * 100).alias("eta"))


@query("settings_hash", """SELECT event_id, md5('{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS hash FROM events""")
def settings_hash(spark, d):
    return table(spark, d, "events").select("event_id", text.settings_hash("user_id", "event_type").alias("hash"))


@query("showinfo_frames", "SELECT event_id, CAST(round_even(CAST(printf('%.2f', event_id * 0.04::DOUBLE) AS DOUBLE) * 25, 0) AS BIGINT) AS frame FROM events")
def showinfo_frames(spark, d):
    line = F.concat(F.lit("[Parsed_showinfo] n: 1 pts_time:"), F.format_string("%.2f", F.col("event_id") * 0.04), F.lit(" fmt:yuv"))
    return table(spark, d, "events").select("event_id", text.frame_of_time(line, 25.0).alias("frame"))


@query("preview_scale", "SELECT l_orderkey, w, h, greatest(2, CAST(floor(w * k / 2) AS INT) * 2) AS pw, greatest(2, CAST(floor(h * k / 2) AS INT) * 2) AS ph FROM (SELECT *, least(1.0, sqrt(500000::DOUBLE / (w * h))) AS k FROM (SELECT DISTINCT l_orderkey, CAST(l_orderkey % 3000 + 100 AS INT) AS w, CAST(l_orderkey % 1700 + 90 AS INT) AS h FROM lineitem))")
def preview_scale(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_orderkey") % 3000 + 100).cast("int").alias("w"), (F.col("l_orderkey") % 1700 + 90).cast("int").alias("h")).distinct()
    pw, ph = text.preview_scale(F.col("w"), F.col("h"), 500000.0)
    return t.select("l_orderkey", "w", "h", pw.alias("pw"), ph.alias("ph"))
