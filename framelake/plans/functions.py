"""Queries of functions that other queries do not reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import boxes as B
from framelake.functions import metrics, text
from framelake.operators import datasets, filters, scenes
from framelake.plans.adapters import adapted, table, with_
from framelake.plans.registry import near, near_sql, query

_D = with_("detections")
_I = "greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_A, _B = (f"(({t}.x2 - {t}.x1) * ({t}.y2 - {t}.y1))" for t in "ab")
_NEXT = "FROM detections a JOIN detections b ON a.image_id = b.image_id AND b.idx = a.idx + 1"


def _next(spark, d):
    t = adapted(spark, d, "detections").select("image_id", "idx", "x1", "y1", "x2", "y2")
    return t.join(t.select("image_id", (F.col("idx") - 1).alias("idx"), *[F.col(c).alias("n" + c) for c in ("x1", "y1", "x2", "y2")]), ["image_id", "idx"])


@query("box_pairs", f"{_D} SELECT a.image_id, a.idx, {near_sql(f'{_I} / {_B}')} AS ioa, {near_sql(f'{_I} / least({_A}, {_B})')} AS iom, {near_sql('greatest(0.0, 1 - sqrt(pow((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2, 2) + pow((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2, 2)) / 400)')} AS similarity, least((b.x1 + b.x2) / 2 - a.x1, (b.y1 + b.y2) / 2 - a.y1, a.x2 - (b.x1 + b.x2) / 2, a.y2 - (b.y1 + b.y2) / 2) AS inside {_NEXT}")
def box_pairs(spark, d):
    a, b = B.box(), B.box("n")
    return _next(spark, d).select("image_id", "idx", near(B.ioa(a, b)).alias("ioa"), near(B.iom(a, b)).alias("iom"), near(B.similarity(a, b, 400.0)).alias("similarity"), F.least(*B.point_distances(a, *B.centre(b))).alias("inside"))


@query("normalised_boxes", f"{_D} SELECT image_id, idx, {', '.join(f'{near_sql(f'least(greatest({c} / {n}, 0.0), 1.0)')} AS n{c}' for c, n in (('x1', '320.0::DOUBLE'), ('y1', '240.0::DOUBLE'), ('x2', '320.0::DOUBLE'), ('y2', '240.0::DOUBLE')))} FROM detections")
def normalised_boxes(spark, d):
    return adapted(spark, d, "detections").select("image_id", "idx", *[near(v).alias("n" + c) for c, v in zip(("x1", "y1", "x2", "y2"), B.normalised(B.box(), 320.0, 240.0), strict=True)])


@query("fallback_boxes", "SELECT o_orderkey, 160 AS x, 120 AS y, 320 AS w, 240 AS h FROM orders")
def fallback_boxes(spark, d):
    return table(spark, d, "orders").select("o_orderkey", *[v.alias(c) for c, v in zip("xywh", B.fallback(640.0, 480.0), strict=True)])


@query("edge_boxes", f"{_D} SELECT image_id, idx, (x1 + x2) / 1280 >= 0.025::DOUBLE AND (x1 + x2) / 1280 <= 0.975::DOUBLE AND (y1 + y2) / 960 >= 0.025::DOUBLE AND (y1 + y2) / 960 <= 0.975::DOUBLE AS inside FROM detections")
def edge_boxes(spark, d):
    x, y = B.centre(B.box())
    return adapted(spark, d, "detections").select("image_id", "idx", datasets.without_edges(x / 640, y / 480).alias("inside"))


@query("padded_lists", f"{_D} SELECT image_id, array_to_string(list(category_id ORDER BY idx)[:4], ',') || repeat(',-1', greatest(0, 4 - CAST(count(*) AS INT))) AS categories FROM detections GROUP BY 1")
def padded_lists(spark, d):
    t = adapted(spark, d, "detections").groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "category_id"))), lambda x: x["category_id"]).alias("c"))
    return t.select("image_id", F.array_join(datasets.padded(F.col("c"), 4, F.lit(-1)), ",").alias("categories"))


@query("metric_scores", f"{with_('frames')} SELECT filename, {near_sql('least(greatest((10 - niqe_score / 10) * 10, 0.0), 100.0)')} AS niqe, {near_sql('least(greatest(sharpness_score / (contrast_score + 1e-7::DOUBLE), 0.0), 2.0) / 2')} AS contrast FROM frames WHERE error IS NULL")
def metric_scores(spark, d):
    m = lambda c: F.col(f"metrics.{c}")
    t = adapted(spark, d, "frames").filter("error is null")
    return t.select("filename", near(metrics.niqe_score(m("niqe_score") / 10)).alias("niqe"), near(metrics.contrast(m("contrast_score"), m("sharpness_score"))).alias("contrast"))


@query("session_quality", f"{with_('frames')} SELECT shot_id, {near_sql('count(*) FILTER (mask_area_pct > 1) * 100.0::DOUBLE / count(*)')} AS mask_yield, {near_sql('avg(niqe_score)')} AS niqe, {near_sql('avg(face_sim)')} AS face_sim FROM frames GROUP BY 1")
def session_quality(spark, d):
    t = adapted(spark, d, "frames").groupBy("shot_id").agg(F.count_if(F.col("mask_area_pct") > 1).alias("some"), F.count("*").alias("n"), F.avg("metrics.niqe_score").alias("niqe"), F.avg("face_sim").alias("face_sim"))
    return t.select("shot_id", near(metrics.mask_yield(F.col("some"), F.col("n"))).alias("mask_yield"), near(F.col("niqe")).alias("niqe"), near(F.col("face_sim")).alias("face_sim"))


@query("entropies", f"WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT user_id, sum(n) AS t FROM c GROUP BY 1) SELECT user_id, {near_sql('-sum(n / t * log2(n / t))')} AS entropy FROM (SELECT user_id, CAST(n AS DOUBLE) AS n, CAST(t AS DOUBLE) AS t FROM c JOIN t USING (user_id)) GROUP BY 1")
def entropies(spark, d):
    t = table(spark, d, "events").groupBy("user_id", "event_type").count().groupBy("user_id").agg(F.collect_list("count").alias("counts"))
    return t.select("user_id", near(metrics.entropy(F.col("counts"))).alias("entropy"))


@query("flags", "SELECT event_id, event_type IN ('click', 'purchase') AS flag, 'Sharp ' || event_type AS label FROM events")
def flags(spark, d):
    word = F.when(F.col("event_type") == "click", " Yes ").when(F.col("event_type") == "purchase", "ON").otherwise("off")
    return table(spark, d, "events").select("event_id", text.truthy(word).alias("flag"), text.without_emoji(F.concat(F.lit("✨ Sharp "), "event_type")).alias("label"))


@query("undo_history", "SELECT o_orderkey, CAST(back AS INT) AS back FROM (SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderdate DESC) AS back FROM orders) WHERE back <= 10")
def undo_history(spark, d):
    return scenes.undo(table(spark, d, "orders"), "o_orderdate").select("o_orderkey", "back")


@query("fetched_metrics", f"{with_('frames')} SELECT filename, CAST(frame_num AS FLOAT) AS by_column, CAST(contrast_score AS FLOAT) AS by_definition, CAST(sharpness_score AS FLOAT) AS by_score, CAST(NULL AS FLOAT) AS by_nothing FROM frames")
def fetched_metrics(spark, d):
    t = adapted(spark, d, "frames").withColumn("metrics", F.struct("metrics.*", F.col("metrics.sharpness_score").alias("focus_score")))
    return t.select("filename", *[filters.fetch(t, k).alias(n) for k, n in (("frame_num", "by_column"), ("contrast", "by_definition"), ("focus", "by_score"), ("none", "by_nothing"))])


@query("frame_seed_similarity", f"{with_('frames', 'scenes')} SELECT f.filename, s.seed_face_sim FROM frames f LEFT JOIN scenes s ON f.shot_id = s.shot_id")
def frame_seed_similarity(spark, d):
    seeds = adapted(spark, d, "scenes").select("shot_id", "seed_face_sim")
    return adapted(spark, d, "frames").select("filename", "shot_id").join(seeds, "shot_id", "left").select("filename", "seed_face_sim")
