"""Transform queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import boxes as B
from framelake.operators import evaluation
from framelake.operators import transforms as T
from framelake.plans.adapters import adapted, table, with_
from framelake.plans.quality import _COUNTS
from framelake.plans.registry import near, near_sql, query

_D = with_("detections")


def _out(t, box, *more):
    return t.select("image_id", "idx", *more, *[near(v).alias(n) for n, v in zip(("bx1", "by1", "bx2", "by2"), box, strict=True)])


def _box_sql(a: str, b: str, c: str, d: str) -> str:
    return ", ".join(f"{near_sql(v)} AS b{n}" for v, n in zip((a, b, c, d), ("x1", "y1", "x2", "y2"), strict=True))


@query("box_flip", f"{_D} SELECT image_id, idx, {_box_sql('640 - x2', 'y1', '640 - x1', 'y2')} FROM detections")
def box_flip(spark, d):
    return _out(adapted(spark, d, "detections"), T.flipped(B.box(), F.lit(640.0)))


@query("box_resize", f"{_D} SELECT image_id, idx, {_box_sql('x1 * 0.5::DOUBLE', 'y1 * 1.5::DOUBLE', 'x2 * 0.5::DOUBLE', 'y2 * 1.5::DOUBLE')} FROM detections")
def box_resize(spark, d):
    return _out(adapted(spark, d, "detections"), T.resized(B.box(), F.lit(0.5), F.lit(1.5)))


_C = [f"least(greatest({v} - {o}, 0.0), {m})" for v, o, m in (("x1", 100, 300), ("y1", 80, 200), ("x2", 100, 300), ("y2", 80, 200))]


@query("box_crop", f"{_D} SELECT image_id, idx, {_box_sql(*_C)} FROM detections WHERE {_C[2]} > {_C[0]} AND {_C[3]} > {_C[1]}")
def box_crop(spark, d):
    t = adapted(spark, d, "detections")
    box = T.cropped(B.box(), 100.0, 80.0, 300.0, 200.0)
    return _out(t.filter(T.has_size(box)), box)


_H = "(greatest(x2 - x1, y2 - y1) * 1.2::DOUBLE / 2)"


@query("zoom_window", f"{_D} SELECT image_id, idx, {_box_sql(*[f'least(greatest({c} {s} {_H}, 0.0), {m})' for c, s, m in (('(x1 + x2) / 2', '-', 640), ('(y1 + y2) / 2', '-', 480), ('(x1 + x2) / 2', '+', 640), ('(y1 + y2) / 2', '+', 480))])} FROM detections")
def zoom_window(spark, d):
    return _out(adapted(spark, d, "detections"), T.zoom(B.box(), 0.2, 640.0, 480.0))


@query("keypoint_cells", f"{_D} SELECT image_id, idx, CASE WHEN px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2 THEN CAST(least(floor((px - x1) * 8 / (x2 - x1)), 7) AS INT) END AS i, CASE WHEN px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2 THEN CAST(least(floor((py - y1) * 8 / (y2 - y1)), 7) AS INT) END AS j FROM (SELECT *, x1 + 13 * category_id AS px, y1 + 11 * category_id AS py FROM detections)")
def keypoint_cells(spark, d):
    t = adapted(spark, d, "detections")
    i, j = T.heatmap_cell(F.col("x1") + 13 * F.col("category_id"), F.col("y1") + 11 * F.col("category_id"), B.box(), 8)
    return t.select("image_id", "idx", i.alias("i"), j.alias("j"))


@query("post_process", f"{_D}, r AS (SELECT image_id, conf AS score, x1 / 640 AS cx, y1 / 480 AS cy, 0.1::DOUBLE AS bw, 0.2::DOUBLE AS bh FROM detections) SELECT image_id, score, {near_sql('(cx - bw / 2) * 1280', 4)} AS x1, {near_sql('(cy + bh / 2) * 960', 4)} AS y2 FROM r WHERE score > 0.6")
def post_process(spark, d):
    t = adapted(spark, d, "detections").select("image_id", F.col("conf").alias("score"), (F.col("x1") / 640).alias("cx"), (F.col("y1") / 480).alias("cy"), F.lit(0.1).alias("bw"), F.lit(0.2).alias("bh"), F.lit(1280).alias("width"), F.lit(960).alias("height"))
    return T.scaled_predictions(t, 0.6).select("image_id", "score", near(F.col("x1"), 4).alias("x1"), near(F.col("y2"), 4).alias("y2"))


@query("best_of_masks", f"{_D}, c AS (SELECT image_id AS object_id, idx, conf AS score, CASE WHEN image_id % 2 = 0 THEN 0.0 ELSE x1 END AS iou FROM detections) SELECT object_id, arg_min(idx, (-CASE WHEN m <= 0 THEN score ELSE iou END, idx)) AS idx FROM (SELECT *, max(iou) OVER (PARTITION BY object_id) AS m FROM c) GROUP BY 1")
def best_of_masks(spark, d):
    t = adapted(spark, d, "detections").select(F.col("image_id").alias("object_id"), "idx", F.col("conf").alias("score"), F.when(F.col("image_id") % 2 == 0, 0.0).otherwise(F.col("x1")).alias("iou"))
    return T.best_of_masks(t)


@query("mask_gate", f"{with_('frames')} SELECT filename, CASE WHEN face_sim >= 0.5 THEN phash END AS mask, coalesce(mask_area_pct, 0) < 5 AS empty, CASE WHEN coalesce(mask_area_pct, 0) < 5 THEN 'Empty mask' END AS error FROM frames")
def mask_gate(spark, d):
    empty, error = T.mask_state(F.col("mask_area_pct"), 5.0)
    return adapted(spark, d, "frames").select("filename", T.gated(F.col("phash"), F.col("face_sim"), 0.5).alias("mask"), empty.alias("empty"), error.alias("error"))


@query("top_k_accuracy", f"{_D}, r AS (SELECT image_id, list(category_id ORDER BY conf DESC, idx) AS ranked, image_id % 5 AS label FROM detections GROUP BY 1) SELECT {near_sql('100.0::DOUBLE * avg(CAST(list_contains(ranked[1:1], label) AS INT))')} AS top_1, {near_sql('100.0::DOUBLE * avg(CAST(list_contains(ranked[1:3], label) AS INT))')} AS top_3 FROM r")
def top_k_accuracy(spark, d):
    t = adapted(spark, d, "detections").groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("c"), "idx", "category_id"))), lambda x: x["category_id"]).alias("ranked"))
    out = T.top_k_accuracy(t.withColumn("label", (F.col("image_id") % 5).cast("int")), (1, 3))
    return out.select(near(F.col("top_1")).alias("top_1"), near(F.col("top_3")).alias("top_3"))


@query("segment_scores", f"{_D}, p AS (SELECT category_id, sum(idx) AS i, sum(idx + 3) AS p, sum(idx + 5) AS t FROM detections GROUP BY 1) SELECT category_id, {near_sql('2 * i / (p + t)')} AS dice, {near_sql('i / (p + t - i)')} AS iou FROM p")
def segment_scores(spark, d):
    t = adapted(spark, d, "detections").select("category_id", F.col("idx").alias("both"), (F.col("idx") + 3).alias("predicted"), (F.col("idx") + 5).alias("true"))
    return T.segment_scores(t).select("category_id", near(F.col("dice")).alias("dice"), near(F.col("iou")).alias("iou"))


@query("query_filters", f"{_D}, q AS (SELECT image_id, category_id, count(*) AS n_objects, bool_or(x2 > 600 OR y2 > 400) AS outside FROM detections GROUP BY ALL) SELECT image_id, category_id FROM q WHERE n_objects <= 2 AND NOT outside AND category_id <> 3")
def query_filters(spark, d):
    t = adapted(spark, d, "detections").groupBy("image_id", "category_id").agg(F.count("*").alias("n_objects"), F.collect_list(F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("boxes"))
    t = t.withColumn("text", F.concat(F.lit("class "), "category_id"))
    return t.filter(T.not_too_many(2) & T.valid_geometry(600.0, 400.0) & T.has_area() & T.not_empty() & T.has_text(["Class 3"], keep=False)).select("image_id", "category_id")


@query("worker_reduce", "SELECT event_type, max(m) AS value FROM (SELECT event_type, user_id % 4 AS worker, max(value) AS m FROM events GROUP BY ALL) GROUP BY 1")
def worker_reduce(spark, d):
    parts = T.reduced(table(spark, d, "events").withColumn("worker", F.col("user_id") % 4), ["event_type", "worker"], "max", "value")
    return T.reduced(parts, ["event_type"], "max", "value")


@query("perfect_rates", f"""{_COUNTS}, b AS (SELECT threshold, n_gt > 0 AS pos, CAST(n_dt = tp AND n_gt = tp AS INT) AS good FROM k)
SELECT threshold, avg(good) FILTER (pos) AS perfect_pos, avg(good) FILTER (NOT pos) AS perfect_neg FROM b GROUP BY 1""")
def perfect_rates(spark, d):
    t = adapted(spark, d, "detections")
    return T.perfect_rates(evaluation.match_counts(t.filter("is_gt"), t.filter("not is_gt")))


_LOGITS = "s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i, vec_id % 100 / 100.0::DOUBLE AS told FROM embeddings), x AS (SELECT *, CASE WHEN (i * 5 + vec_id) % 7 < 3 THEN 1.0::DOUBLE ELSE 0.0 END AS t, 1 / (1 + exp(-v)) AS p FROM s)"


@query("mask_losses", f"""WITH {_LOGITS} SELECT vec_id, {near_sql('1 - (2 * sum(p * t) + 1) / (sum(p) + sum(t) + 1)')} AS dice, {near_sql('pow(any_value(told) - count(*) FILTER (v > 0 AND t > 0) / greatest(1.0::DOUBLE, count(*) FILTER (v > 0 OR t > 0)), 2)')} AS iou_loss FROM x GROUP BY 1""")
def mask_losses(spark, d):
    truth = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: ((i * 5 + F.col("vec_id")) % 7 < 3).cast("int"))
    t = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("logits"), truth.alias("truth"), ((F.col("vec_id") % 100).cast("double") / 100).alias("told"))
    return T.mask_losses(t, "logits", "truth", "told").select("vec_id", near(F.col("dice")).alias("dice"), near(F.col("iou_loss")).alias("iou_loss"))


@query("mean_iou", f"{_D}, p AS (SELECT image_id, category_id, floor(conf * 10) AS met, floor(conf * 10) + idx AS either, CASE WHEN idx % 3 = 0 THEN 0 ELSE idx END AS n FROM detections) SELECT category_id, {near_sql('CASE WHEN count(*) FILTER (n > 0) = 0 THEN 1.0::DOUBLE ELSE sum(met / (either + 1e-8::DOUBLE)) / count(*) FILTER (n > 0) END')} AS miou FROM p GROUP BY 1")
def mean_iou(spark, d):
    t = adapted(spark, d, "detections")
    t = t.select("category_id", F.floor(F.col("conf") * 10).alias("met"), (F.floor(F.col("conf") * 10) + F.col("idx")).alias("either"), F.when(F.col("idx") % 3 == 0, 0).otherwise(F.col("idx")).alias("true"))
    return T.mean_iou(t, ["category_id"]).withColumn("miou", near(F.col("miou")))
