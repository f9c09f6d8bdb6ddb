"""Mask queries: boxes as masks of cells, 8 rows of 64, so that their SQL is rectangle arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import masks as M
from framelake.operators import dedup
from framelake.operators import masks as O
from framelake.plans.adapters import adapted, table, with_
from framelake.plans.quality import _best_sql
from framelake.plans.registry import near, near_sql, query
from framelake.plans.tables import _pictures

_C = f"""{with_('detections')}, c AS (SELECT image_id, idx, conf, is_gt, category_id, CAST(floor(x1 / 10) AS INT) AS x1, CAST(floor(y1 / 60) AS INT) AS y1, CAST(floor(x2 / 10) AS INT) AS x2, CAST(floor(y2 / 60) AS INT) AS y2 FROM detections)"""
_RC = _C.replace("WITH ", "WITH RECURSIVE ", 1)
_BOTH = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_A, _B = (f"(greatest(0, {t}.x2 - {t}.x1) * greatest(0, {t}.y2 - {t}.y1))" for t in "ab")
_IOU = f"CAST({_BOTH} AS DOUBLE) / greatest(1, {_A} + {_B} - {_BOTH})"


def _masks(spark, d):
    """Detections with a mask of the cells that their box covers."""
    t = adapted(spark, d, "detections")
    cell = lambda c, n: F.floor(F.col(c) / n).cast("int")
    return t.select("image_id", "idx", "conf", "is_gt", "category_id", M.of_cells(8, cell("x1", 10), cell("y1", 60), cell("x2", 10), cell("y2", 60)).alias("mask"))


def _sides(spark, d):
    t = _masks(spark, d)
    return t.filter("not is_gt"), t.filter("is_gt").select("image_id", F.col("idx").alias("track_id"), "mask")


@query("mask_overlap", f"{_C} SELECT a.image_id, a.idx, b.idx AS other, {near_sql(_IOU)} AS iou, {near_sql(f'{_BOTH} / (least({_A}, {_B}) + 1e-8::DOUBLE)')} AS iom FROM c a JOIN c b ON a.image_id = b.image_id AND a.idx < b.idx")
def mask_overlap(spark, d):
    t = _masks(spark, d)
    b = t.select("image_id", F.col("idx").alias("other"), F.col("mask").alias("m"))
    pairs = t.join(b, "image_id").filter("idx < other")
    return pairs.select("image_id", "idx", "other", near(M.iou(F.col("mask"), F.col("m"))).alias("iou"), near(M.iom(F.col("mask"), F.col("m"))).alias("iom"))


@query("mask_nms", f"""{_RC}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, idx) AS k FROM c WHERE conf > 0.5::DOUBLE),
s AS MATERIALIZED (SELECT b.image_id, b.k, list(a.k) AS earlier FROM o a JOIN o b ON a.image_id = b.image_id AND a.k < b.k AND {_IOU} > 0.2::DOUBLE GROUP BY ALL),
r AS (SELECT image_id, 0::BIGINT AS k, []::BIGINT[] AS kept FROM o GROUP BY 1 UNION ALL
SELECT o.image_id, o.k, CASE WHEN s.earlier IS NOT NULL AND len(list_intersect(r.kept, s.earlier)) > 0 THEN r.kept ELSE list_append(r.kept, o.k) END FROM r JOIN o ON o.image_id = r.image_id AND o.k = r.k + 1 LEFT JOIN s ON s.image_id = o.image_id AND s.k = o.k)
SELECT o.image_id, o.idx, list_contains(r.kept, r.k) AS kept FROM r JOIN o ON o.image_id = r.image_id AND o.k = r.k""")
def mask_nms(spark, d):
    return O.suppress(_masks(spark, d), 0.5, 0.2).select("image_id", "idx", "kept")


@query("mask_new", f"{_C} SELECT b.image_id, b.idx FROM c b LEFT JOIN c a ON a.image_id = b.image_id AND a.is_gt WHERE NOT b.is_gt GROUP BY b.image_id, b.idx, b.conf HAVING max(a.idx) IS NULL OR (max({_IOU}) < 0.5 AND b.conf >= 0.5)")
def mask_new(spark, d):
    return O.new_detections(*_sides(spark, d))


@query("mask_tracks", f"{_C} SELECT b.image_id, b.idx, string_agg(CAST(a.idx AS VARCHAR), ',' ORDER BY a.idx) AS tracks FROM c b JOIN c a ON a.image_id = b.image_id AND a.is_gt AND NOT b.is_gt AND {_IOU} >= 0.3::DOUBLE GROUP BY ALL")
def mask_tracks(spark, d):
    return O.matched_tracks(*_sides(spark, d), match=0.3).select("image_id", "idx", F.array_join("tracks", ",").alias("tracks"))


_ASSIGNED = _RC + ", g AS MATERIALIZED" + _best_sql(0.0, _IOU).split(", g AS MATERIALIZED", 1)[1].replace("FROM detections", "FROM c")


@query("mask_assigned", f"{_ASSIGNED} SELECT image_id, least(n_gt, n_dt) AS pairs, {near_sql('total')} AS total FROM n JOIN m USING (image_id)")
def mask_assigned(spark, d):
    """Which detection an image's best assignment gives each track; of equal assignments any, so the query gives their worth."""
    t = O.assigned(*_sides(spark, d))
    return t.groupBy("image_id").agg(F.count("*").alias("pairs"), near(F.sum(F.col("weighted") / F.col("score"))).alias("total"))


@query("mask_regions", f"{_C} SELECT a.category_id, {near_sql(f'avg(CASE WHEN {_A} = 0 AND (b.idx IS NULL OR {_B} = 0) THEN 1.0::DOUBLE WHEN b.idx IS NULL THEN 0.0 ELSE {_IOU} END)')} AS j FROM c a LEFT JOIN c b ON a.image_id = b.image_id AND b.idx = a.idx + 1 GROUP BY 1")
def mask_regions(spark, d):
    t = _masks(spark, d)
    b = t.select("image_id", (F.col("idx") - 1).alias("idx"), F.col("mask").alias("m"))
    return O.region_scores(t.join(b, ["image_id", "idx"], "left"), "category_id", F.col("mask"), F.col("m")).select("category_id", near(F.col("j")).alias("j"))


_BITS = "CAST((p_partkey * 7 + i * i) % 5 < 2 AS INT)"


@query("mask_runs", f"""WITH b AS (SELECT p_partkey, i, {_BITS} AS v FROM part, range(70) r(i)), g AS (SELECT *, i - row_number() OVER (PARTITION BY p_partkey, v ORDER BY i) AS g FROM b),
u AS (SELECT p_partkey, v, min(i) AS s, count(*) AS n FROM g GROUP BY p_partkey, v, g), f AS (SELECT p_partkey, arg_min(v, s) AS first, string_agg(CAST(n AS VARCHAR), ',' ORDER BY s) AS runs FROM u GROUP BY 1),
w AS (SELECT p_partkey, sum(v) AS area FROM b GROUP BY 1) SELECT p_partkey, CASE WHEN first = 1 THEN '0,' || runs ELSE runs END AS runs, CAST(area AS BIGINT) AS area FROM f JOIN w USING (p_partkey)""")
def mask_runs(spark, d):
    on = F.transform(F.sequence(F.lit(0), F.lit(69)), lambda i: ((F.col("p_partkey") * 7 + i * i) % 5 < 2).cast("int"))
    # A key of some bytes is much work: as many tasks as shuffles have.
    t = table(spark, d, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey").select("p_partkey", on.alias("on"))
    return t.select("p_partkey", F.array_join(M.runs(F.col("on")), ",").alias("runs"), M.area(M.packed(F.col("on"))).alias("area"))


@query("polygon_areas", f"{with_('detections')} SELECT image_id, idx, abs(x1 * y1 - x2 * y1 + x2 * y2 - (x2 + 5) * y1 + (x2 + 5) * (y2 + 9) - x2 * y2 + x2 * y2 - x1 * (y2 + 9) + x1 * y1 - x1 * y2) / 2 AS area FROM detections")
def polygon_areas(spark, d):
    p = lambda x, y: F.array(x, y)
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    return adapted(spark, d, "detections").select("image_id", "idx", M.polygon_area(F.array(p(x1, y1), p(x2, y1), p(x2 + 5, y2), p(x2, y2 + 9), p(x1, y2))).alias("area"))


_SSIM = f"""WITH p AS MATERIALIZED (SELECT p_partkey AS k, r, c, (p_partkey * 7 + r * 13 + c * 29 + r * c) % 256 AS v FROM part, range(16) a(r), range(16) b(c)), n AS (SELECT k, lag(k) OVER (ORDER BY k) AS k0 FROM (SELECT DISTINCT k FROM p)),
x AS MATERIALIZED (SELECT n.k, a.r, a.c, a.v, b.v AS u FROM n JOIN p a ON a.k = n.k JOIN p b ON b.k = n.k0 AND b.r = a.r AND b.c = a.c),
h AS MATERIALIZED (SELECT k, r, s, sum(v) AS v, sum(u) AS u, sum(v * v) AS vv, sum(u * u) AS uu, sum(v * u) AS vu FROM x JOIN range(10) t(s) ON c >= s AND c < s + 7 GROUP BY ALL),
w AS (SELECT k, q, s, sum(v) / 49.0::DOUBLE AS v, sum(u) / 49.0::DOUBLE AS u, sum(vv) / 49.0::DOUBLE AS vv, sum(uu) / 49.0::DOUBLE AS uu, sum(vu) / 49.0::DOUBLE AS vu FROM h JOIN range(10) t(q) ON r >= q AND r < q + 7 GROUP BY ALL),
y AS (SELECT k, avg((2 * v * u + 6.5025::DOUBLE) * (2 * (vu - v * u) * 49 / 48 + 58.5225::DOUBLE) / ((v * v + u * u + 6.5025::DOUBLE) * ((vv - v * v + uu - u * u) * 49 / 48 + 58.5225::DOUBLE))) AS ssim FROM w GROUP BY 1),
z AS (SELECT n.k, n.k * 7 % 101 AS q, coalesce(ssim, 0) >= 0.6 AS alike, lag(n.k * 7 % 101) OVER o AS before, lead(n.k * 7 % 101) OVER o AS after, lead(coalesce(ssim, 0) >= 0.6) OVER o AS next FROM n LEFT JOIN y USING (k) WINDOW o AS (ORDER BY n.k))
SELECT printf('frame_%09d', k) AS filename, NOT ((alike AND q <= before) OR (coalesce(next, false) AND after > q)) AS kept FROM z"""


@query("dedup_ssim", _SSIM)
def dedup_ssim(spark, d):
    t = _pictures(spark, d).select(F.format_string("frame_%09d", "p_partkey").alias("filename"), "image", (F.col("p_partkey") * 7 % 101).cast("double").alias("quality"))
    return dedup.dispatch(t, "Balanced (SSIM)", least=0.6).select("filename", "kept")


@query("dedup_none", f"{with_('hashes')} SELECT filename, true AS kept FROM hashes")
def dedup_none(spark, d):
    return dedup.dispatch(adapted(spark, d, "hashes"), "None").select("filename", "kept")
