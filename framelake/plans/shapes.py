"""Queries of masks as runs: ellipses in frames of 640 by 480, some with holes or a speck; and of scenes in drawn frames. Their SQL counts pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from framelake.functions import mask_text
from framelake.operators import contours as C
from framelake.operators import runs as R
from framelake.operators import scenes
from framelake.operators.seeds import aspect_ratios
from framelake.plans.adapters import adapted, table, with_
from framelake.plans.registry import near, near_sql, query
from framelake.session import keep

W, H = 640, 480
_RUNS = with_("mask_runs")
_P = f"{_RUNS}, p AS MATERIALIZED (SELECT mask_id, image_id, x, unnest(range(lo, hi)) AS y FROM mask_runs)"


def _runs(spark, d):
    return adapted(spark, d, "mask_runs").select("mask_id", "x", "lo", "hi")


def _masks(spark, d):
    return table(spark, d, "supplier").select(F.floor(F.col("s_suppkey") / 4).alias("image_id"), F.col("s_suppkey").alias("mask_id"))


@query("mask_algebra", f"""{_P}, q AS (SELECT mask_id, x + 3 AS x, y - 2 AS y FROM p), b AS (SELECT coalesce(p.mask_id, q.mask_id) AS mask_id, p.x IS NOT NULL AS a, q.x IS NOT NULL AS b FROM p FULL JOIN q ON p.mask_id = q.mask_id AND p.x = q.x AND p.y = q.y)
SELECT mask_id, count(*) FILTER (a AND b) AS met, count(*) AS either, count(*) FILTER (a AND NOT b) AS rest, count(*) FILTER (a <> b) AS unlike FROM b GROUP BY 1""")
def mask_algebra(spark, d):
    a = _runs(spark, d)
    b, out = R.shifted(a, 3, -2), None
    for name, f in (("met", R.both), ("either", R.either), ("rest", R.minus), ("unlike", R.unlike)):
        t = R.measured(f(a, b)).select("mask_id", F.col("area").alias(name))
        out = t if out is None else out.join(t, "mask_id", "left")
    return out.fillna(0)


@query("mask_boxes", f"{_P} SELECT mask_id, count(*) AS area, min(x) AS x1, CAST(min(y) AS INT) AS y1, max(x) + 1 AS x2, CAST(max(y) + 1 AS INT) AS y2 FROM p GROUP BY 1")
def mask_boxes(spark, d):
    return R.measured(_runs(spark, d))


@query("mask_pairs", f"""{_P}, n AS (SELECT mask_id, count(*) AS n FROM p GROUP BY 1), m AS (SELECT a.image_id, a.mask_id AS a, b.mask_id AS b, count(*) AS met FROM p a JOIN p b ON a.image_id = b.image_id AND a.x = b.x AND a.y = b.y AND a.mask_id < b.mask_id GROUP BY ALL)
SELECT image_id, a, b, {near_sql('met::DOUBLE / (u.n + v.n - met)')} AS iou FROM m JOIN n u ON a = u.mask_id JOIN n v ON b = v.mask_id WHERE met::DOUBLE / (u.n + v.n - met) > 0.05""")
def mask_pairs(spark, d):
    return R.overlaps(_masks(spark, d), _runs(spark, d), 0.05).withColumn("iou", near(F.col("iou")))


@query("mask_text", f"""{_P}, f AS (SELECT mask_id, x * {H} + y AS spot, x * {H} + y - row_number() OVER (PARTITION BY mask_id ORDER BY x, y) AS g FROM p), e AS (SELECT mask_id, min(spot) AS lo, max(spot) + 1 AS hi FROM f GROUP BY mask_id, g),
v AS (SELECT mask_id, lo AS y FROM e UNION ALL SELECT mask_id, hi FROM e UNION ALL SELECT mask_id, {W * H} FROM e GROUP BY mask_id HAVING max(hi) < {W * H}),
c AS (SELECT mask_id, y - coalesce(lag(y) OVER w, 0) AS n, row_number() OVER w - 1 AS i FROM v WINDOW w AS (PARTITION BY mask_id ORDER BY y)),
d AS (SELECT mask_id, i, n - CASE WHEN i > 2 THEN lag(n, 2) OVER (PARTITION BY mask_id ORDER BY i) ELSE 0 END AS v FROM c),
s AS (SELECT *, 1 + list_sum(list_transform(range(1, 7), lambda k: CASE WHEN v < -(16 * 32 ** (k - 1)) OR v >= 16 * 32 ** (k - 1) THEN 1 ELSE 0 END)) AS groups FROM d),
t AS (SELECT mask_id, i, list_aggregate(list_transform(range(CAST(groups AS BIGINT)), lambda g: chr(CAST(48 + ((CAST(floor(v / 32.0 ** g) AS BIGINT) % 32) + 32) % 32 + CASE WHEN g + 1 < groups THEN 32 ELSE 0 END AS INT))), 'string_agg', '') AS part FROM s)
SELECT mask_id, string_agg(part, '' ORDER BY i) AS text FROM t GROUP BY 1""")
def mask_text_form(spark, d):
    return R.counts(_runs(spark, d), W, H).select("mask_id", mask_text.to_text(F.col("counts")).alias("text"))


@query("mask_text_back", f"{_P} SELECT mask_id, count(*) AS area, CAST(sum(x * 7 + y) AS BIGINT) AS mark FROM p GROUP BY 1")
def mask_text_back(spark, d):
    """Masks to text, back to runs, and what they cover."""
    t = mask_text_form(spark, d).select("mask_id", mask_text.from_text("text").alias("counts"))
    n = F.col("hi") - F.col("lo")
    mark = F.col("x") * 7 * n + (F.col("lo") + F.col("hi") - 1) * n / 2
    return R.from_counts(t, H).groupBy("mask_id").agg(F.sum(n).cast("long").alias("area"), F.sum(mark.cast("long")).alias("mark"))


_ELLIPSE = "o AS (SELECT i AS dx, j AS dy FROM range(-2, 3) a(i), range(-2, 3) b(j) WHERE abs(i) <= CASE abs(j) WHEN 2 THEN 0 ELSE 2 END)"


@query("mask_closed", f"""{_P}, {_ELLIPSE}, g AS MATERIALIZED (SELECT DISTINCT mask_id, x + dx AS x, y + dy AS y FROM p, o), b AS (SELECT DISTINCT e.mask_id, e.x, e.y FROM (SELECT mask_id, g.x, g.y, g.x + dx AS nx, g.y + dy AS ny FROM g, o) e LEFT JOIN g ON g.mask_id = e.mask_id AND g.x = nx AND g.y = ny WHERE g.x IS NULL)
SELECT mask_id, count(*) AS area, CAST(sum(g.x * 7 + g.y) AS BIGINT) AS mark FROM g ANTI JOIN b USING (mask_id, x, y) GROUP BY 1""")
def mask_closed(spark, d):
    n = F.col("hi") - F.col("lo")
    mark = F.col("x") * 7 * n + (F.col("lo") + F.col("hi") - 1) * n / 2
    return R.closed(_runs(spark, d), R.ellipse(5), W, H).groupBy("mask_id").agg(F.sum(n).cast("long").alias("area"), F.sum(mark.cast("long")).alias("mark"))


@query("mask_parts", f"{_P}, s AS (SELECT mask_id, count(*) AS n FROM p GROUP BY 1) SELECT mask_id, CASE WHEN mask_id % 2 = 0 THEN 2 ELSE 1 END AS parts, n - CASE WHEN mask_id % 2 = 0 THEN 9 ELSE 0 END AS largest FROM s")
def mask_parts(spark, d):
    t = _runs(spark, d)
    parts = R.parted(t).groupBy("mask_id").agg(F.count_distinct("part").cast("int").alias("parts"))
    return parts.join(R.measured(R.largest(t)).select("mask_id", F.col("area").alias("largest")), "mask_id")


@query("mask_filled", f"{_P}, s AS (SELECT mask_id, count(*) AS n FROM p GROUP BY 1) SELECT mask_id, n - CASE WHEN mask_id % 2 = 0 THEN 9 ELSE 0 END + CASE WHEN mask_id % 3 = 1 THEN 13 ELSE 0 END AS area FROM s")
def mask_filled(spark, d):
    return R.measured(R.filled(_runs(spark, d), 30, W, H)).select("mask_id", "area")


@query("mask_boundaries", f"""{_P}, n AS (SELECT mask_id, x + dx AS x, y + dy AS y FROM p, (VALUES (0, 0), (-1, 0), (0, -1), (-1, -1)) s(dx, dy)), b AS MATERIALIZED (SELECT mask_id, any_value(m.image_id) AS image_id, x, y FROM n JOIN (SELECT DISTINCT mask_id, image_id FROM p) m USING (mask_id) GROUP BY mask_id, x, y HAVING count(*) < 4),
g AS MATERIALIZED (SELECT DISTINCT mask_id, image_id, x + i AS x, y + j AS y FROM b, range(-2, 3) s(i), range(-2, 3) t(j)), c AS (SELECT mask_id, count(*) AS n FROM b GROUP BY 1), pairs AS (SELECT a.mask_id AS gt_id, b.mask_id AS dt_id FROM c a JOIN c b ON floor(a.mask_id / 4) = floor(b.mask_id / 4) AND a.mask_id < b.mask_id),
k AS (SELECT b.mask_id AS own, g.mask_id AS other, count(*) AS met FROM b JOIN g ON b.image_id = g.image_id AND b.mask_id <> g.mask_id AND b.x = g.x AND b.y = g.y GROUP BY ALL),
r AS (SELECT gt_id, dt_id, coalesce(u.met, 0) / s.n::DOUBLE AS recall, coalesce(v.met, 0) / t.n::DOUBLE AS precision FROM pairs JOIN c s ON s.mask_id = gt_id JOIN c t ON t.mask_id = dt_id LEFT JOIN k u ON u.own = gt_id AND u.other = dt_id LEFT JOIN k v ON v.own = dt_id AND v.other = gt_id)
SELECT gt_id, dt_id, {near_sql('CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END')} AS f FROM r""")
def mask_boundaries(spark, d):
    """F of the boundaries of every two masks of an image."""
    m = _masks(spark, d)
    pairs = m.withColumnRenamed("mask_id", "gt_id").join(m.withColumnRenamed("mask_id", "dt_id"), "image_id").filter("gt_id < dt_id").select("gt_id", "dt_id")
    t = _runs(spark, d)
    return R.boundary_scores(pairs, t, t, 2, W, H).withColumn("f", near(F.col("f")))


@query("mask_contours", f"""{_P}, s AS (SELECT mask_id, count(*) AS area FROM p GROUP BY 1), n AS (SELECT mask_id, count(*) AS near FROM (SELECT a.mask_id FROM p a JOIN p b ON a.mask_id = b.mask_id AND b.x = a.x + 1 AND b.y = a.y UNION ALL SELECT a.mask_id FROM p a JOIN p b ON a.mask_id = b.mask_id AND b.x = a.x AND b.y = a.y + 1) GROUP BY 1)
SELECT mask_id, CASE WHEN mask_id % 2 = 0 THEN 2 ELSE 1 END AS outer_borders, CASE WHEN mask_id % 3 < 2 THEN 1 ELSE 0 END AS holes, area::DOUBLE AS area, 4 * area - 2 * near AS edges, area AS again FROM s JOIN n USING (mask_id)""")
def mask_contours(spark, d):
    """Borders of each mask, what they enclose, and the area of the mask that their corners give back."""
    b = keep(C.contours(_runs(spark, d)))
    t = b.groupBy("mask_id").agg(F.count_if(~F.col("hole")).cast("int").alias("outer_borders"), F.count_if("hole").cast("int").alias("holes"), F.sum("area").alias("area"), F.sum("edges").alias("edges"))
    return t.join(R.measured(C.from_corners(b)).select("mask_id", F.col("area").alias("again")), "mask_id")


@query("mask_polygons")
def mask_polygons(spark, d):
    t = C.polygons(C.contours(_runs(spark, d)))
    return t.select("mask_id", F.to_json("polygons").alias("polygons"), "has_holes")


@query("mask_centres")
def mask_centres(spark, d):
    return C.centres(_runs(spark, d), 2)


@query("mask_points", f"""{_P}, k AS (SELECT *, row_number() OVER (PARTITION BY mask_id ORDER BY x, y) - 1 AS spot, count(*) OVER (PARTITION BY mask_id) AS n FROM p), a AS (SELECT mask_id, place, CAST(floor(('0x' || substr(md5('5:' || mask_id || ':' || place), 1, 13))::BIGINT / 4503599627370496::DOUBLE * n) AS BIGINT) AS spot FROM (SELECT DISTINCT mask_id, n FROM k), range(8) r(place))
SELECT mask_id, CAST(place AS INT) AS place, x, CAST(y AS INT) AS y FROM a JOIN k USING (mask_id, spot)""")
def mask_points(spark, d):
    return C.random_points(_runs(spark, d), 8, 5)


@query("mask_error_centres")
def mask_error_centres(spark, d):
    """Where to click next when a mask was found three columns too far to the right."""
    t = _runs(spark, d)
    return C.error_centres(t, R.clipped(R.shifted(t, 3, 0), W, H))


_RATIOS = "1:1, 16:9, 2:1"
_BOX = "s_suppkey % 20 AS x, s_suppkey % 15 AS y, 5 + s_suppkey * 3 % 40 AS w, 4 + s_suppkey * 5 % 30 AS h"


def _drawn(spark, d):
    """Gray pictures of 64 by 48 from supplier keys."""

    @F.pandas_udf("binary")
    def draw(key: pd.Series) -> pd.Series:
        r, c = np.mgrid[0:48, 0:64]
        return pd.Series([((int(k) * 7 + r * 13 + c * 29 + r * c) % 256).astype(np.uint8).tobytes() for k in key])

    pic = F.struct(F.lit(48).alias("height"), F.lit(64).alias("width"), F.lit(1).alias("nChannels"), draw("s_suppkey").alias("data"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("mask_id"), pic.alias("image"))


@query("crop_apply", f"""WITH s AS (SELECT s_suppkey AS mask_id, 64::DOUBLE AS fw, 48::DOUBLE AS fh, {_BOX} FROM supplier), r AS (SELECT * FROM (VALUES ('1:1', 1::DOUBLE, 0), ('16:9', 16::DOUBLE / 9, 1), ('2:1', 2::DOUBLE, 2)) t(ratio, r, i)),
g AS (SELECT *, least(greatest(least(greatest(w, h * r) * 1.1::DOUBLE, least(fw, fh * r)), greatest(w, h * r)), least(fw, fh * r)) AS gw, least(greatest(least(greatest(h, w / r) * 1.1::DOUBLE, least(fh, fw / r)), greatest(h, w / r)), least(fh, fw / r)) AS gh FROM s, r),
c AS (SELECT *, greatest(0.0, least(x + w / 2 - gw / 2, fw - gw)) AS cx, greatest(0.0, least(y + h / 2 - gh / 2, fh - gh)) AS cy FROM g),
k AS (SELECT mask_id, ratio, trunc(cx)::INT AS cx, trunc(cy)::INT AS cy, trunc(gw)::INT AS gw, trunc(gh)::INT AS gh, row_number() OVER (PARTITION BY mask_id ORDER BY gw * gh, abs(trunc(gw) / trunc(gh) - w / h), i) AS k FROM c WHERE cx <= x AND cy <= y AND cx + gw >= x + w AND cy + gh >= y + h),
b AS (SELECT mask_id, coalesce(ratio, 'native') AS ratio, coalesce(cx, x) AS x, coalesce(cy, y) AS y, coalesce(gw, w) AS w, coalesce(gh, h) AS h FROM s LEFT JOIN (SELECT * FROM k WHERE k = 1) USING (mask_id))
SELECT mask_id, any_value(ratio) AS ratio, CAST(any_value(w) AS INT) AS width, CAST(any_value(h) AS INT) AS height, CAST(sum((mask_id * 7 + j * 13 + i * 29 + j * i) % 256) AS BIGINT) AS total FROM b, range(64) a(i), range(48) e(j) WHERE i >= x AND i < x + w AND j >= y AND j < y + h GROUP BY 1""")
def crop_apply(spark, d):
    box = table(spark, d, "supplier").selectExpr("s_suppkey AS mask_id", *_BOX.split(", "))
    rows = box.select("mask_id", F.explode(F.sequence(F.col("x").cast("int"), (F.col("x") + F.col("w") - 1).cast("int"))).alias("x"), F.col("y").cast("int").alias("lo"), (F.col("y") + F.col("h")).cast("int").alias("hi"))
    t = C.crop_apply(_drawn(spark, d), rows, aspect_ratios(_RATIOS), 1.1)

    @F.pandas_udf("long")
    def total(data: pd.Series) -> pd.Series:
        return pd.Series([int(np.frombuffer(x, np.uint8).sum(dtype=np.int64)) for x in data])

    return t.select("mask_id", "ratio", "crop.width", "crop.height", total("crop.data").alias("total"))


_FILM = f"""WITH RECURSIVE q AS (SELECT p_partkey % 3 AS video, CAST(floor(p_partkey / 3.0) AS BIGINT) AS n, (CAST(floor(p_partkey / 3.0) AS BIGINT) // 6 * 83 + r * 3 + c * 5) % 256 AS b, (CAST(floor(p_partkey / 3.0) AS BIGINT) // 6 * 29 + r * 7 + c) % 256 AS g, (p_partkey + r + c * 2) % 256 AS d FROM part, range(6) s(r), range(8) t(c)),
m AS (SELECT *, greatest(b, g, d) AS v, greatest(b, g, d) - least(b, g, d) AS w FROM q), h AS (SELECT video, n, v, (w * CAST(round(1044480.0 / greatest(v, 1)) AS BIGINT) + 2048) >> 12 AS s, CASE WHEN v = d THEN g - b WHEN v = g THEN b - d + 2 * w ELSE d - g + 4 * w END * CAST(round(122880.0 / greatest(w, 1)) AS BIGINT) + 2048 AS hue, row_number() OVER (PARTITION BY video, n ORDER BY 0) AS i FROM m),
k AS (SELECT video, n, i, v, s, CAST(floor(hue / 4096.0) AS BIGINT) + CASE WHEN hue < 0 THEN 180 ELSE 0 END AS hue FROM h)"""


def _film(spark, d):
    """Frames of three videos, 8 by 6 pixels in colour; the colours jump every six frames."""

    @F.pandas_udf("binary")
    def draw(key: pd.Series) -> pd.Series:
        r, c = np.mgrid[0:6, 0:8]
        out = []
        for p in key.tolist():
            shot = p // 3 // 6
            out.append(np.stack([shot * 83 + r * 3 + c * 5, shot * 29 + r * 7 + c, p + r + c * 2], 2).__mod__(256).astype(np.uint8).tobytes())
        return pd.Series(out)

    pic = F.struct(F.lit(6).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("nChannels"), draw("p_partkey").alias("data"))
    # A key of some bytes is much work: as many tasks as shuffles have.
    parts = table(spark, d, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return parts.select((F.col("p_partkey") % 3).alias("video"), F.floor(F.col("p_partkey") / 3).alias("n"), pic.alias("image"))


_CONTENT = _FILM.replace("row_number() OVER (PARTITION BY video, n ORDER BY 0) AS i", "i").replace("AS b, (CAST", "AS b, r * 8 + c AS i, (CAST", 1) + """, z AS (SELECT a.video, a.n, (avg(abs(a.hue - b.hue)) + avg(abs(a.s - b.s)) + avg(abs(a.v - b.v))) / 3 AS content FROM k a JOIN k b ON a.video = b.video AND b.n = a.n - 1 AND a.i = b.i GROUP BY ALL),
y AS MATERIALIZED (SELECT DISTINCT q.video, q.n, coalesce(content, 0.0) AS content FROM q LEFT JOIN z USING (video, n))"""


@query("content_scores", f"{_CONTENT} SELECT video, n, {near_sql('content')} AS content FROM y")
def content_scores(spark, d):
    return scenes.content_scores(_film(spark, d), "n", "video").withColumn("content", near(F.col("content")))


@query("shots_from_pixels", f"""{_CONTENT}, e AS (SELECT video, min(n) AS first, max(n) + 1 AS last FROM y GROUP BY 1), o AS (SELECT video, 0 AS shot_id, first AS start FROM e UNION ALL
SELECT o.video, o.shot_id + 1, (SELECT min(y.n) FROM y WHERE y.video = o.video AND content >= 20 AND y.n >= o.start + 10) FROM o WHERE EXISTS (SELECT 1 FROM y WHERE y.video = o.video AND content >= 20 AND y.n >= o.start + 10))
SELECT video, shot_id, start, coalesce(lead(start) OVER (PARTITION BY video ORDER BY shot_id), last) AS "end" FROM o JOIN e USING (video)""")
def shots_from_pixels(spark, d):
    return scenes.cuts(scenes.content_scores(_film(spark, d), "n", "video"), "n", "video", 20.0, 10)
