"""Queries of masks from prototypes and of keypoints from heatmaps, drawn from supplier keys. Their SQL interpolates cell by cell."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from framelake.operators import resampled
from framelake.operators import runs as R
from framelake.plans.adapters import adapted, table, with_
from framelake.plans.registry import near, near_sql, query

_PLANES, _ROWS, _COLUMNS, _SIDE = 3, 16, 20, 80
_DETS = """SELECT s_suppkey AS image_id, CAST(i AS INT) AS idx, CAST(20 + (s_suppkey * 7 + i * 13) % 40 AS DOUBLE) AS cx, CAST(15 + (s_suppkey * 11 + i * 5) % 45 AS DOUBLE) AS cy,
CAST(12 + (s_suppkey * 3 + i * 7) % 50 AS DOUBLE) AS bw, CAST(10 + (s_suppkey * 5 + i * 3) % 50 AS DOUBLE) AS bh FROM supplier, range(2) AS r(i)"""


def _linear_sql(name: str, n: int, size: int) -> str:
    """Cells of n and their weights for each of size."""
    at = f"((t + 0.5::DOUBLE) * {n} / {size} - 0.5)"
    return f"{name} AS (SELECT t, least(greatest(CAST(floor({at}) AS BIGINT) + k, 0), {n - 1}) AS c, sum(CASE k WHEN 0 THEN 1 - ({at} - floor({at})) ELSE {at} - floor({at}) END) AS w FROM range({size}) a(t), range(2) b(k) GROUP BY ALL)"


@query("prototype_masks", f"""WITH d AS ({_DETS}), s AS (SELECT image_id, idx, y, x, 1 / (1 + exp(-sum(((image_id * 3 + k * 7 + idx) % 9 - 4) / 4.0::DOUBLE * (((image_id * 7 + k * 5 + y * 3 + x * 11 + x * y) % 17 - 8) / 4.0::DOUBLE)))) AS v
FROM d, range({_PLANES}) p(k), range({_ROWS}) a(y), range({_COLUMNS}) b(x) WHERE x >= trunc(greatest(0, (cx - bw / 2) * {_COLUMNS} / {_SIDE})) AND x < trunc(least({_COLUMNS}, (cx + bw / 2) * {_COLUMNS} / {_SIDE})) AND y >= trunc(greatest(0, (cy - bh / 2) * {_ROWS} / {_SIDE})) AND y < trunc(least({_ROWS}, (cy + bh / 2) * {_ROWS} / {_SIDE})) GROUP BY ALL),
{_linear_sql("u", _COLUMNS, 64)}, {_linear_sql("w", _ROWS, 48)},
f AS (SELECT image_id, idx, w.t AS y, u.t AS x FROM s JOIN u ON s.x = u.c JOIN w ON s.y = w.c GROUP BY ALL HAVING sum(v * u.w * w.w) > 0.5)
SELECT image_id, idx, count(*) AS area, CAST(min(x) AS INT) AS x1, CAST(min(y) AS INT) AS y1, CAST(max(x) + 1 AS INT) AS x2, CAST(max(y) + 1 AS INT) AS y2 FROM f GROUP BY ALL""")
def prototype_masks(spark, d):
    """Area and box of the masks that two detections a picture make of its three prototype planes."""
    @F.pandas_udf("binary")
    def planes(key: pd.Series) -> pd.Series:
        k, y, x = np.mgrid[0:_PLANES, 0:_ROWS, 0:_COLUMNS]
        return pd.Series([(((int(s) * 7 + k * 5 + y * 3 + x * 11 + x * y) % 17 - 8) / 4).astype(np.float32).tobytes() for s in key])

    dets = spark.sql(_DETS.replace("FROM supplier", "FROM {supplier}"), supplier=table(spark, d, "supplier"))
    weights = F.transform(F.sequence(F.lit(0), F.lit(_PLANES - 1)), lambda k: ((F.col("image_id") * 3 + k * 7 + F.col("idx")) % 9 - 4) / F.lit(4.0))
    dets = dets.withColumns({"coefficients": weights, "width": F.lit(64), "height": F.lit(48)})
    protos = table(spark, d, "supplier").select(F.col("s_suppkey").alias("image_id"), F.lit(_PLANES).alias("planes"), F.lit(_ROWS).alias("rows"), F.lit(_COLUMNS).alias("columns"), planes("s_suppkey").alias("values"))
    t = resampled.prototype_masks(dets, protos, _SIDE).withColumn("mask", F.struct("image_id", "idx"))
    return R.measured(t, "mask").select("mask.*", "area", "x1", "y1", "x2", "y2")


def _cubic_sql(name: str, n: int, size: int) -> str:
    at = f"((t + 0.5::DOUBLE) * {n} / {size} - 0.5)"
    far = f"abs({at} - floor({at}) - k)"
    weight = f"CASE WHEN {far} <= 1 THEN (1.25::DOUBLE * {far} - 2.25) * {far} * {far} + 1 WHEN {far} < 2 THEN ((-0.75::DOUBLE * {far} + 3.75) * {far} - 6) * {far} + 3 ELSE 0 END"
    return f"{name} AS (SELECT t, least(greatest(CAST(floor({at}) AS BIGINT) + k, 0), {n - 1}) AS c, sum({weight}) AS w FROM range({size}) a(t), range(-1, 3) b(k) GROUP BY ALL)"


@query("heatmap_keypoints", f"""WITH s AS (SELECT s_suppkey AS roi, k AS point, y, x, ((s_suppkey * 37 + k * 101 + (x * 6 + y) * (s_suppkey % 7 + 3) * 19) % 997) / 300.0::DOUBLE AS v FROM supplier, range(3) p(k), range(6) a(y), range(6) b(x)),
{_cubic_sql("u", 6, 13)}, {_cubic_sql("w", 6, 10)}, f AS MATERIALIZED (SELECT roi, point, w.t AS y, u.t AS x, sum(v * u.w * w.w) AS v FROM s JOIN u ON s.x = u.c JOIN w ON s.y = w.c GROUP BY ALL),
m AS (SELECT roi, point, max(v) AS top, arg_max(x, v) AS x, arg_max(y, v) AS y FROM f GROUP BY ALL), e AS (SELECT roi, point, sum(exp(s.v - top)) AS n FROM s JOIN m USING (roi, point) GROUP BY ALL)
SELECT roi, CAST(point AS INT) AS point, {near_sql('5 + (x + 0.5::DOUBLE) * 12.5::DOUBLE / 13')} AS x, {near_sql('roi % 9 + (y + 0.5::DOUBLE) * 9.25::DOUBLE / 10')} AS y, {near_sql('top')} AS logit, {near_sql('1 / n')} AS score FROM m JOIN e USING (roi, point)""")
def heatmap_keypoints(spark, d):
    cell = lambda i: F.floor(((F.col("s_suppkey") * 37 + F.col("point") * 101 + ((i % 6) * 6 + F.floor(i / 6)) * (F.col("s_suppkey") % 7 + 3) * 19) % 997)) / F.lit(300.0)
    t = table(spark, d, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("point"))
    t = t.select(F.col("s_suppkey").alias("roi"), "point", F.lit(6).alias("side"), F.transform(F.sequence(F.lit(0), F.lit(35)), cell).alias("values"), F.lit(5.0).alias("x1"), (F.col("s_suppkey") % 9).cast("double").alias("y1"))
    t = t.withColumns({"x2": F.col("x1") + 12.5, "y2": F.col("y1") + 9.25})
    return resampled.keypoints(t, ["roi", "point"]).select("roi", "point", *[near(F.col(c)).alias(c) for c in ("x", "y", "logit", "score")])


@query("mask_flips", f"""{with_("mask_runs")}, p AS (SELECT mask_id, 639 - x AS x, unnest(range(lo, hi)) AS y FROM mask_runs)
SELECT mask_id, count(*) AS area, CAST(min(x) - 100 AS INT) AS x1, CAST(min(y) - 50 AS INT) AS y1, CAST(max(x) - 99 AS INT) AS x2, CAST(max(y) - 49 AS INT) AS y2 FROM p WHERE x >= 100 AND x < 500 AND y >= 50 AND y < 350 GROUP BY 1""")
def mask_flips(spark, d):
    """Masks mirrored and cut to a part of the frame."""
    t = adapted(spark, d, "mask_runs").select("mask_id", "x", "lo", "hi")
    return R.measured(R.cropped(R.flipped(t, 640, 480), 100, 50, 400, 300))


@query("mask_cut")
def mask_cut(spark, d):
    """Masks cut to their own boxes, 14 cells a side: how many are on."""
    t = adapted(spark, d, "mask_runs").select("mask_id", "x", "lo", "hi")
    return resampled.cut_masks(t, R.measured(t), 14).select("mask_id", F.size(F.filter("mask", lambda v: v)).alias("cells"))


@query("semantic_masks", f"{with_('mask_runs')}, p AS (SELECT DISTINCT mask_id % 5 AS category_id, x, unnest(range(lo, hi)) AS y FROM mask_runs) SELECT category_id, count(*) AS area FROM p GROUP BY 1")
def semantic_masks(spark, d):
    t = adapted(spark, d, "mask_runs").select("mask_id", "x", "lo", "hi")
    groups = table(spark, d, "supplier").select(F.col("s_suppkey").alias("mask_id"), (F.col("s_suppkey") % 5).alias("category_id"))
    return R.measured(R.semantic(t, groups), "category_id").select("category_id", "area")
