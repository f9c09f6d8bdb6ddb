"""Matching and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.operators import evaluation as E
from framelake.operators import matching as M
from framelake.operators import training
from framelake.plans.adapters import adapted, table, with_
from framelake.plans.registry import near, near_sql, query
from framelake.session import keep

_D, _T = with_("detections"), with_("tracks")


def _sides(spark, d):
    t = adapted(spark, d, "detections")
    return t.filter("is_gt"), t.filter("not is_gt")


def _rated(spark, d):
    """Both sides with areas in shares of a 600 x 500 image; some truths are crowds."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) / 300000.0
    gt, dt = (x.withColumn("area", area) for x in _sides(spark, d))
    return gt.withColumn("crowd", (F.col("image_id") + F.col("idx")) % 11 == 0), dt


def _truth(spark, d):
    """Tracks as truth, and detections that follow them with drops, drift and swapped ids."""
    t = adapted(spark, d, "tracks")
    gt = t.select("video_id", F.col("frame").alias("t"), F.col("track_id").alias("gt_id"), "category_id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    drift = (F.col("t") % 5).cast("double")
    swapped = F.when(F.col("t") >= 12, F.col("gt_id") + 1000).otherwise(F.col("gt_id"))
    dt = gt.filter("(t + gt_id) % 6 <> 0").select("video_id", "t", swapped.alias("trk_id"), F.when(F.col("gt_id") % 9 == 0, 0).otherwise(F.col("category_id")).cast("int").alias("category_id"), (F.col("x1") + drift).alias("x1"), "y1", (F.col("x2") + drift).alias("x2"), "y2")
    return gt, dt


def _greedy(box: str, overlap: str, group: str = "image_id", order: str = "conf DESC, idx") -> str:
    """Rows of o with k, their turn in the group, and kept: not overlapped by one kept before. box: CTEs that end in o
    without k; overlap: a condition on an earlier row a and a later one b."""
    return f"""{box}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS k FROM o1),
s AS MATERIALIZED (SELECT b.{group}, b.k, list(a.k) AS earlier FROM o a JOIN o b ON a.{group} = b.{group} AND a.k < b.k AND {overlap} GROUP BY ALL),
r AS (SELECT {group}, 0::BIGINT AS k, []::BIGINT[] AS kept FROM o GROUP BY 1 UNION ALL
SELECT o.{group}, o.k, CASE WHEN s.earlier IS NOT NULL AND len(list_intersect(r.kept, s.earlier)) > 0 THEN r.kept ELSE list_append(r.kept, o.k) END
FROM r JOIN o ON o.{group} = r.{group} AND o.k = r.k + 1 LEFT JOIN s ON s.{group} = o.{group} AND s.k = o.k)"""


_RD, _RT = (x.replace("WITH ", "WITH RECURSIVE ", 1) for x in (_D, _T))
_I = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0.0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0.0)"
_A, _B = (f"(({t}.x2 - {t}.x1) * ({t}.y2 - {t}.y1))" for t in "ab")
_KEPT = "SELECT o.image_id, o.idx, list_contains(r.kept, r.k) AS kept FROM r JOIN o ON o.image_id = r.image_id AND o.k = r.k"


@query("nms_frame", f"{_greedy(f'{_RD}, o1 AS (SELECT * FROM detections WHERE x2 > x1 AND y2 > y1)', f'{_I} / ({_A} + {_B} - {_I}) >= 0.5')} {_KEPT}")
def nms_frame(spark, d):
    t = adapted(spark, d, "detections").select("image_id", "idx", "x1", "y1", "x2", "y2", "conf")
    return M.suppress(t, 0.5, ["image_id"]).select("image_id", "idx", "kept")


@query("iom_overlap_removal", f"{_greedy(f'{_RD}, o1 AS (SELECT * FROM detections)', f'{_I} / least({_A}, {_B}) > 0.3::DOUBLE')} {_KEPT}")
def iom_overlap_removal(spark, d):
    t = adapted(spark, d, "detections").select("image_id", "idx", "x1", "y1", "x2", "y2", "conf")
    return M.drop_contained(t, ["image_id"], 0.3).select("image_id", "idx", "kept")


_OVER = f"""{_T}, p AS (SELECT a.video_id, a.track_id AS a, b.track_id AS b, greatest(0.0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0.0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i, a.w * a.h + b.w * b.h AS s
FROM tracks a JOIN tracks b ON a.video_id = b.video_id AND a.frame = b.frame AND a.track_id < b.track_id)"""


@query("track_overlap", f"{_OVER} SELECT video_id, a, b, {near_sql('sum(i) / sum(s - i)')} AS iou FROM p GROUP BY ALL")
def track_overlap(spark, d):
    return M.overlap_over_time(adapted(spark, d, "tracks")).select("video_id", "a", "b", near(F.col("iou")).alias("iou"))


_NEAR = f"""{_OVER.replace("WITH ", "WITH RECURSIVE ", 1)}, v AS (SELECT video_id, a, b FROM p GROUP BY ALL HAVING sum(i) / sum(s - i) >= 0.1::DOUBLE), n AS (SELECT video_id, a, b FROM v UNION ALL SELECT video_id, b, a FROM v),
o1 AS (SELECT video_id, track_id, max(score) AS score FROM tracks GROUP BY ALL)"""
_TRACKS = _greedy(_NEAR, "EXISTS (SELECT 1 FROM n WHERE n.video_id = a.video_id AND n.a = a.track_id AND n.b = b.track_id)", "video_id", "score DESC, track_id")


@query("nms_track", f"{_TRACKS} SELECT o.video_id, o.track_id, list_contains(r.kept, r.k) AS kept FROM r JOIN o ON o.video_id = r.video_id AND o.k = r.k")
def nms_track(spark, d):
    return M.suppress_tracks(adapted(spark, d, "tracks"), 0.1).select("video_id", "track_id", "kept")


@query("associate", f"""{_D}, m AS (SELECT b.image_id, b.idx, coalesce(max({_I} / ({_A} + {_B} - {_I})), 0.0) AS iou FROM detections b LEFT JOIN detections a ON a.image_id = b.image_id AND a.is_gt WHERE NOT b.is_gt GROUP BY ALL)
SELECT image_id, idx, iou < 0.1::DOUBLE AS is_new, {near_sql('iou')} AS iou FROM m""")
def associate(spark, d):
    gt, dt = _sides(spark, d)
    tracks = gt.select("image_id", F.col("idx").cast("long").alias("track_id"), "x1", "y1", "x2", "y2")
    return M.associate(dt.select("image_id", "idx", "x1", "y1", "x2", "y2"), tracks, "image_id").select("image_id", "idx", "is_new", near(F.col("iou")).alias("iou"))


@query("repeated_ids", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_ids(spark, d):
    return M.repeated_ids(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("global_track_ids", f"{_T} SELECT DISTINCT video_id, track_id, dense_rank() OVER (ORDER BY video_id, track_id) - 1 AS global_id FROM tracks")
def global_track_ids(spark, d):
    return M.global_track_ids(adapted(spark, d, "tracks")).select("video_id", "track_id", "global_id").distinct()


def _best_sql(least: float, score: str) -> str:
    """Every way to give an image's truths detections of their own, and the one with the greatest total."""
    return f"""{_D.replace("WITH ", "WITH RECURSIVE ", 1)}, g AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY idx) AS i FROM detections WHERE is_gt), e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY idx) AS j FROM detections WHERE NOT is_gt AND conf >= {least}),
n AS MATERIALIZED (SELECT image_id, count(*) FILTER (is_gt) AS n_gt, count(*) FILTER (NOT is_gt AND conf >= {least}) AS n_dt FROM detections GROUP BY 1),
o AS MATERIALIZED (SELECT * FROM (SELECT image_id, a.i, b.j, {score} AS iou FROM g a JOIN e b USING (image_id)) WHERE iou > 0 UNION ALL SELECT image_id, i, 0, 0.0 FROM g),
r AS (SELECT image_id, 0::BIGINT AS i, []::BIGINT[] AS used, 0.0::DOUBLE AS total, []::DOUBLE[] AS ious FROM n WHERE n_gt > 0 AND n_dt > 0
UNION ALL SELECT r.image_id, o.i, list_append(r.used, o.j), r.total + o.iou, list_append(r.ious, o.iou) FROM r JOIN o ON o.image_id = r.image_id AND o.i = r.i + 1 AND (o.j = 0 OR NOT list_contains(r.used, o.j))),
m AS (SELECT r.image_id, arg_max(ious, total) AS ious, max(total) AS total FROM r JOIN n ON r.image_id = n.image_id AND r.i = n.n_gt GROUP BY 1)"""


_COUNTS = f"""{_best_sql(0.5, f"{_I} / ({_A} + {_B} - {_I})")}, k AS (SELECT image_id, round(0.5::DOUBLE + 0.05::DOUBLE * t, 2) AS threshold, n_gt, n_dt, len(list_filter(coalesce(ious, []), lambda x: x >= round(0.5::DOUBLE + 0.05::DOUBLE * t, 2))) AS tp FROM n LEFT JOIN m USING (image_id), range(10) r(t) WHERE n_gt + n_dt > 0)"""


@query("match_counts", f"{_COUNTS} SELECT threshold, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(n_dt - tp) AS BIGINT) AS fp, CAST(sum(n_gt - tp) AS BIGINT) AS fn FROM k GROUP BY 1")
def match_counts(spark, d):
    gt, dt = _sides(spark, d)
    return E.match_counts(gt, dt).groupBy("threshold").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


@query("image_mcc", f"""{_D}, s AS (SELECT image_id, bool_or(is_gt) AS g, bool_or(NOT is_gt AND conf >= 0.5) AS p FROM detections GROUP BY 1),
c AS (SELECT CAST(count(*) FILTER (g AND p) AS DOUBLE) AS tp, CAST(count(*) FILTER (NOT g AND p) AS DOUBLE) AS fp, CAST(count(*) FILTER (NOT g AND NOT p) AS DOUBLE) AS tn, CAST(count(*) FILTER (g AND NOT p) AS DOUBLE) AS fn FROM s),
r AS (SELECT *, tp / (tp + fn + 1e-6::DOUBLE) AS recall, tp / (tp + fp + 1e-6::DOUBLE) AS precision FROM c)
SELECT {near_sql('recall')} AS recall, {near_sql('precision')} AS precision, {near_sql('2 * precision * recall / (precision + recall + 1e-6::DOUBLE)')} AS f1, {near_sql('fp / (fp + tn + 1e-6::DOUBLE)')} AS fpr,
{near_sql('(tp * tn - fp * fn) / (sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) + 1e-6::DOUBLE)')} AS mcc FROM r""")
def image_mcc(spark, d):
    s = adapted(spark, d, "detections").groupBy("image_id").agg(F.max("is_gt").alias("g"), F.max(~F.col("is_gt") & (F.col("conf") >= 0.5)).alias("p"))
    out = E.image_level(s, F.col("g"), F.col("p"))
    return out.select(*[near(F.col(c)).alias(c) for c in out.columns])


def _f1_sql(p: str, r: str) -> str:
    return f"2 * {p} * {r} / ({p} + {r} + 1e-4::DOUBLE)"


@query("cgf1", f"""{_COUNTS}, i AS (SELECT *, CASE WHEN n_gt > 0 AND n_dt > 0 THEN {_f1_sql('(tp / (n_dt + 1e-4::DOUBLE))', '(tp / (n_gt + 1e-4::DOUBLE))')} ELSE 0.0 END AS own FROM k),
c AS (SELECT CAST(count(*) FILTER (n_gt > 0 AND n_dt > 0) AS DOUBLE) AS tp, CAST(count(*) FILTER (n_gt = 0 AND n_dt > 0) AS DOUBLE) AS fp, CAST(count(*) FILTER (n_gt = 0 AND n_dt = 0) AS DOUBLE) AS tn, CAST(count(*) FILTER (n_gt > 0 AND n_dt = 0) AS DOUBLE) AS fn FROM n),
l AS (SELECT (tp * tn - fp * fn) / (sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) + 1e-6::DOUBLE) AS mcc FROM c),
s AS (SELECT threshold, sum(tp) AS tp, sum(n_dt - tp) AS fp, sum(n_gt - tp) AS fn, sum(CASE WHEN n_gt > 0 THEN n_dt - tp ELSE 0 END) AS pfp, sum(own) AS own, count(*) FILTER (n_gt > 0 AND n_dt > 0) AS valid, count(*) FILTER (n_gt > 0) AS positives FROM i GROUP BY 1),
f AS (SELECT threshold, tp / (tp + fp + 1e-4::DOUBLE) AS precision, tp / (tp + fn + 1e-4::DOUBLE) AS recall, tp / (tp + pfp + 1e-4::DOUBLE) AS pp, own / valid AS macro, own / positives AS w0 FROM s),
q AS (SELECT *, {_f1_sql('precision', 'recall')} AS f1, {_f1_sql('pp', 'recall')} AS micro FROM f)
SELECT threshold, {near_sql('precision')} AS precision, {near_sql('recall')} AS recall, {near_sql('f1')} AS f1, {near_sql('micro')} AS positive_micro_f1, {near_sql('macro')} AS positive_macro_f1, {near_sql('w0')} AS positive_w0dt_macro_f1,
{near_sql('micro * mcc')} AS cgf1, {near_sql('macro * mcc')} AS cgf1_macro, {near_sql('w0 * mcc')} AS cgf1_w0dt FROM q, l""")
def cgf1(spark, d):
    gt, dt = _sides(spark, d)
    out = E.cgf1(adapted(spark, d, "detections").select("image_id"), gt, dt)
    return out.select("threshold", *[near(F.col(c)).alias(c) for c in out.columns[1:]])


@query("best_oracle", f"{_D}, m AS (SELECT image_id, category_id AS oracle, avg(CASE WHEN conf >= 0.5 THEN conf ELSE 1.0 END) AS mean FROM detections GROUP BY ALL) SELECT image_id, arg_max(oracle, (round(mean, 9), -oracle)) AS oracle, {near_sql('max(mean)')} AS mean FROM m GROUP BY 1")
def best_oracle(spark, d):
    t = adapted(spark, d, "detections").select("image_id", F.col("category_id").alias("oracle"), F.when(F.col("conf") >= 0.5, F.col("conf")).alias("f1"))
    return E.best_oracle(t).select("image_id", "oracle", near(F.col("mean")).alias("mean"))


@query("average_precision")
def average_precision(spark, d):
    out = E.average_precision(*_rated(spark, d))
    return out.select("category_id", "area", "most", "threshold", near(F.col("ap")).alias("ap"), near(F.col("recall")).alias("recall"))


@query("precision_summary")
def precision_summary(spark, d):
    out = E.precision_summary(E.average_precision(*_rated(spark, d)))
    return out.select("metric", near(F.col("value")).alias("value"))


@query("hota")
def hota(spark, d):
    gt, dt = _truth(spark, d)
    out = E.hota(E.track_counts(gt, dt, ["video_id"]), ["video_id"])
    return out.select("video_id", *[near(F.col(c)).alias(c) for c in out.columns[1:]])


@query("hota_rollup")
def hota_rollup(spark, d):
    """Sequences combined, by class, by super-category and over classes, weighted by detections."""
    gt, dt = _truth(spark, d)
    counts = keep(E.track_counts(gt, dt, ["video_id", "category_id"]))
    by_class = E.hota(counts, ["category_id"]).select(F.col("category_id").cast("string").alias("level"), "hota", "det_a", "ass_a")
    all_ = E.hota(counts.withColumn("level", F.lit("all")), ["level"]).select("level", "hota", "det_a", "ass_a")
    mean = E.hota_by_class(E.hota(counts, ["category_id"]).withColumn("level", F.lit("class mean")), ["level"]).select("level", "hota", "det_a", "ass_a")
    members = spark.createDataFrame([(c, "even" if c % 2 == 0 else "odd") for c in range(4)], "category_id int, super string")
    above = E.hota(training.by_super(counts, members), ["super"]).select(F.col("super").alias("level"), "hota", "det_a", "ass_a")
    out = by_class.unionByName(all_).unionByName(mean).unionByName(above)
    return out.select("level", *[near(F.col(c)).alias(c) for c in out.columns[1:]])


@query("teta")
def teta(spark, d):
    """By class and over classes, sequences combined."""
    out = E.teta_by_class(E.teta_counts(*_truth(spark, d), ["video_id"]))
    return out.select("level", *[near(F.col(c)).alias(c) for c in out.columns[1:]])


_TRUTH = f"""{_T}, g AS (SELECT video_id, frame AS t, track_id AS gt_id FROM tracks), p AS (SELECT video_id, t, CASE WHEN t >= 12 THEN gt_id + 1000 ELSE gt_id END AS trk_id FROM g WHERE (t + gt_id) % 6 <> 0)"""


@query("count_metric", f"{_TRUTH} SELECT video_id, max(t) + 1 AS frames, count(*) AS gt_dets, count(DISTINCT gt_id) AS gt_ids, (SELECT count(*) FROM p WHERE p.video_id = g.video_id) AS dets, (SELECT count(DISTINCT trk_id) FROM p WHERE p.video_id = g.video_id) AS ids FROM g GROUP BY video_id")
def count_metric(spark, d):
    gt, dt = _truth(spark, d)
    return E.detection_totals(gt, dt, "video_id")


@query("counting", f"{_D} SELECT image_id, count(*) FILTER (conf * (CAST(category_id AS DOUBLE) / 4) > 0.25) AS n_25, count(*) FILTER (conf * (CAST(category_id AS DOUBLE) / 4) > 0.5) AS n_50 FROM detections GROUP BY 1")
def counting(spark, d):
    t = adapted(spark, d, "detections").withColumn("presence", F.col("category_id") / 4)
    return E.counting(t, "image_id", (0.25, 0.5))
