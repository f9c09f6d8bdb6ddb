"""Duplicate, cluster, seed and crop queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import boxes as B
from framelake.operators import dedup, graph, seeds
from framelake.plans.adapters import adapted, table, with_
from framelake.plans.registry import near, near_sql, query

W, H = 640.0, 480.0
RATIOS = "16:9, 1:1, 9:16"

_D = with_("detections")
_INTER = "greatest(least({a}x2, {b}x2) - greatest({a}x1, {b}x1), 0.0) * greatest(least({a}y2, {b}y2) - greatest({a}y1, {b}y1), 0.0)"


def _inter(a: str, b: str) -> str:
    return _INTER.format(a=a, b=b)


def _area(a: str) -> str:
    return f"(({a}x2 - {a}x1) * ({a}y2 - {a}y1))"


@query("dedup_exact", f"{with_('hashes')} SELECT filename, row_number() OVER (PARTITION BY phash ORDER BY quality DESC, filename) = 1 AS kept FROM hashes")
def dedup_exact(spark, d):
    return dedup.exact(adapted(spark, d, "hashes")).select("filename", "kept")


def _near_hashes(spark, d):
    """Hashes of frames, some a few bits from a base."""
    flips = F.expr("shiftleft(1L, cast(frame_num % 7 as int)) | shiftleft(1L, cast(frame_num % 61 as int))")
    base = dedup.bits(F.substring(F.md5((F.col("frame_num") % 300).cast("string")), 1, 16))
    t = table(spark, d, "documents").select(F.col("doc_id").alias("frame_num"))
    h = F.lpad(F.lower(F.hex(base.bitwiseXOR(flips))), 16, "0")
    return t.select(F.format_string("frame_%06d", "frame_num").alias("filename"), "frame_num", h.alias("phash"), (F.col("frame_num") * 7 % 101).cast("double").alias("quality"))


_BASE = "SELECT doc_id, CAST(('0x' || substr(md5(CAST(doc_id % 300 AS VARCHAR)), 1, 16)) AS UBIGINT) AS b, (1::UBIGINT << CAST(doc_id % 7 AS INT)) | (1::UBIGINT << CAST(doc_id % 61 AS INT)) AS f FROM documents"


_ROWS = f"f AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS k, concat('frame_', lpad(CAST(doc_id AS VARCHAR), 6, '0')) AS filename, doc_id, xor(b, f) AS h, CAST(doc_id * 7 % 101 AS DOUBLE) AS q FROM ({_BASE}))"
_HIT = "coalesce(list_position(list_transform(r.hs, lambda x: bit_count(xor(x, f.h)) <= 4), true), 0)"


@query("dedup_banded", f"""WITH RECURSIVE {_ROWS}, r AS (SELECT 0::BIGINT AS k, []::UBIGINT[] AS hs, []::DOUBLE[] AS qs, []::BIGINT[] AS slots, []::BIGINT[] AS lost UNION ALL
SELECT k, CASE WHEN hit = 0 THEN list_append(hs, h) WHEN better THEN list_concat(list_append(hs[:hit - 1], h), hs[hit + 1:]) ELSE hs END, CASE WHEN hit = 0 THEN list_append(qs, q) WHEN better THEN list_concat(list_append(qs[:hit - 1], q), qs[hit + 1:]) ELSE qs END,
CASE WHEN hit = 0 THEN list_append(slots, k) WHEN better THEN list_concat(list_append(slots[:hit - 1], k), slots[hit + 1:]) ELSE slots END, CASE WHEN hit = 0 THEN lost WHEN better THEN list_append(lost, slots[hit]) ELSE list_append(lost, k) END
FROM (SELECT *, hit > 0 AND q > qs[hit] AS better FROM (SELECT f.k, f.h, f.q, r.hs, r.qs, r.slots, r.lost, {_HIT} AS hit FROM r JOIN f ON f.k = r.k + 1)))
SELECT filename, k NOT IN (SELECT unnest(lost) FROM r WHERE k = (SELECT max(k) FROM r)) AS kept FROM f""")
def dedup_banded(spark, d):
    return dedup.near(_near_hashes(spark, d), 4).select("filename", "kept")


@query("near_hash_pairs", f"WITH h AS (SELECT DISTINCT xor(b, f) AS h FROM ({_BASE})) SELECT count(*) AS pairs FROM h x JOIN h y ON x.h < y.h AND bit_count(xor(x.h, y.h)) <= 4")
def near_hash_pairs(spark, d):
    hashes = _near_hashes(spark, d).select(dedup.bits(F.col("phash")).alias("h")).distinct()
    return dedup.near_hashes(hashes, 4).agg(F.count("*").alias("pairs"))


@query(
    "dedup_adjacent",
    f"""{with_('frames')}, n AS (SELECT filename, coalesce(quality_score, 0) AS q, lag(coalesce(quality_score, 0)) OVER w AS bq, lead(coalesce(quality_score, 0)) OVER w AS aq,
coalesce(abs(brightness_score - lag(brightness_score) OVER w) <= 20, false) AS s, coalesce(abs(lead(brightness_score) OVER w - brightness_score) <= 20, false) AS t FROM frames WINDOW w AS (PARTITION BY shot_id ORDER BY filename))
SELECT filename, NOT ((s AND NOT q > bq) OR (t AND coalesce(aq > q, false))) AS kept FROM n""",
)
def dedup_adjacent(spark, d):
    from pyspark.sql import Window

    frames = adapted(spark, d, "frames").select("filename", "frame_num", "shot_id", F.col("metrics.quality_score").alias("quality"), F.col("metrics.brightness_score").alias("b"))
    like = F.abs(F.col("b") - F.lag("b").over(Window.partitionBy("shot_id").orderBy("filename", "frame_num"))) <= 20
    return dedup.adjacent(frames, like, partition="shot_id", then=("frame_num",)).select("filename", "kept")


@query("dedup_hybrid", f"""WITH RECURSIVE {_ROWS}, r AS (SELECT 0::BIGINT AS k, []::UBIGINT[] AS hs, []::BIGINT[] AS slots, []::STRUCT(slot BIGINT, k BIGINT)[] AS pairs UNION ALL
SELECT k, CASE WHEN hit = 0 THEN list_append(hs, h) ELSE hs END, CASE WHEN hit = 0 THEN list_append(slots, k) ELSE slots END, CASE WHEN hit = 0 THEN pairs ELSE list_append(pairs, {{'slot': slots[hit], 'k': k}}) END
FROM (SELECT f.k, f.h, r.hs, r.slots, r.pairs, {_HIT} AS hit FROM r JOIN f ON f.k = r.k + 1)),
p AS (SELECT unnest(pairs) AS p FROM r WHERE k = (SELECT max(k) FROM r)), l AS (SELECT CASE WHEN b.q > a.q THEN a.k ELSE b.k END AS k FROM p JOIN f a ON a.k = p.p.slot JOIN f b ON b.k = p.p.k WHERE a.doc_id % 300 = b.doc_id % 300 AND (a.doc_id + b.doc_id) % 20 <= 10)
SELECT filename, k NOT IN (SELECT k FROM l) AS kept FROM f""")
def dedup_hybrid(spark, d):
    frames = _near_hashes(spark, d)
    names = frames.select("filename", "frame_num")

    def distance(pairs):
        """Of pairs with one base; only they have one."""
        t = pairs.join(names.toDF("slot", "a"), "slot").join(names.toDF("frame", "b"), "frame").filter("a < b and a % 300 = b % 300")
        return t.select("slot", "frame", ((F.col("a") + F.col("b")) % 20 / 100).alias("distance"))

    return dedup.hybrid(frames, 4, distance).select("filename", "kept")


@query("dup_stats", "SELECT count(*) AS frames, count(DISTINCT md5(text)) AS distinct_hashes, count(*) - count(DISTINCT md5(text)) AS duplicates FROM documents")
def dup_stats(spark, d):
    kept = dedup.exact(adapted(spark, d, "hashes").withColumn("phash", F.col("phash")))
    return kept.agg(F.count("*").alias("frames"), F.count_if(F.col("kept")).alias("distinct_hashes"), F.count_if(~F.col("kept")).alias("duplicates"))


@query("first_like", f"WITH h AS (SELECT doc_id, xor(b, f) AS h FROM ({_BASE})) SELECT printf('frame_%06d', min(y.doc_id)) AS filename FROM h x JOIN h y ON x.doc_id = 5 AND y.doc_id <> 5 AND bit_count(xor(x.h, y.h)) <= 4 HAVING count(*) > 0")
def first_like(spark, d):
    return dedup.first_like(_near_hashes(spark, d), "frame_000005", 4).select("filename")


_LINKS = """WITH RECURSIVE links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.35),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
parts AS (SELECT a AS face_id, least(a, min(b)) AS c FROM reach GROUP BY a), names AS (SELECT c, CAST(row_number() OVER (ORDER BY c) - 1 AS INT) AS cluster FROM (SELECT DISTINCT c FROM parts)),
clustered AS (SELECT e.vec_id AS face_id, coalesce(n.cluster, -1) AS cluster, CAST(e.vec_id * 37 % 101 AS DOUBLE) / 100 AS det_score FROM embeddings e LEFT JOIN parts p ON p.face_id = e.vec_id LEFT JOIN names n USING (c))"""


@query("face_clusters", f"{_LINKS} SELECT face_id, cluster FROM clustered")
def face_clusters(spark, d):
    return graph.face_clusters(adapted(spark, d, "faces"), 0.35)


@query("cluster_best", f"{_LINKS} SELECT cluster, arg_min(face_id, (-det_score, face_id)) AS face_id, max(det_score) AS det_score, count(*) AS size FROM clustered WHERE cluster >= 0 GROUP BY cluster")
def cluster_best(spark, d):
    faces = adapted(spark, d, "faces")
    return graph.representatives(graph.face_clusters(faces, 0.35).join(faces.select("face_id", "det_score"), "face_id"))


@query("face_similarity", "SELECT e.vec_id AS face_id, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 6) AS face_sim FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) r")
def face_similarity(spark, d):
    faces = adapted(spark, d, "faces").select("face_id", F.col("embedding").cast("array<double>").alias("v"))
    ref = faces.filter("face_id = 0").select(F.col("v").alias("r"))
    dot = F.aggregate(F.zip_with("v", "r", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return faces.join(F.broadcast(ref)).select("face_id", F.round(dot, 6).alias("face_sim"))


_SCORES = {
    "largest": ("Largest Subject", _area("")),
    "centre": ("Center-most Subject", "-sqrt(pow((x1 + x2) / 2 - 320, 2) + pow((y1 + y2) / 2 - 240, 2))"),
    "confidence": ("Highest Confidence", "CASE WHEN conf < 0.4 THEN -1.0 ELSE conf END"),
    "tallest": ("Tallest Subject", "y2 - y1"),
    "area_confidence": ("Area x Confidence", f"{_area('')} * conf"),
    "edge_avoiding": ("Edge-avoiding", "least(x1, y1, 640 - x2, 480 - y2)"),
    "balanced": ("Balanced", f"0.4::DOUBLE * ({_area('')} / 307200) + 0.4::DOUBLE * conf + 0.2::DOUBLE * (least(x1, y1, 640 - x2, 480 - y2) / 240)"),
    "thirds": ("Rule-of-Thirds", "-least(" + ", ".join(f"sqrt(pow((x1 + x2) / 2 - 640::DOUBLE * {i} / 3, 2) + pow((y1 + y2) / 2 - 480::DOUBLE * {j} / 3, 2))" for j in (1, 2) for i in (1, 2)) + ")"),
}


def _strategy(name: str, strategy: str, score: str) -> None:
    sql = f"{_D}, s AS (SELECT *, {near_sql(score, 8)} AS score, row_number() OVER (PARTITION BY image_id ORDER BY {near_sql(score, 8)} DESC, conf DESC, {_area('')} DESC, idx) AS k FROM detections) SELECT image_id, idx, score FROM s WHERE k = 1"

    @query(f"best_box_{name}", sql)
    def run(spark, d):
        t = adapted(spark, d, "detections")
        return seeds._best(t, near(seeds.strategy_score(strategy, W, H), 8)).select("image_id", "idx", "score")


for _n, (_s, _e) in _SCORES.items():
    _strategy(_n, _s, _e)


def _faces(spark, d):
    """A face in every third image, from orders."""
    o = table(spark, d, "orders").filter("o_orderkey % 3 = 0")
    x, y = F.col("o_custkey") % 500, F.col("o_custkey") * 7 % 400
    return o.select(F.col("o_orderkey").alias("image_id"), x.cast("double").alias("fx1"), y.cast("double").alias("fy1"), (x + 40).cast("double").alias("fx2"), (y + 40).cast("double").alias("fy2"), ((F.col("o_custkey") % 97) / 100).alias("det_score"), ((F.col("o_custkey") % 89) / 100).alias("sim"))


_FACES = "faces AS (SELECT o_orderkey AS image_id, CAST(o_custkey % 500 AS DOUBLE) AS fx1, CAST(o_custkey * 7 % 400 AS DOUBLE) AS fy1, CAST(o_custkey % 500 + 40 AS DOUBLE) AS fx2, CAST(o_custkey * 7 % 400 + 40 AS DOUBLE) AS fy2, CAST(o_custkey % 97 AS DOUBLE) / 100 AS det_score, CAST(o_custkey % 89 AS DOUBLE) / 100 AS sim FROM orders WHERE o_orderkey % 3 = 0)"


@query(
    "best_box_face",
    f"""{_D}, {_FACES}, s AS (SELECT t.image_id, idx, conf, {_area('t.')} AS area, coalesce(max(CASE WHEN fx1 + fx2 / 2 >= x1 AND fx1 + fx2 / 2 < x2 AND fy1 + fy2 / 2 >= y1 AND fy1 + fy2 / 2 < y2 THEN det_score END), 0.0) AS score
FROM detections t LEFT JOIN faces f USING (image_id) GROUP BY ALL) SELECT image_id, idx, score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, conf DESC, area DESC, idx) AS k FROM s) WHERE k = 1""",
)
def best_box_face(spark, d):
    return seeds.best_face_subject(adapted(spark, d, "detections"), _faces(spark, d), W, H).select("image_id", "idx", "score")


@query("face_in_box", f"{_D}, {_FACES}, b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {_area('')} DESC, conf DESC, idx) AS k FROM detections) SELECT image_id, idx, coalesce(max(CASE WHEN (fx1 + fx2) / 2 BETWEEN x1 AND x2 AND (fy1 + fy2) / 2 BETWEEN y1 AND y2 THEN sim END), 0.0) AS seed_face_sim FROM b LEFT JOIN faces USING (image_id) WHERE k = 1 GROUP BY ALL")
def face_in_box(spark, d):
    best = seeds.best_subject(adapted(spark, d, "detections"), "Largest Subject", W, H)
    return seeds.similarity_in_box(best, _faces(spark, d)).select("image_id", "idx", "seed_face_sim")


_IOU = f"{_inter('a.', 'b.')} / ({_area('a.')} + {_area('b.')} - {_inter('a.', 'b.')} + 1e-6::DOUBLE)"


@query("iou_join", f"{_D} SELECT a.image_id, a.idx, b.idx AS r_idx, round({_IOU}, 6) AS iou FROM detections a JOIN detections b USING (image_id) WHERE a.type = 'text' AND b.type = 'subject'")
def iou_join(spark, d):
    t = adapted(spark, d, "detections")
    return seeds.iou_pairs(t.filter("type = 'text'"), t.filter("type = 'subject'")).select("image_id", "idx", "r_idx", F.round("iou", 6).alias("iou"))


_PAD = "least(greatest({0} - ({2} - {1}) * 0.05::DOUBLE, 0.0), 1e9)"


@query(
    "object_first",
    f"""{_D}, p AS (SELECT a.image_id, a.x1, a.y1, a.x2, a.y2, {_IOU} AS iou, row_number() OVER (PARTITION BY a.image_id ORDER BY {_IOU} DESC, a.idx, b.idx) AS k FROM detections a JOIN detections b USING (image_id) WHERE a.type = 'text' AND b.type = 'subject'),
m AS (SELECT * FROM p WHERE k = 1 AND iou > 0.5), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY idx) AS k FROM detections WHERE type = 'text') WHERE k = 1),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {_area('')} DESC, conf DESC, idx) AS k FROM detections WHERE type = 'subject') WHERE k = 1),
c AS (SELECT i.image_id, CASE WHEN m.image_id IS NOT NULL THEN 'text_and_subject' WHEN t.image_id IS NOT NULL THEN 'text' ELSE 'strategy' END AS kind, coalesce(m.x1, t.x1, g.x1) AS x1, coalesce(m.y1, t.y1, g.y1) AS y1, coalesce(m.x2, t.x2, g.x2) AS x2, coalesce(m.y2, t.y2, g.y2) AS y2
FROM (SELECT DISTINCT image_id FROM detections) i LEFT JOIN m USING (image_id) LEFT JOIN t USING (image_id) LEFT JOIN g USING (image_id)),
q AS (SELECT image_id, kind, greatest(0.0, x1 - (x2 - x1) * 0.05::DOUBLE) AS a1, greatest(0.0, y1 - (y2 - y1) * 0.05::DOUBLE) AS b1, least(639.0, x2 + (x2 - x1) * 0.05::DOUBLE) AS a2, least(479.0, y2 + (y2 - y1) * 0.05::DOUBLE) AS b2 FROM c)
SELECT image_id, CAST(trunc(a1) AS INT) AS x, CAST(trunc(b1) AS INT) AS y, greatest(1, CAST(trunc(a2 - a1) AS INT)) AS w, greatest(1, CAST(trunc(b2 - b1) AS INT)) AS h, kind FROM q""",
)
def object_first(spark, d):
    return seeds.object_first(adapted(spark, d, "detections"), "Largest Subject", W, H)


_WHOLE = "CAST(trunc(greatest(0.0, x1 - pw)) AS INT) AS x, CAST(trunc(greatest(0.0, y1 - ph)) AS INT) AS y, greatest(1, CAST(trunc(least(639.0, x2 + pw) - greatest(0.0, x1 - pw)) AS INT)) AS w, greatest(1, CAST(trunc(least(479.0, y2 + ph) - greatest(0.0, y1 - ph)) AS INT)) AS h"


@query("identity_first", f"""{_D}, {_FACES}, f AS (SELECT * FROM faces WHERE sim > 0.4::DOUBLE),
p AS (SELECT * FROM (SELECT a.image_id, a.idx AS s, b.idx AS t, {_IOU} AS iou, row_number() OVER (PARTITION BY a.image_id ORDER BY {_IOU} DESC, a.idx, b.idx) AS k FROM detections a JOIN detections b USING (image_id) WHERE a.type = 'subject' AND b.type = 'text') WHERE k = 1 AND iou > 0.5),
c AS (SELECT d.*, (x2 - x1) * 0.05::DOUBLE AS pw, (y2 - y1) * 0.05::DOUBLE AS ph, CASE WHEN x1 <= fx1 AND y1 <= fy1 AND x2 >= fx2 AND y2 >= fy2 THEN 100.0::DOUBLE ELSE 0.0 END + 20.0::DOUBLE * conf + CASE WHEN coalesce(d.idx = p.s OR d.idx = p.t, false) THEN 50.0::DOUBLE ELSE 0.0 END AS score
FROM detections d JOIN f USING (image_id) LEFT JOIN p USING (image_id)),
b AS (SELECT image_id, score, {_WHOLE} FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, type = 'subject' DESC, idx) AS k FROM c) WHERE k = 1),
g AS (SELECT image_id, least(639.0, greatest(0.0, fx1 + 20 - 80)) AS gx, least(479.0, greatest(0.0, fy1 - 30)) AS gy FROM f)
SELECT image_id, coalesce(b.x, CAST(trunc(gx) AS INT)) AS x, coalesce(b.y, CAST(trunc(gy) AS INT)) AS y, coalesce(b.w, CAST(trunc(least(640 - gx, 160.0)) AS INT)) AS w, coalesce(b.h, CAST(trunc(least(480 - gy, 280.0)) AS INT)) AS h,
CASE WHEN b.image_id IS NOT NULL THEN 'evidence' ELSE 'face' END AS kind, b.score FROM g LEFT JOIN b USING (image_id)""")
def identity_first(spark, d):
    return seeds.evidence(adapted(spark, d, "detections"), _faces(spark, d), W, H)


@query("seed_cascade", f"{_D}, {_FACES}, t AS (SELECT image_id, min(idx) AS idx FROM detections WHERE type = 'text' GROUP BY 1) SELECT i.image_id, CASE WHEN t.idx IS NOT NULL THEN 'cached' WHEN f.image_id IS NOT NULL THEN 'face' ELSE 'region' END AS source FROM (SELECT DISTINCT image_id FROM detections) i LEFT JOIN t USING (image_id) LEFT JOIN faces f USING (image_id)")
def seed_cascade(spark, d):
    t = adapted(spark, d, "detections")
    box = lambda *c: F.struct(*[x.cast("int").alias(n) for n, x in zip("xywh", c, strict=True)]).alias("box")
    cached = t.filter("type = 'text'").groupBy("image_id").agg(F.min_by(box(*B.to_xywh(B.box())), "idx").alias("box"))
    face = _faces(spark, d).select("image_id", box(*B.body(B.box("f"), W, H)))
    region = t.select("image_id").distinct().select("image_id", box(*B.fallback(W, H)))
    return seeds.cascade(t, [("cached", cached), ("face", face), ("region", region)]).select("image_id", "source")


_UNION = f"({_area('a.')} + {_area('b.')} - {_inter('a.', 'b.')})"
_HULL = "((greatest(a.x2, b.x2) - least(a.x1, b.x1)) * (greatest(a.y2, b.y2) - least(a.y1, b.y1)))"


@query("box_metrics", f"""{_D} SELECT a.image_id, a.idx, {near_sql(f"{_inter('a.', 'b.')} / {_UNION}")} AS iou, {near_sql(f"{_inter('a.', 'b.')} / {_UNION} - ({_HULL} - {_UNION}) / {_HULL}")} AS giou,
{near_sql(f"{_inter('a.', 'b.')} / {_area('b.')}")} AS ioa, {near_sql(f"{_inter('a.', 'b.')} / least({_area('a.')}, {_area('b.')})")} AS iom, a.x1 <= b.x1 AND a.y1 <= b.y1 AND a.x2 >= b.x2 AND a.y2 >= b.y2 AS contains
FROM detections a JOIN detections b ON a.image_id = b.image_id AND b.idx = a.idx + 1""")
def box_metrics(spark, d):
    t = adapted(spark, d, "detections").select("image_id", "idx", "x1", "y1", "x2", "y2")
    r = t.select("image_id", (F.col("idx") - 1).alias("idx"), *[F.col(c).alias("r_" + c) for c in ("x1", "y1", "x2", "y2")])
    a, b = B.box(), B.box("r_")
    return t.join(r, ["image_id", "idx"]).select("image_id", "idx", *[near(f(a, b)).alias(n) for n, f in (("iou", B.iou), ("giou", B.giou), ("ioa", B.ioa), ("iom", B.iom))], B.contains(a, b).alias("contains"))


@query(
    "face_to_body",
    f"""WITH {_FACES}, g AS (SELECT image_id, greatest(0.0, least(639.0, fx1 + (fx2 - fx1) / 2 - (fx2 - fx1) * 4 / 2)) AS x, greatest(0.0, least(479.0, fy1 - (fy2 - fy1) * 0.75::DOUBLE)) AS y, (fx2 - fx1) * 4 AS w, (fy2 - fy1) * 7 AS h FROM faces)
SELECT image_id, CAST(trunc(x) AS INT) AS x, CAST(trunc(y) AS INT) AS y, CAST(trunc(greatest(1.0, least(640 - x, w))) AS INT) AS w, CAST(trunc(greatest(1.0, least(480 - y, h))) AS INT) AS h FROM g""",
)
def face_to_body(spark, d):
    x, y, w, h = B.body(B.box("f"), W, H)
    return _faces(spark, d).select("image_id", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


@query("face_prominence", f"WITH {_FACES} SELECT image_id, round(0.7::DOUBLE * (100 * (fx2 - fx1) * (fy2 - fy1) / 307200) + 30 * (1 - least(sqrt(pow((fx1 + fx2) / 2 - 320, 2) + pow((fy1 + fy2) / 2 - 240, 2)) / 400, 1.0)), 6) AS prominence FROM faces")
def face_prominence(spark, d):
    return _faces(spark, d).select("image_id", F.round(B.prominence(B.box("f"), W, H), 6).alias("prominence"))


_CROP = f"""{_D}, s AS (SELECT image_id, 640::DOUBLE AS fw, 480::DOUBLE AS fh, x1 AS x, y1 AS y, least(x2, 640.0) - x1 AS w, least(y2, 480.0) - y1 AS h, idx FROM detections),
r AS (SELECT * FROM (VALUES ('16:9', 16::DOUBLE / 9, 0), ('1:1', 1::DOUBLE, 1), ('9:16', 9::DOUBLE / 16, 2)) t(ratio, r, i)),
g AS (SELECT *, least(greatest(least(greatest(w, h * r) * 1.2::DOUBLE, least(fw, fh * r)), greatest(w, h * r)), least(fw, fh * r)) AS gw, least(greatest(least(greatest(h, w / r) * 1.2::DOUBLE, least(fh, fw / r)), greatest(h, w / r)), least(fh, fw / r)) AS gh FROM s, r WHERE w > 0 AND h > 0),
p AS (SELECT *, greatest(0.0, least(x + w / 2 - gw / 2, fw - gw)) AS cx, greatest(0.0, least(y + h / 2 - gh / 2, fh - gh)) AS cy FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY image_id, idx ORDER BY gw * gh, abs(trunc(gw) / trunc(gh) - w / h), i) AS k FROM p WHERE cx <= x AND cy <= y AND cx + gw >= x + w AND cy + gh >= y + h)
SELECT image_id, idx, 640 AS frame_w, 480 AS frame_h, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(w AS INT) AS w, CAST(h AS INT) AS h, ratio, CAST(trunc(cx) AS INT) AS crop_x, CAST(trunc(cy) AS INT) AS crop_y, CAST(trunc(gw) AS INT) AS crop_w, CAST(trunc(gh) AS INT) AS crop_h FROM k WHERE k = 1"""


@query("crop_plan", _CROP)
def crop_plan(spark, d):
    t = adapted(spark, d, "detections")
    s = t.select("image_id", "idx", F.lit(640).alias("frame_w"), F.lit(480).alias("frame_h"), F.col("x1").cast("int").alias("x"), F.col("y1").cast("int").alias("y"), (F.least("x2", F.lit(W)) - F.col("x1")).cast("int").alias("w"), (F.least("y2", F.lit(H)) - F.col("y1")).cast("int").alias("h"))
    return seeds.crop_plan(s, seeds.aspect_ratios(RATIOS), 1.2)
