"""Engine tables over the driver's tables.

The text of each adapter is SQL that Spark and DuckDB read alike, so a query and its SQL start from the same
rows; everything after it is written twice. All numbers are derived with whole-number arithmetic and
divisions of doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = ("quality_score", "sharpness_score", "edge_strength_score", "contrast_score", "brightness_score", "entropy_score", "niqe_score", "eyes_open", "blink_prob", "yaw", "pitch", "roll")


def _scaled(name: str, factor: int, modulus: int, unit: int = 10) -> str:
    return f"CASE WHEN event_type <> 'error' THEN CAST(event_id * {factor} % {modulus} AS DOUBLE) / {unit} END AS {name}"


SQL = {
    "frames": f"""SELECT concat('frame_', lpad(concat(event_id, ''), 6, '0'), '.png') AS filename, event_id AS frame_num, CAST(user_id % 25 AS INT) AS shot_id,
        CASE WHEN event_type = 'error' THEN 'Operator failed' END AS error,
        CASE WHEN event_id % 7 <> 0 THEN CAST(event_id * 11 % 101 AS DOUBLE) / 100 END AS face_sim,
        CASE WHEN event_id % 9 <> 0 THEN CAST(event_id * 31 % 1000 AS DOUBLE) / 10 END AS mask_area_pct,
        substr(md5(concat(event_id % 400, '')), 1, 16) AS phash,
        {_scaled("quality_score", 37, 1009)}, {_scaled("sharpness_score", 53, 997)}, {_scaled("edge_strength_score", 71, 1013)}, {_scaled("contrast_score", 29, 1003)},
        {_scaled("brightness_score", 17, 1019)}, {_scaled("entropy_score", 41, 1021)}, {_scaled("niqe_score", 13, 1031)}, {_scaled("eyes_open", 7, 101, 100)}, {_scaled("blink_prob", 3, 101, 100)},
        CASE WHEN event_type <> 'error' THEN CAST(event_id * 19 % 121 - 60 AS DOUBLE) END AS yaw, CASE WHEN event_type <> 'error' THEN CAST(event_id * 23 % 91 - 45 AS DOUBLE) END AS pitch,
        CASE WHEN event_type <> 'error' THEN CAST(event_id % 31 - 15 AS DOUBLE) END AS roll
        FROM events""",
    "scenes": """SELECT CAST(o_orderkey AS INT) AS shot_id, o_orderkey * 7 AS start_frame, o_orderkey * 7 + 7 AS end_frame,
        CASE o_orderstatus WHEN 'F' THEN 'included' WHEN 'O' THEN 'excluded' ELSE 'pending' END AS status,
        o_custkey % 11 = 0 AS manual_status_change, o_custkey % 13 = 0 AS is_overridden,
        CASE WHEN o_custkey % 3 <> 0 THEN CAST(o_orderkey * 17 % 1000 AS DOUBLE) / 10 END AS seed_mask_area, CASE WHEN o_custkey % 5 <> 0 THEN CAST(o_orderkey * 13 % 1000 AS DOUBLE) / 10 END AS detail_mask_area,
        CASE WHEN o_custkey % 4 <> 0 THEN CAST(o_orderkey * 7 % 100 AS DOUBLE) / 100 END AS seed_face_sim, CASE WHEN o_custkey % 7 <> 0 THEN CAST(o_orderkey * 3 % 100 AS DOUBLE) / 100 END AS detail_face_sim,
        CASE WHEN o_custkey % 2 <> 0 THEN CAST(o_orderkey * 29 % 200 AS DOUBLE) / 10 END AS seed_quality, CAST(o_orderkey * 23 % 200 AS DOUBLE) / 10 AS seed_score, o_custkey % 6 <> 0 AS has_bbox
        FROM orders""",
    "detections": """SELECT l_orderkey AS image_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS INT) AS idx,
        CAST(l_partkey % 400 AS DOUBLE) AS x1, CAST(l_suppkey * 7 % 300 AS DOUBLE) AS y1,
        CAST(l_partkey % 400 + 20 + l_partkey * 3 % 180 AS DOUBLE) AS x2, CAST(l_suppkey * 7 % 300 + 20 + l_partkey * 5 % 150 AS DOUBLE) AS y2,
        CAST(l_partkey * 7 % 61 + 35 AS DOUBLE) / 100 AS conf, CASE WHEN l_returnflag = 'R' THEN 'text' ELSE 'subject' END AS type, CAST(l_partkey % 5 AS INT) AS category_id, l_linestatus = 'F' AS is_gt
        FROM lineitem""",
    "faces": """SELECT vec_id AS face_id, vec_id AS frame_num, embedding, label, CAST(vec_id * 37 % 101 AS DOUBLE) / 100 AS det_score FROM embeddings""",
    "hashes": """SELECT doc_id AS frame_num, concat('frame_', lpad(concat(doc_id, ''), 6, '0')) AS filename, substr(md5(text), 1, 16) AS phash, CAST(doc_id * 7 % 101 AS DOUBLE) / 10 AS quality FROM documents""",
    "tracks": """SELECT CAST(user_id % 10 AS INT) AS video_id, CAST(user_id AS INT) AS track_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS frame,
        CAST(user_id * 13 % 300 AS DOUBLE) + CAST(event_id % 17 AS DOUBLE) AS x, CAST(user_id * 29 % 200 AS DOUBLE) + CAST(event_id % 13 AS DOUBLE) AS y, CAST(60 + user_id % 5 * 10 AS DOUBLE) AS w, CAST(50 + user_id % 7 * 10 AS DOUBLE) AS h,
        CAST(event_id * 7 % 100 AS DOUBLE) / 100 AS score, CAST(user_id % 4 AS INT) AS category_id FROM events""",
    "mask_runs": """SELECT mask_id, CAST(floor(CAST(mask_id AS DOUBLE) / 4) AS BIGINT) AS image_id, CAST(cx + u AS INT) AS x, CAST(lo AS INT) AS lo, CAST(hi AS INT) AS hi FROM (
        SELECT *, CASE WHEN side = 2 THEN cy - 1 WHEN side = 0 THEN cy - h ELSE cy + k + 1 END AS lo, CASE WHEN side = 2 THEN cy + 2 WHEN side = 0 AND k >= 0 THEN cy - k ELSE cy + h + 1 END AS hi FROM (
        SELECT *, floor(ry * sqrt(1 - CAST(u * u AS DOUBLE) / (rx * rx))) AS h, CASE WHEN hx > 0 AND abs(u) <= hx THEN floor(hy * sqrt(1 - CAST(u * u AS DOUBLE) / (hx * hx))) ELSE -1 END AS k FROM (
        SELECT *, i - rx AS u FROM (SELECT *, CASE mask_id % 3 WHEN 0 THEN CAST(floor(CAST(rx AS DOUBLE) / 2) AS BIGINT) WHEN 1 THEN 2 ELSE 0 END AS hx, CASE mask_id % 3 WHEN 0 THEN CAST(floor(CAST(ry AS DOUBLE) / 2) AS BIGINT) WHEN 1 THEN 2 ELSE 0 END AS hy FROM (
        SELECT s_suppkey AS mask_id, 20 + s_suppkey * 37 % 100 AS rx, 20 + s_suppkey * 53 % 80 AS ry, 130 + s_suppkey * 71 % 380 AS cx, 110 + s_suppkey * 91 % 260 AS cy FROM supplier) shapes) holed, range(250) AS r(i), range(3) AS t(side)
        WHERE i <= 2 * rx + 6) spread
        WHERE CASE WHEN abs(u) <= rx THEN side < 2 ELSE side = 2 AND mask_id % 2 = 0 AND u >= rx + 4 END) halves) cut
        WHERE side <> 1 OR k >= 0""",
}

#: The driver's table that an adapter reads.
BASE = {"mask_runs": "supplier", "frames": "events", "scenes": "orders", "detections": "lineitem", "faces": "embeddings", "hashes": "documents", "tracks": "events"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def adapted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An engine table. Frames have their metrics in one struct, as they are stored, so unused ones are not read."""
    base = BASE[name]
    rows = table(spark, sf_dir, base)
    if name == "mask_runs":  # a key of some bytes is a mask: as many tasks as shuffles have
        rows = rows.select("s_suppkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "s_suppkey")
    df = spark.sql(SQL[name].replace(f"FROM {base}", f"FROM {{{base}}}"), **{base: rows})
    if name == "frames":
        df = df.select("filename", "frame_num", "shot_id", "error", "face_sim", "mask_area_pct", "phash", F.struct(*METRICS).alias("metrics"))
    return df


def with_(*names: str) -> str:
    """WITH clause that gives the named engine tables to a SQL text."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
