"""Queries that write files and read them again: exports, annotation and scene files, tracking text, logs, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import pixels
from framelake.plans.adapters import adapted, table, with_
from framelake.plans.registry import near, near_sql, query
from framelake.plans.tables import _pictures
from framelake.session import folder
from framelake.sinks import writers
from framelake.sources import readers

_F, _T, _D, _S = with_("frames"), with_("tracks"), with_("detections"), with_("scenes")


def _frames(spark, d):
    return adapted(spark, d, "frames").select("filename", "frame_num", "shot_id", "error", "face_sim", F.col("metrics.sharpness_score").alias("sharpness_score"))


_EXPORTED = "filename, shot_id, face_sim, error, frame_num, sharpness_score"


@query("export_csv", f"{_F} SELECT {_EXPORTED} FROM frames")
def export_csv(spark, d):
    at = folder(spark)
    writers.export(_frames(spark, d), at, "csv")
    return spark.read.csv(at, schema="filename string, shot_id int, face_sim double, error string, frame_num long, sharpness_score double", header=True, enforceSchema=False)


@query("export_json", f"{_F} SELECT {_EXPORTED} FROM frames")
def export_json(spark, d):
    at = folder(spark)
    writers.export(_frames(spark, d), at)
    return spark.read.json(at, schema="filename string, shot_id int, face_sim double, error string, frame_num long, sharpness_score double")


@query("json_rows", f"{_F} SELECT filename, shot_id, face_sim FROM frames")
def json_rows(spark, d):
    """Rows as JSON texts, nested values too, and what the texts say."""
    t = writers.json_rows(_frames(spark, d).select(F.struct("filename", "face_sim").alias("own"), "shot_id", F.encode("filename", "utf-8").alias("raw")))
    p = F.from_json("json", "own struct<filename: string, face_sim: double>, shot_id int, raw string")
    return t.select(p.alias("p")).filter(F.decode(F.unbase64("p.raw"), "utf-8") == F.col("p.own.filename")).select("p.own.filename", "p.shot_id", "p.own.face_sim")


@query("scene_files", f"{_S} SELECT shot_id % 40 AS video, CAST(row_number() OVER (PARTITION BY shot_id % 40 ORDER BY start_frame) - 1 AS INT) AS shot_id, CAST(start_frame AS INT) AS start_frame, CAST(end_frame AS INT) AS end_frame FROM scenes")
def scene_files(spark, d):
    """A file of pairs a video, read as scenes."""
    t = adapted(spark, d, "scenes").groupBy((F.col("shot_id") % 40).alias("video")).agg(F.to_json(F.array_sort(F.collect_list(F.array("start_frame", "end_frame")))).alias("value"))
    t.write.partitionBy("video").text(at := folder(spark))
    return readers.scenes(spark, at, ("video",))


@query("tracking_files", f"{_T} SELECT frame AS t, track_id AS ident, x, w, score FROM tracks WHERE video_id % 3 <> 1 AND category_id <> 2")
def tracking_files(spark, d):
    """Tracks as delimited text; of valid videos only, without the rows to be ignored."""
    t = adapted(spark, d, "tracks").select("frame", "track_id", "x", "y", "w", "h", "score", "category_id", "video_id")
    t.write.option("sep", " ").csv(at := folder(spark))
    columns = ("t", "ident", "x", "y", "w", "h", "score", "category_id", "video")
    rows, _ = readers.tracking_text(spark, at, " ", columns, valid={"video": [float(v) for v in range(10) if v % 3 != 1]}, crowd=("category_id", [2]))
    return rows.select("t", "ident", "x", "w", "score")


def _annotated(spark, d) -> str:
    """Annotation files of some hundred pictures each."""
    boxes = F.struct(F.col("idx").alias("id"), "image_id", "category_id", F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("bbox"), F.struct(F.col("conf").alias("score")).alias("more"))
    t = adapted(spark, d, "detections").groupBy(F.floor(F.col("image_id") / 400).alias("part"))
    t = t.agg(F.collect_list(boxes).alias("annotations"), F.transform(F.collect_set("image_id"), lambda i: F.struct(i.alias("id"), F.concat(i.cast("string"), F.lit(".jpg")).alias("file_name"))).alias("images"))
    t.select(F.to_json(F.struct("images", "annotations", F.lit("v1").alias("version"))).alias("value"), "part").write.partitionBy("part").text(at := folder(spark))
    return at


@query("annotation_file_rows", f"{_D} SELECT image_id, idx AS id, category_id, x2 - x1 AS w, conf AS score FROM detections")
def annotation_file_rows(spark, d):
    t = readers.annotation_rows(spark, _annotated(spark, d), "annotations", {"image_id": "bigint", "id": "int", "category_id": "int", "bbox": "array<double>", "more.score": "double"})
    return t.select("image_id", "id", "category_id", F.col("bbox")[2].alias("w"), F.col("more_score").alias("score"))


@query("annotation_file_lists", f"{_D}, n AS (SELECT floor(image_id / 400) AS part, count(*) AS a, count(DISTINCT image_id) AS i FROM detections GROUP BY 1) SELECT 'annotations' AS name, count(*) AS files, CAST(sum(a) AS BIGINT) AS n FROM n UNION ALL SELECT 'images', count(*), CAST(sum(i) AS BIGINT) FROM n")
def annotation_file_lists(spark, d):
    return readers.annotation_lists(spark, _annotated(spark, d)).groupBy("name").agg(F.count("*").alias("files"), F.sum("n").alias("n"))


@query("scene_seeds_json", f"{_S} SELECT shot_id, status, seed_score FROM scenes")
def scene_seeds_json(spark, d):
    """Scenes as one JSON object a session, and back."""
    t = writers.scene_seeds(adapted(spark, d, "scenes").withColumn("session_id", F.col("shot_id") % 25), ("status", "seed_score"))
    back = F.explode(F.from_json("json", "map<string, struct<status: string, seed_score: double>>")).alias("shot_id", "s")
    return t.select(back).select(F.col("shot_id").cast("int").alias("shot_id"), "s.status", "s.seed_score")


@query("score_summary", f"{_D}, s AS (SELECT concat('class ', category_id) AS level, avg(conf) AS conf, CAST(count(*) AS DOUBLE) AS n FROM detections GROUP BY 1) SELECT concat(rpad(level, 20, ' '), ' conf: ', printf('%.3f', conf), ' n: ', printf('%.3f', n)) AS value FROM s")
def score_summary(spark, d):
    """The text summary of a table of scores."""
    t = adapted(spark, d, "detections").groupBy(F.concat(F.lit("class "), "category_id").alias("level")).agg(F.avg("conf").alias("conf"), F.count("*").cast("double").alias("n"))
    writers.score_tables(t, at := folder(spark))
    return spark.read.text(f"{at}/summary")


@query("log_rows", "SELECT CASE WHEN event_id % 5 = 0 THEN 'ERROR' ELSE 'INFO' END AS level, event_type AS component, count(*) AS n, count(*) FILTER (event_id % 2 = 0) AS timed FROM events WHERE event_id % 11 <> 3 GROUP BY ALL")
def log_rows(spark, d):
    """Log lines, some of them broken, as events by level."""
    own = F.to_json(F.struct(F.lit("2024-01-02T03:04:05").alias("timestamp"), F.when(F.col("event_id") % 5 == 0, "ERROR").otherwise("INFO").alias("level"), F.col("event_type").alias("component"), F.when(F.col("event_id") % 2 == 0, 1.5).alias("duration_ms")))
    table(spark, d, "events").select(F.when(F.col("event_id") % 11 == 3, "{broken").otherwise(own).alias("value")).write.text(at := folder(spark))
    return readers.logs(spark, at).groupBy("level", "component").agg(F.count("*").alias("n"), F.count("duration_ms").alias("timed"))


@query("progress_fraction", "SELECT least(1.0, max(event_id) * 10 / 1e6::DOUBLE) AS fraction, true AS ended FROM events")
def progress_fraction(spark, d):
    """How far an encoder is, by its key=value lines."""
    lines = table(spark, d, "events").select(F.col("event_id").alias("at"), F.explode(F.array(F.concat(F.lit("out_time_us="), F.col("event_id") * 10), F.lit("fps=25"), F.lit("progress=end"))).alias("value"))
    return readers.progress_lines(lines, 1000000)


_MASKED = "SELECT p_partkey, (p_partkey * 7 + r * 13 + c * 29 + r * c) % 256 AS v FROM part, range(16) a(r), range(16) b(c)"


@query("mask_area_pct", f"WITH p AS ({_MASKED}) SELECT p_partkey, {near_sql('100.0::DOUBLE * count(*) FILTER (v > 128) / count(*)')} AS pct FROM p GROUP BY 1")
def mask_area_pct(spark, d):
    """Percent of each picture's pixels that its mask (here the picture itself) covers."""
    t = pixels.measure(_pictures(spark, d).withColumn("mask", F.col("image.data")), mask="mask", only=("mask_area_pct",))
    return t.select("p_partkey", near(F.col("measured.mask_area_pct")).alias("pct"))
