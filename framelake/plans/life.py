"""Queries of frames at a constant rate, plugins that see a frame at a time, kept conditioning frames, and turned boxes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framelake.functions import rotated
from framelake.operators import datasets, joins, plugins, training
from framelake.plans.adapters import adapted, table, with_
from framelake.plans.registry import near, near_sql, query
from framelake.sources import readers
from framelake.streaming import state

_TIMED = "f AS (SELECT user_id AS video, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, CAST(event_id % 50 AS DOUBLE) / 50 AS part FROM events), t AS (SELECT video, n, (n + part) / 6 AS t FROM f)"


@query("frames_at_rate", f"""WITH {_TIMED}, s AS (SELECT video, CAST(floor(t * 2.5::DOUBLE + 0.5) AS BIGINT) AS slot, arg_max(n, (t, n)) AS n FROM t GROUP BY ALL), l AS (SELECT *, lead(slot) OVER (PARTITION BY video ORDER BY slot) AS after FROM s)
SELECT video, unnest(range(slot, coalesce(after, slot + 1))) AS slot, n FROM l""")
def frames_at_rate(spark, d):
    t = table(spark, d, "events").select(F.col("user_id").alias("video"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("n"), ((F.col("event_id") % 50).cast("double") / 50).alias("part"))
    return readers.at_rate(t.select("video", "n", ((F.col("n") + F.col("part")) / 6).alias("t")), 2.5, "video")


class Spread(plugins.FrameOperator):
    """How far apart the sharpness and the contrast of a frame are; a frame without them fails."""

    name, columns = "spread", ("sharpness", "contrast")

    def execute(self, frame, found):
        if frame["sharpness"] != frame["sharpness"] or frame["contrast"] != frame["contrast"]:
            raise ValueError("no sharpness or contrast")
        return plugins.Result({"spread": abs(frame["sharpness"] - frame["contrast"]), "low": min(frame["sharpness"], frame["contrast"])})


class Graded(plugins.FrameOperator):
    """A grade from what the others found."""

    name, last = "graded", True

    def execute(self, frame, found):
        return plugins.Result({"grade": found["low"] // 10}) if "low" in found else plugins.Result({}, "nothing to grade")


for _o in (Spread(), Graded()):
    if _o.name not in plugins.OPERATORS:
        plugins.add(_o)


@query("plugin_results", f"""{with_('frames')} SELECT filename, abs(sharpness_score - contrast_score) AS spread, floor(least(sharpness_score, contrast_score) / 10) AS grade,
CASE WHEN sharpness_score IS NULL OR contrast_score IS NULL THEN 2 ELSE 0 END AS errors FROM frames""")
def plugin_results(spark, d):
    t = adapted(spark, d, "frames").select("filename", F.col("metrics.sharpness_score").alias("sharpness"), F.col("metrics.contrast_score").alias("contrast"))
    out = plugins.execute(t, ["graded", "spread"], "filename", wait=0.0)
    return out.select("filename", F.col("metrics")["spread"].alias("spread"), F.col("metrics")["grade"].alias("grade"), F.size("errors").alias("errors"))


_T = with_("tracks")


@query("conditioning_first", f"""{_T}, e AS (SELECT DISTINCT video_id, frame, frame % 9 = 4 AS c FROM tracks), x AS (SELECT a.video_id, a.frame, b.frame AS cond FROM e a JOIN e b ON a.video_id = b.video_id AND NOT a.c AND b.c),
k AS (SELECT *, coalesce(min(cond) FILTER (cond < frame) OVER w, max(cond) OVER w) AS one, max(cond) FILTER (cond < frame) OVER w AS low, min(cond) FILTER (cond > frame) OVER w AS high FROM x WINDOW w AS (PARTITION BY video_id, frame)),
r AS (SELECT video_id, frame, cond, row_number() OVER (PARTITION BY video_id, frame ORDER BY CASE WHEN cond = one THEN -1 WHEN cond = low THEN 0 WHEN cond = high THEN 1 ELSE 2 END, abs(cond - frame), cond) AS rank FROM k)
SELECT video_id, frame, cond, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""")
def conditioning_first(spark, d):
    t = adapted(spark, d, "tracks").select("video_id", "frame").distinct().withColumn("conditioning", F.col("frame") % 9 == 4)
    return joins.nearest_conditioning(t, 3, keep_first=True)


@query("rotated_scaled", f"""{with_('detections')}, b AS (SELECT image_id, idx, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS w, y2 - y1 AS h, CAST(idx * 37 % 180 - 90 AS DOUBLE) AS a FROM detections)
SELECT image_id, idx, {near_sql('w * sqrt((2 * cos(radians(a))) ** 2 + (0.5::DOUBLE * sin(radians(a))) ** 2)', 4)} AS w, {near_sql('h * sqrt((2 * sin(radians(a))) ** 2 + (0.5::DOUBLE * cos(radians(a))) ** 2)', 4)} AS h, {near_sql('degrees(atan2(sin(radians(a)) * 2, cos(radians(a)) * 0.5::DOUBLE))', 4)} AS angle,
cx - abs(cos(radians(a))) * w / 2 - abs(sin(radians(a))) * h / 2 >= -0.37 AND cy - abs(cos(radians(a))) * h / 2 - abs(sin(radians(a))) * w / 2 >= -0.37 AS fits FROM b""")
def rotated_scaled(spark, d):
    """Turned boxes stretched with their picture, and whether they stand in it."""
    t = adapted(spark, d, "detections")
    box = ((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), (F.col("idx") * 37 % 180 - 90).cast("double"))
    _, _, w, h, angle = rotated.scaled(*box, 2.0, 0.5)
    return t.select("image_id", "idx", near(w, 4).alias("w"), near(h, 4).alias("h"), near(angle, 4).alias("angle"), rotated.inside(*box, 1e9, 1e9, 0.37).alias("fits"))


_EVENTS = """SELECT user_id AS item, CAST(event_id AS DOUBLE) / 4 AS moment, CASE event_id * 7 % 11 WHEN 0 THEN 'added' WHEN 1 THEN 'failed' WHEN 2 THEN 'failed' WHEN 3 THEN 'failed' WHEN 4 THEN 'completed' WHEN 5 THEN 'cancelled' WHEN 6 THEN 'progress' WHEN 7 THEN 'progress' ELSE 'started' END AS event,
CASE WHEN event_id * 7 % 11 IN (6, 7) THEN CAST(event_id % 100 AS DOUBLE) / 100 END AS fraction, CASE WHEN event_id * 7 % 11 = 7 THEN concat('step ', event_id % 9) END AS message FROM events"""
_LOG = f"""WITH e AS ({_EVENTS}), l AS (SELECT *, sum(CASE WHEN event = 'added' THEN 1 ELSE 0 END) OVER (PARTITION BY item ORDER BY moment, event) AS life FROM e),
f AS (SELECT *, sum(CASE WHEN event = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY item, life ORDER BY moment, event) AS failures FROM l),
o AS (SELECT *, coalesce(bool_or(event IN ('completed', 'cancelled') OR failures >= 3) OVER (PARTITION BY item, life ORDER BY moment, event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM f),
t AS (SELECT *, CASE WHEN event = 'failed' AND failures >= 3 THEN 'failed' WHEN event = 'added' THEN 'pending' WHEN event IN ('completed', 'cancelled') THEN event ELSE 'processing' END AS status,
 CASE WHEN event = 'failed' AND failures < 3 THEN moment + 1.5 END AS retry_at, CASE WHEN event = 'failed' AND failures < 3 THEN concat('Retrying... (', failures, '/3)') WHEN event = 'started' THEN coalesce(message, 'Starting...') ELSE message END AS own FROM o WHERE NOT over),
u AS (SELECT *, coalesce(last_value(fraction IGNORE NULLS) OVER w, 0.0) AS progress, coalesce(last_value(own IGNORE NULLS) OVER w, 'Waiting...') AS text,
 CASE WHEN status = 'processing' THEN 1 ELSE 0 END - coalesce(lag(CASE WHEN status = 'processing' THEN 1 ELSE 0 END) OVER (PARTITION BY item ORDER BY moment, event), 0) AS step FROM t WINDOW w AS (PARTITION BY item, life ORDER BY moment, event ROWS UNBOUNDED PRECEDING)),
log AS MATERIALIZED (SELECT *, sum(step) OVER (ORDER BY moment RANGE UNBOUNDED PRECEDING) AS running FROM u)"""


def _log(spark, d):
    events = spark.sql(_EVENTS.replace("FROM events", "FROM {events}"), events=table(spark, d, "events")).withColumnRenamed("moment", "at")
    return state.queue_log(events, delay=1.5)


@query("queue_log", f'{_LOG} SELECT item, moment AS "at", event, status, CAST(failures AS BIGINT) AS failures, retry_at, progress, text, CAST(running AS BIGINT) AS running FROM log')
def queue_log(spark, d):
    return _log(spark, d).select("item", "at", "event", "status", "failures", "retry_at", "progress", "text", "running")


@query("queue_snapshots", f"""{_LOG}, s AS (SELECT *, lead(moment) OVER (PARTITION BY item ORDER BY moment, event) AS until FROM log)
SELECT CAST(i * 200 AS DOUBLE) AS snapshot, item, status, progress, text FROM s JOIN range(1, 8) r(i) ON moment <= i * 200 AND (until IS NULL OR until > i * 200)""")
def queue_snapshots(spark, d):
    times = spark.range(1, 8).select((F.col("id") * 200).cast("double").alias("snapshot"))
    return state.queue_snapshots(_log(spark, d), times)


@query("prepared_tracks", f"""{_T}, t AS (SELECT video_id, track_id, category_id, max(score) AS score, coalesce(avg(CASE WHEN frame % 3 <> 0 AND track_id % 2 = 0 AND w > 70 THEN w + h END), avg(CASE WHEN frame % 3 <> 0 THEN w * h END), 0.0) AS area FROM tracks GROUP BY ALL)
SELECT video_id, category_id, track_id, {near_sql('area')} AS area, score, CAST(row_number() OVER (PARTITION BY video_id, category_id ORDER BY score DESC, track_id) - 1 AS INT) AS place FROM t""")
def prepared_tracks(spark, d):
    there = F.col("frame") % 3 != 0
    t = adapted(spark, d, "tracks")
    t = t.withColumns({"area": F.when(there & (F.col("track_id") % 2 == 0), F.when(F.col("w") > 70, F.col("w") + F.col("h")).otherwise(0.0)), "w": F.when(there, F.col("w")), "h": F.when(there, F.col("h"))})
    return training.prepared_tracks(t).withColumn("area", near(F.col("area")))


@query("open_world_subset", f"{_T}, g AS (SELECT video_id, frame FROM tracks WHERE track_id % 2 = 0 AND category_id = 3 GROUP BY ALL) SELECT video_id, frame, track_id FROM tracks JOIN g USING (video_id, frame) WHERE track_id % 2 = 1")
def open_world_subset(spark, d):
    """Tracks of frames that hold a truth of an unknown class."""
    t = adapted(spark, d, "tracks")
    _, left = datasets.subset(t.filter("track_id % 2 = 0"), t.filter("track_id % 2 = 1"), ["video_id", "frame"], "unknown", [0, 1], [2])
    return left.select("video_id", "frame", "track_id")


@query("most_a_frame", f"""{with_('detections')}, q AS (SELECT image_id AS datapoint, f AS frame, idx * 10 + f AS query, conf > 0.6 AS positive FROM detections, range(2) r(f)),
p AS (SELECT *, row_number() OVER (PARTITION BY datapoint, frame ORDER BY query) AS place FROM q), n AS (SELECT *, max(place) OVER (PARTITION BY datapoint) > 3 AS large FROM p),
k AS (SELECT datapoint, place, row_number() OVER (PARTITION BY datapoint ORDER BY positive DESC, md5('4:' || datapoint || ':' || place)) AS k FROM n WHERE frame = 0)
SELECT datapoint, CAST(frame AS INT) AS frame, query FROM n JOIN k USING (datapoint, place) WHERE NOT large OR k <= 3""")
def most_a_frame(spark, d):
    t = adapted(spark, d, "detections").withColumn("frame", F.explode(F.array(F.lit(0), F.lit(1))))
    objects = F.when(F.col("conf") > 0.6, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    t = t.select(F.col("image_id").alias("datapoint"), "frame", (F.col("idx") * 10 + F.col("frame")).cast("long").alias("query"), objects.alias("objects"))
    return datasets.most_a_frame(t, 3, positives=True, seed=4).select("datapoint", "frame", "query")
