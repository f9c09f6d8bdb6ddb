"""Writers and the tables they write."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions.text import colour_label, star_rating

# Fixed value: columns that come first in an export.
FIRST = ("filename", "shot_id", "face_sim", "mask_area_pct", "quality_score", "error")
#: Schema versions: what each adds to the frame table.
MIGRATIONS: dict[int, dict[str, str]] = {1: {}, 2: {"error_severity": "string"}}


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the last in order: what repeated writes leave in a table with a unique key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def upsert(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """existing with the rows of new in place of those of the same key; columns of either."""
    fresh = latest(new, key, order)
    return existing.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def fold_unknown(rows: DataFrame, known: list[str], into: str = "extra_json") -> DataFrame:
    """rows with all columns but the known ones as one JSON column."""
    rest = sorted(c for c in rows.columns if c not in known)
    return rows.select(*[c for c in known if c in rows.columns], F.to_json(F.struct(*rest)).alias(into)) if rest else rows


def migrate(rows: DataFrame, version: int, to: int = max(MIGRATIONS)) -> tuple[DataFrame, list[int]]:
    """rows at a later schema version, and the versions applied; columns that are there already stay."""
    applied = [v for v in sorted(MIGRATIONS) if version < v <= to]
    for v in applied:
        for c, t in MIGRATIONS[v].items():
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast(t))
    return rows, applied


def ordered_columns(columns: list[str], first: tuple[str, ...] = FIRST) -> list[str]:
    return [c for c in first if c in columns] + sorted(c for c in columns if c not in first)


def export(rows: DataFrame, path: str, kind: str = "json") -> None:
    """rows as JSON lines or CSV with a header, the usual columns first."""
    out = rows.select(*ordered_columns(rows.columns))
    if kind == "csv":
        out.write.mode("overwrite").option("header", True).csv(path)
    else:
        out.write.mode("overwrite").json(path)


def dry_run(kept: DataFrame, rejected: DataFrame, target: str) -> DataFrame:
    """One row: how many frames would go where."""
    k, r = kept.agg(F.count("*").alias("kept")), rejected.agg(F.count("*").alias("rejected"))
    return k.join(r).withColumn("plan", F.format_string(f"%d of %d frames to {target}", F.col("kept"), F.col("kept") + F.col("rejected")))


def sidecars(photos: DataFrame) -> DataFrame:
    """path and XML text of each photo's sidecar: stars from the score, a colour from the status."""
    score = F.coalesce(F.col("quality_score"), F.lit(0.0))
    label = colour_label(F.col("status"))
    xml = F.concat(
        F.lit('<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmp:Rating="'),
        star_rating(score).cast("string"),
        F.lit('"'),
        F.coalesce(F.concat(F.lit(' xmp:Label="'), label, F.lit('"')), F.lit("")),
        F.lit("/></rdf:RDF></x:xmpmeta>"),
    )
    return photos.select(F.concat(F.regexp_replace("source", r"\.[^./]*$", ""), F.lit(".xmp")).alias("path"), xml.alias("xml"))


def scene_seeds(scenes: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One row a session: a JSON object of scenes by id."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("shot_id").cast("string"), F.struct(*fields)))))
    return scenes.groupBy("session_id").agg(F.to_json(entries).alias("json"))


def fingerprint(spark: SparkSession, path: str, size: int, mtime: float, settings_hash: str) -> DataFrame:
    return spark.createDataFrame([(path, size, mtime, settings_hash)], "video_path string, video_size long, video_mtime double, extraction_hash string")


def unchanged(saved: DataFrame, now: DataFrame, slack: float = 1.0) -> bool:
    """Whether a saved fingerprint is of the same file and settings; times may differ by less than the slack."""
    on = ["video_path", "video_size", "extraction_hash"]
    both = saved.join(now.withColumnRenamed("video_mtime", "now"), on).filter(F.abs(F.col("video_mtime") - F.col("now")) < slack)
    return both.limit(1).count() > 0


def histogram_svg(counts: list[int], width: int = 300, height: int = 100) -> str:
    """A bar chart of a histogram's counts."""
    top, n = max(counts, default=0) or 1, max(1, len(counts))
    bars = "".join(f'<rect x="{i * width / n:.1f}" y="{height - c * height / top:.1f}" width="{width / n:.1f}" height="{c * height / top:.1f}"/>' for i, c in enumerate(counts))
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}">{bars}</svg>'


def coco_predictions(detections: DataFrame) -> DataFrame:
    """image_id, category_id, bbox (x, y, w, h) and score: rows of a prediction dump."""
    return detections.select("image_id", "category_id", F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("bbox"), F.col("conf").alias("score"))


def cleared(rows: DataFrame) -> DataFrame:
    """No rows, with all columns: what a table is overwritten with to clear it."""
    return rows.limit(0)


def json_rows(rows: DataFrame) -> DataFrame:
    """Every row as one JSON text, nested values and binaries (as base64) included."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def score_tables(scores: DataFrame, path: str, by: str = "level") -> None:
    """A folder of one CSV with a header for all scores, and a text summary of a line each, both in order."""
    names = [c for c in scores.columns if c != by]
    ordered = scores.orderBy(by).coalesce(1)
    ordered.select(by, *names).write.mode("overwrite").option("header", True).csv(f"{path}/detailed")
    line = F.concat_ws(" ", F.rpad(F.col(by).cast("string"), 20, " "), *[F.format_string(f"{c}: %.3f", F.col(c).cast("double")) for c in names])
    ordered.select(line.alias("value")).write.mode("overwrite").text(f"{path}/summary")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file whole or not at all: beside its place first, then moved there. A file of that name is replaced."""
    jvm = spark._jvm
    hadoop = spark._jsparkSession.sessionState().newHadoopConf()
    target = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else jvm.java.net.URI("file:///"), hadoop)
    fs = target.getFileSystem(hadoop)
    try:
        out = fs.create(beside)
        out.write(bytearray(text.encode()))
        out.close()
        # One step for readers: they see the old file or the new one.
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        files.rename(fs.makeQualified(beside), fs.makeQualified(target), options)
    finally:
        fs.delete(beside, False)
