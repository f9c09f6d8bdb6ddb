"""Readers: frame tables, sessions, annotation files, tracking text, image folders, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values.
JPEG = ("jpg", "jpeg")
RAW = ("cr2", "cr3", "nef", "arw", "dng", "orf", "rw2", "raf")
IMAGES = ("png", "jpg", "jpeg", "webp", "bmp", "tiff")

COCO = (
    "images array<struct<id: bigint, file_name: string, width: int, height: int>>, "
    "annotations array<struct<id: bigint, image_id: bigint, category_id: int, bbox: array<double>, area: double, iscrowd: int, noun_phrase: string>>, "
    "categories array<struct<id: int, name: string, supercategory: string>>"
)


def frames(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A frame table whose leftover metrics are a JSON column: its values win over columns of the same name."""
    df = spark.read.parquet(path)
    if "extra_json" not in df.columns:
        return df
    extra = F.from_json("extra_json", schema or "map<string,string>")
    return df.withColumn("extra", extra).drop("extra_json")


def flattened(df: DataFrame, json_column: str, keys: dict[str, str]) -> DataFrame:
    """df with each key (and its type) read from a JSON column, else from the column of that name."""
    parsed = F.from_json(json_column, ", ".join(f"`{k}` {t}" for k, t in keys.items()))
    out = df.withColumn("__json", parsed)
    for k in keys:
        out = out.withColumn(k, F.coalesce(F.col("__json")[k], F.col(k)) if k in df.columns else F.col("__json")[k])
    return out.drop("__json")


def coco(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """images, annotations and categories of an annotation file, one table each."""
    whole = spark.read.schema(COCO).json(path, multiLine=True)
    return {k: whole.select(F.explode(k).alias("r")).select("r.*") for k in ("images", "annotations", "categories")}


def annotation_lists(spark: SparkSession, path: str) -> DataFrame:
    """path, name, n: the lists at the top of each annotation file. Files are parsed where they are read, as variants."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.parse_json("value").alias("v"))
    found = whole.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("path", F.col("key").alias("name"), F.col("value").alias("v"))
    return found.filter(F.schema_of_variant("v").startswith("ARRAY")).select("path", "name", F.size(F.variant_get("v", "$", "array<variant>")).alias("n"))


def annotation_rows(spark: SparkSession, path: str, name: str, fields: dict[str, str]) -> DataFrame:
    """path and the fields (name: type) of the entries of one top-level list of all annotation files of a path.

    A field may be a path of names with dots; one that is missing, or of another type, is null. Entries that are a plain
    value, as in a list of names, are the field "value". A file without the list gives no row."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.parse_json("value").alias("v"))
    rows = whole.select("path", F.explode(F.try_variant_get("v", f"$.{name}", "array<variant>")).alias("r"))
    return rows.select("path", *[F.try_variant_get("r", "$" if f == "value" else f"$.{f}", t).alias(f.replace(".", "_")) for f, t in fields.items()])


def session_config(spark: SparkSession, folder: str, name: str = "run_config.json") -> DataFrame:
    """One row: config (a map of texts) of a session's folder, or the error that says why there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder, name)
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return spark.range(1).select(F.lit(None).cast("map<string,string>").alias("config"), F.lit(f"{name} is not in {folder}").alias("error"))
    read = spark.read.text(f"{folder.rstrip('/')}/{name}", wholetext=True).withColumn("config", F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"}))
    fine = F.try_parse_json("value").isNotNull() & F.col("config").isNotNull()
    return read.select(F.when(fine, F.col("config")).alias("config"), F.when(~fine, f"{name} is invalid").alias("error"))


def scenes(spark: SparkSession, path: str, of: tuple[str, ...] = ()) -> DataFrame:
    """shot_id, start_frame, end_frame of a JSON list of pairs, a file a video. of: columns that the folders' names give, as video=7."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(*of, F.posexplode(F.from_json("value", "array<array<int>>")).alias("shot_id", "p"))
    return pairs.select(*of, "shot_id", F.col("p")[0].alias("start_frame"), F.col("p")[1].alias("end_frame"))


def image_folder(spark: SparkSession, path: str, recursive: bool = False, content: bool = False) -> DataFrame:
    """path, kind (jpeg, raw or other image), length, and the bytes if asked for."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(suffix.isin(*JPEG), "jpeg").when(suffix.isin(*RAW), "raw").when(suffix.isin(*IMAGES), "image")
    df = df.withColumn("kind", kind).filter("kind is not null")
    return df.select("path", "kind", "length", *(["content"] if content else []))


def tracking_text(spark: SparkSession, path: str, delimiter: str = ",", columns: tuple[str, ...] = ("t", "ident", "x", "y", "w", "h", "score", "category_id"), valid: dict[str, list] | None = None, crowd: tuple[str, list] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of delimited tracking text, and those to be ignored: rows outside `valid` values are left out, rows with a crowd value set apart."""
    schema = ", ".join(f"{c} {'int' if c in ('t', 'ident', 'category_id') else 'double'}" for c in columns)
    df = spark.read.csv(path, schema=schema, sep=delimiter)
    for c, values in (valid or {}).items():
        df = df.filter(F.col(c).isin(values))
    if not crowd:
        return df, df.limit(0)
    ignored = F.coalesce(F.col(crowd[0]).isin(crowd[1]), F.lit(False))
    return df.filter(~ignored), df.filter(ignored)


def preview(candidates: DataFrame, least: int = 25 * 1024) -> DataFrame:
    """Of each file's embedded previews (path, priority, length) the first in priority that is large enough."""
    some = candidates.filter(F.col("length") > least)
    return some.groupBy("path").agg(F.min_by(F.struct(*[c for c in some.columns if c != "path"]), "priority").alias("p")).select("path", "p.*")


def selected_frames(frames_: DataFrame, method: str, every: int = 1) -> DataFrame:
    """Frames (n from 0, is_key) that an extraction method takes: keyframes, every_nth_frame, or all for any other."""
    if method == "keyframes":
        return frames_.filter("is_key")
    return frames_.filter(F.col("n") % every == 0) if method == "every_nth_frame" else frames_


def at_rate(frames_: DataFrame, fps: float, video: str | None = None) -> DataFrame:
    """Frames (n, t in seconds) at a constant rate: slot and n, a row a slot from each video's first to its last.

    A frame stands in the slot nearest its time. Of several in one slot the last is taken; a slot without any repeats the frame before."""
    keys = [video] if video else []
    t = frames_.withColumn("slot", F.floor(F.col("t") * fps + 0.5))
    t = t.groupBy(*keys, "slot").agg(F.max_by("n", F.struct("t", "n")).alias("n"))
    if not video:
        t = t.withColumn("__all", F.lit(0))
    after = F.lead("slot").over(Window.partitionBy(video or "__all").orderBy("slot"))
    return t.withColumn("after", after).select(*keys, F.explode(F.sequence("slot", F.coalesce(F.col("after") - 1, F.col("slot")))).alias("slot"), "n")


def progress_lines(lines: DataFrame, total_us: int) -> DataFrame:
    """The share done and whether it ended, from key=value lines in order of `at`."""
    kv = lines.select("at", F.split("value", "=", 2).alias("kv")).select("at", F.col("kv")[0].alias("k"), F.col("kv")[1].alias("v"))
    last = kv.agg(F.max_by(F.when(F.col("k") == "out_time_us", F.col("v").try_cast("long")), F.when(F.col("k") == "out_time_us", F.col("at"))).alias("us"), F.max((F.col("k") == "progress") & (F.col("v") == "end")).alias("ended"))
    return last.select(F.least(F.lit(1.0), F.coalesce(F.col("us"), F.lit(0)) / F.lit(total_us)).alias("fraction"), F.coalesce("ended", F.lit(False)).alias("ended"))


def logs(spark: SparkSession, path: str) -> DataFrame:
    """Log events of JSON lines; lines that are none are left out."""
    schema = "timestamp timestamp, level string, message string, component string, operation string, duration_ms double, error_type string, stack_trace string, context map<string,string>, _corrupt string"
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path).filter("timestamp is not null").drop("_corrupt")
