"""Row-wise transforms of datapoints, queries, boxes, keypoints and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import boxes as B

# Query filters: whether a query (text, n_objects, area, is_semantic, exhaustive, n_crowd ...) stays.


def has_text(texts: list[str], keep: bool = True) -> Column:
    found = F.lower("text").isin([t.lower() for t in texts])
    return found if keep else ~found


def not_semantic() -> Column:
    return ~F.coalesce("is_semantic", F.lit(False))


def not_too_many(most: int) -> Column:
    return F.col("n_objects") <= most


def has_area(least: float = 1e-6) -> Column:
    """Every target box has an area."""
    return ~F.exists("boxes", lambda b: (b[2] <= least) | (b[3] <= least))


def not_empty(least: float = 1e-6) -> Column:
    return F.coalesce(F.aggregate("boxes", F.lit(0.0), lambda a, b: a + b[2] * b[3]), F.lit(0.0)) > least


def exhaustive() -> Column:
    return F.coalesce("is_exhaustive", F.lit(True))


def without_crowds() -> Column:
    return F.coalesce("n_crowd", F.lit(0)) == 0


def valid_geometry(width: float, height: float) -> Column:
    """Every box (x, y, w, h) lies in the image."""
    return F.forall("boxes", lambda b: (b[0] >= 0) & (b[1] >= 0) & (b[0] + b[2] <= width) & (b[1] + b[3] <= height))


def at_most(queries: DataFrame, most: int, by: list[str], seed: int = 0) -> DataFrame:
    """At most so many queries of each group, chosen by a hash."""
    w = Window.partitionBy(*by).orderBy(F.xxhash64(*by, "query", F.lit(seed)), "query")
    return queries.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most).drop("k")


def reworded(text: Column, prefix: str = "", suffix: str = "", replace: dict[str, str] | None = None) -> Column:
    """A query's text in other words."""
    for a, b in (replace or {}).items():
        text = F.when(text == a, b).otherwise(text)
    return F.concat(F.lit(prefix), text, F.lit(suffix))


def visual(text: Column, box: Column, on: Column, dropped: Column) -> tuple[Column, Column]:
    """A query's text and box: where `on`, the text asks for what the box shows, and the box may be dropped."""
    return F.when(on, F.lit("visual")).otherwise(text), F.when(~(on & dropped), box)


# Boxes under image transforms; a box without area afterwards is to be dropped (see has_size).


def flipped(b: B.Box, width: Column) -> B.Box:
    return width - b[2], b[1], width - b[0], b[3]


def resized(b: B.Box, sx: Column, sy: Column) -> B.Box:
    return b[0] * sx, b[1] * sy, b[2] * sx, b[3] * sy


def padded(b: B.Box, left: float, top: float) -> B.Box:
    return b[0] + left, b[1] + top, b[2] + left, b[3] + top


def cropped(b: B.Box, x: float, y: float, width: float, height: float) -> B.Box:
    """A box in the coordinates of a crop, cut at its edges."""
    return B.clip((b[0] - x, b[1] - y, b[2] - x, b[3] - y), width, height)


def has_size(b: B.Box) -> Column:
    return (b[2] > b[0]) & (b[3] > b[1])


def jittered(b: B.Box, key: Column, most: float, width: float, height: float, seed: int = 0) -> B.Box:
    """Each side moved by up to a share of the box's size, by a hash of key; cut at the frame."""
    w, h = b[2] - b[0], b[3] - b[1]
    u = lambda i: F.pmod(F.xxhash64(key, F.lit(seed * 4 + i)), F.lit(1 << 20)) / float(1 << 20) * 2 - 1
    return B.clip(tuple(s + u(i) * most * (w if i % 2 == 0 else h) for i, s in enumerate(b)), width, height)


def zoom(b: B.Box, margin: float, width: float, height: float) -> B.Box:
    """The square around a box with a margin, cut at the frame."""
    cx, cy = B.centre(b)
    half = F.greatest(b[2] - b[0], b[3] - b[1]) * (1 + margin) / 2
    return B.clip((cx - half, cy - half, cx + half, cy + half), width, height)


def heatmap_cell(x: Column, y: Column, b: B.Box, size: int) -> tuple[Column, Column]:
    """The cell of a grid over a box that a point is in; null outside it."""
    inside = B.holds(b, x, y, closed=True)
    cell = lambda v, lo, hi: F.least(F.floor((v - lo) * size / (hi - lo)), F.lit(size - 1)).cast("int")
    return F.when(inside, cell(x, b[0], b[2])), F.when(inside, cell(y, b[1], b[3]))


def heatmap_point(i: Column, j: Column, b: B.Box, size: int) -> tuple[Column, Column]:
    """The point in the middle of a cell."""
    return b[0] + (i + 0.5) * (b[2] - b[0]) / size, b[1] + (j + 0.5) * (b[3] - b[1]) / size


# Predictions.


def scaled_predictions(raw: DataFrame, threshold: float) -> DataFrame:
    """Detections over a score from relative centre boxes (cx, cy, bw, bh) and image sizes."""
    x1, y1, x2, y2 = B.from_cxcywh(*(F.col(c) for c in ("cx", "cy", "bw", "bh")))
    w, h = F.col("width"), F.col("height")
    out = raw.filter(F.col("score") > threshold)
    return out.select("image_id", "score", *[v.alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (x1 * w, y1 * h, x2 * w, y2 * h), strict=True)])


def best_of_masks(candidates: DataFrame, key: str = "object_id") -> DataFrame:
    """Of each object the candidate of greatest overlap; where all are 0, of greatest score."""
    none = F.max("iou").over(Window.partitionBy(key)) <= 0
    ranked = candidates.withColumn("value", F.when(none, F.col("score")).otherwise(F.col("iou")))
    return ranked.groupBy(key).agg(F.max_by("idx", F.struct("value", -F.col("idx"))).alias("idx"))


def gated(mask: Column, score: Column, least: float) -> Column:
    """A mask whose score is high enough, else null."""
    return F.when(score >= least, mask)


def mask_state(area_pct: Column, least: float) -> tuple[Column, Column]:
    """Whether a mask is empty, and its error."""
    empty = F.coalesce(area_pct, F.lit(0.0)) < least
    return empty, F.when(empty, "Empty mask")


def top_k_accuracy(rows: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Percent of rows (an array of ranked classes, and the true one) whose class is among the first k."""
    return rows.agg(*[(100.0 * F.avg(F.array_contains(F.slice("ranked", 1, k), F.col("label")).cast("double"))).alias(f"top_{k}") for k in ks])


def segment_scores(rows: DataFrame, key: str = "category_id") -> DataFrame:
    """Dice and IoU by class from pixel counts (both, predicted, true), and over them their mean."""
    t = rows.groupBy(key).agg(F.sum("both").alias("i"), F.sum("predicted").alias("p"), F.sum("true").alias("t"))
    return t.select(key, F.try_divide(2 * F.col("i"), F.col("p") + F.col("t")).alias("dice"), F.try_divide(F.col("i"), F.col("p") + F.col("t") - F.col("i")).alias("iou"))


def mask_losses(rows: DataFrame, logits: str, truth: str, told: str | None = None) -> DataFrame:
    """rows with dice and, with `told` (the overlap that a model claims), iou_loss: of predicted logits and truths of 0 and 1, arrays of one length.

    dice: one less the softened overlap of the logistic of the logits with the truth, one added to both sides. iou_loss: the
    squared error of the claim against the overlap of what is over 0."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    p = F.transform(logits, lambda x: 1 / (1 + F.exp(-x)))
    out = rows.withColumn("__p", p)
    hit = total(F.zip_with("__p", truth, lambda a, b: a * b))
    out = out.withColumn("dice", 1 - (2 * hit + 1) / (total("__p") + total(F.transform(truth, lambda x: x.cast("double"))) + 1)).drop("__p")
    if told is None:
        return out
    both = total(F.zip_with(logits, truth, lambda a, b: ((a > 0) & (b > 0)).cast("double")))
    any_ = total(F.zip_with(logits, truth, lambda a, b: ((a > 0) | (b > 0)).cast("double")))
    return out.withColumn("iou_loss", F.pow(F.col(told) - both / F.greatest(any_, F.lit(1.0)), 2))


def mean_iou(pairs: DataFrame, group: list[str]) -> DataFrame:
    """group, miou: of pixel counts of pairs of masks (met, either, true) the sum of overlaps over the number of truths that have any pixel; 1 without such."""
    some = F.count_if(F.col("true") > 0)
    return pairs.groupBy(*group).agg(F.when(some == 0, 1.0).otherwise(F.sum(F.col("met") / (F.col("either") + 1e-8)) / some).alias("miou"))


def reduced(rows: DataFrame, keys: list[str], how: str, value: str) -> DataFrame:
    """Values of many workers as one: mean, sum, min or max."""
    return rows.groupBy(*keys).agg({"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[how](value).alias(value))


def perfect_rates(counts: DataFrame) -> DataFrame:
    """Share of images with truths, and of those without, that are right throughout, by threshold."""
    right = (F.col("fp") == 0) & (F.col("fn") == 0)
    pos = F.col("n_gt") > 0
    return counts.groupBy("threshold").agg(F.avg(F.when(pos, right.cast("double"))).alias("perfect_pos"), F.avg(F.when(~pos, right.cast("double"))).alias("perfect_neg"))
