"""Suppression and association of masks. Masks are arrays of words (functions.masks). For suppression overlaps are computed in the
JVM, and only pairs that overlap enough reach the greedy choice of a group; detections and tracks meet in batches of images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import masks as M
from framelake.functions.assign import CELLS, assign_many
from framelake.functions.groups import Arrays, both_sides, per_batch, per_group, side_pairs

# Overlaps that match a detection to a track, and a track to its detection; the score of a new one.
MATCH, MATCH_TRACK, NEW = 0.5, 0.5, 0.5


def greedy_pairs(rows: DataFrame, near: DataFrame, group: str, item: str, score: str) -> DataFrame:
    """rows (group, item, score) with kept: best score first, equal ones by item; one goes if it is near a kept one.

    near: pairs (group, a, b) of items, once each."""
    both = near.select(group, F.col("a").alias(item), F.col("b").alias("other")).unionByName(near.select(group, F.col("b").alias(item), F.col("a").alias("other")))
    lists = rows.select(group, item, score).join(both.groupBy(group, item).agg(F.collect_list("other").alias("others")), [group, item], "left")
    lists = lists.withColumn("back", -F.col(score).cast("double"))

    def run(a: Arrays) -> Arrays:
        gone: set = set()
        kept = np.ones(len(a[item]), bool)
        for k, (i, others) in enumerate(zip(a[item].tolist(), a["others"], strict=True)):
            kept[k] = i not in gone
            if kept[k] and others is not None:
                gone.update(others)
        return {group: a[group], item: a[item], "kept": kept}

    kinds = dict(rows.dtypes)
    kept = per_group(lists, [group], ["back", item], f"{group} {kinds[group]}, {item} {kinds[item]}, kept boolean", run)
    return rows.join(kept, [group, item])


def _reach(rows: DataFrame, names: list[str], mask: str) -> DataFrame:
    """names, n, low, high: a mask's area and its first and last word with a pixel that is on; no row for an empty mask."""
    at = F.filter(F.transform(mask, lambda w, i: F.when(w != 0, i)), lambda i: i.isNotNull())
    return rows.select(*names, M.area(F.col(mask)).alias("n"), F.array_min(at).alias("low"), F.array_max(at).alias("high")).filter("n > 0")


def could_overlap(a: DataFrame, b: DataFrame, group: str, i: str, j: str, least: float) -> DataFrame:
    """Pairs (group, i, j) of two sides' masks (as of _reach) whose areas and words leave room for an overlap over `least`; no mask is moved."""
    x, y = (t.select(group, k, *[F.col(c).alias(f"{s}_{c}") for c in ("n", "low", "high")]) for t, k, s in ((a, i, "a"), (b, j, "b")))
    words = F.least("a_high", "b_high") - F.greatest("a_low", "b_low") + 1
    most = F.least(F.col("a_n"), F.col("b_n"), 64 * words.cast("long"))
    return x.join(y, group).filter((words > 0) & (most > least * (F.col("a_n") + F.col("b_n") - most))).select(group, i, j)


def suppress(rows: DataFrame, least_score: float, threshold: float, group: str = "image_id", item: str = "idx", score: str = "conf", mask: str = "mask") -> DataFrame:
    """Masks over a score with kept: one goes if it overlaps a kept one by more than the threshold."""
    some = rows.filter(F.col(score) > least_score)
    a, b = some.select(group, F.col(item).alias("a"), F.col(mask).alias("ma")), some.select(group, F.col(item).alias("b"), F.col(mask).alias("mb"))
    pairs = could_overlap(_reach(a, [group, "a"], "ma"), _reach(b, [group, "b"], "mb"), group, "a", "b", threshold).filter("a < b")
    near = pairs.join(a, [group, "a"]).join(b, [group, "b"]).filter(M.iou(F.col("ma"), F.col("mb")) > threshold).select(group, "a", "b")
    return greedy_pairs(some, near, group, item, score)


def _met(rows: pa.RecordBatch, left: np.ndarray, right: np.ndarray, mask: str) -> np.ndarray:
    """Overlaps of pairs of a batch's masks, by the words between the first and the last one with a pixel in both."""
    lists = rows.column(mask)
    words = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
    ends = lists.offsets.to_numpy()
    sums = np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64))
    n = sums[ends[1:]] - sums[ends[:-1]]
    # Places of words with a pixel; a mask's own are between those before its start and before its end.
    on = np.flatnonzero(words)
    lo, hi = np.searchsorted(on, ends[:-1]), np.searchsorted(on, ends[1:])
    low, high = np.zeros(len(n), np.int64), np.full(len(n), -1)
    some = np.flatnonzero(lo < hi)
    low[some], high[some] = on[lo[some]] - ends[some], on[hi[some] - 1] - ends[some]
    first = np.maximum(low[left], low[right])
    wide = np.maximum(np.minimum(high[left], high[right]) - first + 1, 0)
    i, done, k = np.zeros(len(left), np.int64), np.cumsum(wide), 0
    while k < len(left):
        e = max(k + 1, int(np.searchsorted(done, done[k] - wide[k] + CELLS, "right")))
        w = wide[k:e]
        at = np.cumsum(w) - w
        step = np.arange(w.sum()) + np.repeat(first[k:e] - at, w)
        x, y = (words[np.repeat(ends[side[k:e]], w) + step] for side in (left, right))
        part = np.append(0, np.cumsum(np.bitwise_count(x & y), dtype=np.int64))
        i[k:e] = part[at + w] - part[at]
        k = e
    return i / np.maximum(1, n[left] + n[right] - i)


def _together(dets: DataFrame, tracks: DataFrame, key: str, schema: str, fn: Callable[..., dict], whole: bool = False) -> DataFrame:
    """Rows of fn for detections (key, idx, conf, mask) and tracks (key, track_id, mask), each moved once, to its image.

    fn gets rows of many images, which of them are a block's detections, how many detections and tracks its groups have, and the
    rows of their pairs with the overlaps, by detection. A group is a detection, or a whole image."""
    # A mask without pixels need not be moved.
    mask = F.when(M.area(F.col("mask")) > 0, F.col("mask")).alias("mask")
    both = both_sides(dets.select(key, "idx", "conf", mask), tracks.select(key, "track_id", mask))

    def run(rows: pa.RecordBatch, starts: np.ndarray) -> Iterator[dict]:
        for _, own, n, m, left, right in side_pairs(rows.column("side").to_numpy(), starts, whole):
            yield fn(rows, own, n, m, left, right, _met(rows, left, right, "mask"))

    return per_batch(both, [key], ["side", "idx", "track_id"], schema, run)


def _pairs_schema(dets: DataFrame, tracks: DataFrame, key: str) -> str:
    d, t = dict(dets.dtypes), dict(tracks.dtypes)
    return f"{key} {d[key]}, idx {d['idx']}, conf {d['conf']}, track_id {t['track_id']}, iou double"


def _pairs(rows: pa.RecordBatch, key: str, left: np.ndarray, right: np.ndarray, iou: np.ndarray) -> dict:
    return {c: rows.column(c).take(pa.array(left)) for c in (key, "idx", "conf")} | {"track_id": rows.column("track_id").take(pa.array(right)), "iou": iou}


def overlaps(dets: DataFrame, tracks: DataFrame, key: str = "image_id") -> DataFrame:
    """key, idx, conf, track_id, iou: every detection with every track of its image."""
    return _together(dets, tracks, key, _pairs_schema(dets, tracks, key), lambda rows, own, n, m, left, right, iou: _pairs(rows, key, left, right, iou))


def new_detections(dets: DataFrame, tracks: DataFrame, key: str = "image_id", match: float = MATCH, new: float = NEW) -> DataFrame:
    """Detections (key, idx) that match no track and score enough; all of an image without tracks."""

    def best(rows: pa.RecordBatch, own: np.ndarray, n: np.ndarray, m: np.ndarray, left: np.ndarray, right: np.ndarray, iou: np.ndarray) -> dict:
        most = np.full(rows.num_rows, np.nan)  # no track to meet
        runs = np.flatnonzero(np.diff(left, prepend=-1))
        if len(runs):
            most[left[runs]] = np.maximum.reduceat(iou, runs)
        return {c: rows.column(c).take(pa.array(own)) for c in (key, "idx", "conf")} | {"best": most[own]}

    kinds = dict(dets.dtypes)
    t = _together(dets, tracks, key, f"{key} {kinds[key]}, idx {kinds['idx']}, conf {kinds['conf']}, best double", best)
    return t.filter(F.isnan("best") | (F.col("best") < match) & (F.col("conf") >= new)).select(key, "idx")


def matched_tracks(dets: DataFrame, tracks: DataFrame, key: str = "image_id", match: float = MATCH) -> DataFrame:
    """key, idx, tracks: of each detection all tracks that it matches, in order; many may match one."""
    return overlaps(dets, tracks, key).filter(F.col("iou") >= match).groupBy(key, "idx").agg(F.array_sort(F.collect_list("track_id")).alias("tracks"))


def assigned(dets: DataFrame, tracks: DataFrame, key: str = "image_id", match: float = MATCH_TRACK) -> DataFrame:
    """key, track_id, idx, score, weighted, matched: the detection that the best assignment of an image gives each track, its
    score, that times the overlap, and whether they overlap enough. Tracks without a row, or not matched, are unmatched."""

    def best(rows: pa.RecordBatch, own: np.ndarray, n: np.ndarray, m: np.ndarray, left: np.ndarray, right: np.ndarray, iou: np.ndarray) -> dict:
        on = assign_many(iou, n, m)
        return _pairs(rows, key, left[on], right[on], iou[on])

    out = _together(dets, tracks, key, _pairs_schema(dets, tracks, key), best, whole=True)
    return out.select(key, "track_id", "idx", F.col("conf").alias("score"), (F.col("conf") * F.col("iou")).alias("weighted"), (F.col("iou") >= match).alias("matched"))


def region_scores(pairs: DataFrame, group: str, a: Column, b: Column) -> DataFrame:
    """group, j: the mean overlap of predicted and true masks (rows of pairs; null for none, as an empty mask)."""
    empty = F.array().cast("array<bigint>")
    x, y = F.coalesce(a, empty), F.coalesce(b, empty)
    j = F.when((M.area(x) == 0) & (M.area(y) == 0), F.lit(1.0)).otherwise(M.iou(x, y))
    return pairs.groupBy(group).agg(F.avg(j).alias("j"))
