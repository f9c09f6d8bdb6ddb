"""Masks and keypoints that come from coarse planes: masks from prototypes, masks cut to boxes, keypoints from heatmaps.

Planes are large, so each travels once, with all that belongs to it; results are runs (operators.runs) or a few numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions.groups import Arrays, per_group
from framelake.functions.pixels import column_runs
from framelake.functions.resize import cubic, region, resized
from framelake.operators.contours import drawn

# A pixel is on from here on.
ON = 0.5


def unboxed(detections: DataFrame) -> DataFrame:
    """detections (cx, cy, bw, bh in a padded, scaled square; scale, pad_left, pad_top; width, height of the frame) with x1, y1, x2, y2 in the frame, whole numbers."""
    at = lambda centre, size, sign, pad, most: F.greatest(F.lit(0.0), F.least((F.col(centre) + sign * F.col(size) / 2 - F.col(pad)) / F.col("scale"), F.col(most).cast("double"))).cast("int")
    return detections.withColumns({"x1": at("cx", "bw", -1, "pad_left", "width"), "y1": at("cy", "bh", -1, "pad_top", "height"), "x2": at("cx", "bw", 1, "pad_left", "width"), "y2": at("cy", "bh", 1, "pad_top", "height")})


def prototype_masks(detections: DataFrame, prototypes: DataFrame, side: int, key: str = "image_id") -> DataFrame:
    """Runs (key, idx, x, lo, hi) of the masks that detections make of their image's prototype planes.

    detections: key, idx, cx, cy, bw, bh in a square of `side`, coefficients, width and height of the frame. prototypes: key,
    planes, rows, columns, values (float32 bytes). A mask is the logistic of the weighted sum of the planes, 0 outside the
    detection's box, at the frame's size. A detection without a pixel, or without planes, gives no row."""
    kind = dict(detections.dtypes)[key]
    fields = ("idx", "cx", "cy", "bw", "bh", "coefficients", "width", "height")
    each = detections.groupBy(key).agg(F.collect_list(F.struct(*fields)).alias("d"))
    rows = prototypes.select(key, "planes", "rows", "columns", "values").join(each, key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                name, found = getattr(r, key), list(r.d)
                planes = np.frombuffer(r.values, np.float32).reshape(r.planes, r.rows * r.columns)
                soft = 1 / (1 + np.exp(-(np.array([d["coefficients"] for d in found], np.float64) @ planes)))
                for d, s in zip(found, soft.reshape(-1, r.rows, r.columns)):
                    cut = lambda v, n: int(np.clip(v * n / side, 0, n))
                    x1, x2 = (cut(d["cx"] + k * d["bw"] / 2, r.columns) for k in (-1, 1))
                    y1, y2 = (cut(d["cy"] + k * d["bh"] / 2, r.rows) for k in (-1, 1))
                    own = np.zeros_like(s)
                    own[y1:y2, x1:x2] = s[y1:y2, x1:x2]
                    x, lo, hi = column_runs(resized(own, d["height"], d["width"]) > ON)
                    yield pd.DataFrame({key: name, "idx": d["idx"], "x": x, "lo": lo, "hi": hi})

    return rows.mapInPandas(run, f"{key} {kind}, idx int, x int, lo int, hi int")


def cut_masks(runs: DataFrame, boxes: DataFrame, size: int, key: str = "mask_id") -> DataFrame:
    """key, mask (array of size * size booleans, by rows): each mask cut to its box (key, x1, y1, x2, y2) and resized, on where half of a cell is."""
    kind = dict(runs.dtypes)[key]
    rows = runs.select(key, "x", "lo", "hi").join(boxes.select(key, "x1", "y1", "x2", "y2"), key)

    def run(a: Arrays) -> Arrays:
        # Two off pixels around a mask: a sample that meets it has all its neighbours here.
        on, left, top = drawn(a["x"], a["lo"], a["hi"], pad=2)
        x1, y1, x2, y2 = (float(a[c][0]) for c in ("x1", "y1", "x2", "y2"))
        wide = np.pad(on, ((max(0, top - int(y1) + 2), max(0, int(y2) + 2 - top - on.shape[0])), (max(0, left - int(x1) + 2), max(0, int(x2) + 2 - left - on.shape[1]))))
        left, top = left - max(0, left - int(x1) + 2), top - max(0, top - int(y1) + 2)
        cells = region(wide.astype(np.float64), (x1 - left, y1 - top, x2 - left, y2 - top), size) >= ON
        out = np.empty(1, object)
        out[0] = cells.ravel().tolist()
        return {key: a[key][:1], "mask": out}

    return per_group(rows, [key], ["x", "lo"], f"{key} {kind}, mask array<boolean>", run)


def keypoints(maps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, y, logit, score: where each heatmap (side, values by rows; box x1, y1, x2, y2) is highest, at the box's own size.

    The score is the height as a share of all cells, so that boxes of different sizes compare."""
    kinds = dict(maps.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                side = int(r.side)
                cells = np.asarray(r.values_, np.float64).reshape(side, side)
                w, h = max(r.x2 - r.x1, 1.0), max(r.y2 - r.y1, 1.0)
                wide, high = int(np.ceil(w)), int(np.ceil(h))
                fine = resized(cells, high, wide, cubic)
                y, x = divmod(int(fine.argmax()), wide)
                top = fine[y, x]
                out.append((r.x1 + (x + 0.5) * w / wide, r.y1 + (y + 0.5) * h / high, top, 1.0 / np.exp(cells - top).sum()))
            made = pd.DataFrame(out, columns=["x", "y", "logit", "score"], dtype="float64")
            yield pd.concat([pdf[keys].reset_index(drop=True), made], axis=1)

    rows = maps.select(*keys, "side", F.col("values").alias("values_"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    return rows.mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "x double, y double, logit double, score double"]))
