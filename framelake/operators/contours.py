"""Borders, centres and crops of masks that are rows of runs (operators.runs), a mask at a time on Arrow batches.

A mask is drawn in its own box, so a large frame with a small mask costs little. Everything over its pixels is whole-array
NumPy; nothing is traced pixel by pixel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.groups import Arrays, per_group
from framelake.functions.pixels import linked
from framelake.operators.runs import either, measured, minus
from framelake.operators.seeds import crop_plan

#: Along the top edge, the right, the bottom, the left: the pixel on the right hand is on, the one on the left is off.
STEPS = np.array([[1, 0], [0, 1], [-1, 0], [0, -1]])
#: From a pixel to the corner where its edge in each direction begins.
CORNERS = np.array([[0, 0], [1, 0], [1, 1], [0, 1]])


def drawn(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, values: np.ndarray | bool = True, pad: int = 1) -> tuple[np.ndarray, int, int]:
    """Runs as an array with a border of off pixels, and the frame's x and y of its first cell."""
    left, top = int(x.min()) - pad, int(lo.min()) - pad
    out = np.zeros((int(hi.max()) - top + pad, int(x.max()) - left + pad + 1), np.asarray(values).dtype)
    n = hi - lo
    rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo - top, n)
    out[rows, np.repeat(x - left, n)] = np.repeat(values, n) if np.ndim(values) else values
    return out, left, top


def loops(on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges between on and off pixels in the order of their closed paths: path number, direction, x, y of the on pixel.

    `on` has a border of off pixels. Where two on pixels meet at a corner only, the path goes over to the other one, so on
    pixels connect eight ways and holes four ways. Each edge has one successor; paths are found by doubling jumps."""
    edges = []
    number = np.full((4, *on.shape), -1)
    for d in range(4):
        dx, dy = STEPS[(d + 3) % 4]
        y, x = np.nonzero(on & ~np.roll(on, (-dy, -dx), (0, 1)))
        number[d, y, x] = np.arange(len(y)) + sum(len(e[1]) for e in edges)
        edges.append((np.full(len(y), d), x, y))
    d, x, y = (np.concatenate(c) for c in zip(*edges))
    ax, ay = x + STEPS[d, 0], y + STEPS[d, 1]
    left = (d + 3) % 4
    lx, ly = ax + STEPS[left, 0], ay + STEPS[left, 1]
    after = np.where(on[ly, lx], number[left, ly, lx], np.where(on[ay, ax], number[d, ay, ax], number[(d + 1) % 4, y, x]))
    path, jump = np.arange(len(d)), after
    for _ in range(max(1, int(len(d)).bit_length())):
        path, jump = np.minimum(path, path[jump]), jump[jump]
    stop = path[after] == after  # the next edge begins the path anew
    to_go, jump = np.where(stop, 0, 1), np.where(stop, np.arange(len(d)), after)
    for _ in range(max(1, int(len(d)).bit_length())):
        to_go, jump = to_go + to_go[jump], jump[jump]
    order = np.lexsort((-to_go, path))
    return np.unique(path[order], return_inverse=True)[1], d[order], x[order], y[order]


def _before(path: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each path starts and ends, and the edge before each along its closed path."""
    starts = np.flatnonzero(np.diff(path, prepend=-1))
    ends = np.concatenate([starts[1:], [len(path)]])
    before = np.arange(len(path)) - 1
    before[starts] = ends - 1
    return starts, ends, before


CONTOURS = "contour int, parent int, hole boolean, area double, edges long, pixels array<array<int>>, corners array<array<int>>"


def contours(runs: DataFrame, key: str = "mask_id") -> DataFrame:
    """key, contour, parent, hole, area, edges, pixels, corners: a row for each border of each mask, from the top left.

    A hole's parent is the outer border of its part; outer borders have none (-1). pixels: the on pixels along the border,
    clockwise, a hole's the other way. corners: the polygon between on and off pixels; its area has a hole's negative, and
    all polygons of a mask filled by the even-odd rule are the mask again."""
    kind = dict(runs.dtypes)[key]

    def run(a: Arrays) -> Arrays:
        part = linked(a["x"], a["lo"], a["hi"])
        label, left, top = drawn(a["x"], a["lo"], a["hi"], part + 1)
        path, d, x, y = loops(label > 0)
        starts, ends, before = _before(path)
        cx, cy = x + CORNERS[d, 0], y + CORNERS[d, 1]
        nx, ny = cx + STEPS[d, 0], cy + STEPS[d, 1]
        area = np.add.reduceat((cx * ny - nx * cy) / 2.0, starts)
        own = label[y[starts], x[starts]]
        outer = {int(l): i for i, (l, s) in enumerate(zip(own, area)) if s > 0}
        new_corner, new_pixel = d != d[before], (x != x[before]) | (y != y[before])
        new_pixel[starts] = True
        # A path that comes back to the pixel it began with does not name it again.
        last = np.maximum.reduceat(np.where(new_pixel, np.arange(len(path)), 0), starts)
        new_pixel[last[(last > starts) & (x[last] == x[starts]) & (y[last] == y[starts])]] = False
        px, pc = np.stack([x + left, y + top], 1), np.stack([cx + left, cy + top], 1)
        lists = lambda p, new: pd.Series([p[s:e][new[s:e]].tolist() for s, e in zip(starts, ends)]).to_numpy()
        n = len(starts)
        return {
            key: np.repeat(a[key][:1], n), "contour": np.arange(n), "parent": np.array([-1 if s > 0 else outer[int(l)] for l, s in zip(own, area)]), "hole": area < 0,
            "area": area, "edges": ends - starts, "pixels": lists(px, new_pixel), "corners": lists(pc, new_corner),
        }

    return per_group(runs.select(key, "x", "lo", "hi"), [key], ["x", "lo"], f"{key} {kind}, {CONTOURS}", run)


def polygons(borders: DataFrame, key: str = "mask_id", least: int = 3) -> DataFrame:
    """key, polygons (lists of x, y through the middles of border pixels), has_holes. Borders of fewer pixels give no polygon."""
    flat = F.flatten(F.transform("pixels", lambda p: F.transform(p, lambda v: v + F.lit(0.5))))
    return borders.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.size("pixels") >= least, F.struct("contour", flat.alias("p"))))).alias("p"), F.max("hole").alias("has_holes")).select(key, F.transform("p", lambda p: p["p"]).alias("polygons"), "has_holes")


def from_corners(borders: DataFrame, key: str = "mask_id") -> DataFrame:
    """Runs of the masks whose polygons of whole corners these are, by the even-odd rule: a horizontal edge turns its columns on or off."""
    n = F.size("corners")
    edge = F.transform("corners", lambda p, i: F.struct(p[0].alias("x"), p[1].alias("y"), F.get("corners", (i + 1) % n)[0].alias("to"), F.get("corners", (i + 1) % n)[1].alias("y2")))
    t = borders.select(key, F.explode(F.filter(edge, lambda e: e["y"] == e["y2"])).alias("e"))
    t = t.select(key, F.explode(F.sequence(F.least("e.x", "e.to"), F.greatest("e.x", "e.to") - 1)).alias("x"), F.col("e.y").alias("y"))
    cuts = t.groupBy(key, "x").agg(F.array_sort(F.collect_list("y")).alias("y"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("y") / 2).cast("int") - 1), lambda i: F.struct(F.get("y", 2 * i).alias("lo"), F.get("y", 2 * i + 1).alias("hi")))
    return cuts.select(key, "x", F.explode(pairs).alias("p")).select(key, "x", F.col("p.lo").alias("lo"), F.col("p.hi").alias("hi")).filter("lo < hi")


def distances(on: np.ndarray) -> np.ndarray:
    """Squared distance of each on pixel to the nearest off pixel; `on` has a border of off pixels."""
    n = np.arange(on.shape[0])[:, None]
    above = n - np.maximum.accumulate(np.where(on, -1, n), 0)
    below = np.minimum.accumulate(np.where(on, on.shape[0], n)[::-1], 0)[::-1] - n
    column = np.minimum(above, below).astype(np.int64) ** 2
    out = column.copy()
    k = 1
    while k < on.shape[1] and k * k < out.max():
        out[:, k:] = np.minimum(out[:, k:], column[:, :-k] + k * k)
        out[:, :-k] = np.minimum(out[:, :-k], column[:, k:] + k * k)
        k += 1
    return out


def centres(runs: DataFrame, points: int = 1, key: str = "mask_id") -> DataFrame:
    """key, place, x, y, distance: the pixel farthest from the edge of the mask or frame; each next one takes those before as edges.

    Of equally far ones the first by y, then x. A mask has as many rows as points, or pixels if it has fewer."""
    kind = dict(runs.dtypes)[key]

    def run(a: Arrays) -> Arrays:
        on, left, top = drawn(a["x"], a["lo"], a["hi"])
        rows = []
        while len(rows) < points and on.any():
            far = distances(on)
            y, x = divmod(int(far.argmax()), far.shape[1])
            rows.append((x + left, y + top, float(far[y, x]) ** 0.5))
            on[y, x] = False
        x, y, far = zip(*rows)
        return {key: np.repeat(a[key][:1], len(rows)), "place": np.arange(len(rows)), "x": np.array(x), "y": np.array(y), "distance": np.array(far)}

    return per_group(runs.select(key, "x", "lo", "hi"), [key], ["x", "lo"], f"{key} {kind}, place int, x int, y int, distance double", run)


def error_centres(truth: DataFrame, found: DataFrame, key: str = "mask_id") -> DataFrame:
    """key, x, y, label: the middle of what is missing (1) or of what is too much (0), whichever is farther from its edge; no row without errors."""
    missing, extra = (centres(t, key=key).select(key, F.struct("distance", "x", "y").alias(n)) for n, t in (("missing", minus(truth, found, key)), ("extra", minus(found, truth, key))))
    t = missing.join(extra, key, "full")
    more = F.coalesce(F.col("missing.distance"), F.lit(0.0)) > F.coalesce(F.col("extra.distance"), F.lit(0.0))
    best = F.when(more, F.col("missing")).otherwise(F.col("extra"))
    return t.select(key, best["x"].alias("x"), best["y"].alias("y"), more.cast("int").alias("label"))


def _unit(*parts: Column | str) -> Column:
    """A number in [0, 1) of its own for each row and seed."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])), 1, 13), 16, 10).cast("double") / float(1 << 52)


def random_points(runs: DataFrame, points: int, seed: int = 0, key: str = "mask_id") -> DataFrame:
    """key, place, x, y: pixels drawn evenly from each mask, with return, the same in every run.

    The pixels of a mask are numbered along its runs; a drawn number finds its run by the number of its first pixel."""
    order = Window.partitionBy(key).orderBy("x", "lo")
    t = runs.withColumn("__end", F.sum(F.col("hi") - F.col("lo")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    draws = t.groupBy(key).agg(F.max("__end").alias("__n")).withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    draws = draws.withColumn("__at", F.floor(_unit(F.lit(seed), key, "place") * F.col("__n")))
    met = draws.join(t, key).filter((F.col("__at") < F.col("__end")) & (F.col("__at") >= F.col("__end") - (F.col("hi") - F.col("lo"))))
    return met.select(key, "place", "x", (F.col("hi") - (F.col("__end") - F.col("__at"))).cast("int").alias("y"))


def error_points(truth: DataFrame, found: DataFrame, points: int, seed: int = 0, key: str = "mask_id") -> DataFrame:
    """key, place, x, y, label: pixels drawn evenly from where the masks differ; 1 where the truth is on. No row without errors."""
    missing, extra = minus(truth, found, key), minus(found, truth, key)
    drawn_ = random_points(either(missing, extra, key), points, seed, key)
    hit = drawn_.join(missing, [key, "x"], "left").withColumn("__in", F.coalesce((F.col("y") >= F.col("lo")) & (F.col("y") < F.col("hi")), F.lit(False)))
    return hit.groupBy(key, "place", "x", "y").agg(F.max(F.col("__in").cast("int")).alias("label"))


def cut_out(image: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """A part of a picture (a struct as Spark's image source gives it) as such a struct; null where the picture or the box is."""

    @F.pandas_udf("struct<height: int, width: int, nChannels: int, data: binary>")
    def run(pic: pd.DataFrame, x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
        out = []
        for p, *box in zip(pic.itertuples(), x, y, w, h):
            if p.data is None or any(pd.isna(v) for v in box):
                out.append((None, None, None, None))
                continue
            left, top, wide, high = (int(v) for v in box)
            whole = np.frombuffer(p.data, np.uint8).reshape(int(p.height), int(p.width), int(p.nChannels))
            part = whole[top : top + high, left : left + wide]
            out.append((part.shape[0], part.shape[1], part.shape[2], part.tobytes()))
        return pd.DataFrame(out, columns=["height", "width", "nChannels", "data"]).astype({c: "Int32" for c in ("height", "width", "nChannels")})

    return run(image, x, y, width, height)


def crop_apply(images: DataFrame, runs: DataFrame, ratios: list[tuple[str, float]], padding: float = 1.0, key: str = "mask_id", image: str = "image") -> DataFrame:
    """key, crop, ratio, error: each picture cut to the best crop around its mask.

    Without a fitting ratio the crop is the mask's own box ("native"); without a mask there is none, and an error."""
    box = measured(runs, key).select(key, F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    frames = images.select(key, F.col(f"{image}.width").alias("frame_w"), F.col(f"{image}.height").alias("frame_h"))
    subjects = frames.join(box, key, "left")
    plan = crop_plan(subjects.filter("w is not null"), ratios, padding).select(key, "ratio", "crop_x", "crop_y", "crop_w", "crop_h")
    t = subjects.join(plan, key, "left").select(key, *[F.coalesce(f"crop_{c}", c).alias(c) for c in "xywh"], F.when(F.col("w").isNotNull(), F.coalesce("ratio", F.lit("native"))).alias("ratio"))
    t = images.select(key, image).join(t, key)
    return t.select(key, cut_out(F.col(image), *[F.col(c) for c in "xywh"]).alias("crop"), "ratio", F.when(F.col("ratio").isNull(), "no subject in the mask").alias("error"))
