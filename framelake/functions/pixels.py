"""Pixel metrics in NumPy, and as UDFs over rows of Spark's image source.

An image is height, width, channels and bytes, rows from the top, channels blue, green, red. A metric has a value
from 0 to 1 and a score from 0 to 100. A mask counts where a pixel is over 128, and only with 100 such pixels.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Scales of sharpness and edge strength, the greatest contrast, and mask rules.
SHARPNESS_SCALE, EDGE_SCALE, MAX_CONTRAST = 2500.0, 100.0, 2.0
MASK_OVER, MASK_LEAST = 128, 100


def pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8)[: height * width * channels].reshape(height, width, channels)


def gray(image: np.ndarray) -> np.ndarray:
    """Luminance rounded to whole numbers, of one picture or a stack."""
    if image.ndim == 2 or image.shape[-1] == 1:
        return image if image.ndim == 2 else image[..., 0]
    b, g, r = (image[..., i].astype(np.float64) for i in range(3))
    return np.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5).astype(np.uint8)


def hsv(image: np.ndarray) -> np.ndarray:
    """Hue (0 to 179), saturation and value (0 to 255) of blue, green, red bytes, by the usual table of twelve-bit fractions."""
    b, g, r = (image[..., i].astype(np.int64) for i in range(3))
    v = np.maximum(np.maximum(b, g), r)
    span = v - np.minimum(np.minimum(b, g), r)
    part = lambda whole, by: np.rint(whole / np.maximum(by, 1)).astype(np.int64)
    s = (span * part(255 << 12, v) + (1 << 11)) >> 12
    h = np.where(v == r, g - b, np.where(v == g, b - r + 2 * span, r - g + 4 * span))
    h = (h * part((180 << 12) / 6, span) + (1 << 11)) >> 12
    return np.stack([h + np.where(h < 0, 180, 0), s, v], -1)


def content_changes(stack: np.ndarray) -> np.ndarray:
    """Mean difference of hue, saturation and value of each picture of a stack and the one before it."""
    x = hsv(stack if stack.shape[3] == 3 else np.repeat(stack, 3, 3))
    return np.abs(np.diff(x, axis=0)).mean((1, 2)).mean(1)


def content_change(a: np.ndarray, b: np.ndarray) -> float | None:
    """Mean difference of hue, saturation and value of two pictures; null if their sizes differ. Hue does not wrap around."""
    return float(content_changes(np.stack([a, b]))[0]) if a.shape == b.shape else None


content_change.stacked = content_changes


def _near(x: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """The image shifted by one each way; borders mirror the row next to the edge."""
    p = np.pad(x.astype(np.float64), 1, mode="reflect") if min(x.shape) > 1 else np.pad(x.astype(np.float64), 1, mode="edge")
    h, w = x.shape
    return {(i, j): p[1 + i : 1 + i + h, 1 + j : 1 + j + w] for i in (-1, 0, 1) for j in (-1, 0, 1)}


def _active(mask: np.ndarray | None, shape: tuple[int, int]) -> np.ndarray | None:
    if mask is None or mask.shape != shape:
        return None
    on = mask > MASK_OVER
    return on if on.sum() >= MASK_LEAST else None


def sharpness(g: np.ndarray, mask: np.ndarray | None = None) -> float:
    n = _near(g)
    laplace = n[-1, 0] + n[1, 0] + n[0, -1] + n[0, 1] - 4 * n[0, 0]
    on = _active(mask, g.shape)
    return min(float((laplace if on is None else laplace[on]).var()) / SHARPNESS_SCALE, 1.0)


def edge_strength(g: np.ndarray) -> float:
    n = _near(g)
    x = n[-1, 1] + 2 * n[0, 1] + n[1, 1] - n[-1, -1] - 2 * n[0, -1] - n[1, -1]
    y = n[1, -1] + 2 * n[1, 0] + n[1, 1] - n[-1, -1] - 2 * n[-1, 0] - n[-1, 1]
    return min(float(np.hypot(x, y).mean()) / EDGE_SCALE, 1.0)


def _chosen(g: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    on = _active(mask, g.shape)
    return g.ravel() if on is None else g[on]


def contrast(g: np.ndarray, mask: np.ndarray | None = None) -> float:
    x = _chosen(g, mask).astype(np.float64)
    return min(max(float(x.std() / (x.mean() + 1e-7)), 0.0), MAX_CONTRAST) / MAX_CONTRAST


def brightness(g: np.ndarray, mask: np.ndarray | None = None) -> float:
    return float(_chosen(g, mask).mean()) / 255.0


def entropy(g: np.ndarray, mask: np.ndarray | None = None) -> float:
    counts = np.bincount(_chosen(g, mask), minlength=256)
    p = counts[counts > 0] / counts.sum()
    return min(max(float(-(p * np.log2(p)).sum()) / 8.0, 0.0), 1.0)


def mask_area(mask: np.ndarray) -> float:
    """Percent of pixels that the mask covers."""
    return 100.0 * float((mask > MASK_OVER).sum()) / mask.size if mask.size else 0.0


def coloured(image: np.ndarray) -> int:
    """Pixels that are not black."""
    return int((image.reshape(image.shape[0], image.shape[1], -1) > 0).any(2).sum())


@functools.cache
def _lanczos(n: int, size: int) -> np.ndarray:
    """Weights (size, n) of a three-lobed Lanczos filter that is widened where it shrinks, in whole 2**-22ths."""
    scale = n / size
    wide = max(scale, 1.0)
    out = np.zeros((size, n))
    for i in range(size):
        centre = (i + 0.5) * scale
        first, last = max(int(centre - 3 * wide + 0.5), 0), min(int(centre + 3 * wide + 0.5), n)
        x = (np.arange(first, last) + 0.5 - centre) / wide
        w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
        out[i, first:last] = w / w.sum()
    return np.trunc(out * (1 << 22) + np.where(out < 0, -0.5, 0.5)).astype(np.int64)


def _shrunk(g: np.ndarray, size: int) -> np.ndarray:
    """Gray pictures of size by size, as common imaging libraries resize: rows first, then columns, each rounded to bytes.

    Sums are whole numbers below 2**53, so doubles hold them exactly."""
    half, one = float(1 << 21), float(1 << 22)
    rows = np.clip(np.floor((g.astype(np.float64) @ _lanczos(g.shape[-1], size).T.astype(np.float64) + half) / one), 0, 255)
    return np.clip(np.floor((_lanczos(g.shape[-2], size).astype(np.float64) @ rows + half) / one), 0, 255)


def _hashes(g: np.ndarray, side: int = 8, factor: int = 4) -> list[str]:
    """phash() of each of many gray pictures of one size."""
    n = side * factor
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    low = (basis @ _shrunk(g, n) @ basis.T)[:, :side, :side].reshape(len(g), -1)
    return [b.tobytes().hex() for b in np.packbits(low > np.median(low, axis=1)[:, None], axis=1)]


def phash(g: np.ndarray, side: int = 8, factor: int = 4) -> str:
    """64-bit perceptual hash: low frequencies of a cosine transform against their median, as hex."""
    return _hashes(g[None], side, factor)[0]


def _ssims(a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    n = min(window, *a.shape[1:])

    def mean(x: np.ndarray) -> np.ndarray:
        """Of every window; sums of whole numbers are exact."""
        c = np.pad(x.cumsum(1).cumsum(2), ((0, 0), (1, 0), (1, 0)))
        return (c[:, n:, n:] - c[:, :-n, n:] - c[:, n:, :-n] + c[:, :-n, :-n]) / (n * n)

    ma, mb = mean(a), mean(b)
    k = n * n / max(1, n * n - 1)
    va, vb = (mean(a * a) - ma * ma) * k, (mean(b * b) - mb * mb) * k
    vab = (mean(a * b) - ma * mb) * k
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return (((2 * ma * mb + c1) * (2 * vab + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean((1, 2))


def ssim(a: np.ndarray, b: np.ndarray, window: int = 7) -> float:
    """Mean structural similarity of two gray images of one size, over square windows."""
    return float(_ssims(a.astype(np.float64)[None], b.astype(np.float64)[None], window)[0])


def likenesses(stack: np.ndarray) -> np.ndarray:
    """Structural similarity in gray of each picture of a stack and the one before it."""
    g = gray(stack).astype(np.float64)
    return _ssims(g[:-1], g[1:], 7)


def likeness(a: np.ndarray, b: np.ndarray) -> float | None:
    """Structural similarity of two pictures in gray; null if their sizes differ."""
    return ssim(gray(a), gray(b)) if a.shape[:2] == b.shape[:2] else None


likeness.stacked = likenesses


def linked(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, eight: bool = True) -> np.ndarray:
    """The connected part (number of its first run) of each run of one mask. A run is the rows lo..hi-1 of column x; runs come in order of x and lo."""
    reach = int(eight)
    wide = int(hi.max(initial=0)) + 4
    at = x.astype(np.int64) * wide
    first = np.searchsorted(at + hi, at + wide + lo - reach, "right")
    last = np.searchsorted(at + lo, at + wide + hi + reach, "left")
    n = np.maximum(last - first, 0)
    a = np.repeat(np.arange(len(x)), n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    part = np.arange(len(x))
    while True:
        low = np.minimum(part[a], part[b])
        new = part.copy()
        np.minimum.at(new, part[a], low)
        np.minimum.at(new, part[b], low)
        new = new[new]
        if (new == part).all():
            return part
        part = new


def column_runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, lo, hi of the runs of a mask, column by column."""
    step = np.diff(np.pad(on, ((1, 1), (0, 0))).astype(np.int8), axis=0).T
    x, lo = np.nonzero(step == 1)
    return x, lo, np.nonzero(step == -1)[1]


def components(on: np.ndarray, eight: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Label (from 1, 0 for off) of each pixel's connected part, and the parts' sizes by label."""
    x, lo, hi = column_runs(on)
    names, part = np.unique(linked(x, lo, hi, eight), return_inverse=True)
    label = np.zeros((on.shape[1], on.shape[0]), np.int64)
    label[on.T] = np.repeat(part + 1, hi - lo)
    return label.T, np.bincount(label.ravel(), minlength=len(names) + 1)


def _shifted(on: np.ndarray, radius: int, grow: bool) -> np.ndarray:
    """Dilation or erosion by an ellipse whose rows' half widths are rounded."""
    p = np.pad(on, radius, constant_values=not grow)
    h, w = on.shape
    out = np.zeros_like(on) if grow else np.ones_like(on)
    for i in range(-radius, radius + 1):
        for j in range(-radius, radius + 1):
            if abs(j) <= round(radius * ((radius * radius - i * i) / max(1, radius * radius)) ** 0.5):
                part = p[radius + i : radius + i + h, radius + j : radius + j + w]
                out = out | part if grow else out & part
    return out


def clean_mask(mask: np.ndarray, radius: int = 2) -> np.ndarray:
    """The largest part of a mask after closing gaps, as 0 and 255."""
    on = mask > MASK_OVER
    if not on.any():
        return np.zeros(mask.shape, np.uint8)
    label, sizes = components(_shifted(_shifted(on, radius, True), radius, False))
    sizes[0] = 0
    return np.where(label == sizes.argmax(), 255, 0).astype(np.uint8) if sizes.any() else np.zeros(mask.shape, np.uint8)


def fill_holes(on: np.ndarray, most: int) -> np.ndarray:
    """A mask without holes and specks of at most so many pixels."""
    for value in (False, True):
        label, sizes = components(on == value)
        small = np.flatnonzero((sizes > 0) & (sizes <= most))
        on = np.where(np.isin(label, small[small > 0]), not value, on)
    return on


def mask_box(on: np.ndarray, inclusive: bool = False) -> tuple[int, int, int, int]:
    """x1, y1, x2, y2 of a mask, the far edges one beyond it unless inclusive; zeros if it is empty."""
    rows, cols = np.flatnonzero(on.any(1)), np.flatnonzero(on.any(0))
    if not len(rows):
        return 0, 0, 0, 0
    more = 0 if inclusive else 1
    return int(cols[0]), int(rows[0]), int(cols[-1]) + more, int(rows[-1]) + more


def mask_iou(a: np.ndarray, b: np.ndarray) -> float:
    return float((a & b).sum() / max(1, (a | b).sum()))


def mask_iom(a: np.ndarray, b: np.ndarray) -> float:
    return float((a & b).sum() / (min(a.sum(), b.sum()) + 1e-8))


def boundary(on: np.ndarray) -> np.ndarray:
    """Pixels that differ from the one to the east, south or south-east; in the last column or row only along it."""
    out = np.zeros_like(on)
    out[:, :-1] |= on[:, :-1] ^ on[:, 1:]
    out[:-1] |= on[:-1] ^ on[1:]
    out[:-1, :-1] |= on[:-1, :-1] ^ on[1:, 1:]
    return out


def boundary_f(a: np.ndarray, b: np.ndarray, radius: int = 1) -> float:
    """F-measure of two masks' boundaries, near by a square of a radius."""
    x, y = boundary(a), boundary(b)
    if not x.any() or not y.any():
        return float(x.any() == y.any())
    wide = lambda m: np.lib.stride_tricks.sliding_window_view(np.pad(m, radius), (2 * radius + 1, 2 * radius + 1)).any((2, 3))
    p, r = (y & wide(x)).sum() / y.sum(), (x & wide(y)).sum() / x.sum()
    return float(2 * p * r / (p + r)) if p + r else 0.0


def rle(on: np.ndarray) -> list[int]:
    """Lengths of runs down the columns, the first of pixels that are off."""
    flat = np.asarray(on, bool).ravel(order="F")
    cuts = np.flatnonzero(np.diff(np.concatenate([[False], flat, [not flat[-1]] if len(flat) else []]).astype(np.int8)))
    return np.diff(np.concatenate([[0], cuts])).astype(int).tolist() if len(flat) else []


def from_rle(counts: list[int], height: int, width: int) -> np.ndarray:
    values = np.arange(len(counts)) % 2 == 1
    return np.repeat(values, counts).reshape((height, width), order="F")


def polygon_area(points: np.ndarray) -> float:
    x, y = points[:, 0], points[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def polygon_mask(points: np.ndarray, height: int, width: int) -> np.ndarray:
    """Pixels whose centre is inside, by crossings."""
    y, x = np.mgrid[0:height, 0:width] + 0.5
    inside = np.zeros((height, width), bool)
    for (x1, y1), (x2, y2) in zip(points, np.roll(points, -1, 0), strict=True):
        if y1 != y2:
            inside ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return inside


METRICS = {"sharpness": sharpness, "edge_strength": lambda g, m=None: edge_strength(g), "contrast": contrast, "brightness": brightness, "entropy": entropy}


#: Pixels of pictures of one size that are measured at once.
AT_ONCE = 1 << 18


def _measured(g: np.ndarray, mask: np.ndarray | None, only: tuple[str, ...]) -> dict[str, np.ndarray]:
    """What METRICS and phash() say of each of many gray pictures of one size (number, height, width); a mask for each, or none."""
    n, size = len(g), g.shape[1] * g.shape[2]
    x, out, use = g.reshape(n, size), {}, None
    if mask is not None:
        use = (mask > MASK_OVER).reshape(n, size)
        use = use | (use.sum(1) < MASK_LEAST)[:, None]
    count = np.full(n, size) if use is None else use.sum(1)

    def spread(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = (v if use is None else v * use).sum(1) / count
        away = v - mean[:, None]
        return mean, (away * away if use is None else away * away * use).sum(1) / count

    if {"sharpness", "edge_strength"} & set(only):
        p = np.pad(g.astype(np.float64), ((0, 0), (1, 1), (1, 1)), mode="reflect" if min(g.shape[1:]) > 1 else "edge")
        v = lambda i, j: p[:, 1 + i : 1 + i + g.shape[1], 1 + j : 1 + j + g.shape[2]]
        if "sharpness" in only:
            laplace = v(-1, 0) + v(1, 0) + v(0, -1) + v(0, 1) - 4 * v(0, 0)
            out["sharpness"] = np.minimum(spread(laplace.reshape(n, size))[1] / SHARPNESS_SCALE, 1.0)
        if "edge_strength" in only:
            across = v(-1, 1) + 2 * v(0, 1) + v(1, 1) - v(-1, -1) - 2 * v(0, -1) - v(1, -1)
            down = v(1, -1) + 2 * v(1, 0) + v(1, 1) - v(-1, -1) - 2 * v(-1, 0) - v(-1, 1)
            out["edge_strength"] = np.minimum(np.hypot(across, down).reshape(n, size).mean(1) / EDGE_SCALE, 1.0)
    if {"contrast", "brightness"} & set(only):
        mean, var = spread(x.astype(np.float64))
        out["brightness"] = mean / 255.0
        out["contrast"] = np.clip(np.sqrt(var) / (mean + 1e-7), 0.0, MAX_CONTRAST) / MAX_CONTRAST
    if "entropy" in only:
        at = x + 256 * np.arange(n)[:, None]
        levels = np.bincount(at.ravel() if use is None else at[use], minlength=256 * n).reshape(n, 256) / count[:, None]
        out["entropy"] = np.clip(-(levels * np.log2(np.where(levels > 0, levels, 1.0))).sum(1) / 8.0, 0.0, 1.0)
    if "phash" in only:
        out["phash"] = _hashes(g)
    if "mask_area_pct" in only and mask is not None:
        out["mask_area_pct"] = 100.0 * (mask > MASK_OVER).reshape(n, size).sum(1) / size
    return out


def measure(images: DataFrame, image: str = "image", mask: str | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """images with a struct of all metrics and the hash, or those asked for; a picture that can't be read has nulls and an error.

    Pictures of one size are measured together."""
    only = (*METRICS, "phash", "mask_area_pct") if only is None else only
    scored = [k for k in METRICS if k in only]
    kinds = {k: "double" for k in scored} | {f"{k}_score": "double" for k in scored} | {k: t for k, t in (("phash", "string"), ("mask_area_pct", "double")) if k in only} | {"error": "string"}

    @F.pandas_udf("struct<" + ", ".join(f"{k}: {t}" for k, t in kinds.items()) + ">")
    def run(data: pd.Series, h: pd.Series, w: pd.Series, c: pd.Series, m: pd.Series) -> pd.DataFrame:
        out = {k: np.full(len(data), None, object) for k in kinds}
        groups: dict[tuple, list[tuple[int, np.ndarray, np.ndarray | None]]] = {}

        def work(rows: list[tuple[int, np.ndarray, np.ndarray | None]]) -> None:
            at = [i for i, _, _ in rows]
            masks = None if rows[0][2] is None else np.stack([x for _, _, x in rows])
            for k, v in _measured(np.stack([g for _, g, _ in rows]), masks, only).items():
                if k in out:
                    out[k][at] = v
                if k in scored:
                    out[f"{k}_score"][at] = 100 * v
            rows.clear()

        for i, (d, hh, ww, cc, mm) in enumerate(zip(data, h, w, c, m, strict=True)):
            try:
                g = gray(pixels(d, int(hh), int(ww), int(cc)))
                if not g.size:
                    raise ValueError("a picture without pixels")
                own = None if mm is None else np.frombuffer(mm, np.uint8).reshape(g.shape)
            except (ValueError, TypeError) as e:
                out["error"][i] = str(e)
                continue
            rows = groups.setdefault((g.shape, own is None), [])
            rows.append((i, g, own))
            if len(rows) * g.size >= AT_ONCE:
                work(rows)
        for rows in groups.values():
            if rows:
                work(rows)
        return pd.DataFrame({k: v if kinds[k] == "string" else v.astype(float) for k, v in out.items()})

    own = F.col(mask) if mask else F.lit(None).cast("binary")
    return images.withColumn("measured", run(F.col(f"{image}.data"), F.col(f"{image}.height"), F.col(f"{image}.width"), F.col(f"{image}.nChannels"), own))


def rle_udf(mask: Column, height: Column, width: Column) -> Column:
    @F.pandas_udf("array<int>")
    def run(m: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([rle(np.frombuffer(x, np.uint8).reshape(int(a), int(b)) > 0) for x, a, b in zip(m, h, w, strict=True)])

    return run(mask, height, width)
