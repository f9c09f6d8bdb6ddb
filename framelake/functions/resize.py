"""Resampling as matrices: an image of n rows is resized by a product with weights (size, n). Pixel centres are at halves."""

from __future__ import annotations

import numpy as np


def _weights(n: int, size: int, taps: int, kernel) -> np.ndarray:
    """Rows of weights at each target's centre; what falls beyond the edges is the edge pixel."""
    at = (np.arange(size) + 0.5) * n / size - 0.5
    base = np.floor(at).astype(np.int64)
    out = np.zeros((size, n))
    for k in range(1 - taps // 2, taps // 2 + 1):
        np.add.at(out, (np.arange(size), np.clip(base + k, 0, n - 1)), kernel(np.abs(at - base - k)))
    return out


def linear(n: int, size: int) -> np.ndarray:
    return _weights(n, size, 2, lambda d: np.maximum(1 - d, 0))


def cubic(n: int, size: int, a: float = -0.75) -> np.ndarray:
    """Cubic convolution over four pixels."""
    near = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1
    far = lambda d: ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    return _weights(n, size, 4, lambda d: np.where(d <= 1, near(d), np.where(d < 2, far(d), 0.0)))


def resized(image: np.ndarray, height: int, width: int, weights=linear) -> np.ndarray:
    """Images (..., rows, columns) at another size."""
    return weights(image.shape[-2], height) @ image @ weights(image.shape[-1], width).T


def _box_weights(n: int, low: float, high: float, size: int) -> np.ndarray:
    """Means of bilinear samples in `size` equal parts of low..high, ceil(part) samples each; 0 beyond a pixel off the edge."""
    part = (high - low) / size
    count = max(1, int(np.ceil(part)))
    at = low - 0.5 + (np.arange(size)[:, None] + (np.arange(count)[None, :] + 0.5) / count) * part
    out = np.zeros((size, n))
    inside = (at >= -1) & (at <= n)
    at = np.clip(at, 0, n - 1)
    base = np.minimum(np.floor(at).astype(np.int64), n - 1)
    rows = np.broadcast_to(np.arange(size)[:, None], at.shape)
    for k, w in ((base, 1 - (at - base)), (np.minimum(base + 1, n - 1), at - base)):
        np.add.at(out, (rows[inside], k[inside]), w[inside] / count)
    return out


def region(image: np.ndarray, box: tuple[float, float, float, float], size: int) -> np.ndarray:
    """A box (x1, y1, x2, y2) of an image as size by size means, samples aligned to pixel centres."""
    x1, y1, x2, y2 = box
    return _box_weights(image.shape[0], y1, y2, size) @ image @ _box_weights(image.shape[1], x1, x2, size).T
