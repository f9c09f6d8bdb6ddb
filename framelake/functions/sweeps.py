"""Many masks' runs at once in NumPy: arrays of the mask's number, the column x, and the rows lo..hi-1 that are on."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np

from framelake.functions.pixels import linked


class Runs(NamedTuple):
    m: np.ndarray
    x: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def some(r: Runs, on: np.ndarray) -> Runs:
    return Runs(*(c[on] for c in r))


def joined(parts: list[Runs]) -> Runs:
    return Runs(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def swept(layers: list[Runs], keep: Callable[[list[np.ndarray], np.ndarray], np.ndarray]) -> Runs:
    """Runs where keep(which layers are on, x) holds, by mask, column and row. Runs of a layer may overlap; those of the result don't and don't touch."""
    every = joined(layers)
    if not len(every.m):
        return every
    y = np.concatenate([every.lo, every.hi])
    x0, y0 = every.x.min(), y.min()
    wide, high = every.x.max() - x0 + 1, y.max() - y0 + 1
    column = every.m * wide + (every.x - x0)
    spot = np.concatenate([column, column]) * high + (y - y0)
    order = np.argsort(spot, kind="stable")
    spot = spot[order]
    column, y = spot // high, spot % high + y0
    lane, step = np.repeat(np.arange(len(layers)), [len(r.m) for r in layers]), np.repeat([1, -1], len(every.m))[order]
    lane = np.concatenate([lane, lane])[order]
    # A column's steps add up to nothing, so each column starts anew.
    on = [np.cumsum(np.where(lane == i, step, 0))[:-1] > 0 for i in range(len(layers))]
    column, lo, hi, same = column[:-1], y[:-1], y[1:], column[1:] == column[:-1]
    here = np.flatnonzero(same & (lo < hi) & keep(on, column % wide + x0))
    column, lo, hi = column[here], lo[here], hi[here]
    new = np.ones(len(here), bool)
    new[1:] = (column[1:] != column[:-1]) | (lo[1:] != hi[:-1])
    first = np.flatnonzero(new)
    column = column[first]
    return Runs(column // wide, column % wide + x0, lo[first], hi[np.append(first[1:], len(here))[: len(first)] - 1])


def both(a: Runs, b: Runs) -> Runs:
    return swept([a, b], lambda on, x: on[0] & on[1])


def either(a: Runs, b: Runs) -> Runs:
    return swept([a, b], lambda on, x: on[0] | on[1])


def minus(a: Runs, b: Runs) -> Runs:
    return swept([a, b], lambda on, x: on[0] & ~on[1])


def areas(r: Runs, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, r.m, r.hi - r.lo)
    return out


def clipped(r: Runs, width: int, height: int) -> Runs:
    r = Runs(r.m, r.x, np.maximum(r.lo, 0), np.minimum(r.hi, height))
    return some(r, (r.x >= 0) & (r.x < width) & (r.lo < r.hi))


def shifted(r: Runs, dx: int, dy: int) -> Runs:
    return Runs(r.m, r.x + dx, r.lo + dy, r.hi + dy)


def grown(r: Runs, element: dict[int, int]) -> Runs:
    return joined([Runs(r.m, r.x + x, r.lo - h, r.hi + h) for x, h in element.items()])


def dilated(r: Runs, element: dict[int, int], width: int, height: int) -> Runs:
    return swept([clipped(grown(r, element), width, height)], lambda on, x: on[0])


def _columns(m: np.ndarray, first: np.ndarray, last: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Runs:
    """A run lo..hi-1 in each of the columns first..last of the masks."""
    n = np.maximum(last - first + 1, 0)
    x = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return Runs(np.repeat(m, n), x, np.repeat(lo, n), np.repeat(hi, n))


def around(r: Runs, margin: int, width: int, height: int) -> Runs:
    """Each mask's box, grown by a margin and cut to the frame."""
    m, at = np.unique(r.m, return_inverse=True)
    far = np.iinfo(np.int64).max
    x1, y1, x2, y2 = (np.full(len(m), v) for v in (far, far, -far, -far))
    np.minimum.at(x1, at, r.x)
    np.minimum.at(y1, at, r.lo)
    np.maximum.at(x2, at, r.x)
    np.maximum.at(y2, at, r.hi)
    return _columns(m, np.maximum(x1 - margin, 0), np.minimum(x2 + margin, width - 1), np.maximum(y1 - margin, 0), np.minimum(y2 + margin, height))


def eroded(r: Runs, element: dict[int, int], width: int, height: int) -> Runs:
    """What stays when the off pixels grow; beyond the frame nothing grows."""
    frame = around(r, max(max(element), max(element.values())), width, height)
    return minus(r, grown(minus(frame, r), element))


def closed(r: Runs, element: dict[int, int], width: int, height: int) -> Runs:
    return eroded(dilated(r, element, width, height), element, width, height)


def boundary(r: Runs, width: int, height: int) -> Runs:
    """Pixels that differ from the one to the east, south or south-east; in the last column or row only along it."""
    layers = [r, *(shifted(r, -i, -j) for i, j in ((1, 0), (0, 1), (1, 1))), around(r, 1, width, height - 1)]

    def differs(on: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        own, east, south, corner, above = on
        inner = x < width - 1
        return (inner & (own != east)) | (above & (own != south)) | (inner & above & (own != corner))

    return clipped(swept(layers, differs), width, height)


def sizes(r: Runs) -> np.ndarray:
    """The pixels of each run's part, of eight neighbours. Runs come by mask, column and row."""
    if not len(r.m):
        return np.zeros(0, np.int64)
    x0 = r.x.min()
    part = linked(r.m * (r.x.max() - x0 + 3) + (r.x - x0), r.lo, r.hi)
    return areas(Runs(part, r.x, r.lo, r.hi), len(part))[part]


def filled(r: Runs, most: int, width: int, height: int) -> Runs:
    """Masks without holes, then without specks, of at most so many pixels; parts of both are those of eight neighbours in the frame."""
    m = np.unique(r.m)
    fill = lambda v: np.full(len(m), v)
    holes = minus(_columns(m, fill(0), fill(width - 1), fill(0), fill(height)), r)
    on = either(r, some(holes, sizes(holes) <= most))
    return some(on, sizes(on) > most)


def packed(r: Runs, n: int) -> list[bytes]:
    """The runs of each of n masks, which come by mask, as bytes."""
    rows = np.stack([r.x, r.lo, r.hi]).astype(np.int32)
    ends = np.searchsorted(r.m, np.arange(n + 1))
    return [rows[:, a:b].tobytes() for a, b in zip(ends, ends[1:])]


def unpacked(masks: list[bytes | None]) -> Runs:
    rows = [np.frombuffer(b or b"", np.int32).reshape(3, -1).astype(np.int64) for b in masks]
    return Runs(np.repeat(np.arange(len(rows)), [v.shape[1] for v in rows]), *(np.concatenate([v[i] for v in rows]) for i in range(3)))
