"""Optimal assignment without SciPy."""

from __future__ import annotations

from functools import cache
from itertools import permutations
from math import perm

import numpy as np

#: Ways to assign a group that are tried one by one, and numbers that are held for that at once.
WAYS, CELLS = 720, 1 << 20


def assign(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of an assignment of greatest total score, rows ascending.

    Shortest augmenting paths with potentials, O(n^3); which of several optima is found is not defined."""
    score = np.asarray(score, np.float64)
    if not score.size:
        none = np.zeros(0, np.int64)
        return none, none
    turned = score.shape[0] > score.shape[1]
    cost = -(score.T if turned else score)
    n, m = cost.shape
    # Every row first takes its best column where that is free; only the others look for a path.
    best = cost.argmin(1)
    if len(set(best.tolist())) == n:
        rows = np.arange(n)
        order = np.argsort(best)
        return (best[order], rows[order]) if turned else (rows, best)
    u, v, owner, todo = cost.min(1), np.zeros(m), np.full(m, -1), []
    for i, col in enumerate(best.tolist()):
        if owner[col] < 0:
            owner[col] = i
        else:
            todo.append(i)
    for i in todo:
        dist, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, last = i, -1
        while True:
            better = ~done & (cost[row] - u[row] - v + (dist[last] if last >= 0 else 0.0) < dist)
            reach = cost[row] - u[row] - v + (dist[last] if last >= 0 else 0.0)
            dist[better], via[better] = reach[better], last
            col = int(np.where(done, np.inf, dist).argmin())
            done[col] = True
            if owner[col] < 0:
                break
            row, last = owner[col], col
        total = dist[col]
        u[i] += total
        for j in np.flatnonzero(done):
            if j != col and owner[j] >= 0:
                u[owner[j]] += total - dist[j]
            if j != col:
                v[j] -= total - dist[j]
        while col >= 0:
            before = via[col]
            owner[col] = i if before < 0 else owner[before]
            col = before
    cols = np.flatnonzero(owner >= 0)
    rows = owner[cols]
    if turned:
        rows, cols = cols, rows
    order = np.argsort(rows)
    return rows[order].astype(np.int64), cols[order].astype(np.int64)


@cache
def _ways(many: int, few: int) -> np.ndarray:
    return np.array(list(permutations(range(many), few)))


def assign_many(score: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which cells the assignments of many groups take, ascending; score has the cells of n[0] by m[0] scores row by row, then n[1] by m[1] ...

    Groups of one shape are solved together: by each row's best column where those differ, else by trying all ways; large
    ones one at a time."""
    starts, taken = np.cumsum(n * m) - n * m, []
    shapes, which = np.unique(np.stack([n, m], 1), axis=0, return_inverse=True)
    order = np.argsort(which.ravel(), kind="stable")
    ends = np.cumsum(np.bincount(which.ravel(), minlength=len(shapes)))
    for (high, wide), lo, hi in zip(shapes.tolist(), [0, *ends[:-1]], ends, strict=True):
        few, many = min(high, wide), max(high, wide)
        step = max(1, CELLS // max(1, high * wide))
        for k in range(lo, hi, step) if few else ():
            at = starts[order[k : min(k + step, hi)]]
            cells = np.arange(high * wide).reshape(high, wide)
            cells = cells.T if high > wide else cells
            s = score[at[:, None, None] + cells]
            best = s.argmax(2)
            if few > 1:
                alike = np.sort(best, 1)
                left = np.flatnonzero((alike[:, 1:] == alike[:, :-1]).any(1))
                ways = perm(many, few)
                if len(left) and ways <= WAYS:
                    tried = _ways(many, few)
                    part = max(1, CELLS // ways)
                    for j in range(0, len(left), part):
                        some = left[j : j + part]
                        total = sum(s[some, i][:, tried[:, i]] for i in range(few))
                        best[some] = tried[total.argmax(1)]
                else:
                    for g in left:
                        best[g] = assign(s[g])[1]
            taken.append((at[:, None] + cells[np.arange(few), best]).ravel())
    return np.sort(np.concatenate(taken)) if taken else np.zeros(0, np.int64)


def iou_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of each xyxy box of a with the one of b beside it, as iou_matrix has it."""
    w = np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0])
    h = np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1])
    i = np.clip(w, 0, None) * np.clip(h, 0, None)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = area(a) + area(b) - i
    return np.divide(i, union, out=np.zeros_like(i), where=union > 0)


def iou_matrix(a: np.ndarray, b: np.ndarray, eps: float = 0.0) -> np.ndarray:
    """IoU of xyxy boxes, 0 where both are empty."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    i = np.clip(w, 0, None) * np.clip(h, 0, None)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = area(a)[:, None] + area(b)[None, :] - i + eps
    return np.divide(i, union, out=np.zeros_like(i), where=union > 0)
