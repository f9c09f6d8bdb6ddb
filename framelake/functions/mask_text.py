"""The text form of run lengths in public mask files: differences in groups of five bits, a character each.

From the fourth count on a number is the difference from the one two before. Groups go low bits first, one bit more says
that another follows, and 48 is added; the last group's high bit is the sign. Parts of a batch are one pass of NumPy each, not a loop over
masks. Nulls stay null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format.
BITS, MORE, BASE, SIGN = 5, 32, 48, 16
#: Counts or characters of masks that are worked on together; a batch of long masks is many such parts.
PART = 1 << 18


def _numbers(counts: np.ndarray, offsets: np.ndarray, back: bool) -> np.ndarray:
    """Differences of counts two apart, or counts of differences; the first three of a mask are themselves."""
    place = np.arange(len(counts)) - np.repeat(offsets[:-1], np.diff(offsets))
    if not back:
        before = np.concatenate([[0, 0], counts[:-2]]) if len(counts) > 1 else np.zeros(len(counts), np.int64)
        return counts - np.where(place > 2, before, 0)
    # Places 1, 3, 5, ... add up, and so do 2, 4, ...; place 0 stands alone.
    mask = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    lane = np.where(place == 0, 0, 1 + place % 2) + 3 * mask
    order = np.lexsort((place, lane))
    sums = np.cumsum(counts[order])
    first = np.flatnonzero(np.concatenate([[True], np.diff(lane[order]) != 0])) if len(counts) else np.zeros(0, np.int64)
    base = np.repeat(np.concatenate([[0], sums])[first], np.diff(np.concatenate([first, [len(counts)]])))
    out = np.empty(len(counts), np.int64)
    out[order] = sums - base
    return out


def encode(counts: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Texts of masks whose counts stand one after the other."""
    v = _numbers(counts.astype(np.int64), offsets, False)
    groups = np.ones(len(v), np.int64)
    for k in range(1, 13):
        groups += (v < -(1 << (BITS * k - 1))) | (v >= (1 << (BITS * k - 1)))
    number = np.repeat(np.arange(len(v)), groups)
    step = np.arange(len(number)) - np.repeat(np.cumsum(groups) - groups, groups)
    code = (v[number] >> (BITS * step)) & (MORE - 1) | np.where(step + 1 < groups[number], MORE, 0)
    data = (code + BASE).astype(np.uint8).tobytes().decode("ascii")
    ends = np.concatenate([[0], np.cumsum(groups)])[offsets]
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def decode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all texts, and where each mask's begin."""
    code = np.frombuffer("".join(texts).encode("ascii"), np.uint8).astype(np.int64) - BASE
    last = (code & MORE) == 0
    number = np.cumsum(last) - last
    n = int(last.sum())
    first = np.concatenate([[0], np.flatnonzero(last) + 1])[:n]
    v = np.zeros(n, np.int64)
    np.add.at(v, number, (code & (MORE - 1)) << (BITS * (np.arange(len(code)) - first[number])) if n else code)
    size = np.diff(np.concatenate([first, [len(code)]]))
    v -= np.where(code[last] & SIGN, np.int64(1) << (BITS * size), 0)
    chars = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(last)])[chars]
    return _numbers(v, offsets, True), offsets


def _cuts(rows: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """rows cut so that a cut's sizes add up to PART at most, or it is one row."""
    total = np.concatenate([[0], np.cumsum(size[rows])])
    ends = [0]
    while ends[-1] < len(rows):
        ends.append(max(ends[-1] + 1, int(np.searchsorted(total, total[ends[-1]] + PART, "right")) - 1))
    return [rows[a:b] for a, b in zip(ends, ends[1:])]


def to_text(counts: Column) -> Column:
    @F.pandas_udf("string")
    def run(c: pd.Series) -> pd.Series:
        known = c.notna()
        out = np.full(len(c), None, object)
        for at in _cuts(np.flatnonzero(known), c.str.len().to_numpy()):
            lists = [np.asarray(c.iat[i], np.int64) for i in at]
            out[at] = encode(np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64))
        return pd.Series(out, index=c.index)

    return run(counts)


def from_text(text: Column) -> Column:
    @F.pandas_udf("array<int>")
    def run(t: pd.Series) -> pd.Series:
        known = t.notna()
        out = np.full(len(t), None, object)
        for at in _cuts(np.flatnonzero(known), t.str.len().to_numpy()):
            v, ends = decode([t.iat[i] for i in at])
            for i, a, b in zip(at, ends, ends[1:]):
                out[i] = v[a:b].astype(np.int32)
        return pd.Series(out, index=t.index)

    return run(text)
