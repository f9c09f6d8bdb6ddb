"""Many small groups a call: sorted partitions are cut into runs of equal keys, each handed on as NumPy arrays.

A grouped-map call costs milliseconds, which is too much for millions of images with a few boxes each. Where a call each
of fn is too much as well, per_batch hands on all whole groups of a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Arrays = dict[str, np.ndarray]


def per_group(df: DataFrame, keys: list[str], order: list[str], schema: str, fn: Callable[[Arrays], Arrays], spread: bool = False) -> DataFrame:
    """fn's rows for each group of keys; a group's rows come in `order`, its arrays have the columns of df.

    spread: few bytes are much work, so there are as many tasks as shuffles have."""
    names = list(df.columns)
    out_names = [c.strip().split()[0].strip("`") for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the last group, as far as it came

        def work(pdf: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
            arrays = {c: pdf[c].to_numpy() for c in names}
            parts = [fn({c: v[a:b] for c, v in arrays.items()}) for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
            return pd.DataFrame({c: np.concatenate([p[c] for p in parts]) for c in out_names})

        for pdf in batches:
            if not len(pdf):
                continue
            new = np.zeros(len(pdf), bool)
            for k in keys:
                v = pdf[k].to_numpy()
                new[1:] |= v[1:] != v[:-1]
                if held:
                    new[0] |= v[0] != held[-1][k].iat[-1]
            cuts = np.flatnonzero(new)
            if len(cuts):
                whole = pd.concat([*held, pdf.iloc[: cuts[-1]]], ignore_index=True)
                ends = cuts + (len(whole) - cuts[-1])
                held = [pdf.iloc[cuts[-1] :].reset_index(drop=True)]
                if len(whole):
                    yield work(whole, ends[ends > 0])
            else:
                held.append(pdf)
        if held:
            last = pd.concat(held, ignore_index=True)
            yield work(last, np.array([len(last)]))

    tasks = [int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))] if spread else []
    return df.repartition(*tasks, *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _changes(rows: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """Rows whose keys differ from those of the row before; a null differs from everything."""
    new = np.zeros(max(0, rows.num_rows - 1), bool)
    for k in keys:
        v = rows.column(k)
        new |= pc.fill_null(pc.not_equal(v.slice(1), v.slice(0, rows.num_rows - 1)), True).to_numpy(zero_copy_only=False) if len(new) else new
    return np.flatnonzero(new) + 1


def per_batch(df: DataFrame, keys: list[str], order: list[str], schema: str, fn: Callable[[pa.RecordBatch, np.ndarray], Iterator[dict]]) -> DataFrame:
    """Rows that fn yields, as columns, for many whole groups of keys a call: it gets their rows, a group's in `order`, and where each
    group starts. A row without a key is a group of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last group, as far as it came

        def work() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            for out in fn(whole, np.append(0, _changes(whole, keys))):
                yield pa.RecordBatch.from_pydict(out)

        for b in batches:
            if not b.num_rows:
                continue
            cuts = _changes(b, keys)
            if held and len(_changes(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), b.slice(0, 1)]).combine_chunks(), keys)):
                cuts = np.append(0, cuts)
            if len(cuts):
                held.append(b.slice(0, cuts[-1]))
                if sum(h.num_rows for h in held):
                    yield from work()
                held = [b.slice(cuts[-1])]
            else:
                held.append(b)
        if held:
            yield from work()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def per_long_group(df: DataFrame, keys: list[str], order: list[str], schema: str, fn: Callable[[Arrays], Iterator[Arrays]], tasks: int) -> DataFrame:
    """Rows that fn yields, keys aside and a part at a time, for each group of keys, which may be long: a task holds a group once, as
    arrays of the other columns' own types. A group's rows come in `order`; no column of df is null. schema begins with the keys."""
    names = [c for c in df.columns if c not in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {c: [] for c in names}
        first: pa.RecordBatch | None = None  # a row of the group that is held

        def work() -> Iterator[pa.RecordBatch]:
            arrays = {}
            for c in names:  # one column at a time is there twice
                arrays[c] = np.concatenate(held[c])
                held[c].clear()
            for out in fn(arrays):
                n = len(next(iter(out.values())))
                yield pa.RecordBatch.from_pydict({k: pa.repeat(first.column(k)[0], n) for k in keys} | out)

        for b in batches:
            if not b.num_rows:
                continue
            cuts = _changes(b, keys).tolist()
            if first is not None and len(_changes(pa.Table.from_batches([first, b.slice(0, 1).select(keys)]).combine_chunks(), keys)):
                cuts = [0, *cuts]
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if lo in cuts and first is not None:
                    yield from work()
                if hi > lo:
                    part = b.slice(lo, hi - lo)
                    first = pa.RecordBatch.from_pydict({k: part.column(k).take(pa.array([0])) for k in keys})
                    for c in names:
                        held[c].append(np.array(part.column(c).to_numpy(zero_copy_only=False)))
        if first is not None:
            yield from work()

    return df.repartition(tasks, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def side_pairs(side: np.ndarray, starts: np.ndarray, whole: bool = True, most: int = 1 << 18) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a group's rows of side 0 with those of side 1, which follow them, in blocks of about `most` pairs.

    A block is whole groups: which ones, their rows of side 0, how many rows each has of both sides, and the rows of each pair,
    by those of side 0. Not `whole`: each row of side 0 counts as a group, so that a large group has many blocks."""
    first = starts
    n = np.add.reduceat(side == 0, starts, dtype=np.int64)
    other, m = starts + n, np.diff(np.append(starts, len(side))) - n
    if not whole:
        first, other, m, n = np.flatnonzero(side == 0), np.repeat(other, n), np.repeat(m, n), np.ones(n.sum(), np.int64)
    done = np.cumsum(n * m)
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(done, done[a] - n[a] * m[a] + most, "right")))
        own, wide = n[a:b], m[a:b]
        pairs = own * wide
        r = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        per = np.repeat(wide, pairs)
        rows = np.arange(own.sum()) + np.repeat(first[a:b] - np.cumsum(own) + own, own)
        yield slice(a, b), rows, own, wide, np.repeat(first[a:b], pairs) + r // per, np.repeat(other[a:b], pairs) + r % per
        a = b


def numbers(rows: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Columns side by side as doubles, NaN for null."""
    return np.stack([rows.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], 1)


def both_sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both with `side` 0 or 1; a column that one side lacks is null there."""
    return left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)), allowMissingColumns=True)
