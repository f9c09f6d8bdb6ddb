"""What neighbouring pictures of an order have in common.

Pictures are moved once: range-partitioned and sorted by the order, compared along each partition. The first and the last
picture of a partition are handed over (two a partition), so that the cuts between partitions are compared too; the result
is the same for any partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.pixels import pixels
from framelake.session import keep

#: Of two pictures. An attribute `stacked` gives the same for neighbours of a stack (n, height, width, channels): n - 1 numbers.
Measure = Callable[[np.ndarray, np.ndarray], float | None]
#: Bytes of pictures that are measured together.
STACK = 1 << 20
PICTURE = "struct<height: int, width: int, nChannels: int, data: binary>"


def _measured(measure: Measure, shapes: np.ndarray, data: list[bytes | None]) -> np.ndarray:
    """Scores of pictures (rows of height, width, channels; a height of -1 for none) against the one before each, NaN where there is none.

    Neighbours of one size are measured as stacks of at most STACK bytes, or two pictures."""
    out, stacked = np.full(len(data), np.nan), getattr(measure, "stacked", None)
    known, same = shapes[:, 0] >= 0, (shapes[1:] == shapes[:-1]).all(1) & (stacked is not None)
    for i in np.flatnonzero(known[1:] & known[:-1] & ~same):
        score = measure(*(pixels(data[k], *shapes[k].tolist()) for k in (i, i + 1)))
        out[i + 1] = np.nan if score is None else score
    ends = np.flatnonzero(np.concatenate([[True], ~(same & known[1:]), [True]]))
    for first, last in zip(ends, ends[1:]):
        size = int(shapes[first].prod())
        n = max(1, STACK // max(1, size))
        for at in range(first, last - 1, n):
            many = data[at : min(at + n + 1, last)]
            stack = np.frombuffer(b"".join(x[:size] for x in many), np.uint8).reshape(len(many), *shapes[first])
            out[at + 1 : at + len(many)] = stacked(stack)
    return out


def _fields(pictures: pa.Array) -> tuple[np.ndarray, list[bytes | None]]:
    *sides, data = pictures.flatten()
    shapes = np.stack([s.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for s in sides], 1)
    shapes[data.is_null().to_numpy(zero_copy_only=False) | (shapes < 0).any(1)] = -1
    return shapes, data.to_pylist()


def _compared(measure: Measure, names: list[str]):
    """Rows with their score against the row before; with their picture where they stand first or last."""
    kind = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("data", pa.binary())])

    def made(rows: pa.RecordBatch, scores: list, first: list, last: list) -> pa.RecordBatch:
        pictures = [None] * rows.num_rows
        for i in {0, rows.num_rows - 1} if rows.num_rows else ():  # only these stand at an end
            pictures[i] = rows.column("picture")[i].as_py() if first[i] or last[i] else None
        columns = [rows.column(c) for c in names]
        return pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64()), pa.array(first, pa.bool_()), pa.array(last, pa.bool_()), pa.array(pictures, kind)], names=[*names, "score", "first", "last", "picture"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far: as a batch, its score, whether it is the first of all
        group, shape, before = None, np.full((1, 3), -1), [None]
        for batch in batches:
            if not batch.num_rows:
                continue
            shapes, data = _fields(batch.column("picture"))
            groups = batch.column("__group").to_pylist()
            found = _measured(measure, np.concatenate([shape, shapes]), [*before, *data])[1:]
            new = [a != b for a, b in zip(groups, [group, *groups])]
            scores = [None if cut or x != x else x for cut, x in zip(new, found.tolist())]
            group, shape, before = groups[-1], shapes[-1:], data[-1:]
            n = batch.num_rows
            first = [held is None, *[False] * (n - 1)]
            if held is not None:
                yield made(*held, [False])
            yield made(batch.slice(0, n - 1), scores[:-1], first[:-1], [False] * (n - 1))
            held = (batch.slice(n - 1), scores[-1:], first[-1:])
        if held is not None:
            yield made(*held, [True])

    return run


def scores(frames: DataFrame, order: list[str], measure: Measure, image: str = "image", group: str | None = None) -> DataFrame:
    """Columns group and order, score: the measure of each picture and the one before it in its group; null for the first, and
    where one of the two is missing. The order must tell all rows of a group apart."""
    names = [*([group] if group else []), *order]
    kinds = dict(frames.dtypes)
    picture = F.struct(*[F.col(f"{image}.{c}").alias(c) for c in ("height", "width", "nChannels", "data")])
    rows = frames.select(*names, (F.to_json(F.struct(group)) if group else F.lit("")).alias("__group"), picture.alias("picture"))
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), f"score double, first boolean, last boolean, picture {PICTURE}"])
    made = keep(rows.repartitionByRange(*names).sortWithinPartitions(*names).mapInArrow(_compared(measure, names), schema))
    # Only a partition's first row can lack its neighbour, which is another partition's last.
    by = Window.partitionBy(group) if group else Window.partitionBy()
    edges = made.filter("first or last").withColumn("before", F.lag("picture").over(by.orderBy(*order))).filter("first")

    @F.pandas_udf("double")
    def over_cut(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        out = []
        for two in zip(a.to_dict("records"), b.to_dict("records")):
            known = all(r["data"] is not None and r["height"] == r["height"] for r in two)
            shapes = np.array([[r[c] for c in ("height", "width", "nChannels")] if known else [-1] * 3 for r in two], np.int64)
            out.append(_measured(measure, shapes, [r["data"] for r in two])[1])
        return pd.Series(out, dtype="float64")

    joined = edges.select(*names, over_cut(F.coalesce("before", F.lit(None).cast(PICTURE)), F.col("picture")).alias("score"))
    return made.filter("not first").select(*names, "score").unionByName(joined)
