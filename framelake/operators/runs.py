"""Masks of any size as rows of runs: key, x, lo, hi, the rows lo..hi-1 of one column that are on.

Runs of a mask in one column neither overlap nor touch. Boolean operations, dilation, erosion, closing and boundaries are
sweeps along columns over the edges of runs, filling too; nothing is decoded to pixels. Masks are dealt and sorted by key once
a call, and a task works on one Arrow batch of whole masks at a time, however many steps the call has. Connected parts come from
the overlaps of runs in neighbouring columns. A mask's runs are at most half its pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import sweeps as S
from framelake.functions.groups import Arrays, per_group
from framelake.functions.pixels import linked
from framelake.session import keep

Element = dict[int, int]
#: Pairs of masks that are unpacked at a time.
PAIRS = 64


def square(radius: int) -> Element:
    """Offsets of columns and how far each reaches up and down."""
    return dict.fromkeys(range(-radius, radius + 1), radius)


def ellipse(size: int) -> Element:
    """The ellipse that common imaging libraries draw in a square of odd size: each row's half width is rounded."""
    r = size // 2
    half = {y: round(r * ((r * r - y * y) / max(1, r * r)) ** 0.5) for y in range(-r, r + 1)}
    return {x: max(y for y, w in half.items() if abs(x) <= w) for x in range(-r, r + 1)}


def _by_masks(layers: list[DataFrame], fn: Callable[[list[S.Runs], int], tuple[np.ndarray, list]], key: str, out: str = "x int, lo int, hi int") -> DataFrame:
    """fn's rows (numbers of masks, other columns) for batches of whole masks: of each layer the runs, and how many masks.

    Masks are dealt and sorted by key alone, as rows of numbers; a batch, not a partition, is what a task works on."""
    rows = reduce(DataFrame.unionByName, [t.select(key, *[F.col(c).cast("int").alias(c) for c in ("x", "lo", "hi")], F.lit(i).alias("layer")) for i, t in enumerate(layers)])
    schema, many = f"`{key}` {dict(rows.dtypes)[key]}, {out}", len(layers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last mask, as far as it came

        def work(t: pa.Table, number: np.ndarray) -> pa.RecordBatch:
            x, lo, hi, layer = (t.column(c).to_numpy().astype(np.int64) for c in ("x", "lo", "hi", "layer"))
            every = S.Runs(number, x, lo, hi)
            m, columns = fn([S.some(every, layer == i) for i in range(many)], int(number[-1]) + 1)
            first = np.searchsorted(number, m)
            keys = t.column(key).combine_chunks().take(pa.array(first))
            kinds = [pa.int32() if k.strip().endswith(" int") else None for k in out.split(",")]
            return pa.RecordBatch.from_arrays([keys, *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], names=[key, *(k.split()[0] for k in out.split(","))])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([*held, batch])
            k = t.column(key).combine_chunks()
            one, two = k.slice(1), k.slice(0, len(k) - 1)
            unlike = pc.fill_null(pc.not_equal(one, two), True).to_numpy(zero_copy_only=False) & ~pc.and_(pc.is_null(one), pc.is_null(two)).to_numpy(zero_copy_only=False)
            number = np.concatenate([[0], np.cumsum(unlike)]).astype(np.int64)
            cut = int(np.searchsorted(number, number[-1]))
            if cut:
                yield work(t.slice(0, cut), number[:cut])
            held = t.slice(cut).to_batches()
        if held:
            t = pa.Table.from_batches(held)
            yield work(t, np.zeros(t.num_rows, np.int64))

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def _numbers(r: S.Runs) -> tuple[np.ndarray, list]:
    return r.m, [r.x, r.lo, r.hi]


def swept(layers: list[DataFrame], keep: Callable[[list[np.ndarray], np.ndarray], np.ndarray], key: str = "mask_id") -> DataFrame:
    """Runs where keep(which layers are on, x) holds. Runs of a layer may overlap; those of the result don't and don't touch."""
    return _by_masks(layers, lambda r, n: _numbers(S.swept(r, keep)), key)


def both(a: DataFrame, b: DataFrame, key: str = "mask_id") -> DataFrame:
    return swept([a, b], lambda on, x: on[0] & on[1], key)


def either(a: DataFrame, b: DataFrame, key: str = "mask_id") -> DataFrame:
    return swept([a, b], lambda on, x: on[0] | on[1], key)


def minus(a: DataFrame, b: DataFrame, key: str = "mask_id") -> DataFrame:
    return swept([a, b], lambda on, x: on[0] & ~on[1], key)


def unlike(a: DataFrame, b: DataFrame, key: str = "mask_id") -> DataFrame:
    return swept([a, b], lambda on, x: on[0] != on[1], key)


def measured(runs: DataFrame, key: str = "mask_id") -> DataFrame:
    """key, area, x1, y1, x2, y2: the box's far edges are one beyond the mask. A mask without runs gives no row."""
    return runs.groupBy(key).agg(F.sum(F.col("hi") - F.col("lo")).cast("long").alias("area"), F.min("x").alias("x1"), F.min("lo").alias("y1"), (F.max("x") + 1).alias("x2"), F.max("hi").alias("y2"))


def shifted(runs: DataFrame, dx: int, dy: int) -> DataFrame:
    return runs.withColumns({"x": F.col("x") + dx, "lo": F.col("lo") + dy, "hi": F.col("hi") + dy})


def clipped(runs: DataFrame, width: int, height: int) -> DataFrame:
    """What of the runs is in a frame."""
    runs = runs.withColumns({"lo": F.greatest("lo", F.lit(0)), "hi": F.least("hi", F.lit(height))})
    return runs.filter((F.col("x") >= 0) & (F.col("x") < width) & (F.col("lo") < F.col("hi")))


def flipped(runs: DataFrame, width: int, height: int, across: bool = True) -> DataFrame:
    """Runs mirrored in their frame: left and right change places, or else top and bottom."""
    if across:
        return runs.withColumn("x", F.lit(width - 1) - F.col("x"))
    return runs.withColumns({"lo": F.lit(height) - F.col("hi"), "hi": F.lit(height) - F.col("lo")})


def cropped(runs: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """What a part of the frame has of the runs, in the part's own columns and rows. A part may reach beyond the frame, which pads it."""
    return clipped(shifted(runs, -x, -y), width, height)


def semantic(runs: DataFrame, group: DataFrame, key: str = "mask_id", by: str = "category_id") -> DataFrame:
    """Runs (by, x, lo, hi) of all masks of a group (key, by) together. A group can have any number of masks, so its columns are dealt apart."""
    order = Window.partitionBy(by, "x").orderBy("lo")
    t = runs.join(group.select(key, by), key).select(by, "x", "lo", "hi")
    t = t.withColumn("__reach", F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    t = t.withColumn("__part", F.sum(F.when(F.col("lo") <= F.col("__reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy(by, "x", "__part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("__part")


def dilated(runs: DataFrame, element: Element, width: int, height: int, key: str = "mask_id") -> DataFrame:
    return _by_masks([runs], lambda r, n: _numbers(S.dilated(r[0], element, width, height)), key)


def eroded(runs: DataFrame, element: Element, width: int, height: int, key: str = "mask_id") -> DataFrame:
    """What stays when the off pixels grow; beyond the frame nothing grows."""
    return _by_masks([runs], lambda r, n: _numbers(S.eroded(r[0], element, width, height)), key)


def closed(runs: DataFrame, element: Element, width: int, height: int, key: str = "mask_id") -> DataFrame:
    return _by_masks([runs], lambda r, n: _numbers(S.closed(r[0], element, width, height)), key)


def boundary(runs: DataFrame, width: int, height: int, key: str = "mask_id") -> DataFrame:
    """Pixels that differ from the one to the east, south or south-east; in the last column or row only along it."""
    return _by_masks([runs], lambda r, n: _numbers(S.boundary(r[0], width, height)), key)


def boundary_scores(pairs: DataFrame, truth: DataFrame, found: DataFrame, radius: int, width: int, height: int) -> DataFrame:
    """pairs (gt_id, dt_id) with f: the harmonic mean of the shares of each boundary that is within a square of the other.

    A mask's boundary, and what is near it, are made once and are one row; pairs bring those rows together, not their runs."""
    element = square(radius)

    def edges(r: list[S.Runs], n: int) -> tuple[np.ndarray, list]:
        own = S.boundary(r[0], width, height)
        return np.arange(n), [S.areas(own, n), S.packed(own, n), S.packed(S.dilated(own, element, width, height), n)]

    def made(t: DataFrame) -> DataFrame:
        return keep(_by_masks([t], edges, "mask_id", "n long, own binary, wide binary"))

    gt = made(truth)
    dt = gt if found is truth else made(found)
    t = pairs
    for side, b in (("gt", gt), ("dt", dt)):
        t = t.join(b.toDF(f"{side}_id", *(f"__{side}_{c}" for c in ("n", "own", "wide"))), f"{side}_id", "left")
    t = t.select(*pairs.columns, *(f"__{side}_{c}" for c in ("n", "own", "wide") for side in ("gt", "dt")))
    plain = [*pairs.columns, "__gt_n", "__dt_n"]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PAIRS):
                batch = whole.slice(at, PAIRS)
                masks = [S.unpacked(batch.column(c).to_pylist()) for c in ("__gt_own", "__dt_wide", "__dt_own", "__gt_wide")]
                counts = [S.areas(S.both(a, b), batch.num_rows) for a, b in (masks[:2], masks[2:])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in plain), *map(pa.array, counts)], names=[*plain, "__gt_met", "__dt_met"])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in t.select(*plain).dtypes)
    out = t.mapInArrow(met, f"{schema}, __gt_met long, __dt_met long")
    gn, dn, gm, dm = (F.coalesce(F.col(f"__{c}"), F.lit(0)) for c in ("gt_n", "dt_n", "gt_met", "dt_met"))
    precision = F.when(dn > 0, F.when(gn > 0, dm / dn).otherwise(0.0)).otherwise(1.0)
    recall = F.when(gn > 0, F.when(dn > 0, gm / gn).otherwise(0.0)).otherwise(1.0)
    f = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return out.withColumn("f", f).drop("__gt_n", "__dt_n", "__gt_met", "__dt_met")


def overlaps(masks: DataFrame, runs: DataFrame, least: float = 0.0, group: str = "image_id", side: str | None = None) -> DataFrame:
    """group, a, b, iou of pairs of masks (group, mask_id) of a group that overlap by more than least; with a side (column), only pairs of a lower and a higher one.

    Boxes and areas, a row a mask, decide which pairs could; only those bring their runs together, column by column."""
    box = masks.select(group, "mask_id", F.col(side or "mask_id").alias("side")).join(measured(runs), "mask_id")
    one = lambda n: box.select(group, *[F.col(c).alias(f"{n}_{c}") for c in ("mask_id", "side", "area", "x1", "y1", "x2", "y2")])
    pairs = one("a").join(one("b"), group).filter("a_side < b_side")
    inner = lambda u, v: F.greatest(F.lit(0), F.least(f"a_{v}", f"b_{v}") - F.greatest(f"a_{u}", f"b_{u}")).cast("long")
    most = F.least(inner("x1", "x2") * inner("y1", "y2"), F.least("a_area", "b_area"))
    pairs = pairs.filter((most > 0) & (most > least * (F.col("a_area") + F.col("b_area") - most)))
    pairs = pairs.select(group, F.col("a_mask_id").alias("a"), F.col("b_mask_id").alias("b"), "a_area", "b_area")
    mine = pairs.join(runs.select(F.col("mask_id").alias("a"), "x", F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi")), "a")
    met = mine.join(runs.select(F.col("mask_id").alias("b"), "x", "lo", "hi"), ["b", "x"]).filter("lo < a_hi and hi > a_lo")
    met = met.groupBy(group, "a", "b").agg(F.first("a_area").alias("m"), F.first("b_area").alias("n"), F.sum(F.least("hi", "a_hi") - F.greatest("lo", "a_lo")).alias("met"))
    return met.select(group, "a", "b", (F.col("met") / (F.col("m") + F.col("n") - F.col("met"))).alias("iou")).filter(F.col("iou") > least)


def parted(runs: DataFrame, diagonal: bool = True, key: str = "mask_id") -> DataFrame:
    """runs with part, the same for runs that are connected: a number within the mask."""
    kind = dict(runs.dtypes)[key]

    def run(a: Arrays) -> Arrays:
        return {key: a[key], "x": a["x"], "lo": a["lo"], "hi": a["hi"], "part": linked(a["x"], a["lo"], a["hi"], diagonal)}

    return per_group(runs.select(key, "x", "lo", "hi"), [key], ["x", "lo"], f"{key} {kind}, x int, lo int, hi int, part long", run)


def part_sizes(parts: DataFrame, key: str = "mask_id") -> DataFrame:
    """parts with size, the pixels of the part."""
    return parts.withColumn("size", F.sum(F.col("hi") - F.col("lo")).over(Window.partitionBy(key, "part")).cast("long"))


def largest(runs: DataFrame, key: str = "mask_id") -> DataFrame:
    """The largest connected part of each mask; of equal ones the first from the left."""
    t = part_sizes(parted(runs, key=key), key)
    best = F.max_by(F.col("part"), F.struct("size", -F.col("part"))).over(Window.partitionBy(key))
    return t.withColumn("__best", best).filter("part = __best").select(key, "x", "lo", "hi")


def filled(runs: DataFrame, most: int, width: int, height: int, key: str = "mask_id") -> DataFrame:
    """Masks without holes, then without specks, of at most so many pixels; parts of both are those of eight neighbours in the frame."""
    return _by_masks([runs], lambda r, n: _numbers(S.filled(r[0], most, width, height)), key)


def counts(runs: DataFrame, width: int, height: int, key: str = "mask_id") -> DataFrame:
    """key, counts: run lengths down the columns of a frame, off and on in turn from off. A mask without runs gives no row."""
    flat = runs.select(key, (F.col("x").cast("long") * height + F.col("lo")).alias("at"), (F.col("x").cast("long") * height + F.col("hi")).alias("end"))
    order = Window.partitionBy(key).orderBy("at")
    flat = flat.withColumn("__part", F.when(F.lag("end").over(order) == F.col("at"), 0).otherwise(1))
    flat = flat.withColumn("__part", F.sum("__part").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = flat.groupBy(key, "__part").agg(F.min("at").alias("at"), F.max("end").alias("end"))
    ends = whole.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "end"))).alias("r"), F.max("end").alias("last"))
    rest = F.when(F.col("last") < width * height, F.array(F.lit(width * height).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    edges = F.concat(F.flatten(F.transform("r", lambda r: F.array(r["at"], r["end"]))), rest)
    return ends.select(key, edges.alias("e")).select(key, F.transform("e", lambda v, i: v - F.when(i > 0, F.get("e", i - 1)).otherwise(0)).cast("array<int>").alias("counts"))


def from_counts(masks: DataFrame, height: int, key: str = "mask_id") -> DataFrame:
    """Runs of masks (key, counts) of a frame of so many rows."""
    t = masks.select(key, F.posexplode("counts").alias("place", "n"))
    end = F.sum("n").over(Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("end", end).filter("place % 2 = 1 and n > 0").withColumn("at", F.col("end") - F.col("n"))
    t = t.withColumn("x", F.explode(F.sequence(F.floor(F.col("at") / height), F.floor((F.col("end") - 1) / height))))
    start = F.col("x") * height
    return t.select(key, F.col("x").cast("int").alias("x"), F.greatest(F.col("at") - start, F.lit(0)).cast("int").alias("lo"), F.least(F.col("end") - start, F.lit(height)).cast("int").alias("hi"))
