"""Masks as arrays of 64-bit words, a bit a pixel: areas and overlaps are bit counts inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(m: Column) -> Column:
    """Pixels that are on."""
    return F.aggregate(m, F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w))


def both(a: Column, b: Column) -> Column:
    """Pixels that are on in both; words that one mask lacks are off."""
    return area(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0).cast("long")).bitwiseAND(F.coalesce(y, F.lit(0).cast("long")))))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, which counts 1 at least."""
    i = both(a, b)
    return i / F.greatest(F.lit(1), area(a) + area(b) - i)


def iom(a: Column, b: Column) -> Column:
    """Intersection over the smaller area."""
    return both(a, b) / (F.least(area(a), area(b)) + F.lit(1e-8))


def of_cells(rows: int, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A box of whole cells, far edges excluded, on a grid of so many rows of 64 cells: a word a row."""
    word = F.call_function("shiftleft", F.lit(1).cast("long"), x2.cast("int")) - F.call_function("shiftleft", F.lit(1).cast("long"), x1.cast("int"))
    return F.array(*[F.when((F.lit(r) >= y1) & (F.lit(r) < y2) & (x2 > x1), word).otherwise(F.lit(0).cast("long")) for r in range(rows)])


def packed(on: Column) -> Column:
    """An array of 0 and 1 as words, the first pixel in the lowest bit."""
    words = F.sequence(F.lit(0), F.floor((F.size(on) - 1) / 64).cast("int"))
    bit = lambda w, i: F.call_function("shiftleft", F.coalesce(F.get(on, w * 64 + i), F.lit(0)).cast("long"), i.cast("int"))
    return F.when(F.size(on) > 0, F.transform(words, lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda n, i: n.bitwiseOR(bit(w, i))))).otherwise(F.array().cast("array<bigint>"))


def runs(on: Column) -> Column:
    """Lengths of the runs of an array of 0 and 1, the first of zeros."""
    cuts = F.filter(F.sequence(F.lit(1), F.size(on) - 1), lambda i: F.get(on, i) != F.get(on, i - 1))
    cuts = F.when(F.size(on) > 1, cuts).otherwise(F.array().cast("array<int>"))
    first = F.when(F.get(on, F.lit(0)) == 1, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    ends = F.concat(first, cuts, F.array(F.size(on)))
    # Side by side with the ends before; a lambda that reads `ends` would make it again for each of them.
    return F.zip_with(ends, F.slice(F.concat(F.array(F.lit(0)), ends), F.lit(1), F.size(ends)), lambda e, b: e - b)


def polygon_area(points: Column) -> Column:
    """The area that an array of (x, y) encloses, by the shoelace formula."""
    n = F.size(points)
    cross = F.transform(points, lambda p, i: p[0] * F.get(points, (i + 1) % n)[1] - F.get(points, (i + 1) % n)[0] * p[1])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, c: a + c)) / 2
