"""Duplicate frames: equal and near hashes, neighbours, and both.

The rule for hashes is order-dependent: frames come by file name; a frame within the threshold of a kept one
takes its place if it is strictly better, else it is rejected. Frames only ever meet frames of their own
component of near hashes, so components are resolved apart, each in order.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import pixels
from framelake.operators.graph import connected
from framelake.operators.neighbours import scores
from framelake.operators.numbering import numbered
from framelake.session import keep


def bits(hex_col: Column) -> Column:
    """16 hex digits as a signed 64-bit number."""
    return F.conv(hex_col, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def exact(frames: DataFrame, name: str = "filename", hash_col: str = "phash", quality: str = "quality") -> DataFrame:
    """frames with kept: of equal hashes the best, then first, stays; frames without a hash stay."""
    rank = F.row_number().over(Window.partitionBy(hash_col).orderBy(F.desc(quality), name))
    return frames.withColumn("kept", F.col(hash_col).isNull() | (rank == 1))


def shared_bands(threshold: int, count: int) -> int:
    """How many equal bands to ask of two hashes, of threshold + that many bands: the number with the fewest keys and chance meetings."""

    def cost(m: int) -> float:
        return math.comb(threshold + m, m) * (1 + count / 2 ** (64 * m // (threshold + m)))

    return min(range(1, 7), key=cost)


def near_hashes(hashes: DataFrame, threshold: int, shared: int | None = None) -> DataFrame:
    """Pairs a < b of distinct 64-bit hashes (column h) that differ in at most `threshold` bits.

    Of threshold + m bands two such hashes share m at least, so pairs come from equal sets of m bands, and are verified. More
    hashes take a larger m, whose keys have more bits: with a threshold of 4 two of six bands (21 bits) for a hundred thousand
    hashes, three of seven (27) for some millions, four of eight (32) for a billion."""
    if shared is None:
        hashes = keep(hashes.select("h"))
        shared = shared_bands(threshold, hashes.count())
    n = threshold + shared
    cuts = [64 * i // n for i in range(n + 1)]
    bands = [F.shiftrightunsigned("h", lo).bitwiseAND((1 << (hi - lo)) - 1) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    keys = [F.xxhash64(F.lit(k), *[bands[i] for i in some]) for k, some in enumerate(itertools.combinations(range(n), shared))]
    b = hashes.select("h", F.explode(F.array(*keys)).alias("key"))
    pairs = b.toDF("a", "key").join(b.toDF("b", "key"), "key").filter("a < b")
    return pairs.filter(hamming(F.col("a"), F.col("b")) <= threshold).select("a", "b").distinct()


def components(frames: DataFrame, threshold: int, hash_col: str = "phash") -> DataFrame:
    """frames with component: that of near hashes, or the hash itself."""
    rows = frames.withColumn("h", bits(F.col(hash_col)))
    parts = connected(near_hashes(rows.select("h").dropna().distinct(), threshold)).select(F.col("node").alias("h"), "component")
    return rows.join(parts, "h", "left").withColumn("component", F.coalesce("component", "h")).drop("h")


def _resolve(threshold: int, name: str, hash_col: str, quality: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(name, kind="stable").reset_index(drop=True)
        values = [int(x, 16) for x in pdf[hash_col]]
        score = pdf[quality].fillna(0.0).tolist()
        kept, slots = [True] * len(pdf), []
        for i, v in enumerate(values):
            hit = next((s for s, j in enumerate(slots) if (values[j] ^ v).bit_count() <= threshold), None)
            if hit is None:
                slots.append(i)
            elif score[i] > score[slots[hit]]:
                kept[slots[hit]] = False
                slots[hit] = i
            else:
                kept[i] = False
        return pdf.assign(kept=kept)[[name, "kept"]]

    return run


def near(frames: DataFrame, threshold: int, name: str = "filename", hash_col: str = "phash", quality: str = "quality") -> DataFrame:
    """frames with kept, by the rule above. Threshold 0 needs no components; frames without a hash stay.

    A component is resolved by one task: its size is that of one group of near-equal frames."""
    if threshold <= 0:
        return exact(frames, name, hash_col, quality)
    some = components(frames.filter(F.col(hash_col).isNotNull()).select(name, hash_col, quality), threshold, hash_col)
    size = some.groupBy("component").agg(F.count("*").alias("m")).filter("m > 1")
    groups = some.join(size, "component", "left_semi")
    out = groups.groupBy("component").applyInPandas(_resolve(threshold, name, hash_col, quality), f"{name} string, kept boolean").filter("not kept")
    return frames.join(out.select(name, F.lit(False).alias("lost")), name, "left").withColumn("kept", F.col("lost").isNull()).drop("lost")


def adjacent(frames: DataFrame, similar: Column, name: str = "filename", quality: str = "quality", partition: str | None = None, then: tuple[str, ...] = ()) -> DataFrame:
    """frames with kept: of two neighbours by name (equal names by `then`, in a partition) that are alike the worse goes, of equal ones the later.

    similar: whether a row is like the one before it, in terms of frames' columns. Rejected frames still compare.
    Without a partition neighbours meet by their number, so that no task has all frames."""
    t = frames.withColumn("like", F.coalesce(similar, F.lit(False))).withColumn("q", F.coalesce(F.col(quality), F.lit(0.0)))
    if partition is None:
        t = numbered(t, [name], "__n")
        t = t.join(t.select((F.col("__n") + 1).alias("__n"), F.col("q").alias("before")), "__n", "left")
        t = t.join(t.select((F.col("__n") - 1).alias("__n"), F.col("q").alias("after"), F.col("like").alias("like_after")), "__n", "left").drop("__n")
    else:
        w = Window.partitionBy(partition).orderBy(name, *then)
        t = t.withColumn("before", F.lag("q").over(w)).withColumn("after", F.lead("q").over(w)).withColumn("like_after", F.lead("like").over(w))
    lost = (F.col("like") & F.col("before").isNotNull() & ~(F.col("q") > F.col("before"))) | (F.coalesce("like_after", F.lit(False)) & (F.col("after") > F.col("q")))
    return t.withColumn("kept", ~F.coalesce(lost, F.lit(False))).drop("like", "q", "before", "after", "like_after")


def adjacent_ssim(frames: DataFrame, least: float = 0.95, image: str = "image", name: str = "filename", quality: str = "quality") -> DataFrame:
    """frames with kept, alike where two neighbours' pictures have a structural similarity of `least`. Pictures are moved once, then only their scores."""
    near = scores(frames, [name], pixels.likeness, image).withColumnRenamed("score", "__ssim")
    kept = adjacent(frames.select(name, quality).join(near, name), F.col("__ssim") >= least, name, quality)
    return frames.join(kept.select(name, "kept"), name)


#: What finds duplicates, by the names of the choices.
METHODS = {"Fast (pHash)": "near", "Accurate (LPIPS)": "distance", "Balanced (SSIM)": "ssim", "pHash then LPIPS": "hybrid"}


def dispatch(frames: DataFrame, method: str, threshold: int = 5, least: float = 0.95, distance: DataFrame | None = None, most: float = 0.1) -> DataFrame:
    """frames with kept by the method of that name; any other keeps all."""
    kind = METHODS.get(method)
    if kind == "near":
        return near(frames, threshold)
    if kind == "ssim":
        return adjacent_ssim(frames, least)
    if kind == "hybrid" and distance is not None:
        return hybrid(frames, threshold, distance, most)
    if kind == "distance" and distance is not None:
        # distance: filename and how far its picture is from the one before.
        own = frames.join(distance.select("filename", "distance"), "filename", "left")
        return adjacent(own, F.col("distance") <= most).drop("distance")
    return frames.withColumn("kept", F.lit(True))


def _candidates(threshold: int, name: str, hash_col: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(name, kind="stable").reset_index(drop=True)
        values, slots, out = [int(x, 16) for x in pdf[hash_col]], [], []
        for i, v in enumerate(values):
            hit = next((j for j in slots if (values[j] ^ v).bit_count() <= threshold), None)
            if hit is None:
                slots.append(i)
            else:
                out.append((pdf[name][hit], pdf[name][i]))
        return pd.DataFrame(out, columns=["slot", "frame"])

    return run


def hybrid(frames: DataFrame, threshold: int, distance: DataFrame | Callable[[DataFrame], DataFrame], most: float = 0.1, name: str = "filename", hash_col: str = "phash", quality: str = "quality") -> DataFrame:
    """frames with kept: pairs by hash, here without replacement, confirmed by a distance of at most `most`.

    distance: a table (slot, frame, distance), or what adds the distance to pairs (slot, frame), which then are the only ones measured."""
    some = components(frames.filter(F.col(hash_col).isNotNull()).select(name, hash_col, quality), threshold, hash_col)
    pairs = some.groupBy("component").applyInPandas(_candidates(threshold, name, hash_col), "slot string, frame string")
    pairs = (distance(pairs) if callable(distance) else pairs.join(distance, ["slot", "frame"])).filter(F.col("distance") <= most)
    q = frames.select(F.col(name).alias("n"), F.coalesce(F.col(quality), F.lit(0.0)).alias("q"))
    pairs = pairs.join(q.toDF("slot", "slot_q"), "slot").join(q.toDF("frame", "frame_q"), "frame")
    lost = pairs.select(F.when(F.col("frame_q") > F.col("slot_q"), F.col("slot")).otherwise(F.col("frame")).alias(name)).distinct().withColumn("lost", F.lit(True))
    return frames.join(lost, name, "left").withColumn("kept", F.col("lost").isNull()).drop("lost")


def first_like(frames: DataFrame, selected: str, threshold: int, name: str = "filename", hash_col: str = "phash") -> DataFrame:
    """The first other frame within the threshold of the selected one's hash, if any."""
    one = frames.filter(F.col(name) == selected).limit(1).select(bits(F.col(hash_col)).alias("own"))
    return frames.filter(F.col(name) != selected).join(F.broadcast(one)).filter(hamming(bits(F.col(hash_col)), F.col("own")) <= threshold).orderBy(name).limit(1).drop("own")
