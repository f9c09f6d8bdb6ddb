"""Masks, neighbours, numbers and checked joins against plain loops."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import masks as M
from framelake.functions import pixels as P
from framelake.operators import checked, dedup
from framelake.operators import masks as O
from framelake.operators.numbering import numbered
from framelake.plans import QUERIES, masks
from oracle import DATA


def test_words_like_arrays(spark):
    rnd = random.Random(1)
    rows = [(i, [int(rnd.random() < 0.4) for _ in range(n)], [int(rnd.random() < 0.5) for _ in range(n)]) for i, n in enumerate([1, 2, 63, 64, 65, 130, 200])] + [(99, [], [])]
    t = spark.createDataFrame(rows, "id int, a array<int>, b array<int>").withColumns({"x": M.packed(F.col("a")), "y": M.packed(F.col("b"))})
    got = {r.id: r for r in t.select("id", M.area(F.col("x")).alias("area"), M.iou(F.col("x"), F.col("y")).alias("iou"), M.iom(F.col("x"), F.col("y")).alias("iom"), M.runs(F.col("a")).alias("runs")).collect()}
    for i, a, b in rows:
        x, y = np.array(a, bool), np.array(b, bool)
        assert got[i].area == x.sum() and got[i].iou == pytest.approx(P.mask_iou(x, y)) and got[i].iom == pytest.approx(P.mask_iom(x, y))
        if a:
            assert got[i].runs == P.rle(x.reshape(-1, 1))


def test_mask_assignment_like_trying_all(spark):
    dets, tracks = masks._sides(spark, DATA)
    cells = {}
    for r in O.overlaps(dets, tracks).collect():
        cells.setdefault(r.image_id, {})[r.idx, r.track_id] = r.iou
    total = {}
    for r in O.assigned(dets, tracks).collect():
        assert r.matched == (cells[r.image_id][r.idx, r.track_id] >= 0.5) and r.weighted == pytest.approx(r.score * cells[r.image_id][r.idx, r.track_id])
        total.setdefault(r.image_id, []).append((r.idx, r.track_id))
    assert set(total) == set(cells)
    for image, iou in cells.items():
        d, t = sorted({i for i, _ in iou}), sorted({j for _, j in iou})
        pairs = total[image]
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs) == min(len(d), len(t))
        if max(len(d), len(t)) <= 6:
            few, many = (d, t) if len(d) <= len(t) else (t, d)
            best = max(sum(iou[(f, m) if few is d else (m, f)] for f, m in zip(few, p, strict=True)) for p in itertools.permutations(many, len(few)))
            assert sum(iou[p] for p in pairs) == pytest.approx(best)


def test_numbers_across_partitions(spark):
    rnd = random.Random(2)
    values = [rnd.randrange(500) for _ in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = numbered(spark.createDataFrame([(v,) for v in values], "v int").repartition(5), ["v"], "n", 7).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.v for r in sorted(got, key=lambda r: r.n)] == sorted(values) and sorted(r.n for r in got) == list(range(7, 3007))
    assert numbered(spark.createDataFrame([], "v int"), ["v"], "n").collect() == []


def test_neighbours_without_partition(spark):
    rnd = random.Random(3)
    rows = [(f"f{i:04d}", float(rnd.randrange(4)), rnd.random() < 0.5) for i in range(400)]
    kept = [True] * len(rows)
    for i in range(1, len(rows)):
        if rows[i][2]:
            kept[i - 1 if rows[i][1] > rows[i - 1][1] else i] = False
    t = spark.createDataFrame(rows, "filename string, quality double, like_it boolean").repartition(3)
    got = {r.filename: r.kept for r in dedup.adjacent(t, F.col("like_it")).collect()}
    assert [got[r[0]] for r in rows] == kept


def test_ssim_duplicates_like_loops(spark):
    rows = masks._pictures(spark, DATA).orderBy("p_partkey").collect()
    pics = [np.frombuffer(r.image.data, np.uint8).reshape(16, 16) for r in rows]
    quality = [r.p_partkey * 7 % 101 for r in rows]
    kept = [True] * len(rows)
    for i in range(1, len(rows)):
        if P.ssim(pics[i - 1], pics[i]) >= 0.6:
            kept[i - 1 if quality[i] > quality[i - 1] else i] = False
    got = sorted((r.filename, r.kept) for r in QUERIES["dedup_ssim"](spark, DATA).collect())
    assert [k for _, k in got] == kept and not all(kept)


def test_plain_structural_similarity():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 256, (12, 11)).astype(np.uint8), rng.integers(0, 256, (12, 11)).astype(np.uint8)
    total = []
    for i in range(6):
        for j in range(5):
            x, y = (p[i : i + 7, j : j + 7].astype(float).ravel() for p in (a, b))
            c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
            total.append((2 * x.mean() * y.mean() + c1) * (2 * np.cov(x, y)[0, 1] + c2) / ((x.mean() ** 2 + y.mean() ** 2 + c1) * (x.var(ddof=1) + y.var(ddof=1) + c2)))
    assert P.ssim(a, b) == pytest.approx(np.mean(total))


def test_hash_of_a_picture_at_its_own_size():
    """At 32 by 32 nothing is resized, so the hash is that of a plain cosine transform."""
    g = np.random.default_rng(4).integers(0, 256, (32, 32)).astype(np.uint8)
    low = [[sum(float(g[y, x]) * np.cos(np.pi * u * (2 * y + 1) / 64) * np.cos(np.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]
    bits = (np.array(low) > np.median(low)).ravel()
    assert P.phash(g) == f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"
    flat = np.full((100, 80), 77, np.uint8)
    assert (P._shrunk(flat, 32) == 77).all() and (np.abs(P._lanczos(100, 32).sum(1) - (1 << 22)) < 40).all()
    ramp = np.repeat(np.arange(128, dtype=np.uint8)[None], 64, 0)
    assert (np.diff(P._shrunk(ramp, 32)[0]) >= 3).all()


def test_missing_partners_are_errors(spark):
    tracks = spark.createDataFrame([(0, 1, 0, 0.5, [[1.0, 2.0, 3.0, 4.0], None, [0.0] * 4, [1.0, 1.0, 2.0, 2.0]], None)], "video_id int, track_id int, category_id int, score double, boxes array<array<double>>, areas array<double>")
    images = spark.createDataFrame([(0, f, 10 + f) for f in range(4)], "video_id int, frame_index int, image_id int")
    assert sorted((r.image_id, r.area) for r in checked.predictions_to_images(tracks, images).collect()) == [(10, 12.0), (13, 4.0)]
    with pytest.raises(Exception, match="prediction without an image"):
        checked.predictions_to_images(tracks, images.filter("frame_index < 3")).collect()
    for use in (lambda t: t.count(), lambda t: t.select("track_id").collect(), lambda t: t.groupBy("video_id").count().collect()):
        with pytest.raises(Exception, match="prediction without an image"):
            use(checked.predictions_to_images(tracks, images.filter("frame_index < 3")))
    videos = spark.createDataFrame([(1,), (2,)], "video_id int")
    mixed = spark.createDataFrame([(1, ["a"]), (1, ["b"]), (2, ["b"])], "video_id int, tags array<string>")
    assert [r.video_id for r in checked.tagged(videos, mixed.filter("video_id = 2"), "b").collect()] == [2]
    with pytest.raises(Exception, match="not all annotations"):
        checked.tagged(videos, mixed, "a").collect()
    names = spark.createDataFrame([(1, "cat")], "category_id int, name string")
    files = spark.createDataFrame([(1, ["x", "y"])], "video_id int, file_names array<string>")
    pairs = spark.createDataFrame([(1, 1, "cat")], "video_id int, category_id int, noun_phrase string")
    assert checked.video_phrases(files, pairs, names).count() == 2
    with pytest.raises(Exception, match="category name does not match"):
        checked.video_phrases(files, pairs.withColumn("noun_phrase", F.lit("dog")), names).collect()
    for wrong in (pairs.withColumn("noun_phrase", F.lit("dog")), pairs.withColumn("category_id", F.lit(5)), pairs.withColumn("noun_phrase", F.lit(None).cast("string"))):
        with pytest.raises(Exception, match="category name does not match"):
            checked.video_phrases(files, wrong, names).count()


def test_retries():
    waits, calls = [], []

    def fails(n):
        def run():
            calls.append(1)
            if len(calls) < n:
                raise ValueError("no")
            return "done"

        return run

    assert checked.retried(fails(3), wait=waits.append) == "done" and waits == [1, 5]
    calls.clear()
    with pytest.raises(ValueError, match="no"):
        checked.retried(fails(9), wait=waits.append)
