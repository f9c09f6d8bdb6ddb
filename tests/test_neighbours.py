"""Neighbouring pictures for any partitioning, content changes, cuts."""

import colorsys

import numpy as np
import pytest

from framelake.functions import pixels
from framelake.operators import dedup, neighbours, scenes

PIC = "image struct<height: int, width: int, nChannels: int, data: binary>"


def film(seed, n, h=6, w=5):
    rng = np.random.default_rng(seed)
    out, base = [], rng.integers(0, 256, (h, w, 3))
    for i in range(n):
        if i % 9 == 0:
            base = rng.integers(0, 256, (h, w, 3))
        out.append(np.clip(base + rng.integers(-3, 4, (h, w, 3)), 0, 255).astype(np.uint8))
    return out


def rows(videos):
    return [(v, i, None if p is None else (p.shape[0], p.shape[1], 3, p.tobytes())) for v, pics in videos.items() for i, p in enumerate(pics)]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_scores_for_any_partitioning(spark, parts):
    videos = {"a": film(1, 40), "b": film(2, 25), None: film(3, 5)}
    videos["a"][7] = None
    videos["b"][3] = videos["b"][3][:4]
    t = spark.createDataFrame(rows(videos), f"video string, n int, {PIC}").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.video, r.n): r.score for r in neighbours.scores(t, ["n"], pixels.content_change, group="video").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 70
    for v, pics in videos.items():
        for i, p in enumerate(pics):
            before = pics[i - 1] if i else None
            missing = before is None or p is None or before.shape != p.shape
            assert got[v, i] == (None if missing else pytest.approx(pixels.content_change(before, p)))
    assert neighbours.scores(t.limit(0), ["n"], pixels.content_change, group="video").collect() == []


def test_hue_saturation_value():
    rng = np.random.default_rng(4)
    bgr = rng.integers(0, 256, (40, 40, 3)).astype(np.uint8)
    got = pixels.hsv(bgr)
    for (b, g, r), (h, s, v) in zip(bgr.reshape(-1, 3).tolist(), got.reshape(-1, 3).tolist()):
        x, y, z = colorsys.rgb_to_hsv(r / 255, g / 255, b / 255)
        assert v == max(r, g, b) and abs(s - 255 * y) <= 1 and min(abs(h - 180 * x), 180 - abs(h - 180 * x)) <= 1
    assert pixels.hsv(np.zeros((1, 1, 3), np.uint8)).tolist() == [[[0, 0, 0]]]
    known = {(255, 0, 0): (120, 255, 255), (0, 255, 0): (60, 255, 255), (0, 0, 255): (0, 255, 255), (128, 128, 128): (0, 0, 128)}
    for colour, want in known.items():
        assert tuple(pixels.hsv(np.array([[colour]], np.uint8))[0, 0]) == want


def test_cuts(spark):
    pics = film(5, 60)
    t = spark.createDataFrame(rows({"a": pics, "b": pics[:3]}), f"video string, n int, {PIC}")
    s = scenes.content_scores(t, "n", "video")
    got = sorted((r.video, r.shot_id, r.start, r.end) for r in scenes.cuts(s, "n", "video", 27.0, 9).collect())
    assert got == [("a", i, 9 * i, min(60, 9 * i + 9)) for i in range(7)] + [("b", 0, 0, 3)]
    wide = sorted((r.start, r.end) for r in scenes.cuts(s.filter("video = 'a'"), "n", "video", 27.0, 15).collect())
    assert wide == [(0, 18), (18, 36), (36, 54), (54, 60)]


def test_many_cuts_in_linear_time(spark):
    """A shot that opens is appended, not copied with all before it."""
    s = spark.range(300_000).selectExpr("1 AS video", "id AS n", "CAST(99 AS DOUBLE) AS content")
    t = scenes.cuts(s, "n", "video", 20.0, 1)
    assert "aggregate(over" not in t._jdf.queryExecution().optimizedPlan().toString()
    assert t.count() == 300_000 and t.filter("start <> shot_id or end <> start + 1").count() == 0


def test_ssim_neighbours(spark):
    pics = film(6, 20)
    quality = [float(i * 7 % 5) for i in range(20)]
    t = spark.createDataFrame([(f"f{i:03}", (6, 5, 3, p.tobytes()), q) for i, (p, q) in enumerate(zip(pics, quality))], f"filename string, {PIC}, quality double").repartition(4)
    alike = [False] + [pixels.ssim(pixels.gray(a), pixels.gray(b)) >= 0.95 for a, b in zip(pics, pics[1:])]
    lost = set()
    for i in range(1, 20):
        if alike[i]:
            lost.add(f"f{i - 1 if quality[i] > quality[i - 1] else i:03}")
    got = {r.filename for r in dedup.adjacent_ssim(t).filter("kept").select("filename").collect()}
    assert got == {f"f{i:03}" for i in range(20)} - lost and lost


def test_neighbours_of_one_size_are_measured_together(monkeypatch):
    """In stacks of bounded size, as if two by two; other sizes and missing pictures two by two or not at all."""
    rng = np.random.default_rng(8)
    pics = [None if i % 11 == 10 else rng.integers(0, 256, ((9, 8, 3), (9, 8, 1), (7, 8, 3))[i // 5 % 3], dtype=np.uint8) for i in range(60)]
    shapes = np.array([[-1] * 3 if p is None else p.shape for p in pics])
    data = [None if p is None else p.tobytes() + b"more" for p in pics]
    for measure in (pixels.likeness, pixels.content_change):
        calls = []

        def seen(stack, f=measure.stacked, calls=calls):
            calls.append(stack.nbytes)
            return f(stack)

        want = [None] + [None if a is None or b is None else measure(a, b) for a, b in zip(pics, pics[1:])]
        for size in (1, 600, 1 << 20):
            monkeypatch.setattr(neighbours, "STACK", size)
            got = neighbours._measured(measure, shapes, data)
            assert [None if x != x else x for x in got] == [None if w is None else pytest.approx(w, abs=1e-12) for w in want]
        monkeypatch.setattr(measure, "stacked", seen)
        neighbours._measured(measure, shapes, data)
        assert 0 < len(calls) < 25


def test_near_hashes_for_any_bands(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(-(1 << 63), 1 << 63, 40, dtype=np.int64)
    hashes = {int(h) for h in base}
    for h in base:
        for k in range(1, 7):
            hashes.add(int(h ^ np.bitwise_or.reduce(np.int64(1) << rng.choice(63, k, replace=False).astype(np.int64))))
    hashes = sorted(hashes)
    want = {(a, b) for i, a in enumerate(hashes) for b in hashes[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    t = spark.createDataFrame([(h,) for h in hashes], "h long")
    for shared in (None, 1, 2, 3, 4):
        assert {(r.a, r.b) for r in dedup.near_hashes(t, 4, shared).collect()} == want
    found = [dedup.shared_bands(4, 10**k) for k in (2, 5, 7, 9)]
    assert found == sorted(found) and found[0] < found[-1]
