"""Run algebra, borders, text form, points and crops against dense arrays."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import mask_text, pixels
from framelake.operators import contours, runs

W, H = 61, 47


def shapes(n, seed, w=W, h=H):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    out = []
    for i in range(n):
        m = np.zeros((h, w), bool)
        for _ in range(rng.integers(1, 4)):
            cx, cy, r, s = rng.integers(0, w), rng.integers(0, h), rng.integers(1, w // 3), rng.integers(1, h // 3)
            m ^= ((x - cx) / r) ** 2 + ((y - cy) / s) ** 2 <= 1
        m ^= rng.random((h, w)) < rng.choice([0, 0.01, 0.3])
        m[0, 0] |= not m.any()
        out.append(m)
    return out


def column_runs(m):
    p = np.pad(m, ((1, 1), (0, 0))).astype(np.int8)
    d = np.diff(p, axis=0)
    out = []
    for x in range(m.shape[1]):
        out += [(x, int(a), int(b)) for a, b in zip(np.flatnonzero(d[:, x] == 1), np.flatnonzero(d[:, x] == -1))]
    return out


def frame(spark, masks):
    return spark.createDataFrame([(i, *r) for i, m in enumerate(masks) for r in column_runs(m)], "mask_id int, x int, lo int, hi int").repartition(3)


def back(df, n, w=W, h=H, key="mask_id"):
    out = [np.zeros((h, w), np.int8) for _ in range(n)]
    for r in df.collect():
        out[r[key]][r.lo : r.hi, r.x] += 1
    assert all((m <= 1).all() for m in out)
    return [m.astype(bool) for m in out]


def alike(df, want, w=W, h=H):
    assert all((a == b).all() for a, b in zip(back(df, len(want), w, h), want))


def grown(m, element):
    out = np.zeros_like(m)
    for y, x in np.argwhere(m):
        for dx, k in element.items():
            if 0 <= x + dx < m.shape[1]:
                out[max(0, y - k) : y + k + 1, x + dx] = True
    return out


def shrunk(m, element):
    return ~grown(~m, element)


def test_boolean_operations(spark):
    a, b = shapes(9, 1), shapes(9, 2)
    ra, rb = frame(spark, a), frame(spark, b)
    for f, op in ((runs.both, np.logical_and), (runs.either, np.logical_or), (runs.unlike, np.logical_xor), (runs.minus, lambda p, q: p & ~q)):
        got = f(ra, rb)
        alike(got, [op(p, q) for p, q in zip(a, b)])
        assert sorted((r.mask_id, r.x, r.lo, r.hi) for r in got.collect()) == sorted((i, *r) for i, (p, q) in enumerate(zip(a, b)) for r in column_runs(op(p, q)))
    for r in runs.measured(ra).collect():
        ys, xs = np.nonzero(a[r.mask_id])
        assert (r.area, r.x1, r.y1, r.x2, r.y2) == (len(xs), xs.min(), ys.min(), xs.max() + 1, ys.max() + 1)


def test_morphology(spark):
    masks = shapes(6, 3)
    t = frame(spark, masks)
    assert runs.ellipse(5) == {-2: 1, -1: 1, 0: 2, 1: 1, 2: 1} and runs.ellipse(1) == {0: 0}
    for element in (runs.square(1), runs.ellipse(5), runs.ellipse(7)):
        alike(runs.dilated(t, element, W, H), [grown(m, element) for m in masks])
        alike(runs.eroded(t, element, W, H), [shrunk(m, element) for m in masks])
        alike(runs.closed(t, element, W, H), [shrunk(grown(m, element), element) for m in masks])


def plain_boundary(m):
    east, south, corner = np.zeros_like(m), np.zeros_like(m), np.zeros_like(m)
    east[:, :-1], south[:-1], corner[:-1, :-1] = m[:, 1:], m[1:], m[1:, 1:]
    b = (m ^ east) | (m ^ south) | (m ^ corner)
    b[-1], b[:, -1] = m[-1] ^ east[-1], m[:, -1] ^ south[:, -1]
    b[-1, -1] = False
    return b


def test_boundaries(spark):
    a, b = shapes(6, 4), shapes(6, 5)
    b[0] = a[0]
    ra, rb = frame(spark, a), frame(spark, b)
    alike(runs.boundary(ra, W, H), [plain_boundary(m) for m in a])
    pairs = spark.createDataFrame([(i, j) for i in range(6) for j in range(3)] + [(0, 99)], "gt_id int, dt_id int")
    for r in runs.boundary_scores(pairs, ra, rb, 2, W, H).collect():
        if r.dt_id == 99:
            assert r.f == 0
            continue
        x, y = plain_boundary(a[r.gt_id]), plain_boundary(b[r.dt_id])
        p, q = (y & grown(x, runs.square(2))).sum() / y.sum(), (x & grown(y, runs.square(2))).sum() / x.sum()
        assert r.f == pytest.approx(2 * p * q / (p + q) if p + q else 0)
        assert r.gt_id or r.dt_id or r.f == 1


def test_parts_and_filling(spark):
    masks = shapes(8, 6)
    t = frame(spark, masks)
    for diagonal in (True, False):
        got = {}
        for r in runs.parted(t, diagonal).collect():
            got.setdefault((r.mask_id, r.part), []).append((r.x, r.lo, r.hi))
        for i, m in enumerate(masks):
            label, sizes = pixels.components(m, diagonal)
            parts = [v for (k, _), v in got.items() if k == i]
            assert sorted(sum(hi - lo for _, lo, hi in v) for v in parts) == sorted(s for s in sizes[1:] if s)
            assert all(len({int(label[y, x]) for x, lo, hi in v for y in range(lo, hi)}) == 1 for v in parts)
    big = back(runs.largest(t), 8)
    for m, g in zip(masks, big):
        assert g.sum() == pixels.components(m)[1][1:].max() and not (g & ~m).any()
    alike(runs.filled(t, 12, W, H), [pixels.fill_holes(m, 12) for m in masks])


def test_overlaps_on_runs(spark):
    masks = shapes(10, 7)
    t = frame(spark, masks)
    rows = spark.createDataFrame([(i % 2, i) for i in range(10)], "image_id int, mask_id int")
    for least in (0.0, 0.2):
        want = {(i, j): pixels.mask_iou(masks[i], masks[j]) for i in range(10) for j in range(i + 2, 10, 2)}
        want = {k: v for k, v in want.items() if v > least}
        got = {(r.a, r.b): r.iou for r in runs.overlaps(rows, t, least).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def plain_text(counts):
    out = ""
    for i, c in enumerate(counts):
        v = c - counts[i - 2] if i > 2 else c
        while True:
            low, v = v & 31, v >> 5
            more = v != (-1 if low & 16 else 0)
            out += chr(low + 32 * more + 48)
            if not more:
                break
    return out


def test_counts_and_text(spark):
    masks = shapes(8, 8)
    masks[3][:] = True
    t = runs.counts(frame(spark, masks), W, H)
    rows = t.withColumn("text", mask_text.to_text(F.col("counts"))).withColumn("again", mask_text.from_text("text")).collect()
    for r in rows:
        want = pixels.rle(masks[r.mask_id])
        assert r.counts == want and r.text == plain_text(want) and r.again == want
    alike(runs.from_counts(t, H), masks)
    # Three masks and their texts.
    known = {"52203": [5, 2, 2, 2, 5], "0`4`7": None, "]n0\\O": None}
    texts = [plain_text([6, 1, 40, 4, 5, 4, 5, 4, 21]), plain_text([0, 1, 100000, 3, 7, 2000])]
    lists, offsets = mask_text.decode([*texts, "", "52203"])
    assert [lists[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [[6, 1, 40, 4, 5, 4, 5, 4, 21], [0, 1, 100000, 3, 7, 2000], [], [5, 2, 2, 2, 5]]
    assert texts[0] == "61X13mN000`0" and known["52203"]
    odd = spark.createDataFrame([(1, None), (2, []), (3, [7])], "mask_id int, counts array<int>").withColumn("text", mask_text.to_text(F.col("counts"))).withColumn("again", mask_text.from_text("text"))
    assert {r.mask_id: (r.text, r.again) for r in odd.collect()} == {1: (None, None), 2: ("", []), 3: ("7", [7])}


def test_contours(spark):
    masks = shapes(8, 9)
    masks += [np.zeros((H, W), bool) for _ in range(3)]
    masks[8][5, 5] = True
    masks[9][3:10, 3:10], masks[9][5:8, 5:8], masks[9][6, 6] = True, False, True
    masks[10][4:7, 4:7], masks[10][5, 5] = True, False
    t = frame(spark, masks)
    borders = contours.contours(t)
    alike(contours.from_corners(borders), masks)
    by = {}
    for r in borders.collect():
        by.setdefault(r.mask_id, []).append(r)
    for i, m in enumerate(masks):
        p = np.pad(m, 1)
        _, parts = pixels.components(m)
        _, holes = pixels.components(~p, eight=False)
        got = sorted(by[i], key=lambda r: r.contour)
        assert sum(not r.hole for r in got) == len(parts) - 1 and sum(r.hole for r in got) == len(holes) - 2
        assert sum(r.area for r in got) == m.sum()
        assert sum(r.edges for r in got) == (p[1:] != p[:-1]).sum() + (p[:, 1:] != p[:, :-1]).sum()
        for r in got:
            assert all(m[y, x] for x, y in r.pixels)
            assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(r.pixels, r.pixels[1:] + r.pixels[:1])) or len(r.pixels) == 1
            assert r.parent == -1 if not r.hole else not got[r.parent].hole
    assert [r.pixels for r in by[8]] == [[[5, 5]]]
    assert [(r.hole, r.parent) for r in sorted(by[9], key=lambda r: r.contour)] == [(False, -1), (False, -1), (True, 0)]
    hole = next(r for r in by[10] if r.hole)
    assert sorted(map(tuple, hole.pixels)) == [(4, 5), (5, 4), (5, 6), (6, 5)]
    lines = {r.mask_id: r for r in contours.polygons(borders).collect()}
    assert lines[8].polygons == [] and lines[10].has_holes and len(lines[10].polygons) == 2 and lines[10].polygons[0][:2] == [4.5, 4.5]


def plain_distances(m):
    p = np.pad(m, 1)
    off = np.argwhere(~p)
    out = np.zeros(p.shape)
    for y, x in np.argwhere(p):
        out[y, x] = ((off - (y, x)) ** 2).sum(1).min()
    return out[1:-1, 1:-1]


def test_points(spark):
    masks, found = shapes(5, 10), shapes(5, 11)
    found[2] = masks[2]
    t, u = frame(spark, masks), frame(spark, found)
    for r in contours.centres(t).collect():
        far = plain_distances(masks[r.mask_id])
        assert r.y * W + r.x == far.argmax() and r.distance == pytest.approx(far.max() ** 0.5)
    many = contours.centres(t, 4).collect()
    for i, m in enumerate(masks):
        left = m.copy()
        for r in sorted((r for r in many if r.mask_id == i), key=lambda r: r.place):
            assert r.y * W + r.x == plain_distances(left).argmax()
            left[r.y, r.x] = False
    got = {r.mask_id: (r.x, r.y, r.label) for r in contours.error_centres(t, u).collect()}
    assert 2 not in got
    for i, (x, y, label) in got.items():
        fn, fp = plain_distances(masks[i] & ~found[i]), plain_distances(found[i] & ~masks[i])
        best = fn if fn.max() > fp.max() else fp
        assert (y * W + x, label) == (best.argmax(), int(fn.max() > fp.max()))
    points = contours.error_points(t, u, 300, 7).collect()
    assert {r.mask_id for r in points} == {0, 1, 3, 4} and len(points) == 1200
    assert all((masks[r.mask_id] ^ found[r.mask_id])[r.y, r.x] and r.label == masks[r.mask_id][r.y, r.x] for r in points)
    assert sorted(map(str, points)) == sorted(map(str, contours.error_points(t.repartition(2), u, 300, 7).collect()))
    even = contours.random_points(frame(spark, [np.ones((2, 3), bool)]), 6000, 3).groupBy("x", "y").count().collect()
    assert len(even) == 6 and all(850 < r["count"] < 1150 for r in even)


def test_crops(spark):
    rng = random.Random(4)
    pic = np.array([[[rng.randrange(256) for _ in range(3)] for _ in range(40)] for _ in range(30)], np.uint8)
    rows = [(i, (30, 40, 3, pic.tobytes())) for i in range(4)]
    images = spark.createDataFrame(rows, "mask_id int, image struct<height: int, width: int, nChannels: int, data: binary>")
    masks = [np.zeros((30, 40), bool) for _ in range(3)]
    masks[0][10:14, 10:14] = True
    masks[1][5:6, :] = True
    masks[2][3:9, 20:24], masks[2][20, 5] = True, True
    got = {r.mask_id: r for r in contours.crop_apply(images, frame(spark, masks), [("1:1", 1.0), ("9:16", 9 / 16)]).collect()}
    part = lambda r: np.frombuffer(r.crop.data, np.uint8).reshape(r.crop.height, r.crop.width, 3)
    assert got[0].ratio == "1:1" and (part(got[0]) == pic[10:14, 10:14]).all()
    assert got[1].ratio == "native" and (part(got[1]) == pic[5:6]).all()
    assert got[2].ratio == "1:1" and part(got[2]).shape == (19, 19, 3) and got[2].error is None
    assert got[3].crop.data is None and got[3].ratio is None and "no subject" in got[3].error


def test_large_frames(spark):
    masks = shapes(3, 12, 1280, 720)
    masks[1] = pixels.fill_holes(masks[1], 200)
    t = frame(spark, masks)
    assert sorted(r.area for r in runs.measured(t).collect()) == sorted(int(m.sum()) for m in masks)
    wide = back(runs.dilated(t, runs.square(3), 1280, 720), 3, 1280, 720)
    for m, g in zip(masks, wide):
        p = np.pad(m, 3)
        assert (np.lib.stride_tricks.sliding_window_view(p, (7, 7)).any((2, 3)) == g).all()


def test_a_task_holds_a_batch_of_masks(spark):
    """Closing, filling and boundaries are one exchange and no window, whose rows a task would hold; batches may end inside a mask."""
    masks = shapes(7, 11)
    t = frame(spark, masks)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "7")
    try:
        for got, want in (
            (runs.closed(t, runs.ellipse(5), W, H), [shrunk(grown(m, runs.ellipse(5)), runs.ellipse(5)) for m in masks]),
            (runs.filled(t, 12, W, H), [pixels.fill_holes(m, 12) for m in masks]),
            (runs.boundary(t, W, H), [plain_boundary(m) for m in masks]),
        ):
            plan = got._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("Window") == 0 and plan.count("RepartitionByExpression") == 1
            alike(got, want)
    finally:
        spark.conf.set(batch, before)


def test_pairs_of_boundaries_are_rows_not_runs(spark, monkeypatch):
    kept, keep = [], runs.keep

    def counted(t):
        kept.append(t.count())
        return keep(t)

    monkeypatch.setattr(runs, "keep", counted)
    t = frame(spark, shapes(6, 4))
    pairs = spark.createDataFrame([(i, j, "a") for i in range(6) for j in range(6)], "gt_id int, dt_id int, name string")
    got = runs.boundary_scores(pairs, t, t, 2, W, H)
    assert got.columns == ["gt_id", "dt_id", "name", "f"] and all(r.f == 1 for r in got.collect() if r.gt_id == r.dt_id)
    assert kept == [6]


def test_masks_of_a_group_together(spark):
    masks = shapes(9, 12)
    group = spark.createDataFrame([(i, None if i % 3 == 2 else i % 3) for i in range(9)], "mask_id int, category_id int")
    got = runs.semantic(frame(spark, masks), group).collect()
    for c in (0, 1, None):
        want = np.any([m for i, m in enumerate(masks) if (None if i % 3 == 2 else i % 3) == c], 0)
        assert sorted((r.x, r.lo, r.hi) for r in got if r.category_id == c) == column_runs(want)


def test_text_in_parts_of_a_batch(spark, monkeypatch):
    """A batch of long masks is worked on in parts of bounded size; nulls stay null, a mask larger than a part is one."""
    rows = [(i, None if i % 5 == 4 else [int(v) for v in np.random.default_rng(i).integers(0, 3000, 1 + i * 7)]) for i in range(40)]
    t = spark.createDataFrame(rows, "i int, counts array<int>").coalesce(1)
    for part in (1, 40, 10**6):
        monkeypatch.setattr(mask_text, "PART", part)
        cuts = mask_text._cuts(np.arange(40), np.array([1 + i * 7 for i in range(40)]))
        assert all(len(c) == 1 or sum(1 + i * 7 for i in c) <= part for c in cuts) and np.concatenate(cuts).tolist() == list(range(40))
    texts = t.select("i", "counts", mask_text.to_text(F.col("counts")).alias("text"))
    assert all(list(r.again) == r.counts if r.counts else r.again is None and r.text is None for r in texts.withColumn("again", mask_text.from_text(F.col("text"))).collect())
