"""Masks from prototypes and boxes, keypoints from heatmaps, transforms of runs: against loops over pixels."""

import math

import numpy as np
import pytest
from test_runs import H, W, alike, back, frame, shapes

from framelake.functions import resize
from framelake.operators import resampled, runs


def cubic_weight(d, a=-0.75):
    d = abs(d)
    return (a + 2) * d**3 - (a + 3) * d**2 + 1 if d <= 1 else a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a if d < 2 else 0


def plain_resize(img, h, w, taps, weight):
    n, m = img.shape
    out = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            v, u = (y + 0.5) * n / h - 0.5, (x + 0.5) * m / w - 0.5
            for j in range(math.floor(v) + 1 - taps // 2, math.floor(v) + 1 + taps // 2):
                for i in range(math.floor(u) + 1 - taps // 2, math.floor(u) + 1 + taps // 2):
                    out[y, x] += weight(v - j) * weight(u - i) * img[min(max(j, 0), n - 1), min(max(i, 0), m - 1)]
    return out


def test_resizes():
    img = np.random.default_rng(1).random((7, 5))
    for h, w in ((13, 11), (3, 4), (7, 5)):
        assert np.allclose(resize.resized(img, h, w), plain_resize(img, h, w, 2, lambda d: max(0, 1 - abs(d))))
        assert np.allclose(resize.resized(img, h, w, resize.cubic), plain_resize(img, h, w, 4, cubic_weight))
    assert np.allclose(resize.resized(img, 7, 5, resize.cubic), img)


def plain_region(img, box, size):
    x1, y1, x2, y2 = box
    ph, pw = (y2 - y1) / size, (x2 - x1) / size
    ny, nx = max(1, math.ceil(ph)), max(1, math.ceil(pw))
    out = np.zeros((size, size))
    for a in range(size):
        for b in range(size):
            for i in range(ny):
                for j in range(nx):
                    y, x = y1 - 0.5 + a * ph + (i + 0.5) * ph / ny, x1 - 0.5 + b * pw + (j + 0.5) * pw / nx
                    if not (-1 <= y <= img.shape[0] and -1 <= x <= img.shape[1]):
                        continue
                    y, x = min(max(y, 0), img.shape[0] - 1), min(max(x, 0), img.shape[1] - 1)
                    y0, x0 = int(y), int(x)
                    y9, x9 = min(y0 + 1, img.shape[0] - 1), min(x0 + 1, img.shape[1] - 1)
                    v, u = y - y0, x - x0
                    out[a, b] += ((1 - v) * (1 - u) * img[y0, x0] + (1 - v) * u * img[y0, x9] + v * (1 - u) * img[y9, x0] + v * u * img[y9, x9]) / (ny * nx)
    return out


def test_regions(spark):
    img = np.random.default_rng(2).random((9, 12))
    for box in ((0, 0, 12, 9), (2.3, 1.7, 8.1, 8.8), (-3, -2, 5, 20), (4.2, 4.2, 4.9, 4.9)):
        assert np.allclose(resize.region(img, box, 4), plain_region(img, box, 4))
    masks = shapes(5, 3)
    boxes = [(0, 0, W, H), (3.5, 2.5, 40.2, 30.9), (10, 10, 25, 45), (30, 5, 60.5, 46), (5.5, 5.5, 9.5, 9.5)]
    t = spark.createDataFrame([(i, *map(float, b)) for i, b in enumerate(boxes)], "mask_id int, x1 double, y1 double, x2 double, y2 double")
    for r in resampled.cut_masks(frame(spark, masks), t, 14).collect():
        want = plain_region(masks[r.mask_id].astype(float), boxes[r.mask_id], 14)
        got = np.array(r.mask).reshape(14, 14)
        inner = np.abs(want - 0.5) > 1e-9
        x1, y1, x2, y2 = boxes[r.mask_id]
        if x1 > 0 and y1 > 0 and x2 < W - 1 and y2 < H - 1:
            assert (got == (want >= 0.5))[inner].all()
        else:
            assert (got == (want >= 0.5))[2:-2, 2:-2][inner[2:-2, 2:-2]].all()


def test_prototype_masks(spark):
    rng = np.random.default_rng(3)
    planes = {i: rng.normal(size=(4, 10, 12)).astype(np.float32) for i in range(3)}
    dets = [(i, k, *rng.uniform(20, 60, 2).tolist(), *rng.uniform(10, 60, 2).tolist(), rng.normal(size=4).tolist(), 50, 33, 0.5, 3.0, 5.0) for i in range(4) for k in range(3)]
    d = spark.createDataFrame([tuple(x) for x in dets], "image_id int, idx int, cx double, cy double, bw double, bh double, coefficients array<double>, width int, height int, scale double, pad_left double, pad_top double")
    p = spark.createDataFrame([(i, 4, 10, 12, v.tobytes()) for i, v in planes.items()], "image_id int, planes int, rows int, columns int, values binary")
    got = {}
    for r in resampled.prototype_masks(d, p, 80).collect():
        got.setdefault((r.image_id, r.idx), np.zeros((33, 50), bool))[r.lo : r.hi, r.x] = True
    some = 0
    for i, k, cx, cy, bw, bh, c, *_ in dets:
        if i == 3:
            assert (i, k) not in got
            continue
        own = np.zeros((10, 12))
        for y in range(10):
            for x in range(12):
                if int(max(0, (cy - bh / 2) * 10 / 80)) <= y < int(min(10, (cy + bh / 2) * 10 / 80)) and int(max(0, (cx - bw / 2) * 12 / 80)) <= x < int(min(12, (cx + bw / 2) * 12 / 80)):
                    own[y, x] = 1 / (1 + math.exp(-sum(float(w) * float(q) for w, q in zip(c, planes[i][:, y, x]))))
        want = plain_resize(own, 33, 50, 2, lambda t: max(0, 1 - abs(t)))
        sure = np.abs(want - 0.5) > 1e-6
        mine = got.get((i, k), np.zeros((33, 50), bool))
        assert (mine == (want > 0.5))[sure].all()
        some += mine.sum()
    assert some
    for r in resampled.unboxed(d).collect():
        assert (r.x1, r.y2) == (int(min(max((r.cx - r.bw / 2 - 3) / 0.5, 0), 50)), int(min(max((r.cy + r.bh / 2 - 5) / 0.5, 0), 33)))


def test_keypoints_from_heatmaps(spark):
    rng = np.random.default_rng(4)
    rows = [(i, k, 6, rng.normal(size=36).tolist(), *b) for i, b in enumerate([(2.0, 3.0, 20.5, 17.2), (0.0, 0.0, 6.0, 6.0), (5.0, 5.0, 5.2, 9.0)]) for k in range(3)]
    t = spark.createDataFrame(rows, "roi int, point int, side int, values array<double>, x1 double, y1 double, x2 double, y2 double")
    got = {(r.roi, r.point): r for r in resampled.keypoints(t, ["roi", "point"]).collect()}
    assert len(got) == 9
    for i, k, _, v, x1, y1, x2, y2 in rows:
        cells = np.array(v).reshape(6, 6)
        w, h = max(x2 - x1, 1), max(y2 - y1, 1)
        fine = plain_resize(cells, math.ceil(h), math.ceil(w), 4, cubic_weight)
        y, x = np.unravel_index(fine.argmax(), fine.shape)
        r = got[i, k]
        assert (r.x, r.y, r.logit) == (pytest.approx(x1 + (x + 0.5) * w / math.ceil(w)), pytest.approx(y1 + (y + 0.5) * h / math.ceil(h)), pytest.approx(fine.max()))
        assert r.score == pytest.approx(1 / np.exp(cells - fine.max()).sum())


def test_transforms_of_runs(spark):
    masks = shapes(4, 5)
    t = frame(spark, masks)
    alike(runs.flipped(t, W, H), [m[:, ::-1] for m in masks])
    alike(runs.flipped(t, W, H, across=False), [m[::-1] for m in masks])
    alike(runs.cropped(t, 5, 7, 30, 20), [m[7:27, 5:35] for m in masks], 30, 20)
    alike(runs.cropped(t, -3, -2, W + 5, H + 4), [np.pad(m, ((2, 2), (3, 2))) for m in masks], W + 5, H + 4)
    groups = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 1)], "mask_id int, category_id int")
    both = back(runs.semantic(t, groups), 2, key="category_id")
    assert (both[0] == masks[1]).all() and (both[1] == masks[0] | masks[2] | masks[3]).all()
