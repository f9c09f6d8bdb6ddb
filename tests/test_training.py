"""Matching, turned boxes, tracks for scoring, progress and settings against plain loops."""

import itertools
import math
import random
from queue import Queue

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import rotated as R
from framelake.operators import checked, filters, training
from framelake.sinks import writers
from framelake.streaming.progress import Tracker


def test_targets_like_trying_all(spark):
    rnd = random.Random(1)
    box = lambda: [rnd.random(), rnd.random(), rnd.random() / 2 + 0.05, rnd.random() / 2 + 0.05]
    predictions = [(i, q, *box(), [rnd.random() for _ in range(3)]) for i in range(12) for q in range(rnd.randrange(1, 5))]
    targets = [(i, t, rnd.randrange(3), *box()) for i in range(12) for t in range(rnd.randrange(1, 4))]
    names = "cx double, cy double, bw double, bh double"
    p = spark.createDataFrame(predictions, f"image_id int, query int, {names}, probs array<double>")
    t = spark.createDataFrame(targets, f"image_id int, target int, label int, {names}")

    def giou(a, b):
        a, b = ((x - w / 2, y - h / 2, x + w / 2, y + h / 2) for x, y, w, h in (a, b))
        size = lambda r: max(0, r[2] - r[0]) * max(0, r[3] - r[1])
        i = size((max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])))
        union, hull = size(a) + size(b) - i, size((min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])))
        return i / union - (hull - union) / hull

    for focal in (False, True):
        got = {}
        for r in training.matched_targets(p, t, focal=focal).collect():
            got.setdefault(r.image_id, set()).add((r.query, r.target))
        for i in range(12):
            ps, ts = [x for x in predictions if x[0] == i], [x for x in targets if x[0] == i]

            def cost(a, b):
                q = a[6][b[2]]
                c = 0.25 * (1 - q) ** 2 * -math.log(q + 1e-8) - 0.75 * q**2 * -math.log(1 - q + 1e-8) if focal else -q
                return c + sum(abs(x - y) for x, y in zip(a[2:6], b[3:7], strict=True)) - giou(a[2:6], b[3:7])

            few, many = (ps, ts) if len(ps) <= len(ts) else (ts, ps)
            best = min(sum(cost(f, m) if few is ps else cost(m, f) for f, m in zip(few, c, strict=True)) for c in itertools.permutations(many, len(few)))
            assert len(got[i]) == len(few) and sum(cost(ps[q], ts[g]) for q, g in got[i]) == pytest.approx(best)
    assert training.matched_targets(p, t, repeats=2).groupBy("image_id", "target").count().agg(F.max("count")).first()[0] == 2


def test_turned_boxes():
    rnd = random.Random(2)
    shared = lambda a, b: float(R.intersections(np.array([a], float), np.array([b], float))[0])
    assert shared((0, 0, 2, 2, 0), (0, 0, 2, 2, 45)) == pytest.approx(8 * (math.sqrt(2) - 1))
    assert shared((0, 0, 2, 2, 0), (9, 0, 2, 2, 30)) == 0 and shared((0, 0, 2, 2, 0), (0, 0, 2, 2, 0)) == pytest.approx(4)
    assert shared((0, 0, 2, 2, 0), (1, 0, 2, 2, 0)) == pytest.approx(2) and shared((0, 0, 2, 2, 30), (0, 0, 1, 1, 77)) == pytest.approx(1) and shared((0, 0, 0, 5, 0), (0, 0, 2, 2, 10)) == 0
    for _ in range(40):
        a, b = ((rnd.uniform(0, 4), rnd.uniform(0, 4), rnd.uniform(1, 4), rnd.uniform(1, 4), rnd.uniform(-180, 180)) for _ in range(2))

        def holds(box, x, y):
            c, s = math.cos(math.radians(box[4])), math.sin(math.radians(box[4]))
            dx, dy = x - box[0], y - box[1]
            return abs(c * dx - s * dy) <= box[2] / 2 and abs(s * dx + c * dy) <= box[3] / 2

        n = 240
        cells = sum(holds(a, 12 * (i + 0.5) / n - 4, 12 * (j + 0.5) / n - 4) and holds(b, 12 * (i + 0.5) / n - 4, 12 * (j + 0.5) / n - 4) for i in range(n) for j in range(n))
        assert shared(a, b) == pytest.approx(cells * (12 / n) ** 2, abs=0.12) and shared(a, b) == pytest.approx(shared(b, a), abs=1e-9)


def test_tracks_made_ready(spark):
    box = "x1 double, y1 double, x2 double, y2 double"
    gt = spark.createDataFrame([(0, 0, 1, 7, 0.0, 0.0, 10.0, 10.0), (0, 0, 2, 8, 50.0, 0.0, 60.0, 10.0)], f"video_id int, t int, category_id int, gt_id int, {box}")
    rows = [(0, 0, 1, 5, 0.0, 0.0, 10.0, 9.0), (0, 0, 1, 6, 30.0, 0.0, 40.0, 9.0), (0, 1, 1, 5, 0.0, 0.0, 10.0, 9.0), (0, 0, 2, 3, 50.0, 0.0, 60.0, 9.0), (0, 0, 2, 4, 70.0, 0.0, 80.0, 9.0), (0, 0, 3, 9, 0.0, 0.0, 1.0, 1.0), (0, 0, 4, 2, 0.0, 0.0, 1.0, 1.0)]
    dt = spark.createDataFrame(rows, f"video_id int, t int, category_id int, trk_id int, {box}")
    one = lambda c: spark.createDataFrame([(0, c)], "video_id int, category_id int")
    got = {(r.t, r.category_id, r.trk_id, r.new_id) for r in training.scored_tracks(gt, dt, one(3), one(2)).collect()}
    # Class 1: both in frame 0, the one in frame 1 has no truth; class 2 is open, so the unmatched goes; 3 is known absent.
    assert got == {(0, 1, 5, 0), (0, 1, 6, 1), (0, 2, 3, 0), (0, 3, 9, 0)}


def test_progress_events():
    now, q = [0.0], Queue()
    t = Tracker(q, lambda: now[0])
    t.start(4, "analysis")
    for seconds in (1.0, 0.01, 2.0, 1.0):
        now[0] += seconds
        t.step()
    events = [q.get()["progress"] for _ in range(q.qsize())]
    assert [e["done"] for e in events] == [0, 1, 3, 4] and events[0]["eta_formatted"] == "—"
    assert events[1]["eta_seconds"] == pytest.approx(3.0) and events[-1]["fraction"] == 1 and events[-1]["eta_seconds"] == 0
    assert events[2]["eta_seconds"] == pytest.approx(0.2 * 2 + 0.8 * (0.2 * 0.01 + 0.8 * 1))


def test_settings_and_tables(spark, tmp_path):
    assert filters.reset(["yaw_min", "yaw_max", "x_min"], {"yaw": {"default_min": -25, "default_max": 25}}) == {"x_min": 0, "yaw_max": 25, "yaw_min": -25, "dedup_thresh": 5, "require_face_match": False, "dedup_method": "Fast (pHash)", "smart_filter_enabled": False}
    assert filters.with_defaults({"nth": None, "method": "✨ all", "k": 3}, {"default_nth": 5, "filter_default_yaw": 2, "default_k": 9, "other": 1}) == {"nth": 5, "method": "all", "k": 3, "yaw": 2}
    rows = spark.createDataFrame([("a", 0.5, [1, 2]), ("b", 0.25, None)], "level string, hota double, parts array<int>")
    assert writers.cleared(rows).collect() == [] and writers.cleared(rows).columns == rows.columns
    assert sorted(r.json for r in writers.json_rows(rows).collect()) == ['{"level":"a","hota":0.5,"parts":[1,2]}', '{"level":"b","hota":0.25}']
    writers.score_tables(rows.select("level", "hota"), f"file://{tmp_path}/s")
    assert [r.value.split() for r in spark.read.text(f"file://{tmp_path}/s/summary").collect()] == [["a", "hota:", "0.500"], ["b", "hota:", "0.250"]]
    found = {r.name: r.ok for r in checked.diagnosis(spark, ("numpy", "no-such-package"), (f"file://{tmp_path}", f"file://{tmp_path}/none")).collect()}
    assert found["numpy"] and not found["no-such-package"] and found[f"file://{tmp_path}"] and not found[f"file://{tmp_path}/none"]
