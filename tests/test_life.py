"""Plugins' life, annotation lists, sessions, rates, whole files, and links that stay few."""

import math
import random

import numpy as np
import pytest

from framelake.functions import rotated
from framelake.operators import graph, joins, plugins
from framelake.sinks import writers
from framelake.sources import readers


def operators():
    """Local classes, which tasks get by value."""

    class Area(plugins.FrameOperator):
        name, columns, filters = "area", ("w", "h"), ({"key": "area", "min": 1},)

        def initialise(self, config):
            self.scale, self.seen = config["scale"], 0

        def execute(self, frame, found):
            self.seen += 1
            return plugins.Result({"area": frame["w"] * frame["h"] * self.scale, "first": float(self.seen == 1)})

    class Flaky(plugins.FrameOperator):
        name, columns = "flaky", ("w",)

        def initialise(self, config):
            self.tries = {}

        def execute(self, frame, found):
            self.tries[frame["w"]] = self.tries.get(frame["w"], 0) + 1
            if frame["w"] >= 3 or self.tries[frame["w"]] <= frame["w"]:
                raise ValueError("busy")
            return plugins.Result({"tries": self.tries[frame["w"]]})

    class Total(plugins.FrameOperator):
        name, last, needs_mask = "total", True, True

        def execute(self, frame, found):
            return plugins.Result({"total": sum(found.values())}) if found else plugins.Result({}, "nothing found")

    class Broken(plugins.FrameOperator):
        name = "broken"

        def initialise(self, config):
            raise RuntimeError("no model")

    return Area, Flaky, Total, Broken


def test_plugins_live_and_fail(spark, monkeypatch):
    monkeypatch.setattr(plugins, "OPERATORS", {})
    Area, *_ = kinds = operators()
    for k in kinds:
        plugins.add(k())
    with pytest.warns(UserWarning, match="again"):
        plugins.add(Area())
    assert plugins.filter_definitions() == [{"key": "area", "min": 1}]
    frames = spark.createDataFrame([(i, i, 2, b"m" if i % 2 else None) for i in range(5)], "id int, w int, h int, mask binary").coalesce(1)
    got = {r.id: r for r in plugins.execute(frames, ["total", "area", "flaky", "broken", "other"], "id", {"scale": 10}, wait=0.0).collect()}
    assert [got[i].metrics["area"] for i in range(5)] == [0, 20, 40, 60, 80]
    assert sum(r.metrics["first"] for r in got.values()) == 1
    assert [got[i].metrics.get("tries") for i in range(5)] == [1, 2, 3, None, None]
    assert got[3].errors["flaky"] == "failed after 2 retries: busy" and "flaky" not in got[2].errors
    assert got[0].errors["total"] == "no mask" and got[1].metrics["total"] == sum(got[1].metrics[k] for k in ("area", "first", "tries"))
    assert all(r.errors["broken"] == "failed to initialise: no model" and r.errors["other"] == "unknown operator: other" for r in got.values())


def test_plugins_are_found(tmp_path, monkeypatch):
    monkeypatch.setattr(plugins, "OPERATORS", {})
    (tmp_path / "found_here").mkdir()
    (tmp_path / "found_here/__init__.py").write_text("")
    (tmp_path / "found_here/good.py").write_text("from framelake.operators import plugins\nclass One(plugins.FrameOperator):\n    name = 'one'\nplugins.add(One())\n")
    (tmp_path / "found_here/bad.py").write_text("raise OSError('no')\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.warns(UserWarning, match="left out"):
        assert plugins.discover("found_here") == ["one"]


def test_annotation_lists(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"info": {"v": 1}, "images": [{"id": 1, "size": {"w": 5}}, {"id": "x"}], "tags": ["p", "q"]}')
    (tmp_path / "b.json").write_text('{"images": [{"id": 7, "more": [1, 2]}], "videos": []}')
    at = f"file://{tmp_path}"
    got = sorted((r.path.rsplit("/", 1)[1], r.name, r.n) for r in readers.annotation_lists(spark, at).collect())
    assert got == [("a.json", "images", 2), ("a.json", "tags", 2), ("b.json", "images", 1), ("b.json", "videos", 0)]
    rows = readers.annotation_rows(spark, at, "images", {"id": "bigint", "size.w": "int", "more": "array<int>"}).collect()
    assert sorted((r.path[-6:], str(r.id), str(r.size_w), str(r.more)) for r in rows) == [("a.json", "1", "5", "None"), ("a.json", "None", "None", "None"), ("b.json", "7", "None", "[1, 2]")]
    assert sorted(r.value for r in readers.annotation_rows(spark, at, "tags", {"value": "string"}).collect()) == ["p", "q"]
    assert readers.annotation_rows(spark, at, "videos", {"id": "int"}).count() == 0


def test_session_config_and_whole_files(spark, tmp_path):
    at = f"file://{tmp_path}"
    assert "is not in" in readers.session_config(spark, at).first().error
    for text, config in (('{"fps": 25, "name": "é"}', {"fps": "25", "name": "é"}), ("{broken", None)):
        writers.write_text(spark, f"{at}/run_config.json", text)
        assert (tmp_path / "run_config.json").read_text() == text
        r = readers.session_config(spark, at).first()
        assert r.config == config and (r.error is None) == (config is not None)
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["run_config.json"]


def test_frames_at_a_rate(spark):
    frames = [("a", i, i / 10) for i in range(20)] + [("b", 0, 0.0), ("b", 1, 2.0)]
    t = spark.createDataFrame(frames, "video string, n int, t double")
    got = sorted((r.video, r.slot, r.n) for r in readers.at_rate(t, 4.0, "video").collect())
    want = {}
    for v, n, at in frames:
        want[v, math.floor(at * 4 + 0.5)] = n
    assert got == [(v, s, max((k, n) for (u, k), n in want.items() if u == v and k <= s)[1]) for v, last in (("a", 8), ("b", 8)) for s in range(last + 1)]
    assert readers.at_rate(t.filter("video = 'b'"), 1.0).count() == 3


def test_first_conditioning_frame_is_kept(spark):
    rows = [(0, f, f in (3, 10, 11, 12, 30)) for f in range(32)] + [(1, f, f in (20, 25)) for f in range(22, 30)]
    t = spark.createDataFrame(rows, "video_id int, frame int, conditioning boolean")
    got = {}
    for r in joins.nearest_conditioning(t, 3, keep_first=True).collect():
        got.setdefault((r.video_id, r.frame), []).append((r["rank"], r.cond))
    for v, f, c in rows:
        if c:
            continue
        cond = sorted(x for u, x, k in rows if u == v and k)
        order = []
        before, after = [x for x in cond if x < f], [x for x in cond if x > f]
        if before or after:
            order.append(min(before) if before else max(after))
        order += [x for x in ([max(before)] if before else []) + ([min(after)] if after else []) if x not in order]
        order += [x for x in sorted(cond, key=lambda x: (abs(x - f), x)) if x not in order]
        assert [x for _, x in sorted(got.get((v, f), []))] == order[:3], (v, f)


def test_few_links_connect_alike():
    rng = np.random.default_rng(5)
    for n, m in ((1, 0), (5, 3), (40, 60), (200, 4000)):
        i, j = rng.integers(0, n, m), rng.integers(0, n, m)
        i, j = i[i != j], j[i != j]
        kept = graph._forest(i, j, n)

        def parts(a, b, n=n):
            label = list(range(n))
            for x, y in list(zip(a, b)) * n:
                label[x] = label[y] = min(label[x], label[y])
            return label

        if m <= 60:
            assert parts(i, j) == parts(i[kept], j[kept])
        assert kept.sum() <= n - 1


def test_equal_faces_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 4)
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.02) for x in centres[i % 5]]) for i in range(30)] + [(100 + i, [9.0, 0.0, 0.0, 0.0, 0.0, -9.0]) for i in range(7)] + [(200, [0.0] * 6), (201, [0.0] * 6), (202, [-5.0, 1.0, 9.0, 0.0, 2.0, 0.0])]
    got = {r.face_id: r.cluster for r in graph.face_clusters(spark.createDataFrame(rows, "face_id int, embedding array<double>"), 0.95).collect()}
    groups = {}
    for i, c in got.items():
        groups.setdefault(c, set()).add(i)
    assert groups.pop(-1) == {200, 201, 202}
    assert sorted(map(min, groups.values())) == [0, 1, 2, 3, 4, 100] and all(len(g) in (6, 7) for g in groups.values())


def test_a_block_is_moved_once_a_stripe(spark, monkeypatch):
    """Not once a block; and of two stripes no more links are left than they have faces."""
    monkeypatch.setattr(graph, "BLOCK", 4)
    rng = random.Random(7)
    rows = [(i, [1.0 + rng.random() / 9, rng.random() / 9]) for i in range(80)]
    every = graph.similar(spark.createDataFrame(rows, "id int, v array<double>"), 0.9, "id", "v").select("a", "b").collect()
    assert sorted(map(tuple, every)) == [(a, b) for a in range(80) for b in range(a + 1, 80)]
    forest = graph.similar(spark.createDataFrame(rows, "id int, v array<double>"), 0.9, "id", "v", forest=True)
    stripes = math.ceil(2 * spark.sparkContext.defaultParallelism**0.5)
    assert 79 <= forest.count() <= stripes**2 * 80 / stripes


def test_turned_boxes_scale_and_stay_inside(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = [tuple(rng.uniform(*r) for r in ((0, 100), (0, 80), (1, 40), (1, 40), (-180, 180))) for _ in range(50)]
    t = spark.createDataFrame(rows, "cx double, cy double, w double, h double, angle double")
    c = [F.col(x) for x in rotated.FIELDS]
    out = t.select("*", F.struct(*[v.alias(n) for n, v in zip(rotated.FIELDS, rotated.scaled(*c, 2.0, 2.0))]).alias("s"), rotated.inside(*c, 100.0, 80.0).alias("inside")).collect()
    for r in out:
        box = np.array([[r[f] for f in rotated.FIELDS]])
        p = rotated.corners(box)[0]
        assert r.inside == bool((p[:, 0] >= 0).all() and (p[:, 1] >= 0).all() and (p[:, 0] < 100).all() and (p[:, 1] < 80).all())
        assert np.allclose(rotated.corners(np.array([[r.s[f] for f in rotated.FIELDS]]))[0], 2 * p)
    wide = t.filter("abs(angle) < 90").select(F.struct(*[v.alias(n) for n, v in zip(rotated.FIELDS, rotated.scaled(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), F.lit(90.0), 3.0, 1.0))]).alias("s"), "w", "h").collect()
    assert all(r.s.w == pytest.approx(r.w) and r.s.h == pytest.approx(3 * r.h) for r in wide)


def test_queue_log_and_snapshots(spark):
    """An item that is retried and completes, one that fails for good and is added again, one that waits; events after an end are ignored."""
    from framelake.streaming import state

    rows = [
        ("a", 0.0, "added", None, None), ("a", 1.0, "started", None, None), ("a", 2.0, "progress", 0.5, "half"), ("a", 3.0, "failed", None, "boom"),
        ("a", 4.0, "started", None, None), ("a", 9.0, "completed", 1.0, "Completed"), ("a", 9.5, "failed", None, None),
        ("b", 0.0, "added", None, None), ("b", 2.0, "failed", None, "x"), ("b", 3.0, "failed", None, "y"), ("b", 5.0, "failed", None, "z"), ("b", 5.5, "progress", 0.9, None), ("b", 7.0, "added", None, None),
        ("c", 6.0, "added", None, None),
    ]
    log = state.queue_log(spark.createDataFrame(rows, "item string, at double, event string, fraction double, message string"), delay=1.0)
    got = {(r.item, r["at"]): (r.status, r.failures, r.retry_at, r.progress, r.text, r.running) for r in log.collect()}
    assert got == {
        ("a", 0.0): ("pending", 0, None, 0.0, "Waiting...", 0), ("b", 0.0): ("pending", 0, None, 0.0, "Waiting...", 0), ("a", 1.0): ("processing", 0, None, 0.0, "Starting...", 1),
        ("a", 2.0): ("processing", 0, None, 0.5, "half", 2), ("b", 2.0): ("processing", 1, 3.0, 0.0, "Retrying... (1/3)", 2), ("a", 3.0): ("processing", 1, 4.0, 0.5, "Retrying... (1/3)", 2),
        ("b", 3.0): ("processing", 2, 4.0, 0.0, "Retrying... (2/3)", 2), ("a", 4.0): ("processing", 1, None, 0.5, "Starting...", 2), ("b", 5.0): ("failed", 3, None, 0.0, "z", 1),
        ("c", 6.0): ("pending", 0, None, 0.0, "Waiting...", 1), ("b", 7.0): ("pending", 0, None, 0.0, "Waiting...", 1), ("a", 9.0): ("completed", 1, None, 1.0, "Completed", 0),
    }
    times = spark.createDataFrame([(t,) for t in (-1.0, 2.5, 5.0, 8.0, 100.0)], "snapshot double")
    for width in (60.0, 2.0):
        shown = {(r.snapshot, r.item): r.status for r in state.queue_snapshots(log, times, width).collect()}
        assert shown == {(2.5, "a"): "processing", (2.5, "b"): "processing", (5.0, "a"): "processing", (5.0, "b"): "failed", (8.0, "a"): "processing", (8.0, "b"): "pending", (8.0, "c"): "pending", (100.0, "a"): "completed", (100.0, "b"): "pending", (100.0, "c"): "pending"}
    assert state.queue_snapshots(log, times.limit(0)).collect() == []
