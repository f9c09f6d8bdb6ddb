import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelake.functions import pixels as P
from framelake.functions import text
from framelake.functions.assign import assign, iou_matrix
from framelake.operators import datasets, dedup, evaluation, filters, graph, joins, matching, seeds
from framelake.sinks import writers
from framelake.sources import readers
from framelake.streaming import state


def _frames(spark, rows):
    metrics = "quality_score,sharpness_score,edge_strength_score,contrast_score,brightness_score,entropy_score,niqe_score,eyes_open,blink_prob,yaw,pitch,roll".split(",")
    schema = "filename string, face_sim double, mask_area_pct double, phash string, metrics struct<" + ",".join(f"{m}: double" for m in metrics) + ">"
    return spark.createDataFrame([(r["filename"], r.get("face_sim"), r.get("mask_area_pct"), r.get("phash"), tuple(r.get(m) for m in metrics)) for r in rows], schema)


def _verdicts(df):
    return {r.filename: (r.kept, list(r.reasons)) for r in df.collect()}


def test_filter_reasons(spark):
    t = _frames(spark, [{"filename": "a", "quality_score": 80.0, "yaw": 0.0}, {"filename": "b", "quality_score": 90.0, "yaw": 30.0}, {"filename": "c", "quality_score": float("nan"), "yaw": -3.0}])
    got = _verdicts(filters.apply_filters(t, {"quality_score_min": 85.0}))
    assert got == {"a": (False, ["quality_score_low"]), "b": (False, ["yaw_out_of_range"]), "c": (False, [])}


def test_face_match(spark):
    t = _frames(spark, [{"filename": "a", "face_sim": 0.8}, {"filename": "b", "face_sim": 0.4}, {"filename": "c"}])
    args = {"face_sim_min": 0.5, "face_sim_enabled": True}
    assert _verdicts(filters.apply_filters(t, args)) == {"a": (True, []), "b": (False, ["face_sim_low"]), "c": (True, [])}
    assert _verdicts(filters.apply_filters(t, args | {"require_face_match": True}))["c"] == (False, ["face_missing"])
    assert _verdicts(filters.apply_filters(t, {"face_sim_min": 0.5}))["b"] == (True, [])


def test_float32_thresholds(spark):
    t = _frames(spark, [{"filename": "a", "face_sim": 0.7}])
    assert _verdicts(filters.apply_filters(t, {"face_sim_min": 0.7, "face_sim_enabled": True}))["a"][0]


def test_percentiles(spark):
    t = _frames(spark, [{"filename": str(i), "quality_score": 10.0 * i} for i in range(1, 6)])
    assert {r.metric: r.threshold for r in filters.auto_thresholds(t, 50, ("quality_score",)).collect()} == {"quality_score": 30.0}


HASHES = {"f1": "0" * 16, "f2": "0" * 16, "f3": "f" * 16, "f4": "f" * 15 + "e"}


@pytest.mark.parametrize(("threshold", "quality", "kept"), [(5, (10, 20, 10, 5), "FTTF"), (5, (10, 5, 10, 5), "TFTF"), (0, (10, 20, 10, 5), "FTTT")])
def test_near_duplicates(spark, threshold, quality, kept):
    t = spark.createDataFrame([(n, h, float(q)) for (n, h), q in zip(HASHES.items(), quality, strict=True)], "filename string, phash string, quality double")
    got = {r.filename: r.kept for r in dedup.near(t, threshold).collect()}
    assert "".join("T" if got[n] else "F" for n in HASHES) == kept


def test_near_duplicates_like_one_sequence(spark):
    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(8)]
    rows = [(f"f{i:04d}", f"{rnd.choice(base) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)):016x}", float(rnd.randrange(5))) for i in range(300)]
    slots, want = [], [True] * len(rows)
    for i, (_, h, q) in enumerate(rows):
        hit = next((s for s, j in enumerate(slots) if (int(rows[j][1], 16) ^ int(h, 16)).bit_count() <= 3), None)
        if hit is None:
            slots.append(i)
        elif q > rows[slots[hit]][2]:
            want[slots[hit]], slots[hit] = False, i
        else:
            want[i] = False
    got = {r.filename: r.kept for r in dedup.near(spark.createDataFrame(rows, "filename string, phash string, quality double"), 3).collect()}
    assert [got[r[0]] for r in rows] == want


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.component for r in graph.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in got} and len(got) == len({x for e in edges if e[0] != e[1] for x in e})


def test_strategies(spark):
    t = spark.createDataFrame([(0, 0, 10.0, 10.0, 50.0, 50.0, 0.8, "subject"), (0, 1, 100.0, 100.0, 120.0, 120.0, 0.95, "subject"), (0, 2, 400.0, 400.0, 450.0, 480.0, 0.7, "subject")], "image_id int, idx int, x1 double, y1 double, x2 double, y2 double, conf double, type string")
    want = {"Largest Subject": 2, "Tallest Subject": 2, "Highest Confidence": 1, "Area x Confidence": 2, "Center-most Subject": 1, "Rule-of-Thirds": 1, "Edge-avoiding": 1, "Balanced": 1}
    assert {s: seeds.best_subject(t, s, 500.0, 500.0).first().idx for s in want} == want


def test_crops_hold_their_subject(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(200):
        w, h = rnd.randrange(50, 2000), rnd.randrange(50, 2000)
        x, y = rnd.randrange(w - 10), rnd.randrange(h - 10)
        rows.append((i, w, h, x, y, rnd.randrange(1, w - x), rnd.randrange(1, h - y)))
    t = spark.createDataFrame(rows, "id int, frame_w int, frame_h int, x int, y int, w int, h int")
    for r in seeds.crop_plan(t, seeds.aspect_ratios("21:9, 1:1, 9:21, junk, 0:1"), 1.3).collect():
        assert r.crop_x <= r.x and r.crop_y <= r.y and r.crop_x + r.crop_w >= r.x + r.w - 1 and r.crop_y + r.crop_h >= r.y + r.h - 1
        assert 0 <= r.crop_x and r.crop_x + r.crop_w <= r.frame_w and r.crop_y + r.crop_h <= r.frame_h


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_assignment_is_best(n, m, seed):
    s = np.random.default_rng(seed).integers(0, 5, (n, m)).astype(float)
    r, c = assign(s)
    t = s if n <= m else s.T
    assert s[r, c].sum() == max(sum(t[i, p[i]] for i in range(len(t))) for p in itertools.permutations(range(t.shape[1]), len(t)))


def test_suppression_like_a_loop(spark):
    rnd = random.Random(3)
    rows = [(i // 8, i % 8, float(x := rnd.randrange(40)), float(y := rnd.randrange(40)), float(x + rnd.randrange(30)), float(y + rnd.randrange(1, 30)), rnd.randrange(10) / 10) for i in range(400)]
    t = spark.createDataFrame(rows, "image_id int, idx int, x1 double, y1 double, x2 double, y2 double, conf double")
    want = set()
    for k in range(50):
        g = sorted([r for r in rows if r[0] == k and r[4] > r[2] and r[5] > r[3]], key=lambda r: (-r[6], r[1]))
        kept = []
        for r in g:
            if all(iou_matrix(np.array([r[2:6]]), np.array([q[2:6]]))[0, 0] < 0.3 for q in kept):
                kept.append(r)
        want |= {(r[0], r[1]) for r in kept}
    assert {(r.image_id, r.idx) for r in matching.suppress(t, 0.3, ["image_id"]).filter("kept").collect()} == want


def test_tracking_scores(spark):
    rows = [(0, t, i, 0, 50.0 * i, 0.0, 50.0 * i + 20, 20.0) for t in range(10) for i in range(3)]
    gt = spark.createDataFrame(rows, "video_id int, t int, gt_id int, category_id int, x1 double, y1 double, x2 double, y2 double")
    same = gt.withColumnRenamed("gt_id", "trk_id")
    swapped = same.withColumn("trk_id", F.when((F.col("t") >= 5) & (F.col("trk_id") < 2), 1 - F.col("trk_id")).otherwise(F.col("trk_id")))
    score = lambda d: evaluation.hota(evaluation.track_counts(gt, d, ["video_id"]), ["video_id"]).first()
    assert score(same).hota == pytest.approx(1) and score(same.limit(0)).hota == 0
    r = score(swapped)
    assert r.det_a == pytest.approx(1) and r.ass_a < 1
    assert evaluation.teta(evaluation.teta_counts(gt, same, ["video_id"]), ["video_id"]).first().teta == pytest.approx(1)


def test_images():
    flat, rnd = np.full((100, 100), 90, np.uint8), np.random.default_rng(0)
    checker = ((np.indices((100, 100)).sum(0) // 10) % 2 * 255).astype(np.uint8)
    assert P.sharpness(flat) == P.edge_strength(flat) == P.contrast(flat) == P.entropy(flat) == 0 and P.brightness(flat) == pytest.approx(90 / 255)
    assert P.sharpness(checker) > 0.2 and P.entropy(checker) == pytest.approx(1 / 8) and P.contrast(checker) == pytest.approx(0.5)
    noise = rnd.integers(0, 256, (64, 64)).astype(np.uint8)
    assert P.ssim(noise, noise) == pytest.approx(1) and P.ssim(noise, 255 - noise) < 0.1
    assert len(P.phash(noise)) == 16 and P.phash(noise) == P.phash(noise)
    on = rnd.random((13, 17)) < 0.5
    assert (P.from_rle(P.rle(on), 13, 17) == on).all()
    label, sizes = P.components(np.array([[1, 0, 1], [0, 1, 0], [0, 0, 0], [1, 1, 0]], bool))
    assert sorted(sizes[1:]) == [2, 3]
    assert P.polygon_area(np.array([[0, 0], [4, 0], [4, 3], [0, 3.0]])) == 12
    assert P.polygon_mask(np.array([[0, 0], [4, 0], [4, 3], [0, 3.0]]), 5, 6).sum() == 12
    assert P.mask_box(P.polygon_mask(np.array([[1, 1], [4, 1], [4, 3], [1, 3.0]]), 5, 6)) == (1, 1, 4, 3)
    big = np.zeros((40, 40), np.uint8)
    big[5:25, 5:25], big[35:37, 35:37] = 255, 255
    assert P.clean_mask(big).sum() == 255 * 400 and P.boundary_f(big > 0, big > 0) == 1.0
    assert P.fill_holes(np.pad(np.zeros((1, 1), bool), 3, constant_values=True), 2).all()


def test_measure_reports_errors(spark):
    t = spark.createDataFrame([((2, 2, 1, bytes([0, 255, 255, 0])),), ((9, 9, 3, b"xy"),), ((1, 1, 3, None),)], "image struct<height: int, width: int, nChannels: int, data: binary>")
    rows = P.measure(t).collect()
    assert rows[0].measured.brightness == pytest.approx(0.5) and rows[1].measured.error and rows[2].measured.error


def test_text(spark):
    t = spark.createDataFrame([("a b/c.jpg", "yes", "✨ Sharp", 3725.0), ("x" * 80, " TRUE ", "Plain", None)], "name string, flag string, label string, s double")
    r = t.select(text.sanitised(F.col("name")).alias("n"), text.truthy(F.col("flag")).alias("f"), text.without_emoji(F.col("label")).alias("l"), text.eta(F.col("s")).alias("e"), text.eta(F.col("s"), True).alias("fine"), joins.stem("name").alias("stem")).collect()
    assert tuple(r[0]) == ("a_b_c.jpg", True, "Sharp", "1h 2m", "1h 2m 5s", "c") and r[1].e == "—" and len(r[1].n) == 50


def test_writers(spark, tmp_path):
    photos = spark.createDataFrame([("a.jpg", 95.0, "kept"), ("b.CR2", 30.0, "review"), ("c.jpg", 10.0, "rejected")], "source string, quality_score double, status string")
    xml = {r.path: r.xml for r in writers.sidecars(photos).collect()}
    assert 'Rating="5"' in xml["a.xmp"] and 'Label="Yellow"' in xml["b.xmp"] and 'Rating="1"' in xml["b.xmp"] and 'Rating="0"' in xml["c.xmp"]
    old, new = (spark.createDataFrame([("dup.jpg", s, i)], "filename string, face_sim double, seq int") for i, s in enumerate((0.5, 0.8)))
    assert [(r.filename, r.face_sim) for r in writers.upsert(old, new, "filename", "seq").collect()] == [("dup.jpg", 0.8)]
    moved, applied = writers.migrate(spark.createDataFrame([(1,)], "id int"), 0)
    assert applied == [1, 2] and moved.columns == ["id", "error_severity"]
    a, b, c = (writers.fingerprint(spark, "v", 5, t, "h") for t in (1.0, 1.01, 2.55))
    assert writers.unchanged(a, b) and not writers.unchanged(a, c)
    writers.export(photos.withColumnRenamed("source", "filename"), f"file://{tmp_path}/csv", "csv")
    assert spark.read.csv(f"file://{tmp_path}/csv", header=True).columns == ["filename", "quality_score", "status"]


def test_readers(spark, tmp_path):
    (tmp_path / "scenes.json").write_text("[[0, 10], [10, 25]]")
    assert [tuple(r) for r in readers.scenes(spark, f"file://{tmp_path}/scenes.json").collect()] == [(0, 0, 10), (1, 10, 25)]
    (tmp_path / "pics").mkdir()
    for n in ("img1.jpg", "img2.CR2", "random.txt"):
        (tmp_path / "pics" / n).write_bytes(b"x")
    assert sorted(r.kind for r in readers.image_folder(spark, f"file://{tmp_path}/pics").collect()) == ["jpeg", "raw"]
    (tmp_path / "c.json").write_text('{"images": [{"id": 1, "file_name": "a"}], "annotations": [{"id": 7, "image_id": 1, "category_id": 2, "bbox": [1, 2, 3, 4]}], "categories": [{"id": 2, "name": "cat"}]}')
    c = readers.coco(spark, f"file://{tmp_path}/c.json")
    assert datasets.group_by_image(c["images"].withColumnRenamed("id", "image_id"), c["annotations"].withColumnRenamed("id", "ann_id")).first().annotations[0].ann_id == 7
    (tmp_path / "t.txt").write_text("1,4,0,0,5,5,0.9,1\n2,4,0,0,5,5,0.9,13\n")
    rows, ignored = readers.tracking_text(spark, f"file://{tmp_path}/t.txt", crowd=("category_id", [13]))
    assert rows.count() == 1 and ignored.count() == 1


@pytest.mark.parametrize("reverse, empties", [(False, False), (True, True)])
def test_probation_as_stream_and_table(spark, tmp_path, reverse, empties):
    """As a stream, as a table, and by one pass over each video, forwards and backwards; ids can share a frame and its detection twice."""
    rnd = random.Random(6)
    rows = [(v, f, o, rnd.choice(["matched", "matched", "unmatched", "empty", "new"]), rnd.randrange(3)) for v in range(3) for f in range(30) for o in range(7) if rnd.random() < 0.9]
    rows += [(0, f, o, "matched", 9) for f in range(30) for o in (5, 6)]
    rows = [(*r[:4], r[4] if r[3] == "matched" else None) for r in rows]
    schema = "video_id int, frame int, object_id int, status string, detection int"
    for k in (2, 1, 0) if reverse else (0, 1, 2):
        spark.createDataFrame([r for r in rows if r[1] // 10 == k], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    name = f"probation_{reverse}"
    q = state.probation_stream(stream, reverse, empties).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    want = []
    for v in range(3):
        p = state.Probation(reverse=reverse, empties=empties)
        for f in sorted(range(30), reverse=reverse):
            want += [(v, f, *e) for e in p.step(f, [(r[2], r[3], r[4]) for r in rows if r[:2] == (v, f)])]
    assert {e[3] for e in want} == {"removed", "suppressed"}
    assert sorted(map(tuple, spark.table(name).collect())) == sorted(want)
    assert sorted(map(tuple, state.probation_table(spark.createDataFrame(rows, schema), reverse, empties).collect())) == sorted(want)


def test_recent_occlusion_suppresses(spark):
    pairs = spark.createDataFrame([(0, 1, 2, 5, 3), (1, 1, 2, 5, -1), (2, 1, 2, 3, 5), (3, 1, 2, 4, 4), (4, 1, 2, -1, 7), (5, 1, 2, state.REMOVED, 0)], "frame int, a int, b int, a_last int, b_last int")
    assert sorted(map(tuple, state.suppress_recent(pairs).collect())) == [(0, 1), (2, 2), (5, 1)]
    assert sorted(map(tuple, state.suppress_recent(pairs, reverse=True).collect())) == [(0, 2), (1, 2), (2, 1), (4, 1), (5, 2)]


def test_windows_over_a_stream(spark, tmp_path):
    t = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    t.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(t.schema).parquet(f"{tmp_path}/in")
    q = state.windows(stream, "ts", "1 hour", ["event_type"], late="10 minutes").writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.table("hours").agg(F.sum("n")).first()[0] == t.count()
