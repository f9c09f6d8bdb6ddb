"""What larger tables showed: file names that repeat, and work that grew faster than the tables."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from framelake.functions import pixels as P
from framelake.functions import masks
from framelake.functions.assign import assign, assign_many, iou_matrix
from framelake.operators import evaluation as E
from framelake.operators import frames as FR
from framelake.operators import masks as O
from framelake.operators import matching as M
from framelake.operators import datasets, seeds, training
from framelake.plans import QUERIES, SQL, quality, tables
from framelake.plans.adapters import adapted
from oracle import DATA, TABLES, same


@pytest.fixture(scope="module")
def repeated_names(tmp_path_factory):
    """Events on both sides of a million: file names have six digits, so theirs repeat."""
    at = tmp_path_factory.mktemp("million")
    made = {
        "events": "SELECT * REPLACE (event_id + 100000 AS event_id) FROM t UNION ALL SELECT * REPLACE (event_id + 1000000 AS event_id) FROM t",
        "documents": "SELECT * REPLACE (doc_id + 33334 AS doc_id) FROM t UNION ALL SELECT * REPLACE (doc_id + 333334 AS doc_id) FROM t",
    }
    for t in TABLES:
        duckdb.sql(f"COPY ({made.get(t, 'FROM t').replace(' t', f' read_parquet({DATA + "/" + t + ".parquet"!r})')}) TO '{at}/{t}.parquet'")
    return str(at)


@pytest.mark.parametrize("name", ["export_join", "export_missing", "mask_join", "filter_with_dedup"])
def test_same_rows_as_sql_where_names_repeat(spark, repeated_names, name):
    same(QUERIES[name](spark, repeated_names), SQL[name], repeated_names)


def test_equal_names_stand_by_number(spark, repeated_names):
    """The SQL leaves their order open; the query's rows don't depend on how its input is cut."""
    want = sorted(map(str, QUERIES["dedup_adjacent"](spark, repeated_names).collect()))
    events = adapted(spark, repeated_names, "frames").collect()
    groups, kept = {}, []
    for r in events:
        groups.setdefault(r.shot_id, []).append(r)
    for rows in groups.values():
        rows.sort(key=lambda r: (r.filename, r.frame_num))
        q = [r.metrics.quality_score or 0.0 for r in rows]
        b = [r.metrics.brightness_score for r in rows]
        like = [False] + [None not in p and abs(p[0] - p[1]) <= 20 for p in zip(b, b[1:])] + [False]
        kept += [str(Row(filename=r.filename, kept=not (like[i] and not q[i] > q[i - 1] or like[i + 1] and q[i + 1] > q[i]))) for i, r in enumerate(rows)]
    assert want == sorted(kept)


def test_pictures_measured_together_as_one_by_one(spark):
    rng, rows = np.random.default_rng(5), []
    for i, (h, w, c) in enumerate([(16, 16, 1), (9, 20, 3), (1, 7, 1), (16, 16, 1), (9, 20, 3), (40, 33, 1)] * 6):
        data = rng.integers(0, 256, h * w * c, dtype=np.uint8).tobytes()
        mask = [None, rng.integers(0, 256, h * w, dtype=np.uint8).tobytes(), bytes(h * w), b"short"][i % 4]
        rows.append((i, (h, w, c, data), mask))
    schema = "i int, image struct<height: int, width: int, nChannels: int, data: binary>, mask binary"
    t = spark.createDataFrame([*rows, (99, (16, 16, 1, b"few"), None), (100, (0, 4, 1, b""), None)], schema)
    got = {r.i: r.measured for r in P.measure(t, mask="mask").collect()}
    assert all(got[i].error and got[i].sharpness is None and got[i].phash is None for i in (99, 100))
    for i, (h, w, c, data), mask in rows:
        if mask == b"short":
            assert got[i].error and got[i].brightness is None
            continue
        g, m = P.gray(P.pixels(data, h, w, c)), None if mask is None else np.frombuffer(mask, np.uint8).reshape(h, w)
        for k, f in P.METRICS.items():
            assert got[i][k] == pytest.approx(f(g, m), abs=1e-12) and got[i][f"{k}_score"] == 100 * got[i][k]
        assert got[i].phash == P.phash(g) and got[i].mask_area_pct == (None if m is None else P.mask_area(m)) and got[i].error is None
    assert P.measure(t, only=("phash",)).select("measured.*").columns == ["phash", "error"]


def test_few_bytes_of_keys_are_many_tasks(spark):
    assert tables._pictures(spark, DATA).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_precision_in_bounded_cuts(spark, monkeypatch):
    want = sorted(map(str, QUERIES["average_precision"](spark, DATA).collect()))
    sizes, keep = [], E.keep

    def seen(t):
        out = keep(t)
        if "cut" in out.columns:
            sizes.append(max(r["count"] for r in out.groupBy("cut").count().collect()))
        return out

    monkeypatch.setattr(E, "CUT", 200)
    monkeypatch.setattr(E, "keep", seen)
    assert sorted(map(str, QUERIES["average_precision"](spark, DATA).collect())) == want
    assert sizes and max(sizes) <= 2 * 200


def test_overlap_of_tracks_in_blocks(spark, monkeypatch):
    """Many blocks, a task for two of them; a track twice in a frame and boxes with gaps count as in a join of rows."""
    monkeypatch.setattr(M, "BLOCK", 4)
    same(QUERIES["track_overlap"](spark, DATA), SQL["track_overlap"])
    rows = [(1, 0, 5, 0.0, 0.0, 4.0, 4.0), (1, 0, 5, 1.0, 0.0, 4.0, 4.0), (1, 0, 6, 2.0, 1.0, 4.0, 4.0), (1, 1, 6, None, 0.0, 2.0, 2.0), (1, 1, 7, 1.0, 1.0, 2.0, None), (1, 1, 8, 0.0, 1.0, 0.0, 0.0), (1, 1, 9, 5.0, 5.0, 0.0, 0.0), (1, 2, 6, 0.0, 0.0, 2.0, 2.0)]
    t = spark.createDataFrame(rows, "video_id int, frame int, track_id int, x double, y double, w double, h double")
    t.createOrReplaceTempView("gappy")
    want = spark.sql("""SELECT video_id, a, b, coalesce(try_divide(sum(i), sum(s - i)), 0.0) AS iou FROM (SELECT a.video_id, a.track_id AS a, b.track_id AS b, a.w * a.h + b.w * b.h AS s,
        greatest(0.0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0.0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i
        FROM gappy a JOIN gappy b ON a.video_id = b.video_id AND a.frame = b.frame AND a.track_id < b.track_id) GROUP BY ALL""")
    assert sorted(M.overlap_over_time(t).collect()) == sorted(want.collect())


def test_tracks_suppressed_in_rounds(spark):
    t = adapted(spark, "/root/testdata/sf0.01", "tracks")
    one, some = (sorted(map(tuple, M.suppress_tracks(t, 0.1, most=n).select("video_id", "track_id", "kept").collect())) for n in (1000, 2))
    assert one == some and {k for _, _, k in one} == {True, False}


def test_an_image_leaves_its_matching_as_one_row(spark, monkeypatch):
    """And cgf1 matches once."""
    calls, per_group = [], E.per_group
    monkeypatch.setattr(E, "per_group", lambda *a: calls.append(a) or per_group(*a))
    df = QUERIES["cgf1"](spark, DATA)
    assert len(calls) == 1 and "ious" in calls[0][3]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1


def crowded(seed, n=40, frames=5):
    """Boxes that all overlap, most of them more than one other well; and some of which there is only one side."""
    rng = np.random.default_rng(seed)
    rows = lambda t, i, at: (int(seed), int(t), int(i), int(i) % 3, *map(float, at), float(at[0]) + 40, float(at[1]) + 30)
    at = rng.integers(0, 25, (n, 2)) + 0.0
    gt = [rows(t, i, at[i] + rng.random(2) * 9) for t in range(frames) for i in range(n) if rng.random() < 0.8]
    dt = [rows(t, i, at[i] + rng.random(2) * 9) for t in range(frames) for i in range(n + 10 * (t % 2)) if i < n and rng.random() < (0.6, 0.95)[t % 2]]
    return gt, dt


def crowds(spark):
    sides = [crowded(s) for s in (0, 1)]
    make = lambda k, name: spark.createDataFrame([r for s in sides for r in s[k]], f"video_id int, t int, {name} int, category_id int, x1 double, y1 double, x2 double, y2 double")
    return sides, make(0, "gt_id"), make(1, "trk_id")


@pytest.mark.parametrize("top", [1, 3, 1000])
def test_crowded_frames_like_whole_matrices(spark, monkeypatch, top):
    """However few partners a box hands on at first, and in however many blocks, each frame's assignment is the best of all."""
    sides, gt, dt = crowds(spark)
    monkeypatch.setattr(FR, "TOP", top)
    monkeypatch.setattr(FR, "CELLS", 300)
    got = {}
    for r in FR.matches(gt, dt, ["video_id"]).collect():
        got.setdefault((r.video_id, r.t), {})[r.gt_id, r.trk_id] = (r.sim, r.n_g, r.n_d)
    for v, (g, d) in enumerate(sides):
        n = 40
        both, n_g, n_d, sims = np.zeros((n, n)), *(np.bincount([r[2] for r in x], minlength=n) for x in (g, d)), {}
        for t in range(5):
            a, b = ([r for r in x if r[1] == t] for x in (g, d))
            sim = iou_matrix(*(np.array([r[4:] for r in x]) for x in (a, b)))
            i, j = ([r[2] for r in x] for x in (a, b))
            both[np.ix_(i, j)] += sim / (sim.sum(1)[:, None] + sim.sum(0) - sim)
            sims[t] = i, j, sim
        for t, (i, j, sim) in sims.items():
            score = (both / (n_g[:, None] + n_d - both))[np.ix_(i, j)] * sim
            mine = got[v, t]
            total = sum(score[i.index(x), j.index(y)] for x, y in mine)
            assert total == pytest.approx(score[assign(score)].sum()) and len({x for x, _ in mine}) == len({y for _, y in mine}) == len(mine)
            assert all(m == (pytest.approx(sim[i.index(x), j.index(y)]), n_g[x], n_d[y]) for (x, y), m in mine.items())


def test_nearest_of_crowded_frames_like_whole_matrices(spark):
    sides, gt, dt = crowds(spark)
    got = {}
    for r in FR.nearest_matches(gt, dt, ["video_id"], 0.5).collect():
        got.setdefault((r.video_id, r.t), []).append((r.gt_id, r.trk_id))
    for v, (g, d) in enumerate(sides):
        for t in range(5):
            a, b = ({r[2]: r[4:] for r in x if r[1] == t} for x in (g, d))
            sim = iou_matrix(*(np.array(list(x.values())) for x in (a, b)))
            worth = np.where(sim >= 0.5, sim, 0)
            i, j = list(a), list(b)
            assert sum(worth[i.index(x), j.index(y)] for x, y in got[v, t]) == pytest.approx(worth[assign(worth)].sum())
            assert all(worth[i.index(x), j.index(y)] > 0 for x, y in got[v, t]) and len({x for x, _ in got[v, t]}) == len({y for _, y in got[v, t]}) == len(got[v, t])


@pytest.mark.parametrize("score", [E.track_counts, E.teta_counts, lambda gt, dt, keys: training.scored_tracks(gt, dt, gt.limit(0), gt.limit(0))])
def test_no_row_a_pair_of_boxes(spark, monkeypatch, score):
    """Of crowded frames neither what is written nor what leaves or reaches Python grows as their pairs."""
    n, rng, schema = 150, np.random.default_rng(3), "video_id int, t int, category_id int, x1 double, y1 double, x2 double, y2 double"
    at = rng.random((n, 2)) * 20
    box = lambda t, i, d: (0, t, i, i % 2, *map(float, at[i] + t + d), *map(float, at[i] + t + d + 30))
    gt, dt = (spark.createDataFrame([box(t, i, d) for t in range(3) for i in range(n)], schema.replace("t int", f"t int, {name} int")) for name, d in (("gt_id", 0.0), ("trk_id", 0.05)))
    pairs, sizes = 3 * n * n, []
    for module in (E, FR, training):
        for name in ("keep", "per_group"):
            if hasattr(module, name):
                def seen(t, *a, f=getattr(module, name), **k):
                    sizes.append(t.count())
                    return f(t, *a, **k)

                monkeypatch.setattr(module, name, seen)
    score(gt, dt, ["video_id"]).collect()
    assert sizes and max(sizes) < pairs / 10


def test_a_task_sums_some_ids_at_once(spark, monkeypatch):
    """And hands on a part at a time, whose rows are those of all at once."""
    gt, dt = quality._truth(spark, "/root/testdata/sf0.01")
    seen, sizes, best, long_group = [], [], FR._best, FR.per_long_group
    monkeypatch.setattr(FR, "per_long_group", lambda df, keys, order, schema, fn, tasks: seen.append((df.orderBy(*keys, *order), keys, fn)) or long_group(df, keys, order, schema, fn, tasks))
    monkeypatch.setattr(FR, "_best", lambda *a: sizes.append(len(a[5]) * len(a[6])) or best(*a))
    rows = FR._summed(FR.sides(gt, dt, ["video_id"]).withColumn("n", F.lit(60)), ["video_id"])
    want = FR._candidates(rows, ["video_id"])
    df, keys, fn = seen[0]
    got = {}
    for cells, chunk in ((1 << 22, 1 << 16), (100, 50)):
        monkeypatch.setattr(FR, "CELLS", cells)
        monkeypatch.setattr(FR, "CHUNK", chunk)
        sizes.clear()
        parts = [{c: v.tolist() for c, v in part.items()} for _, one in df.toPandas().groupby(keys) for part in fn({c: one[c].to_numpy() for c in df.columns if c not in keys})]
        got[cells] = sorted(x for p in parts for x in zip(p["t"], p["r"], p["c"], p["sim"], p["score"], strict=True))
        assert max(sizes) <= cells and max(len(p["t"]) for p in parts) <= chunk + 200
    assert got[100] == got[1 << 22] == sorted((x.t, x.r, x.c, x.sim, x.score) for x in want.collect())


def test_the_other_side_is_copied_for_tasks_not_for_pairs(spark, monkeypatch):
    gt, dt = quality._truth(spark, "/root/testdata/sf0.01")
    keys, blocks = ["video_id", "category_id"], []
    monkeypatch.setattr(FR, "CELLS", 8)
    for name in ("per_group", "per_long_group"):
        if hasattr(FR, name):
            monkeypatch.setattr(FR, name, lambda df, by, *a, f=getattr(FR, name), **k: blocks.append((df, by)) or f(df, by, *a, **k))
    FR._candidates(FR.sides(gt, dt, keys).withColumns({"n": F.lit(60), "total": F.lit(1.0), "lead": F.lit(1)}), keys)
    df, by = blocks[0]
    sequences = df.select(*by[:-1]).distinct().count()
    assert df.select(*by).distinct().count() <= sequences + 2 * spark.sparkContext.defaultParallelism


def test_runs_of_long_masks_in_linear_time(spark):
    """Ends are made a few times, not once for each run."""
    on = [[i % 2 for i in range(6000)], [1] * 7, [0], [1, 0, 0], []]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(on)], "i int, on array<int>")
    got = {r.i: r.runs for r in t.select("i", masks.runs(F.col("on")).alias("runs")).collect()}
    assert got[0] == [1] * 6000 and [got[i] for i in (1, 2, 3)] == [[0, 7], [1], [0, 1, 2]]
    assert str(t.select(masks.runs(F.col("on")))._jdf.queryExecution().analyzed()).count("transform(") == 0


def test_mask_runs_in_many_tasks(spark):
    assert QUERIES["mask_runs"](spark, DATA).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("name", ["crop_plan", "best_box_face"])
def test_a_box_is_not_grouped_again(spark, name):
    """Groups are those of an image at most; no group is a whole row."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [" in line and "idx#" in line.split("Aggregate [", 1)[1].split("]", 1)[0]]


def test_only_candidates_have_a_distance(spark):
    """The distances of dedup_hybrid are those of pairs by hash; no join pairs a base's frames."""
    df = QUERIES["dedup_hybrid"](spark, DATA)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"\bg#", plan)
    same(df, SQL["dedup_hybrid"])


def test_assignments_of_many_groups_like_one_by_one():
    rng = np.random.default_rng(3)
    n, m = rng.integers(0, 9, 600), rng.integers(0, 9, 600)
    score = rng.random((n * m).sum()) * (rng.random((n * m).sum()) < 0.6)
    got, starts = assign_many(score, n, m), np.cumsum(n * m) - n * m
    for g, at in enumerate(starts):
        one = score[at : at + n[g] * m[g]].reshape(n[g], m[g])
        i, j = np.divmod(got[(got >= at) & (got < at + one.size)] - at, max(1, m[g]))
        assert len(set(i)) == len(set(j)) == len(i) == min(n[g], m[g])
        assert one[i, j].sum() == pytest.approx(one[assign(one)].sum())


@pytest.mark.parametrize("name", ["mask_assigned", "mask_new", "mask_tracks"])
def test_a_mask_meets_its_image_in_one_move(spark, name):
    assert "Join" not in QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


def test_masks_of_any_length_met_in_blocks_like_columns(spark):
    rng = np.random.default_rng(6)
    word = lambda: int(rng.integers(-(2**63), 2**63 - 1)) if rng.random() < 0.6 else 0
    mask = lambda: [None, [], [0, 0], [5, None]][rng.integers(4)] if rng.random() < 0.2 else [word() for _ in range(rng.integers(1, 9))]
    keys = [1] * 40 + [2] * 3 + [4] * 2 + [None] * 2
    d = spark.createDataFrame([(k, i, 0.3 + i % 5 / 5, mask()) for i, k in enumerate(keys)], "image_id long, idx int, conf double, mask array<long>")
    t = spark.createDataFrame([(k, i, mask()) for i, k in enumerate([1] * 30 + [2] * 5 + [3] + [None])], "image_id long, track_id long, mask array<long>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.image_id, r.idx, r.track_id): r.iou for r in O.overlaps(d, t).collect()}
        new = {(r.image_id, r.idx) for r in O.new_detections(d, t).collect()}
        pairs = O.assigned(d, t).groupBy("image_id").count().collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    both = d.join(t.withColumnRenamed("mask", "other"), "image_id").select("image_id", "idx", "conf", "track_id", F.when((masks.area(F.col("mask")) > 0) & (masks.area(F.col("other")) > 0), masks.iou(F.col("mask"), F.col("other"))).otherwise(0.0).alias("iou")).collect()
    assert got == {(r.image_id, r.idx, r.track_id): r.iou for r in both}
    best = {i: max(r.iou for r in both if r.idx == i) for i in {r.idx for r in both}}
    assert new == {(k, i) for i, k in enumerate(keys) if i not in best or best[i] < 0.5 and 0.3 + i % 5 / 5 >= 0.5}
    assert {r.image_id: r["count"] for r in pairs} == {1: 30, 2: 3}


def _some_boxes(spark, rng, keys, names, shift=0):
    low = rng.integers(0, 40, (len(keys), 2))
    box = np.hstack([low, low + rng.integers(0, 25, low.shape)]).astype(float).tolist()
    return spark.createDataFrame([(k, i + shift, *box[i], 0.3 + i % 7 / 10) for i, k in enumerate(keys)], f"image_id long, {names} long, x1 double, y1 double, x2 double, y2 double, conf double")


def _by_image(df, *names):
    out = {}
    for r in df.collect():
        out.setdefault(r.image_id, []).append(tuple(r[c] for c in names))
    return out


def test_associate_in_batches_like_loops(spark):
    rng = np.random.default_rng(8)
    d, t = _some_boxes(spark, rng, rng.integers(0, 60, 260).tolist() + [99] * 30, "idx"), _some_boxes(spark, rng, rng.integers(5, 70, 200).tolist() + [99] * 25, "track_id", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        out = M.associate(d, t, "image_id", match=0.2)
        got = {(r.image_id, r.idx): r for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()  # a call has many images
    dets, tracks = _by_image(d, "idx", *M.BOX), _by_image(t, "track_id", *M.BOX)
    assert len(got) == sum(map(len, dets.values()))
    for image, rows in dets.items():
        rows, others = np.array(sorted(rows)), np.array(sorted(tracks.get(image, [])))
        iou = iou_matrix(rows[:, 1:], others[:, 1:]) if len(others) else np.zeros((len(rows), 0))
        mine = [got[image, int(i)] for i in rows[:, 0]]
        best = iou.max(1) if len(others) else np.zeros(len(rows))
        assert [r.iou for r in mine] == best.tolist() and [r.is_new for r in mine] == (best < 0.1).tolist()
        pairs = [(k, others[:, 0].tolist().index(r.track_id)) for k, r in enumerate(mine) if r.track_id is not None]
        assert len({j for _, j in pairs}) == len(pairs) and all(iou[p] >= 0.2 for p in pairs)
        if len(others):
            i, j = assign(iou)
            assert sum(iou[p] for p in pairs) == pytest.approx(iou[i, j][iou[i, j] >= 0.2].sum())


def test_match_counts_in_batches_like_loops(spark):
    rng = np.random.default_rng(9)
    g, d = _some_boxes(spark, rng, rng.integers(0, 60, 240).tolist() + [99] * 20, "idx"), _some_boxes(spark, rng, rng.integers(5, 70, 240).tolist() + [99] * 30, "idx")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        out = E.match_counts(g, d, thresholds=(0.3, 0.6))
        got = {(r.image_id, r.threshold): (r.tp, r.fp, r.fn, r.n_gt, r.n_dt) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()  # a call has many images
    truths, found = _by_image(g, *M.BOX), _by_image(d.filter("conf >= 0.5"), *M.BOX)
    want = {}
    for image in truths.keys() | found.keys():
        a, b = np.array(truths.get(image, [])).reshape(-1, 4), np.array(found.get(image, [])).reshape(-1, 4)
        iou = iou_matrix(a, b)
        on = iou[assign(iou)]
        for t in (0.3, 0.6):
            tp = int((on >= t).sum())
            want[image, t] = (tp, len(b) - tp, len(a) - tp, len(a), len(b))
    assert got == want


def test_most_a_frame_in_one_move_like_loops(spark):
    rng = np.random.default_rng(10)
    rows = []
    for v in range(30):
        n, frames = int(rng.integers(1, 9)), [1, 2] if v % 10 == 7 else [0, 1, 3]
        has = [[[1, 2], [], None][rng.integers(3)] for _ in range(n)]
        rows += [(v, f, 100 * f + 7 * i, has[i]) for f in frames for i in range(n)]
    t = spark.createDataFrame(rows, "datapoint long, frame int, query long, objects array<int>").repartition(5)
    for positives in (False, True):
        out = datasets.most_a_frame(t, 3, positives, seed=2)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert out.columns == t.columns and plan.count("Exchange hashpartitioning(datapoint") == 1 and "Join" not in plan
        want = []
        for v in range(30):
            mine = [r for r in rows if r[0] == v]
            places = {f: sorted(r[2] for r in mine if r[1] == f) for f in {r[1] for r in mine}}
            if max(map(len, places.values())) <= 3:
                want += mine
                continue
            objects = {r[2]: r[3] for r in mine if r[1] == 0}
            order = sorted((((2 if objects[q] is None else int(not objects[q])) if positives else 0), hashlib.md5(f"2:{v}:{k + 1}".encode()).hexdigest(), k) for k, q in enumerate(places.get(0, [])))
            chosen = {k for _, _, k in order[:3]}
            want += [r for r in mine if places[r[1]].index(r[2]) in chosen]
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in out.collect())


def test_datapoints_move_once_like_loops(spark):
    rng = np.random.default_rng(12)
    images = [(i, int(rng.integers(50, 90)), int(rng.integers(40, 80))) for i in range(25)]
    anns = [(i, 3 * k, [float(v) for v in rng.random(4)]) for i in range(22) for k in rng.permutation(rng.integers(0, 6)).tolist()]
    asked = [(i, q, f"text {q % 2}", [None, [], [int(v) for v in rng.integers(0, 14, 4)]][min(2, int(rng.integers(0, 8)))]) for i in range(3, 25) for q in range(rng.integers(0, 4))]
    args = [spark.createDataFrame(r, s).repartition(3) for r, s in ((images, "image_id long, width int, height int"), (anns, "image_id long, ann_id int, box array<double>"), (asked, "image_id long, query int, text string, ann_ids array<int>"))]
    out = training.datapoints(*args)
    assert out.columns == ["image_id", "width", "height", "objects", "queries"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    got = {r.image_id: r for r in out.collect()}
    assert len(got) == len(images)
    for i, w, h in images:
        mine = sorted((a, b) for k, a, b in anns if k == i)
        cut = lambda v, most: min(max(v, 0.0), float(most))
        boxes = [(cut(x * w, w), cut(y * h, h), cut((x + bw) * w, w), cut((y + bh) * h, h)) for _, (x, y, bw, bh) in mine]
        ids = [a for a, _ in mine]
        queries = [(text, sorted(ids.index(a) for a in ann or [] if a in ids)) for _, text, ann in sorted((q, t, a) for k, q, t, a in asked if k == i)]
        assert got[i].objects == (boxes or None) and got[i].queries == (queries or None)


def test_datapoints_number_boxes_once(spark):
    """What images, annotations and queries read has no window over the driver's table behind it."""
    assert "l_orderkey" not in QUERIES["datapoints"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
