"""Queries over all rows: neither they nor their SQL read a subset by id."""

import pytest

from framelake.operators import matching
from framelake.plans import QUERIES, SQL, quality
from framelake.plans.adapters import adapted, table
from framelake.streaming import state
from oracle import same

DATA = "/root/testdata/sf0.01"
SUBSETS = {
    "ema_eta": " WHERE user_id < 40",
    "queue_status": " WHERE event_id < 600",
    "pixel_levels": " WHERE p_partkey < 200",
    "count_metric": " WHERE frame < 20",
    "track_overlap": " WHERE a.frame < 20",
    "select_expression": " AND event_id % 50 = 0",
    "nearest_conditioning": " WHERE frame < 40",
    "ytvis_explode": "frame < 10 AND ",
}


@pytest.mark.parametrize("name", sorted(SUBSETS))
def test_all_rows_as_sql_without_filter(spark, name):
    assert SUBSETS[name] not in SQL[name]
    same(QUERIES[name](spark, DATA), SQL[name], DATA)


def test_pixel_metrics_of_every_part(spark):
    keys = sorted(r.p_partkey for r in QUERIES["pixel_metrics"](spark, DATA).collect())
    assert keys == sorted(r.p_partkey for r in table(spark, DATA, "part").collect())


def test_truth_has_whole_tracks(spark):
    """What hota, hota_rollup and teta score."""
    rows = lambda t, frame, track: sorted((r["video_id"], r[frame], r[track]) for r in t.collect())
    gt, dt = quality._truth(spark, DATA)
    want = rows(adapted(spark, DATA, "tracks"), "frame", "track_id")
    assert rows(gt, "t", "gt_id") == want
    assert rows(dt, "t", "trk_id") == sorted((v, t, i + 1000 * (t >= 12)) for v, t, i in want if (t + i) % 6)


def test_hota_of_whole_tracks(spark):
    """At alpha 0.05 every detection that stays is matched, so recall follows from the rows."""
    want = {}
    for r in adapted(spark, DATA, "tracks").collect():
        n = want.setdefault(r.video_id, [0, 0])
        n[0] += 1
        n[1] += (r.frame + r.track_id) % 6 != 0
    got = {r.video_id: r for r in QUERIES["hota"](spark, DATA).collect()}
    assert sorted(got) == sorted(want)
    for v, (n, stay) in want.items():
        assert got[v].det_re <= stay / n + 1e-6
        assert got[v].det_re / got[v].det_pr == pytest.approx(stay / n, abs=1e-4)


def test_track_suppression_sees_late_frames(spark):
    tracks = adapted(spark, DATA, "tracks")
    iou = {(r.video_id, r.a, r.b): r.iou for r in matching.overlap_over_time(tracks).collect()}
    best = {}
    for r in tracks.collect():
        best[r.video_id, r.track_id] = max(best.get((r.video_id, r.track_id), 0), r.score)
    gone = set()
    for v, t in sorted(best, key=lambda k: (k[0], -best[k], k[1])):
        if (v, t) not in gone:
            gone |= {(v, u) for w, u in best if w == v and u != t and iou.get((v, min(t, u), max(t, u)), 0) >= 0.1}
    assert {(r.video_id, r.track_id) for r in QUERIES["nms_track"](spark, DATA).collect() if not r.kept} == gone


def test_probation_reads_late_frames(spark, monkeypatch):
    """Its events end early on these tables, so what it reads is held against all rows."""
    monkeypatch.setattr(state, "probation_table", lambda rows: rows)
    rows = sorted((r.video_id, r.frame, r.object_id) for r in QUERIES["probation"](spark, DATA).collect())
    assert rows == sorted((r.video_id, r.frame, r.track_id) for r in adapted(spark, DATA, "tracks").collect())
