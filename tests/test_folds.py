"""Operators whose order matters, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from meadow.operators import detections as det
from meadow.operators import episodes, tracking, tracks
from meadow.params import LANDING

BOX = "x1 double, y1 double, x2 double, y2 double"


def boxes(n, seed, frames=6):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y, w, h = r.uniform(0, 300), r.uniform(0, 200), r.uniform(10, 80), r.uniform(10, 80)
        out.append((1, i, r.randrange(frames), "bee", round(r.random(), 6), x, y, x + w, y + h))
    return out


def area(b):
    return max(1.0, (b[2] - b[0]) * (b[3] - b[1]))


def inter(a, b):
    return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))


def test_without_overlaps(spark):
    rows = boxes(60, 1)
    df = spark.createDataFrame(rows, f"video int, track_id int, fi int, cls string, conf double, {BOX}")
    got = {(r.fi, r.track_id) for r in det.without_overlaps(df).collect()}
    want = set()
    for f in range(6):
        kept = []
        for r in sorted((x for x in rows if x[2] == f), key=lambda x: (-x[4], x[1])):
            b = r[5:]
            if all(inter(b, k) / (area(b) + area(k) - inter(b, k)) < 0.6 and inter(b, k) / min(area(b), area(k)) < 0.75 for k in kept):
                kept.append(b)
                want.add((f, r[1]))
    assert got == want


def test_assigned(spark):
    rows = boxes(60, 2)
    df = spark.createDataFrame(rows, f"video int, track_id int, fi int, cls string, conf double, {BOX}")
    a = df.where("track_id % 2 = 0").select("video", "fi", F.col("track_id").alias("flower_id"), "x1", "y1", "x2", "y2")
    b = df.where("track_id % 2 = 1").select("video", "fi", F.col("track_id").alias("det"), "x1", "y1", "x2", "y2")
    got = {(r.fi, r.flower_id, r.det) for r in tracking.assigned(a, b, 0.1).collect()}
    want = set()
    for f in range(6):
        now = [x for x in rows if x[2] == f]
        pairs = []
        for p in now:
            for q in now:
                if p[1] % 2 == 0 and q[1] % 2 == 1:
                    i, u = inter(p[5:], q[5:]), (p[7] - p[5]) * (p[8] - p[6]) + (q[7] - q[5]) * (q[8] - q[6])
                    if i and i / (u - i) >= 0.1:
                        pairs.append((-i / (u - i), p[1], q[1]))
        used_a, used_b = set(), set()
        for _, x, y in sorted(pairs):
            if x not in used_a and y not in used_b:
                used_a.add(x), used_b.add(y), want.add((f, x, y))
    assert got == want


def test_landings_follow_the_state_machine(spark):
    r = random.Random(5)
    rows = []
    for track in range(30):
        fi = 0
        for _ in range(60):
            fi += r.choice([1, 1, 2, 8, 15])
            on = r.random() < 0.5
            rows.append((1, track, fi, round(fi * 0.05, 2), 0.5, f"f{r.randrange(3)}" if on else None))
    df = spark.createDataFrame(rows, "video int, track_id int, fi int, t double, conf double, flower_id string")
    got = sorted((x.track_id, x.t_enter_s, x.t_exit_s, x.flower_id) for x in episodes.landings(df).collect())
    want = []
    for track in range(30):
        open_ = None
        for _, _, _, t, _, f in [x for x in rows if x[1] == track]:
            if f is not None:
                open_ = [open_[0] if open_ else t, t, f]
            elif open_ and t - open_[1] > LANDING.grace_s:
                want.append((track, *open_))
                open_ = None
        if open_:
            want.append((track, *open_))
    assert got == sorted(want)


def test_entered_visits(spark):
    r = random.Random(6)
    rows = [(1, t, fi, r.choice(["a", "b", None])) for t in range(10) for fi in range(0, 200, 3)]
    df = spark.createDataFrame(rows, "video int, track_id int, fi int, flower_id string")
    got = {(x.track_id, x.flower_id): x.visits for x in episodes.entered_visits(df).collect()}
    want, last, counted = {}, {}, {}
    for _, t, fi, f in rows:
        if f is not None and last.get(t) != f and fi - counted.get((t, f), -(10**9)) > 20:
            want[(t, f)] = want.get((t, f), 0) + 1
            counted[(t, f)] = fi
        last[t] = f
    assert got == want


def test_steady_labels(spark):
    r = random.Random(7)
    rows = [(1, t, fi, r.choice(["bee", "fly", "bug"]), round(r.random(), 3)) for t in range(5) for fi in range(40)]
    df = spark.createDataFrame(rows, "video int, track_id int, fi int, cls string, conf double")
    got = {(x.track_id, x.fi): x.cls for x in episodes.steady_labels(df).collect()}
    for t in range(5):
        shown, sums = None, {}
        for _, _, fi, c, conf in [x for x in rows if x[1] == t]:
            sums[c] = sums.get(c, 0.0) + conf
            if shown is None or c != shown and sums[c] >= 1.5 * sums[shown]:
                shown = c
            assert got[(t, fi)] == shown


def test_canonical_flowers_keep_their_ids(spark):
    rows = [(1, fi, k, 100.0 * k + fi % 2, 10.0, 100.0 * k + 40 + fi % 2, 50.0) for fi in range(0, 30, 2) for k in range(3)]
    df = spark.createDataFrame(rows, f"video int, fi int, ordinal int, {BOX}")
    got = tracking.canonical_flowers(df).groupBy("flower_id").count().collect()
    assert {x.flower_id: x["count"] for x in got} == {"flower_1": 15, "flower_2": 15, "flower_3": 15}


def test_unknown_flowers_are_reused(spark):
    landed = spark.createDataFrame([(1, 1, 10.0, 10.0, 4.0), (1, 2, 11.0, 10.0, 4.0), (1, 3, 500.0, 10.0, 4.0), (1, 4, 100.0, 100.0, 4.0)], "video int, seq int, cx double, cy double, area double")
    flowers = spark.createDataFrame([(1, "a", 1, 102.0, 100.0)], "video int, flower_id string, ordinal int, cx double, cy double")
    got = {r.seq: r.flower_id for r in tracking.attributed(landed, flowers).collect()}
    assert got == {1: "flower_unk_1", 2: "flower_unk_1", 3: "flower_unk_2", 4: "a"}


def test_unified_tracks(spark):
    line = lambda t, a, z, off=0.0: [(1, t, fi, "bee", 0.5, fi + off, 10.0, fi + off + 20, 30.0) for fi in range(a, z)]
    rows = line(1, 0, 10) + line(2, 14, 20) + line(3, 14, 20, 2.0) + line(4, 0, 10, 600.0)
    df = spark.createDataFrame(rows, f"video int, track_id int, fi int, cls string, conf double, {BOX}")
    got = tracks.unified(df).groupBy("track_id").count().collect()
    assert {r.track_id: r["count"] for r in got} == {1: 16, 4: 10}


@pytest.mark.parametrize("n", [0, 1])
def test_empty_tables(spark, n):
    df = spark.createDataFrame(boxes(n, 3), f"video int, track_id int, fi int, cls string, conf double, {BOX}")
    for f in (det.without_overlaps, det.class_votes, det.best_boxes, tracks.spans, tracks.interpolated, tracks.unified):
        assert f(df).count() == n
