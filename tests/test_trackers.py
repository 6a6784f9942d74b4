"""Trackers and scans against plain loops on random frames."""

import random

import pytest
from pyspark.sql import functions as F

from meadow.operators import tracking, tracks
from meadow.operators.nearest import nearest_within
from meadow.params import LANDING

BOX = "x1 double, y1 double, x2 double, y2 double"


def middle(b):
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def apart(a, b):
    return ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5


def area(b):
    return max(1.0, (b[2] - b[0]) * (b[3] - b[1]))


def shuffled_flowers(seed, videos=3, frames=60):
    """Flowers that jitter, are missed for a while, come back and stand close to each other."""
    r = random.Random(seed)
    rows = []
    for v in range(videos):
        spots = [(r.uniform(0, 400), r.uniform(0, 300), r.uniform(15, 40)) for _ in range(9)]
        hidden = {}
        for fi in range(0, frames * 3, 3):
            for k in r.sample(range(9), 9):
                if hidden.get(k, -1) >= fi:
                    continue
                if r.random() < 0.1:
                    hidden[k] = fi + r.choice([3, 9, 15, 18, 40])
                    continue
                x, y, h = spots[k]
                x, y = x + r.uniform(-6, 6), y + r.uniform(-6, 6)
                rows.append((v, fi, len(rows), x - h, y - h, x + h, y + h))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_canonical_flowers_against_a_loop(spark, seed):
    rows = shuffled_flowers(seed)
    want = set()
    for v in range(3):
        view, made = [], 0
        for fi in sorted({r[1] for r in rows if r[0] == v}):
            taken = []
            for b in [r[3:] for r in rows if r[0] == v and r[1] == fi]:
                open_ = [(apart(middle(b), middle(f["box"])), -f["n"], f) for f in view if f["n"] not in taken]
                open_ = [x for x in open_ if x[0] <= LANDING.merge_k * area(b) ** 0.5]
                if open_:
                    f = min(open_, key=lambda x: x[:2])[2]
                    f["box"] = [LANDING.flower_ema * o + (1 - LANDING.flower_ema) * x for o, x in zip(f["box"], b)]
                else:
                    made += 1
                    f = {"n": made, "box": list(b)}
                    view.append(f)
                f["at"] = fi
                taken.append(f["n"])
            view = [f for f in view if fi - f["at"] <= LANDING.hold_s * LANDING.fps]
            want |= {(v, fi, f"flower_{f['n']}", *(round(x, 6) for x in f["box"])) for f in view}
    df = spark.createDataFrame(rows, f"video int, fi int, ordinal int, {BOX}").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {(r.video, r.fi, r.flower_id, *(round(x, 6) for x in r[3:])) for r in tracking.canonical_flowers(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and len({w[2] for w in want}) > 9


def test_nearest_within_rings(spark):
    r = random.Random(3)
    places = [(v, f"p{k:03}", r.uniform(-200, 200), r.uniform(-200, 200)) for v in range(3) for k in range(40)] + [(1, "twin", 5.0, 5.0), (1, "also", 5.0, 5.0), (2, None, 1.0, 1.0), (2, "none", None, 3.0)]
    points = [(v, k, r.uniform(-250, 250), r.uniform(-250, 250), r.choice([0.0, 1.0, 8.0, 20.0, 90.0, 400.0])) for v in range(4) for k in range(60)] + [(1, 99, 5.0, 5.0, 0.0), (1, 98, None, 5.0, 9.0), (1, 97, 5.0, 5.0, None)]
    got = nearest_within(spark.createDataFrame(points, "video int, id long, x double, y double, reach double"), spark.createDataFrame(places, "video int, name string, x double, y double")).collect()
    assert len(got) == len(points)
    for row in got:
        if row.x is None or row.reach is None:
            assert row.near is None
            continue
        near = [(apart((row.x, row.y), p[2:]), p[1] or "", p[1]) for p in places if p[0] == row.video and p[2] is not None]
        near = [x for x in near if x[0] <= row.reach]
        assert row.near == (min(near)[2] if near else None), row


def test_nearest_without_points_or_reach(spark):
    places = spark.createDataFrame([(1, "a", 1.0, 1.0)], "video int, name string, x double, y double")
    none = spark.createDataFrame([], "video int, id long, x double, y double, reach double")
    assert nearest_within(none, places).count() == 0
    at = spark.createDataFrame([(1, 1, 1.0, 1.0, 0.0), (1, 2, 1.5, 1.0, 0.0)], "video int, id long, x double, y double, reach double")
    assert {(r.id, r.near) for r in nearest_within(at, places).collect()} == {(1, "a"), (2, None)}


def test_attributed_against_a_loop(spark):
    r = random.Random(4)
    flowers = [(v, f"f{k:02}", k, r.uniform(0, 600), r.uniform(0, 400)) for v in range(2) for k in range(12)]
    landed = [(v, k, r.uniform(0, 600), r.uniform(0, 400), r.uniform(4, 300)) for v in range(2) for k in range(250)]
    want = {}
    for v in range(2):
        made = []
        for _, k, x, y, a in [z for z in landed if z[0] == v]:
            reach = LANDING.unknown_k * a**0.5
            near = [(apart((x, y), f[3:]), f[1]) for f in flowers if f[0] == v]
            near = min((z for z in near if z[0] <= reach), default=None)
            if near:
                want[v, k] = near[1]
                continue
            old = next((n for n, at in enumerate(made, 1) if apart((x, y), at) <= reach), None)
            if old is None:
                made.append((x, y))
                old = len(made)
            want[v, k] = f"flower_unk_{old}"
        assert len(made) > 20
    got = tracking.attributed(spark.createDataFrame(landed, "video int, seq int, cx double, cy double, area double"), spark.createDataFrame(flowers, "video int, flower_id string, ordinal int, cx double, cy double"))
    assert {(x.video, x.seq): x.flower_id for x in got.collect()} == want


def united(dets):
    """Groups of one video's tracks {id: {fi: box}} by the rule, in order."""
    info = {t: (min(b), max(b)) for t, b in dets.items()}
    order = sorted(info, key=lambda t: (info[t][0], t))
    group = {t: {t} for t in order}

    def join(a, b):
        both = group[a] | group[b]
        for t in both:
            group[t] = both

    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            common = set(dets[a]) & set(dets[b])
            if len(common) >= 2:
                total = 0.0
                for f in common:
                    p, q = dets[a][f], dets[b][f]
                    inter = max(0.0, min(p[2], q[2]) - max(p[0], q[0])) * max(0.0, min(p[3], q[3]) - max(p[1], q[1]))
                    total += inter / (area(p) + area(q) - inter) if inter else 0.0
                if total / len(common) >= LANDING.concurrent_iou:
                    join(a, b)
    second = 0
    for later in order:
        offers = []
        for e in order:
            gap = info[later][0] - info[e][1]
            size = max(area(dets[e][info[e][1]]), area(dets[later][info[later][1]])) ** 0.5
            if e != later and 0 <= gap <= LANDING.relink_s * LANDING.fps and apart(middle(dets[later][info[later][0]]), middle(dets[e][info[e][1]])) <= LANDING.relink_k * size:
                offers.append((gap, info[e][0], e))
        left = [o for o in sorted(offers) if o[2] not in group[later]]
        second += bool(left) and left[0] != min(offers)
        if left:
            join(later, left[0][2])
    return {t: min(group[t]) for t in order}, second


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_unified_against_a_loop(spark, seed):
    r = random.Random(seed)
    rows, want, second = [], {}, 0
    for v in range(4):
        dets = {}
        for t in range(60):
            x, y, f0 = r.uniform(0, 500), r.uniform(0, 300), r.randrange(250)
            dets[t] = {f: (x + f % 5, y, x + f % 5 + 20, y + 20) for f in range(f0, f0 + r.randrange(1, 30))}
            if r.random() < 0.5:  # another id for the same insect, a little later
                dets[t + 100] = {f: tuple(c + 2 for c in b) for f, b in dets[t].items() if f > f0 + 1} or {f0: (x, y, x + 5, y + 5)}
        rows += [(v, t, f, "bee", 0.5, *b) for t, one in dets.items() for f, b in one.items()]
        groups, n = united(dets)
        want |= {(v, t): g for t, g in groups.items()}
        second += n
    df = spark.createDataFrame(rows, f"video int, track_id int, fi int, cls string, conf double, {BOX}")
    ends = tracks.spans(df)
    alone = ends.select("video", F.col("track_id").cast("long").alias("track_id"), F.col("track_id").cast("long").alias("grp"))
    groups = tracks.continued(tracks._regrouped(alone, tracks.concurrent_edges(df)), tracks.relink_pairs(ends))
    assert {(x.video, x.track_id): x.grp for x in groups.collect()} == want
    assert second > 3  # tracks that took another than their best
    got = {(x.video, x.track_id) for x in tracks.unified(df).select("video", "track_id").distinct().collect()}
    assert got == {(v, g) for (v, _), g in want.items()}


@pytest.mark.parametrize("alpha", [0.0, 0.05, 0.6, 0.85, 0.97, 1.0])
def test_smoothed_against_a_loop(spark, alpha):
    r = random.Random(8)
    rows = [(1, t, f, r.uniform(-500, 900), 1.0) for t in range(3) for f in sorted(r.sample(range(4000), 1500 if t else 1))]
    got = {(x.track_id, x.fi): x.x1 for x in tracks.smoothed(spark.createDataFrame(rows, "video int, track_id int, fi int, x1 double, other double"), alpha, ("x1",)).collect()}
    assert len(got) == len(rows)
    for t in range(3):
        mean = None
        for _, _, f, x, _ in [z for z in rows if z[1] == t]:
            mean = x if mean is None else alpha * mean + (1 - alpha) * x
            assert abs(got[t, f] - mean) < 1e-9
