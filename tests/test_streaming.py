"""The stream against a replay of the same rows, and its sinks across restarts."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from meadow.sources.readers import DETECTIONS, detection_stream
from meadow.streaming import live

T0 = datetime(2024, 5, 1, 12, 0, 0)


@pytest.fixture(autouse=True)
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STATE_STORE)


def rows(camera, seed, seconds=30):
    """One flower; a bee that lands, vanishes for a moment and comes back; a fly that passes."""
    r = random.Random(seed)
    out = []
    for k in range(seconds * 4):
        t, ts = k * 0.25, T0 + timedelta(seconds=k * 0.25)
        row = lambda kind, track, cls, x, y, s: (camera, ts, k, kind, track, cls, 0.9, x - s, y - s, x + s, y + s)  # noqa: B023, E731
        out.append(row("flower", None, None, 100.0 + r.random(), 100.0, 40.0))
        if 2 <= t < 6 or 7.5 <= t < 12:
            out.append(row("insect", 1 if t < 6 else 2, "bee", 100.0 + r.random(), 101.0, 6.0))
        if t >= 12:
            out.append(row("insect", 2, "bee", 400.0, 300.0, 6.0))
        if 20 <= t < 21:
            out.append(row("insect", 3, "fly", 90.0, 100.0, 4.0))
    return out


def written(spark, path, files=4):
    data = rows("cam0", 1) + rows("cam1", 2)
    data.sort(key=lambda r: r[1])
    n = -(-len(data) // files)
    for k in range(files):
        spark.createDataFrame(data[k * n : (k + 1) * n], DETECTIONS).coalesce(1).write.mode("append").parquet(path)
    # A late row of another camera moves the watermark past everything, so that timers fire.
    end = [("zz", T0 + timedelta(seconds=600 + 60 * k), k, "flower", None, None, 0.9, 0.0, 0.0, 9.0, 9.0) for k in range(2)]
    for e in end:
        spark.createDataFrame([e], DETECTIONS).coalesce(1).write.mode("append").parquet(path)
    return spark.createDataFrame(data, DETECTIONS)


def key(r):
    return r.camera, r.seq, r.t_enter_s, r.t_exit_s, r.flower_id, r.insect_type, r.is_real_landing


def test_stream_equals_replay(spark, tmp_path):
    table = written(spark, str(tmp_path / "in"))
    landed = live.live_landings(detection_stream(spark, str(tmp_path / "in")))
    q = live.append_to(landed, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    got = sorted(key(r) for r in spark.read.schema(live.LANDED).parquet(str(tmp_path / "out")).where("camera <> 'zz'").collect())
    want = sorted(key(r) for r in live.replayed(table).collect())
    assert got == want
    bees = [r for r in want if r[5] == "bee"]
    # The bee that came back near by is one landing, from its first second to its last.
    assert [(r[2], r[3]) for r in bees] == [(2.0, 11.75)] * 2 and all(r[6] == 1 for r in bees)


def test_flower_rules():
    row = lambda t, kind, x, s=50.0: (t, kind, 1 if kind == "insect" else -1, "bee", 0.5, x - s, 0.0, x + s, 100.0)
    rows = pd.DataFrame([row(0.0, "flower", 50), row(0.0, "insect", 50, 5.0), row(0.1, "flower", 52), row(0.1, "flower", 300), row(0.1, "insect", 50, 5.0), row(0.7, "insect", 50, 5.0), row(0.8, "insect", 50, 5.0)], columns=["ts", "kind", "track", "cls", "conf", *live.SIDES])
    under, known, made = live.flower_under(rows, {}, 0)
    # A flower counts from its second box on, for 0.6 s after its last one.
    assert [None if k != k else int(k) for k in under[rows["kind"] == "insect"]] == [None, 1, 1, None]
    assert made == 2 and abs(known[1][0] - (0.85 * 0 + 0.15 * 2)) < 1e-9 and known[1][5] == 2
    assert live.flower_under(rows.assign(ts=rows["ts"] + 9), known, made)[1].keys() == {3, 4}


def test_sighting_rules():
    box = lambda x, s=5.0: (x - s, 0.0, x + s, 10.0)
    s = live.Sightings()
    assert s.add(0.0, 1, "bee", 0.5, box(50), "flower_1") == [] and s.add(0.4, 1, "fly", 0.4, box(90), None) == []
    (when, landing), = s.add(0.6, 1, "fly", 0.4, box(90), None)  # off for longer than the grace
    assert when == 0.6 and landing == (0.0, 0.0, "flower_1", "fly", 0.5)
    s.add(1.0, 2, "bee", 0.9, box(200), "flower_2")
    s.add(2.0, 3, "bee", 0.9, box(215), "flower_2")  # takes up what track 2 left: 15 is within 4 roots of 100
    s.add(2.0, 4, "bee", 0.9, box(260), "flower_3")  # too far
    assert s.table[s.current[3]].enter == 1.0 and s.table[s.current[4]].enter == 2.0
    s.add(7.6, 5, "bug", 0.2, box(215), "flower_2")  # 5.6 s after the last row of track 3: too late
    assert s.table[s.current[5]].enter == 7.6
    out = s.expired(7.5)
    assert sorted(x[1][:3] for x in out) == [(1.0, 2.0, "flower_2"), (2.0, 2.0, "flower_3")] and {w for w, _ in out} == {7.5}
    assert [x[1][0] for x in s.expired(float("inf"))] == [7.6] and not s.table and not s.current


def plain_landings(data):
    """The rules once more, with lists and one row at a time."""
    out = []
    for camera in sorted({r[0] for r in data}):
        flowers, sights, n_flowers, start = [], [], 0, None
        moments = sorted({r[1] for r in data if r[0] == camera})
        for ts in moments:
            start = start or ts
            t = round((ts - start).total_seconds(), 2)
            now = [r for r in data if r[0] == camera and r[1] == ts]
            flowers = [f for f in flowers if t - f["seen"] <= 1.5]
            pairs = []
            boxes = sorted(r[7:11] for r in now if r[3] == "flower")
            for i, b in enumerate(boxes):
                for f in flowers:
                    w, h = min(b[2], f["box"][2]) - max(b[0], f["box"][0]), min(b[3], f["box"][3]) - max(b[1], f["box"][1])
                    both = max(w, 0) * max(h, 0)
                    size = lambda x: max(1, (x[2] - x[0]) * (x[3] - x[1]))
                    pairs.append((-both / (size(b) + size(f["box"]) - both), i, f["id"]))
            used, owner = set(), {}
            for score, i, k in sorted(pairs):
                if -score >= 0.3 and i not in owner and k not in used:
                    owner[i] = k
                    used.add(k)
            for i, b in enumerate(boxes):
                if i in owner:
                    f = next(f for f in flowers if f["id"] == owner[i])
                    f["box"] = [0.85 * o + 0.15 * x for o, x in zip(f["box"], b)]
                    f["seen"], f["hits"] = t, f["hits"] + 1
                else:
                    n_flowers += 1
                    flowers.append({"id": n_flowers, "box": list(b), "seen": t, "hits": 1})
            for r in sorted((r for r in now if r[3] == "insect"), key=lambda r: (r[4], r[7:11])):
                x, y, area = (r[7] + r[9]) / 2, (r[8] + r[10]) / 2, max(1, (r[9] - r[7]) * (r[10] - r[8]))
                on = None
                for f in sorted(flowers, key=lambda f: f["id"]):
                    w, h = (f["box"][2] - f["box"][0]) * 0.15, (f["box"][3] - f["box"][1]) * 0.15
                    if t - f["seen"] <= 0.6 and f["hits"] >= 2 and f["box"][0] - w <= x <= f["box"][2] + w and f["box"][1] - h <= y <= f["box"][3] + h:
                        on = f"flower_{f['id']}"
                        break
                mine = [s for s in sights if s["track"] == r[4]]
                s = mine[-1] if mine else None
                if s is None or s["over"] or t - s["seen"] > 0.5:
                    new = {"track": r[4], "flower": None, "sums": {}, "over": False}
                    if s is not None and not s["over"] and s["flower"] is None:
                        if t - s["seen"] <= 5:
                            new["sums"] = s["sums"]
                        s["over"] = True
                    left = [z for z in sights if not z["over"] and z["flower"] and z["seen"] + 0.5 < t <= z["seen"] + (0.5 + 5.0)] if on else []
                    left = [z for z in left if ((z["x"] - x) ** 2 + (z["y"] - y) ** 2) ** 0.5 <= 4 * area**0.5]
                    if left:
                        z = min(left, key=lambda z: ((z["x"] - x) ** 2 + (z["y"] - y) ** 2) ** 0.5)
                        z["over"] = True
                        new |= {k: z[k] for k in ("flower", "enter", "last", "confs", "sums")}
                    sights.append(new)
                    s = new
                s |= {"seen": t, "x": x, "y": y}
                s["sums"][r[5]] = s["sums"].get(r[5], 0) + r[6]
                if on and not s["flower"]:
                    s |= {"flower": on, "enter": t, "last": t, "confs": [r[6]]}
                elif on:
                    s |= {"flower": on, "last": t, "confs": s["confs"] + [r[6]]}
                elif s["flower"] and t - s["last"] > 0.5:
                    out.append((camera, s["enter"], s["last"], s["flower"], max(s["sums"], key=s["sums"].get), round(sum(s["confs"]) / len(s["confs"]), 3)))
                    s["flower"] = None
        out += [(camera, s["enter"], s["last"], s["flower"], max(s["sums"], key=s["sums"].get), round(sum(s["confs"]) / len(s["confs"]), 3)) for s in sights if s["flower"] and not s["over"]]
    return sorted(out)


def test_replay_equals_a_plain_loop(spark):
    r = random.Random(5)
    data = []
    for camera in ("a", "b", "c"):
        places = [(r.uniform(50, 1200), r.uniform(50, 600)) for _ in range(8)]
        insects = {k: [r.choice(places)[0], r.choice(places)[1]] for k in range(6)}
        for k in range(500):
            ts = T0 + timedelta(milliseconds=100 * k)
            for x, y in places:
                if r.random() < 0.8:
                    x, y = x + r.uniform(-3, 3), y + r.uniform(-3, 3)
                    data.append((camera, ts, k, "flower", None, None, 0.9, x - 40, y - 40, x + 40, y + 40))
            for n, at in insects.items():
                if r.random() < 0.03:
                    at[:] = [v + r.uniform(-60, 60) for v in r.choice(places)]
                if r.random() < 0.9 and (k // 40 + n) % 5:
                    x, y = at[0] + r.uniform(-4, 4), at[1] + r.uniform(-4, 4)
                    data.append((camera, ts, k, "insect", n + 10 * (k // 90 % 3), r.choice(["bee", "bee", "fly"]), r.choice([0.25, 0.5, 0.625, 1.0]), x - 6, y - 6, x + 6, y + 6))
    assert len(data) > 10_000
    got = sorted((x.camera, x.t_enter_s, x.t_exit_s, x.flower_id, x.insect_type, x.conf_mean) for x in live.replayed(spark.createDataFrame(data, DETECTIONS)).collect())
    want = plain_landings(data)
    assert len(want) > 100 and got == want


def test_daily_counts_and_recents(spark, tmp_path):
    written(spark, str(tmp_path / "in"))
    landed = live.live_landings(detection_stream(spark, str(tmp_path / "in"), 10))
    live.append_to(landed, str(tmp_path / "land"), str(tmp_path / "cp0")).processAllAvailable()
    for q in spark.streams.active:
        q.stop()
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cpdir"))
    stream = lambda: spark.readStream.schema(live.LANDED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "land"))
    q = live.upsert_daily(live.daily_counts(stream()), str(tmp_path / "daily"), str(tmp_path / "cp1"))
    q.processAllAvailable()
    q.stop()
    total = spark.read.parquet(str(tmp_path / "land")).count()
    daily = live.daily_table(spark, str(tmp_path / "daily")).read()
    assert total > 0 and daily.groupBy().sum("n_landings").first()[0] == total
    q = live.upsert_daily(live.daily_counts(stream()), str(tmp_path / "daily"), str(tmp_path / "cp1"))
    q.processAllAvailable()
    q.stop()
    assert live.daily_table(spark, str(tmp_path / "daily")).read().groupBy().sum("n_landings").first()[0] == total
    q = live.keep_recent(stream(), str(tmp_path / "recent"), str(tmp_path / "cp2"), kept=2)
    q.processAllAvailable()
    q.stop()
    versions = [p for p in (tmp_path / "recent").iterdir() if p.name.startswith("v=")]
    last = max(versions, key=lambda p: int(p.name.split("=")[1]))
    assert spark.read.schema(live.LANDED).json(str(last)).count() == min(2, total) and len(versions) <= 2


def test_throughput(spark, tmp_path):
    written(spark, str(tmp_path / "in"), 2)
    q = live.throughput(detection_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("per_second").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.second: r.n for r in spark.table("per_second").collect()}
    assert got[T0] == 8 and len(got) >= 30
