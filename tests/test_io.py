"""Readers and writers, on small files."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meadow.operators import curation, curve, dose, images
from meadow.operators import detections as det
from meadow.sources import readers, sinks


def write(path, text):
    path.write_text(text)
    return str(path)


def test_visits_of_both_layouts(spark, tmp_path):
    real = write(tmp_path / "l.csv", "video,flower_id,insect_type,landing_s,pollination_weight,conf_mean\nv,flower_1,bee,3.5,1.0,0.5\n")
    got = readers.visits(spark, real).first()
    assert (got.flower_id, got.dwell_seconds, got.velocity) == ("v::flower_1", 3.5, None)
    plain = write(tmp_path / "v.csv", "flower_id,dwell_seconds,velocity\nf,2.5,\n")
    got = readers.visits(spark, plain).first()
    assert (got.flower_id, got.dwell_seconds, got.weight) == ("f", 2.5, 1.0)
    with pytest.raises(ValueError):
        readers.visits(spark, write(tmp_path / "x.csv", "a,b\n1,2\n"))


def test_per_video_skips_merged(spark, tmp_path):
    head = readers.LANDINGS.replace(" string", "").replace(" int", "").replace(" double", "").replace(" boolean", "").replace(" timestamp", "").replace(" ", "")
    for n in ("a.csv", "ALL_x.csv"):
        write(tmp_path / n, head + "\nv,f,,1,bee,,0.0,1.0,1.0,0,detected,,1.0,0.5\n")
    got = readers.per_video(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0].is_honeybee is None


def test_coco(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.jpg", "width": 10, "height": 5}], "annotations": [{"id": 7, "image_id": 1, "category_id": 2, "bbox": [0, 0, 1, 1]}], "categories": [{"id": 2, "name": "bee"}]}
    i, a, c = readers.coco(spark, write(tmp_path / "d.json", json.dumps(doc, indent=1)))
    assert (i.first().file_name, a.first().category_id, c.first().name) == ("a.jpg", 2, "bee")


def test_small_documents(spark, tmp_path):
    assert readers.facts(spark, write(tmp_path / "f.json", json.dumps({"video": "v", "visits": 3}))).first().report_version == "1.0"
    assert readers.weather(spark, write(tmp_path / "w.json", json.dumps({"temp_c": 21.5}))).first().wind_ms is None
    got = readers.camera_sources(spark, write(tmp_path / "c.txt", "# no\nleft=rtsp://a=b\n\n0\n")).orderBy("n").collect()
    assert [(r.side, r.source) for r in got] == [("left", "rtsp://a=b"), ("cam1", "0")]
    curves = readers.saved_curves(spark, write(tmp_path / "k.json", json.dumps({"fig": {"F0": 0.1, "Fmax": 0.5, "k": 1.0}})))
    assert curves.first().crop == "fig" and curves.first().Fmax == 0.5
    log = readers.training_metrics(spark, write(tmp_path / "m.csv", "  epoch,   map\n 1, 0.5\n 2, 0.7\n 3, 0.6\n"))
    assert readers.best_epoch(log, "map").first().epoch == 2.0
    field = readers.field_table(spark, write(tmp_path / "t.csv", "a,b\n1,2\nx,3\n-1,2\n"), ["a", "b"])
    assert [(r.a, r.b) for r in field.collect()] == [(1.0, 2.0)]
    table = readers.tab_separated(spark, write(tmp_path / "t.tsv", "a\tb\n1\t2\n"), "a int, b int")
    assert table.first().b == 2


def test_first_usable(spark, tmp_path):
    empty, full = write(tmp_path / "e.csv", "a\n"), write(tmp_path / "f.csv", "a\n1\n")
    reads = [lambda p=p: readers.csv(spark, p, "a int") for p in (str(tmp_path / "none.csv"), empty, full)]
    assert readers.first_usable(reads).first().a == 1
    with pytest.raises(FileNotFoundError):
        readers.first_usable(reads[:2])


def test_sinks(spark, tmp_path):
    at = str(tmp_path / "v")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "video string, n int")
    sinks.by_video(df, at)
    sinks.by_video(spark.createDataFrame([("b", 3)], df.schema), at)
    assert sorted((r.video, r.n) for r in spark.read.schema("n int, video string").option("header", True).csv(at).collect()) == [("a", 1), ("b", 3)]
    rows = spark.createDataFrame([("p", "c", 0, "train")], "path string, cls string, class_id int, split string")
    assert sinks.manifest(rows, rows.limit(0), str(tmp_path / "m")) is False
    assert sinks.manifest(rows, rows, str(tmp_path / "m")) is True
    sinks.class_index(rows, str(tmp_path / "c"))
    assert spark.read.schema("class_to_id map<string,int>").json(str(tmp_path / "c")).first().class_to_id == {"c": 0}
    sinks.split_lists(rows, str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).first().value == "p"
    sinks.yolo_labels(spark.createDataFrame([("train", "i", 1, 0.5, 0.5, 0.1, 0.1)], "split string, image string, cls int, x double, y double, w double, h double"), str(tmp_path / "y"))
    assert spark.read.text(str(tmp_path / "y")).first().value == "1 0.500000 0.500000 0.100000 0.100000"
    sinks.annotations(rows, str(tmp_path / "a"), "path")
    sinks.merge_tables([df, spark.createDataFrame([("c", 1.5)], "video string, x double")], str(tmp_path / "all"))
    assert spark.read.option("header", True).csv(str(tmp_path / "all")).count() == 3
    with pytest.raises(PermissionError):
        sinks.report(df, "/x/y", ("/x/y/",))
    sinks.report(df, str(tmp_path / "r"))


def png(path, pixels):
    h, w, _ = pixels.shape
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    d = tmp_path / "bee"
    d.mkdir()
    rng = np.random.default_rng(1)
    png(d / "noise.png", rng.integers(0, 255, (40, 60, 3)).astype(np.uint8))
    png(d / "blank.png", np.full((20, 20, 3), 7, np.uint8))
    (d / "bad.png").write_bytes(b"no image")
    (d / "x.txt").write_text("no")
    assert {r.cls for r in readers.image_files(spark, str(tmp_path)).collect()} == {"bee"} and readers.image_files(spark, str(tmp_path)).count() == 3
    rows = images.images(spark, str(tmp_path)).where("path LIKE '%.png'")
    assert [r.path.rsplit("/", 1)[1] for r in images.corrupt(rows).collect()] == ["bad.png"]
    stats = {r.path.rsplit("/", 1)[1]: r for r in images.statistics(rows).collect()}
    assert set(stats) == {"noise.png", "blank.png"}
    assert stats["blank.png"].blank and stats["blank.png"].grayscale and abs(stats["blank.png"].brightness - 7) < 1e-9
    assert stats["noise.png"].width == 60 and stats["noise.png"].blur > 100 and not stats["noise.png"].blank
    flags = images.quality_flags(images.statistics(rows)).first()
    assert (flags.n, flags.blank, flags.dark) == (2, 1, 1)
    cache = spark.createDataFrame([(stats["noise.png"].path, 5)], "path string, hash long")
    got = {r.path.rsplit("/", 1)[1]: r.hash for r in images.hashed(rows, cache).collect()}
    assert got["noise.png"] == 5 and "blank.png" in got


def plain_hash(g):
    """Resize, transform and bits by loops over single values."""
    import math

    def window(x):
        return 1.0 if x == 0 else 3 * math.sin(math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x) ** 2 if abs(x) < 3 else 0.0

    def line(v, n):
        out = []
        for i in range(n):
            scale = len(v) / n
            wide, c = max(scale, 1), (i + 0.5) * scale
            at = range(max(0, int(c - 3 * wide + 0.5)), min(len(v), int(c + 3 * wide + 0.5)))
            w = [window((k + 0.5 - c) / wide) for k in at]
            out.append(min(255, max(0, math.floor(sum(a * v[k] for a, k in zip(w, at)) / sum(w) + 0.5))))
        return out

    rows = [line(r, 32) for r in g]
    small = list(zip(*[line(c, 32) for c in zip(*rows)]))
    low = [sum(small[y][x] * math.cos(math.pi * u * (2 * y + 1) / 64) * math.cos(math.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    middle = (sorted(low)[31] + sorted(low)[32]) / 2
    return int("".join("1" if z > middle else "0" for z in low), 2)


@pytest.mark.parametrize("shape", [(32, 32), (60, 47), (200, 90), (20, 24)])
def test_perceptual_hash(shape):
    rng = np.random.default_rng(shape[0])
    y, x = np.mgrid[: shape[0], : shape[1]]
    g = np.clip(128 + 90 * np.sin(x / 9.0) * np.cos(y / 13.0) + rng.normal(0, 12, shape), 0, 255).round()
    assert images.perceptual_hash(g) % (1 << 64) == plain_hash(g.tolist())
    assert bin((images.perceptual_hash(g) ^ images.perceptual_hash(np.clip(g + 3, 0, 255))) % (1 << 64)).count("1") <= 4


def test_predicted_crops(spark):
    rows = [("a", 2, 2, 1, bytes([9, 9, 9, 9])), ("b", 0, 0, 1, b""), ("c", None, None, None, None)] + [(f"d{k}", 1, 1, 3, bytes([200, 200, 200])) for k in range(150)]
    crops = spark.createDataFrame(rows, "path string, height int, width int, n_channels int, data binary").withColumn("label", F.lit("mine"))
    got = {r.path: r.label for r in det.predicted(crops, lambda c: [f"{p.shape[2]}:{int(p.mean())}" for p in c], empty="none").collect()}
    assert got["a"] == "1:9" and got["b"] == got["c"] == "none" and {got[f"d{k}"] for k in range(150)} == {"3:200"}


def test_gates_with_nulls(spark):
    rows = [("a", "bee", 3.0, 0.01, None, 1.0, 1.0), ("b", "bee", 3.0, None, None, 1.0, 1.0), ("c", "bee", 1.0, 0.01, None, 1.0, 1.0)]
    table = spark.createDataFrame(rows, dose.VISITS)
    marked = dose.qualifying(table)
    assert dose.applied_gates(table) == ["dwell_seconds", "velocity"] and marked.columns == [*table.columns, "qualifies"]
    assert {r.flower_id: r.qualifies for r in marked.collect()} == {"a": True, "b": False, "c": False}


def test_renaming_passes_over_taken_names(spark):
    names = ["a.jpg", "a.jpg", "A.jpg", "a_1.jpg", "a_3.jpg", "a_3.jpg", "b", "b", "b_2"]
    rows = spark.createDataFrame([(i, "train", n) for i, n in enumerate(names)], "id int, split string, name string")
    got = [r.new_name for r in curation.renamed(rows, "split", "name", "id").orderBy("id").collect()]
    assert got == ["a.jpg", "a_2.jpg", "A_4.jpg", "a_1.jpg", "a_3.jpg", "a_3_1.jpg", "b", "b_1", "b_2"]


def test_bootstrap_covers_the_truth(spark):
    """Intervals of resampled flowers hold the curve that made the labels, with new bins and without."""
    rng = np.random.default_rng(3)
    v = rng.uniform(0, 40, 6000)
    y = (rng.random(6000) < 0.2 + 0.5 * (1 - np.exp(-0.15 * v))).astype(int)
    rows = spark.createDataFrame([("c", float(a), int(b)) for a, b in zip(v, y)], "crop string, V double, y int")
    new = curve.intervals(curve.bootstrap(dose.binned(rows, bins=200), draws=200, rebin=20)).first()
    old = curve.intervals(curve.bootstrap(dose.binned(rows), draws=200)).first()
    for x in (new, old):
        assert x.F0_lo <= 0.2 <= x.F0_hi and x.Fmax_lo <= 0.7 <= x.Fmax_hi and x.k_lo <= 0.15 <= x.k_hi
        assert 0.01 < x.Fmax_hi - x.Fmax_lo < 0.1


def test_pools_and_label_modes(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, u string"), spark.createDataFrame([(2,)], "id int")
    assert sorted((r.split, r.id, r.u) for r in curation.pool({"p": a, "q": b}).collect()) == [("p", 1, "x"), ("q", 2, None)]
    with pytest.raises(ValueError):
        curation.pool({})
    with pytest.raises(ValueError):
        curation.labels(a, "nope")


@pytest.mark.parametrize("kind", ["orchards", "years"])
def test_mixed_model_finds_the_slope(spark, kind):
    """Known slope and group shifts, with either grouping the larger one."""
    from meadow.operators import mixed

    rng = np.random.default_rng(5)
    many, few = rng.normal(0, 0.6, 40), rng.normal(0, 0.4, 5)
    rows = []
    for _ in range(8000):
        i, j, z = rng.integers(40), rng.integers(5), rng.normal()
        p = 1 / (1 + np.exp(-(0.3 + 0.8 * z + many[i] + few[j])))
        g = (str(i), str(j)) if kind == "orchards" else (str(j), str(i))
        rows.append((float(z), *g, int(rng.random() < p)))
    got = mixed.fit_mixed(spark.createDataFrame(rows, "V double, orchard_id string, year string, y int"))
    large = got["var"][0 if kind == "orchards" else 1]
    assert abs(got["slope"] - 0.8) < 4 * got["slope_se"] + 0.03 and 0.15 < large < 0.8 and got["slope_se"] < 0.05


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_pictures_go_to_files_and_back(spark, tmp_path, channels):
    rng = np.random.default_rng(channels)
    rows = [(f"a/p{k}.png", 5 + k, 3, channels, rng.integers(0, 256, (5 + k) * 3 * channels).astype(np.uint8).tobytes()) for k in range(4)] + [("b/broken.png", -1, -1, -1, b"\x89PNG nothing"), ("b/empty.png", None, None, None, None)]
    table = spark.createDataFrame(rows, "path string, height int, width int, n_channels int, data binary")
    for _ in range(2):  # again, as a task may be
        assert sinks.pictures(table, str(tmp_path / "x")).count() == 6
    assert sorted(p.name for p in (tmp_path / "x").rglob("*") if p.is_file()) == ["broken.png", "empty.png", "p0.png", "p1.png", "p2.png", "p3.png"]
    got = {r.path.rpartition("/")[2]: (r.height, r.width, r.n_channels, bytes(r.data)) for r in images.images(spark, str(tmp_path / "x")).where("height > 0").collect()}
    assert got == {p.rpartition("/")[2]: (h, w, c, d) for p, h, w, c, d in rows[:4]}
    assert {r.path.rpartition("/")[2] for r in images.corrupt(images.images(spark, str(tmp_path / "x"))).collect()} == {"broken.png", "empty.png"}


@pytest.mark.parametrize("turned", [False, True])
def test_mixed_model_is_the_dense_one(spark, turned):
    """The elimination by groups against the whole system solved at once, on pairs of groups that don't all occur."""
    from meadow.operators import mixed

    rng = np.random.default_rng(6)
    g, h, z = rng.integers(0, 60, 3000), rng.integers(0, 4, 3000), rng.normal(2, 3, 3000)
    h = np.where(g < 20, 0, h)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(0.2 * z + rng.normal(0, 0.5, 60)[g])))).astype(int)
    rows = [(float(a), *((str(j), str(i)) if turned else (str(i), str(j))), int(b)) for a, i, j, b in zip(z, g, h, y)]
    got = mixed.fit_mixed(spark.createDataFrame(rows, "V double, orchard_id string, year string, y int"), steps=4)
    x = np.concatenate([np.ones((3000, 1)), ((z - z.mean()) / z.std())[:, None], np.eye(60)[g], np.eye(4)[h]], axis=1)
    beta, var = np.zeros(66), np.ones(2)
    for _ in range(4):
        eta = x @ beta
        mu = 1 / (1 + np.exp(-eta))
        w = np.maximum(mu * (1 - mu), 1e-6)
        penalty = np.concatenate([[0, 0], np.full(60, 1 / var[0]), np.full(4, 1 / var[1])])
        inverse = np.linalg.inv((x * w[:, None]).T @ x + np.diag(penalty))
        beta = inverse @ (x.T @ (w * eta + y - mu))
        spread = np.diag(inverse)
        var = np.array([(beta[2:62] @ beta[2:62] + spread[2:62].sum()) / 60, (beta[62:] @ beta[62:] + spread[62:].sum()) / 4])
    assert np.allclose([got["intercept"], got["slope"], got["slope_se"]], [beta[0], beta[1], spread[1] ** 0.5], rtol=1e-6)
    assert np.allclose(got["var"], var[::-1] if turned else var, rtol=1e-6)
