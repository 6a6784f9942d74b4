"""Per-frame detections: sampling, gates, vetoes, duplicates within a frame, and what a track is.

Detections are rows (video, track_id, fi, t, cls, conf, x1, y1, x2, y2); flowers are rows (video, flower_id, ordinal,
x1, y1, x2, y2), with fi as well where they move.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meadow.functions import geometry as g
from meadow.params import LANDING, LandingParams

CELL = 128.0


def sampled(frames: DataFrame, in_fps: float, target_fps: float = 20.0) -> DataFrame:
    """Every stride-th raw frame, renumbered, with its media time (2 places)."""
    stride = max(1, int(in_fps / target_fps + 0.5))
    kept = frames.where(F.col("raw_fi") % stride == 0)
    fi = F.floor(F.col("raw_fi") / stride)
    return kept.withColumn("fi", fi).withColumn("t", F.round(fi * stride / float(in_fps), 2))


def refreshed(frames: DataFrame, every: int, *values: str) -> DataFrame:
    """Values measured on every n-th frame only, the last ones carried on in between."""
    back = Window.partitionBy("video", "track_id").orderBy("fi").rowsBetween(Window.unboundedPreceding, 0)
    return frames.select(*[c for c in frames.columns if c not in values], *[F.last(F.when(F.col("fi") % every == 0, F.col(v)), ignorenulls=True).over(back).alias(v) for v in values])


def speeds(dets: DataFrame) -> DataFrame:
    """Body lengths per second since the track's row before; 0 at its start and where no time has passed."""
    w = Window.partitionBy("video", "track_id").orderBy("fi")
    x, y = g.center(g.box())
    moved = dets.withColumn("cx", x).withColumn("cy", y)
    dt = F.col("t") - F.lag("t").over(w)
    d = g.distance(F.col("cx"), F.col("cy"), F.lag("cx").over(w), F.lag("cy").over(w))
    return moved.withColumn("speed", F.when(dt > 0, d / dt / F.sqrt(g.area(g.box()))).otherwise(0.0))


def plausible_insects(dets: DataFrame, p: LandingParams = LANDING) -> DataFrame:
    b = g.box()
    return dets.where((g.area(b) <= p.max_insect_frac * p.frame_w * p.frame_h) & (g.aspect(b) <= p.insect_aspect))


def plausible_flowers(flowers: DataFrame, p: LandingParams = LANDING, least: float | None = None, most: float | None = None) -> DataFrame:
    b, frame = g.box(), p.frame_w * p.frame_h
    low, high = p.min_box_frac if least is None else least, p.max_flower_frac if most is None else most
    return flowers.where(g.area(b).between(low * frame, high * frame) & (g.aspect(b) <= p.flower_aspect))


def not_oversized(dets: DataFrame, share: float = 0.85, p: LandingParams = LANDING) -> DataFrame:
    return dets.where(g.area(g.box()) <= share * p.frame_w * p.frame_h)


def _cells(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / CELL), F.floor(high / CELL)))


def in_cells(boxes: DataFrame, pad: float = 0.0) -> DataFrame:
    """Boxes once for each grid cell (gx, gy) that they touch, so that spatial joins are equi-joins."""
    b = g.padded(g.box(), pad)
    return boxes.withColumn("gx", _cells(b[0], b[2])).withColumn("gy", _cells(b[1], b[3]))


def on_flowers(dets: DataFrame, flowers: DataFrame, p: LandingParams = LANDING) -> DataFrame:
    """Detections with the flower whose padded box holds their centre: the first one in order of creation, or null.

    The join is on the video and a grid cell (and the frame where flowers have one); a centre lies in one cell only.
    """
    x, y = g.center(g.box())
    keys = ["video", "gx", "gy"] + ["fi"] * ("fi" in flowers.columns)
    placed = dets.withColumn("cx", x).withColumn("cy", y).withColumn("gx", F.floor(x / CELL)).withColumn("gy", F.floor(y / CELL))
    there = in_cells(flowers, p.touch_pad).select(*keys, F.col("flower_id").alias("f_id"), "ordinal", *[F.col(s).alias("f_" + s) for s in g.SIDES])
    hit = placed.select(*keys, "track_id", "cx", "cy", *[] if "fi" in keys else ["fi"]).join(there, keys).where(g.holds(g.box("f_"), F.col("cx"), F.col("cy"), p.touch_pad))
    first = hit.groupBy("video", "track_id", "fi").agg(F.min_by("f_id", "ordinal").alias("flower_id"))
    return dets.join(first, ["video", "track_id", "fi"], "left")


def vetoed(dets: DataFrame, others: DataFrame, least: float, p: LandingParams = LANDING) -> DataFrame:
    """Detections that no box of `others` in their video (and frame, where it has one) matches by IoU >= least."""
    keys = ["video", "gx", "gy"] + ["fi"] * ("fi" in others.columns)
    far = in_cells(others).select(*keys, *[F.col(s).alias("o_" + s) for s in g.SIDES])
    near = in_cells(dets.select("video", "track_id", "fi", *g.SIDES))
    hit = near.join(far, keys).where(g.iou(g.box(), g.box("o_")) >= least).select("video", "track_id", "fi").distinct()
    return dets.join(hit, ["video", "track_id", "fi"], "left_anti")


def _kept(boxes: Column, most_iou: float, most_nested: float | None) -> Column:
    """Greedy pass over boxes from best to worst."""

    def clash(a: Column, b: Column) -> Column:
        x, y = g.fields(a), g.fields(b)
        hit = g.iou(x, y) >= most_iou
        return hit if most_nested is None else hit | (g.nested(x, y) >= most_nested)

    start = F.slice(boxes, 1, 0)
    return F.aggregate(boxes, start, lambda acc, b: F.when(F.exists(acc, lambda k: clash(b, k)), acc).otherwise(F.array_append(acc, b)))


def without_overlaps(dets: DataFrame, most_iou: float = LANDING.nms_iou, most_nested: float | None = LANDING.nms_nested, by: str = "conf") -> DataFrame:
    """One frame's boxes, best first, without those that overlap or are nested in a better one; ties by track."""
    rest = [c for c in dets.columns if c not in ("video", "fi")]
    row = F.struct((-F.col(by)).alias("_o"), F.col("track_id").alias("_t"), *rest)
    frames = dets.groupBy("video", "fi").agg(F.sort_array(F.collect_list(row)).alias("boxes"))
    return frames.select("video", "fi", F.explode(_kept(F.col("boxes"), most_iou, most_nested)).alias("b")).select("video", "fi", *[F.col("b")[c].alias(c) for c in rest]).select(*dets.columns)


def long_enough(dets: DataFrame, least: int = LANDING.min_detections) -> DataFrame:
    """Tracks with at least so many detected frames."""
    n = dets.groupBy("video", "track_id").agg(F.count_distinct("fi").alias("n")).where(F.col("n") >= least)
    return dets.join(n.drop("n"), ["video", "track_id"], "left_semi")


def class_votes(dets: DataFrame) -> DataFrame:
    """video, track_id, cls: the class with most confidence; ties go to the class seen first."""
    sums = dets.groupBy("video", "track_id", "cls").agg(F.sum("conf").alias("votes"), F.min("fi").alias("seen"))
    return sums.groupBy("video", "track_id").agg(F.max_by("cls", F.struct(F.round("votes", 9), -F.col("seen"))).alias("cls"), F.sum("votes").alias("votes"))


def honeybee_votes(votes: DataFrame, types: DataFrame) -> DataFrame:
    """types(video, track_id, cls) with is_honeybee: the majority of votes(video, track_id, label) for bees, false for others, null unknown."""
    n = votes.groupBy("video", "track_id", "label").agg(F.count("*").alias("n"), F.min("fi").alias("seen"))
    top = n.groupBy("video", "track_id").agg(F.max_by("label", F.struct("n", -F.col("seen"))).alias("label"))
    bee = F.when(F.col("cls") == "bee", F.col("label") == "honeybee").otherwise(F.lit(False))
    out = types.join(top, ["video", "track_id"], "left").withColumn("is_honeybee", bee)
    return out.withColumn("cls", F.when(F.col("is_honeybee"), "honeybee").otherwise(F.col("cls"))).drop("label")


def predicted(crops: DataFrame, predict: Callable[[list[np.ndarray]], list[str]], empty: str = "", batch: int = 64) -> DataFrame:
    """crops(height, width, n_channels, data, ...) with `label`: what `predict` says of the pixels of each crop, (height, width, channels).

    `predict` is any function of a list of crops; it runs where the rows are, a bounded number at a time. A crop without
    pixels (null, or height or width under 1) is labelled `empty` and never reaches it.
    """
    rest = [c for c in crops.columns if c not in ("n_channels", "data", "label")]
    kinds = ", ".join(f"`{c}` {t}" for c, t in crops.dtypes if c in rest)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            there = (b["data"].notna() & (b["height"] > 0) & (b["width"] > 0)).to_numpy()
            labels = np.full(len(b), empty, object)
            at = np.flatnonzero(there)
            for k in range(0, len(at), batch):
                some = b.iloc[at[k : k + batch]]
                labels[at[k : k + batch]] = predict([np.frombuffer(r.data, np.uint8).reshape(int(r.height), int(r.width), int(r.n_channels)) for r in some.itertuples(index=False)])
            yield b[rest].assign(label=labels)

    return crops.select(*rest, "n_channels", "data").mapInPandas(work, f"{kinds}, label string")


def best_boxes(dets: DataFrame) -> DataFrame:
    """One row for each (video, track, frame): that of the highest confidence."""
    rest = [c for c in dets.columns if c not in ("video", "track_id", "fi")]
    top = dets.groupBy("video", "track_id", "fi").agg(F.max_by(F.struct(*rest), F.struct("conf", *[-F.col(s) for s in g.SIDES])).alias("b"))
    return top.select("video", "track_id", "fi", "b.*").select(*dets.columns)


def frame_counts(dets: DataFrame) -> DataFrame:
    return dets.groupBy("video", "fi", "cls").agg(F.count("*").alias("n"))
