"""Trackers whose next step depends on their last one.

What can be said without the order comes first, as joins. The rest of a video is brought together by a hash of it and
streamed in order; what is held is the tracker's own state. Each is checked against SQL and against a plain loop.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meadow.functions import geometry as g
from meadow.functions.shared import staged
from meadow.operators.nearest import nearest_within
from meadow.params import LANDING, LandingParams


def assigned(tracks: DataFrame, dets: DataFrame, least: float = 0.3) -> DataFrame:
    """One-to-one matches of tracks (video, fi, flower_id, box) and dets (video, fi, det, box): best IoU first.

    Candidates come from an equi-join on the frame; the greedy pass is a fold over one frame's pairs.
    """
    a = tracks.select("video", "fi", "flower_id", *[F.col(s).alias("a_" + s) for s in g.SIDES])
    b = dets.select("video", "fi", "det", *[F.col(s).alias("b_" + s) for s in g.SIDES])
    score = g.iou(g.box("a_"), g.box("b_"), 0.0)
    pairs = a.join(b, ["video", "fi"]).withColumn("iou", score).where(F.col("iou") >= least)
    row = F.struct((-F.col("iou")).alias("o"), "flower_id", "det", "iou")
    frames = pairs.groupBy("video", "fi").agg(F.sort_array(F.collect_list(row)).alias("pairs"))
    taken = lambda acc, x: F.exists(acc, lambda k: (k["flower_id"] == x["flower_id"]) | (k["det"] == x["det"]))
    kept = F.aggregate("pairs", F.slice("pairs", 1, 0), lambda acc, x: F.when(taken(acc, x), acc).otherwise(F.array_append(acc, x)))
    return frames.select("video", "fi", F.explode(kept).alias("m")).select("video", "fi", "m.flower_id", "m.det", "m.iou")


class InView:
    """The flowers of one video that are in view, as arrays: a number, a box and the last frame of each."""

    def __init__(self, p: LandingParams):
        self.p, self.made = p, 0
        self.number, self.box, self.last = np.empty(0, np.int64), np.empty((0, 4)), np.empty(0, np.int64)

    def seen(self, frame: int, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and boxes in view after a frame with these boxes (n x 4).

        All distances are taken at once. The pairs in reach, in the order of the boxes and then of their distance (ties:
        the newer flower), are gone through once, and a pair holds if both sides are still free.
        """
        middle, centers = (boxes[:, :2] + boxes[:, 2:]) / 2, (self.box[:, :2] + self.box[:, 2:]) / 2
        size = boxes[:, 2:] - boxes[:, :2]
        reach = self.p.merge_k * np.sqrt(np.maximum(1.0, size[:, 0] * size[:, 1]))
        far = np.sqrt((middle[:, :1] - centers[:, 0]) ** 2 + (middle[:, 1:] - centers[:, 1]) ** 2)
        b, f = np.nonzero(far <= reach[:, None])
        to, taken = [-1] * len(boxes), set()
        order = np.lexsort((-self.number[f], far[b, f], b))
        for i, j in zip(b[order].tolist(), f[order].tolist()):
            if to[i] < 0 and j not in taken:
                to[i] = j
                taken.add(j)
        to = np.array(to)
        again = to >= 0
        self.box[to[again]] = self.p.flower_ema * self.box[to[again]] + (1 - self.p.flower_ema) * boxes[again]
        self.last[to[again]] = frame
        new = np.arange(self.made + 1, self.made + 1 + int((~again).sum()))
        self.made += len(new)
        self.number, self.box, self.last = np.append(self.number, new), np.concatenate([self.box, boxes[~again]]), np.append(self.last, np.full(len(new), frame))
        stays = frame - self.last <= self.p.hold_s * max(1.0, self.p.fps)
        self.number, self.box, self.last = self.number[stays], self.box[stays], self.last[stays]
        return self.number, self.box.copy()


class MadeUp:
    """Places of one video where something landed and no flower is: the first one in reach, or a new one.

    Places are kept by cells of a grid, so a landing looks at what lies around it and not at all there ever was.
    """

    CELL = 64.0

    def __init__(self, p: LandingParams):
        self.p, self.n = p, 0
        self.cells: dict[tuple[int, int], list[tuple[int, float, float]]] = {}

    def number(self, x: float, y: float, area: float) -> int:
        reach = self.p.unknown_k * area**0.5
        i, j, r = int(x // self.CELL), int(y // self.CELL), int(reach // self.CELL) + 1
        around = (z for a in range(i - r, i + r + 1) for b in range(j - r, j + r + 1) for z in self.cells.get((a, b), ()))
        first = min((n for n, u, v in around if ((x - u) ** 2 + (y - v) ** 2) ** 0.5 <= reach), default=None)
        if first is None:
            self.n += 1
            first = self.n
            self.cells.setdefault((i, j), []).append((first, x, y))
        return first


def _streamed(rows: DataFrame, order: list[str], fold: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "video").sortWithinPartitions("video", *order).mapInPandas(fold, schema)


def _in_view(videos: np.ndarray, frames: np.ndarray, seen: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
    """One table of what is in view on many frames: (a row of the frame, numbers, boxes) each."""
    if seen:
        at = np.repeat([i for i, _, _ in seen], [len(n) for _, n, _ in seen])
        number, box = np.concatenate([n for _, n, _ in seen]), np.concatenate([x for _, _, x in seen])
        yield pd.DataFrame({"video": videos[at], "fi": frames[at], "flower_id": [f"flower_{n}" for n in number.tolist()], **dict(zip(g.SIDES, box.T))})


def canonical_flowers(boxes: DataFrame, p: LandingParams = LANDING) -> DataFrame:
    """boxes(video, fi, ordinal, x1..y2) to the flowers in view on each of these frames, with steady ids and boxes.

    A box takes the nearest flower in view that is in reach and not yet taken on this frame, or is a new one; flowers move by
    an exponential mean and vanish when they weren't seen for hold_s.
    """
    kind = boxes.schema["video"].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, state, held = None, InView(p), None
        for b in chain(batches, [None]):
            rows = held if b is None else b if held is None else pd.concat([held, b], ignore_index=True)
            if rows is None or not len(rows):
                continue
            videos, frames, sides = rows["video"].to_numpy(), rows["fi"].to_numpy(), rows[list(g.SIDES)].to_numpy(float)
            starts = np.flatnonzero(np.append(True, (videos[1:] != videos[:-1]) | (frames[1:] != frames[:-1])))
            held = None if b is None else rows.iloc[starts[-1]:]  # the last frame may go on in the next batch
            ends = np.append(starts[1:], len(rows))
            out = []
            for i, j in zip(starts.tolist(), ends.tolist()) if b is None else zip(starts[:-1].tolist(), ends[:-1].tolist()):
                if videos[i] != video:
                    video, state = videos[i], InView(p)
                number, box = state.seen(int(frames[i]), sides[i:j])
                out.append((i, number, box))
            yield from _in_view(videos, frames, out)

    cols = boxes.select("video", F.col("fi").cast("long").alias("fi"), "ordinal", *g.SIDES)
    return _streamed(cols, ["fi", "ordinal"], fold, f"video {kind}, fi long, flower_id string, x1 double, y1 double, x2 double, y2 double")


def attributed(landed: DataFrame, flowers: DataFrame, p: LandingParams = LANDING) -> DataFrame:
    """landed(video, seq, cx, cy, area) with the flower of each landing that no box holds. flowers(video, flower_id, ordinal, cx, cy).

    The nearest flower in reach comes from a join by growing rings of cells. Only landings without one are put in order and
    get a made-up flower: the first in reach, or a new one where they are.
    """
    kind = landed.schema["video"].dataType.simpleString()
    points = landed.select("video", F.col("seq").cast("long").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"), "area", (p.unknown_k * F.sqrt("area")).alias("reach"))
    places = flowers.select("video", F.col("flower_id").alias("name"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    near = staged(nearest_within(points, places).select("video", F.col("id").alias("seq"), "near", "x", "y", "area"), "attributed")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, state = None, MadeUp(p)
        for b in batches:
            names = []
            for v, x, y, area in zip(b["video"], b["x"], b["y"], b["area"]):
                if v != video:
                    video, state = v, MadeUp(p)
                names.append(f"flower_unk_{state.number(x, y, area)}")
            yield pd.DataFrame({"video": b["video"], "seq": b["seq"], "flower_id": names})

    made = _streamed(near.where("near IS NULL").drop("near"), ["seq"], fold, f"video {kind}, seq long, flower_id string")
    return near.where("near IS NOT NULL").select("video", "seq", F.col("near").alias("flower_id")).unionByName(made)
