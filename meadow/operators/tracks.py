"""Tracks that a detector has cut apart: which belong together, and their boxes on every frame."""

from __future__ import annotations

from math import ceil, log10

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meadow.functions import geometry as g
from meadow.functions.shared import staged
from meadow.operators.components import connected_components
from meadow.operators.detections import best_boxes
from meadow.params import LANDING, LandingParams


def spans(dets: DataFrame) -> DataFrame:
    """First and last frame of each track, where it was then, and its area at the end."""
    x, y = g.center(g.box())
    at = dets.withColumn("cx", x).withColumn("cy", y).withColumn("area", g.area(g.box()))
    first, last = (lambda c: F.min_by(c, "fi")), (lambda c: F.max_by(c, "fi"))
    return at.groupBy("video", "track_id").agg(
        F.min("fi").alias("f0"), F.max("fi").alias("f1"), first("cx").alias("x0"), first("cy").alias("y0"), last("cx").alias("x1"), last("cy").alias("y1"), last("area").alias("area1")
    )


def concurrent_edges(dets: DataFrame, p: LandingParams = LANDING, least_frames: int = 2) -> DataFrame:
    """video, a, b: tracks with `least_frames` frames in common whose mean IoU over these is high enough.

    An equi-join on (video, frame). Boxes that don't cross add nothing to a sum, so only those that do are shuffled by pair. That
    leaves few pairs whose sum could do, and for these the frames in common are counted.
    """
    side = lambda k: dets.select("video", "fi", F.col("track_id").alias(k), *[F.col(s).alias(f"{k}_{s}") for s in g.SIDES])
    both = side("a").join(side("b"), ["video", "fi"]).where("a < b").select("video", "a", "b", g.iou(g.box("a_"), g.box("b_")).alias("iou"))
    if p.concurrent_iou > 0:
        both = both.where("iou > 0")
    sums = both.groupBy("video", "a", "b").agg(F.sum("iou").alias("sum"), F.count("*").alias("hits"))
    may = staged(sums.where(F.col("sum") / F.col("hits") >= p.concurrent_iou).select("video", "a", "b", "sum"), "crossing")
    on = lambda k: may.join(dets.select("video", F.col("track_id").alias(k), "fi"), ["video", k]).groupBy("video", "a", "b", "fi").agg(F.count("*").alias(f"{k}_n"))
    shared = on("a").join(on("b"), ["video", "a", "b", "fi"]).groupBy("video", "a", "b").agg(F.sum(F.col("a_n") * F.col("b_n")).alias("frames"))
    pairs = may.join(shared, ["video", "a", "b"]).select("video", "a", "b", "frames", (F.col("sum") / F.col("frames")).alias("iou"))
    return pairs.where((F.col("frames") >= least_frames) & (F.col("iou") >= p.concurrent_iou))


def relink_pairs(ends: DataFrame, p: LandingParams = LANDING) -> DataFrame:
    """video, later, earlier, gap, l_f0, e_f0: each track with every earlier one that it may continue.

    The earlier track ended at most relink_s before, near by for the larger of the two sizes. Candidates meet by video and a
    bucket of frames as long as the longest gap, so the interval join is an equi-join on two buckets.
    """
    longest = int(p.relink_s * p.fps)
    bucket = lambda c: F.floor(F.col(c) / max(longest, 1))
    late = ends.select("video", F.col("track_id").alias("later"), F.col("f0").alias("l_f0"), F.col("x0").alias("lx"), F.col("y0").alias("ly"), F.col("area1").alias("la"), F.explode(F.array(bucket("f0"), bucket("f0") - 1)).alias("bucket"))
    early = ends.select("video", F.col("track_id").alias("earlier"), F.col("f0").alias("e_f0"), F.col("f1").alias("e_f1"), F.col("x1").alias("ex"), F.col("y1").alias("ey"), F.col("area1").alias("ea"), bucket("f1").alias("bucket"))
    gap = F.col("l_f0") - F.col("e_f1")
    near = g.distance(F.col("lx"), F.col("ly"), F.col("ex"), F.col("ey")) <= p.relink_k * F.sqrt(F.greatest("ea", "la"))
    pairs = late.join(early, ["video", "bucket"]).where((F.col("later") != F.col("earlier")) & gap.between(0, longest) & near)
    return pairs.select("video", "later", "earlier", gap.alias("gap"), "l_f0", "e_f0")


#: Of several earlier tracks: the smallest gap, then the one that began first.
BEST = ("gap", "e_f0", "earlier")


def relink_edges(ends: DataFrame, p: LandingParams = LANDING) -> DataFrame:
    """video, later, earlier, gap: each track with the earlier one it most likely continues."""
    best = F.min(F.struct(*BEST))
    return relink_pairs(ends, p).groupBy("video", "later").agg(best.alias("b")).select("video", "later", "b.earlier", "b.gap")


def _named(video: Column | str, n: Column | str) -> Column:
    """A node of the components: a track or group of a video."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.struct(col(video).cast("string").alias("v"), col(n).cast("long").alias("t"))


def _regrouped(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """groups(video, track_id, grp) after edges(video, a, b) between groups; a group has its smallest track's name."""
    parts = connected_components(edges.select(_named("video", "a").alias("a"), _named("video", "b").alias("b")))
    parts = parts.select(F.col("node").alias("n"), F.col("component.t").alias("into"))
    out = groups.withColumn("n", _named("video", "grp")).join(parts, "n", "left")
    return staged(out.select("video", "track_id", F.coalesce("into", "grp").alias("grp")), "groups")


def _hung(groups: DataFrame, up: DataFrame) -> DataFrame:
    """groups(video, track_id, grp) after every lg of up(video, lg, eg) has joined its eg, where an lg has one eg and no way leads
    back to it: all jump to where their eg goes until each has its root, in as many rounds as the longest way has binary digits."""
    while True:
        further = up.select("video", F.col("lg").alias("eg"), F.col("eg").alias("next"))
        jumped = staged(up.join(further, ["video", "eg"], "left").select("video", "lg", F.coalesce("next", "eg").alias("eg"), F.col("next").isNotNull().alias("moved")), "jumped")
        if jumped.where("moved").isEmpty():
            break
        up = jumped.drop("moved")
    roots = up.groupBy("video", "eg").agg(F.min("lg").alias("least")).select("video", "eg", F.least("least", "eg").alias("into"))
    parts = up.join(roots, ["video", "eg"]).select("video", F.col("lg").alias("grp"), "into").unionByName(roots.select("video", F.col("eg").alias("grp"), "into"))
    return staged(groups.join(parts, ["video", "grp"], "left").select("video", "track_id", F.coalesce("into", "grp").alias("grp")), "groups")


def continued(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """groups(video, track_id, grp) after each track, in the order of its first frame (then its id), has joined the group of the
    best of its pairs(video, later, earlier, gap, l_f0, e_f0) that is not of its own group by then.

    What a track finds depends on those before it only through its own group. So in each round all those tracks decide whose
    group no earlier undecided track could touch, by belonging to it or by a pair that leads into it. The first undecided track
    of a video is always one of them; a track that is alone in its group almost always is. Pairs inside a group are void.

    A group has one deciding track at most, and where it goes, the deciding track is an earlier one, as this pair touches that
    group too. So the ways of a round end in roots.
    """
    order = F.struct("l_f0", "later")
    pending = pairs
    while True:
        of = lambda track, name: groups.select("video", F.col("track_id").alias(track), F.col("grp").alias(name))
        live = pending.join(of("later", "lg"), ["video", "later"]).join(of("earlier", "eg"), ["video", "earlier"]).where("lg <> eg")
        live = staged(live.select("video", "later", "earlier", "gap", "l_f0", "e_f0", "lg", "eg"), "pending")
        if live.isEmpty():
            return groups
        best = live.groupBy("video", "later").agg(F.min(order).alias("o"), F.min(F.struct(*BEST, "lg", "eg")).alias("b"))
        best = staged(best.select("video", "later", "o", "b.lg", "b.eg"), "best")
        touching = best.select("video", F.col("lg").alias("grp"), "o").unionByName(live.select("video", F.col("eg").alias("grp"), order.alias("o")))
        first = touching.groupBy("video", "grp").agg(F.min("o").alias("first")).withColumnRenamed("grp", "lg")
        ready = staged(best.join(first, ["video", "lg"]).where(F.col("first") == F.col("o")).select("video", "later", "lg", "eg"), "ready")
        groups = _hung(groups, ready.drop("later"))
        pending = live.drop("lg", "eg").join(ready.select("video", "later"), ["video", "later"], "left_anti")


def unified(dets: DataFrame, p: LandingParams = LANDING) -> DataFrame:
    """dets with track_id replaced by the smallest one of the tracks it belongs with; one box for each frame.

    First tracks that run side by side are joined; then each track, in order, to the best earlier one that isn't of its group yet.
    """
    dets = staged(dets, "dets")
    ends = staged(spans(dets), "spans")
    alone = ends.select("video", F.col("track_id").cast("long").alias("track_id"), F.col("track_id").cast("long").alias("grp"))
    groups = continued(_regrouped(alone, concurrent_edges(dets, p)), relink_pairs(ends, p))
    joined = dets.withColumn("k", F.col("track_id").cast("long")).join(groups.select("video", F.col("track_id").alias("k"), "grp"), ["video", "k"], "left")
    kind = dets.schema["track_id"].dataType
    return best_boxes(joined.withColumn("track_id", F.coalesce("grp", "k").cast(kind)).select(*dets.columns))


def interpolated(dets: DataFrame) -> DataFrame:
    """A row for every frame from a track's first to its last: boxes in between lie on the line, and have no confidence."""
    w = Window.partitionBy("video", "track_id").orderBy("fi")
    nxt = dets.withColumn("to", F.coalesce(F.lead("fi").over(w), F.col("fi") + 1)).withColumns({f"to_{s}": F.coalesce(F.lead(s).over(w), F.col(s)) for s in g.SIDES})
    dense = nxt.withColumn("at", F.explode(F.sequence(F.col("fi"), F.col("to") - 1)))
    share = (F.col("at") - F.col("fi")) / (F.col("to") - F.col("fi"))
    moved = g.blended(g.box(), g.box("to_"), share)
    return dense.select("video", "track_id", F.col("at").alias("fi"), F.when(F.col("at") == F.col("fi"), F.col("conf")).alias("conf"), *[v.alias(s) for v, s in zip(moved, g.SIDES)])


def smoothed(rows: DataFrame, alpha: float = LANDING.insect_ema, columns: tuple[str, ...] = g.SIDES) -> DataFrame:
    """Exponential means alpha * before + (1 - alpha) * now along a track, as a scan of affine steps.

    A track is cut into blocks of so many rows that alpha**block is under 1e-17. Inside a block the mean that starts from
    nothing is a running sum of values scaled by alpha**-place; terms of one sign lose no digits by that. A row then adds
    what came out of the block before, faded by its place; what came out of earlier blocks has faded to nothing. All of it
    is windows in one order, linear in the rows for any alpha.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be 0 to 1")
    along = Window.partitionBy("video", "track_id").orderBy("fi")
    others = [c for c in rows.columns if c not in columns]
    if alpha in (0, 1):
        mean = lambda c: F.first(F.col(c).cast("double")).over(along.rowsBetween(Window.unboundedPreceding, 0)) if alpha else F.col(c).cast("double")
        return rows.select(*others, *[mean(c).alias(c) for c in columns]).select(*rows.columns)
    block = ceil(-17 / log10(alpha))
    numbered = rows.withColumn("_at", F.row_number().over(along) - 1).withColumn("_block", F.floor(F.col("_at") / block)).withColumn("_place", F.col("_at") % block)
    inside = Window.partitionBy("video", "track_id", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.when(F.col("_at") == 0, 1.0).otherwise(1 - alpha)
    fade = F.pow(F.lit(float(alpha)), F.col("_place"))
    own = numbered.withColumns({f"_{c}": fade * F.sum(F.col(c).cast("double") * weight / fade).over(inside) for c in columns})
    last = {f"_out_{c}": F.when(F.col("_place") == block - 1, F.col(f"_{c}")) for c in columns}
    came = {c: F.coalesce(F.last(f"_out_{c}", True).over(before), F.lit(0.0)) for c in columns}
    return own.withColumns(last).select(*others, *[(F.col(f"_{c}") + alpha * fade * came[c]).alias(c) for c in columns]).select(*rows.columns)


def held(seen: DataFrame, frames: DataFrame, hold: int) -> DataFrame:
    """Boxes of seen (video, flower_id, fi, ...) on every frame of frames (video, fi), carried on for up to `hold` frames.

    A box goes to the frames before the next one of its flower."""
    along = Window.partitionBy("video", "flower_id").orderBy("fi")
    most = F.col("fi") + hold
    to = F.greatest("fi", F.least(F.coalesce(F.lead("fi").over(along) - 1, most), most))
    carried = seen.where("flower_id IS NOT NULL").select("video", "flower_id", F.col("fi").alias("last"), to.alias("to"), *g.SIDES)
    on = carried.withColumn("fi", F.explode(F.sequence("last", "to")))
    # A frame is one narrow row, so the table of a task's frames is small; what is carried needn't be sorted.
    there = on.join(frames.select("video", "fi").distinct().hint("shuffle_hash"), ["video", "fi"])
    return there.select("video", "flower_id", "fi", *g.SIDES, (F.col("fi") - F.col("last")).alias("age"))
