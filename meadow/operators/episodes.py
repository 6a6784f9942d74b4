"""Landings and other sequences within a track."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meadow.functions.rounding import half_up
from meadow.operators.curation import numbered
from meadow.params import LANDING, LandingParams


def landings(rows: DataFrame, types: DataFrame | None = None, p: LandingParams = LANDING) -> DataFrame:
    """Landing episodes of rows (video, track_id, fi, t, conf, flower_id or null).

    An episode closes on a row off every flower whose time is more than the grace after the last row on one. So a row on
    a flower opens an episode if there is none before it, or if the row just before it is off and that late. The distance
    between two rows on a flower doesn't matter. An episode belongs to the last flower touched; rows without a detection
    have confidence 0 (null). Times are rounded (half up) to 2 places, and "real" tests the rounded duration. Where rows
    have a wall-clock time `ts`, an episode has that of its first row on a flower.
    """
    w = Window.partitionBy("video", "track_id").orderBy("fi")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    on = F.col("flower_id").isNotNull()
    last_on = F.last(F.when(on, F.col("t")), ignorenulls=True).over(before)
    late = ~F.lag(on).over(w) & (F.lag("t").over(w) - last_on > p.grace_s)
    opens = on & (last_on.isNull() | late)
    marked = rows.withColumn("opens", opens.cast("int")).withColumn("episode", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.where(on).groupBy("video", "track_id", "episode").agg(
        F.max_by("flower_id", "fi").alias("flower_id"),
        F.round(F.min("t"), 2).alias("t_enter_s"),
        F.round(F.max("t"), 2).alias("t_exit_s"),
        F.max("fi").alias("last_fi"),
        half_up(F.avg(F.coalesce("conf", F.lit(0.0))), 3).alias("conf_mean"),
        *([F.min("ts").alias("ts")] if "ts" in rows.columns else []),
    )
    out = out.withColumn("landing_s", F.round(F.col("t_exit_s") - F.col("t_enter_s"), 2)).withColumn("is_real_landing", (F.col("landing_s") >= p.real_s).cast("int"))
    out = out.withColumn("flower_detected", F.lit("detected"))
    if types is None:
        return out
    named = out.join(types.select("video", "track_id", F.col("cls").alias("insect_type")), ["video", "track_id"], "left")
    return named.withColumn("pollination_weight", weight(F.col("insect_type"), p.weights, p.default_weight))


def weight(kind, weights: dict, default: float):
    """Weight of an insect type, `default` for those without one."""
    table = F.create_map(*[F.lit(v) for k in weights.items() for v in k])
    return F.coalesce(F.try_element_at(table, kind), F.lit(default))


def entered_visits(rows: DataFrame, debounce: int = 20) -> DataFrame:
    """Visits on entering a flower: the track's flower differs from its row before, and its last counted visit to that
    flower is over `debounce` frames ago. Counting depends on what was counted, so a fold runs over the entries of a
    (track, flower), never over the whole track."""
    w = Window.partitionBy("video", "track_id").orderBy("fi")
    into = rows.withColumn("was", F.lag("flower_id").over(w)).where("flower_id IS NOT NULL AND (was IS NULL OR was <> flower_id)")
    entries = into.groupBy("video", "track_id", "flower_id").agg(F.sort_array(F.collect_list("fi")).alias("entries"))
    start = F.struct(F.lit(-(10**9)).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda a, f: F.when(f - a["last"] > debounce, F.struct(f.cast("long").alias("last"), (a["n"] + 1).alias("n"))).otherwise(a)
    return entries.select("video", "track_id", "flower_id", F.aggregate("entries", start, step)["n"].alias("visits"))


def steady_labels(votes: DataFrame, factor: float = 1.5) -> DataFrame:
    """The label shown at each frame of votes (video, track_id, fi, cls, conf): it changes only to one whose summed
    confidence reaches `factor` times that of the label shown. Tracks are streamed in frame order; what is held is one sum
    for each label."""
    kinds = {c: votes.schema[c].dataType.simpleString() for c in ("video", "track_id")}

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        track, shown, sums = None, None, {}
        for b in batches:
            out = []
            for video, t, cls, conf in zip(b["video"], b["track_id"], b["cls"], b["conf"]):
                if (video, t) != track:
                    track, shown, sums = (video, t), None, {}
                sums[cls] = sums.get(cls, 0.0) + conf
                if shown is None or cls != shown and sums[cls] >= factor * sums[shown]:
                    shown = cls
                out.append(shown)
            yield b[["video", "track_id", "fi"]].assign(cls=out)

    n = int(votes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = votes.select("video", "track_id", F.col("fi").cast("bigint").alias("fi"), "cls", F.col("conf").cast("double").alias("conf"))
    ordered = rows.repartition(n, "video", "track_id").sortWithinPartitions("video", "track_id", "fi", "cls", "conf")
    return ordered.mapInPandas(fold, f"video {kinds['video']}, track_id {kinds['track_id']}, fi bigint, cls string")


def running_counts(landed: DataFrame) -> DataFrame:
    """How many real landings each flower has had when one of them ends."""
    w = Window.partitionBy("video", "flower_id").orderBy("last_fi", "track_id", "episode").rowsBetween(Window.unboundedPreceding, 0)
    return landed.where("is_real_landing = 1").withColumn("so_far", F.count("*").over(w))


def first_seen_ids(rows: DataFrame, key: str, order: str) -> DataFrame:
    """key, id: keys numbered from 1 by where they first appear. Numbers the distinct keys only."""
    seen = rows.groupBy(key).agg(F.min(order).alias("seen"))
    return numbered(seen, "seen", key, into="id").select(key, F.col("id").cast("int").alias("id"))


def per_second(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows per second of event time."""
    return rows.groupBy(F.window(ts, "1 second").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("second"), "n")
