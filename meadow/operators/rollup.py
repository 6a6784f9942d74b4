"""Landings rolled up by flower, day and user, and the numbers of a dashboard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meadow.functions import geometry as g
from meadow.functions.rounding import half_up
from meadow.params import INSECT_TYPES, LANDING, POLLINATORS, POLLINATORS_LEGACY, LandingParams


def flower_summary(landings: DataFrame, flowers: DataFrame | None = None, p: LandingParams = LANDING) -> DataFrame:
    """One row per (video, flower): landings, real ones, real ones by type, their time and score.

    Flowers without landings keep a row of zeros. The mean is that of the total before it is rounded.
    """
    real = F.col("is_real_landing") == 1
    score = F.col("pollination_weight") * F.least("landing_s", F.lit(p.score_cap_s))
    total = F.sum(F.when(real, F.col("landing_s")).otherwise(0.0))
    out = landings.groupBy("video", "flower_id").agg(
        F.count("*").alias("n_landings"),
        F.count_if(real).alias("n_real_landings"),
        *[F.count_if(real & (F.col("insect_type") == t)).alias(f"n_{t}") for t in INSECT_TYPES],
        half_up(total, 2).alias("total_landing_s"),
        F.coalesce(half_up(F.try_divide(total, F.count_if(real)), 2), F.lit(0.0)).alias("mean_landing_s"),
        half_up(F.sum(F.when(real, score).otherwise(0.0)), 2).alias("pollination_score"),
    )
    if flowers is None:
        return out
    return flowers.select("video", "flower_id").distinct().unionByName(out.select("video", "flower_id")).distinct().join(out, ["video", "flower_id"], "left").fillna(0)


def headline_count(landings: DataFrame, seen: DataFrame, p: LandingParams = LANDING) -> DataFrame:
    """video, flowers: those seen for span_s, and those with a real landing; ones closer than a share of the diagonal count once.

    seen(video, flower_id, fi, ordinal, cx, cy). The greedy pass is a fold over one video's flowers, in order of creation.
    """
    life = seen.groupBy("video", "flower_id").agg((F.max("fi") - F.min("fi")).alias("span"), F.max(F.struct("fi", "cx", "cy")).alias("last"), F.min("ordinal").alias("ordinal"))
    life = life.select("video", "flower_id", "span", "last.cx", "last.cy", "ordinal")
    landed = landings.where("is_real_landing = 1").select("video", "flower_id").distinct().withColumn("landed", F.lit(True))
    real = life.join(landed, ["video", "flower_id"], "left").where((F.col("span") >= p.span_s * p.fps) | F.col("landed"))
    radius = p.cluster_frac * (p.frame_w**2 + p.frame_h**2) ** 0.5
    points = real.groupBy("video").agg(F.sort_array(F.collect_list(F.struct("ordinal", "flower_id", "cx", "cy"))).alias("points"))
    near = lambda a, b: g.distance(a["cx"], a["cy"], b["cx"], b["cy"]) < radius
    kept = F.aggregate("points", F.slice("points", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: near(k, x)), acc).otherwise(F.array_append(acc, x)))
    return points.select("video", F.size(kept).cast("long").alias("flowers"))


def merged(tables: list[DataFrame]) -> DataFrame:
    """All rows, with the union of the columns; what a table lacks is 0 (numbers) or empty (strings)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).fillna(0).fillna("")


def overview(visits: DataFrame, videos: DataFrame) -> DataFrame:
    """One row: done videos, visits, share of pollinators, mean visits per flower, and the flower with most (across videos)."""
    per = visits.groupBy("flower_id").agg(F.count("*").alias("n"), F.count_if(F.lower("insect_type").isin(*POLLINATORS)).alias("good"))
    facts = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("visits"),
        F.coalesce(F.round(F.try_divide(F.sum("good") * 100.0, F.sum("n")), 1), F.lit(0.0)).alias("pollinator_pct"),
        F.coalesce(half_up(F.avg("n"), 2), F.lit(0.0)).alias("mean_visits"),
        F.max_by("flower_id", F.struct("n", "flower_id")).alias("top_flower"),
    )
    return videos.where("status = 'done'").agg(F.count("*").alias("done_videos")).join(facts)


def visits_by_flower(visits: DataFrame, video=None, date_from=None, date_to=None, pollinator: bool | None = None) -> DataFrame:
    """Pollinators and others per flower (across videos), and a row of grand totals with a null flower. Filters are optional."""
    good = F.lower("insect_type").isin(*POLLINATORS)
    if video is not None:
        visits = visits.where(F.col("video") == video)
    if date_from is not None:
        visits = visits.where(F.col("ts") >= F.lit(date_from))
    if date_to is not None:
        visits = visits.where(F.col("ts") < F.lit(date_to))
    if pollinator is not None:
        visits = visits.where(good if pollinator else ~good)
    return visits.rollup("flower_id").agg(F.count_if(good).alias("pollinators"), F.count_if(~good).alias("others"), F.count("*").alias("total"))


def daily_series(visits: DataFrame, ts: str = "ts") -> DataFrame:
    return visits.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("visits"))


def daily_counts(landings: DataFrame, ts: str = "ts") -> DataFrame:
    """Per day, camera side and flower. Types count every landing here, unlike in flower_summary."""
    real = F.col("is_real_landing") == 1
    return landings.groupBy(F.to_date(ts).alias("day"), "camera_side", "flower_id").agg(
        F.count("*").alias("n_landings"), F.count_if(real).alias("n_real_landings"), *[F.count_if(F.col("insect_type") == t).alias(f"n_{t}") for t in INSECT_TYPES]
    )


def visit_table(visits: DataFrame, flowers: DataFrame, types: list[str]) -> DataFrame:
    """The older table: visits per flower, pollinators among them, and one column per type; flowers without visits stay."""
    by = visits.groupBy("video", "flower_id").pivot("insect_type", types).agg(F.sum("visits"))
    out = flowers.select("video", "flower_id").distinct().join(by, ["video", "flower_id"], "left").fillna(0)
    total = reduce(lambda a, b: a + b, [F.col(t) for t in types])
    good = reduce(lambda a, b: a + b, [F.col(t) for t in types if t in POLLINATORS_LEGACY], F.lit(0))
    return out.select("video", "flower_id", total.alias("total"), good.alias("pollinator"), (total - good).alias("non_pollinator"), *types)


def snapshot(landings: DataFrame, kept: int = 200, shown: int = 25) -> tuple[DataFrame, DataFrame]:
    """Totals over the newest `kept` landings, and the newest `shown` of them. `seq` orders them."""
    recent = landings.orderBy(F.desc("seq")).limit(kept)
    totals = recent.agg(F.count("*").alias("landings"), F.count_if(F.col("is_real_landing") == 1).alias("real"), F.count_if(F.col("insect_type") == "honeybee").alias("honeybees"), F.count_distinct("flower_id").alias("flowers"))
    return totals, recent.orderBy(F.desc("seq")).limit(shown)


def observed(landings: DataFrame) -> DataFrame:
    """Observation span of each video, and pollinators and others on each of its flowers."""
    good = F.col("insect_type").isin(*POLLINATORS)
    w = Window.partitionBy("video")
    per = landings.groupBy("video", "flower_id").agg(F.count_if(good).alias("pollinators"), F.count_if(~good).alias("others"), F.min("t_enter_s").alias("a"), F.max("t_exit_s").alias("z"))
    return per.select("video", "flower_id", "pollinators", "others", F.round(F.max("z").over(w) - F.min("a").over(w), 2).alias("span_s"))


def enriched(landings: DataFrame, cameras: DataFrame, weather: DataFrame) -> DataFrame:
    """Camera side by video, and the one row of weather; the one row is broadcast, Spark chooses about the cameras."""
    return landings.join(cameras, "video", "left").join(F.broadcast(weather.limit(1)))
