"""Nearest place within reach, as equi-joins on grid cells."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meadow.functions import geometry as g
from meadow.functions.shared import staged


def _cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) / size)


def nearest_within(points: DataFrame, places: DataFrame, by: str = "video", start: float = 8.0) -> DataFrame:
    """points(by, id, x, y, reach) with near, the name of the place(by, name, x, y) at the least distance up to `reach`, and its
    distance; ties go to the smaller name, points without a place in reach have nulls.

    Rings grow: first all points look into the cells around them that are `start` wide, and only those that found nothing
    and may reach farther go on to cells of twice the size. What is found within a ring is the nearest there is. A
    point meets what lies in its own surroundings, so a busy `by` is spread over as many tasks as it has cells, and a
    crowded place is met by those that are near it only.
    """
    names = ["id", "x", "y", "reach"]
    open_ = points.select(by, *names).where("reach IS NOT NULL")
    most = points.agg(F.max("reach")).first()[0]
    rings = 0 if most is None or most < 0 else 1 + max(0, ceil(log2(most / start))) if most > 0 else 1
    there = places.select(by, "name", F.col("x").alias("px"), F.col("y").alias("py"))
    done = None
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    for k in range(rings):
        size = start * 2**k
        cells = there.withColumn("o", F.explode(around)).withColumn("cx", _cell("px", size) + F.col("o.i")).withColumn("cy", _cell("py", size) + F.col("o.j")).drop("o")
        met = open_.withColumn("cx", _cell("x", size)).withColumn("cy", _cell("y", size)).join(cells, [by, "cx", "cy"])
        far = g.distance(F.col("x"), F.col("y"), F.col("px"), F.col("py"))
        near = met.withColumn("far", far).where(F.col("far") <= F.least("reach", F.lit(size))).groupBy(by, "id").agg(F.min(F.struct("far", F.col("name").alias("near"))).alias("b"))
        found = staged(near.select(by, "id", "b.near", "b.far"), "near")
        done = found if done is None else done.unionByName(found)
        if k < rings - 1:
            open_ = staged(open_.where(F.col("reach") > size).join(found.select(by, "id"), [by, "id"], "left_anti"), "far")
    if done is None:
        return points.withColumn("near", F.lit(None).cast(places.schema["name"].dataType)).withColumn("far", F.lit(None).cast("double"))
    return points.join(done, [by, "id"], "left")
