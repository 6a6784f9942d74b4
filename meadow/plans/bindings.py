"""The driver's tables seen as detections, flowers, visits, images and reports; the same arithmetic in Spark and in SQL.

Every user is a track and every part a flower. They are dealt to a video for every 200 parts, so that videos grow in
number with the tables and not in how much they hold.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meadow.functions.shared import shared_dir

TYPES = {"click": "bee", "view": "fly", "purchase": "butterfly", "signup": "beetle"}

#: Common table expressions for the SQL of the queries.
SQL = {
    "detections": """
shows AS (SELECT greatest(1, count(*) // 200) AS videos FROM part),
e0 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
e1 AS (SELECT *, (user_id * 131) % 1100 + (floor(rn / 9.0)::BIGINT % 4) * 25 + (event_id * 7) % 11 AS cx, (user_id * 71) % 600 + (floor(rn / 15.0)::BIGINT % 3) * 20 + (event_id * 5) % 9 AS cy,
  10 + (event_id * 13) % 14 AS hw, 10 + (event_id * 17) % 14 AS hh FROM e0),
detections AS (SELECT user_id % videos AS video, user_id AS track_id, rn + floor(rn / 12.0)::BIGINT * (user_id % 7) AS fi, round((rn + floor(rn / 12.0)::BIGINT * (user_id % 7)) * 0.05::DOUBLE, 2) AS t,
  CASE event_type WHEN 'click' THEN 'bee' WHEN 'view' THEN 'fly' WHEN 'purchase' THEN 'butterfly' WHEN 'signup' THEN 'beetle' ELSE 'bug' END AS cls,
  0.2::DOUBLE + (event_id * 37 % 80) / 100.0::DOUBLE AS conf, (cx - hw)::DOUBLE AS x1, (cy - hh)::DOUBLE AS y1, (cx + hw)::DOUBLE AS x2, (cy + hh)::DOUBLE AS y2, ts, event_id FROM e1, shows)""",
    "flowers": """
f0 AS (SELECT p_partkey, (p_partkey * 137) % 1200 AS cx, (p_partkey * 89) % 680 AS cy, 15 + p_size % 20 AS h FROM part),
flowers AS (SELECT p_partkey % (SELECT greatest(1, count(*) // 200) FROM part) AS video, 'flower_' || p_partkey AS flower_id, p_partkey AS ordinal, (cx - h)::DOUBLE AS x1, (cy - h)::DOUBLE AS y1, (cx + h)::DOUBLE AS x2, (cy + h)::DOUBLE AS y2 FROM f0)""",
    "on_flowers": """
onf AS (SELECT d.video, d.track_id, d.fi, arg_min(f.flower_id, f.ordinal) AS flower_id FROM detections d JOIN flowers f ON f.video = d.video
  AND (d.x1 + d.x2) / 2 BETWEEN f.x1 - (f.x2 - f.x1) * 0.15 AND f.x2 + (f.x2 - f.x1) * 0.15 AND (d.y1 + d.y2) / 2 BETWEEN f.y1 - (f.y2 - f.y1) * 0.15 AND f.y2 + (f.y2 - f.y1) * 0.15 GROUP BY 1, 2, 3),
on_flowers AS (SELECT d.*, o.flower_id FROM detections d LEFT JOIN onf o ON o.video = d.video AND o.track_id = d.track_id AND o.fi = d.fi)""",
    "votes": """
v0 AS (SELECT video, track_id, cls, sum(conf) AS votes, min(fi) AS seen FROM detections GROUP BY 1, 2, 3),
types AS (SELECT video, track_id, cls FROM (SELECT *, row_number() OVER (PARTITION BY video, track_id ORDER BY round(votes, 9) DESC, seen) AS n FROM v0) WHERE n = 1)""",
    "landings": """
l0 AS (SELECT *, lag(flower_id IS NOT NULL) OVER w AS was_on, lag(t) OVER w AS was_t, last_value(CASE WHEN flower_id IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY video, track_id ORDER BY fi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_on
  FROM on_flowers WINDOW w AS (PARTITION BY video, track_id ORDER BY fi)),
l1 AS (SELECT *, sum(CASE WHEN flower_id IS NOT NULL AND (last_on IS NULL OR (NOT was_on AND was_t - last_on > 0.5)) THEN 1 ELSE 0 END) OVER (PARTITION BY video, track_id ORDER BY fi ROWS UNBOUNDED PRECEDING)::BIGINT AS episode FROM l0),
l2 AS (SELECT video, track_id, episode, arg_max(flower_id, fi) AS flower_id, round(min(t), 2) AS t_enter_s, round(max(t), 2) AS t_exit_s, max(fi) AS last_fi, round(avg(conf)::DECIMAL(18, 9), 3)::DOUBLE AS conf_mean, min(ts) AS ts FROM l1 WHERE flower_id IS NOT NULL GROUP BY 1, 2, 3),
l3 AS (SELECT *, round(t_exit_s - t_enter_s, 2) AS landing_s FROM l2),
landings AS (SELECT l.*, CASE WHEN landing_s >= 2 THEN 1 ELSE 0 END AS is_real_landing, c.cls AS insect_type,
  CASE c.cls WHEN 'honeybee' THEN 10.0 WHEN 'bee' THEN 1.0 WHEN 'butterfly' THEN 2.0 WHEN 'fly' THEN 0.5 WHEN 'beetle' THEN 0.5 WHEN 'bug' THEN 0.2 ELSE 0.3 END::DOUBLE AS pollination_weight
  FROM l3 l LEFT JOIN types c ON c.video = l.video AND c.track_id = l.track_id)""",
    "trial": """
trial AS (SELECT l_linestatus AS crop, l_quantity * (1 - l_discount) AS V, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, s_nationkey::VARCHAR AS orchard_id, year(l_shipdate)::VARCHAR AS year
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)""",
    "bins": """
edges AS (SELECT crop, list_distinct(quantile_cont(V, [i / 20.0 for i in range(21)])) AS edges FROM trial GROUP BY 1),
placed AS (SELECT t.crop, t.V, t.y, greatest(1, len([e for e in edges if e < t.V]))::BIGINT AS bin FROM trial t JOIN edges e ON e.crop = t.crop),
bins AS (SELECT crop, bin, avg(V) AS mean_v, avg(y) AS rate, sum(y)::DOUBLE AS hits, count(*)::BIGINT AS n FROM placed GROUP BY 1, 2)""",
    "files": """
files AS (SELECT lang || '/' || source || '/' || doc_id || '.jpg' AS path, lang AS cls, source AS folder, doc_id AS id, text AS content, n_chars AS bytes, md5(text) AS h FROM documents)""",
    "vec": """
vec AS (SELECT vec_id AS id, label AS cls, list_sum([(CASE WHEN embedding[i + 1] > 0 THEN 1 ELSE 0 END * (1 << i))::BIGINT for i in range(16)])::BIGINT AS hash FROM embeddings)""",
}


def sql(*names: str) -> str:
    return "WITH " + ",".join(SQL[n] for n in names) + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for what a query writes and reads back."""
    return f"{shared_dir(spark)}/meadow/{name}-{uuid.uuid4().hex}"


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: how many videos there are."""
    return F.broadcast(table(spark, sf_dir, "part").agg(F.greatest(F.lit(1), F.expr("count(*) div 200")).alias("videos")))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = e.withColumn("rn", rn.cast("long"))
    fl = lambda n: F.floor(F.col("rn") / n)
    fi = F.col("rn") + fl(12) * (F.col("user_id") % 7)
    cx = (F.col("user_id") * 131) % 1100 + (fl(9) % 4) * 25 + (F.col("event_id") * 7) % 11
    cy = (F.col("user_id") * 71) % 600 + (fl(15) % 3) * 20 + (F.col("event_id") * 5) % 9
    hw, hh = 10 + (F.col("event_id") * 13) % 14, 10 + (F.col("event_id") * 17) % 14
    cls = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for k in TYPES.items() for v in k]), F.col("event_type")), F.lit("bug"))
    d = lambda c, n: c.cast("double").alias(n)
    return e.crossJoin(_videos(spark, sf_dir)).select(
        (F.col("user_id") % F.col("videos")).alias("video"), F.col("user_id").alias("track_id"), fi.alias("fi"), F.round(fi * F.lit(0.05), 2).alias("t"), cls.alias("cls"),
        (F.lit(0.2) + (F.col("event_id") * 37 % 80) / F.lit(100.0)).alias("conf"), d(cx - hw, "x1"), d(cy - hh, "y1"), d(cx + hw, "x2"), d(cy + hh, "y2"), "ts", "event_id",
    )


def flowers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size").crossJoin(_videos(spark, sf_dir))
    cx, cy, h = (F.col("p_partkey") * 137) % 1200, (F.col("p_partkey") * 89) % 680, 15 + F.col("p_size") % 20
    d = lambda c, n: c.cast("double").alias(n)
    return p.select((F.col("p_partkey") % F.col("videos")).alias("video"), F.concat(F.lit("flower_"), F.col("p_partkey")).alias("flower_id"), F.col("p_partkey").alias("ordinal"), d(cx - h, "x1"), d(cy - h, "y1"), d(cx + h, "x2"), d(cy + h, "y2"))


def on_flowers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meadow.operators.detections import on_flowers as placed

    return placed(detections(spark, sf_dir), flowers(spark, sf_dir))


def landings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landings with the event time of their first row."""
    from meadow.operators import detections as det
    from meadow.operators import episodes

    votes = det.class_votes(detections(spark, sf_dir))
    return episodes.landings(on_flowers(spark, sf_dir), votes)


def trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_quantity", "l_discount", "l_returnflag", "l_suppkey", "l_shipdate")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = li.join(s, li["l_suppkey"] == s["s_suppkey"])
    return rows.select(
        F.col("l_linestatus").alias("crop"), (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("V"), (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.col("s_nationkey").cast("string").alias("orchard_id"), F.year("l_shipdate").cast("string").alias("year"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")))
    return d.select(path.alias("path"), F.col("lang").alias("cls"), F.col("source").alias("folder"), F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("n_chars").alias("bytes"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    bits = F.aggregate(F.transform(F.slice("embedding", 1, 16), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    return v.select(F.col("vec_id").alias("id"), F.col("label").alias("cls"), bits.alias("hash"))
