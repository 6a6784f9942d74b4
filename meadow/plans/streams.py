"""The streaming operators over bounded tables: the same code runs as a stream in the tests."""

from __future__ import annotations

import json
import uuid
from dataclasses import replace

from pyarrow import fs as files
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meadow.functions import geometry as g
from meadow.functions.shared import staged
from meadow.params import LANDING
from meadow.plans import bindings as b
from meadow.plans.landing import LANDED
from meadow.sources import readers
from meadow.streaming import live

QUERIES, ORACLE = {}, {}
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def camera_rows(spark, d) -> DataFrame:
    """Detections as a camera sees them: insects on their frames, the video's flowers on every fifth frame."""
    rows = b.detections(spark, d)
    ts = lambda c: F.timestamp_micros((c * 50_000).cast("long")).alias("ts")
    insects = rows.select(F.col("video").cast("string").alias("camera"), ts(F.col("fi")), "fi", F.lit("insect").alias("kind"), "track_id", "cls", "conf", *g.SIDES)
    frames = rows.where("fi % 5 = 0").select("video", "fi").distinct()
    none = F.lit(None)
    there = frames.join(b.flowers(spark, d), "video").select(F.col("video").cast("string").alias("camera"), ts(F.col("fi")), "fi", F.lit("flower").alias("kind"), none.cast("long").alias("track_id"), none.cast("string").alias("cls"), F.lit(0.9).alias("conf"), *g.SIDES)
    return insects.unionByName(there)


def st1_st2_st3_j9_replayed(spark, d):
    return live.replayed(camera_rows(spark, d))


def _finished(query) -> None:
    """Let a stream work off what is there, then end it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def _landed_stream(spark, d) -> DataFrame:
    """Landings as a file stream in the layout of the live ones."""
    at = b.folder(spark, "landed")
    rows = b.landings(spark, d).withColumn("camera", F.col("video").cast("string")).withColumn("seq", F.col("track_id") * 10_000 + F.col("episode"))
    none = F.lit(None).cast("boolean")
    rows.withColumn("is_pollinator", none).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in live.LANDED.split(", ")]).write.parquet(at)
    return spark.readStream.schema(live.LANDED).parquet(at)


#: No centre lies on a padded edge.
OFF_EDGES = replace(LANDING, touch_pad=0.1503)
#: Rules under which a stream and the batch landings are the same: nothing is taken up, and no centre lies on a padded edge.
PLAIN = replace(LANDING, relink_s=0.0, touch_pad=0.1503)


def _still_flowers(spark, d, every: int = 5, slower: int = 1) -> DataFrame:
    """A camera's insects, and its flowers on every n-th frame of its time, whether or not an insect is there."""
    # An hour later, as a stream takes nothing at the beginning of time.
    ts = (F.timestamp_micros((F.col("fi") * 50_000 * slower).cast("long")) + F.expr("INTERVAL 1 HOUR")).alias("ts")
    rows = camera_rows(spark, d).where("kind = 'insect'").withColumn("ts", ts)
    spine = rows.groupBy("camera").agg(F.max("fi").alias("end")).select("camera", F.explode(F.sequence(F.lit(0).cast("long"), F.col("end"), F.lit(every).cast("long"))).alias("fi"))
    there = b.flowers(spark, d).select(F.col("video").cast("string").alias("camera"), *g.SIDES)
    none = F.lit(None)
    seen = spine.join(there, "camera").select("camera", ts, "fi", F.lit("flower").alias("kind"), none.cast("long").alias("track_id"), none.cast("string").alias("cls"), F.lit(0.9).alias("conf"), *g.SIDES)
    return rows.unionByName(seen)


def _shaped(rows: DataFrame) -> DataFrame:
    """With the columns of detections, missing ones null."""
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in (c.split() for c in readers.DETECTIONS.split(", "))])


def _after(rows: DataFrame, hours: int) -> DataFrame:
    """A row of another camera, much later, so that the watermark passes all that is open."""
    end = rows.agg((F.max("ts") + F.expr(f"INTERVAL {24 + hours} HOUR")).alias("ts"))
    return _shaped(end.select(F.lit("end").alias("camera"), "ts", F.lit("flower").alias("kind"), *[F.lit(0.0).alias(c) for c in g.SIDES])).coalesce(1)


def st4_k3_s18_st8_streamed(spark, d):
    """Landings that a stream appends to a table. It is stopped in the middle of its rows and goes on from its checkpoint; rows
    that come again, hours too late, are dropped."""
    rows_at, out, at = b.folder(spark, "detections"), b.folder(spark, "appended"), b.folder(spark, "checkpoint")
    rows = staged(_shaped(_still_flowers(spark, d)), "camera")
    half = rows.agg(F.percentile("fi", F.lit(0.5))).first()[0] or 0
    add = lambda df: df.write.mode("append").parquet(rows_at)
    was = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, live.STATE_STORE)

    def run() -> None:
        _finished(live.append_to(live.live_landings(readers.detection_stream(spark, rows_at, 1_000_000), p=PLAIN), out, at))

    try:
        add(rows.where(F.col("fi") <= half))
        run()
        add(rows.where(F.col("fi") > half))
        run()
        add(_after(rows, 0))
        run()
        add(rows.where(F.col("fi") <= half).withColumn("x1", F.col("x1") - 5))
        run()
        add(_after(rows, 1))
        run()
    finally:
        spark.conf.unset(PROVIDER) if was is None else spark.conf.set(PROVIDER, was)
    return spark.read.schema(live.LANDED).parquet(out).where("camera <> 'end'").select("camera", "t_enter_s", "t_exit_s", "landing_s", "is_real_landing", "flower_id", "conf_mean")


def st1_st2_st3_j9_still(spark, d):
    """Landings by all live rules over flowers that stand still. A frame takes 0.2 s, so tracks pause for longer than the grace
    and what they leave is taken up."""
    out = live.replayed(_still_flowers(spark, d, 2, 4), OFF_EDGES)
    return out.select("camera", "t_enter_s", "t_exit_s", "landing_s", "is_real_landing", "flower_id", "insect_type", "is_pollinator")


def st7_throughput_streamed(spark, d):
    """Rows per second of event time, as a stream counts them."""
    rows_at, out, at = b.folder(spark, "detections"), b.folder(spark, "counts"), b.folder(spark, "checkpoint")
    rows = _shaped(camera_rows(spark, d).where("kind = 'insect'"))
    for part in (rows, _after(rows, 0), _after(rows, 1)):
        part.write.mode("append").parquet(rows_at)
        counts = live.throughput(readers.detection_stream(spark, rows_at, 1_000_000))
        _finished(counts.writeStream.outputMode("append").format("parquet").option("checkpointLocation", at).start(out))
    last = rows.agg(F.max("ts").alias("last"))
    return spark.read.schema("second timestamp, n long").parquet(out).join(last, F.col("second") <= F.col("last")).select("second", "n")


class _Noted:
    """A callback that notes the landings it gets in a file for each task."""

    def __init__(self, at: str):
        self.at = at

    def open(self, partition: int, epoch: int) -> None:
        self.rows = []

    def __call__(self, row) -> None:
        self.rows.append({"camera": row.camera, "seq": row.seq, "flower_id": row.flower_id})

    def close(self, error) -> None:
        if self.rows:
            system, path = files.FileSystem.from_uri(self.at if "://" in self.at else f"file://{self.at}")
            system.create_dir(path, recursive=True)
            with system.open_output_stream(f"{path}/{uuid.uuid4().hex}.json") as f:
                f.write("".join(json.dumps(r) + "\n" for r in self.rows).encode())


def x1_called(spark, d):
    """What a callback for each landing of a stream was called with."""
    out, at = b.folder(spark, "called"), b.folder(spark, "checkpoint")
    landed = _landed_stream(spark, d)
    for _ in range(2):  # started again, the stream calls nothing twice
        _finished(live.call_for_each(landed, _Noted(out), at))
    return spark.read.schema("camera string, seq long, flower_id string").json(out).groupBy("camera", "seq", "flower_id").agg(F.count("*").alias("calls"))


def st5_k4_daily_counts(spark, d):
    """Daily counts of a stream, kept by key in a table."""
    out = b.folder(spark, "daily")
    _finished(live.upsert_daily(live.daily_counts(_landed_stream(spark, d)), out, b.folder(spark, "checkpoint")))
    return live.daily_table(spark, out).read()


def st6_k5_recent(spark, d):
    """The rolling mirror of a stream's newest landings."""
    out = b.folder(spark, "recent")
    _finished(live.keep_recent(_landed_stream(spark, d), out, b.folder(spark, "checkpoint")))
    return live.recents(spark, out).select("camera", "seq", "flower_id")


for _f in (st1_st2_st3_j9_replayed, st1_st2_st3_j9_still, st4_k3_s18_st8_streamed, st5_k4_daily_counts, st6_k5_recent, st7_throughput_streamed, x1_called):
    QUERIES[_f.__name__] = _f

_TYPES = ", ".join(f"(count(*) FILTER (insect_type = '{t}'))::BIGINT AS n_{t}" for t in live.INSECT_TYPES)
ORACLE["st5_k4_daily_counts"] = b.sql(*LANDED) + f"SELECT ts::DATE AS day, video::VARCHAR AS camera, flower_id, count(*)::BIGINT AS n_landings, (count(*) FILTER (is_real_landing = 1))::BIGINT AS n_real_landings, {_TYPES} FROM landings GROUP BY 1, 2, 3"
ORACLE["st6_k5_recent"] = b.sql(*LANDED) + "SELECT video::VARCHAR AS camera, (track_id * 10000 + episode)::BIGINT AS seq, flower_id FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, track_id DESC, episode DESC) AS k FROM landings) WHERE k <= 200"
ORACLE["x1_called"] = b.sql(*LANDED) + "SELECT video::VARCHAR AS camera, (track_id * 10000 + episode)::BIGINT AS seq, flower_id, 1::BIGINT AS calls FROM landings"
ORACLE["st7_throughput_streamed"] = b.sql("detections") + "SELECT make_timestamp((fi // 20 * 1000000)::BIGINT) AS second, count(*)::BIGINT AS n FROM detections GROUP BY 1"
#: Batch landings with flowers named by the order of their boxes, on from their second frame.
ORACLE["st4_k3_s18_st8_streamed"] = b.sql("detections", "flowers") + """, named AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY x1, y1, x2, y2) AS k FROM flowers),
onf AS (SELECT d.video, d.track_id, d.fi, min(f.k) AS k FROM detections d JOIN named f ON f.video = d.video AND d.fi >= 5
  AND (d.x1 + d.x2) / 2 BETWEEN f.x1 - (f.x2 - f.x1) * 0.1503::DOUBLE AND f.x2 + (f.x2 - f.x1) * 0.1503::DOUBLE AND (d.y1 + d.y2) / 2 BETWEEN f.y1 - (f.y2 - f.y1) * 0.1503::DOUBLE AND f.y2 + (f.y2 - f.y1) * 0.1503::DOUBLE GROUP BY 1, 2, 3),
r AS (SELECT d.video, d.track_id, d.fi, d.t, d.conf, o.k FROM detections d LEFT JOIN onf o ON o.video = d.video AND o.track_id = d.track_id AND o.fi = d.fi),
l0 AS (SELECT *, lag(k IS NOT NULL) OVER w AS was_on, lag(t) OVER w AS was_t, last_value(CASE WHEN k IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY video, track_id ORDER BY fi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_on
  FROM r WINDOW w AS (PARTITION BY video, track_id ORDER BY fi)),
l1 AS (SELECT *, sum(CASE WHEN k IS NOT NULL AND (last_on IS NULL OR (NOT was_on AND was_t - last_on > 0.5)) THEN 1 ELSE 0 END) OVER (PARTITION BY video, track_id ORDER BY fi ROWS UNBOUNDED PRECEDING) AS episode FROM l0)
SELECT video::VARCHAR AS camera, round(min(t), 2) AS t_enter_s, round(max(t), 2) AS t_exit_s, round(max(t) - min(t), 2) AS landing_s, CASE WHEN round(max(t) - min(t), 2) >= 2 THEN 1 ELSE 0 END AS is_real_landing, 'flower_' || arg_max(k, fi) AS flower_id, round(avg(conf), 3) AS conf_mean
FROM l1 WHERE k IS NOT NULL GROUP BY video, track_id, episode"""

_SIGHTING = "STRUCT(no BIGINT, track BIGINT, seen DOUBLE, x DOUBLE, y DOUBLE, flower BIGINT, enter_t DOUBLE, last_t DOUBLE, conf DOUBLE, n BIGINT, sums STRUCT(kind VARCHAR, total DOUBLE)[])"
#: The rows of a camera one by one, with its sightings as a list: which is gone on with, what is taken up, what ends.
ORACLE["st1_st2_st3_j9_still"] = b.sql("detections", "flowers").replace("WITH ", "WITH RECURSIVE ", 1) + f""", named AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY x1, y1, x2, y2) AS k FROM flowers),
onf AS (SELECT d.video, d.track_id, d.fi, min(f.k) AS k FROM detections d JOIN named f ON f.video = d.video AND d.fi >= 2
  AND (d.x1 + d.x2) / 2 BETWEEN f.x1 - (f.x2 - f.x1) * 0.1503::DOUBLE AND f.x2 + (f.x2 - f.x1) * 0.1503::DOUBLE AND (d.y1 + d.y2) / 2 BETWEEN f.y1 - (f.y2 - f.y1) * 0.1503::DOUBLE AND f.y2 + (f.y2 - f.y1) * 0.1503::DOUBLE GROUP BY 1, 2, 3),
r AS (SELECT d.video, d.track_id, round(d.fi * 0.2::DOUBLE, 2) AS t, d.cls, d.conf, (d.x1 + d.x2) / 2 AS x, (d.y1 + d.y2) / 2 AS y, 4 * sqrt(greatest(1, (d.x2 - d.x1) * (d.y2 - d.y1))) AS reach, o.k,
  row_number() OVER (PARTITION BY d.video ORDER BY d.fi, d.track_id, d.x1, d.y1, d.x2, d.y2) AS i FROM detections d LEFT JOIN onf o ON o.video = d.video AND o.track_id = d.track_id AND o.fi = d.fi),
walk AS (SELECT video, 0::BIGINT AS i, 0::BIGINT AS made, []::{_SIGHTING}[] AS tab, []::STRUCT(track BIGINT, no BIGINT)[] AS cur, NULL::{_SIGHTING} AS ended FROM r GROUP BY video UNION ALL
  SELECT video, i, made, CASE WHEN closes THEN list_append(others, {{'no': e.no, 'track': e.track, 'seen': t, 'x': x, 'y': y, 'flower': NULL, 'enter_t': NULL, 'last_t': NULL, 'conf': 0.0, 'n': 0, 'sums': e.sums}}) ELSE list_append(others, e) END,
    CASE WHEN fresh THEN list_append(list_filter(cur, lambda c: c.track <> track_id), {{'track': track_id, 'no': made}}) ELSE cur END, CASE WHEN closes THEN e END FROM (
    SELECT *, k IS NULL AND e.flower IS NOT NULL AND t - e.last_t > 0.5 AS closes FROM (
      SELECT video, i, made, cur, fresh, others, track_id, t, x, y, k, {{'no': base.no, 'track': track_id, 'seen': t, 'x': x, 'y': y, 'flower': coalesce(k, base.flower), 'enter_t': CASE WHEN k IS NOT NULL AND base.flower IS NULL THEN t ELSE base.enter_t END,
        'last_t': CASE WHEN k IS NOT NULL THEN t ELSE base.last_t END, 'conf': base.conf + CASE WHEN k IS NOT NULL THEN conf ELSE 0 END, 'n': base.n + CASE WHEN k IS NOT NULL THEN 1 ELSE 0 END,
        'sums': CASE WHEN list_contains(list_transform(base.sums, lambda z: z.kind), cls) THEN list_transform(base.sums, lambda z: {{'kind': z.kind, 'total': z.total + CASE WHEN z.kind = cls THEN conf ELSE 0 END}}) ELSE list_append(base.sums, {{'kind': cls, 'total': conf}}) END}}::{_SIGHTING} AS e FROM (
        SELECT *, list_filter(tab, lambda z: z.no <> coalesce(was.no, -1) AND z.no <> base.no) AS others FROM (
          SELECT *, CASE WHEN NOT fresh THEN s WHEN was IS NOT NULL THEN {{'no': made, 'track': track_id, 'seen': t, 'x': x, 'y': y, 'flower': was.flower, 'enter_t': was.enter_t, 'last_t': was.last_t, 'conf': was.conf, 'n': was.n, 'sums': was.sums}}::{_SIGHTING}
            ELSE {{'no': made, 'track': track_id, 'seen': t, 'x': x, 'y': y, 'flower': NULL, 'enter_t': NULL, 'last_t': NULL, 'conf': 0.0, 'n': 0, 'sums': CASE WHEN s IS NOT NULL AND s.flower IS NULL AND t - s.seen <= 5 THEN s.sums ELSE [] END}}::{_SIGHTING} END AS base FROM (
            SELECT *, CASE WHEN near IS NOT NULL THEN list_filter(tab, lambda z: z.no = near)[1] END AS was FROM (
              SELECT * REPLACE (CASE WHEN fresh AND s IS NOT NULL AND s.flower IS NULL THEN list_filter(tab, lambda z: z.no <> s.no) ELSE tab END AS tab, CASE WHEN fresh THEN made + 1 ELSE made END AS made),
                CASE WHEN fresh AND k IS NOT NULL THEN list_min(list_transform(list_filter(tab, lambda z: z.flower IS NOT NULL AND z.seen + 0.5 < t AND t <= z.seen + 5.5 AND sqrt((z.x - x) * (z.x - x) + (z.y - y) * (z.y - y)) <= reach),
                  lambda z: {{'far': sqrt((z.x - x) * (z.x - x) + (z.y - y) * (z.y - y)), 'no': z.no}})).no END AS near FROM (
                SELECT *, s IS NULL OR t - s.seen > 0.5 AS fresh FROM (
                  SELECT r.*, w.made, w.tab, w.cur, list_filter(w.tab, lambda z: z.no = list_filter(w.cur, lambda c: c.track = r.track_id)[1].no)[1] AS s FROM walk w JOIN r ON r.video = w.video AND r.i = w.i + 1))))))))),
landed AS (SELECT video, ended AS e FROM walk WHERE ended IS NOT NULL UNION ALL SELECT video, e FROM (SELECT video, unnest(arg_max(tab, i)) AS e FROM walk GROUP BY video) WHERE e.flower IS NOT NULL),
kinds AS (SELECT *, list_filter(e.sums, lambda z: z.total = list_max(list_transform(e.sums, lambda q: q.total)))[1].kind AS kind FROM landed)
SELECT video::VARCHAR AS camera, e.enter_t AS t_enter_s, e.last_t AS t_exit_s, round(e.last_t - e.enter_t, 2) AS landing_s, CASE WHEN round(e.last_t - e.enter_t, 2) >= 2 THEN 1 ELSE 0 END AS is_real_landing, 'flower_' || e.flower AS flower_id,
  kind AS insect_type, kind IN ('honeybee', 'bee', 'butterfly', 'fly') AS is_pollinator FROM kinds"""
