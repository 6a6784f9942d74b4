"""Queries over detections and landings."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from meadow.functions import geometry as g
from meadow.operators import detections as det
from meadow.operators import episodes, rollup, tracking, tracks
from meadow.params import INSECT_TYPES, LANDING
from meadow.plans import bindings as b

R = lambda c, n=6: F.round(c, n)
IOU = "(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))"
AREA = lambda t: f"greatest(1.0, ({t}.x2 - {t}.x1) * ({t}.y2 - {t}.y1))"
IOU = f"(CASE WHEN {IOU} > 0 THEN {IOU} / ({AREA('a')} + {AREA('b')} - {IOU}) ELSE 0 END)"

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(b.sql("detections") + """SELECT video, track_id, fi, round((x1 + x2) / 2, 6) AS cx, round((y1 + y2) / 2, 6) AS cy, round(greatest(1.0, (x2 - x1) * (y2 - y1)), 6) AS area,
round(greatest(greatest(1.0, x2 - x1) / greatest(1.0, y2 - y1), greatest(1.0, y2 - y1) / greatest(1.0, x2 - x1)), 6) AS aspect, round(x1 - (x2 - x1) * 0.15, 6) AS px1 FROM detections""")
def p7_geometry(spark, d):
    x, y = g.center(g.box())
    return b.detections(spark, d).select("video", "track_id", "fi", R(x).alias("cx"), R(y).alias("cy"), R(g.area(g.box())).alias("area"), R(g.aspect(g.box())).alias("aspect"), R(g.padded(g.box(), 0.15)[0]).alias("px1"))


@query(b.sql("detections") + f"""SELECT a.video, a.fi, a.track_id AS a, b.track_id AS b, round({IOU}, 6) AS iou,
round(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / least({AREA('a')}, {AREA('b')}), 6) AS nested
FROM detections a JOIN detections b ON a.video = b.video AND a.fi = b.fi AND a.track_id < b.track_id WHERE {IOU} > 0""")
def p8_p9_overlaps(spark, d):
    rows = b.detections(spark, d).select("video", "fi", "track_id", *g.SIDES)
    left, right = rows.select("video", "fi", F.col("track_id").alias("a"), *[F.col(s).alias("a_" + s) for s in g.SIDES]), rows.select("video", "fi", F.col("track_id").alias("b"), *[F.col(s).alias("b_" + s) for s in g.SIDES])
    both = left.join(right, ["video", "fi"]).where("a < b")
    iou = g.iou(g.box("a_"), g.box("b_"))
    return both.where(iou > 0).select("video", "fi", "a", "b", R(iou).alias("iou"), R(g.nested(g.box("a_"), g.box("b_"))).alias("nested"))


@query(b.sql("detections") + "SELECT video, cls, count(*)::BIGINT AS n FROM detections WHERE greatest(1.0, (x2 - x1) * (y2 - y1)) <= 0.001 * 1280 * 720 AND greatest((x2 - x1) / (y2 - y1), (y2 - y1) / (x2 - x1)) <= 1.5 GROUP BY 1, 2")
def p11_plausible_insects(spark, d):
    from dataclasses import replace

    from meadow.params import LANDING

    return det.plausible_insects(b.detections(spark, d), replace(LANDING, max_insect_frac=0.001, insect_aspect=1.5)).groupBy("video", "cls").agg(F.count("*").alias("n"))


@query(b.sql("flowers") + "SELECT video, flower_id FROM flowers WHERE (x2 - x1) * (y2 - y1) BETWEEN 0.002 * 1280 * 720 AND 0.004 * 1280 * 720 AND (x2 - x1) * (y2 - y1) <= 0.003 * 1280 * 720")
def p12_p13_plausible_flowers(spark, d):
    return det.not_oversized(det.plausible_flowers(b.flowers(spark, d), least=0.002, most=0.004), 0.003).select("video", "flower_id")


@query(b.sql("detections") + """SELECT video, track_id, raw_fi, floor(raw_fi / 3.0)::BIGINT AS fi, round(floor(raw_fi / 3.0) * 3 / 60.0, 2) AS t FROM (SELECT video, track_id, fi AS raw_fi FROM detections) WHERE raw_fi % 3 = 0""")
def p14_sampled(spark, d):
    rows = b.detections(spark, d).select("video", "track_id", F.col("fi").alias("raw_fi"))
    return det.sampled(rows, 60.0)


@query(b.sql("detections") + "SELECT video, track_id, fi, last_value(CASE WHEN fi % 5 = 0 THEN x1 END IGNORE NULLS) OVER (PARTITION BY video, track_id ORDER BY fi ROWS UNBOUNDED PRECEDING) AS x1 FROM detections")
def p15_refreshed(spark, d):
    return det.refreshed(b.detections(spark, d).select("video", "track_id", "fi", "x1"), 5, "x1")


@query(b.sql("detections") + """, s AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM detections), w AS (SELECT *, lag(cx) OVER o AS px, lag(cy) OVER o AS py, lag(t) OVER o AS pt FROM s WINDOW o AS (PARTITION BY video, track_id ORDER BY fi))
SELECT video, track_id, fi, round(CASE WHEN t - pt > 0 THEN sqrt((cx - px) * (cx - px) + (cy - py) * (cy - py)) / (t - pt) / sqrt(greatest(1.0, (x2 - x1) * (y2 - y1))) ELSE 0 END, 6) AS speed FROM w""")
def p16_speeds(spark, d):
    return det.speeds(b.detections(spark, d)).select("video", "track_id", "fi", R(F.col("speed")).alias("speed"))


@query(b.sql("detections", "flowers", "on_flowers") + "SELECT video, track_id, fi, flower_id FROM on_flowers")
def j1_p10_on_flowers(spark, d):
    return b.on_flowers(spark, d).select("video", "track_id", "fi", "flower_id")


@query(b.sql("detections", "flowers") + f"SELECT a.video, a.track_id, a.fi FROM detections a WHERE NOT EXISTS (SELECT 1 FROM flowers b WHERE a.video = b.video AND {IOU} >= 0.1)")
def j2_j3_vetoed(spark, d):
    return det.vetoed(b.detections(spark, d), b.flowers(spark, d), 0.1).select("video", "track_id", "fi")


NESTED = f"(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / least({AREA('a')}, {AREA('b')}))"
#: Boxes of a frame by falling confidence; one after the other stays unless it overlaps one that stayed.
GREEDY = b.sql("detections").replace("WITH ", "WITH RECURSIVE ", 1) + f""", o AS (SELECT *, row_number() OVER (PARTITION BY video, fi ORDER BY conf DESC, track_id, x1, y1, x2, y2) AS n FROM detections),
hits AS (SELECT b.video, b.fi, b.n, list(a.n) AS over FROM o b JOIN o a ON a.video = b.video AND a.fi = b.fi AND a.n < b.n WHERE {IOU} >= 0.6 OR {NESTED} >= 0.75 GROUP BY 1, 2, 3),
steps AS (SELECT o.video, o.fi, o.n, coalesce(h.over, []) AS over FROM o LEFT JOIN hits h ON h.video = o.video AND h.fi = o.fi AND h.n = o.n),
walk AS (SELECT video, fi, 0::BIGINT AS n, []::BIGINT[] AS kept FROM (SELECT DISTINCT video, fi FROM detections) UNION ALL
  SELECT w.video, w.fi, s.n, CASE WHEN len(list_intersect(w.kept, s.over)) > 0 THEN w.kept ELSE list_append(w.kept, s.n) END FROM walk w JOIN steps s ON s.video = w.video AND s.fi = w.fi AND s.n = w.n + 1),
last AS (SELECT video, fi, arg_max(kept, n) AS kept FROM walk GROUP BY 1, 2)
"""


@query(GREEDY + "SELECT o.video, o.track_id, o.fi, round(o.conf, 6) AS conf FROM o JOIN last l ON l.video = o.video AND l.fi = o.fi AND list_contains(l.kept, o.n)")
def d9_without_overlaps(spark, d):
    return det.without_overlaps(b.detections(spark, d)).select("video", "track_id", "fi", R(F.col("conf")).alias("conf"))


@query(b.sql("detections") + "SELECT video, track_id, count(*)::BIGINT AS n FROM detections GROUP BY 1, 2 HAVING count(DISTINCT fi) >= 40")
def d12_long_enough(spark, d):
    return det.long_enough(b.detections(spark, d), 40).groupBy("video", "track_id").agg(F.count("*").alias("n"))


@query(b.sql("detections", "votes") + "SELECT t.video, t.track_id, t.cls, round(sum(v.votes), 6) AS votes FROM types t JOIN v0 v ON v.video = t.video AND v.track_id = t.track_id GROUP BY 1, 2, 3")
def a2_class_votes(spark, d):
    return det.class_votes(b.detections(spark, d)).select("video", "track_id", "cls", R(F.col("votes")).alias("votes"))


@query(b.sql("detections", "votes") + """, lab AS (SELECT video, track_id, CASE WHEN event_id % 3 = 0 THEN 'honeybee' ELSE 'other' END AS label, fi FROM detections WHERE cls = 'bee'),
n AS (SELECT video, track_id, label, count(*) AS n, min(fi) AS seen FROM lab GROUP BY 1, 2, 3), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video, track_id ORDER BY n DESC, seen) AS k FROM n) WHERE k = 1),
j AS (SELECT t.video, t.track_id, t.cls, CASE WHEN t.cls = 'bee' THEN p.label = 'honeybee' ELSE false END AS is_honeybee FROM types t LEFT JOIN top p ON p.video = t.video AND p.track_id = t.track_id)
SELECT video, track_id, CASE WHEN is_honeybee THEN 'honeybee' ELSE cls END AS cls, is_honeybee FROM j""")
def a3_x2_honeybee_votes(spark, d):
    rows = b.detections(spark, d)
    labels = rows.where("cls = 'bee'").select("video", "track_id", "fi", F.when(F.col("event_id") % 3 == 0, "honeybee").otherwise("other").alias("label"))
    return det.honeybee_votes(labels, det.class_votes(rows).drop("votes"))


@query(b.sql("detections") + """, h AS (SELECT *, floor(fi / 4.0)::BIGINT AS g FROM detections)
SELECT video, track_id, g AS fi, round(conf, 6) AS conf, x1 FROM (SELECT *, row_number() OVER (PARTITION BY video, track_id, g ORDER BY conf DESC, x1, y1, x2, y2) AS k FROM h) WHERE k = 1""")
def a4_best_boxes(spark, d):
    rows = b.detections(spark, d).withColumn("fi", F.floor(F.col("fi") / 4)).select("video", "track_id", "fi", "conf", *g.SIDES)
    return det.best_boxes(rows).select("video", "track_id", "fi", R(F.col("conf")).alias("conf"), "x1")


@query(b.sql("detections") + "SELECT video, fi, cls, count(*)::BIGINT AS n FROM detections GROUP BY 1, 2, 3")
def a27_frame_counts(spark, d):
    return det.frame_counts(b.detections(spark, d))


@query(b.sql("detections") + "SELECT video, track_id, min(fi) AS f0, max(fi) AS f1, arg_min((x1 + x2) / 2, fi) AS x0, arg_max((x1 + x2) / 2, fi) AS x1, arg_max(greatest(1.0, (x2 - x1) * (y2 - y1)), fi) AS area1 FROM detections GROUP BY 1, 2")
def w5_spans(spark, d):
    return tracks.spans(b.detections(spark, d)).select("video", "track_id", "f0", "f1", "x0", "x1", "area1")


#: Each track twice, the second one numbered on and moved a little, so that some of the pairs are one insect.
DOUBLED = """, twice AS (SELECT video, track_id, fi, x1, y1, x2, y2 FROM detections UNION ALL SELECT video, track_id + 1000000 AS track_id, fi, x1 + fi % 9 AS x1, y1 + track_id % 14 AS y1, x2 + fi % 9 AS x2, y2 + track_id % 14 AS y2 FROM detections)
"""


def _doubled(spark, d):
    rows = b.detections(spark, d).select("video", "track_id", "fi", *g.SIDES)
    dx, dy = F.col("fi") % 9, F.col("track_id") % 14
    return rows.unionByName(rows.select("video", (F.col("track_id") + 1000000).alias("track_id"), "fi", *[(F.col(c) + s).alias(c) for c, s in zip(g.SIDES, (dx, dy, dx, dy))]))


@query(b.sql("detections") + DOUBLED + f"SELECT a.video, a.track_id AS a, b.track_id AS b, count(*)::BIGINT AS frames, round(avg({IOU}), 6) AS iou FROM twice a JOIN twice b ON a.video = b.video AND a.fi = b.fi AND a.track_id < b.track_id GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND avg({IOU}) >= 0.45")
def j8_u4_concurrent(spark, d):
    return tracks.concurrent_edges(_doubled(spark, d)).withColumn("iou", R(F.col("iou")))


#: Tracks cut at every gap over four frames, so that there is something to link.
CUT = """, c0 AS (SELECT *, CASE WHEN fi - lag(fi) OVER (PARTITION BY video, track_id ORDER BY fi) > 2 THEN 1 ELSE 0 END AS cut FROM detections),
cut AS (SELECT * REPLACE (track_id * 1000 + sum(cut) OVER (PARTITION BY video, track_id ORDER BY fi ROWS UNBOUNDED PRECEDING)::BIGINT AS track_id) FROM c0),
ends AS (SELECT video, track_id, min(fi) AS f0, max(fi) AS f1, arg_min((x1 + x2) / 2, fi) AS x0, arg_min((y1 + y2) / 2, fi) AS y0, arg_max((x1 + x2) / 2, fi) AS x9, arg_max((y1 + y2) / 2, fi) AS y9, arg_max(greatest(1.0, (x2 - x1) * (y2 - y1)), fi) AS area1 FROM cut GROUP BY 1, 2)"""


def _cut(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("video", "track_id").orderBy("fi")
    cut = F.coalesce((F.col("fi") - F.lag("fi").over(w) > 2).cast("long"), F.lit(0))
    rows = b.detections(spark, d).withColumn("cut", cut)
    return rows.withColumn("track_id", F.col("track_id") * 1000 + F.sum("cut").over(w)).drop("cut")


@query(b.sql("detections") + CUT + """
SELECT video, later, earlier, gap FROM (SELECT l.video, l.track_id AS later, e.track_id AS earlier, l.f0 - e.f1 AS gap, row_number() OVER (PARTITION BY l.video, l.track_id ORDER BY l.f0 - e.f1, e.f0, e.track_id) AS k
  FROM ends l JOIN ends e ON e.video = l.video AND e.track_id <> l.track_id AND l.f0 - e.f1 BETWEEN 0 AND 100 AND sqrt((l.x0 - e.x9) * (l.x0 - e.x9) + (l.y0 - e.y9) * (l.y0 - e.y9)) <= 4 * sqrt(greatest(e.area1, l.area1))) WHERE k = 1""")
def j7_relinked(spark, d):
    return tracks.relink_edges(tracks.spans(_cut(spark, d)))


D10 = (b.sql("detections") + CUT).replace("WITH ", "WITH RECURSIVE ", 1) + """, sizes AS (SELECT *, greatest(1, (x2 - x1) * (y2 - y1)) AS area FROM cut),
shared AS (SELECT a.video, a.track_id AS a, c.track_id AS c, count(*) AS frames, avg(""" + IOU.replace("b.", "c.") + """) AS iou FROM sizes a JOIN sizes c ON a.video = c.video AND a.fi = c.fi AND a.track_id < c.track_id GROUP BY 1, 2, 3),
side AS (SELECT video, a, c FROM shared WHERE frames >= 2 AND iou >= 0.45 UNION SELECT video, c, a FROM shared WHERE frames >= 2 AND iou >= 0.45),
reach AS (SELECT video, track_id, track_id AS at_track FROM ends UNION SELECT r.video, r.track_id, s.c FROM reach r JOIN side s ON s.video = r.video AND s.a = r.at_track),
grouped AS (SELECT video, track_id, min(at_track) AS grp FROM reach GROUP BY 1, 2),
placed AS (SELECT e.*, g.grp, row_number() OVER (PARTITION BY e.video ORDER BY e.f0, e.track_id) AS n FROM ends e JOIN grouped g ON g.video = e.video AND g.track_id = e.track_id),
offers AS (SELECT l.video, l.n, list({'gap': l.f0 - e.f1, 'f0': e.f0, 'id': e.track_id, 'n': e.n} ORDER BY l.f0 - e.f1, e.f0, e.track_id) AS offers
  FROM placed l JOIN placed e ON e.video = l.video AND e.track_id <> l.track_id AND l.f0 - e.f1 BETWEEN 0 AND 100 AND sqrt((l.x0 - e.x9) * (l.x0 - e.x9) + (l.y0 - e.y9) * (l.y0 - e.y9)) <= 4 * sqrt(greatest(e.area1, l.area1)) GROUP BY 1, 2),
walk AS (SELECT video, 0::BIGINT AS n, list(grp ORDER BY n) AS grps FROM placed GROUP BY video UNION ALL
  SELECT video, n, CASE WHEN to_grp IS NULL THEN grps ELSE list_transform(grps, lambda g: CASE WHEN g = to_grp OR g = own THEN least(own, to_grp) ELSE g END) END FROM (
    SELECT w.video, w.n + 1 AS n, w.grps, w.grps[w.n + 1] AS own, list_filter(list_transform(o.offers, lambda x: w.grps[x.n]), lambda g: g <> w.grps[w.n + 1])[1] AS to_grp
    FROM walk w LEFT JOIN offers o ON o.video = w.video AND o.n = w.n + 1 WHERE w.n < len(w.grps))),
done AS (SELECT video, arg_max(grps, n) AS grps FROM walk GROUP BY video),
merged AS (SELECT p.video, p.track_id, d.grps[p.n] AS grp FROM placed p JOIN done d ON d.video = p.video)
"""


@query(D10 + "SELECT c.video, m.grp AS track_id, count(DISTINCT c.fi) AS frames, min(c.fi) AS f0, max(c.fi) AS f1 FROM cut c JOIN merged m ON m.video = c.video AND m.track_id = c.track_id GROUP BY 1, 2")
def d10_unified(spark, d):
    """Cut tracks put together again: one row per unified track."""
    rows = _cut(spark, d).select("video", "track_id", "fi", "conf", *g.SIDES)
    return tracks.unified(rows).groupBy("video", "track_id").agg(F.count("*").alias("frames"), F.min("fi").alias("f0"), F.max("fi").alias("f1"))


INTER = """, n0 AS (SELECT *, coalesce(lead(fi) OVER w, fi + 1) AS nfi, coalesce(lead(x1) OVER w, x1) AS nx1, coalesce(lead(y2) OVER w, y2) AS ny2 FROM detections WINDOW w AS (PARTITION BY video, track_id ORDER BY fi)),
dense AS (SELECT video, track_id, a AS fi, x1 * (1 - (a - fi) / (nfi - fi)::DOUBLE) + nx1 * ((a - fi) / (nfi - fi)::DOUBLE) AS x1, y2 * (1 - (a - fi) / (nfi - fi)::DOUBLE) + ny2 * ((a - fi) / (nfi - fi)::DOUBLE) AS y2 FROM (SELECT *, unnest(range(fi, nfi)) AS a FROM n0))"""


@query(b.sql("detections") + INTER + " SELECT video, track_id, fi, round(x1, 6) AS x1, round(y2, 6) AS y2 FROM dense")
def w3_interpolated(spark, d):
    return tracks.interpolated(b.detections(spark, d)).select("video", "track_id", "fi", R(F.col("x1")).alias("x1"), R(F.col("y2")).alias("y2"))


@query(b.sql("detections") + INTER + """, k AS (SELECT video, track_id, fi, list(x1) OVER (PARTITION BY video, track_id ORDER BY fi ROWS BETWEEN 80 PRECEDING AND CURRENT ROW) AS xs FROM dense)
SELECT video, track_id, fi, round(list_reduce(xs, lambda a, x: 0.6::DOUBLE * a + 0.4::DOUBLE * x), 5) AS x1 FROM k""")
def w4_smoothed(spark, d):
    return tracks.smoothed(tracks.interpolated(b.detections(spark, d)), columns=("x1",)).select("video", "track_id", "fi", F.round("x1", 5).alias("x1"))


@query(b.sql("detections") + """, s AS (SELECT video, 'f' || track_id AS flower_id, fi, x1 FROM detections), i AS (SELECT video, flower_id, min(fi) AS a, max(fi) AS z FROM s GROUP BY 1, 2),
sp AS (SELECT * FROM (SELECT video, flower_id, unnest(range(a, z + 17)) AS fi FROM i) JOIN (SELECT DISTINCT video, fi FROM detections) USING (video, fi)),
h AS (SELECT sp.video, sp.flower_id, sp.fi, last_value(s.x1 IGNORE NULLS) OVER w AS x1, last_value(s.fi IGNORE NULLS) OVER w AS lfi FROM sp LEFT JOIN s USING (video, flower_id, fi) WINDOW w AS (PARTITION BY sp.video, sp.flower_id ORDER BY sp.fi ROWS UNBOUNDED PRECEDING))
SELECT video, flower_id, fi, x1, fi - lfi AS age FROM h WHERE fi - lfi <= 16""")
def w6_held(spark, d):
    rows = b.detections(spark, d)
    seen = rows.select("video", F.concat(F.lit("f"), F.col("track_id")).alias("flower_id"), "fi", *g.SIDES)
    return tracks.held(seen, rows, 16).select("video", "flower_id", "fi", "x1", "age")


ASSIGNED = (b.sql("detections") + DOUBLED).replace("WITH ", "WITH RECURSIVE ", 1) + f""", p AS (SELECT a.video, a.fi, a.track_id AS flower_id, b.track_id AS det, {IOU} AS iou FROM twice a JOIN twice b ON a.video = b.video AND a.fi = b.fi AND a.track_id < 1000000 AND b.track_id >= 1000000 WHERE {IOU} >= 0.3),
o AS (SELECT *, row_number() OVER (PARTITION BY video, fi ORDER BY iou DESC, flower_id, det) AS n FROM p),
walk AS (SELECT video, fi, 0::BIGINT AS n, []::BIGINT[] AS used, []::BIGINT[] AS kept FROM (SELECT DISTINCT video, fi FROM o) UNION ALL
  SELECT w.video, w.fi, o.n, CASE WHEN free THEN list_concat(w.used, [o.flower_id, o.det]) ELSE w.used END, CASE WHEN free THEN list_append(w.kept, o.n) ELSE w.kept END
  FROM (SELECT w.*, NOT (list_contains(w.used, o.flower_id) OR list_contains(w.used, o.det)) AS free FROM walk w JOIN o ON o.video = w.video AND o.fi = w.fi AND o.n = w.n + 1) w JOIN o ON o.video = w.video AND o.fi = w.fi AND o.n = w.n + 1),
last AS (SELECT video, fi, arg_max(kept, n) AS kept FROM walk GROUP BY 1, 2)
"""


@query(ASSIGNED + "SELECT o.video, o.fi, o.flower_id, o.det, round(o.iou, 6) AS iou FROM o JOIN last l ON l.video = o.video AND l.fi = o.fi AND list_contains(l.kept, o.n)")
def j4_assigned(spark, d):
    rows = _doubled(spark, d)
    a = rows.where("track_id < 1000000").select("video", "fi", F.col("track_id").alias("flower_id"), *g.SIDES)
    c = rows.where("track_id >= 1000000").select("video", "fi", F.col("track_id").alias("det"), *g.SIDES)
    return tracking.assigned(a, c).withColumn("iou", R(F.col("iou")))


J5 = b.sql("detections").replace("WITH ", "WITH RECURSIVE ", 1) + """, boxes AS (SELECT video, fi, x1, y1, x2, y2, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, 1.6 * sqrt(greatest(1, (x2 - x1) * (y2 - y1))) AS reach,
  row_number() OVER (PARTITION BY video ORDER BY fi, track_id) AS n, lead(fi) OVER (PARTITION BY video ORDER BY fi, track_id) IS DISTINCT FROM fi AS closes FROM detections),
walk AS (SELECT video, 0::BIGINT AS n, NULL::BIGINT AS fi, false AS closes, 0::BIGINT AS made, []::STRUCT(id BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, last BIGINT)[] AS known FROM boxes GROUP BY video UNION ALL
  SELECT video, n, fi, closes, made, CASE WHEN closes THEN list_filter(known, lambda k: bfi - k.last <= 16) ELSE known END FROM (
    SELECT video, n, fi, fi AS bfi, closes, CASE WHEN best IS NULL THEN made + 1 ELSE made END AS made,
      CASE WHEN best IS NULL THEN list_append(known, {'id': made + 1, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'last': fi}) ELSE list_transform(known, lambda k: CASE WHEN k.id <> best THEN k ELSE
        {'id': k.id, 'x1': 0.85::DOUBLE * k.x1 + (1 - 0.85::DOUBLE) * x1, 'y1': 0.85::DOUBLE * k.y1 + (1 - 0.85::DOUBLE) * y1, 'x2': 0.85::DOUBLE * k.x2 + (1 - 0.85::DOUBLE) * x2, 'y2': 0.85::DOUBLE * k.y2 + (1 - 0.85::DOUBLE) * y2, 'last': fi} END) END AS known FROM (
      SELECT b.*, w.made, w.known, -(list_min(list_filter(list_transform(w.known, lambda k: {'far': sqrt((b.cx - (k.x1 + k.x2) / 2) * (b.cx - (k.x1 + k.x2) / 2) + (b.cy - (k.y1 + k.y2) / 2) * (b.cy - (k.y1 + k.y2) / 2)), 'id': -k.id, 'used': k.last = b.fi}),
        lambda k: NOT k.used AND k.far <= b.reach)).id) AS best
      FROM walk w JOIN boxes b ON b.video = w.video AND b.n = w.n + 1)))
"""


@query(J5 + "SELECT video, 'flower_' || k.id AS flower_id, count(*) AS frames, min(fi) AS f0, max(fi) AS f1, round(sum(k.x1), 3) AS sum_x1 FROM (SELECT video, fi, unnest(known) AS k FROM walk WHERE closes) GROUP BY 1, 2")
def j5_canonical_flowers(spark, d):
    boxes = b.detections(spark, d).select("video", "fi", F.col("track_id").alias("ordinal"), *g.SIDES)
    seen = tracking.canonical_flowers(boxes).groupBy("video", "flower_id")
    return seen.agg(F.count("*").alias("frames"), F.min("fi").alias("f0"), F.max("fi").alias("f1"), F.round(F.sum("x1"), 3).alias("sum_x1"))


J6 = b.sql("detections", "flowers").replace("WITH ", "WITH RECURSIVE ", 1) + """, landed AS (SELECT video, event_id AS seq, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, 0.8 * sqrt(greatest(1, (x2 - x1) * (y2 - y1))) AS reach FROM detections),
met AS (SELECT l.video, l.seq, f.flower_id, sqrt((l.x - (f.x1 + f.x2) / 2) * (l.x - (f.x1 + f.x2) / 2) + (l.y - (f.y1 + f.y2) / 2) * (l.y - (f.y1 + f.y2) / 2)) AS far, l.reach FROM landed l JOIN flowers f ON f.video = l.video),
near AS (SELECT video, seq, arg_min(flower_id, {'far': far, 'id': flower_id}) AS flower_id FROM met WHERE far <= reach GROUP BY 1, 2),
rest AS (SELECT l.*, row_number() OVER (PARTITION BY l.video ORDER BY l.seq) AS n FROM landed l ANTI JOIN near m ON m.video = l.video AND m.seq = l.seq),
walk AS (SELECT video, 0::BIGINT AS n, NULL::BIGINT AS seq, 0::BIGINT AS took, []::STRUCT(x DOUBLE, y DOUBLE)[] AS made FROM rest GROUP BY video UNION ALL
  SELECT video, n, seq, coalesce(hit, len(made) + 1), CASE WHEN hit IS NULL THEN list_append(made, {'x': x, 'y': y}) ELSE made END FROM (
    SELECT r.*, w.made, list_position(list_transform(w.made, lambda m: sqrt((r.x - m.x) * (r.x - m.x) + (r.y - m.y) * (r.y - m.y)) <= r.reach), true) AS hit FROM walk w JOIN rest r ON r.video = w.video AND r.n = w.n + 1))
"""


@query(J6 + "SELECT video, seq, flower_id FROM near UNION ALL SELECT video, seq, 'flower_unk_' || took FROM walk WHERE n > 0")
def j6_attributed(spark, d):
    """With a shorter reach than landings have, so that some find no flower."""
    rows = b.detections(spark, d)
    x, y = g.center(g.box())
    landed = rows.select("video", F.col("event_id").alias("seq"), x.alias("cx"), y.alias("cy"), g.area(g.box()).alias("area"))
    there = b.flowers(spark, d).select("video", "flower_id", "ordinal", x.alias("cx"), y.alias("cy"))
    return tracking.attributed(landed, there, replace(LANDING, unknown_k=0.8))


LANDED = ("detections", "flowers", "on_flowers", "votes", "landings")


@query(b.sql(*LANDED) + "SELECT video, track_id, episode, flower_id, t_enter_s, t_exit_s, landing_s, is_real_landing, insect_type, pollination_weight, conf_mean FROM landings")
def w1_landings(spark, d):
    return b.landings(spark, d).select("video", "track_id", "episode", "flower_id", "t_enter_s", "t_exit_s", "landing_s", "is_real_landing", "insect_type", "pollination_weight", "conf_mean")


SUMMARY = b.sql(*LANDED) + """, per AS (SELECT video, flower_id, count(*)::BIGINT AS n_landings, (count(*) FILTER (is_real_landing = 1))::BIGINT AS n_real_landings,
""" + ", ".join(f"(count(*) FILTER (is_real_landing = 1 AND insect_type = '{t}'))::BIGINT AS n_{t}" for t in INSECT_TYPES) + """,
sum(CASE WHEN is_real_landing = 1 THEN landing_s ELSE 0 END) AS tot, sum(CASE WHEN is_real_landing = 1 THEN pollination_weight * least(landing_s, 30) ELSE 0 END) AS score FROM landings GROUP BY 1, 2),
ids AS (SELECT video, flower_id FROM flowers UNION SELECT video, flower_id FROM per),
summary AS (SELECT i.video, i.flower_id, coalesce(n_landings, 0) AS n_landings, coalesce(n_real_landings, 0) AS n_real_landings, """ + ", ".join(f"coalesce(n_{t}, 0) AS n_{t}" for t in INSECT_TYPES) + """,
coalesce(round(tot::DECIMAL(18, 9), 2)::DOUBLE, 0) AS total_landing_s, coalesce(round((tot / nullif(n_real_landings, 0))::DECIMAL(18, 9), 2)::DOUBLE, 0) AS mean_landing_s, coalesce(round(score::DECIMAL(18, 9), 2)::DOUBLE, 0) AS pollination_score FROM ids i LEFT JOIN per p ON p.video = i.video AND p.flower_id = i.flower_id)
"""


@query(SUMMARY + "SELECT * FROM summary")
def a1_u2_flower_summary(spark, d):
    return rollup.flower_summary(b.landings(spark, d), b.flowers(spark, d))


@query(SUMMARY + "SELECT video, flower_id, n_landings, n_real_landings, pollination_score, rank FROM (SELECT *, row_number() OVER (ORDER BY pollination_score DESC, video, flower_id) AS rank FROM summary WHERE n_real_landings > 0) WHERE rank <= 20")
def flagship_top_flowers(spark, d):
    """Which flowers received real landings, and with what score."""
    from pyspark.sql import Window

    s = a1_u2_flower_summary(spark, d).where("n_real_landings > 0").orderBy(F.desc("pollination_score"), "video", "flower_id").limit(20)
    return s.select("video", "flower_id", "n_landings", "n_real_landings", "pollination_score", F.row_number().over(Window.orderBy(F.desc("pollination_score"), "video", "flower_id")).cast("long").alias("rank"))


HEADLINE = b.sql(*LANDED).replace("WITH ", "WITH RECURSIVE ", 1) + """, life AS (SELECT video, flower_id, max(fi) - min(fi) AS span, max({'fi': fi, 'cx': (x1 + x2) / 2, 'cy': (y1 + y2) / 2}) AS spot, min(substr(flower_id, 8)::BIGINT) AS ordinal FROM on_flowers WHERE flower_id IS NOT NULL GROUP BY 1, 2),
real AS (SELECT video, spot.cx AS cx, spot.cy AS cy, row_number() OVER (PARTITION BY video ORDER BY ordinal) AS n FROM life l WHERE span >= 20 OR EXISTS (SELECT 1 FROM landings k WHERE k.video = l.video AND k.flower_id = l.flower_id AND k.is_real_landing = 1)),
walk AS (SELECT video, 0::BIGINT AS n, []::STRUCT(x DOUBLE, y DOUBLE)[] AS kept FROM (SELECT DISTINCT video FROM real) UNION ALL
  SELECT w.video, r.n, CASE WHEN len([k FOR k IN w.kept IF sqrt((k.x - r.cx) * (k.x - r.cx) + (k.y - r.cy) * (k.y - r.cy)) < 0.16 * sqrt(1280 * 1280 + 720 * 720)]) > 0 THEN w.kept ELSE list_append(w.kept, {'x': r.cx, 'y': r.cy}) END FROM walk w JOIN real r ON r.video = w.video AND r.n = w.n + 1)
"""


@query(HEADLINE + "SELECT video, max(len(kept))::BIGINT AS flowers FROM walk GROUP BY 1")
def a26_headline_count(spark, d):
    x, y = g.center(g.box())
    seen = b.on_flowers(spark, d).where("flower_id IS NOT NULL").select("video", "flower_id", "fi", x.alias("cx"), y.alias("cy"), F.regexp_extract("flower_id", r"(\d+)", 1).cast("long").alias("ordinal"))
    return rollup.headline_count(b.landings(spark, d), seen)


ENTERED = b.sql("detections", "flowers", "on_flowers").replace("WITH ", "WITH RECURSIVE ", 1) + """, w AS (SELECT *, lag(flower_id) OVER (PARTITION BY video, track_id ORDER BY fi) AS was FROM on_flowers),
e AS (SELECT video, track_id, flower_id, fi, row_number() OVER (PARTITION BY video, track_id, flower_id ORDER BY fi) AS n FROM w WHERE flower_id IS NOT NULL AND (was IS NULL OR was <> flower_id)),
walk AS (SELECT video, track_id, flower_id, n, fi AS last, 1::BIGINT AS visits FROM e WHERE n = 1 UNION ALL
  SELECT e.video, e.track_id, e.flower_id, e.n, CASE WHEN e.fi - k.last > 20 THEN e.fi ELSE k.last END, k.visits + CASE WHEN e.fi - k.last > 20 THEN 1 ELSE 0 END FROM walk k JOIN e ON e.video = k.video AND e.track_id = k.track_id AND e.flower_id = k.flower_id AND e.n = k.n + 1)
"""


@query(ENTERED + "SELECT video, track_id, flower_id, max(visits)::INT AS visits FROM walk GROUP BY 1, 2, 3")
def w2_entered_visits(spark, d):
    return episodes.entered_visits(b.on_flowers(spark, d).select("video", "track_id", "fi", "flower_id"))


STEADY = b.sql("detections").replace("WITH ", "WITH RECURSIVE ", 1) + """, o AS (SELECT video, track_id, fi, cls, row_number() OVER v AS n, """ + ", ".join(f"coalesce(sum(conf) FILTER (cls = '{t}') OVER v, 0) AS s_{t}" for t in ("bee", "fly", "butterfly", "beetle", "bug")) + """ FROM detections WINDOW v AS (PARTITION BY video, track_id ORDER BY fi, cls, conf ROWS UNBOUNDED PRECEDING)),
s AS (SELECT video, track_id, fi, n, cls, map {'bee': s_bee, 'fly': s_fly, 'butterfly': s_butterfly, 'beetle': s_beetle, 'bug': s_bug} AS sums FROM o),
walk AS (SELECT video, track_id, fi, n, cls FROM s WHERE n = 1 UNION ALL
  SELECT s.video, s.track_id, s.fi, s.n, CASE WHEN s.cls <> k.cls AND s.sums[s.cls] >= 1.5 * s.sums[k.cls] THEN s.cls ELSE k.cls END FROM walk k JOIN s ON s.video = k.video AND s.track_id = k.track_id AND s.n = k.n + 1)
"""


@query(STEADY + "SELECT video, track_id, fi, cls FROM walk")
def w12_steady_labels(spark, d):
    return episodes.steady_labels(b.detections(spark, d).select("video", "track_id", "fi", "cls", "conf"))


@query(b.sql(*LANDED) + "SELECT video, flower_id, track_id, episode, count(*) OVER (PARTITION BY video, flower_id ORDER BY last_fi, track_id, episode ROWS UNBOUNDED PRECEDING)::BIGINT AS so_far FROM landings WHERE is_real_landing = 1")
def w11_running_counts(spark, d):
    return episodes.running_counts(b.landings(spark, d)).select("video", "flower_id", "track_id", "episode", "so_far")


@query(b.sql("detections") + "SELECT track_id, dense_rank() OVER (ORDER BY seen, track_id)::INT AS id FROM (SELECT track_id, min(event_id) AS seen FROM detections GROUP BY 1)")
def w13_first_seen_ids(spark, d):
    return episodes.first_seen_ids(b.detections(spark, d), "track_id", "event_id")


@query("SELECT date_trunc('second', ts) AS second, count(*)::BIGINT AS n FROM events GROUP BY 1")
def w15_st7_per_second(spark, d):
    return episodes.per_second(b.table(spark, d, "events"))


@query(b.sql(*LANDED) + """, f AS (SELECT flower_id, count(*) AS n, count(*) FILTER (insect_type IN ('honeybee', 'bee', 'butterfly', 'fly')) AS good FROM landings GROUP BY 1)
SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')::BIGINT AS done_videos, sum(n)::BIGINT AS visits, round(sum(good) * 100.0 / sum(n), 1)::DOUBLE AS pollinator_pct, round(avg(n)::DECIMAL(18, 9), 2)::DOUBLE AS mean_visits, arg_max(flower_id, {'n': n, 'f': flower_id}) AS top_flower FROM f""")
def a8_overview(spark, d):
    videos = b.table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status"))
    return rollup.overview(b.landings(spark, d), videos)


@query(b.sql(*LANDED) + "SELECT flower_id, (count(*) FILTER (insect_type IN ('honeybee', 'bee', 'butterfly', 'fly')))::BIGINT AS pollinators, (count(*) FILTER (insect_type NOT IN ('honeybee', 'bee', 'butterfly', 'fly')))::BIGINT AS others, count(*)::BIGINT AS total FROM landings WHERE video = 0 GROUP BY ROLLUP (flower_id)")
def a9_p26_visits_by_flower(spark, d):
    return rollup.visits_by_flower(b.landings(spark, d), video=0)


@query(b.sql(*LANDED) + "SELECT ts::DATE AS day, count(*)::BIGINT AS visits FROM landings GROUP BY 1")
def a10_p28_daily_series(spark, d):
    return rollup.daily_series(b.landings(spark, d))


@query(b.sql(*LANDED) + "SELECT ts::DATE AS day, CASE WHEN video % 2 = 0 THEN 'left' ELSE 'right' END AS camera_side, flower_id, count(*)::BIGINT AS n_landings, (count(*) FILTER (is_real_landing = 1))::BIGINT AS n_real_landings, " + ", ".join(f"(count(*) FILTER (insect_type = '{t}'))::BIGINT AS n_{t}" for t in INSECT_TYPES) + " FROM landings GROUP BY 1, 2, 3")
def a11_p29_daily_counts(spark, d):
    rows = b.landings(spark, d)
    cameras = rows.select("video").distinct().withColumn("camera_side", F.when(F.col("video") % 2 == 0, "left").otherwise("right"))
    weather = spark.createDataFrame([(20.0, 1.5, 60.0)], "temp_c double, wind_ms double, humidity_pct double")
    return rollup.daily_counts(rollup.enriched(rows, cameras, weather))


@query(b.sql(*LANDED) + """, v AS (SELECT video, flower_id, insect_type, count(*) AS visits FROM landings GROUP BY 1, 2, 3), n AS (SELECT video, flower_id, """ + ", ".join(f"coalesce(sum(visits) FILTER (insect_type = '{t}'), 0)::BIGINT AS {t}" for t in ("bee", "beetle", "bug", "butterfly", "fly")) + """ FROM flowers LEFT JOIN v USING (video, flower_id) GROUP BY 1, 2)
SELECT *, bee + beetle + bug + butterfly + fly AS total, bee + butterfly + fly AS pollinator, beetle + bug AS non_pollinator FROM n""")
def a12_visit_table(spark, d):
    visits = b.landings(spark, d).groupBy("video", "flower_id", "insect_type").agg(F.count("*").alias("visits"))
    return rollup.visit_table(visits, b.flowers(spark, d), ["bee", "beetle", "bug", "butterfly", "fly"])


@query(b.sql(*LANDED) + ", r AS (SELECT *, row_number() OVER (ORDER BY ts DESC, track_id DESC, episode DESC) AS k FROM landings) SELECT count(*)::BIGINT AS landings, (count(*) FILTER (is_real_landing = 1))::BIGINT AS real, (count(*) FILTER (insect_type = 'honeybee'))::BIGINT AS honeybees, count(DISTINCT flower_id)::BIGINT AS flowers FROM r WHERE k <= 200")
def a28_t3_snapshot(spark, d):
    rows = b.landings(spark, d).withColumn("seq", F.struct("ts", "track_id", "episode"))
    return rollup.snapshot(rows)[0]


@query(b.sql(*LANDED) + """, p AS (SELECT video, flower_id, (count(*) FILTER (insect_type IN ('honeybee', 'bee', 'butterfly', 'fly')))::BIGINT AS pollinators, (count(*) FILTER (insect_type NOT IN ('honeybee', 'bee', 'butterfly', 'fly')))::BIGINT AS others, min(t_enter_s) AS a, max(t_exit_s) AS z FROM landings GROUP BY 1, 2)
SELECT video, flower_id, pollinators, others, round(max(z) OVER (PARTITION BY video) - min(a) OVER (PARTITION BY video), 2) AS span_s FROM p""")
def a34_observed(spark, d):
    return rollup.observed(b.landings(spark, d))


@query("SELECT n_name AS name, coalesce(c_custkey, 0) AS c_custkey, coalesce(s_suppkey, 0) AS s_suppkey FROM (SELECT n_name, c_custkey, NULL AS s_suppkey FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT n_name, NULL, s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey)")
def k2_u5_merged(spark, d):
    n = b.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    c, s = b.table(spark, d, "customer"), b.table(spark, d, "supplier")
    return rollup.merged([c.join(n, c["c_nationkey"] == n["n_nationkey"]).select("name", "c_custkey"), s.join(n, s["s_nationkey"] == n["n_nationkey"]).select("name", "s_suppkey")])
