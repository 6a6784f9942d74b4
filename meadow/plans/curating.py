"""Queries over file-like and label-like views of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from meadow.functions import geometry as g
from meadow.functions import taxonomy as tx
from meadow.operators import curation as c
from meadow.params import BEE_FAMILIES
from meadow.plans import bindings as b
from meadow.sources import readers, sinks

QUERIES, ORACLE = {}, {}
R = lambda x, n=6: F.round(x, n)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


NAMES = "WITH n AS (SELECT p_partkey, p_partkey || '_Animalia_Arthropoda_Insecta_' || CASE p_partkey % 5 WHEN 0 THEN 'Hymenoptera' WHEN 1 THEN 'Diptera' WHEN 2 THEN 'Lepidoptera' WHEN 3 THEN 'Coleoptera' ELSE CASE WHEN p_partkey % 2 = 0 THEN 'Odonata' ELSE '' END END || '_' || CASE p_partkey % 3 WHEN 0 THEN 'Apidae' WHEN 1 THEN 'Vespidae' ELSE 'Formicidae' END || '_' || CASE p_partkey % 7 WHEN 0 THEN ' Apis' ELSE 'Bombus' END || '_' || replace(p_name, ' ', '_') AS name FROM part)\n"


def _names(spark, d):
    p = b.table(spark, d, "part")
    k = F.col("p_partkey")
    order = F.when(k % 5 == 0, "Hymenoptera").when(k % 5 == 1, "Diptera").when(k % 5 == 2, "Lepidoptera").when(k % 5 == 3, "Coleoptera").otherwise(F.when(k % 2 == 0, "Odonata").otherwise(""))
    family = F.when(k % 3 == 0, "Apidae").when(k % 3 == 1, "Vespidae").otherwise("Formicidae")
    genus = F.when(k % 7 == 0, " Apis").otherwise("Bombus")
    return p.select("p_partkey", F.concat_ws("_", k, F.lit("Animalia"), F.lit("Arthropoda"), F.lit("Insecta"), order, family, genus, F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"))


TAXA = NAMES[:-1] + ", t AS (SELECT *, string_split(name, '_') AS p FROM n), x AS (SELECT p_partkey, p[1] AS tax_id, p[4] AS class, p[5] AS ord, p[6] AS family, p[7] AS genus, array_to_string(p[8:], '_') AS species FROM t)\n"
BEES = ", ".join(f"'{f}'" for f in BEE_FAMILIES)


@query(TAXA + "SELECT p_partkey, tax_id, ord, family, genus, species FROM x")
def p1_parse_taxon(spark, d):
    t = _names(spark, d).select("p_partkey", tx.parse_taxon(F.col("name")).alias("t"))
    return t.select("p_partkey", "t.tax_id", F.col("t.order").alias("ord"), "t.family", "t.genus", "t.species")


@query(TAXA + "SELECT p_partkey, tax_id, class, ord FROM x")
def p2_parse_short_taxonomy(spark, d):
    t = _names(spark, d).select("p_partkey", tx.parse_short_taxonomy(F.col("name")).alias("t"))
    return t.select("p_partkey", "t.tax_id", F.col("t.class").alias("class"), F.col("t.order").alias("ord"))


@query(TAXA + f"""SELECT p_partkey, class = 'Insecta' AS insect, ord = 'Hymenoptera' AND family IN ({BEES}) AS bee, lower(trim(genus)) = 'apis' AS honeybee,
CASE WHEN family IN ({BEES}) THEN 'bee' WHEN ord = 'Lepidoptera' THEN 'butterfly' WHEN family = 'Formicidae' THEN 'ant' WHEN ord = 'Coleoptera' THEN 'beetle' WHEN ord = 'Diptera' THEN 'fly' WHEN ord = 'Hymenoptera' THEN 'wasp' WHEN ord = 'Hemiptera' THEN 'bug' WHEN ord = '' THEN 'insect' ELSE lower(ord) END AS kind,
CASE ord WHEN 'Hymenoptera' THEN 'bee' WHEN 'Lepidoptera' THEN 'butterfly' WHEN 'Diptera' THEN 'fly' WHEN 'Coleoptera' THEN 'beetle' WHEN 'Hemiptera' THEN 'bug' END AS detector FROM x""")
def p3_p4_p5_p6_taxon_rules(spark, d):
    t = _names(spark, d).select("p_partkey", tx.parse_taxon(F.col("name")).alias("t"))
    o, f = F.col("t.order"), F.col("t.family")
    return t.select("p_partkey", tx.is_insecta(F.col("t.class")).alias("insect"), tx.is_bee(o, f).alias("bee"), tx.is_honeybee_genus(F.col("t.genus")).alias("honeybee"), tx.coarse_type(o, f).alias("kind"), tx.detector_class(o).alias("detector"))


@query(b.sql("detections") + "SELECT video, track_id, fi, least(1, greatest(0, (x1 + x2) / 2 / 1280)) AS x, least(1, greatest(0, (y1 + y2) / 2 / 720)) AS y, least(1, greatest(0, (x2 - x1) / 1280)) AS w, least(1, greatest(0, (y2 - y1) / 720)) AS h FROM detections WHERE x2 - x1 > 1 AND y2 - y1 > 1")
def p17_yolo(spark, d):
    x, y, w, h = g.yolo(g.box(), F.lit(1280.0), F.lit(720.0))
    return b.detections(spark, d).where("x2 - x1 > 1 AND y2 - y1 > 1").select("video", "track_id", "fi", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


P18 = """WITH s AS (SELECT p_partkey, (p_partkey % 100) / 100.0::DOUBLE AS x, (p_partkey % 90) / 90.0::DOUBLE AS y, (p_partkey % 41) / 40.0::DOUBLE AS bw, (p_partkey % 37) / 36.0::DOUBLE AS bh FROM part),
o AS (SELECT p_partkey, CASE WHEN ok THEN x ELSE 0.5 END AS x, CASE WHEN ok THEN y ELSE 0.5 END AS y, CASE WHEN ok THEN bw ELSE 0.92 END AS bw, CASE WHEN ok THEN bh ELSE 0.92 END AS bh FROM (SELECT *, bw * bh BETWEEN 0.02 AND 0.985 AS ok FROM s))
SELECT p_partkey, least(641, greatest(0, round_even((x - bw / 2) * 641, 0))) AS x1, least(481, greatest(0, round_even((y + bh / 2) * 481, 0))) AS y2 FROM o"""


@query(P18)
def p18_from_yolo(spark, d):
    k = F.col("p_partkey")
    p = b.table(spark, d, "part").select("p_partkey", ((k % 100) / 100.0).alias("x"), ((k % 90) / 90.0).alias("y"), ((k % 41) / 40.0).alias("w"), ((k % 37) / 36.0).alias("h"))
    box = g.from_yolo(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(641.0), F.lit(481.0))
    return p.select("p_partkey", box[0].alias("x1"), box[3].alias("y2"))


@query("SELECT doc_id, 'v' || doc_id % 3 AS version, CASE doc_id % 2 WHEN 0 THEN 'train' ELSE 'val' END AS split, lang AS cls, 'v' || doc_id % 3 || '_' || lang || '_' || doc_id || '.JPG' AS name, lang || '/' || doc_id || '.JPG' AS label FROM documents WHERE doc_id % 4 <> 3")
def p19_p20_sources(spark, d):
    k = F.col("doc_id")
    ext = F.when(k % 4 == 3, ".txt").otherwise(".JPG")
    split = F.when(k % 2 == 0, "train").otherwise("val")
    path = F.concat_ws("/", F.concat(F.lit("v"), k % 3), split, "lang", F.concat(k.cast("string"), ext))
    t = b.table(spark, d, "documents").select("doc_id", path.alias("path")).withColumn("s", tx.source_of(F.col("path"))).where("s IS NOT NULL")
    return t.select("doc_id", "s.version", "s.split", "s.cls", "s.name", tx.label_name(F.col("path"), "v[0-9]+/(train|val)/").alias("label"))


@query(b.sql("files") + "SELECT path, cls, (dense_rank() OVER (ORDER BY cls) - 1)::INT AS class_id, cls = 'en' AS is_bee FROM files")
def p21_w9_class_ids(spark, d):
    return c.class_ids(b.files(spark, d).select("path", "cls")).withColumn("class_id", F.col("class_id").cast("int")).withColumn("is_bee", F.col("cls") == "en")


@query(b.sql("files") + "SELECT path, h AS md5, CASE WHEN path <> min(path) OVER (PARTITION BY h) THEN min(path) OVER (PARTITION BY h) END AS duplicate_of FROM files")
def d1_w7_exact_duplicates(spark, d):
    return c.exact_duplicates(b.files(spark, d).select("path", "content")).select("path", "md5", "duplicate_of")


@query(b.sql("files") + "SELECT h AS hash, count(*)::BIGINT AS n, min(path) AS first FROM files GROUP BY 1 HAVING count(*) > 1")
def d2_same_hash_groups(spark, d):
    return c.same_hash_groups(b.files(spark, d).withColumn("hash", F.md5("content")))


@query(b.sql("vec") + """, f AS (SELECT cls, hash, min(id) AS id FROM vec GROUP BY 1, 2)
SELECT a.id AS a, b.id AS b, bit_count(xor(a.hash, b.hash))::INT AS distance FROM f a JOIN f b ON a.cls = b.cls AND a.id < b.id AND bit_count(xor(a.hash, b.hash)) <= 2
UNION ALL SELECT f.id, v.id, 0 FROM vec v JOIN f ON f.cls = v.cls AND f.hash = v.hash AND f.id <> v.id""")
def d3_f10_near_hash_pairs(spark, d):
    return c.near_hash_pairs(b.vectors(spark, d), most=2, bits=16)


GRP = b.sql("vec").replace("WITH ", "WITH RECURSIVE ", 1) + """, e AS (SELECT a.id AS a, b.id AS b FROM vec a JOIN vec b ON a.cls = b.cls AND a.id <> b.id AND bit_count(xor(a.hash, b.hash)) <= 2),
r AS (SELECT id, id AS to_ FROM vec UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.to_), grp AS (SELECT id, min(to_) AS grp FROM r GROUP BY 1)
"""


@query(GRP + "SELECT id, grp FROM grp")
def d4_groups(spark, d):
    v = b.vectors(spark, d)
    return c.groups_of(v.select("id"), c.near_hash_pairs(v, most=2, bits=16)).select("id", "grp")


@query(GRP + "SELECT grp, count(DISTINCT split)::BIGINT AS splits, count(*)::BIGINT AS n FROM (SELECT grp, CASE WHEN id % 10 < 7 THEN 'train' WHEN id % 10 = 7 THEN 'val' ELSE 'test' END AS split FROM grp) GROUP BY 1 HAVING count(DISTINCT split) > 1")
def d6_d7_leaking_groups(spark, d):
    v = b.vectors(spark, d)
    at = F.col("id") % 10
    rows = c.groups_of(v.select("id"), c.near_hash_pairs(v, most=2, bits=16)).withColumn("split", F.when(at < 7, "train").when(at == 7, "val").otherwise("test"))
    return c.leaking_groups(rows)


@query(b.sql("files") + ", r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY md5('42|' || path), path) AS k, count(*) OVER (PARTITION BY cls) AS n FROM files), e AS (SELECT *, floor(round(n * 0.7, 9))::BIGINT AS f1, floor(round(n * 0.15, 9))::BIGINT AS f2, round(n * 0.7 - floor(round(n * 0.7, 9)), 9) AS r1, round(n * 0.15 - floor(round(n * 0.15, 9)), 9) AS r2 FROM r), q AS (SELECT *, n - f1 - 2 * f2 AS rest, CASE WHEN r2 > r1 THEN 2 ELSE 0 END AS b1, CASE WHEN r1 >= r2 THEN 1 ELSE 0 END AS b2 FROM e), z AS (SELECT *, f1 + CASE WHEN b1 < rest THEN 1 ELSE 0 END AS q1, f2 + CASE WHEN b2 < rest THEN 1 ELSE 0 END AS q2 FROM q) SELECT path, CASE WHEN k <= q1 THEN 'train' WHEN k <= q1 + q2 THEN 'val' ELSE 'test' END AS split FROM z")
def w8_stratified(spark, d):
    return c.stratified(b.files(spark, d).select("path", "cls")).select("path", "split")


SPLIT = b.sql("files").replace("WITH ", "WITH RECURSIVE ", 1) + """, z AS (SELECT cls, folder, count(*)::BIGINT AS n FROM files GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY md5('1337|' || folder), folder) AS k, sum(n) OVER (PARTITION BY cls)::DOUBLE AS total FROM z),
walk AS (SELECT cls, 0::BIGINT AS k, 0::DOUBLE AS a, 0::DOUBLE AS v, 0::DOUBLE AS t, NULL::VARCHAR AS folder, NULL::BIGINT AS n, NULL::VARCHAR AS split FROM (SELECT DISTINCT cls FROM files) UNION ALL
  SELECT cls, k, CASE best WHEN 1 THEN a + n ELSE a END, CASE best WHEN 2 THEN v + n ELSE v END, CASE best WHEN 3 THEN t + n ELSE t END, folder, n, ['train', 'val', 'test'][best] FROM (
    SELECT o.cls, o.k, w.a, w.v, w.t, o.folder, o.n, list_position([round(o.total * 0.8 - w.a, 9), round(o.total * 0.1 - w.v, 9), round(o.total * 0.1 - w.t, 9)], greatest(round(o.total * 0.8 - w.a, 9), round(o.total * 0.1 - w.v, 9), round(o.total * 0.1 - w.t, 9))) AS best FROM walk w JOIN o ON o.cls = w.cls AND o.k = w.k + 1))
"""


@query(SPLIT + "SELECT cls, folder AS grp, split, n FROM walk WHERE k > 0")
def d5_grouped_split(spark, d):
    rows = b.files(spark, d).select("path", "cls", F.col("folder").alias("grp"))
    return c.grouped_split(rows).groupBy("cls", "grp", "split").agg(F.count("*").alias("n"))


@query(b.sql("files") + ", f AS (SELECT folder, row_number() OVER (ORDER BY md5('42|' || folder), folder) AS k, greatest(1, count(*) OVER () // 10) AS t FROM (SELECT DISTINCT folder FROM files)) SELECT path, CASE WHEN k <= t THEN 'val' WHEN k <= 2 * t THEN 'test' ELSE 'train' END AS split FROM files JOIN f ON f.folder = files.folder")
def d8_folder_split(spark, d):
    return c.folder_split(b.files(spark, d).select("path", "folder")).select("path", "split")


@query(b.sql("files") + "SELECT path, cls FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY md5('42|' || path), path) AS k FROM files) WHERE k <= 20")
def w10_t7_capped(spark, d):
    return c.capped(b.files(spark, d).select("path", "cls"), ["cls"], 20, "path")


@query(b.sql("files") + "SELECT path FROM files ORDER BY md5('42|' || path), path LIMIT 100")
def t5_t6_seeded_sample(spark, d):
    return c.downsampled(b.files(spark, d).select("path"), 100, "path")[0]


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1")
def d11_one_per(spark, d):
    return c.one_per(b.table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey")


@query("SELECT (count(*) FILTER (quality = 1))::BIGINT AS kept, (count(*) FILTER (quality IS DISTINCT FROM 1))::BIGINT AS removed FROM labels")
def d13_separated(spark, d):
    kept, gone = c.separated(b.table(spark, d, "labels"), F.col("quality") == 1)
    return kept.agg(F.count("*").alias("kept")).join(gone.agg(F.count("*").alias("removed")))


@query("SELECT id, split, CASE WHEN k = 0 THEN name ELSE replace(name, '.jpg', '_' || k || '.jpg') END AS new_name FROM (SELECT doc_id AS id, lang AS split, source || '.jpg' AS name, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1 AS k FROM documents)")
def w14_renamed(spark, d):
    rows = b.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("split"), F.concat("source", F.lit(".jpg")).alias("name"))
    return c.renamed(rows, "split", "name", "id").select("id", "split", "new_name")


@query("SELECT o_orderkey AS id, count(l_orderkey)::INT AS n, coalesce(sum(l_linenumber), 0)::BIGINT AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def j12_images_with_boxes(spark, d):
    images = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    boxes = b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("x"))
    out = c.images_with_boxes(images, boxes)
    return out.select("id", F.size("boxes").alias("n"), F.aggregate("boxes", F.lit(0).cast("long"), lambda a, x: a + x["x"]).alias("total"))


@query("SELECT o_orderkey AS file_name, c_acctbal AS width, n_name AS category FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = o_orderkey % 30")
def j13_original_category(spark, d):
    o, cu = b.table(spark, d, "orders"), b.table(spark, d, "customer")
    images = o.select(F.col("o_orderkey").alias("file_name"), (F.col("o_orderkey") % 30).alias("dir"))
    dims = o.join(cu, o["o_custkey"] == cu["c_custkey"]).select(F.col("o_orderkey").alias("file_name"), F.col("c_acctbal").alias("width"))
    cats = b.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("dir"), F.col("n_name").alias("category"), F.col("n_nationkey").alias("ordinal"))
    return c.with_original_category(images, dims, cats).select("file_name", "width", "category")


@query("SELECT u.user_id, count(*)::BIGINT AS visits FROM (SELECT o_custkey % 100 AS user_id, o_orderkey FROM orders WHERE o_custkey % 100 = 7) u JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def j14_s14_user_visits(spark, d):
    videos = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).alias("user_id"))
    visits = b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("video_id"))
    return readers.user_visits(visits, videos, 7).agg(F.lit(7).cast("long").alias("user_id"), F.count("*").alias("visits"))


@query("SELECT l_shipdate::DATE AS day, count(*)::BIGINT AS visits FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def j15_left_joined_series(spark, d):
    """The join keeps every row and nothing of the right side is read, so Catalyst drops it."""
    from meadow.operators.rollup import daily_series

    o = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")).distinct()
    return daily_series(b.table(spark, d, "lineitem").select("l_orderkey", "l_shipdate").join(o, "l_orderkey", "left"), "l_shipdate")


@query("SELECT (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))::BIGINT AS only_left, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))::BIGINT AS only_right")
def j16_j19_u3_only_in(spark, d):
    left, right = c.only_in(b.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), b.table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")
    return left.agg(F.count("*").alias("only_left")).join(right.agg(F.count("*").alias("only_right")))


@query("SELECT (SELECT count(*) FROM documents d JOIN labels l ON l.doc_id = d.doc_id)::BIGINT AS known, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))::BIGINT AS todo")
def j22_i5_cached_hashes(spark, d):
    files = b.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.lit(1).alias("size"), F.lit(2).alias("mtime"))
    cache = b.table(spark, d, "labels").select(F.col("doc_id").alias("path"), F.lit(1).alias("size"), F.lit(2).alias("mtime"), F.lit("x").alias("hash"))
    known, todo = c.cached_hashes(files, cache)
    return known.agg(F.count("*").alias("known")).join(todo.agg(F.count("*").alias("todo")))


@query("SELECT lang, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def a13_distribution(spark, d):
    return c.distribution(b.table(spark, d, "documents"), "lang")


@query("SELECT source, " + ", ".join(f"(count(*) FILTER (lang = '{x}'))::BIGINT AS {x}" for x in ("de", "en", "es", "fr")) + " FROM documents GROUP BY 1")
def a14_matrix(spark, d):
    return c.matrix(b.table(spark, d, "documents").select("source", "lang"), "source", "lang", ["de", "en", "es", "fr"])


@query("WITH n AS (SELECT count(*)::DOUBLE AS x FROM documents GROUP BY source), r AS (SELECT x, row_number() OVER (ORDER BY x) AS i FROM n), a AS (SELECT max(x) / min(x) AS ratio, 2 * sum(x * i) / (count(*) * sum(x)) - (count(*) + 1) / count(*)::DOUBLE AS gini FROM r) SELECT round(ratio, 6) AS ratio, round(gini, 6) AS gini, ratio > 10 OR gini > 0.4 AS rebalance FROM a")
def a15_a30_imbalance(spark, d):
    n = b.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return c.imbalance(n).select(R(F.col("ratio")).alias("ratio"), R(F.col("gini")).alias("gini"), "rebalance")


@query("SELECT lang AS split, n, flagged, round(n / sum(n) OVER (), 6) AS share FROM (SELECT lang, count(*)::BIGINT AS n, (count(*) FILTER (source = 'src0'))::BIGINT AS flagged FROM documents GROUP BY 1)")
def a16_split_report(spark, d):
    rows = b.table(spark, d, "documents").select(F.col("lang").alias("split"), (F.col("source") == "src0").cast("int").alias("is_bee"))
    return c.split_report(rows).withColumn("share", R(F.col("share")))


@query("SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))::BIGINT AS missing, 0::BIGINT AS unlisted, 0::BIGINT AS repeated, 0::BIGINT AS in_several_splits, 0::BIGINT AS ambiguous_ids, (SELECT count(*) FROM documents WHERE doc_id % 7 = 0)::BIGINT AS bad_split, false AS passed")
def a17_t8_integrity(spark, d):
    k = F.col("doc_id")
    manifest = b.table(spark, d, "documents").select(k.alias("path"), F.col("lang").alias("cls"), F.length("lang").alias("class_id"), F.when(k % 7 == 0, "other").otherwise("train").alias("split"))
    return c.integrity(manifest, b.table(spark, d, "labels").select(k.alias("path"))).drop("examples")


@query("SELECT count(*)::BIGINT AS classes, (count(*) FILTER (s = 4))::BIGINT AS covered, bool_and(s = 4) AS all_covered FROM (SELECT source, count(DISTINCT lang) AS s FROM documents GROUP BY 1)")
def a18_coverage(spark, d):
    return c.coverage(b.table(spark, d, "documents"), "source", "lang", 4)


@query("SELECT count(*)::BIGINT AS files, count(DISTINCT p_brand)::BIGINT AS n_cls, count(DISTINCT p_type)::BIGINT AS n_order, count(DISTINCT p_size)::BIGINT AS n_family, sum(p_partkey)::BIGINT AS bytes, round(avg(p_partkey), 6) AS mean_bytes FROM part")
def a19_overview(spark, d):
    p = b.table(spark, d, "part").select(F.col("p_brand").alias("cls"), F.col("p_type").alias("order"), F.col("p_size").alias("family"), F.col("p_partkey").alias("bytes"))
    return c.overview(p).withColumn("mean_bytes", R(F.col("mean_bytes")))


@query("SELECT lang, min(n_chars) AS low, median(n_chars) AS median, max(n_chars) AS top, count(n_chars)::BIGINT AS n, list_sort(list(n_chars))[(count(*) // 2 + 1)::INT] AS upper_median FROM documents GROUP BY 1")
def a20_spread(spark, d):
    return c.spread(b.table(spark, d, "documents"), "n_chars", ("lang",))


@query("SELECT lang AS split, count(*)::BIGINT AS n, (count(*) FILTER (doc_id % 5 = 0))::BIGINT AS removed, (count(*) FILTER (doc_id % 5 = 1))::BIGINT AS corrupt FROM documents GROUP BY 1")
def a29_a33_profile(spark, d):
    at = F.col("doc_id") % 5
    return c.profile(b.table(spark, d, "documents").select(F.col("lang").alias("split"), F.when(at == 0, "removed").when(at == 1, "corrupt").otherwise("kept").alias("status")))


@query("SELECT lang AS split, 'i' || doc_id AS image, doc_id % 5 || ' ' || '0.500000 0.250000 0.100000 0.200000' AS value FROM documents")
def k9_yolo_lines(spark, d):
    rows = b.table(spark, d, "documents").select(F.col("lang").alias("split"), F.concat(F.lit("i"), "doc_id").alias("image"), (F.col("doc_id") % 5).alias("cls"), *[F.lit(v).alias(n) for n, v in (("x", 0.5), ("y", 0.25), ("w", 0.1), ("h", 0.2))])
    return sinks.yolo_lines(rows)


@query("SELECT lang AS split, count(*)::BIGINT AS images, (count(*) - 1)::BIGINT AS last_id FROM documents GROUP BY 1")
def k8_dense_labels(spark, d):
    docs = b.table(spark, d, "documents").select(F.col("lang").alias("split"), F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("file_name"))
    ann = docs.select(F.col("id").alias("image_id"), (F.col("id") % 5).cast("int").alias("category_id"))
    cats = b.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    out = c.dense_labels(docs, ann, cats)
    return out.select("split", F.size("images").cast("long").alias("images"), F.array_max(F.transform("images", lambda x: x["id"])).cast("long").alias("last_id"))


@query("SELECT p_type AS ord, count(*)::BIGINT AS n FROM part GROUP BY 1 ORDER BY n DESC, ord LIMIT 20")
def t2_top_orders(spark, d):
    return c.distribution(b.table(spark, d, "part").select(F.col("p_type").alias("ord")), "ord").limit(20)


@query("SELECT doc_id, lang, source, row_number() OVER (ORDER BY lang, source, doc_id)::INT AS place FROM documents")
def t1_manifest_order(spark, d):
    rows = b.table(spark, d, "documents").select("doc_id", "lang", "source")
    return c.numbered(rows, "lang", "source", "doc_id").withColumn("place", F.col("place").cast("int"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 25")
def t4_newest(spark, d):
    return c.newest(b.table(spark, d, "orders"), "o_orderdate", "o_orderkey", 25).select("o_custkey", "o_orderkey")


@query("SELECT 'documents' AS split, count(*)::BIGINT AS n FROM documents GROUP BY 1 UNION ALL SELECT 'pages', count(*) FROM pages")
def u1_pool(spark, d):
    splits = {"documents": b.table(spark, d, "documents").select(F.col("doc_id").alias("id")), "pages": b.table(spark, d, "pages").select(F.col("page_id").alias("id"))}
    return c.pool(splits).groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT n_name AS name, n, string_split(n_name, ' ')[1] AS short, printf('%.1f%%', n * 100.0 / sum(n) OVER ()) AS pct FROM (SELECT n_name, count(*)::BIGINT AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)")
def p32_readable(spark, d):
    cu, n = b.table(spark, d, "customer"), b.table(spark, d, "nation")
    return c.readable(cu.join(n, cu["c_nationkey"] == n["n_nationkey"]).groupBy(F.col("n_name").alias("name")).agg(F.count("*").alias("n")))


@query("SELECT lower(event_type) IN ('click', 'view') AS good, count(*)::BIGINT AS n FROM events GROUP BY 1")
def p27_j17_flags(spark, d):
    from meadow.operators.episodes import weight

    return b.table(spark, d, "events").groupBy((weight(F.lower("event_type"), {"click": 1.0, "view": 1.0}, 0.0) == 1).alias("good")).agg(F.count("*").alias("n"))
