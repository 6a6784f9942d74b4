"""Queries that write a table with a sink and read it back with a reader: what comes back is the table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meadow.functions.shared import staged
from meadow.operators import curation as c
from meadow.operators import detections as det
from meadow.operators import images, reports
from meadow.plans import bindings as b
from meadow.plans.landing import LANDED, SUMMARY, a1_u2_flower_summary
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


def laid_out(df: DataFrame, schema: str, *without: str) -> DataFrame:
    """df with the columns of a file layout, in its order; what df lacks is null."""
    have = set(df.columns)
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return df.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in fields if n not in without])


@query(b.sql(*LANDED) + "SELECT 'v' || video AS video, flower_id, track_id::INT AS track_id, insect_type, t_enter_s, t_exit_s, landing_s, is_real_landing, pollination_weight, conf_mean FROM landings")
def s3_k1_k12_per_video(spark, d):
    """Landings written by video, those of a video replaced, and read back."""
    rows = b.landings(spark, d).withColumn("video", F.concat(F.lit("v"), "video"))
    table = staged(laid_out(rows, readers.LANDINGS), "landings").select(*[n.split()[0] for n in readers.LANDINGS.split(", ")[1:]], "video")
    at = b.folder(spark, "landings")
    sinks.by_video(table, at)
    sinks.by_video(table.where("video = 'v0'"), at)
    back = readers.per_video(spark, at)
    return back.select("video", "flower_id", "track_id", "insect_type", "t_enter_s", "t_exit_s", "landing_s", "is_real_landing", "pollination_weight", "conf_mean")


@query(SUMMARY + "SELECT printf('%d flowers, %d real landings, %d by honeybees, score %.1f', count(*), sum(n_real_landings)::BIGINT, sum(n_honeybee)::BIGINT, round(sum(pollination_score), 1)) AS line FROM summary")
def a32_s2_context_line(spark, d):
    at = b.folder(spark, "summary")
    laid_out(a1_u2_flower_summary(spark, d), readers.SUMMARY).write.option("header", True).csv(at)
    return reports.context_line(readers.summary(spark, at))


@query("SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def s4_tab_separated(spark, d):
    at = b.folder(spark, "tsv")
    b.table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice").write.options(header=True, sep="\t").csv(at)
    return readers.tab_separated(spark, at, "p_partkey bigint, p_name string, p_brand string, p_size int, p_retailprice double")


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT')::BIGINT AS images, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'))::BIGINT AS annotations, (SELECT count(DISTINCT l_suppkey) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT')::BIGINT AS categories")
def j11_s5_coco_filtered(spark, d):
    """A label document for each month of orders, written, read back and filtered to the images that are left."""
    o, li, s = (b.table(spark, d, t) for t in ("orders", "lineitem", "supplier"))
    month = F.date_format("o_orderdate", "yyyy-MM").alias("split")
    none = F.lit(None)
    shot = F.struct(F.col("o_orderkey").alias("id"), F.concat(F.col("o_orderkey"), F.lit(".jpg")).alias("file_name"), none.cast("int").alias("width"), none.cast("int").alias("height"))
    images_ = o.groupBy(month).agg(F.collect_list(shot).alias("images"))
    box = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("image_id"), F.col("l_suppkey").alias("category_id"), F.array(F.lit(0.0), F.lit(0.0), F.col("l_quantity"), F.lit(1.0)).alias("bbox"))
    marks = li.join(o.select("o_orderkey", month), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("split").agg(F.collect_list(box).alias("annotations"))
    kinds = s.agg(F.collect_list(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))).alias("categories"))
    at = b.folder(spark, "labels")
    sinks.label_documents(images_.join(marks, "split").join(kinds), at)
    i, a, k = readers.coco(spark, at)
    alive = o.where("o_orderpriority = '1-URGENT'").select(F.concat(F.col("o_orderkey"), F.lit(".jpg")).alias("file_name"))
    i, a, k = c.coco_filtered(i, a, k.select("id", "name").distinct(), alive)
    return i.agg(F.count("*").alias("images")).join(a.agg(F.count("*").alias("annotations"))).join(k.agg(F.count("*").alias("categories")))


MANIFEST = "SELECT 'd/' || doc_id || '.jpg' AS path, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END::INT AS class_id, lang AS class_name, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 = 7 THEN 'val' ELSE 'test' END AS split, CASE WHEN doc_id % 11 = 0 THEN 'removed' ELSE 'kept' END AS status FROM documents"


def _manifest(spark, d) -> DataFrame:
    k = F.col("doc_id")
    cls = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "en", 1).when(F.col("lang") == "es", 2).otherwise(3)
    split = F.when(k % 10 < 7, "train").when(k % 10 == 7, "val").otherwise("test")
    rows = b.table(spark, d, "documents").select(F.concat(F.lit("d/"), k.cast("string"), F.lit(".jpg")).alias("path"), cls.alias("class_id"), F.col("lang").alias("class_name"), split.alias("split"), F.when(k % 11 == 0, "removed").otherwise("kept").alias("status"))
    return laid_out(rows, readers.MANIFEST)


@query(f"WITH m AS ({MANIFEST}) SELECT 'manifest' AS log, path, class_id, class_name, split FROM m WHERE status = 'kept' UNION ALL SELECT 'removed', path, class_id, class_name, split FROM m WHERE status = 'removed'")
def k6_s8_manifest(spark, d):
    """Manifest and removal log by the sink, twice: a run that removes nothing leaves the log alone."""
    rows, at = _manifest(spark, d), b.folder(spark, "manifest")
    sinks.manifest(rows.where("status = 'kept'"), rows.where("status = 'removed'"), at)
    sinks.manifest(rows.where("status = 'kept'"), rows.limit(0), at)
    logs = [readers.manifest(spark, f"{at}/{name}").select(F.lit(name).alias("log"), "path", "class_id", "class_name", "split") for name in ("manifest", "removed")]
    return logs[0].unionByName(logs[1])


@query(f"SELECT path, class_id, split FROM ({MANIFEST}) WHERE status = 'kept'")
def s9_k10_kept_assignments(spark, d):
    at = b.folder(spark, "assignments")
    sinks.annotations(_manifest(spark, d), at, "class_id", "path")
    return readers.kept_assignments(spark, at).select("path", "class_id", "split")


@query(f"WITH m AS ({MANIFEST}) SELECT 'class ' || class_name AS name, class_id::BIGINT AS n FROM m GROUP BY ALL UNION ALL SELECT 'split ' || split, count(*)::BIGINT FROM m GROUP BY split")
def k7_class_index(spark, d):
    at = b.folder(spark, "index")
    sinks.class_index(_manifest(spark, d).select(F.col("class_name").alias("cls"), "class_id", "split"), at)
    back = spark.read.schema("class_to_id map<string,bigint>, splits map<string,bigint>").json(at)
    each = [back.select(F.explode(m).alias("k", "n")).select(F.concat(F.lit(f"{word} "), "k").alias("name"), "n") for m, word in (("class_to_id", "class"), ("splits", "split"))]
    return each[0].unionByName(each[1])


@query(f"SELECT split, path FROM ({MANIFEST})")
def k11_split_lists(spark, d):
    at = b.folder(spark, "lists")
    sinks.split_lists(_manifest(spark, d), at)
    return spark.read.schema("value string, split string").text(at).select("split", F.col("value").alias("path"))


@query("SELECT 'v' || doc_id AS video, n_chars::BIGINT AS visits, '1.0' AS report_version FROM documents")
def s10_k13_facts(spark, d):
    """Facts documents as one JSON row each; the version that they lack is filled in."""
    at = b.folder(spark, "facts")
    rows = b.table(spark, d, "documents").select(F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("video"), F.col("n_chars").alias("visits"))
    sinks.report(rows, at, blessed=("/blessed/curve",))
    back = spark.read.schema(readers.FACTS).json(at)
    return readers.versioned(back).select("video", "visits", "report_version")


@query("SELECT avg(c_acctbal) AS temp_c, count(*)::DOUBLE AS wind_ms, NULL::DOUBLE AS humidity_pct FROM customer")
def s11_weather(spark, d):
    at = b.folder(spark, "weather")
    b.table(spark, d, "customer").agg(F.avg("c_acctbal").alias("temp_c"), F.count("*").cast("double").alias("wind_ms")).coalesce(1).write.json(at)
    return readers.weather(spark, at).withColumn("temp_c", F.round("temp_c", 6))


@query("SELECT n_nationkey AS n, CASE WHEN n_nationkey % 2 = 0 THEN 'side' || n_nationkey ELSE 'cam' || n_nationkey END AS side, 'rtsp://' || n_name AS source FROM nation")
def s12_camera_sources(spark, d):
    """A list of sources, one line per nation, a comment above; lines without a side count as cameras."""
    at = b.folder(spark, "sources")
    k = F.col("n_nationkey")
    line = F.concat(F.when(k % 2 == 0, F.concat(F.lit("side"), k, F.lit("="))).otherwise(""), F.lit("rtsp://"), "n_name")
    rows = b.table(spark, d, "nation").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(k.alias("k"), line.alias("line")))), lambda x: x["line"]), "\n").alias("value"))
    rows.select(F.concat(F.lit("# sources\n"), "value", F.lit("\n\n")).alias("value")).coalesce(1).write.text(at)
    return readers.camera_sources(spark, at)


@query("SELECT s_suppkey, s_name FROM supplier")
def s13_first_usable(spark, d):
    """A folder that isn't there, a table of a header only, and one with rows."""
    none, empty, full = (b.folder(spark, n) for n in ("none", "empty", "full"))
    rows = b.table(spark, d, "supplier").select("s_suppkey", "s_name")
    rows.limit(0).coalesce(1).write.option("header", True).csv(empty)
    rows.write.option("header", True).csv(full)
    return readers.first_usable([lambda p=p: readers.csv(spark, p, "s_suppkey bigint, s_name string") for p in (none, empty, full)])


@query("SELECT s_name AS crop, (s_suppkey % 40) / 100.0::DOUBLE AS F0, 0.9::DOUBLE AS Fmax, s_suppkey / 7.0::DOUBLE AS k, NULL::DOUBLE AS k_hi FROM supplier")
def s17_saved_curves(spark, d):
    at = b.folder(spark, "curves")
    k = F.col("s_suppkey")
    curve = F.struct(((k % 40) / F.lit(100.0)).alias("F0"), F.lit(0.9).alias("Fmax"), (k / F.lit(7.0)).alias("k"))
    b.table(spark, d, "supplier").select(F.to_json(F.create_map("s_name", curve)).alias("value")).repartition(1).write.text(at)
    return readers.saved_curves(spark, at, one_per_line=True).select("crop", "F0", "Fmax", "k", "k_hi")


@query("SELECT arg_max(l_orderkey, l_extendedprice)::DOUBLE AS l_orderkey, max(l_extendedprice) AS l_extendedprice FROM lineitem")
def a25_s15_best_row(spark, d):
    """A training log with padded names, an epoch for each line item; the best one by price."""
    at = b.folder(spark, "log")
    rows = b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("  l_orderkey"), F.col("l_extendedprice").alias("   l_extendedprice"))
    rows.write.options(header=True, ignoreLeadingWhiteSpace=False).csv(at)
    return readers.best_epoch(readers.training_metrics(spark, at), "l_extendedprice")


@query("SELECT o_orderkey, o_custkey, coalesce(c_acctbal, 0) AS c_acctbal FROM (SELECT o_orderkey, o_custkey, NULL AS c_acctbal FROM orders UNION ALL SELECT 0, c_custkey, c_acctbal FROM customer)")
def k2_merge_tables(spark, d):
    at = b.folder(spark, "merged")
    sinks.merge_tables([b.table(spark, d, "orders").select("o_orderkey", "o_custkey"), b.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")], at)
    return spark.read.schema("o_orderkey bigint, o_custkey bigint, c_acctbal double").option("header", True).csv(at)


# Images: a vector of 64 components is a picture of 8 by 8, one byte each.

BYTES = "px AS (SELECT 'vec_' || vec_id AS path, vec_id, [least(255, greatest(0, floor((x + 3) / 6 * 255)))::DOUBLE FOR x IN embedding::DOUBLE[]] AS p FROM embeddings)"


def _drawn(spark, d) -> DataFrame:
    byte = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 3) / 6 * 255))).cast("int")
    data = F.unhex(F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(byte(x)), 2, "0")), ""))
    bad = F.col("vec_id") % 50 == 0
    return b.table(spark, d, "embeddings").select(
        F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("path"), F.when(bad, -1).otherwise(8).alias("height"), F.when(bad, -1).otherwise(8).alias("width"), F.when(bad, -1).otherwise(1).alias("n_channels"), F.when(~bad, data).alias("data"), "label"
    )


def pictures(spark, d) -> DataFrame:
    """What images.images gives; every 50th can't be decoded."""
    return _drawn(spark, d).drop("label")


def picture_files(spark, d) -> str:
    """The pictures as PNG files, in a folder for each label; every 50th holds other bytes, and beside them lie notes.

    Rows are few bytes and files take time, so rows are dealt over the cores."""
    at = b.folder(spark, "pictures")
    rows = _drawn(spark, d).where("path IS NOT NULL")
    named = rows.withColumn("path", F.concat(F.col("label").cast("string"), F.lit("/"), F.col("path"), F.lit(".png"))).withColumn("data", F.coalesce("data", F.encode(F.lit("no picture"), "utf-8")))
    notes = rows.groupBy("label").agg(F.lit(-1).alias("height"), F.lit(-1).alias("width"), F.lit(-1).alias("n_channels"), F.encode(F.lit("a note"), "utf-8").alias("data")).withColumn("path", F.concat(F.col("label").cast("string"), F.lit("/notes.txt")))
    written = sinks.pictures(named.drop("label").repartition(4 * spark.sparkContext.defaultParallelism), at).count(), sinks.pictures(notes, at).count()
    if not written[0]:
        raise ValueError("there are no pictures")
    return at


def seen_pictures(spark, d) -> DataFrame:
    """The picture files as Spark's image source reads them, named like their vectors."""
    read = images.images(spark, picture_files(spark, d)).where(F.col("path").endswith(".png"))
    return read.withColumn("path", F.regexp_extract("path", r"([^/]+)\.png$", 1))


@query("SELECT 'vec_' || vec_id AS name, label::VARCHAR AS cls FROM embeddings")
def s6_image_tree(spark, d):
    """A tree of image files: their names and the folders that are their classes, notes left out."""
    return readers.image_files(spark, picture_files(spark, d)).where("bytes > 0").select(F.regexp_extract("path", r"([^/]+)\.png$", 1).alias("name"), "cls")


@query(f"WITH {BYTES} SELECT path, 8 AS height, 8 AS width, 1 AS n_channels, list_sum([p[i] * i FOR i IN range(1, 65)])::BIGINT AS pixels FROM px WHERE vec_id % 50 <> 0")
def s7_decoded(spark, d):
    """Size, channels and pixels (a sum weighted by place) of the files that can be decoded."""
    byte = lambda i: F.conv(F.hex(F.substring("data", i, 1)), 16, 10).cast("long")
    return seen_pictures(spark, d).where("height > 0").select("path", "height", "width", "n_channels", sum((byte(i) * i for i in range(2, 65)), byte(1)).alias("pixels"))


@query("SELECT 'vec_' || vec_id AS path, 'can''t be decoded' AS error FROM embeddings WHERE vec_id % 50 = 0")
def i1_corrupt(spark, d):
    return images.corrupt(seen_pictures(spark, d))


LOOKS = f"""WITH {BYTES}, lap AS (SELECT path, p, [p[i - 8] + p[i + 8] + p[i - 1] + p[i + 1] - 4 * p[i] FOR i IN [(k // 6 + 1) * 8 + k % 6 + 2 FOR k IN range(36)]] AS l FROM px WHERE vec_id % 50 <> 0),
looks AS (SELECT path, list_avg(p) AS brightness, list_stddev_pop(p) AS contrast, list_var_pop(l) AS blur FROM lap)
"""


@query(LOOKS + "SELECT path, round(brightness, 6) AS brightness, round(contrast, 6) AS contrast, round(blur, 4) AS blur, 'L' AS mode, true AS grayscale, contrast < 1 AS blank FROM looks")
def i2_i3_x3_statistics(spark, d):
    s = images.statistics(seen_pictures(spark, d))
    return s.select("path", R(F.col("brightness")).alias("brightness"), R(F.col("contrast")).alias("contrast"), F.round("blur", 4).alias("blur"), "mode", "grayscale", "blank")


@query(LOOKS + ", q AS (SELECT quantile_cont(blur, 0.05) AS p5 FROM looks) SELECT count(*)::BIGINT AS n, count(*)::BIGINT AS grayscale, (count(*) FILTER (contrast < 1))::BIGINT AS blank, (count(*) FILTER (blur <= p5))::BIGINT AS blurred, (count(*) FILTER (brightness < 30))::BIGINT AS dark, (count(*) FILTER (brightness > 225))::BIGINT AS bright FROM looks, q")
def p34_quality_flags(spark, d):
    return images.quality_flags(images.statistics(seen_pictures(spark, d)))


def hash_sql(size: int = 8, n: int = 32, low: int = 8) -> str:
    """CTEs after px: hashes(path, hash), from the weights of the shrinking and of the cosine transform."""
    lists = lambda m: "[" + ", ".join(str([float(x) for x in row]) for row in m) + "]::DOUBLE[][]"
    wave = 2 * np.cos(np.pi * np.outer(np.arange(low), 2 * np.arange(n) + 1) / (2 * n))
    byte = lambda x: f"least(255, greatest(0, floor({x} + 0.5::DOUBLE)))"
    return f"""weights AS (SELECT {lists(images._resized(size, n))} AS w, {lists(wave)} AS c),
wide AS (SELECT path, w, c, [[{byte(f"list_dot_product(p[{size} * i + 1:{size} * i + {size}], w[k + 1])")} FOR i IN range({size})] FOR k IN range({n})] AS m FROM px, weights WHERE vec_id % 50 <> 0),
small AS (SELECT path, c, [[{byte("list_dot_product(m[k + 1], w[r + 1])")} FOR r IN range({n})] FOR k IN range({n})] AS s FROM wide),
half AS (SELECT path, c, [[list_dot_product(s[k + 1], c[u + 1]) FOR k IN range({n})] FOR u IN range({low})] AS h FROM small),
turned AS (SELECT path, flatten([[list_dot_product(h[u + 1], c[v + 1]) FOR v IN range({low})] FOR u IN range({low})]) AS t FROM half),
bits AS (SELECT path, list_sum([CASE WHEN t[i + 1] > list_median(t) THEN (2::HUGEINT ** (63 - i))::HUGEINT ELSE 0::HUGEINT END FOR i IN range(64)]) AS b FROM turned),
hashes AS (SELECT path, (CASE WHEN b >= 9223372036854775808::HUGEINT THEN b - 18446744073709551616::HUGEINT ELSE b END)::BIGINT AS hash FROM bits)
"""


@query(f"WITH {BYTES}, {hash_sql()} SELECT path, CASE WHEN right(path, 1) IN ('0', '3', '6', '9') THEN 7 ELSE hash END AS hash FROM hashes")
def i4_i5_hashed(spark, d):
    """Perceptual hashes; every third is in the cache already."""
    rows = staged(seen_pictures(spark, d), "pictures")
    cache = rows.where(F.substring("path", -1, 1).isin("0", "3", "6", "9") & (F.col("height") > 0)).select("path", F.lit(7).cast("long").alias("hash"))
    return images.hashed(rows, cache)


@query(f"WITH {BYTES} SELECT path, CASE WHEN vec_id % 50 = 0 THEN 'unknown' WHEN list_avg(p) > 127 THEN 'light' ELSE 'dark' END AS label FROM px")
def x2_predicted(spark, d):
    """A classifier of crops as a plain function of pixels; what can't be decoded gets the label of an empty crop."""
    return det.predicted(pictures(spark, d), lambda crops: ["light" if p.mean() > 127 else "dark" for p in crops], empty="unknown").select("path", "label")


@query("SELECT doc_id, doc_id % 4 = 1 AS is_bee, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END::INT AS species FROM documents")
def x4_label_modes(spark, d):
    """The two label modes over folder names of four species, one of them a bee."""
    name = F.element_at(F.array(*[F.lit(f"000{i}_Animalia_Arthropoda_Insecta_{o}_{f}_G_s") for i, (o, f) in enumerate((("Diptera", "Syrphidae"), ("Hymenoptera", "Apidae"), ("Hymenoptera", "Formicidae"), ("Odonata", "Aeshnidae")))]), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = b.table(spark, d, "documents").select("doc_id", F.concat(F.lit("train/"), name, F.lit("/x.jpg")).alias("path"), name.alias("cls"))
    both = [c.labels(rows, mode).select("doc_id", F.col("label").alias(mode)) for mode in ("species", "is_bee")]
    return both[0].join(both[1], "doc_id").select("doc_id", (F.col("is_bee") == 1).alias("is_bee"), F.col("species").cast("int").alias("species"))
