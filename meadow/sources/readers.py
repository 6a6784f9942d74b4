"""Readers of the tables the operators work on; every one has a fixed schema, so nothing is inferred from the data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meadow.functions import taxonomy
from meadow.operators.dose import canonical_visits

LANDINGS = (
    "video string, flower_id string, flower_species string, track_id int, insect_type string, is_honeybee boolean, t_enter_s double, t_exit_s double, "
    "landing_s double, is_real_landing int, flower_detected string, timestamp timestamp, pollination_weight double, conf_mean double"
)
SUMMARY = (
    "video string, flower_id string, flower_species string, n_landings int, n_real_landings int, n_honeybee int, n_bee int, n_fly int, n_beetle int, n_bug int, "
    "n_butterfly int, total_landing_s double, mean_landing_s double, pollination_score double, timestamp_first timestamp, timestamp_last timestamp"
)
COCO = (
    "images array<struct<id:bigint,file_name:string,width:int,height:int>>, "
    "annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>>>, categories array<struct<id:bigint,name:string>>"
)
MANIFEST = "path string, class_id int, class_name string, order string, family string, genus string, species string, is_bee int, source_split string, split string, status string"
CURVE = "F0 double, Fmax double, k double, F0_lo double, F0_hi double, Fmax_lo double, Fmax_hi double, k_lo double, k_hi double"
FACTS = "report_version string, video string, flowers bigint, active bigint, visits bigint, fruit_set double, lo double, hi double, species_totals map<string,bigint>"
DETECTIONS = "camera string, ts timestamp, fi bigint, kind string, track_id bigint, cls string, conf double, x1 double, y1 double, x2 double, y2 double"


def csv(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    return spark.read.schema(schema).options(header=True, **options).csv(path)


def visits(spark: SparkSession, path: str) -> DataFrame:
    """Canonical visits from a CSV of either layout; its header says which."""
    names = spark.read.options(header=True).csv(path).columns
    types = {c.split()[0]: c.split()[1] for c in LANDINGS.split(", ")} | {c: "double" for c in ("dwell_seconds", "velocity", "fraction_on", "weight", "confidence")}
    return canonical_visits(csv(spark, path, ", ".join(f"`{c}` {types.get(c, 'string')}" for c in names)))


def landings(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, LANDINGS)


def summary(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, SUMMARY)


def per_video(spark: SparkSession, folder: str, schema: str = LANDINGS) -> DataFrame:
    """All files of a folder but merged ones (ALL_*)."""
    return csv(spark, folder, schema, pathGlobFilter="*.csv").where(~F.col("_metadata.file_name").startswith("ALL_"))


def tab_separated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return csv(spark, path, schema, sep="\t")


def coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations, categories of label documents, with the name of their file."""
    docs = spark.read.schema(COCO).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))
    return tuple(docs.select("file", F.explode(c).alias("x")).select("file", "x.*") for c in ("images", "annotations", "categories"))


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes, modified, cls (the folder): files with an image's extension, contents unread."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return rows.where(ext.isin(*taxonomy.IMAGE_EXTENSIONS)).withColumn("cls", F.element_at(F.split("path", "/"), -2))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, MANIFEST)


def kept_assignments(spark: SparkSession, path: str, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    return manifest(spark, path).where((F.col("status") == "kept") & F.col("split").isin(*splits))


def facts(spark: SparkSession, path: str, version: str = "1.0") -> DataFrame:
    return versioned(spark.read.schema(FACTS).option("multiLine", True).json(path), version)


def versioned(documents: DataFrame, version: str = "1.0") -> DataFrame:
    """Documents without a version get the default one."""
    return documents.withColumn("report_version", F.coalesce("report_version", F.lit(version)))


def weather(spark: SparkSession, path: str) -> DataFrame:
    """One row; what the file lacks is null."""
    return spark.read.schema("temp_c double, wind_ms double, humidity_pct double").option("multiLine", True).json(path).limit(1)


def camera_sources(spark: SparkSession, path: str) -> DataFrame:
    """side, source of a list with `side=source` lines; comments are skipped, and lines without a side are cam<n>."""
    lines = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    kept = lines.where("line <> '' AND NOT startswith(line, '#')").withColumn("n", F.row_number().over(Window.orderBy("pos")) - 1)
    named = F.col("line").rlike(r"^[A-Za-z_][\w-]*=")
    return kept.select("n", F.when(named, F.regexp_extract("line", "^([^=]+)=", 1)).otherwise(F.concat(F.lit("cam"), F.col("n"))).alias("side"), F.when(named, F.regexp_extract("line", "^[^=]+=(.*)$", 1)).otherwise(F.col("line")).alias("source"))


def first_usable(candidates: list[Callable[[], DataFrame]]) -> DataFrame:
    """The first table that can be read and has rows; a header alone counts as none."""
    from pyspark.errors import AnalysisException

    for read in candidates:
        try:
            df = read()
            if not df.isEmpty():
                return df
        except AnalysisException:
            continue
    raise FileNotFoundError("none of the candidates has rows")


def user_visits(visits_: DataFrame, videos: DataFrame, user_id: int) -> DataFrame:
    """Visits of one user's videos; the filter reaches the scan of videos."""
    return visits_.join(videos.where(F.col("user_id") == user_id).select(F.col("id").alias("video_id")), "video_id")


def training_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A training log, its padded header names stripped, numbers as doubles."""
    raw = spark.read.options(header=True, ignoreLeadingWhiteSpace=True).csv(path)
    named = raw.toDF(*[c.strip() for c in raw.columns])
    return named.select(*[F.trim(F.col(f"`{c}`")).try_cast("double").alias(c) for c in named.columns])


def best_epoch(metrics: DataFrame, by: str) -> DataFrame:
    return metrics.agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in metrics.columns]), F.col(f"`{by}`")).alias("best")).select("best.*")


def field_table(spark: SparkSession, path: str, numeric: list[str]) -> DataFrame:
    """Rows whose numeric columns all hold positive numbers."""
    raw = spark.read.options(header=True).csv(path)
    out = raw.withColumns({c: F.col(c).try_cast("double") for c in numeric}).dropna(subset=numeric)
    for c in numeric:
        out = out.where(F.col(c) > 0)
    return out


def saved_curves(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """crop and its curve, from a document (or a line each) that maps crops to curves."""
    kind = f"map<string,struct<{','.join(c.replace(' ', ':') for c in CURVE.split(', '))}>>"
    docs = spark.read.option("wholetext", not one_per_line).text(path)
    return docs.select(F.explode(F.from_json("value", kind)).alias("crop", "c")).select("crop", "c.*")


def detection_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(DETECTIONS).option("maxFilesPerTrigger", per_trigger).parquet(path)
