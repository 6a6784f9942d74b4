"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: With it, the shuffle files of a query go when it ends; once a table is written, nothing reads them again.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where a local session names none, as in tests, it gets a temporary one; on a
    cluster that would be another folder on every machine, so it is an error there."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-meadow-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: a cut lineage that survives lost executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/meadow/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.unset(CLEAN_UP) if was is None else spark.conf.set(CLEAN_UP, was)
    back = spark.read.schema(df.schema).parquet(at)
    back._meadow_path = at
    return back


def drop_staged(df: DataFrame) -> None:
    """Delete the files behind a frame of staged() that nothing reads any more."""
    spark, at = df.sparkSession, df._meadow_path
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
