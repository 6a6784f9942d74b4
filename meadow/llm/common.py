"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Texts can be very long, so few of them go to Python at once."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(taken: list[str], *names: str) -> list[str]:
    """Names for helper columns that clash with none of `taken`, whatever the case."""
    out, used = [], {c.lower() for c in taken}
    for name in names:
        own = f"_{name}"
        while own.lower() in used:
            own = f"_{own}"
        used.add(own.lower())
        out.append(own)
    return out
