"""Queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meadow.plans import curating, io, landing, reporting, streams, yields

PARTS = (landing, yields, curating, reporting, io, streams)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.flagship_top_flowers(spark, sf_dir)


def queries() -> dict:
    return {k: f for p in PARTS for k, f in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for p in PARTS for k, s in p.ORACLE.items()}
