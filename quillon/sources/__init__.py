"""Scans: every table is read through Spark's own readers, so any store Spark reads works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (any Hadoop path)."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
