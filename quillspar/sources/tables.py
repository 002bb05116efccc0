"""Readers of the parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Registers tables as temporary views for SQL queries."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
