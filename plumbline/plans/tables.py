"""The given tables, and written steps for the carriers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..frames import cut, shared

__all__ = ["cut", "shared", "spread", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows by key over as many tasks as shuffles have: a file of few row groups would leave Python's work to few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
