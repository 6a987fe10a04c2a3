"""Facts as a stream: files of facts arrive, each content is passed on once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import fact_id

SCHEMA = "kind string, component string, source_logical_id string, payload string, at timestamp"


def fact_stream(spark: SparkSession, folder: str, late: str = "1 hour") -> DataFrame:
    """Facts of JSON files in a folder, with ids; a fact seen within the last `late` isn't passed again.
    State is bounded by the watermark."""
    raw = spark.readStream.schema(SCHEMA).json(folder)
    return raw.withColumn("fact_id", fact_id("kind", "component", "source_logical_id", "payload")).withWatermark("at", late).dropDuplicatesWithinWatermark(["fact_id"])


def kinds_by_hour(facts: DataFrame) -> DataFrame:
    """Counts by kind and hour of event time."""
    return facts.groupBy(F.window("at", "1 hour").alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "kind", "n")
