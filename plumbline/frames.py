"""Frames in the cluster's shared folder: written steps that end a plan's lineage, and ranks without one task for all."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where it is unset: a temporary one in
    local mode, an error on a cluster, whose executors would each write to a disk of their own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        at = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(shutil.rmtree, at[7:], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at if ":" in at else "file://" + os.path.abspath(at)


_steps: dict[str, SparkSession] = {}


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read back; a lost executor costs at most this step. Steps go when the driver ends, or by tidy."""
    spark = df.sparkSession
    at = f"{shared(spark).rstrip('/')}/plumbline/step-{uuid.uuid4().hex[:12]}"
    if not _steps:
        atexit.register(tidy)
    _steps[at] = spark
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def tidy() -> None:
    """Delete all steps of this driver. To be called once no result that reads them is wanted any more."""
    for at, spark in list(_steps.items()):
        del _steps[at]
        try:
            if at.startswith("file:"):
                shutil.rmtree(re.sub("^file:/*", "/", at), ignore_errors=True)
            else:
                path = spark._jvm.org.apache.hadoop.fs.Path(at)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may be gone; what is left lies in a folder of its own
            pass


def ranked(df: DataFrame, name: str, *order, start: int = 0) -> DataFrame:
    """df and a column more: the row's number in an order, from start + 1. Rows are sorted by ranges; each range
    counts on from the rows of those before it, so that no task sees all rows. The order must leave no ties."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = cut(df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()))
    sizes = split.groupBy("__range").count()  # a row a range
    before = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("__range", (F.coalesce(F.sum("count").over(before), F.lit(0)) + start).alias("__base"))
    within = Window.partitionBy("__range").orderBy(*order)
    out = split.join(F.broadcast(base), "__range").withColumn(name, (F.row_number().over(within) + F.col("__base")).cast("long"))
    return out.drop("__range", "__base")
