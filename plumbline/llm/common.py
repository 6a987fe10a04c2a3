"""What the operators of this subpackage share: the cluster's shared folder, written
intermediate tables, side files between passes and connected components."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from .textwords import trim

#: Rows and bytes of one Arrow batch between the JVM and Python; texts differ widely in length.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: The largest id there can be; no id stands for a missing one.
TOP_ID = np.int64(2**63 - 1)


def free(df: DataFrame, name: str) -> str:
    """The name, behind as many underscores as it takes to be no column of df (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, and file splits that don't depend on the executors alive just now."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    except Exception:  # an older Spark has no such setting; the row bound still holds
        pass
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", max(1, spark.sparkContext.defaultParallelism))


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared(spark: SparkSession) -> str:
    """The folder all executors share, as a URI: the one in spark.checkpoint.dir. Where that is unset, a
    temporary one in local mode (tests); on a cluster, whose executors would each write to a disk of
    their own, that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        at = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(shutil.rmtree, at[7:], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at if "://" in at or at.startswith("file:") else "file://" + os.path.abspath(at)


#: Places in the shared folder that lazily read results may still need; they go when the driver ends.
_placed: set[str] = set()


def place(spark: SparkSession, what: str) -> str:
    if not _placed:
        atexit.register(tidy)
    at = f"{shared(spark).rstrip('/')}/plumbline/{what}-{uuid.uuid4().hex[:12]}"
    _placed.add(at)
    return at


def tidy() -> None:
    """Delete all intermediate tables of this driver. To be called once no result of theirs is to be read again."""
    for at in list(_placed):
        try:
            discard(at)
        except OSError:
            pass


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """A folder by its URI. file:/x, as Hadoop writes it, is file:///x."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def discard(*uris: str) -> None:
    for uri in uris:
        _placed.discard(uri)
        fs, at = filesystem(uri)
        if fs.get_file_info(at).type != pafs.FileType.NotFound:
            fs.delete_dir(at)


def written(df: DataFrame, what: str, by: list[str] | None = None) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and where it lies: lineage ends there, and a lost
    executor costs nothing that was written."""
    at = place(df.sparkSession, what)
    w = df.write
    (w.partitionBy(*by) if by else w).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at), at


def side_tables(uri: str, key: str, value: int, filters: list | None = None) -> pa.Table | None:
    """The rows written for one value of a partitioning key, or those of them that filters let pass; None if there are none."""
    fs, at = filesystem(uri)
    at = f"{at}/{key}={value}"
    if fs.get_file_info(at).type == pafs.FileType.NotFound:
        return None
    files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.path.endswith(".parquet"))
    parts = [pq.read_table(f, filesystem=fs, filters=filters, partitioning=None) for f in files]
    return pa.concat_tables(parts) if parts else None


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, of batches that come sorted by them. Holds one run at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        trim(b.nbytes)
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            key = tuple(c[s] for c in cols)
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


#: Bits of the set that `bits` makes: 16 MB at most, whatever the number of ids.
BITS = 1 << 27


def bits(ids: DataFrame, column: str) -> DataFrame:
    """(word, mask) of a bit set that holds the ids: BITS / 64 rows at most, so it may be broadcast.
    With more ids than bits it lets everything pass, and only spares less."""
    at = ids.select(F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(BITS)).alias("p"))
    return at.groupBy(F.expr("p div 64").alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("__mask"))


def with_hit(df: DataFrame, key: str, words: DataFrame, name: str) -> DataFrame:
    """df and a column more, whether the bit set may hold the row's key; false is certain, a null key is false."""
    place = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(BITS))
    at, word, mask = (free(df, c) for c in ("__at", "__word", "__mask"))
    df = df.withColumn(at, F.when(F.col(key).isNotNull(), place)).withColumn(word, F.expr(f"{at} div 64"))
    df = df.join(F.broadcast(words.toDF(word, mask)), word, "left")
    hit = F.coalesce(F.expr(f"({mask} & shiftleft(1L, cast({at} % 64 as int))) <> 0"), F.lit(False))
    return df.withColumn(name, hit).drop(word, at, mask)


#: Links up to which one task finds their components; it holds some forty bytes a link.
TASK_LINKS = 1_000_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    a, b = (np.concatenate(c) for c in zip(*held))
    ids, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = back[: len(a)], back[len(a) :]
    least = np.arange(len(ids))
    while True:  # the smaller of two roots to both ends and both roots, then straight to the root
        low = np.minimum(least[i], least[j])
        new = least.copy()
        for k in (i, j, least[i], least[j]):
            np.minimum.at(new, k, low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == least).all():
            break
        least = new
    for s in range(0, len(ids), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(ids[s : s + 100_000]), pa.array(ids[least[s : s + 100_000]])], names=["id", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id of the links (a, b).

    Up to TASK_LINKS links (they are counted) go to one task. Beyond, alternates large-star and small-star steps, which keep the components and end in stars
    around the smallest ids. Each step is a minimum by node, combined before its shuffle, and a
    join; each is written, so that a lost executor costs one step. Links of a node with itself
    and repeated links change nothing; links with a null end are none."""
    spark = edges.sparkSession

    def step(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        joined = both.join(least, "a")
        if large:  # every larger neighbour to the least one
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:  # a's smaller neighbours, and a itself, to the least one
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, at = written(e, "links")
    seen = mark(e)
    if 0 < seen[0] <= TASK_LINKS:
        return e.coalesce(1).mapInArrow(_stars, "id long, component long")
    if seen[0]:
        while True:  # ends: each round that isn't the last moves some link to a smaller end
            large, mid = written(step(e, True), "links")
            e2, to = written(step(large, False), "links")
            now = mark(e2)
            discard(at, mid)
            e, at = e2, to
            if now == seen:
                break
            seen = now
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
