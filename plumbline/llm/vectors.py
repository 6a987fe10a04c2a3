"""Reading tables of vectors: which rows take part, and their numbers as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textwords as T


def matrix(raw: pa.Array, kind: str, dim: int) -> np.ndarray:
    """Rows of dim numbers from binary values."""
    if not len(raw):
        return np.zeros((0, dim))
    return np.frombuffer(b"".join(raw.to_pylist()), kind).reshape(-1, dim).astype(np.float64)


def prepared(table: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, str, int]:
    """(rows (vec_id, raw), the kind of their numbers, their dimension). raw is null for vectors that
    take no part: null or zero ones, such with null or non-finite numbers, and those of another
    dimension than most (of equally common ones the largest counts). Rows of equal id count once,
    by their smallest vector; rows without an id stay, and have no raw."""
    spark = table.sparkSession
    common.tune(spark)
    kind = "<f8" if "double" in table.schema[vec_col].dataType.simpleString() else "<f4"
    slim = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    sizes = slim.where("vec_id is not null and size(v) > 0").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dim = sizes[0]["d"] if sizes else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = T.column(b, "vec_id"), T.column(b, "v")
            has = ids.is_valid().to_numpy(zero_copy_only=False)
            out = []
            for ok, v in zip(has, rows):
                a = None
                if ok and v.is_valid and len(v) == dim and v.values.null_count == 0:
                    a = v.values.to_numpy().astype(kind)
                    if not (np.isfinite(a).all() and a.any()):
                        a = None
                out.append(None if a is None else a.tobytes())
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary())], names=["vec_id", "raw"])

    rows, _ = common.written(slim.mapInArrow(run, "vec_id long, raw binary"), "vectors")
    if rows.where("vec_id is not null").groupBy("vec_id").count().where("count > 1").take(1):
        named = rows.where("vec_id is not null").groupBy("vec_id").agg(F.min("raw").alias("raw"))
        rows = named.unionByName(rows.where("vec_id is null"))
    return rows, kind, dim
