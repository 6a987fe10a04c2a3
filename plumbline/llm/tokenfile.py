"""Token ids as raw binary shards with keyed access.

A shard holds the ids of a range of document ids, in ascending order, as little-endian unsigned
integers of 2 bytes (4 where the vocabulary needs them) without separators: NAME.ids. Beside it
lies NAME.idx: a minimal perfect hash maps each key to a slot, and by slot are stored the key's
fingerprint, offset and length, so that one document's ids are found by two look-ups and one read
of the payload. NAME.idx also lists the keys in the order of the payload, for sequential reading.
The manifest, a table written by Spark, names the files of each shard; a task that is run twice
writes files of two names, of which the manifest has one.

A null text is empty; rows without an id come after all others. Rows of equal id are kept, in
the order of their texts; a key is an id and a number, 0 for its first row. Other columns are
ignored. Memory of a task is bounded by a chunk of texts and 40 bytes a document of its shard;
shards are as many as spark.sql.shuffle.partitions."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, mph, pretokens
from . import textwords as T

U = np.uint64
_MANIFEST = pa.schema([("shard", pa.int32()), ("name", pa.string()), ("width", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
_MANIFEST_SQL = "shard int, name string, width int, docs long, ids long, low long, high long"
#: Ids read from a payload at once.
READ = 4 << 20


#: Numbers of rows without an id begin here.
_MISSING = 1 << 62


def keys_of(ids: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Different for different ids whose number is 0: each step is then a bijection."""
    return T.mix(T.mix(ids.astype(np.int64).view(U).copy()) + number.astype(U) * T.GOLDEN)


def _numbers(ids: np.ndarray, named: int) -> np.ndarray:
    """Of sorted ids, how many equal ones come before each; the rows after the first `named` have no id."""
    i = np.arange(named)
    new = np.concatenate(([True], ids[1:named] != ids[: named - 1]))[:named]
    return np.concatenate([i - np.maximum.accumulate(np.where(new, i, 0)) if named else i, _MISSING + np.arange(len(ids) - named)])


def _index_bytes(ids: np.ndarray, named: int, length: np.ndarray) -> bytes:
    keys = keys_of(ids, _numbers(ids, named))
    m = mph.build(keys)
    slot = m.slot(keys)
    by = {"fingerprint": mph.fingerprint(keys), "offset": np.cumsum(length) - length, "length": length}
    arrays = {"keys": ids, "named": np.array([named]), "shift": m.shift}
    for k, v in by.items():
        arrays[k] = np.empty(len(v), v.dtype)
        arrays[k][slot] = v
    head = json.dumps({k: [v.dtype.str, len(v)] for k, v in arrays.items()}).encode()
    return len(head).to_bytes(8, "little") + head + b"".join(v.tobytes() for v in arrays.values())


class Shard:
    """A shard, opened for reading."""

    def __init__(self, uri: str, name: str, width: int) -> None:
        fs, at = common.filesystem(uri)
        raw = fs.open_input_file(f"{at}/{name}.idx").read()
        n = int.from_bytes(raw[:8], "little")
        here = 8 + n
        self.part = {}
        for k, (kind, size) in json.loads(raw[8:here]).items():
            self.part[k] = np.frombuffer(raw, kind, size, here)
            here += size * np.dtype(kind).itemsize
        self.mph = mph.Mph(len(self.part["keys"]), self.part["shift"])
        self.payload, self.kind = fs.open_input_file(f"{at}/{name}.ids"), np.dtype(f"<u{width}")

    def find(self, ids: np.ndarray, number: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, offset, length) of each key."""
        keys = keys_of(ids, np.zeros(len(ids), np.int64) if number is None else number)
        if not self.mph.n:
            none = np.zeros(len(ids), np.int64)
            return none > 0, none, none
        slot = self.mph.slot(keys)
        found = self.part["fingerprint"][slot] == mph.fingerprint(keys)
        return found, np.where(found, self.part["offset"][slot], 0), np.where(found, self.part["length"][slot], 0)

    def read(self, offset: int, length: int) -> np.ndarray:
        w = self.kind.itemsize
        return np.frombuffer(self.payload.read_at(length * w, offset * w), self.kind)


def _writer(uri: str, path: str, end: int | None, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pretokens.word_coder(path)
        width = 2 if coder.library.get_vocab_size() <= 1 << 16 else 4
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex[:8]}"
        fs, at = common.filesystem(uri)
        fs.create_dir(at, recursive=True)
        ids, length, named = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        with fs.open_output_stream(f"{at}/{name}.ids") as out:
            for b in batches:
                text, key = T.column(b, text_col), T.column(b, id_col)
                named += len(key) - key.null_count  # those without come last
                key = pc.fill_null(key, 0).to_numpy()
                for s, e in T.chunks(text):
                    flat, cut = coder.encode(text.slice(s, e - s), end)
                    out.write(flat.astype(f"<u{width}").tobytes())
                    length.append(np.diff(cut))
                    ids.append(key[s:e])
        ids, length = np.concatenate(ids), np.concatenate(length)
        with fs.open_output_stream(f"{at}/{name}.idx") as out:
            out.write(_index_bytes(ids, named, length))
        row = (shard, name, width, len(ids), int(length.sum()), int(ids[0]) if named else None, int(ids[named - 1]) if named else None)
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _MANIFEST)], schema=_MANIFEST)

    return run


def write(docs: DataFrame, path: str, uri: str, end: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, write shards into the folder uri, and return the manifest (also written there)."""
    spark = docs.sparkSession
    common.tune(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    key = F.col("id").asc_nulls_last()
    ordered = slim.repartitionByRange(common.shuffles(spark), key).sortWithinPartitions(key, "text")
    ordered.mapInArrow(_writer(uri, path, end, "id", "text"), _MANIFEST_SQL).write.parquet(f"{uri}/manifest")
    return manifest(spark, uri)


def manifest(spark, uri: str) -> DataFrame:
    """Shards in order, with first: the ids in all shards before."""
    m = spark.read.schema(_MANIFEST_SQL).parquet(f"{uri}/manifest")
    # One row a shard. Shards are as many as shuffle partitions, so this window is small.
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return m.withColumn("first", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("long")))


def _reader(uri: str):
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                shard = Shard(uri, row["name"], row["width"])
                ids = shard.part["keys"]
                named = int(shard.part["named"][0])
                found, offset, length = shard.find(ids, _numbers(ids, named))
                if not found.all() or len(ids) != row["docs"]:
                    raise RuntimeError(f"{row['name']}: keys are missing from the index")
                stop = offset + length
                i = 0
                while i < len(ids):
                    j = max(i + 1, int(np.searchsorted(stop, offset[i] + READ, "right")))
                    data = shard.read(int(offset[i]), int(stop[j - 1] - offset[i])).astype("<u4")
                    view, base = memoryview(data).cast("B"), int(offset[i])
                    crc = [zlib.crc32(view[4 * (s - base) : 4 * (e - base)]) for s, e in zip(offset[i:j].tolist(), stop[i:j].tolist())]
                    doc = pa.array(ids[i:j], pa.int64(), mask=np.arange(i, j) >= named)
                    yield pa.RecordBatch.from_arrays([doc, pa.array(offset[i:j] + row["first"], pa.int64()), pa.array(length[i:j], pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(j - i, row["shard"]), pa.int32())], schema=out)
                    i = j

    return run


def read_digests(spark, uri: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of every document in the shards of a folder."""
    m = manifest(spark, uri)
    return m.repartition(common.shuffles(spark), "shard").mapInArrow(_reader(uri), "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def lookup(spark, uri: str, doc_id: int) -> np.ndarray | None:
    """One document's ids: its shard by the manifest's ranges, its place by the perfect hash."""
    for row in manifest(spark, uri).where((F.col("low") <= doc_id) & (F.col("high") >= doc_id)).collect():
        shard = Shard(uri, row["name"], row["width"])
        found, offset, length = shard.find(np.array([doc_id]))
        if found[0]:
            return shard.read(int(offset[0]), int(length[0]))
    return None
