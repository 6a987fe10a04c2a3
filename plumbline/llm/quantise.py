"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of codewords, one of each of BOOKS codebooks that all span the full
dimension. Codebooks are trained on a bounded sample (`sample` vectors, by a hash of their ids):
k-means on the residuals, then alternately beam-search encoding and a joint least-squares update.
Every vector of the table is encoded, by beam search, and stored with its codes, the norm of its
approximation, the length of its residual and itself. A query scores all codes of a partition by look-up
tables (its products with the codewords) and the stored norms; the best `share` of each partition is
reranked by their exact distances. By the triangle inequality a vector is no nearer than its approximation
less its residual; all others for which that leaves a chance against the k-th best are then computed
exactly too, so a partition's bests are its true ones. The bests of all partitions are merged.
Queries pass the partitions in blocks of QUERIES; neither they nor the index come to the driver.

Equal vectors are encoded once, with their k + 1 smallest ids: no query can want more of them.

Vectors that are null, zero, of another dimension than most, or hold null or non-finite components
take no part. Rows of equal id count once. Fewer candidates than asked for are all returned."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, vectors
from . import textwords as T

BOOKS, WORDS, BEAM, SAMPLE = 16, 128, 8, 10_000
#: Share of a partition's vectors, and the least number, that are reranked exactly.
SHARE, SHORTLIST = 0.04, 100
#: Vectors of a partition scored together, those of a partition, and queries of a block.
HELD, PART, QUERIES = 60_000, 4096, 256


@dataclass
class Books:
    words: np.ndarray  # (books, words, dim)

    def __post_init__(self) -> None:
        flat = self.words.reshape(-1, self.words.shape[2])
        self.gram = (flat @ flat.T).astype(np.float32)
        self.norm = np.einsum("ij,ij->i", flat, flat).astype(np.float32)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """(n, books) codes that approximate x well, book after book, keeping the best sums."""
        m, k, d = self.words.shape
        out = np.empty((len(x), m), np.int16)
        flat = self.words.reshape(m * k, d).astype(np.float32)
        for s in range(0, len(x), 512):
            v = x[s : s + 512].astype(np.float32)
            n = len(v)
            product = self.norm - 2 * (v @ flat.T)
            codes, cost = np.zeros((n, 1, 0), np.int16), np.zeros((n, 1), np.float32)
            for b in range(m):
                part = slice(b * k, (b + 1) * k)
                new = cost[:, :, None] + product[:, None, part]
                for p in range(b):
                    new += 2 * self.gram[codes[:, :, p].astype(np.int64) + p * k, part]
                w = new.shape[1]
                keep = min(beam, w * k)
                best = np.argpartition(new.reshape(n, -1), keep - 1, axis=1)[:, :keep]
                cost = np.take_along_axis(new.reshape(n, -1), best, 1)
                codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], 1), (best % k)[:, :, None].astype(np.int16)], axis=2)
            out[s : s + 512] = np.take_along_axis(codes, cost.argmin(axis=1)[:, None, None], 1)[:, 0]
        return out

    def approximate(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[b][codes[:, b]] for b in range(len(self.words)))


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (np.einsum("ij,ij->i", c, c) - 2 * (x @ c.T)).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 2) -> Books:
    rng = np.random.default_rng(11)
    k = int(min(words, max(1, len(x))))
    left, made = x.copy(), []
    for _ in range(books):
        c = _means(left, k, 8, rng)
        near = (np.einsum("ij,ij->i", c, c) - 2 * (left @ c.T)).argmin(axis=1)
        left = left - c[near]
        made.append(c)
    out = Books(np.stack(made))
    for _ in range(rounds):
        codes = out.encode(x).astype(np.int64) + np.arange(books) * k
        size = books * k
        normal = np.zeros(size * size)
        for a in range(books):
            for b in range(books):
                normal += np.bincount(codes[:, a] * size + codes[:, b], minlength=size * size)
        right = np.stack([np.bincount(codes.ravel(), np.repeat(x[:, j], books), size) for j in range(x.shape[1])], axis=1)
        old = out.words.reshape(size, -1)
        # a little weight on the codewords as they are keeps unused ones and makes the system regular
        solved = np.linalg.solve(normal.reshape(size, size) + 0.1 * np.eye(size), right + 0.1 * old)
        out = Books(solved.reshape(books, k, -1))
    return out


def _blocks(uri: str) -> Iterator[pa.RecordBatch]:
    fs, at = common.filesystem(uri)
    for f in sorted(x.path for x in fs.get_file_info(pafs.FileSelector(at)) if x.path.endswith(".parquet")):
        yield from pq.ParquetFile(fs.open_input_file(f)).iter_batches(QUERIES)


def _search(uri: str, words: np.ndarray, kind: str, dim: int, k: int, share: float):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = words.reshape(-1, dim).astype(np.float32)
        size = words.shape[1]
        unsure = 5e-7 * (dim + len(words)) * np.linalg.norm(words, axis=2).max(axis=1).sum()

        def scan(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            norm, residual = t.column("norm").to_numpy(), t.column("residual").to_numpy()
            lists = t.column("ids").combine_chunks()
            at, ids = lists.offsets.to_numpy(), lists.values.to_numpy()
            size_of = np.diff(at)
            codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.int16).reshape(len(norm), -1).astype(np.int64) + np.arange(words.shape[0]) * size
            x = vectors.matrix(t.column("raw").combine_chunks(), kind, dim)
            for q in _blocks(uri):
                q_ids, y = T.column(q, "vec_id").to_numpy(), vectors.matrix(T.column(q, "raw"), kind, dim)
                table = y.astype(np.float32) @ flat.T
                got = []
                for r in range(len(q_ids)):
                    rough = norm - 2 * table[r][codes].sum(axis=1)
                    n = min(len(norm), max(SHORTLIST, int(share * len(norm))))
                    near = np.argpartition(rough, n - 1)[:n]
                    exact = np.full(len(norm), np.inf)
                    exact[near] = np.sqrt(((x[near] - y[r]) ** 2).sum(axis=1))
                    # a node of several ids is several candidates, less the query's own
                    o = near[np.argsort(exact[near], kind="stable")]
                    enough = np.searchsorted(np.cumsum(size_of[o]), k + 1)
                    kth = exact[o[enough]] if enough < len(o) else np.inf
                    squared = y[r] @ y[r]
                    # the scores' rounding in single precision; a score that overflowed is no number, and stays
                    slack = unsure * np.sqrt(squared) + 1e-6 * norm + 1e-30
                    least = np.sqrt(np.maximum(rough + squared - slack, 0)) - residual * (1 + 1e-6)
                    more = np.flatnonzero(~(least > kth) & ~np.isfinite(exact))
                    exact[more] = np.sqrt(((x[more] - y[r]) ** 2).sum(axis=1))
                    nodes = np.flatnonzero(exact <= kth)
                    own = np.concatenate([ids[at[i] : at[i + 1]] for i in nodes])
                    exact = np.repeat(exact[nodes], size_of[nodes])
                    own, exact = own[own != q_ids[r]], exact[own != q_ids[r]]
                    o = np.lexsort((own, exact))[:k]
                    got.append((np.full(len(o), q_ids[r]), own[o], exact[o]))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got)], schema=schema)

        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(h.num_rows for h in held) >= HELD:
                yield from scan(held)
                held = []
        if held:
            yield from scan(held)

    return run


def nearest(table: DataFrame, is_query, k: int = 10, sample: int = SAMPLE, share: float = SHARE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every vector for which the condition
    is_query (on vec_id) holds, by Euclidean distance, itself excluded, ties to the smaller id."""
    spark = table.sparkSession
    rows, kind, dim = vectors.prepared(table, id_col, vec_col)
    rows = rows.where("raw is not null")
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("raw").toPandas()["raw"]  # sample rows
    if not len(some):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books = train(vectors.matrix(pa.array([bytes(b) for b in some], pa.binary()), kind, dim))
    words = books.words

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Books(words)
        for b in batches:
            x = vectors.matrix(T.column(b, "raw"), kind, dim)
            codes = own.encode(x)
            near = own.approximate(codes)
            yield pa.RecordBatch.from_arrays([T.column(b, "ids"), T.column(b, "raw"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(np.einsum("ij,ij->i", near, near).astype(np.float32)), pa.array(np.linalg.norm(x - near, axis=1))], names=["ids", "raw", "codes", "norm", "residual"])

    # ranked before they are gathered: of many copies, k + 1 ids are all that is held
    nth = Window.partitionBy("raw").orderBy("vec_id")
    nodes = rows.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= k + 1).groupBy("raw").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    index, _ = common.written(nodes.select("ids", "raw").mapInArrow(encode, "ids array<long>, raw binary, codes binary, norm float, residual double"), "quantised")
    _, asked = common.written(rows.where(is_query), "queries")
    # partitions of PART vectors or so, or as many as the cluster's shuffles have; what each finds doesn't depend on it
    parts = max(1, min(common.shuffles(spark), -(-index.count() // PART)))
    found = index.repartition(parts, "raw").mapInArrow(_search(asked, words, kind, dim, k, share), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
