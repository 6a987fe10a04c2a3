"""Substring dedup by fixed-block anchors.

Passages of `window` words or more that also start in a document with a smaller id are removed.
The documents are read three times and their texts are never shuffled:

1. Index and probe. Every text's non-overlapping blocks of `block` = (window + 1) // 2 words are
   reference blocks; every rolling window of `block` words probes. Any repeated passage of
   `window` words holds a whole reference block of the one text, at which the other text has a
   probe. Each task sends its distinct probes to buckets by hash, each with two bits (it is also a
   reference block; it occurs in several documents of the task). A bucket answers each task with
   those of its probes that hit: a block somewhere, and present in more than one document.
2. Extend. Windows of `window` words over a hit are looked up the same way, with the smallest
   document id; a task gets back those of its windows that a smaller document has.
3. Every word under such a window goes: overlapping windows are the maximal exact repeats.

Hits in step 1 may be too many (56 bits of a hash are compared) but none is missed; step 2 compares
128 bits of a window's words (textwords). What is shuffled is one number a distinct probe, as
differences of sorted numbers; a passage in any number of documents counts once a task, so no key is
hot. Answers lie as files by group of tasks in the shared folder. A pass checks that it reads the rows that the first one read
and fails otherwise; an input whose partitions could change between passes is written first. Long
texts are worked through a span of windows at a time.

Nulls and empty texts have no words. A row without an id is neither smaller nor larger than any other: it
keeps all its words and removes none. Rows with equal ids count as one document: neither removes
from the other. Other columns pass through unchanged, whatever their names."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, packed
from . import textwords as T

U = np.uint64
#: Windows that a task holds before it sends them.
FLUSH = 2_000_000
#: Bits of a probe's hash that are compared: of 1e13 probes (2**43) one in 2**13 hits by chance.
PROBE = 56
#: Tasks whose answers share a folder.
GROUP = 4


def _texts(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str):
    """(rows, their ids, which of them have one, their words)"""
    for b in batches:
        key, text = T.column(b, id_col).cast(pa.int64()), T.column(b, text_col)
        ids, has = pc.fill_null(key, 0).to_numpy(zero_copy_only=False), key.is_valid().to_numpy(zero_copy_only=False)
        for s, e in T.chunks(text):
            yield b.slice(s, e - s), ids[s:e], has[s:e], T.of(text.slice(s, e - s))


class _Same:
    """Count and order-free hash of the ids that a task read."""

    def __init__(self) -> None:
        self.n, self.h = 0, 0

    def add(self, ids: np.ndarray, w: T.Words) -> None:
        self.n += len(ids)
        self.h = (self.h + int(T.mix(ids.view(U) + T.mix(w.n_words.astype(U))).sum())) % 2**64

    def row(self) -> np.ndarray:
        return np.array([self.n, self.h], U)


def _grouped(h: np.ndarray, *more: np.ndarray):
    """h sorted, where its runs begin, and the other arrays in that order."""
    o = np.argsort(h, kind="stable")
    h = h[o]
    at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h, at, *(x[o] for x in more)


def _grouped_both(h: np.ndarray, g: np.ndarray, *more: np.ndarray):
    """The same by two numbers, h and then g."""
    o = np.argsort(h, kind="stable")
    x, y = h[o], g[o]
    if ((x[1:] == x[:-1]) & (y[1:] != y[:-1])).any():
        o = np.lexsort((g, h))
        x, y = h[o], g[o]
    at = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))) if len(h) else np.zeros(0, np.int64)
    return x, y, at, *(v[o] for v in more)


_SENT = pa.schema([("bucket", pa.int32()), ("task", pa.int32()), ("h", pa.binary()), ("g", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])
_SENT_SQL = "bucket int, task int, h binary, g binary, a binary, b binary"
_BACK = pa.schema([("task", pa.int32()), ("kind", pa.int32()), ("h", pa.binary()), ("g", pa.binary()), ("a", pa.binary())])
_BACK_SQL = "task int, kind int, h binary, g binary, a binary"


def _by_bucket(h: np.ndarray, bits: int, n: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted hashes by their upper 20 bits."""
    top = ((h >> U(bits - 20)) * U(n)) >> U(20)
    cuts = np.searchsorted(top, np.arange(n + 1, dtype=U))
    return [(k, int(cuts[k]), int(cuts[k + 1])) for k in range(n) if cuts[k + 1] > cuts[k]]


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SENT)], schema=_SENT)


def _probes(block: int, window: int, buckets: int, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, same, held, n = TaskContext.get().partitionId(), _Same(), [], 0

        def flush() -> pa.RecordBatch:
            h, at, ref, doc = _grouped(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
            ref = np.maximum.reduceat(ref, at)
            h = h[at]
            return _sent([(k, task, packed.put_sorted(h[s:e]), None, np.packbits(ref[s:e]).tobytes(), np.packbits(several[s:e]).tobytes()) for k, s, e in _by_bucket(h, PROBE, buckets)])

        for _, ids, has, w in _texts(batches, id_col, text_col):
            same.add(ids, w)
            for lo, hi in w.spans(block):
                h, ok = w.windows(block, lo, hi)
                text = w.text_of(lo, hi)
                ok &= has[text] & (w.n_words[text] >= window)
                ref = (np.arange(lo, hi) - w.first[text]) % block == 0
                held.append((h[ok] >> U(64 - PROBE), ref[ok], ids[text[ok]]))
                n += int(ok.sum())
                if n >= FLUSH:
                    yield flush()
                    n = 0
        if n:
            yield flush()
        if same.n:
            yield _sent([(-1, task, packed.put(same.row()), None, None, None)])

    return run


def _back(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_BACK)], schema=_BACK)


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in common.groups(batches, ["bucket"]):
        tasks = t.column("task").to_pylist()
        if t.column("bucket")[0].as_py() < 0:
            yield _back([(k, 0, x, None, None) for k, x in zip(tasks, t.column("h").to_pylist())])
            continue
        parts = [packed.get_sorted(x) for x in t.column("h").to_pylist()]
        bits = lambda c: np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(t.column(c).to_pylist(), parts)])
        h, at, ref, several, task = _grouped(np.concatenate(parts), bits("a"), bits("b"), np.repeat(np.array(tasks, np.int32), [len(p) for p in parts]))
        runs = np.diff(at, append=len(h))
        hit = (np.maximum.reduceat(ref, at) > 0) & ((runs > 1) | (np.maximum.reduceat(several, at) > 0))
        hit = np.repeat(hit, runs)
        yield from _answers(task[hit], h[hit], None, None)


def _answers(task: np.ndarray, h: np.ndarray, g: np.ndarray | None, a: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if not len(h):
        return
    o = np.argsort(task, kind="stable")
    task, h = task[o], h[o]
    g, a = (None if x is None else x[o] for x in (g, a))
    cuts = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1], [True])))
    yield _back([(int(task[s]), 1, packed.put_sorted(h[s:e]), None if g is None else packed.put(g[s:e]), None if a is None else packed.put(a[s:e])) for s, e in zip(cuts[:-1], cuts[1:])])


class _Answer:
    """What a task got back: h sorted, and of windows g and the smallest document; same: what the first pass read."""

    def __init__(self, uri: str, task: int) -> None:
        self.h, self.g, self.least, self.same = np.zeros(0, U), None, None, None
        t = common.side_tables(uri, "grp", task // GROUP, [("task", "=", task)])
        if t is None:
            return
        h, g, a = [], [], []
        for kind, x, y, z in zip(*(t.column(c).to_pylist() for c in ("kind", "h", "g", "a"))):
            if kind == 0:
                self.same = packed.get(x)
                continue
            h.append(packed.get_sorted(x))
            if y is not None:
                g.append(packed.get(y))
                a.append(packed.get(z, np.int64))
        if not h:
            return
        h = np.concatenate(h)
        if g:
            self.h, self.g, at, self.least = _grouped_both(h, np.concatenate(g), np.concatenate(a))
            self.h, self.g, self.least = self.h[at], self.g[at], self.least[at]
            run = np.diff(np.flatnonzero(np.concatenate(([True], self.h[1:] != self.h[:-1], [True]))))
            self.most = int(run.max())
        else:
            self.h = np.unique(h)

    def has(self, h: np.ndarray) -> np.ndarray:
        if not len(self.h):
            return np.zeros(len(h), bool)
        return self.h[np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)] == h

    def smallest(self, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which windows are known, the smallest document of each of these)"""
        found, least = np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        if len(self.h):
            at = np.searchsorted(self.h, h)
            for k in range(self.most):  # entries that agree in h alone: one as good as always
                i = np.minimum(at + k, len(self.h) - 1)
                ok = ~found & (self.h[i] == h) & (self.g[i] == g)
                least[ok] = self.least[i[ok]]
                found |= ok
        return found, least


def _windows(block: int, window: int, buckets: int, id_col: str, text_col: str, uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, same, held, n = TaskContext.get().partitionId(), _Same(), [], 0
        hits = _Answer(uri, task)

        def flush() -> pa.RecordBatch:
            h, g, at, doc = _grouped_both(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            low, high, h, g = np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at), h[at], g[at]
            return _sent([(k, task, packed.put_sorted(h[s:e]), packed.put(g[s:e]), packed.put(low[s:e]), packed.put(high[s:e] - low[s:e])) for k, s, e in _by_bucket(h, 64, buckets)])

        for _, ids, has, w in _texts(batches, id_col, text_col):
            same.add(ids, w)
            if not len(hits.h):
                continue
            for lo, hi in w.spans():
                # blocks that windows of this span may hold begin up to window - block words after it
                small, _ = w.windows(block, lo, min(len(w.start), hi + window - block))
                hit = np.concatenate(([0], np.cumsum(hits.has(small >> U(64 - PROBE)))))
                h, ok = w.windows(window, lo, hi)
                text = w.text_of(lo, hi)
                i = np.arange(len(h))
                ok &= has[text] & (hit[np.minimum(i + window - block + 1, len(small))] > hit[i])
                if not ok.any():
                    continue
                held.append((h[ok], w.windows(window, lo, hi, 1)[0][ok], ids[text[ok]]))
                n += int(ok.sum())
                if n >= FLUSH:
                    yield flush()
                    n = 0
        if n:
            yield flush()
        _check(same, hits, task)

    return run


def _check(same: _Same, first: _Answer, task: int) -> None:
    if same.n and (first.same is None or (first.same != same.row()).any()):
        raise RuntimeError(f"substring dedup: task {task} reads other rows than in the first pass; write the input as a table first")


def _smaller(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in common.groups(batches, ["bucket"]):
        parts = [packed.get_sorted(x) for x in t.column("h").to_pylist()]
        g = np.concatenate([packed.get(x) for x in t.column("g").to_pylist()])
        low = np.concatenate([packed.get(x, np.int64) for x in t.column("a").to_pylist()])
        high = low + np.concatenate([packed.get(x, np.int64) for x in t.column("b").to_pylist()])
        h, g, at, low, high, task = _grouped_both(np.concatenate(parts), g, low, high, np.repeat(np.array(t.column("task").to_pylist(), np.int32), [len(p) for p in parts]))
        least = np.repeat(np.minimum.reduceat(low, at), np.diff(at, append=len(h)))
        needs = least < high
        yield from _answers(task[needs], h[needs], g[needs], least[needs])


def _removed(w: T.Words, ids: np.ndarray, has: np.ndarray, window: int, known: _Answer) -> np.ndarray:
    """Which words go: those of maximal runs of windows that a smaller document has."""
    n = len(w.start)
    if known.g is None or not n:
        return np.zeros(n, bool)
    edge = np.zeros(n + 1, np.int32)
    for lo, hi in w.spans():
        h, ok = w.windows(window, lo, hi)
        text = w.text_of(lo, hi)
        ok &= known.has(h) & has[text]
        if not ok.any():
            continue
        i = np.flatnonzero(ok)
        found, least = known.smallest(h[i], w.windows(window, lo, hi, 1)[0][i])
        i = i[found & (least < ids[text[i]])] + lo
        np.add.at(edge, i, 1)
        np.add.at(edge, i + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(w: T.Words, keep_word: np.ndarray, joined: bool) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each text begins and the end) of what is left. joined: words with one space
    between; else each removed word goes with the white space up to the next word."""
    n = len(w.data)
    edge = np.zeros(n + 1, np.int8)
    data = w.data
    if joined:
        k = np.flatnonzero(keep_word)
        np.add.at(edge, w.start[k], 1)
        np.add.at(edge, w.end[k], -1)
        mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
        doc = w.text_of()[k]
        sep = w.end[k[:-1][doc[1:] == doc[:-1]]]
        data = data.copy()
        data[sep] = 0x20
        mask[sep] = True
    else:
        k = np.flatnonzero(~keep_word)
        stop = np.append(w.start[1:], n)
        last = np.repeat(w.off[1:], w.n_words)
        np.add.at(edge, w.start[k], 1)
        np.add.at(edge, np.minimum(stop, last)[k], -1)
        mask = np.cumsum(edge[:-1], dtype=np.int8) == 0
    left = data[mask]
    cut = np.concatenate(([0], np.cumsum([np.count_nonzero(mask[a:z]) for a, z in zip(w.off.tolist(), w.off[1:].tolist())]))).astype(np.int64)
    return left, cut


def _digest(window: int, id_col: str, text_col: str, uri: str):
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, same = TaskContext.get().partitionId(), _Same()
        known = _Answer(uri, task)
        for b, ids, has, w in _texts(batches, id_col, text_col):
            same.add(ids, w)
            gone = _removed(w, ids, has, window, known)
            data, off = _cut(w, ~gone, True)
            view, cuts = memoryview(data), off.tolist()
            total = np.concatenate(([0], np.cumsum(gone)))
            sha = [hashlib.sha256(view[s:e]).hexdigest() for s, e in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([T.column(b, id_col).cast(pa.int64()), pa.array(w.n_words, pa.int64()), pa.array(np.diff(total[w.first]), pa.int64()), pa.array(sha, pa.string())], schema=out)
        _check(same, known, task)

    return run


def _texts_left(window: int, id_col: str, text_col: str, uri: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, same = TaskContext.get().partitionId(), _Same()
        known = _Answer(uri, task)
        for b, ids, has, w in _texts(batches, id_col, text_col):
            same.add(ids, w)
            gone = _removed(w, ids, has, window, known)
            data, off = _cut(w, ~gone, False)
            old = T.column(b, text_col)
            text = pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(old.type)
            text = pc.if_else(pc.is_valid(old), text, pa.scalar(None, old.type))
            total = np.concatenate(([0], np.cumsum(gone)))
            i = b.schema.names.index(text_col)
            cols = [text if j == i else c for j, c in enumerate(b.columns)] + [pa.array(np.diff(total[w.first]), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, name])
        _check(same, known, task)

    return run


def _passes(docs: DataFrame, id_col: str, text_col: str, window: int) -> tuple[DataFrame, str]:
    """(the input with fixed partitions, where each task's answer lies)."""
    spark = docs.sparkSession
    common.tune(spark)
    if window < 3:
        raise ValueError("a window has 3 words at least")
    plan = docs._jdf.queryExecution().executedPlan().toString()
    if "Exchange" in plan or "FileScan" not in plan:
        docs, _ = common.written(docs, "substring-input")
    block, n = (window + 1) // 2, common.shuffles(spark)
    slim = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)

    def answered(rows: DataFrame, what: str) -> str:
        at = common.place(spark, what)
        rows.withColumn("grp", F.expr(f"task div {GROUP}")).repartition(n, "grp").sortWithinPartitions("grp", "task").write.partitionBy("grp").parquet(at)
        return at

    def ask(sent, answer) -> DataFrame:
        return slim.mapInArrow(sent, _SENT_SQL).repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(answer, _BACK_SQL)

    hits = answered(ask(_probes(block, window, n, id_col, text_col), _hits), "substring-hits")
    windows = ask(_windows(block, window, n, id_col, text_col, hits), _smaller)
    marks = spark.read.schema(_BACK_SQL + ", grp int").parquet(hits).where("kind = 0").drop("grp")
    at = answered(windows.unionByName(marks), "substring-windows")
    common.discard(hits)
    return docs, at


def digests(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row: kept words joined by one space."""
    docs, at = _passes(docs, id_col, text_col, window)
    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(_digest(window, id_col, text_col, at), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicate(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "n_removed") -> DataFrame:
    """The rows of docs, all columns, with repeated passages cut from the text, and a column more, the
    number of removed words, under the first free of the names n_removed, _n_removed, __n_removed, ... A removed word goes with the white space after it; what stays is unchanged."""
    removed_col = common.free(docs, removed_col)
    docs, at = _passes(docs, id_col, text_col, window)
    schema = docs.select("*", F.lit(0).cast("long").alias(removed_col)).schema
    return docs.mapInArrow(_texts_left(window, id_col, text_col, at, removed_col), schema)
