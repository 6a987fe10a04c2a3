"""Packing documents into sequences by non-negative least squares over the length histogram.

Each document is a run of ids. Whole windows are cut off its start; what remains has one of
window - 1 lengths. Shallow combinations of two or three lengths that occur and fill a window exactly are
enumerated (of more, up to DEPTH, when those run out, as short remainders do in threes), their repeat counts solved against the histogram of remainders under x >= 0, and rounded:
whole parts first, then, the largest fraction first, one more of each for which there is stock.
What is left is enumerated, solved and rounded again, until RESIDUAL of the remainders' ids are left
or combinations place next to nothing more. These residual remainders are packed greedily, one after the other
in order of length, cut where a window ends; the last, partial window is divided into sequences of
powers of two, so that nothing is padded.

Only the histogram (window rows) comes to the driver, and only the plan (a run for each length of a
combination and turn) goes out. A row finds its place by its rank among the rows of its length: rank
in its task plus the counts of the tasks before, so that no length, however common, is gathered or
sorted. These counts lie in the shared folder by group of tasks, and a task reads its own. Ids are
encoded once and written; they are not shuffled.

A null text is empty: one end id. Null and repeated ids are carried as they are. Other columns are
ignored."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, pretokens
from . import textwords as T

#: Tasks whose counts share a folder.
GROUP = 64


#: Combinations solved for at once, lengths of one, and the share of the remainders' ids that may be left to the greedy end.
COMBINATIONS, DEPTH, RESIDUAL = 60_000, 8, 0.02


def combinations(window: int, have: np.ndarray, depth: int = 3, turn: int = 0) -> np.ndarray:
    """(k, depth) lengths, 0 for none, that occur and fill the window: all pairs, and those of two lengths
    with depth - 2 neighbouring shorter ones. Were these more than COMBINATIONS, only those of every s-th
    run of neighbours are made, of all runs in s turns."""
    there = have > 0
    a = np.flatnonzero(there[: window // 2 + 1])
    a = a[(a > 0) & there[window - a]]
    rows = [np.stack([a, window - a, *[np.zeros_like(a)] * (depth - 2)], axis=1)]
    lengths = np.flatnonzero(there)
    n = depth - 2
    fixed = np.lib.stride_tricks.sliding_window_view(lengths, n) if len(lengths) >= n else np.zeros((0, n), np.int64)
    stock = lengths[have[lengths] >= n]  # and one length several times
    fixed = np.concatenate([fixed, np.repeat(stock[:, None], n, axis=1)]) if n > 1 else fixed
    fixed = fixed[fixed.sum(axis=1) + 2 * fixed[:, -1] <= window]
    step = max(1, len(fixed) * len(lengths) // (4 * COMBINATIONS))
    for f in fixed[turn % step :: step]:
        rest = window - int(f.sum())
        y = np.arange(int(f[-1]), rest // 2 + 1)
        y = y[there[y] & there[rest - y]]
        rows.append(np.concatenate([np.repeat(f[None], len(y), axis=0), y[:, None], rest - y[:, None]], axis=1))
    return np.concatenate(rows).astype(np.int64)


def solve(combos: np.ndarray, have: np.ndarray, rounds: int = 150) -> np.ndarray:
    """x >= 0 that minimises |A x - have|**2, where A counts the lengths of each combination, by accelerated projected gradients."""
    n = len(have)

    def forward(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(combos[:, j], x * (combos[:, j] > 0), n) for j in range(combos.shape[1]))

    def back(r: np.ndarray) -> np.ndarray:
        return sum(r[combos[:, j]] * (combos[:, j] > 0) for j in range(combos.shape[1]))

    v = np.ones(len(combos))
    for _ in range(30):
        v = back(forward(v))
        big = np.linalg.norm(v)
        v /= big
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(forward(y) - have) / (1.05 * big))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


@dataclass
class Plan:
    """key: length << 40 | first rank of a run, sorted; count, sequence (of the first), offset: of the run. used: by length."""

    window: int
    full: int
    key: np.ndarray
    count: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    used: np.ndarray
    placed: int  # sequences before the residual ones
    share: float  # of the remainders' ids, that combinations place
    rest_first: np.ndarray  # by length: where the residual remainders of that length begin
    rest: int

    @property
    def tail(self) -> np.ndarray:
        """Where the sequences of powers of two begin, and the end."""
        at, out = self.rest // self.window * self.window, []
        left = self.rest - at
        for k in range(left.bit_length() - 1, -1, -1):
            if left >> k & 1:
                out.append(at)
                at += 1 << k
        return np.array([*out, at], np.int64)


def counts(combos: np.ndarray, x: np.ndarray, left: np.ndarray) -> np.ndarray:
    """x in whole numbers, within the stock: rounded down, then one more of each, the largest fraction first."""
    whole = np.floor(x + 1e-6).astype(np.int64)
    stock = left.tolist()
    out = np.zeros(len(x), np.int64)
    rows = combos.tolist()

    def take(j: int, k: int) -> None:
        parts = [v for v in rows[j] if v]
        k = min(k, *(stock[v] // parts.count(v) for v in parts))
        if k > 0:
            out[j] += k
            for v in parts:
                stock[v] -= k

    for j in np.argsort(-x, kind="stable")[: np.count_nonzero(whole)].tolist():
        take(j, int(whole[j]))
    for j in np.argsort(whole - x, kind="stable").tolist():
        take(j, 1)
    return out


def plan(have: np.ndarray, full: int, window: int) -> Plan:
    """have: remainders by length (have[0] ignored); full: whole windows cut off."""
    have = have.astype(np.int64).copy()
    have[0] = 0
    length = np.arange(len(have))
    total = int((have * length).sum())
    left, used, at = have.copy(), np.zeros_like(have), full
    runs: list[tuple[int, int, int, int, int]] = []
    depth = min(3, DEPTH)
    turn = 0
    while (before := int((left * length).sum())) > RESIDUAL * total:
        combos = combinations(window, left, depth, turn)
        turn += 1
        x = counts(combos, solve(combos, left.astype(float)), left) if len(combos) else np.zeros(0, np.int64)
        for j in np.flatnonzero(x).tolist():
            parts, k, offset = [int(v) for v in combos[j] if v], int(x[j]), 0
            for v in parts:
                runs.append((v, int(used[v]), k, at, offset))
                used[v] += k
                left[v] -= k
                offset += v
            at += k
        if before - int((left * length).sum()) < 0.005 * total:
            if depth == DEPTH:
                break
            depth += 1
    runs.sort()
    r = np.array(runs, np.int64).reshape(-1, 5)
    size = left * length
    share = 1 - int(size.sum()) / total if total else 1.0
    return Plan(window, full, r[:, 0] << 40 | r[:, 1], r[:, 2], r[:, 3], r[:, 4], used, at, share, np.cumsum(size) - size, int(size.sum()))


def pieces(p: Plan, tokens: np.ndarray, first_full: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, length, sequence, offset) of all pieces of documents with so many tokens, so many
    whole windows in documents before, and that rank among remainders of the same length."""
    w = p.window
    full, length = tokens // w, tokens % w
    row = np.repeat(np.arange(len(tokens)), full)
    k = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
    out = [(row, k * w, np.full(len(row), w), first_full[row] + k, np.zeros(len(row), np.int64))]
    some = np.flatnonzero(length)
    n, g = length[some], rank[some]
    if len(p.key):
        i = np.maximum(np.searchsorted(p.key, n << 40 | g, "right") - 1, 0)
        d = g - (p.key[i] & ((1 << 40) - 1))
        fits = (p.key[i] >> 40 == n) & (d >= 0) & (d < p.count[i])
        a, j, e = some[fits], i[fits], d[fits]
        out.append((a, full[a] * w, length[a], p.sequence[j] + e, p.offset[j]))
        some, n, g = some[~fits], n[~fits], g[~fits]
    x = p.rest_first[n] + (g - p.used[n]) * n
    tail, q = p.tail, p.rest // w

    def index(at: np.ndarray) -> np.ndarray:
        return np.where(at < q * w, at // w, q + np.searchsorted(tail, at, "right") - 1)

    def begins(i: np.ndarray) -> np.ndarray:
        return np.where(i < q, i * w, tail[np.clip(i - q, 0, len(tail) - 1)])

    one, last = index(x), index(x + n - 1)
    k = last - one + 1
    row = np.repeat(np.arange(len(x)), k)
    s = one[row] + np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
    a, z = np.maximum(x[row], begins(s)), np.minimum((x + n)[row], begins(s + 1))
    a0 = some[row]
    out.append((a0, full[a0] * w + a - x[row], z - a, p.placed + s, a - begins(s)))
    return tuple(np.concatenate(c) for c in zip(*out))


def _encoder(path: str, window: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = pretokens.word_coder(path), TaskContext.get().partitionId()
        width = 2 if coder.library.get_vocab_size() <= 1 << 16 else 4
        seen, full_before = np.zeros(window, np.int64), 0
        for b in batches:
            text = T.column(b, "text")
            for s, e in T.chunks(text):
                ids, cut = coder.encode(text.slice(s, e - s), end)
                n = np.diff(cut)
                left, full = n % window, n // window
                o = np.argsort(left, kind="stable")
                at = np.arange(len(o)) - np.searchsorted(left[o], left[o])
                rank = np.empty(len(o), np.int64)
                rank[o] = at + seen[left[o]]
                seen += np.bincount(left, minlength=window)
                before = full_before + np.cumsum(full) - full
                full_before += int(full.sum())
                raw = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((cut * width).astype(np.int64).tobytes()), pa.py_buffer(ids.astype(f"<u{width}").tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [T.column(b, "doc_id").slice(s, e - s), raw, pa.array(n, pa.int64()), pa.array(left, pa.int32()), pa.array(rank, pa.int64()), pa.array(before, pa.int64()), pa.array(np.full(len(n), task), pa.int32())],
                    names=["doc_id", "raw", "tokens", "left", "rank", "full_before", "task"],
                )

    return run


_ENCODED = "doc_id long, raw binary, tokens long, left int, rank long, full_before long, task int"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, window: int = 2048, end: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and,
    if with_ids, its ids. Sequences are window long, or, to hold the very last ids, a power of two."""
    spark = docs.sparkSession
    common.tune(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    encoded, _ = common.written(slim.mapInArrow(_encoder(path, window, end), _ENCODED), "packing-ids")
    cells, cells_at = common.written(encoded.groupBy("task", "left").agg(F.count("*").alias("n"), F.sum(F.expr(f"tokens div {window}")).alias("full")), "packing-cells")
    have = np.zeros(window, np.int64)
    full = 0
    for left, n, f in cells.groupBy("left").agg(F.sum("n"), F.sum("full")).collect():  # window rows at most
        have[left], full = n, full + f
    p = spark.sparkContext.broadcast(plan(have, full, window))
    by_length = Window.partitionBy("left").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = Window.partitionBy(F.lit(0)).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    tasks = cells.groupBy("task").agg(F.sum("full").alias("full")).select("task", F.coalesce(F.sum("full").over(by_task), F.lit(0).cast("long")).alias("task_full"))
    base = cells.select("task", "left", F.coalesce(F.sum("n").over(by_length), F.lit(0).cast("long")).alias("base")).join(tasks, "task")
    base_at = common.place(spark, "packing-base")
    base.withColumn("grp", F.expr(f"task div {GROUP}")).repartition(common.shuffles(spark), "grp").sortWithinPartitions("grp", "task").write.partitionBy("grp").parquet(base_at)
    common.discard(cells_at)

    def before_task(task: int) -> tuple[np.ndarray, int]:
        """(of each length, the rows in tasks before; the whole windows in them)"""
        t = common.side_tables(base_at, "grp", task // GROUP, [("task", "=", task)])
        at = np.zeros(window, np.int64)
        at[t.column("left").to_numpy()] = t.column("base").to_numpy()
        return at, t.column("task_full")[0].as_py()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, tuple[np.ndarray, int]] = {}
        for b in batches:
            tokens, rank, before, left, task = (T.column(b, c).to_numpy() for c in ("tokens", "rank", "full_before", "left", "task"))
            seen = np.unique(task).tolist()
            of = {k: of.get(k) or before_task(k) for k in seen}
            at, task_full = np.zeros(len(task), np.int64), np.zeros(len(task), np.int64)
            for k in seen:
                own = task == k
                at[own], task_full[own] = of[k][0][left[own]], of[k][1]
            row, start, length, sequence, offset = pieces(p.value, tokens, before + task_full, rank + at)
            raw = T.column(b, "raw")
            width = sum(len(x.as_buffer()) for x in raw) // max(1, int(tokens.sum())) or 2
            view = [memoryview(np.frombuffer(x.as_buffer(), f"<u{width}").astype("<u4")).cast("B") for x in raw]
            crc = [zlib.crc32(view[r][4 * s : 4 * (s + n)]) for r, s, n in zip(row.tolist(), start.tolist(), length.tolist())]
            cols = [T.column(b, "doc_id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(tokens[row]), pa.array(sequence), pa.array(offset)]
            names = [c.split()[0] for c in _PIECES.split(", ")]
            if with_ids:
                cols.append(pa.array([np.frombuffer(view[r], "<u4")[s : s + n].astype(np.int32) for r, s, n in zip(row.tolist(), start.tolist(), length.tolist())], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return encoded.select("doc_id", "raw", "tokens", "rank", "full_before", "left", "task").mapInArrow(place, _PIECES + (", ids array<int>" if with_ids else ""))
