"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad; what speaks for either are features of the line and of its neighbours
(length, kinds of characters, lengths of words, symbols at the ends of words, repetition in the
document), and the labels of neighbouring lines. Forward-backward gives each line's marginal
probability; their mean, weighted by the lines' lengths, calibrated by a logistic curve, is the
document's score. The field is fitted to documents' labels, which all lines of a document take, on
at most `bound` labelled documents, chosen by a hash of the id (the bound is the only cap, and is a
parameter of the fit; scoring is over whole texts of all documents).

A null text is empty; an empty text is one empty line and is scored. A null id is never held out.
Labels that are null or of no document are ignored, of repeated labels of a document one counts.
Without labels of both kinds the score is the share of good ones (0.5 without any). Other columns
pass through unchanged."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textwords as T

U = np.uint64
BOUND = 5000
_KINDS = np.zeros((8, 256), np.uint8)
_KINDS[0, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1  # letters, and parts of them
_KINDS[1, range(0x30, 0x3A)] = 1  # digits
_KINDS[2, range(0x41, 0x5B)] = 1  # capitals
_KINDS[3, [ord(c) for c in ".,;:!?'\"()-"]] = 1  # marks of prose
_KINDS[4, [ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 1  # symbols
_KINDS[5, ord("|")] = 1
_KINDS[6, range(0xC2, 0x100)] = 1  # first bytes of longer characters
_KINDS[7, [*range(0, 9), *range(14, 32), 127]] = 1  # control characters
_BASE = 17


def lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, their lengths, index of each text's first line and the end). Lines end
    with a line feed; a text has one line at least."""
    w = T.of(texts)
    data, n = w.data, len(w)
    feed = np.flatnonzero(data == 10)
    # a line begins with a text and after each line feed within it
    start = np.sort(np.concatenate([w.off[:-1], feed + 1]), kind="stable")
    text = np.sort(np.concatenate([np.arange(n), np.searchsorted(w.off, feed, "right") - 1]), kind="stable")
    first = np.searchsorted(text, np.arange(n + 1))
    stop = np.append(start[1:], len(data))
    last = np.zeros(len(start), bool)
    last[first[1:] - 1] = True
    size = np.where(last, w.off[1:][text] - start, stop - start - 1)
    end = start + size
    of = np.empty((8, len(start)))
    total = np.zeros(len(data) + 1, np.int32)
    for k in range(8):
        np.cumsum(_KINDS[k][data], out=total[1:])
        of[k] = total[end] - total[start]
    del total
    # words by line
    a, z = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
    words = (z - a).astype(np.float64)

    def sums_of(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x) + 1, np.int32)  # a text has fewer than 2**31 bytes
        np.cumsum(x, out=out[1:])
        return out

    size_of = (w.end - w.start).astype(np.int32)
    length, long_, alone = sums_of(size_of), sums_of(size_of > 14), sums_of(size_of == 1)
    tail = data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    noisy, marked = sums_of(_KINDS[4][tail]), sums_of(_KINDS[3][tail])
    del size_of, tail
    # equal words next to each other, and lines that occur again in their text
    h = w.hash()
    same = np.zeros(len(h) + 1, np.int32)
    if len(h) > 1:
        np.cumsum(h[1:] == h[:-1], out=same[2:])
    line = np.repeat(np.arange(len(start)), z - a)
    place = T.mix((np.arange(len(h)) - a[line] + 1).astype(U) * T.GOLDEN)
    sums = np.zeros(len(h) + 1, U)
    np.cumsum(T.mix(h + place), out=sums[1:])
    key = T.mix((sums[z] - sums[a]) + text.astype(U) * T.GOLDEN)
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    again = (times[back] > 1) & (words > 0)
    m, k = np.maximum(size, 1.0), np.maximum(words, 1.0)
    x = np.stack(
        [
            np.log1p(size),
            np.log1p(words),
            (length[z] - length[a]) / k / 8,
            *(of[j] / m for j in range(8)),
            (noisy[z] - noisy[a]) / k,
            (marked[z] - marked[a]) / k,
            (alone[z] - alone[a]) / k,
            (long_[z] - long_[a]) / k,
            np.where(z > a, same[z] - same[np.minimum(a + 1, len(same) - 1)], 0) / k,
            again.astype(np.float64),
        ],
        axis=1,
    )
    return x, size.astype(np.float64), first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A one, the line's features, those of the line before and after, and whether there are such lines."""
    n = len(x)
    begins, ends = np.zeros(n, bool), np.zeros(n, bool)
    begins[first[:-1]] = True
    ends[first[1:] - 1] = True
    before, after = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[begins] = 0
    after[ends] = 0
    return np.concatenate([np.ones((n, 1)), x, before, after, begins[:, None], ends[:, None]], axis=1)


def forward_backward(emit: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log of each text's partition sum, P(good) of each line, expected transitions by text pair sum (2, 2)).

    emit: (lines, 2) log potentials; all texts advance together, the longest first."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    top, lens = first[:-1][order], n[order]
    steps = int(n.max(initial=0))
    alive = np.searchsorted(-lens, -np.arange(steps), "left")  # texts with more lines than t
    alpha, beta = np.zeros_like(emit), np.zeros_like(emit)

    def add(v: np.ndarray, t: np.ndarray) -> np.ndarray:  # log-sum-exp over the other line's label
        s = v[:, :, None] + t[None]
        m = s.max(axis=1)
        return m + np.log(np.exp(s - m[:, None]).sum(axis=1))

    alpha[top] = emit[top]
    for t in range(1, steps):
        i = top[: alive[t]] + t
        alpha[i] = emit[i] + add(alpha[i - 1], trans)
    for t in range(steps - 2, -1, -1):
        i = top[: alive[t + 1]] + t
        beta[i] = add(beta[i + 1] + emit[i + 1], trans.T)
    last = first[1:] - 1
    m = alpha[last].max(axis=1)
    z = m + np.log(np.exp(alpha[last] - m[:, None]).sum(axis=1))
    zl = np.repeat(z, n)
    good = np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - zl, 0))
    inner = np.ones(len(emit), bool)
    inner[last] = False
    i = np.flatnonzero(inner)
    pair = np.exp(alpha[i][:, :, None] + trans[None] + (emit[i + 1] + beta[i + 1])[:, None, :] - zl[i][:, None, None]).sum(axis=0)
    return z, good, pair


def _mean(good: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    w = size + 1
    return np.add.reduceat(good * w, first[:-1]) / np.add.reduceat(w, first[:-1]) if len(first) > 1 else np.zeros(0)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


@dataclass
class Field:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray  # of a line's features for good
    trans: np.ndarray
    slope: float
    shift: float
    constant: float | None = None

    def mean_good(self, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        f = with_neighbours((x - self.mean) / self.scale, first) @ self.weight
        _, good, _ = forward_backward(np.stack([np.zeros(len(f)), f], axis=1), self.trans, first)
        return _mean(good, size, first)

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        if not len(texts):
            return np.zeros(0)
        x, size, first = lines(texts)
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(self.mean_good(x, size, first)) + self.shift, -500, 500)))


def fit_rows(x: np.ndarray, size: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 250, ridge: float = 1e-3) -> Field:
    """Maximum likelihood of all lines bearing their document's label, by Adam; each document weighs the same."""
    k = 3 * _BASE + 3
    none = Field(np.zeros(_BASE), np.ones(_BASE), np.zeros(k), np.zeros((2, 2)), 1.0, 0.0)
    if len(label) == 0 or label.min() == label.max():
        none.constant = float((label.sum() + 1) / (len(label) + 2)) if len(label) else 0.5
        return none
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    f = with_neighbours((x - mean) / scale, first)
    n = np.diff(first)
    y = np.repeat(label, n).astype(float)
    per = np.repeat(1 / n, n)  # else a long document would count for all its lines
    inner = n - 1
    theta = np.zeros(k + 3)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    same = np.array([[(inner * (1 - label) / n).sum(), 0], [0, (inner * label / n).sum()]])
    for t in range(1, rounds + 1):
        w, tr = theta[:k], np.array([[theta[k], theta[k + 1]], [theta[k + 1], theta[k + 2]]])
        e = f @ w
        _, good, pair = forward_backward(np.stack([np.zeros(len(e)), e], axis=1), tr, first)
        grad = np.zeros_like(theta)
        grad[:k] = f.T @ ((y - good) * per) / len(label) - ridge * w
        share = pair * (same.sum() / max(pair.sum(), 1e-9))
        d = (same - share) / len(label)
        grad[k:] = np.array([d[0, 0], d[0, 1] + d[1, 0], d[1, 1]]) - 0.02 * theta[k:]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += 0.08 * (1 - t / rounds * 0.8) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    out = Field(mean, scale, theta[:k], np.array([[theta[k], theta[k + 1]], [theta[k + 1], theta[k + 2]]]), 1.0, 0.0)
    z = _logit(out.mean_good(x, size, first))
    a, b = 1.0, 0.0
    for _ in range(50):  # the logistic curve, by damped Newton steps
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -500, 500)))
        r, h = label - p, p * (1 - p) + 1e-6
        g = np.array([(r * z).sum() - 0.1 * (a - 1), r.sum()])
        hess = np.array([[(h * z * z).sum() + 0.1, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        a, b = a + 0.7 * step[0], b + 0.7 * step[1]
    out.slope, out.shift = max(float(a), 1e-3), float(b)
    return out


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, bound: int = BOUND, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """Fit on at most bound labelled documents that aren't held out."""
    spark = docs.sparkSession
    common.tune(spark)
    some = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").where(~held_out("id"))
    some = some.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(bound)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id")  # bound rows

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = T.column(b, "text")
            for s, e in T.chunks(text):
                x, size, first = lines(text.slice(s, e - s))
                both = np.concatenate([x, size[:, None]], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [T.column(b, "id").slice(s, e - s), T.column(b, "label").slice(s, e - s), pa.array([both[i:j].tobytes() for i, j in zip(first, first[1:])], pa.binary())],
                    names=["id", "label", "x"],
                )

    got = rows.mapInArrow(features, "id long, label int, x binary").toPandas().sort_values(["id", "label", "x"]).drop_duplicates("id")  # bound rows of features
    x = [np.frombuffer(b).reshape(-1, _BASE + 1) for b in got["x"]]
    first = np.concatenate(([0], np.cumsum([len(v) for v in x]))).astype(np.int64)
    x = np.concatenate(x) if x else np.zeros((0, _BASE + 1))
    return fit_rows(x[:, :_BASE], x[:, _BASE], first, got["label"].to_numpy().astype(float))


def scored(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a column more, the score, under the first free of the names score, _score, __score, ..."""
    common.tune(docs.sparkSession)
    name = common.free(docs, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = T.column(b, text_col)
            for s, e in T.chunks(text):
                part = b.slice(s, e - s)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(field.score(text.slice(s, e - s)), pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(0.0).cast("double")).schema)


def classify(docs: DataFrame, labels: DataFrame, bound: int = BOUND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    field = fit(docs, labels, bound, id_col, text_col)
    got = scored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), field, "doc_id", "text")
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
