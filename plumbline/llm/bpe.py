"""Byte-level BPE encoding and decoding in two tiers.

A text is split into pre-tokens by the vocabulary's pattern, each match apart. A minimal perfect
hash finds the entry that a pre-token could be as a whole, and their bytes are compared. Any other is merged from its
bytes: a heap holds the ranks of neighbouring pieces, a doubly linked list the pieces; the lowest
rank, leftmost first, is merged until no neighbours form an entry. Equal pre-tokens are merged once
a worker (the cache is bounded). Decoding joins the entries of the ids.

A null text is empty; an empty text has no ids. Other columns are ignored."""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, mph, pretokens
from . import textwords as T


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token by merges from single bytes."""
    n = len(word)
    end = list(range(1, n + 1))  # of the piece that starts here; 0: no piece starts here
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue  # one of the two has been merged otherwise
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        h = before[i]
        if h >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def _keys(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in words), np.uint64)


class ByteCoder:
    def __init__(self, path: str) -> None:
        self.ranks = load_ranks(path)
        self.entry = [b""] * (max(self.ranks.values()) + 1)
        for k, v in self.ranks.items():
            self.entry[v] = k
        whole = []
        for k, v in self.ranks.items():
            try:
                whole.append((k.decode("utf-8"), v))
            except UnicodeDecodeError:  # part of a character: never a whole pre-token
                pass
        keys = _keys([w.encode() for w, _ in whole])
        self.mph = mph.build(keys)
        self.id = np.zeros(len(keys), np.int32)
        self.id[self.mph.slot(keys)] = [v for _, v in whole]
        self.cache = pretokens.Cache(self._encode, 2 * pretokens.KEPT)  # merges in Python are dear
        self.decimal = [str(i) for i in range(len(self.entry))]

    def _encode(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        ids = self.id[self.mph.slot(_keys(raw))].tolist()
        return [[i] if self.entry[i] == w else merge(w, self.ranks) for w, i in zip(raw, ids)]

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        s, c, off = pretokens.codepoints(texts)
        return self.cache.ids(s, c, off, *pretokens.split(c, off, False))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the end)."""
        rows = texts.to_pylist()
        if any(x and len(x) > pretokens.PIECE for x in rows):
            return pretokens.in_pieces([pretokens.pieces(x or "") for x in rows], self._plain)
        return self._plain(texts)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.entry.__getitem__, ids))


@functools.cache
def byte_coder(path: str) -> ByteCoder:
    """One for each worker."""
    return ByteCoder(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row."""
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_coder(path)
        for b in batches:
            text = T.column(b, "text")
            for s, e in T.chunks(text):
                ids, cut = coder.encode(text.slice(s, e - s))
                yield pa.RecordBatch.from_arrays([T.column(b, "doc_id").slice(s, e - s), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes) of rows (doc_id, ids); a null list has no bytes; an unknown id is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_coder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([T.column(b, "doc_id"), pa.array([coder.decode(x or []) for x in T.column(b, "ids").to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, decoded from the ids alone."""
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_coder(path)
        dec = coder.decimal.__getitem__
        for b in batches:
            text = T.column(b, "text")
            for s, e in T.chunks(text, 2 << 20):
                ids, cut = coder.encode(text.slice(s, e - s))
                ids, cut = ids.tolist(), cut.tolist()
                rows = [ids[i:j] for i, j in zip(cut, cut[1:])]
                a = [hashlib.sha256(",".join(map(dec, r)).encode()).hexdigest() for r in rows]
                z = [hashlib.sha256(coder.decode(r)).hexdigest() for r in rows]
                yield pa.RecordBatch.from_arrays([T.column(b, "doc_id").slice(s, e - s), pa.array(list(map(len, rows)), pa.int64()), pa.array(a), pa.array(z)], schema=_OUT)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
