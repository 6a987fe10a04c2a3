"""Sorted sets of 64-bit numbers as compact bytes: differences, split into byte planes, compressed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_CODEC = pa.Codec("zstd", compression_level=1)


def put(x: np.ndarray) -> bytes:
    """Any array of 8-byte integers; small or slowly growing ones take little room."""
    raw = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(x).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def get(b: bytes, kind=np.uint64) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    raw = np.frombuffer(_CODEC.decompress(b[8:], n * 8, asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).reshape(-1).view(kind)


def put_sorted(x: np.ndarray) -> bytes:
    return put(np.diff(x, prepend=x.dtype.type(0)))


def get_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(get(b), dtype=np.uint64)
