"""Minimal perfect hashing by hash and displace: n distinct keys onto the slots 0..n-1, found by two
array look-ups. Buckets of about four keys are placed from the largest down, each with the first
displacement that puts all its keys on free slots; a bucket of one key names its slot outright."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .textwords import mix

U = np.uint64
_BUCKET, _SLOT, _PRINT = U(0x8CB92BA72F3D8DD7), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)


@dataclass
class Mph:
    n: int
    shift: np.ndarray  # of each bucket; -1 - slot where it names a slot

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that isn't in the set, some slot."""
        if not self.n:
            return np.zeros(len(keys), np.int64)
        d = self.shift[_bucket(keys, len(self.shift))]
        return np.where(d < 0, -1 - d, _slot(keys, d, self.n))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    """Stored in a key's slot; tells a key of the set from others."""
    return mix(keys ^ _PRINT)


def _bucket(keys: np.ndarray, r: int) -> np.ndarray:
    return (mix(keys ^ _BUCKET) % U(r)).astype(np.int64)


def _slot(keys: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    return (mix(keys + (d.astype(U) + U(1)) * _SLOT) % U(n)).astype(np.int64)


def build(keys: np.ndarray) -> Mph:
    """keys: distinct unsigned 64-bit numbers; ValueError if some are equal."""
    n = len(keys)
    r = max(1, n // 4)
    shift = np.zeros(r, np.int64)
    if not n:
        return Mph(0, shift)
    if len(np.unique(keys)) != n:
        raise ValueError("equal keys")
    keys = keys[np.argsort(_bucket(keys, r), kind="stable")]
    b = _bucket(keys, r)
    first = np.searchsorted(b, np.arange(r + 1))
    size = np.diff(first)
    taken = np.zeros(n, bool)
    for k in range(int(size.max()), 1, -1):
        todo = np.flatnonzero(size == k)
        d = 0
        while len(todo):
            # several displacements at once when few buckets are left to place
            tries = int(np.clip(200_000 // (len(todo) * k), 1, 256))
            own = keys[first[todo][:, None] + np.arange(k)]
            ds = np.arange(d, d + tries)
            s = _slot(np.repeat(own[:, None, :], tries, axis=1).ravel(), np.tile(np.repeat(ds, k), len(todo)), n).reshape(len(todo), tries, k)
            good = ~taken[s].any(axis=2)
            for i in range(k):
                for j in range(i):
                    good &= s[:, :, i] != s[:, :, j]
            which = good.argmax(axis=1)
            g = np.flatnonzero(good.any(axis=1))
            s = s[g, which[g]]
            # of those that want one slot, the first gets it
            claim = np.full(n, -1)
            claim[s.ravel()[::-1]] = np.repeat(g, k)[::-1]
            got = (claim[s] == g[:, None]).all(axis=1) if len(g) else np.zeros(0, bool)
            taken[s[got].ravel()] = True
            shift[todo[g[got]]] = ds[which[g[got]]]
            placed = g[got]
            lost = len(g) > len(placed)
            todo = np.delete(todo, placed)
            if not lost or tries == 1:  # who lost a slot to another tries the same displacements again
                d += tries
            if d > 50_000_000:
                raise RuntimeError("no displacement found")
    one = np.flatnonzero(size == 1)
    shift[one] = -1 - np.flatnonzero(~taken)[: len(one)]
    return Mph(n, shift)
