"""Words and word shingles of a whole Arrow batch at once, by array operations on its UTF-8 bytes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, unchanged. Its hash has two lanes
of 64 bits; each takes the word eight bytes at a time through a mixing function, so that no
arrangement of the bytes cancels out as it does in a polynomial (a long word has a BLAKE2b digest). A
window's hash is a sum of its words' lanes, each times a constant of its own place, mixed again.
Both lanes together are 128 bits: of 1e13 different windows no two are expected to agree (1e26 / 2**128)."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of texts handled at once; a longer text is handled alone.
CHUNK = 4 << 20
#: Windows of a long text that are worked on at once.
SPAN = 1 << 20
GOLDEN = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64: a bijection whose every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _places(lane: int, n: int) -> np.ndarray:
    """An odd constant for each place in a window."""
    return mix(np.arange(1, n + 1, dtype=U) * GOLDEN + U(lane << 32)) | U(1)


#: Bytes from which a word is hashed by itself.
LONG = 256
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], U)
_START, _TIMES = (U(0x243F6A8885A308D3), U(0x13198A2E03707344)), (U(0xA4093822299F31D1), U(0xC0AC29B7C97C50DD))


def eights(data: np.ndarray) -> np.ndarray:
    """At each place of some bytes, the eight from there on as one number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def hashed(data: np.ndarray, start: np.ndarray, size: np.ndarray, lane: int = 0) -> np.ndarray:
    """One 64-bit lane of each slice of the bytes."""
    out = mix(size.astype(U) * GOLDEN + _START[lane])
    v = eights(data)
    todo = np.flatnonzero((size > 0) & (size <= LONG))
    at, left = start[todo], size[todo]
    while len(todo):
        x = v[at] & _MASK[np.minimum(left, 8)]
        out[todo] = mix((out[todo] ^ x) * _TIMES[lane])
        on = left > 8
        todo, at, left = todo[on], at[on] + 8, left[on] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        d = hashlib.blake2b(data[start[i] : start[i] + size[i]].data, digest_size=16).digest()
        out[i] = np.frombuffer(d, U)[lane]
    return out


def equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the slices of some sizes at a and at b hold the same bytes."""
    out = np.ones(len(a), bool)
    v = eights(data)
    todo = np.flatnonzero((a != b) & (size > 0))
    far = 0
    while len(todo):
        left = size[todo] - far
        same = (v[a[todo] + far] ^ v[b[todo] + far]) & _MASK[np.minimum(left, 8)] == 0
        out[todo[~same]] = False
        todo = todo[same & (left > 8)]
        far += 8
        if far >= LONG:
            for i in todo.tolist():
                out[i] = bytes(data[a[i] : a[i] + size[i]]) == bytes(data[b[i] : b[i] + size[i]])
            break
    return out


@dataclass
class Words:
    """data: the bytes; off: where each text begins in them, and the end; start, end: of each
    word; first: index of each text's first word, and the number of words."""

    data: np.ndarray
    off: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __post_init__(self) -> None:
        self._lanes: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.off) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def hash(self, lo: int = 0, hi: int | None = None, lane: int = 0) -> np.ndarray:
        """Of the words lo to hi."""
        if lane not in self._lanes:
            parts = [hashed(self.data[self.start[a] : self.end[z - 1]], self.start[a:z] - self.start[a], self.end[a:z] - self.start[a:z], lane) for a, z in self.spans()]
            self._lanes[lane] = np.concatenate(parts) if parts else np.zeros(0, U)
        return self._lanes[lane][lo:hi]

    def text_of(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """The text of each of the words lo to hi."""
        hi = len(self.start) if hi is None else hi
        return np.repeat(np.arange(len(self)), np.diff(np.clip(self.first, lo, hi)))

    def spans(self, step: int = 1) -> Iterator[tuple[int, int]]:
        """(lo, hi) ranges of words, of SPAN or so, that begin at multiples of step."""
        n = len(self.start)
        size = max(step, SPAN // step * step)
        for lo in range(0, n, size):
            yield lo, min(n, lo + size)

    def windows(self, k: int, lo: int = 0, hi: int | None = None, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each of the words lo to hi on, and whether they all lie in its text."""
        hi = len(self.start) if hi is None else hi
        h = self.hash(lo, hi + k - 1, lane)
        out = np.zeros(hi - lo, U)
        m = min(hi - lo, len(h) - k + 1)
        if m > 0:
            for j, c in enumerate(_places(lane, k)):
                out[:m] += h[j : j + m] * c
            out = mix(out)
        last = np.repeat(self.first[1:], np.diff(np.clip(self.first, lo, hi)))
        return out, np.arange(lo, hi) + k <= last

    def whole(self, lane: int = 0) -> np.ndarray:
        """A hash of each text's words in their order; 0 of a text without words."""
        n = self.n_words
        at = np.arange(len(self.start)) - np.repeat(self.first[:-1], n)
        x = mix(self.hash(lane=lane) + mix((at + 1).astype(U) * GOLDEN))
        out = np.zeros(len(self), U)
        some = np.flatnonzero(n)
        if len(some):
            out[some] = mix(np.add.reduceat(x, self.first[:-1][some]) + n[some].astype(U))
        return out

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, number per text) of all k-word shingles; a text of fewer words has one, of all its words."""
        n = self.n_words
        count = np.maximum(n - k + 1, 0)
        short = np.flatnonzero((n > 0) & (n < k))
        if not len(short):
            got = [h[ok] for h, ok in (self.windows(k, lo, hi) for lo, hi in self.spans())]
            return np.concatenate(got) if got else np.zeros(0, U), count
        h, ok = self.windows(k)
        at = self.first[:-1][short]
        h[at] = self.whole()[short]
        ok[at] = True
        count[short] = 1
        return h[ok], count


def of(texts: pa.Array) -> Words:
    """Words of a string array; a null is an empty text."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    buffers = texts.buffers()
    off = np.frombuffer(buffers[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[off[0] : off[-1]] if buffers[2] is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    n = len(data)
    solid = ~_SPACE[data]
    beside = np.zeros(n, bool)
    if n:
        beside[1:] = solid[:-1]
        beside[off[:-1][off[:-1] < n]] = False
        start = np.flatnonzero(solid & ~beside)
        beside[-1] = False
        beside[:-1] = solid[1:]
        beside[off[1:][off[1:] > 0] - 1] = False
        end = np.flatnonzero(solid & ~beside) + 1
    else:
        start = end = np.zeros(0, np.int64)
    del beside
    first = np.searchsorted(start, off)
    return Words(data, off, start, end, first)


_handled = 0
_libc = None


def trim(size: int) -> None:
    """Give freed memory back to the system each time 16 MB of texts have been handled: a worker outlives its task,
    and the allocator would keep for it what its largest arrays took."""
    global _handled, _libc
    _handled += size
    if _handled < 16 << 20:
        return
    _handled = 0
    pa.default_memory_pool().release_unused()
    try:
        _libc = _libc or ctypes.CDLL("libc.so.6")
        _libc.malloc_trim(0)
    except (OSError, AttributeError):  # another system's library
        pass


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """(from, to) ranges of texts with limit bytes together at most, or of one text."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > at and held + n > limit:
            yield at, i
            at, held = i, 0
        held += n
    if len(size) > at:
        yield at, len(size)
    trim(int(size.sum()))


def column(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))
