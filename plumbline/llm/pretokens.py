"""Pre-tokens of many texts at once, by array operations on code points, and a cache of their ids.

Both vocabularies split a text by a pattern before any merges, so equal pre-tokens have equal ids:
each distinct one is encoded once a worker (the cache is bounded), all others are looked up by their
characters."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex

from . import textwords as T

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Distinct pre-tokens kept by a worker, and characters and ids of them for each; then the cache starts afresh.
KEPT, KEPT_SIZE = 300_000, 80
#: Characters of a text, or of texts, encoded at once.
PIECE = 2 << 20
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def classes() -> np.ndarray:
    """Of each code point: white space, letter, number or other."""
    out = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, range(0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, everything):
            out[m.start() : m.end()] = kind
    out[_WHITE] = SPACE
    return out


@functools.cache
def lower() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point, its lower case, and whether class and lower case are settled: assigned
    long ago, with a lower case of one old code point. Others may differ between libraries."""
    old = unicodedata.ucd_3_2_0
    low = np.arange(0x110000, dtype=np.uint32)
    settled = np.zeros(0x110000, bool)
    for c in range(0x30000):
        ch = chr(c)
        kind = old.category(ch)
        if kind in ("Cn", "Cs", "Co") or kind[0] != unicodedata.category(ch)[0]:
            continue
        s = ch.lower()
        if len(s) == 1 and old.category(s) != "Cn":
            low[c] = ord(s)
            settled[c] = True
    return low, settled


def codepoints(texts: pa.Array) -> tuple[str, np.ndarray, np.ndarray]:
    """(all texts as one string, its code points, where each text begins and the end)."""
    w = texts.to_pylist()
    s = "".join(x or "" for x in w)
    off = np.zeros(len(w) + 1, np.int64)
    np.cumsum([len(x) if x else 0 for x in w], out=off[1:])
    return s, np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32), off


def _contractions(c: np.ndarray, start: np.ndarray, stop: np.ndarray, kind: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one apostrophe that begin a match, before s t m d re ve ll: their numbers, and how many letters they take."""
    i = np.flatnonzero((kind[:-1] == OTHER) & (stop[:-1] - start[:-1] == 1) & open_[:-1] & (kind[1:] == LETTER)) if len(kind) > 1 else np.zeros(0, np.int64)
    i = i[c[start[i]] == ord("'")]
    a = c[start[i + 1]]
    long = stop[i + 1] - start[i + 1] > 1
    z = c[np.minimum(start[i + 1] + 1, len(c) - 1)] if len(i) else a
    n = np.where(np.isin(a, [ord(x) for x in "stmd"]), 1, 0)
    for x, y in ("re", "ve", "ll"):
        n[(a == ord(x)) & (z == ord(y)) & long] = 2
    return i[n > 0], n[n > 0]


def split(c: np.ndarray, off: np.ndarray, words_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the pre-tokens of texts at off in the code points c.

    words_only: letters, single digits, other characters and contractions, without white space.
    Else: public_tokenizers.PATTERN, in which a run takes the space before it."""
    if not len(c):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls = classes()[c]
    bound = np.zeros(len(c) + 1, bool)
    bound[off] = True
    edge = bound.copy()
    bound[1:-1] |= cls[1:] != cls[:-1]
    at = np.flatnonzero(bound)
    start, stop = at[:-1], at[1:]
    kind = cls[start]
    if words_only:
        open_ = ~edge[stop]  # the next run is of the same text
        i, n = _contractions(c, start, stop, kind, open_)
        bound[:-1] |= cls == NUMBER
    else:
        inside = (kind == SPACE) & ~edge[stop]
        joined = inside & (c[stop - 1] == 0x20)
        open_ = ~edge[stop]
        open_[1:] &= ~joined[:-1]
        i, n = _contractions(c, start, stop, kind, open_)
        bound[stop[joined]] = False
        bound[stop[inside] - 1] = True
    if len(i):
        bound[start[i + 1]] = False
        bound[start[i + 1] + n] = True
    at = np.flatnonzero(bound)
    start, stop = at[:-1], at[1:]
    if words_only:
        solid = cls[start] != SPACE
        start, stop = start[solid], stop[solid]
    return start, stop


def distinct(c: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(of each distinct slice, one place; of each slice, the number of its like). Hashes bring equal
    slices together, and every slice is compared with the one it is taken for."""
    top = int(c.max())
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    data = np.ascontiguousarray(c.astype(f"<u{width}")).view(np.uint8)
    at, size = start * width, (stop - start) * width
    _, first, back = np.unique(T.hashed(data, at, size), return_index=True, return_inverse=True)
    like = first[back]
    odd = np.flatnonzero((size != size[like]) | ~T.equal(data, at, at[like], np.minimum(size, size[like])))
    if len(odd):  # equal hashes of different slices
        more: dict[bytes, int] = {}
        for i in odd.tolist():
            back[i] = len(first) + more.setdefault(bytes(data[at[i] : at[i] + size[i]]), len(more))
        fresh = np.unique(back[odd], return_index=True)[1]
        first = np.concatenate([first, odd[fresh]])
    return first, back


class Cache:
    """Ids of pre-tokens by the pre-tokens themselves. encode: ids of each of a list of them."""

    def __init__(self, encode: Callable[[list[str]], list], kept: int = KEPT) -> None:
        self.encode, self.kept = encode, kept
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.first, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.rows = 0

    def _add(self, rows: list, keys: list[str]) -> range:
        n, k = self.rows, len(rows)
        sizes = np.fromiter(map(len, rows), np.int64, k)
        total = int(sizes.sum())
        while len(self.pool) < self.used + total:
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while len(self.first) < n + k:
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        self.pool[self.used : self.used + total] = np.fromiter((i for r in rows for i in r), np.int32, total)
        self.size[n : n + k] = sizes
        self.first[n : n + k] = self.used + np.cumsum(sizes) - sizes
        self.used += total
        self.rows += k
        self.held += sum(map(len, keys))
        self.known.update(zip(keys, range(n, n + k)))
        return range(n, n + k)

    def ids(self, s: str, c: np.ndarray, off: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens in order, where each text's begin and the end). s: the characters of c."""
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        if len(self.known) > self.kept or max(self.held, self.used) > self.kept * KEPT_SIZE:
            self.clear()
        first, back = distinct(c, start, stop)
        keys = [s[i:j] for i, j in zip(start[first].tolist(), stop[first].tolist())]
        have = [self.known.get(k, -1) for k in keys]
        new = [i for i, v in enumerate(have) if v < 0]
        if new:
            fresh = [keys[i] for i in new]
            for i, v in zip(new, self._add(self.encode(fresh), fresh)):
                have[i] = v
        row = np.array(have, np.int64)[back]
        size = self.size[row]
        end = np.concatenate(([0], np.cumsum(size)))
        flat = self.pool[np.repeat(self.first[row] - end[:-1], size) + np.arange(end[-1])]
        return flat, end[np.searchsorted(start, off)]


_BREAK = re.compile("(?<=[^{0}])[{0}]".format("".join(map(chr, _WHITE))))


def pieces(text: str, limit: int = 0) -> list[str]:
    """A long text in pieces that begin where white space does: there both vocabularies' patterns
    begin a match, whatever came before."""
    limit = limit or PIECE
    out, at = [], 0
    while len(text) - at > limit:
        m = _BREAK.search(text, at + limit)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def in_pieces(parts: list[list], encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, where each text's begin and the end) of texts given as lists of strings, and
    of single ids that stand for themselves. Strings are encoded PIECE characters or so at a time."""
    got: list[list[np.ndarray]] = [[] for _ in parts]
    held: list[tuple[int, int, str]] = []

    def flush() -> None:
        if held:
            ids, cut = encode(pa.array([s for _, _, s in held], pa.large_string()))
            for (i, k, _), a, b in zip(held, cut.tolist(), cut[1:].tolist()):
                got[i][k] = ids[a:b]
            held.clear()

    size = 0
    for i, p in enumerate(parts):
        for x in p:
            if isinstance(x, int):
                got[i].append(np.array([x], np.int32))
                continue
            got[i].append(np.zeros(0, np.int32))
            held.append((i, len(got[i]) - 1, x))
            size += len(x)
            if size > PIECE:
                flush()
                size = 0
    flush()
    cut = np.concatenate(([0], np.cumsum([sum(map(len, g)) for g in got]))).astype(np.int64)
    flat = [a for g in got for a in g]
    return np.concatenate(flat) if flat else np.zeros(0, np.int32), cut


def _byte_alphabet() -> dict[int, int]:
    """The printable character that byte-level models write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class WordCoder:
    """Ids by the tokenizers library for a vocabulary that lower-cases and drops white space.

    Every distinct word's merges are the library's, by its model; texts with a character whose class or case is
    not settled among Unicode versions are encoded by it as a whole, long ones in pieces. The strings of
    its special tokens in a text are these tokens, as the library takes them by default."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        model, alphabet = self.library.model, _byte_alphabet()
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        for t in self.library.get_added_tokens_decoder().values():
            if t.normalized or t.lstrip or t.rstrip or t.single_word:
                raise ValueError(f"special token with options: {t.content}")
        # the leftmost one counts, the longest of those
        self.between = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.cache = Cache(lambda words: [[t.id for t in model.tokenize(w.encode("utf-8", "surrogatepass").decode("latin-1").translate(alphabet))] for w in words])

    def _parts(self, text: str) -> list:
        out, at = [], 0
        for m in self.between.finditer(text):
            out += [*pieces(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return [*out, *pieces(text[at:])]

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of texts without special tokens."""
        s, c, off = codepoints(texts)
        low, settled = lower()
        whole: dict[int, list[int]] = {}
        if len(c) and int(c.max()) >= 0x300:
            lines = [s[i:j] for i, j in zip(off.tolist(), off[1:].tolist())]
            for i in np.unique(np.searchsorted(off, np.flatnonzero(c >= 0x300), "right") - 1).tolist():
                if settled[c[off[i] : off[i + 1]]].all() and settled[np.frombuffer((t := unicodedata.normalize("NFC", lines[i])).encode("utf-32-le", "surrogatepass"), np.uint32)].all():
                    lines[i] = t
                else:
                    whole[i], lines[i] = self.library.encode(lines[i], add_special_tokens=False).ids, ""
            s, c, off = codepoints(pa.array(lines, pa.large_string()))
        if not settled[c].all():
            bad = np.unique(np.searchsorted(off, np.flatnonzero(~settled[c]), "right") - 1).tolist()
            lines = [s[i:j] for i, j in zip(off.tolist(), off[1:].tolist())]
            for i in bad:
                whole[i], lines[i] = self.library.encode(lines[i], add_special_tokens=False).ids, ""
            s, c, off = codepoints(pa.array(lines, pa.large_string()))
        c = low[c]
        s = c.tobytes().decode("utf-32-le", "surrogatepass")
        ids, cut = self.cache.ids(s, c, off, *split(c, off, True))
        if whole:
            parts = [np.array(whole[i], np.int32) if i in whole else ids[cut[i] : cut[i + 1]] for i in range(len(off) - 1)]
            ids, cut = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, cut

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the end); end: id after each text."""
        rows = texts.to_pylist()
        if any(x and (len(x) > PIECE or any(t in x for t in self.special)) for x in rows):
            ids, cut = in_pieces([self._parts(x or "") for x in rows], self._plain)
        else:
            ids, cut = self._plain(texts)
        if end is None:
            return ids, cut
        to = cut + np.arange(len(cut))
        out = np.empty(len(ids) + len(cut) - 1, np.int32)
        last = np.zeros(len(out), bool)
        last[to[1:] - 1] = True
        out[last] = end
        out[~last] = ids
        return out, to


@functools.cache
def word_coder(path: str) -> WordCoder:
    """One for each worker."""
    return WordCoder(path)
