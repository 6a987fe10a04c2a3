"""Near-duplicate documents by SimHash and navigable small-world graphs over Hamming distance.

Two documents are near duplicates when the sets of their five-word shingles have a Jaccard
similarity of 0.8 or more; classes are what such links connect. A text of fewer than five words has
one shingle, all its words.

1. One pass gives each text a 128-bit SimHash of its shingles, MINHASHES least hashes of them and a
   128-bit hash of its words. Texts of equal words are one node from here on, so groups of copies,
   however large, cost no pair.
2. Nodes are sent to shards by each of their least hashes. Texts of similarity 0.8 meet in some
   shard but for one in 16,000 at 0.8 itself (0.2 ** 6), so queries go out to the shards that can
   hold an answer instead of to all, and work stays in proportion to the number of documents.
3. Each shard grows a small-world graph: every node in turn searches those before it with a beam,
   from the latest nodes of the same least hash and from a few others, and is linked to its nearest.
   What it finds within the radius are candidates, if the numbers of their shingles and 128-byte
   sketches leave the similarity possible. A beam that is full within the radius is doubled, up to a limit; of nodes still full at the limit the answer is completed by the exact search below.
   A sample of queries in each shard is searched exactly as well, over all its nodes; where one of their pairs isn't among
   the candidates, the whole shard is searched exactly.
4. Candidates are verified on their whole texts: first each node's nearest, whose links make
   classes; then all candidates whose ends are in different classes. For nodes whose beams stayed
   full an exact scan of their shards finds every node of another class within the radius. A pair
   within one class needs no proof, so a large group of near copies never costs all its pairs.
5. The audit of the whole: AUDIT documents, chosen by a hash of their ids, are compared with every document by
   their shingles themselves, in the pass of step 1, with no shard, radius or sketch between. Links that are found
   so and are within no class are added; if less than RECALL were found without, all is done again with a larger radius and wider beams.

With spread="all", queries go out to the graphs of all shards instead of those of their least hashes; the work
then grows with the square of the corpus (README has figures).

A shard of more than BLOCK nodes, as one very common least hash makes it, is divided into blocks of
which each has a graph of its own, searched by the nodes of the later ones.

Null and empty texts have no shingles and link with nothing; their rows are their own class. Rows
without an id link with nothing and have no class. Rows of equal id count as one document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textwords as T

U = np.uint64
MINHASHES = 6
RADIUS, RADIUS_SHORT, SHORT = 38, 46, 20
#: Shards, times least hashes, up to which their table is broadcast (some twelve bytes a row).
BROADCAST_ROWS = 1_000_000
#: Bytes of a sketch, and the share of equal ones from which a pair is verified. At a similarity of
#: 0.8 the share has a standard deviation of 0.035 at most: 0.64 is over four and a half below.
SKETCH, ALIKE = 128, 0.64
SHARD, BLOCK = 8192, 32768
LINKS, SAME, ENTRIES, BATCH = 8, 4, 8, 256
RECALL = 0.98
#: Documents audited against all, the most shingles of one, and how far the radius may grow after a poor audit.
AUDIT, AUDIT_SHINGLES, WIDEST = 128, 20_000, 24
_FAR = 999
_SEEDS = T.mix(np.arange(1, 40, dtype=U) * U(0x9E3779B97F4A7C15))
_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], U)  # a bit to a byte each


def distinct(h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text once."""
    text = np.repeat(np.arange(len(count)), count)
    o = np.argsort(h, kind="stable")  # equal hashes of one text come together
    again = np.zeros(len(h), bool)
    again[o[1:]] = (h[o[1:]] == h[o[:-1]]) & (text[o[1:]] == text[o[:-1]])
    return h[~again], count - np.bincount(text[again], minlength=len(count))


def simhash(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """(texts, 2) of shingle hashes h, of which each text has count. Bit set where most hashes have it set."""
    n = len(count)
    out = np.zeros((n, 2), U)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    first = np.concatenate(([0], np.cumsum(count[full])))
    # sums in bytes hold up to 255 hashes: blocks of that, then sums of blocks
    blocks = -(-count[full] // 255)
    block_first = np.repeat(first[:-1], blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    text_block = np.cumsum(blocks) - blocks
    to = np.append(block_first, len(h))
    for k in range(2):
        sums = np.empty((len(block_first), 64), np.uint8)
        for s in range(0, len(block_first), 4096):  # at most a million hashes at once
            e = min(s + 4096, len(block_first))
            bits = T.mix(h[to[s] : to[e]] ^ _SEEDS[30 + k]).view(np.uint8).reshape(-1, 8)
            sums[s:e] = np.add.reduceat(_SPREAD[bits], to[s:e] - to[s], axis=0).view(np.uint8).reshape(e - s, 64)
        ones = np.add.reduceat(sums.astype(np.int32), text_block, axis=0)
        out[full, k] = np.packbits(2 * ones > count[full][:, None], axis=1, bitorder="little").view(U).ravel()
    return out


class Sample:
    """Some documents' distinct shingles, and which other texts reach a similarity with them."""

    def __init__(self, ids: list[int], same: list[tuple[int, int]], shingles: list[np.ndarray], similarity: float) -> None:
        self.ids, self.same, self.size = ids, same, np.array([len(x) for x in shingles], np.int64)
        self.parts = round(similarity * 1_000_000)
        h = np.concatenate([np.zeros(0, U), *shingles])
        o = np.argsort(h, kind="stable")
        self.h, self.owner = h[o], np.repeat(np.arange(len(ids)), self.size)[o]

    def near(self, h: np.ndarray, count: np.ndarray, same: np.ndarray) -> list[list[int] | None]:
        """Of each text with those shingles, the sample's documents of other words that are similar enough; None for none."""
        out: list[list[int] | None] = [None] * len(count)
        if not len(self.h) or not len(h):
            return out
        low = np.searchsorted(self.h, h)
        hit = np.flatnonzero(self.h[np.minimum(low, len(self.h) - 1)] == h)
        if not len(hit):
            return out
        many = np.searchsorted(self.h, h[hit], "right") - low[hit]
        text = np.repeat(np.repeat(np.arange(len(count)), count)[hit], many)
        at = np.repeat(low[hit], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        key, both = np.unique(text * len(self.ids) + self.owner[at], return_counts=True)
        text, owner = key // len(self.ids), key % len(self.ids)
        ok = both * 1_000_000 >= (count[text] + self.size[owner] - both) * self.parts
        for t, o in zip(text[ok].tolist(), owner[ok].tolist()):
            if self.same[o] != (int(same[t, 0]), int(same[t, 1])):
                out[t] = [*(out[t] or ()), o]
        return out


def _sampled(docs: DataFrame, k: int, similarity: float) -> Sample:
    """AUDIT documents (doc_id, text) or fewer, by a hash of their ids; very long ones are left out of the audit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = T.of(T.column(b, "text"))
            h, count = distinct(*w.shingles(k))
            cut = np.concatenate(([0], np.cumsum(count))).tolist()
            few = [i for i, n in enumerate(count.tolist()) if 0 < n <= AUDIT_SHINGLES]
            same = [w.whole(j).view(np.int64) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([T.column(b, "doc_id").take(pa.array(few, pa.int64())), *(pa.array(x[few]) for x in same), pa.array([h[cut[i] : cut[i + 1]].tobytes() for i in few], pa.binary())], names=["doc_id", "t0", "t1", "h"])

    some = docs.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(AUDIT)
    rows: dict = {}
    for r in some.mapInArrow(run, "doc_id long, t0 long, t1 long, h binary").collect():  # AUDIT rows at most
        rows.setdefault((r["t0"] % 2**64, r["t1"] % 2**64), (r["doc_id"], np.frombuffer(bytes(r["h"]), U)))
    return Sample([i for i, _ in rows.values()], list(rows), [h for _, h in rows.values()], similarity)


def signatures(w: T.Words, k: int, sample: Sample | None = None) -> dict:
    h, count = distinct(*w.shingles(k))
    n = len(w)
    some = np.flatnonzero(count)
    first = np.concatenate(([0], np.cumsum(count[some])))[:-1]
    least = np.zeros((n, MINHASHES), U)
    for i in range(MINHASHES):
        if len(some):
            least[some, i] = np.minimum.reduceat(T.mix(h ^ _SEEDS[i]), first)
    x = T.mix(h ^ _SEEDS[12])
    bins = np.full(n * SKETCH, U(2**64 - 1))
    np.minimum.at(bins, np.repeat(np.arange(n), count) * SKETCH + (x & U(SKETCH - 1)).astype(np.int64), x)
    sketch = np.where(bins == U(2**64 - 1), 0, 1 + T.mix(bins) % U(255)).astype(np.uint8).reshape(n, SKETCH)
    same = np.stack([w.whole(0), w.whole(1)], axis=1)
    near = sample.near(h, count, same) if sample else [None] * n
    return {"count": count, "sim": simhash(h, count), "least": least, "same": same, "sketch": sketch, "near": near}


_SIGNED = "doc_id long, n int, t0 long, t1 long, s0 long, s1 long, least array<long>, sketch binary, near array<int>"


def _sign(k: int, sample: Sample):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = T.column(b, "text")
            for s, e in T.chunks(text, 2 << 20):
                x = signatures(T.of(text.slice(s, e - s)), k, sample)
                least = pa.ListArray.from_arrays(pa.array(np.arange(0, (e - s + 1) * MINHASHES, MINHASHES), pa.int32()), pa.array(x["least"].view(np.int64).ravel()))
                cols = [T.column(b, "doc_id").slice(s, e - s), pa.array(x["count"], pa.int32()), *(pa.array(np.ascontiguousarray(x[c][:, i]).view(np.int64)) for c in ("same", "sim") for i in (0, 1)), least, pa.array([r.tobytes() for r in x["sketch"]], pa.binary()), pa.array(x["near"], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "t0", "t1", "s0", "s1", "least", "sketch", "near"])

    return run


class Graph:
    """The nodes of one shard: sim (n, 2), anchor, count, and which of them are indexed (the first ones)."""

    def __init__(self, sim: np.ndarray, anchor: np.ndarray, count: np.ndarray, sketch: np.ndarray, indexed: int, similarity: float = 0.8, wider: int = 0) -> None:
        self.sim, self.anchor, self.count, self.indexed = sim, anchor.tolist(), count, indexed
        self.links = np.full((indexed, 2 * LINKS), -1, np.int32)
        self.back = np.zeros(indexed, np.int64)
        self.latest: dict[int, list[int]] = {}
        self.radius = np.where(count < SHORT, RADIUS_SHORT, RADIUS) + wider
        self.similarity, self.sketch, self.alike = similarity, sketch, ALIKE - 0.01 * wider

    def distance(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        d = np.bitwise_count(self.sim[nodes] ^ self.sim[q][:, None, :]).astype(np.int16).sum(axis=2, dtype=np.int16)
        return np.where(nodes < 0, np.int16(_FAR), d)

    def fits(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether two nodes' numbers of distinct shingles let them reach the similarity, and their
        sketches (the least hash in each of SKETCH classes of shingles) make it likely."""
        a, b = np.minimum(self.count[i], self.count[j]), np.maximum(self.count[i], self.count[j])
        ok = a.astype(np.int64) * 1_000_000 >= b.astype(np.int64) * round(self.similarity * 1_000_000)
        some = np.flatnonzero(ok)
        for s in range(0, len(some), 20_000):
            k = some[s : s + 20_000]
            x, y = self.sketch[i[k]], self.sketch[j[k]]
            ok[k] = ((x == y) & (x > 0)).sum(axis=1) >= self.alike / 0.8 * self.similarity * ((x > 0) | (y > 0)).sum(axis=1)
        return ok

    def beam(self, q: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, distances) of the nearest found, nearest first, for each query; -1 where fewer."""
        n = len(q)
        ids = np.full((n, width), -1, np.int32)
        entries = np.sort(entries, axis=1)
        entries[:, 1:][entries[:, 1:] == entries[:, :-1]] = -1
        m = min(width, entries.shape[1])
        d0 = self.distance(q, entries)
        o = np.argsort(d0, axis=1, kind="stable")[:, :m]
        ids[:, :m] = np.take_along_axis(entries, o, 1)
        dist = np.full((n, width), _FAR, np.int16)
        dist[:, :m] = np.take_along_axis(d0, o, 1)
        ids[dist == _FAR] = -1
        done = ids < 0
        rows = np.arange(n)
        while True:
            rows = rows[~done[rows].all(axis=1)]
            if not len(rows):
                return ids, dist
            own, far, seen = ids[rows], dist[rows], done[rows]
            at = (~seen).argmax(axis=1)
            seen[np.arange(len(rows)), at] = True
            near = self.links[own[np.arange(len(rows)), at]]
            d = self.distance(q[rows], near)
            d[(near[:, :, None] == own[:, None, :]).any(axis=2)] = _FAR
            all_d = np.concatenate([far, d], axis=1)
            o = np.argsort(all_d, axis=1, kind="stable")[:, :width]
            dist[rows] = np.take_along_axis(all_d, o, 1)
            new = np.take_along_axis(np.concatenate([own, near], axis=1), o, 1)
            new[dist[rows] == _FAR] = -1
            ids[rows] = new
            done[rows] = np.take_along_axis(np.concatenate([seen, np.zeros(near.shape, bool)], axis=1), o, 1) | (new < 0)

    def exact(self, q: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node, distance) of all indexed nodes before upto within the queries' radius."""
        out = []
        for i, stop, r in zip(q.tolist(), upto.tolist(), self.radius[q].tolist()):
            d = np.bitwise_count(self.sim[:stop] ^ self.sim[i]).sum(axis=1, dtype=np.int16)
            j = np.flatnonzero(d <= r)
            j = j[self.fits(np.full(len(j), i), j)]
            out.append((np.full(len(j), i), j, d[j]))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3

    def run(self, width: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Insert and search all nodes: (query, node, distance) of the candidates, and the nodes whose beam stayed full."""
        found: list[tuple] = []
        full: list[np.ndarray] = []
        rng = np.random.default_rng(7)
        n = len(self.sim)
        for s in range(0, n, BATCH):
            q = np.arange(s, min(s + BATCH, n))
            before = min(s, self.indexed)
            near, dist = np.full((len(q), 0), -1, np.int32), np.zeros((len(q), 0), np.int16)
            if before:
                entries = np.empty((len(q), ENTRIES), np.int32)
                none = [-1] * SAME
                entries[:, :SAME] = [(self.latest.get(self.anchor[i], none) + none)[:SAME] for i in q.tolist()]
                entries[:, SAME:] = rng.integers(0, before, ENTRIES - SAME)
                near, dist = self.beam(q, entries, width)
                open_, w = np.arange(len(q)), width
                while True:
                    open_ = open_[(dist[open_, -1] <= self.radius[q[open_]])] if w < before else open_[:0]
                    if not len(open_) or w >= limit:
                        break
                    w = min(2 * w, limit)
                    wide, far = self.beam(q[open_], np.concatenate([near[open_], entries[open_]], axis=1), w)
                    grown = [np.full((len(q), w), v, t) for v, t in ((-1, np.int32), (_FAR, np.int16))]
                    grown[0][:, : near.shape[1]], grown[1][:, : near.shape[1]] = near, dist
                    grown[0][open_], grown[1][open_] = wide, far
                    near, dist = grown
                full.append(q[open_])
            # nodes of the same batch see those before them outright
            own = np.bitwise_count(self.sim[q][:, None, :] ^ self.sim[q][None, :, :]).sum(axis=2, dtype=np.int16)
            own[np.triu_indices(len(q))] = _FAR
            own[:, q >= self.indexed] = _FAR
            all_d = np.concatenate([dist, own], axis=1)
            all_n = np.concatenate([near, np.broadcast_to(q.astype(np.int32), (len(q), len(q)))], axis=1)
            i, j = np.nonzero(all_d <= self.radius[q][:, None])
            ok = self.fits(q[i], all_n[i, j])
            found.append((q[i[ok]], all_n[i[ok], j[ok]], all_d[i[ok], j[ok]]))
            add = q[q < self.indexed]
            if len(add):
                m = min(LINKS, all_d.shape[1])
                o = np.argpartition(all_d[: len(add)], m - 1, axis=1)[:, :m] if m < all_d.shape[1] else np.argsort(all_d[: len(add)], axis=1)
                link = np.where(np.take_along_axis(all_d[: len(add)], o, 1) < _FAR, np.take_along_axis(all_n[: len(add)], o, 1), -1)
                self.links[add, :m] = link
                src, dst = np.repeat(add, m), link.ravel()
                src, dst = src[dst >= 0], dst[dst >= 0]
                if len(dst):  # links back, in a ring of LINKS places, the oldest overwritten
                    o = np.argsort(dst, kind="stable")
                    src, dst = src[o], dst[o]
                    nth = np.arange(len(dst)) - np.searchsorted(dst, dst)
                    self.links[dst, LINKS + (self.back[dst] + nth) % LINKS] = src
                    np.add.at(self.back, dst, 1)
                for i in add.tolist():
                    self.latest[self.anchor[i]] = [i, *self.latest.get(self.anchor[i], ())][:SAME]
        cat = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        return *cat, np.concatenate(full) if full else np.zeros(0, np.int64)


_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("d", pa.int32())])
_FOUND_SQL = "kind int, a long, b long, d int"
PAIR, FULL = 0, 1


def _rows(kind: int, a, b, d) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.int32())], schema=_FOUND)


def _shard(t: pa.Table, similarity: float, wider: int) -> tuple[Graph, np.ndarray, dict]:
    cols = {c: t.column(c).to_numpy() for c in t.column_names if c not in ("route", "shard", "block")}
    o = np.lexsort((cols["id"], cols["guest"]))
    cols = {c: v[o] for c, v in cols.items()}
    sketch = np.frombuffer(b"".join(cols["sketch"].tolist()), np.uint8).reshape(len(o), SKETCH)
    sim = np.stack([cols["s0"].view(U), cols["s1"].view(U)], axis=1)
    indexed = int((cols["guest"] == 0).sum())
    return Graph(sim, cols["anchor"], cols["n"], sketch, indexed, similarity, wider), cols["id"], cols


def _search(width: int, limit: int, similarity: float, wider: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.groups(batches, ["route", "shard", "block"]):
            if t.num_rows < 2:
                continue
            g, ids, _ = _shard(t, similarity, wider)
            q, j, d, full = g.run(width, limit)
            # the audit: some queries against all nodes before them
            some = np.flatnonzero(T.mix(ids.view(U).copy()) % U(64) == 0)
            some = some[~np.isin(some, full)][:64]
            eq, ej, _ = g.exact(some, np.minimum(some, g.indexed))
            if not np.isin(eq * len(ids) + ej, q.astype(np.int64) * len(ids) + j).all():
                every = np.arange(len(ids))
                q, j, d = g.exact(every, np.minimum(every, g.indexed))
                full = full[:0]
            yield _rows(PAIR, ids[q], ids[j], d)
            if len(full):
                yield _rows(FULL, ids[full], np.zeros(len(full)), np.zeros(len(full)))

    return run


def _scan(similarity: float, wider: int):
    """All pairs within the radius of an active node and a node of another class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.groups(batches, ["route", "shard", "block"]):
            g, ids, cols = _shard(t, similarity, wider)
            cls = cols["cls"]
            for i in np.flatnonzero(cols["active"]).tolist():
                q, j, d = g.exact(np.array([i]), np.array([g.indexed]))
                ok = cls[j] != cls[i]
                if ok.any():
                    yield _rows(PAIR, ids[q[ok]], ids[j[ok]], d[ok])

    return run


def _jaccard(k: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.groups(batches, ["family", "bi", "bj"]):
            t = t.combine_chunks()
            pair = t.column("b").is_valid()
            docs, links = t.filter(pc.invert(pair)), t.filter(pair)
            if not docs.num_rows or not links.num_rows:
                continue
            sets: dict[int, list[np.ndarray]] = {}
            text, ids = docs.column("text").combine_chunks(), docs.column("a").to_pylist()
            for s, e in T.chunks(text):
                h, count = T.of(text.slice(s, e - s)).shingles(k)
                cut = np.concatenate(([0], np.cumsum(count))).tolist()
                for i, x, y in zip(ids[s:e], cut, cut[1:]):
                    sets.setdefault(i, []).append(np.unique(h[x:y]))  # rows of equal id are one document
            got = []
            for i, j in zip(links.column("a").to_pylist(), links.column("b").to_pylist()):
                for x in sets.get(i, ()):
                    for y in sets.get(j, ()):
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        either = len(x) + len(y) - both
                        # Jaccard as a ratio of integers against the threshold as written
                        if either and both * 1_000_000 >= either * round(similarity * 1_000_000):
                            got.append((i, j))
            if got:
                a, b = zip(*got)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


#: Documents of a block in which pairs are verified; two blocks meet in a task.
FAMILY = 128


def _verified(texts: DataFrame, pairs: DataFrame, k: int, similarity: float) -> DataFrame:
    """The pairs that reach the similarity. Documents that candidates connect are a family; a family
    meets in one task, a larger one in blocks that meet two by two, so that a text goes out once
    for each block it has pairs with, and not once a pair."""
    spark = texts.sparkSession
    pairs, _ = common.written(pairs.select("a", "b"), "simhash-candidates")
    family, _ = common.written(components(pairs), "simhash-families")
    size = family.groupBy("component").agg(F.ceil(F.count("*") / FAMILY).cast("int").alias("blocks"))
    p = pairs.join(family.select(F.col("id").alias("a"), "component"), "a").join(size, "component")
    block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks")).cast("int")
    p = p.select(F.col("component").alias("family"), F.least(block("a"), block("b")).alias("bi"), F.greatest(block("a"), block("b")).alias("bj"), "a", "b")
    p, _ = common.written(p, "simhash-placed")
    place = ["family", "bi", "bj"]
    needs = p.select(*place, "a").union(p.select(*place, F.col("b").alias("a"))).distinct()
    none = F.lit(None)
    docs = needs.join(texts.select(F.col("doc_id").alias("a"), "text").hint("merge"), "a").select(*place, "a", none.cast("long").alias("b"), "text")
    rows = docs.unionByName(p.withColumn("text", none.cast("string")))
    return rows.repartition(common.shuffles(spark), *place).sortWithinPartitions(*place).mapInArrow(_jaccard(k, similarity), "a long, b long")


def classes(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", width: int = 24, limit: int = 128, report: dict | None = None, spread: str = "least", wider: int = 0) -> DataFrame:
    """(doc_id, class_id) for every row: class_id is the smallest id of its class. report, if given,
    gets the audit's recall before its own links were added, the beam's width and the numbers of candidates and links."""
    spark = docs.sparkSession
    common.tune(spark)
    n_parts = common.shuffles(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sample = _sampled(slim, k, similarity)
    signed, signed_at = common.written(slim.mapInArrow(_sign(k, sample), _SIGNED), "simhash-signed")
    nodes = signed.where("n > 0 and doc_id is not null").groupBy("t0", "t1").agg(F.min("doc_id").alias("id"), *(F.any_value(c).alias(c) for c in ("n", "s0", "s1", "least", "sketch")))
    nodes, nodes_at = common.written(nodes, "simhash-nodes")
    total = nodes.count()
    shards = max(1, -(-total // SHARD))
    anchors = nodes.select("id", F.posexplode("least").alias("route", "anchor")).withColumn("shard", F.pmod(F.col("anchor"), F.lit(shards)).cast("int"))
    everywhere = spread == "all"
    if everywhere:
        blocks, blocks_at = common.written(spark.createDataFrame([(0, 0, shards)], "route int, shard int, blocks int"), "simhash-blocks")
    else:
        blocks, blocks_at = common.written(anchors.groupBy("route", "shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "simhash-blocks")
    few = everywhere or shards * MINHASHES <= BROADCAST_ROWS  # a row a shard

    def routed(rows: DataFrame) -> DataFrame:
        """Rows of nodes, once for each place where they are indexed or guests."""
        places = F.slice("least", 1, 1) if everywhere else F.col("least")
        r = rows.withColumn("x", F.explode(F.transform(places, lambda a, i: F.struct(i.alias("route"), a.alias("anchor"))))).drop("least").select("*", "x.route", "x.anchor").drop("x")
        r = r.withColumn("shard", F.lit(0) if everywhere else F.pmod(F.col("anchor"), F.lit(shards)).cast("int")).join(F.broadcast(blocks) if few else blocks, ["route", "shard"])
        # a node is indexed in its own block and a guest in the earlier ones
        r = r.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
        return r.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("own")))).withColumn("guest", (F.col("block") < F.col("own")).cast("int")).drop("own")

    vectors = nodes.select("id", "n", "s0", "s1", "sketch", "least")

    def in_shards(df: DataFrame) -> DataFrame:
        return df.repartition(n_parts, "route", "shard", "block").sortWithinPartitions("route", "shard", "block")

    def pair(df: DataFrame) -> DataFrame:
        return df.where(F.col("kind") == PAIR).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "d").where("a <> b")

    found, found_at = common.written(in_shards(routed(vectors)).mapInArrow(_search(width, max(limit, width), similarity, wider), _FOUND_SQL), "simhash-found")
    pairs, pairs_at = common.written(pair(found).groupBy("a", "b").agg(F.min("d").alias("d")), "simhash-pairs")
    full = found.where(F.col("kind") == FULL).select(F.col("a").alias("id")).distinct()
    # first each node's nearest
    nearest = pairs.groupBy("a").agg(F.min_by("b", F.struct("d", "b")).alias("b"))
    involved = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).union(full.select(F.col("id").alias("doc_id"))).distinct()
    # a bit set, of bounded size, spares the shuffle of texts that no pair needs; the join is exact
    involved, involved_at = common.written(involved, "simhash-involved")
    may = common.with_hit(slim, "doc_id", common.bits(involved, "doc_id"), "hit").where("hit").drop("hit")
    texts, texts_at = common.written(may.join(involved.hint("merge"), "doc_id", "left_semi"), "simhash-texts")
    links, links_at = common.written(_verified(texts, nearest, k, similarity), "simhash-links")
    firsts, firsts_at = common.written(components(links), "simhash-classes")
    cls = lambda c: F.coalesce(F.col(f"c{c}"), F.col(c))

    def across(p: DataFrame) -> DataFrame:
        for c in ("a", "b"):
            p = p.join(firsts.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")), c, "left")
        return p.where(cls("a") != cls("b")).select("a", "b")

    rest = across(pairs.join(nearest.select("a", "b"), ["a", "b"], "left_anti"))
    n_full = full.count()
    if n_full:
        # beams that stayed full: exact, in the shards that hold such nodes, among other classes
        places = ["route", "shard", "block"]
        where = routed(nodes.select("id", "least").join(full, "id", "left_semi")).select(*places).distinct()
        act = routed(vectors).join(where.hint("merge"), places, "left_semi")
        act = act.join(full.withColumn("active", F.lit(True)), "id", "left").join(firsts.withColumnRenamed("component", "cls"), "id", "left")
        act = act.withColumns({"cls": F.coalesce("cls", "id"), "active": F.coalesce("active", F.lit(False))})
        more = across(pair(in_shards(act).mapInArrow(_scan(similarity, wider), _FOUND_SQL)))
        rest, _ = common.written(rest.union(more).distinct(), "simhash-rest")
        missing = rest.select(F.col("a").alias("doc_id")).union(rest.select(F.col("b").alias("doc_id"))).distinct().join(involved, "doc_id", "left_anti")
        missing, _ = common.written(missing, "simhash-missing")
        if missing.take(1):  # again without a shuffle of all texts
            may = common.with_hit(slim, "doc_id", common.bits(missing, "doc_id"), "hit").where("hit").drop("hit")
            more_texts, _ = common.written(may.join(missing.hint("merge"), "doc_id", "left_semi"), "simhash-texts")
            texts = texts.unionByName(more_texts)
    more, more_at = common.written(_verified(texts, rest, k, similarity), "simhash-links")
    final, final_at = common.written(components(links.union(more)), "simhash-classes")
    node_of = nodes.select("t0", "t1", F.col("id").alias("node"))

    def classed(links_of: DataFrame) -> DataFrame:
        out = signed.select("doc_id", "t0", "t1", "n").join(node_of, ["t0", "t1"], "left").withColumn("node", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("node")))
        out = out.join(links_of.select(F.col("id").alias("node"), "component"), "node", "left")
        return common.written(out.select("doc_id", F.coalesce("component", "node", "doc_id").alias("class_id")), "simhash-out")

    out, out_at = classed(final)
    # the audit of the whole: similar pairs that were found by no index, against the classes
    asked = spark.createDataFrame(list(enumerate(sample.ids)), "at int, sampled long")
    own = out.where(F.col("doc_id").isin(sample.ids)).join(asked, F.col("doc_id") == F.col("sampled")).select("at", F.col("class_id").alias("c")).distinct()  # AUDIT rows
    true = signed.where("near is not null and doc_id is not null").select("doc_id", F.explode("near").alias("at")).join(F.broadcast(own), "at").select("doc_id", "c").distinct()
    true, true_at = common.written(true.join(out.distinct(), "doc_id").select("class_id", "c"), "simhash-audit")
    audited, got = true.agg(F.count("*"), F.count(F.expr("case when class_id = c then 1 end"))).first()
    if got < audited:
        added = links.union(more).union(true.where("class_id <> c").select(F.greatest("class_id", "c").alias("a"), F.least("class_id", "c").alias("b")))
        again, again_at = common.written(components(added), "simhash-classes")
        common.discard(out_at)
        out, out_at = classed(again)
        common.discard(again_at)
    if report is not None:
        report |= {"recall": got / audited if audited else 1.0, "audited": audited, "width": width, "nodes": total, "shards": shards, "pairs": pairs.count(), "full": n_full, "links": links.count() + more.count()}
    common.discard(signed_at, nodes_at, blocks_at, involved_at, found_at, pairs_at, texts_at, links_at, firsts_at, more_at, final_at, true_at)
    if got < RECALL * audited and wider < WIDEST:
        common.discard(out_at)
        return classes(docs, k, similarity, id_col, text_col, 2 * width, 2 * limit, report, spread, wider + 6)
    return out


def components(edges: DataFrame) -> DataFrame:
    return common.components(edges)


def deduplicate(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its class, once each; rows without an id stay."""
    found = classes(docs, k, similarity, id_col, text_col)
    gone_id, hit = common.free(docs, "gone"), common.free(docs, "hit")
    gone = found.where("class_id <> doc_id").select(F.col("doc_id").alias(gone_id)).distinct()
    # most rows are certain to stay without a join; texts of the others alone are shuffled
    gone, _ = common.written(gone, "simhash-gone")
    marked = common.with_hit(docs, id_col, common.bits(gone, gone_id), hit)
    sure, unsure = marked.where(~F.col(hit)).drop(hit), marked.where(hit).drop(hit)
    kept = sure.unionByName(unsure.join(gone.hint("merge"), F.col(id_col).cast("long") == F.col(gone_id), "left_anti"))
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").take(1):
        named = kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col])
        kept = named.unionByName(kept.where(F.col(id_col).isNull()))
    return kept
