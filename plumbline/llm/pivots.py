"""Near duplicates among vectors by a pivot-permutation index.

Reference points are vectors of the table, chosen by a hash of their ids, some four times the root of
their number (256 to 65,536; a bounded sample, every vector is indexed), so that lists grow with the root of
the table. A vector is described by its PREFIX nearest pivots in their order. Each pivot has an
inverted list of the vectors that have it in their prefix, with their whole prefixes. Within a list, pairs are retrieved
that share SHARED pivots or more, each at places that differ by APART at most; what is retrieved is verified by
the cosine in double precision. Two prefixes that share m of l pivots have one of them among the l - m + 1 rarest of either,
so a vector goes to no other lists. At cosine 0.95, the hardest case, 99.9 % of random pairs of 64
dimensions are retrieved with 1,024 pivots (99.8 % with 4,096); closer ones all are.

That doesn't hold inside a group dense enough to own pivots: its members' prefixes are the group's own
pivots, in an order that is each member's noise. A vector with a cosine of DENSE or more to its nearest
pivot is therefore not in the lists but compared with all vectors that the triangle inequality on
angles leaves: those no further from its pivot than its cell's radius and the angle of a link. That
is exact, and quadratic in a dense group. AUDIT vectors of each cell (of AUDITED cells, if there are more) are compared with all others
besides; where the lists missed a link of one, its cell is searched exactly too, and where that
doesn't settle it, all cells are. Links between vectors that neither are dense nor were audited still
rest on the lists.

Equal vectors are one node with a weight, so groups of copies cost no pair. A pair that meets in
several lists counts in one, that of its rarest common pivot, so links can be summed by node
and no pair leaves its task: what leaves is a count and one link to the list's own class for each
node. A list of more than BLOCK vectors is divided; its blocks meet pair by pair in tasks of their
own. The lists are as many as pivots; that bounds what is broadcast.

Vectors that are null, zero, of another dimension than most, or hold null or non-finite components
link with nothing; so do rows without an id, whose component is null. Rows of equal id count once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vectors
from . import textwords as T

PIVOTS, PREFIX, SHARED, APART, BLOCK = (256, 65_536), 12, 3, 9, 2048
#: Cosine with the nearest pivot from which a vector is searched exactly; audited vectors of a cell, and cells;
#: vectors that a task holds against a pass over all, and those of one cell compared at once.
DENSE, AUDIT, AUDITED, HELD, OWN = 0.6, 4, 1024, 8192, 1024


def unit(x: np.ndarray) -> np.ndarray:
    # divided by the largest component first: squares of tiny or huge numbers would vanish or overflow
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def prefixes(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The numbers of the nearest pivots, nearest first; ties to the smaller number."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :length]


def _bits(top: np.ndarray) -> np.ndarray:
    """Four numbers of 64 bits for each prefix, a bit for each pivot; pivots may fall on one bit."""
    at = T.mix(top.astype(T.U)) % T.U(256)
    out = np.zeros((len(top), 4), T.U)
    for k in range(4):
        out[:, k] = np.bitwise_or.reduce(np.where(at // T.U(64) == k, T.U(1) << (at % T.U(64)), T.U(0)), axis=1)
    return out


def retrieved(p: np.ndarray, q: np.ndarray, order: np.ndarray, key: int, same: bool, shared: int, apart: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of two blocks of a list, by their prefixes p and q: with enough shared pivots at
    places near enough, of which the list's is the rarest. same: of one block, each pair once."""
    near = np.abs(np.arange(p.shape[1])[:, None] - np.arange(p.shape[1])[None]) <= apart
    bp, bq = _bits(p), _bits(q)
    # of shared pivots, so many at most fall on one bit
    lp, lq = (p.shape[1] - np.bitwise_count(b).sum(axis=1).astype(np.int8) for b in (bp, bq))
    for s in range(0, len(p), 256):
        # first by bits, of which equal ones can be too many but never too few
        n = np.minimum(lp[s : s + 256, None], lq[None])
        for k in range(4):
            n += np.bitwise_count(bp[s : s + 256, k, None] & bq[None, :, k]).view(np.int8)
        i, j = np.nonzero(n >= shared)
        ok = np.ones(len(i), bool)
        if same:
            ok &= j > i + s
        i, j = i[ok] + s, j[ok]
        for a in range(0, len(i), 50_000):
            x, y = i[a : a + 50_000], j[a : a + 50_000]
            both = p[x][:, :, None] == q[y][:, None, :]
            rare = np.where(both.any(axis=2), order[p[x]], len(order)).min(axis=1)
            ok = ((both & near).sum(axis=(1, 2)) >= shared) & (rare == order[key])
            yield x[ok], y[ok]


def within(x: np.ndarray, y: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the retrieved pairs that have a cosine of least or more."""
    got = [(np.zeros(0, np.int64),) * 2]
    for i, j in pairs:
        ok = np.einsum("ij,ij->i", x[i], y[j]) >= least
        got.append((i[ok], j[ok]))
    return tuple(np.concatenate(c) for c in zip(*got))


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each of n nodes, the smallest number in its class under the links (i, j)."""
    out = np.arange(n)
    while True:
        least = np.minimum(out[i], out[j])
        new = out.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == out).all():
            return out
        out = new


_LINKED = "id long, links long, root long"


def _lists(kind: str, dim: int, order: np.ndarray, least: float, shared: int, apart: int):
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.groups(batches, ["key", "bi", "bj"]):
            if t.num_rows < 2:
                continue
            t = t.sort_by("id")
            key, bi, bj = (t.column(c)[0].as_py() for c in ("key", "bi", "bj"))
            own = t.column("own").to_numpy()
            ids, w = t.column("id").to_numpy(), t.column("w").to_numpy()
            x = unit(vectors.matrix(t.column("raw").combine_chunks(), kind, dim))
            top = np.frombuffer(b"".join(t.column("top").to_pylist()), np.int32).reshape(len(ids), -1)
            a, b = np.flatnonzero(own == bi), np.flatnonzero(own == bj)
            i, j = within(x[a], x[b], retrieved(top[a], top[b], order, key, bi == bj, shared, apart), least)
            if not len(i):
                continue
            i, j = a[i], b[j]
            links = np.bincount(i, w[j], len(ids)) + np.bincount(j, w[i], len(ids))
            root = roots(len(ids), i, j)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(ids[root[some]])], schema=schema)

    return run


def _passed(uri: str, homes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of some cells (sorted numbers) and others that lie with them; files are in the order of cells."""
    fs, at = common.filesystem(uri)
    for f in sorted(x.path for x in fs.get_file_info(pafs.FileSelector(at)) if x.path.endswith(".parquet")):
        file = pq.ParquetFile(fs.open_input_file(f))
        column = file.schema_arrow.names.index("home")
        groups = []
        for g in range(file.num_row_groups):
            known = file.metadata.row_group(g).column(column).statistics
            if known is None or not known.has_min_max or np.searchsorted(homes, known.min) < np.searchsorted(homes, known.max, "right"):
                groups.append(g)
        if groups:
            yield from file.iter_batches(BLOCK, row_groups=groups, columns=["id", "w", "raw", "home", "near"])


def reached(linked: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row and column of a matrix of links reaches; x and y are their ids."""
    while True:
        y2 = np.minimum(y, np.where(linked, x[:, None], common.TOP_ID).min(axis=0))
        x2 = np.minimum(x, np.where(linked, y2[None], common.TOP_ID).min(axis=1))
        if (x2 == x).all() and (y2 == y).all():
            return x, y
        x, y = x2, y2


def _exactly(uri: str, kind: str, dim: int, points: np.ndarray, radius: np.ndarray, least: float, dense: float, cells: list[int], audit: bool):
    """Links of the given rows with all rows at uri. A link of two dense rows is found at both ends, one
    with a row that isn't dense counts at both here. For an audit, only the given rows' links count."""
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def rows(ids: np.ndarray, links: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links.astype(np.int64)), pa.array(root)], schema=schema)

    def scan(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        ids, w, home, near = (t.column(c).to_numpy() for c in ("id", "w", "home", "near"))
        x = unit(vectors.matrix(t.column("raw").combine_chunks(), kind, dim))
        own = [np.flatnonzero(home == h) for h in np.unique(home)]
        own = [o[a : a + OWN] for o in own for a in range(0, len(o), OWN)]
        far = np.array([np.arccos(np.clip(near[o].min(), -1, 1)) for o in own]) + np.arccos(np.clip(least, -1, 1)) + 1e-6
        bound, centre = np.cos(np.minimum(far, np.pi)) - 1e-9, points[[home[o[0]] for o in own]]
        # cells that some row's reach can touch: angles between pivots less the cells' own radii
        reach = np.zeros(len(points), bool)
        for g in range(len(own)):
            reach |= np.arccos(np.clip(points @ centre[g], -1, 1)) <= far[g] + radius + 1e-6
        for b in _passed(uri, np.flatnonzero(reach)):
            y_ids, y_w = T.column(b, "id").to_numpy(), T.column(b, "w").to_numpy()
            y = unit(vectors.matrix(T.column(b, "raw"), kind, dim))
            sparse = ~((T.column(b, "near").to_numpy() >= dense) | np.isin(T.column(b, "home").to_numpy(), cells))
            may = y @ centre.T >= bound
            for g, o in enumerate(own):
                j = np.flatnonzero(may[:, g])
                if not len(j):
                    continue
                linked = x[o] @ y[j].T >= least
                _, me, it = np.intersect1d(ids[o], y_ids[j], return_indices=True)
                linked[me, it] = False
                i, k = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
                if not len(i):
                    continue
                linked, i, j = linked[np.ix_(i, k)], o[i], j[k]
                links = linked @ y_w[j]
                if audit:
                    yield rows(ids[i], links, ids[i])
                    continue
                x_root, y_root = reached(linked, ids[i], y_ids[j])
                yield rows(ids[i], links, x_root)
                yield rows(y_ids[j], np.where(sparse[j], w[i] @ linked, 0), y_root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
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


def near_duplicates(table: DataFrame, least: float = 0.95, pivots: int | None = None, prefix: int = PREFIX, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector: how many others it is linked with
    directly (cosine of least or more), and the smallest id reachable by links."""
    spark = table.sparkSession
    rows, kind, dim = vectors.prepared(table, id_col, vec_col)
    nodes = rows.where("raw is not null").groupBy("raw").agg(F.min("vec_id").alias("id"), F.count("*").alias("w"))
    nodes, nodes_at = common.written(nodes, "pivot-nodes")
    if pivots is None:
        pivots = int(min(max(4 * nodes.count() ** 0.5, PIVOTS[0]), PIVOTS[1]))
    sample = nodes.orderBy(F.xxhash64("id"), "id").limit(pivots).select("raw").collect()  # as many rows as pivots
    points = unit(vectors.matrix(pa.array([bytes(r["raw"]) for r in sample], pa.binary()), kind, dim)) if sample else np.zeros((0, dim))
    length = min(prefix, len(points))
    shared = min(SHARED, length)
    apart = max(APART, 0)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit(vectors.matrix(T.column(b, "raw"), kind, dim))
            near = prefixes(x, points, length).astype(np.int32)
            home = near[:, 0]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, length), pa.int32()), pa.array(near.ravel(), pa.int32()))
            cosine = np.einsum("ij,ij->i", x, points[home])
            yield pa.RecordBatch.from_arrays([T.column(b, "id"), T.column(b, "w"), T.column(b, "raw"), pa.array([r.tobytes() for r in near], pa.binary()), lists, pa.array(home), pa.array(cosine)], names=["id", "w", "raw", "top", "near_to", "home", "near"])

    def search(index: DataFrame, index_at: str, cells: list[int]) -> tuple[DataFrame, str]:
        """Links of all vectors: exact for dense ones and those of the cells, by lists between the others."""
        dense = (F.col("near") >= DENSE) | F.col("home").isin(cells)
        rest = index.where(~dense)
        # a row a pivot: how often it is near, which orders them from the rarest, and its rank in that order
        often = {r["p"]: r["n"] for r in rest.select(F.explode("near_to").alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()}
        order = np.empty(len(points), np.int32)
        order[np.lexsort((np.arange(len(points)), [often.get(k, 0) for k in range(len(points))]))] = np.arange(len(points))

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                top = np.frombuffer(b"".join(T.column(b, "top").to_pylist()), np.int32).reshape(-1, length)
                keys = np.take_along_axis(top, np.argsort(order[top], axis=1)[:, : length - shared + 1], 1)
                at = np.repeat(np.arange(b.num_rows), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel(), pa.int32()), *(T.column(b, c).take(pa.array(at)) for c in ("id", "w", "raw", "top"))], names=["key", "id", "w", "raw", "top"])

        entries = rest.select("id", "w", "raw", "top").mapInArrow(listed, "key int, id long, w long, raw binary, top binary")
        # a pivot's list holds its vectors at most, so blocks are known without another pass; a row a pivot
        sizes = spark.createDataFrame([(k, -(-n // BLOCK)) for k, n in often.items()], "key int, blocks int")
        lists = entries.join(F.broadcast(sizes), "key")
        lists = lists.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        lists = lists.select("key", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "id", "w", "raw", "top")
        met = lists.repartition(parts, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
        linked = met.mapInArrow(_lists(kind, dim, order, least, shared, apart), _LINKED)
        # a cell's vectors go to several tasks, else the densest cell would be one task's work
        own = index.where(dense).select("id", "w", "raw", "home", "near").repartition(parts, "home", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("home")
        return common.written(linked.unionByName(own.mapInArrow(_exactly(index_at, kind, dim, points, radius, least, DENSE, cells, False), _LINKED)), "pivot-links")

    def missed(index: DataFrame, index_at: str, linked: DataFrame, cells: list[int]) -> list[int]:
        """The cells of audited vectors some of whose links weren't found."""
        rest = index.where((F.col("near") < DENSE) & ~F.col("home").isin(cells))
        if len(points) > AUDITED:
            rest = rest.where(F.pmod(F.xxhash64("home"), F.lit(-(-len(points) // AUDITED))) == 0)
        some = rest.groupBy("home", F.pmod(F.xxhash64("id"), F.lit(AUDIT)).alias("nth")).agg(F.min_by("id", F.xxhash64("id")).alias("id"))  # AUDIT rows of AUDITED cells or so
        asked = rest.join(F.broadcast(some.select("id")), "id").select("id", "w", "raw", "home", "near").repartition(parts, "home").sortWithinPartitions("home")
        true = asked.mapInArrow(_exactly(index_at, kind, dim, points, radius, least, DENSE, cells, True), _LINKED).groupBy("id").agg(F.sum("links").alias("true"))
        found = linked.join(F.broadcast(some.select("id")), "id").groupBy("id").agg(F.sum("links").alias("links"))
        short = true.join(found, "id", "left").where(F.coalesce("links", F.lit(0)) < F.col("true"))
        return [r["home"] for r in some.join(short, "id").select("home").distinct().collect()]

    if length < 2:  # one vector, or none: nothing to link
        linked = spark.createDataFrame([], _LINKED)
    else:
        parts = common.shuffles(spark)
        index, index_at = common.written(nodes.select("id", "w", "raw").mapInArrow(describe, "id long, w long, raw binary, top binary, near_to array<int>, home int, near double").repartitionByRange(parts, "home", "id").sortWithinPartitions("home"), "pivot-index")
        radius = np.zeros(len(points))  # of each cell, the angle of its furthest vector; a row a pivot
        for r in index.groupBy("home").agg(F.min("near").alias("near")).collect():
            radius[r["home"]] = np.arccos(np.clip(r["near"], -1, 1))
        linked, linked_at = search(index, index_at, [])
        cells = missed(index, index_at, linked, [])
        if cells:
            common.discard(linked_at)
            linked, linked_at = search(index, index_at, cells)
            if missed(index, index_at, linked, cells):
                common.discard(linked_at)
                linked, linked_at = search(index, index_at, list(range(len(points))))
        common.discard(index_at)
    counts = linked.groupBy("id").agg(F.sum("links").alias("links"))
    classes = common.components(linked.select(F.col("id").alias("a"), F.col("root").alias("b")))
    by_node = nodes.join(counts, "id", "left").join(classes, "id", "left").select("raw", (F.coalesce("links", F.lit(0).cast("long")) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.join(by_node, "raw", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
