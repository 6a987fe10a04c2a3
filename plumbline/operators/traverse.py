"""Walks over dependency graphs: edges (edge_id, src, dst, kind, conf_level), src depends on dst.

Walks advance level by level: a join of the frontier with the edges, less what was seen. Each level
is written, so plans stay small and a lost executor costs a level. Frontiers and seen sets are
tables, never collected. What needs a whole subgraph at once (components, orders) goes to one task
if it has TASK_EDGES edges at most, by count, and through level-wise loops otherwise."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import ship
from ..frames import cut, ranked
from ..schemas import tier

TASK_EDGES = 2_000_000


def reach(edges: DataFrame, start: DataFrame, forward: bool = True, max_depth: int | None = None) -> DataFrame:
    """(node_id, hops) of all nodes within max_depth edges of the start nodes (node_id), these at 0."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    # repeats of an edge make no new node, so they cost less than telling them apart at each level
    step = edges.select(F.col(a).alias("at"), F.col(b).alias("to")).where("at <> to")
    seen = cut(start.select("node_id").distinct().withColumn("hops", F.lit(0)))
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = step.join(frontier, step["at"] == frontier["node_id"], "left_semi").select(F.col("to").alias("node_id")).distinct()
        frontier = cut(new.join(seen, "node_id", "left_anti").withColumn("hops", F.lit(depth)))
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
    return seen


def dependencies(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Every outgoing edge of every node reached before the depth limit, once."""
    nodes = reach(edges, start, True, max_depth)
    if max_depth is not None:
        nodes = nodes.where(F.col("hops") < max_depth)
    return edges.join(nodes.select(F.col("node_id").alias("src")), "src", "left_semi")


def impact(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node_id, tier, hops) of all that depend on the start nodes, these left out.

    A path is as good as its worst edge, a node as its best path; hops is the depth at which that
    best tier first reaches it. That is a walk per tier over the edges of that tier or better; the
    three advance together, as rows of one frontier."""
    step = edges.withColumn("t", tier()).groupBy("src", "dst").agg(F.max("t").alias("t")).where("src <> dst")
    tiers = F.explode(F.array(*(F.lit(t) for t in (0, 1, 2)))).alias("tier")
    seen = cut(start.select("node_id", tiers).distinct().withColumn("hops", F.lit(0)))
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        on = (step["dst"] == frontier["node_id"]) & (step["t"] >= frontier["tier"])
        new = step.join(frontier, on).select(step["src"].alias("node_id"), "tier").distinct()
        frontier = cut(new.join(seen, ["node_id", "tier"], "left_anti").withColumn("hops", F.lit(depth)))
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
    best = seen.groupBy("node_id").agg(F.max(F.struct("tier", (-F.col("hops")).alias("h"))).alias("b"))
    return best.select("node_id", F.col("b.tier").alias("tier"), (-F.col("b.h")).alias("hops")).join(start.select("node_id"), "node_id", "left_anti")


def impact_edges(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Edges into every node nearer than the depth limit."""
    nodes = reach(edges, start, False, max_depth)
    if max_depth is not None:
        nodes = nodes.where(F.col("hops") < max_depth)
    return edges.join(nodes.select(F.col("node_id").alias("dst")), "dst", "left_semi")


def shortest_path(edges: DataFrame, start: int, goal: int) -> DataFrame:
    """(step, node_id, edge_id) from start to goal, edge_id the edge taken to get there; no rows if
    there is no path. Of equal lengths, the path by queue order, then smaller edge ids, wins: in the queue
    of a level, nodes stand in the order of the edge ids by which they were first reached, so the
    smallest list of edge ids is each node's own, and no level needs a rank of all its nodes."""
    spark = edges.sparkSession
    none = spark.createDataFrame([], "step int, node_id long, edge_id long")
    seen = cut(spark.createDataFrame([(start, [])], "node_id long, path array<long>"))
    frontier, found = seen, start == goal
    while not found:
        out = edges.select("src", "dst", F.col("edge_id").alias("e")).join(frontier, F.col("src") == F.col("node_id"))
        new = out.groupBy("dst").agg(F.min(F.concat("path", F.array("e"))).alias("path")).select(F.col("dst").alias("node_id"), "path")
        frontier = cut(new.join(seen.select("node_id"), "node_id", "left_anti"))
        if not frontier.take(1):
            return none
        found = bool(frontier.where(F.col("node_id") == goal).take(1))
        seen = seen.unionByName(frontier)
    path = frontier.where(F.col("node_id") == goal).select(F.posexplode("path").alias("i", "edge_id"))
    steps = path.join(edges.select("edge_id", "dst"), "edge_id").select((F.col("i") + 1).alias("step"), F.col("dst").alias("node_id"), "edge_id")
    return spark.createDataFrame([(0, start, None)], none.schema).unionByName(steps)


def _first_unsafe(rows: pd.DataFrame, start: int, goal: int, max_depth: int, max_paths: int) -> list[tuple]:
    """The first simple paths from start to goal with a bad edge, depth first by edge ids, of edges (edge_id,
    src, dst, bad). A step is taken only if the goal, and a bad edge if none was yet, can still be had in the steps left."""
    out: dict[int, list] = {}
    back: dict[int, list] = {}
    for e, s, d, bad in sorted(zip(*(rows[c].tolist() for c in ("edge_id", "src", "dst", "bad")))):
        out.setdefault(s, []).append((e, d, bad))
        back.setdefault(d, []).append((s, bad))
    # steps to the goal, without a demand and by a bad edge
    left = {(goal, False): 0}
    todo = deque([(goal, False)])
    while todo:
        node, done = todo.popleft()
        for s, bad in back.get(node, ()):
            for k in {(s, done or bad), (s, done)} if not done else {(s, True)}:
                if k not in left:
                    left[k] = left[node, done] + 1
                    todo.append(k)
    far = max_depth + 1
    found: list[tuple] = []
    path: list[int] = []
    nodes = [start]
    on = {start}
    stack = [(iter(out.get(start, ())), False)]
    while stack and len(found) < max_paths:
        rest, had = stack[-1]
        step = next(rest, None)
        if step is None:
            stack.pop()
            if path:
                path.pop()
                on.discard(nodes.pop())
            continue
        e, d, bad = step
        now = had or bad
        need = min(left.get((d, False), far), left.get((d, True), far)) if now else left.get((d, True), far)
        if d in on or len(path) + 1 + need > max_depth:
            continue
        if d == goal:
            if now:
                found.append(([*path, e], [*nodes, d], len(path) + 1))
            continue
        path.append(e)
        nodes.append(d)
        on.add(d)
        stack.append((iter(out.get(d, ())), now))
    return found


def unsafe_paths(edges: DataFrame, start: int, goal: int, max_depth: int = 8, max_paths: int = 100, task_edges: int = TASK_EDGES) -> DataFrame:
    """(path_ids, node_ids, length) of simple paths that take an edge of dynamic code or unknown
    confidence. Paths end at the goal. If there are more than max_paths, those stay that come first
    in the order of their edge ids (the feature's own limit).

    Edges that lie on no path of that length are left out first. What remains is searched depth first, and
    only until the limit, in one task if it has task_edges at most; else level by level, where a beginning goes that comes
    behind as many whole paths as are wanted."""
    spark = edges.sparkSession
    ship(spark)
    e = cut(edges.select("edge_id", "src", "dst", ((F.col("kind") == "OpaqueDynamic") | (tier() == 0)).alias("bad")))
    node = lambda n: spark.createDataFrame([(n,)], "node_id long")
    ahead = reach(e, node(start), True, max_depth)
    # steps to the goal are counted among what the start reaches: no path leads through anything else
    e = cut(e.join(ahead.select(F.col("node_id").alias("src"), F.col("hops").alias("gone")), "src"))
    near = reach(e, node(goal), False, max_depth)
    e = e.join(near.select(F.col("node_id").alias("dst"), F.col("hops").alias("left")), "dst")
    e = cut(e.where(F.col("gone") + 1 + F.col("left") <= max_depth).select("edge_id", "src", "dst", "bad", "left"))
    columns = "path_ids array<long>, node_ids array<long>, length int"
    if e.count() <= task_edges:

        def one(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            got = list(parts)
            if got:
                yield pd.DataFrame(_first_unsafe(pd.concat(got), start, goal, max_depth, max_paths), columns=["path_ids", "node_ids", "length"])

        return e.drop("left").coalesce(1).mapInPandas(one, columns)
    open_ = spark.createDataFrame([([], [start], start, False)], "path_ids array<long>, node_ids array<long>, at long, bad boolean")
    done = None
    for depth in range(1, max_depth + 1):
        grown = open_.withColumnRenamed("bad", "was").join(e.where(F.col("left") + depth <= max_depth), F.col("at") == F.col("src")).where(~F.array_contains("node_ids", F.col("dst")))
        grown = cut(grown.select(F.concat("path_ids", F.array("edge_id")).alias("path_ids"), F.concat("node_ids", F.array("dst")).alias("node_ids"), F.col("dst").alias("at"), (F.col("was") | F.col("bad")).alias("bad")))
        ended = grown.where((F.col("at") == goal) & F.col("bad"))
        done = cut((ended if done is None else done.unionByName(ended)).orderBy("path_ids").limit(max_paths))
        open_ = grown.where(F.col("at") != goal)
        last = done.agg(F.count("*"), F.max("path_ids")).first()
        if last[0] == max_paths:
            open_ = open_.where(F.col("path_ids") < F.array(*(F.lit(x).cast("long") for x in last[1])))
        if not open_.take(1):
            break
    return done.select("path_ids", "node_ids", F.size("path_ids").alias("length"))


def _strong(rows: pd.DataFrame) -> pd.DataFrame:
    """Strongly connected components of edges (src, dst) by two walks without recursion."""
    out: dict[int, list[int]] = {}
    back: dict[int, list[int]] = {}
    for s, d in zip(rows["src"].tolist(), rows["dst"].tolist()):
        out.setdefault(s, []).append(d)
        back.setdefault(d, []).append(s)
    order, seen = [], set()
    for root in sorted({*out, *back}):
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(out.get(root, ())))]
        while stack:
            node, rest = stack[-1]
            nxt = next((x for x in rest if x not in seen), None)
            if nxt is None:
                order.append(node)
                stack.pop()
            else:
                seen.add(nxt)
                stack.append((nxt, iter(out.get(nxt, ()))))
    found: dict[int, int] = {}
    for root in reversed(order):
        if root in found:
            continue
        members, todo = [], [root]
        found[root] = -1
        while todo:
            node = todo.pop()
            members.append(node)
            for x in back.get(node, ()):
                if x not in found:
                    found[x] = -1
                    todo.append(x)
        low = min(members)
        for x in members:
            found[x] = low
    return pd.DataFrame({"node_id": list(found), "component": list(found.values())}, dtype="int64")


def strong_components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node_id, component): the smallest node of the node's strongly connected component, for nodes on a cycle."""
    ship(edges.sparkSession)
    e = cut(edges.select("src", "dst").distinct())
    loops = e.where("src = dst").select(F.col("src").alias("node_id"), F.col("src").alias("component"))
    e = cut(e.where("src <> dst"))
    n = e.count()
    while True:  # nodes without a way in or out are on no cycle
        e2 = cut(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        m = e2.count()
        e = e2
        if m == n or m == 0:
            break
        n = m
    if m <= task_edges:

        def one(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield _strong(pd.concat([pd.DataFrame({"src": [], "dst": []}, dtype="int64"), *rows]))

        found = e.coalesce(1).mapInPandas(one, "node_id long, component long")
    else:
        found = _by_colours(e)
    size = found.groupBy("component").count().where("count > 1").select("component")
    return found.join(size, "component", "left_semi").select("node_id", "component").unionByName(loops).groupBy("node_id").agg(F.min("component").alias("component"))


def _by_colours(e: DataFrame) -> DataFrame:
    """Components by colouring: every node takes the largest id that reaches it; what reaches back to
    that id within the colour is its component; the rest goes on."""
    done = None
    while e.take(1):
        nodes = e.select(F.col("src").alias("node_id")).union(e.select("dst")).distinct()
        colour = cut(nodes.withColumn("c", F.col("node_id")))
        while True:
            up = e.join(colour, F.col("src") == F.col("node_id")).groupBy(F.col("dst").alias("node_id")).agg(F.max("c").alias("m"))
            new = cut(colour.join(up, "node_id", "left").select("node_id", F.greatest("c", F.coalesce("m", "c")).alias("c")))
            moved = new.join(colour.withColumnRenamed("c", "o"), "node_id").where("c <> o").take(1)
            colour = new
            if not moved:
                break
        inner = cut(e.join(colour.select(F.col("node_id").alias("src"), F.col("c").alias("a")), "src").join(colour.select(F.col("node_id").alias("dst"), F.col("c").alias("b")), "dst").where("a = b").select("src", "dst", F.col("a").alias("c")))
        got = cut(colour.where("node_id = c"))
        frontier = got
        while True:
            frontier = cut(inner.join(frontier.select(F.col("node_id").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("node_id"), "c").distinct().join(got, ["node_id", "c"], "left_anti"))
            if not frontier.take(1):
                break
            got = got.unionByName(frontier)
        got = cut(got)
        low = got.groupBy("c").agg(F.min("node_id").alias("component"))
        part = got.join(low, "c").select("node_id", "component")
        done = part if done is None else done.unionByName(part)
        gone = got.select("node_id")
        e = cut(e.join(gone.withColumnRenamed("node_id", "src"), "src", "left_anti").join(gone.withColumnRenamed("node_id", "dst"), "dst", "left_anti").select("src", "dst"))
    return cut(done)


def cycles(edges: DataFrame) -> DataFrame:
    """(component, node_ids, edge_ids) of every cycle component, node ids in order."""
    c = cut(strong_components(edges))
    inner = edges.join(c.withColumnRenamed("node_id", "src"), "src").join(c.select(F.col("node_id").alias("dst"), F.col("component").alias("other")), "dst").where("component = other")
    by = inner.groupBy("component").agg(F.sort_array(F.collect_set("edge_id")).alias("edge_ids"))
    return c.groupBy("component").agg(F.sort_array(F.collect_set("node_id")).alias("node_ids")).join(by, "component")


def _kahn(rows: pd.DataFrame) -> pd.DataFrame:
    """rows: (src, dst), dst null for the nodes themselves. Position of each node, null for leftovers."""
    nodes = sorted(set(rows["src"].tolist()))
    inside = set(nodes)
    needs = {n: set() for n in nodes}
    users: dict[int, list[int]] = {n: [] for n in nodes}
    e = rows.dropna()
    for s, d in sorted(set(zip(e["src"].astype("int64").tolist(), e["dst"].astype("int64").tolist()))):
        if s != d and d in inside:
            needs[s].add(d)
            users[d].append(s)
    left = {n: len(v) for n, v in needs.items()}
    queue, order = deque(n for n in nodes if not left[n]), []
    while queue:
        n = queue.popleft()
        order.append(n)
        for u in users[n]:
            left[u] -= 1
            if not left[u]:
                queue.append(u)
    place = {n: i + 1 for i, n in enumerate(order)}
    return pd.DataFrame({"node_id": nodes, "position": pd.array([place.get(n) for n in nodes], dtype="Int64")})


def recompile_order(edges: DataFrame, nodes: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node_id, position): each node after all it depends on, among the given nodes; first come, first
    served, equals by node id. Position is null for nodes on a cycle or behind one."""
    ship(edges.sparkSession)
    own = nodes.select(F.col("node_id").alias("src")).distinct()
    inner = edges.select("src", "dst").where("src <> dst").join(own, "src", "left_semi").join(own.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst").distinct()
    inner = cut(inner)
    if inner.count() <= task_edges:

        def one(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = list(rows)
            if parts:
                yield _kahn(pd.concat(parts))

        return own.select("src", F.lit(None).cast("long").alias("dst")).unionByName(inner).coalesce(1).mapInPandas(one, "node_id long, position long")
    placed, n = None, 0
    todo, e = cut(own), inner
    while True:  # a level at a time: ready nodes in the order of their last need
        ready = todo.join(e, "src", "left_anti")
        if placed is not None:
            last = inner.join(placed.select(F.col("node_id").alias("dst"), "position"), "dst").groupBy("src").agg(F.max("position").alias("p"))
            ready = ready.join(last, "src", "left")
        else:
            ready = ready.withColumn("p", F.lit(0))
        ready = cut(ranked(ready.select(F.col("src").alias("node_id"), "p"), "position", "p", "node_id", start=n).select("node_id", "position"))
        m = ready.count()
        if not m:
            break
        n += m
        placed = ready if placed is None else placed.unionByName(ready)
        todo = cut(todo.join(ready.select(F.col("node_id").alias("src")), "src", "left_anti"))
        e = cut(e.join(ready.select(F.col("node_id").alias("dst")), "dst", "left_anti"))
    rest = todo.select(F.col("src").alias("node_id"), F.lit(None).cast("long").alias("position"))
    return rest if placed is None else placed.unionByName(rest)


def follow(links: DataFrame, start: DataFrame, max_hops: int = 8) -> DataFrame:
    """(name, target, hops, outcome) of chains name -> target (null: elsewhere) from the start names:
    'resolved' at a name that isn't a link, 'remote', 'cycle', or 'too_long'."""
    step = links.select(F.col("name").alias("n"), F.col("target").alias("t"))
    at = start.select("name", F.col("name").alias("target"), F.array("name").alias("path"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("outcome"))
    for _ in range(max_hops + 1):
        open_ = at.where("outcome is null").join(step, F.col("target") == F.col("n"), "left")
        moved = open_.select(
            "name",
            F.when(F.col("n").isNull(), F.col("target")).otherwise(F.col("t")).alias("target"),
            F.when(F.col("n").isNull() | F.col("t").isNull(), F.col("path")).otherwise(F.concat("path", F.array("t"))).alias("path"),
            F.when(F.col("n").isNull(), F.col("hops")).otherwise(F.col("hops") + 1).alias("hops"),
            F.when(F.col("n").isNull(), "resolved").when(F.col("t").isNull(), "remote").when(F.array_contains("path", F.col("t")), "cycle").when(F.col("hops") >= max_hops, "too_long").alias("outcome"),
        )
        at = cut(at.where("outcome is not null").unionByName(moved))
        if not at.where("outcome is null").take(1):
            break
    return at.select("name", "target", "hops", F.coalesce("outcome", F.lit("too_long")).alias("outcome"))
