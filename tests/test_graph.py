import random
from collections import deque

from plumbline.operators import graph as G
from plumbline.operators import traverse as V
from plumbline.schemas import EDGE, compatible


def edges(spark, rows):
    """rows: (src, dst, level) or (src, dst, level, kind)."""
    full = [(i, r[0], r[1], r[3] if len(r) > 3 else "Calls", r[2], None, "p", None) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, EDGE)


def start(spark, n):
    return spark.createDataFrame([(n,)], "node_id long")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def brute_impact(es, node, limit):
    rank = {"High": 2, "Medium": 1}
    out = {}
    for t in (0, 1, 2):
        seen, q = {node: 0}, deque([node])
        while q:
            n = q.popleft()
            if limit is not None and seen[n] >= limit:
                continue
            for a, b, level in es:
                if b == n and rank.get(level, 0) >= t and a not in seen:
                    seen[a] = seen[n] + 1
                    q.append(a)
        for n, h in seen.items():
            out[n] = (t, h)
    out.pop(node)
    return sorted((n, t, h) for n, (t, h) in out.items())


def test_impact_takes_the_best_tier_and_its_depth(spark):
    e = edges(spark, [(2, 1, "Low"), (3, 1, "High"), (2, 3, "High")])
    assert rows(V.impact(e, start(spark, 1)), "node_id", "tier", "hops") == [(2, 2, 2), (3, 2, 1)]


def test_impact_against_brute_force(spark):
    rng = random.Random(5)
    for limit in (None, 2):
        es = [(rng.randrange(8), rng.randrange(8), rng.choice(["High", "Medium", "Low", "Opaque"])) for _ in range(14)]
        assert rows(V.impact(edges(spark, es), start(spark, 0), limit), "node_id", "tier", "hops") == brute_impact(es, 0, limit)


def test_impact_is_reach_on_reversed_edges(spark):
    es = [(1, 2, "High"), (2, 3, "High"), (4, 2, "High"), (3, 3, "High")]
    back = [(b, a, c) for a, b, c in es]
    assert rows(V.reach(edges(spark, es), start(spark, 3), False), "node_id", "hops") == rows(V.reach(edges(spark, back), start(spark, 3), True), "node_id", "hops")


def test_dependencies_and_depth(spark):
    e = edges(spark, [(1, 2, "High"), (2, 3, "High"), (3, 1, "High"), (9, 1, "High")])
    assert rows(V.dependencies(e, start(spark, 1), 1), "edge_id") == [(0,)]
    assert rows(V.dependencies(e, start(spark, 1)), "edge_id") == [(0,), (1,), (2,)]


def test_shortest_path_ties_and_missing(spark):
    e = edges(spark, [(1, 3, "High"), (1, 2, "High"), (2, 4, "High"), (3, 4, "High")])
    assert rows(V.shortest_path(e, 1, 4), "step", "node_id") == [(0, 1), (1, 3), (2, 4)]
    assert V.shortest_path(e, 4, 1).count() == 0


def test_unsafe_paths(spark):
    e = edges(spark, [(1, 2, "High"), (2, 4, "Low"), (1, 4, "High"), (1, 3, "High", "OpaqueDynamic"), (3, 4, "High"), (4, 1, "Low")])
    assert rows(V.unsafe_paths(e, 1, 4), "node_ids") == [([1, 2, 4],), ([1, 3, 4],)]
    assert rows(V.unsafe_paths(e, 1, 4, max_paths=1), "path_ids") == [([0, 1],)]


def test_components_in_a_task_and_by_colours(spark):
    es = [(1, 2, "High"), (2, 1, "High"), (2, 3, "High"), (3, 4, "High"), (4, 5, "High"), (5, 3, "High"), (6, 6, "High"), (7, 1, "High")]
    want = [(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, 6)]
    for limit in (10, 0):
        assert rows(V.strong_components(edges(spark, es), limit), "node_id", "component") == want


def test_recompile_order_and_leftovers(spark):
    es = [(1, 2, "High"), (2, 3, "High"), (4, 5, "High"), (5, 4, "High"), (6, 4, "High"), (7, 3, "High"), (1, 1, "High")]
    nodes = spark.createDataFrame([(n,) for n in range(1, 8)], "node_id long")
    want = [(1, 4), (2, 2), (3, 1), (4, None), (5, None), (6, None), (7, 3)]
    for limit in (10, 0):
        got = V.recompile_order(edges(spark, es), nodes, limit).collect()
        assert sorted((r["node_id"], r["position"]) for r in got) == want


def test_recompile_order_takes_all_nodes(spark):
    from plumbline.plans import carriers as C
    from plumbline.plans import graph_queries as Q

    d = "/root/testdata/sf0.001"
    at = {r["node_id"]: r["position"] for r in Q.recompile_order(spark, d).collect()}
    assert set(at) == {r["node_id"] for r in C.nodes(spark, d).collect()}
    assert sorted(at.values()) == list(range(1, len(at) + 1))
    assert all(at[r["src"]] > at[r["dst"]] for r in C.edges(spark, d).where("src <> dst").collect())


def test_chains(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "t"), ("c", "d"), ("d", "c"), ("r", None)] + [(f"x{i}", f"x{i + 1}") for i in range(12)], "name string, target string")
    got = {r["name"]: (r["target"], r["outcome"]) for r in V.follow(links, links.select("name")).collect()}
    assert got["a"] == ("t", "resolved") and got["c"][1] == "cycle" and got["r"][1] == "remote" and got["x0"][1] == "too_long" and got["x5"] == ("x12", "resolved")


def test_orphans_and_references_cover_all_nodes(spark):
    e = edges(spark, [(1, 2, "High"), (3, 3, "High")])
    n = spark.createDataFrame([(i, f"n{i}", None, "t") for i in range(1, 5)], "node_id long, logical_id string, persistent_id string, identity_kind string")
    assert rows(G.orphans(e, n), "node_id", "tier") == [(1, "LikelyUnused"), (3, "HighConfidenceUnused"), (4, "HighConfidenceUnused")]


def test_violations(spark):
    e = spark.createDataFrame([(1, 1, 2, "Calls", "High", None, None, None), (2, 1, 2, "Calls", "Low", None, "p", None)], EDGE)
    assert rows(G.violations(e), "edge_id", "violation") == [(1, "MissingProvenance"), (2, "MissingEvidence")]


def test_versions():
    assert [compatible(p, "1.2.0") for p in ("1.1.9", "1.3.0", "2.0.0")] == ["Compatible", "ForwardCompatible", "Incompatible"]
