"""Queries of the graph operators over the carrier graph, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import traverse as V
from ..schemas import TIERS, choose
from . import carriers as C
from .carriers import with_ctes

ORDER, REGION, PART = 7 * 8 + 4, 1 * 8, 1 * 8 + 5


def _start(spark, node):
    return spark.createDataFrame([(node,)], "node_id long")


def _text(c: str):
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


def dependencies(s, d):
    return V.dependencies(C.edges(s, d), _start(s, ORDER), 3).select("edge_id", "src", "dst", "kind")


def reverse_reach(s, d):
    return V.reach(C.edges(s, d), _start(s, REGION), False, 3).select("node_id", F.col("hops").cast("long").alias("hops"))


def impact(s, d):
    return V.impact(C.edges(s, d), _start(s, REGION), 3).select("node_id", choose("tier", TIERS).alias("tier"), F.col("hops").cast("long").alias("hops"))


def impact_edges(s, d):
    return V.impact_edges(C.edges(s, d), _start(s, REGION), 2).select("edge_id", "kind")


def shortest_path(s, d):
    return V.shortest_path(C.edges(s, d), ORDER, _region_of_order(s, d)).select(F.col("step").cast("long").alias("step"), "node_id", "edge_id")


def _region_of_order(s, d):
    e = C.edges(s, d)
    node = ORDER
    for _ in range(3):  # customer, nation, region: each has one edge out
        node = e.where(F.col("src") == node).first()["dst"]
    return node


def explain_path(s, d):
    e = C.edges(s, d)
    out = G.explain_path(V.shortest_path(e, PART, REGION), e)
    return out.select(F.col("length").cast("long").alias("length"), "tier", F.array_join("blockers", ",").alias("blockers"))


def unsafe_paths(s, d):
    return V.unsafe_paths(C.edges(s, d), PART, REGION).select(_text("path_ids"), _text("node_ids"), F.col("length").cast("long").alias("length"))


def cycles(s, d):
    return V.cycles(C.ring(s, d)).select("component", _text("node_ids"), _text("edge_ids"))


def strong_components(s, d):
    return V.strong_components(C.ring(s, d))


def recompile_order(s, d):
    return V.recompile_order(C.edges(s, d), C.nodes(s, d).select("node_id"))


def recompile_leftovers(s, d):
    ring = C.ring(s, d)
    nodes = ring.select(F.col("src").alias("node_id")).union(ring.select("dst"))
    return V.recompile_order(ring, nodes).where("position is null").select("node_id")


def synonym_chains(s, d):
    u = C.users(s, d)
    links = u.where("user_id % 10 <> 0").select(F.concat(F.lit("S"), "user_id").alias("name"), F.when(F.col("user_id") % 13 != 0, F.concat(F.lit("S"), F.pmod(F.col("user_id") * 7 + 3, F.lit(150)))).alias("target"))
    out = V.follow(links, links.select("name"), 8)
    return out.select("name", "target", F.col("hops").cast("long").alias("hops"), "outcome")


def neighbours(s, d):
    return G.neighbours(C.edges(s, d), C.nodes(s, d), ORDER)


def reverse_neighbours(s, d):
    return G.neighbours(C.edges(s, d), C.nodes(s, d), 3 * 8 + 1, reverse=True)


def edge_summaries(s, d):
    return G.summaries(C.edges(s, d), C.nodes(s, d))


def callers(s, d):
    return G.callers(C.edges(s, d), C.nodes(s, d), 2 * 8 + 2).select("src", "logical_id", "identity_kind")


def resolve_node(s, d):
    return G.resolve_node(C.nodes(s, d), " o:7 ")


def _columns(s, d):
    kinds = F.when(F.col("kind") == "Calls", "ReadsColumn").when(F.col("kind") == "DependsOn", "WritesUnknownColumnOfTable").when(F.col("conf_level") == "Medium", "ReadsUnknownColumnOfTable").when(F.col("kind") == "Reads", "WritesColumn").otherwise("DerivesColumn")
    return C.edges(s, d).withColumn("kind", kinds)


def column_readers(s, d):
    return G.column_access(_columns(s, d), 2 * 8 + 2, False)


def column_writers(s, d):
    return G.column_access(_columns(s, d), 3 * 8 + 3, True)


def graph_violations(s, d):
    return G.violations(C.edges(s, d))


def orphans(s, d):
    return G.orphans(C.edges(s, d), C.nodes(s, d))


def orphan_doctor(s, d):
    return G.orphan_doctor(G.orphans(C.edges(s, d), C.nodes(s, d)), 45, True)


def graph_doctor(s, d):
    return G.graph_doctor(C.edges(s, d), C.nodes(s, d))


def edge_kinds(s, d):
    return G.histogram(C.edges(s, d), "kind")


def identity_kinds(s, d):
    return G.histogram(C.nodes(s, d), "identity_kind")


def lineage_doctor(s, d):
    r = G.lineage_doctor(C.edges(s, d))
    return r.withColumns({c: F.round(c, 6) for c in ("exact_ratio", "unknown_ratio")})


def unknown_reasons(s, d):
    return G.unknown_reasons(C.edges(s, d))


def explain_edges(s, d):
    return G.explain_edges(C.edges(s, d), C.nodes(s, d))


def explain_nodes(s, d):
    return G.explain_node(C.edges(s, d), C.nodes(s, d)).withColumn("worst", F.col("worst").cast("long"))


def trigger_edges(s, d):
    t = C.table(s, d, "supplier").select(F.lit("APP").alias("owner"), F.col("s_name").alias("name"), F.when(F.col("s_nationkey") % 2 == 0, "CORE").alias("target_owner"), F.concat(F.lit("T"), "s_nationkey").alias("target_name"))
    return G.trigger_edges(t)


def constraint_edges(s, d):
    c = C.table(s, d, "nation").select(F.lit("APP").alias("owner"), F.concat(F.lit("FK"), "n_nationkey").alias("name"), F.lit("APP").alias("table_owner"), F.lit("NATION").alias("table_name"), F.when(F.col("n_nationkey") % 5 == 0, "CORE").alias("ref_owner"), F.when(F.col("n_nationkey") % 3 > 0, F.concat(F.lit("REGION"), "n_regionkey")).alias("ref_table"))
    return G.constraint_edges(c)


def db_link_edges(s, d):
    u = C.table(s, d, "supplier").select(F.col("s_suppkey").alias("src"), F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("no link "), "s_name")).otherwise(F.concat(F.lit(" app.t"), "s_nationkey", F.lit("@link"), F.col("s_suppkey") % 3)).alias("raw"))
    return G.db_link_edges(u)


def call_targets(s, d):
    calls = C.table(s, d, "orders").select(F.col("o_orderkey").alias("caller"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("c:"), "o_custkey")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("C:"), "o_custkey", F.lit(".run"))).otherwise("nowhere.run").alias("callee"))
    return G.ends_of_calls(calls, C.nodes(s, d))


def minted_targets(s, d):
    a = C.table(s, d, "orders").select(F.concat(F.lit("c:"), F.col("o_custkey") * 2).alias("target"))
    return G.with_missing_targets(a, C.nodes(s, d))


def graphml(s, d):
    return G.graphml(C.edges(s, d), C.nodes(s, d))


def dot(s, d):
    return G.dot(C.edges(s, d), C.nodes(s, d))


_W = "WITH "
SQL = {
    "dependencies": with_ctes("edges", f"""WITH w(n, k) AS (SELECT {ORDER}::BIGINT, 0 UNION SELECT e.dst, k + 1 FROM w JOIN edges e ON e.src = w.n WHERE k < 3)
SELECT DISTINCT e.edge_id, e.src, e.dst, e.kind FROM edges e JOIN w ON e.src = w.n WHERE w.k < 3""", True),
    "reverse_reach": with_ctes("edges", f"""WITH w(n, k) AS (SELECT {REGION}::BIGINT, 0 UNION SELECT e.src, k + 1 FROM w JOIN edges e ON e.dst = w.n WHERE k < 3)
SELECT n AS node_id, min(k)::BIGINT AS hops FROM w GROUP BY n""", True),
    "impact": with_ctes("edges", f"""WITH w(t, n, k) AS (SELECT x, {REGION}::BIGINT, 0 FROM (VALUES (0), (1), (2)) v(x) UNION SELECT w.t, e.src, k + 1 FROM w JOIN edges e ON e.dst = w.n AND e.t >= w.t WHERE k < 3),
b AS (SELECT n, t, min(k) AS k FROM w WHERE n <> {REGION} GROUP BY n, t)
SELECT n AS node_id, CASE max(t) WHEN 2 THEN 'Exact' WHEN 1 THEN 'Heuristic' ELSE 'Unknown' END AS tier, arg_max(k, t)::BIGINT AS hops FROM b GROUP BY n""", True),
    "impact_edges": with_ctes("edges", f"""WITH w(n, k) AS (SELECT {REGION}::BIGINT, 0 UNION SELECT e.src, k + 1 FROM w JOIN edges e ON e.dst = w.n WHERE k < 1)
SELECT DISTINCT e.edge_id, e.kind FROM edges e JOIN w ON e.dst = w.n""", True),
    "shortest_path": with_ctes("edges", f"""WITH w(n, e, k) AS (SELECT {ORDER}::BIGINT, NULL::BIGINT, 0 UNION SELECT e.dst, e.edge_id, k + 1 FROM w JOIN edges e ON e.src = w.n WHERE k < 5)
SELECT k::BIGINT AS step, n AS node_id, e AS edge_id FROM w""", True),
    "unsafe_paths": with_ctes("edges", f"""WITH w(p, q, n, bad) AS (SELECT []::BIGINT[], [{PART}]::BIGINT[], {PART}::BIGINT, false
  UNION ALL SELECT list_append(p, e.edge_id), list_append(q, e.dst), e.dst, bad OR e.kind = 'OpaqueDynamic' OR e.t = 0 FROM w JOIN edges e ON e.src = w.n WHERE len(p) < 8 AND w.n <> {REGION} AND NOT list_contains(q, e.dst))
SELECT array_to_string(p, ',') AS path_ids, array_to_string(q, ',') AS node_ids, len(p)::BIGINT AS length FROM (SELECT * FROM w WHERE n = {REGION} AND bad ORDER BY p LIMIT 100)""", True),
    "strong_components": with_ctes("ring", """WITH w(s, n, k) AS (SELECT src, dst, 1 FROM ring UNION ALL SELECT w.s, r.dst, k + 1 FROM w JOIN ring r ON r.src = w.n WHERE k < 150 AND w.n <> w.s),
c AS (SELECT DISTINCT s FROM w WHERE n = s)
SELECT s AS node_id, min(n) AS component FROM w WHERE s IN (SELECT s FROM c) GROUP BY s""", True),
    "cycles": with_ctes("ring", """WITH w(s, n, k) AS (SELECT src, dst, 1 FROM ring UNION ALL SELECT w.s, r.dst, k + 1 FROM w JOIN ring r ON r.src = w.n WHERE k < 150 AND w.n <> w.s),
c AS (SELECT s, min(n) AS component FROM w WHERE s IN (SELECT s FROM w WHERE n = s) GROUP BY s)
SELECT component, string_agg(s, ',' ORDER BY s) AS node_ids, string_agg(s * 1000 + dst, ',' ORDER BY s * 1000 + dst) AS edge_ids FROM c JOIN ring ON ring.src = c.s GROUP BY component""", True),
    "recompile_leftovers": with_ctes("ring", """WITH g AS (SELECT DISTINCT src, dst FROM ring WHERE src <> dst),
w(s, n, k) AS (SELECT src, dst, 1 FROM g UNION SELECT w.s, g.dst, k + 1 FROM w JOIN g ON g.src = w.n WHERE k < 200)
SELECT DISTINCT s AS node_id FROM w WHERE k = 200""", True),
    "synonym_chains": with_ctes("ring", """WITH l AS (SELECT user_id AS n, CASE WHEN user_id % 13 <> 0 THEN (user_id * 7 + 3) % 150 END AS t FROM users WHERE user_id % 10 <> 0),
w(s, cur, path, hops, done) AS (SELECT n, n, [n], 0, NULL::VARCHAR FROM l UNION ALL
  SELECT s, CASE WHEN l.n IS NULL THEN cur ELSE l.t END, CASE WHEN l.n IS NULL OR l.t IS NULL THEN path ELSE list_append(path, l.t) END, CASE WHEN l.n IS NULL THEN hops ELSE hops + 1 END,
    CASE WHEN l.n IS NULL THEN 'resolved' WHEN l.t IS NULL THEN 'remote' WHEN list_contains(path, l.t) THEN 'cycle' WHEN hops >= 8 THEN 'too_long' END
  FROM w LEFT JOIN l ON l.n = w.cur WHERE done IS NULL)
SELECT 'S' || s AS name, 'S' || cur AS target, hops::BIGINT AS hops, done AS outcome FROM w WHERE done IS NOT NULL""", True),
    "neighbours": with_ctes("nodes edges", f"""SELECT e.edge_id, e.src, e.dst, e.kind, e.conf_level, a.logical_id AS src_logical_id, a.identity_kind AS src_kind, b.logical_id AS dst_logical_id, b.identity_kind AS dst_kind FROM edges e LEFT JOIN nodes a ON a.node_id = e.src LEFT JOIN nodes b ON b.node_id = e.dst WHERE e.src = {ORDER}"""),
    "reverse_neighbours": with_ctes("nodes edges", """SELECT e.edge_id, e.src, e.dst, e.kind, e.conf_level, a.logical_id AS src_logical_id, a.identity_kind AS src_kind, b.logical_id AS dst_logical_id, b.identity_kind AS dst_kind FROM edges e LEFT JOIN nodes a ON a.node_id = e.src LEFT JOIN nodes b ON b.node_id = e.dst WHERE e.dst = 25"""),
    "edge_summaries": with_ctes("nodes edges", """SELECT e.edge_id, e.src, e.dst, e.kind, e.conf_level, a.logical_id AS src_logical_id, a.identity_kind AS src_kind, b.logical_id AS dst_logical_id, b.identity_kind AS dst_kind FROM edges e LEFT JOIN nodes a ON a.node_id = e.src LEFT JOIN nodes b ON b.node_id = e.dst"""),
    "callers": with_ctes("nodes edges", "SELECT DISTINCT e.src, n.logical_id, n.identity_kind FROM edges e JOIN nodes n ON n.node_id = e.src WHERE e.dst = 18 AND e.kind = 'Calls'"),
    "resolve_node": with_ctes("nodes", "SELECT min(node_id) AS node_id FROM nodes WHERE upper(trim(logical_id)) = 'O:7' HAVING min(node_id) IS NOT NULL"),
    "column_readers": with_ctes("edges", "SELECT DISTINCT src, CASE WHEN kind = 'Calls' THEN 'ReadsColumn' ELSE 'ReadsUnknownColumnOfTable' END AS kind, kind <> 'Calls' AS is_unknown FROM edges WHERE dst = 18 AND (kind = 'Calls' OR (conf_level = 'Medium' AND kind <> 'DependsOn'))"),
    "column_writers": with_ctes("edges", "SELECT DISTINCT src, CASE WHEN kind = 'DependsOn' THEN 'WritesUnknownColumnOfTable' WHEN kind = 'Reads' THEN 'WritesColumn' ELSE 'DerivesColumn' END AS kind, kind = 'DependsOn' AS is_unknown FROM edges WHERE dst = 27 AND kind <> 'Calls' AND (kind = 'DependsOn' OR conf_level <> 'Medium')"),
    "graph_violations": with_ctes("edges", "SELECT edge_id, 'MissingProvenance' AS violation FROM edges WHERE prov IS NULL UNION ALL SELECT edge_id, 'MissingEvidence' FROM edges WHERE conf_level <> 'High' AND evidence IS NULL"),
    "orphans": with_ctes("nodes edges", "SELECT node_id, logical_id, CASE WHEN node_id IN (SELECT src FROM edges WHERE src <> dst) THEN 'LikelyUnused' ELSE 'HighConfidenceUnused' END AS tier FROM nodes WHERE node_id NOT IN (SELECT dst FROM edges WHERE src <> dst)"),
    "orphan_doctor": with_ctes("nodes edges", """WITH o AS (SELECT node_id IN (SELECT src FROM edges WHERE src <> dst) AS likely FROM nodes WHERE node_id NOT IN (SELECT dst FROM edges WHERE src <> dst))
SELECT count(*) FILTER (WHERE NOT likely) AS high_confidence, count(*) FILTER (WHERE likely) AS likely, 0::BIGINT AS inconclusive, true AS window_sufficient, true AS safe_to_drop FROM o"""),
    "graph_doctor": with_ctes("nodes edges", """SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM nodes WHERE persistent_id IS NULL) AS null_persistent_ids, count(*) AS edges, count(*) FILTER (WHERE conf_level IN ('Low', 'Opaque')) AS low_confidence_edges,
count(*) FILTER (WHERE kind = 'OpaqueDynamic' OR conf_level = 'Opaque') AS opaque_edges, count(*) FILTER (WHERE prov IS NULL) AS missing_provenance, count(*) FILTER (WHERE conf_level <> 'High' AND evidence IS NULL) AS missing_evidence FROM edges"""),
    "edge_kinds": with_ctes("edges", "SELECT kind, count(*) AS n FROM edges GROUP BY kind"),
    "identity_kinds": with_ctes("nodes", "SELECT identity_kind, count(*) AS n FROM nodes GROUP BY identity_kind"),
    "lineage_doctor": with_ctes("edges", """SELECT count(*) AS total, count(*) FILTER (WHERE t = 2) AS exact, count(*) FILTER (WHERE t = 1) AS heuristic, count(*) FILTER (WHERE t = 0) AS unknown,
round(count(*) FILTER (WHERE t = 2) / count(*)::DOUBLE, 6) AS exact_ratio, round(count(*) FILTER (WHERE t = 0) / count(*)::DOUBLE, 6) AS unknown_ratio FROM edges"""),
    "unknown_reasons": with_ctes("edges", "SELECT coalesce(evidence, 'Opaque') AS reason, count(*) AS n FROM edges WHERE t = 0 GROUP BY 1"),
    "explain_edges": with_ctes("nodes edges", """SELECT e.edge_id, a.logical_id AS src_logical_id, b.logical_id AS dst_logical_id, e.kind, CASE t WHEN 2 THEN 'Exact' WHEN 1 THEN 'Heuristic' ELSE 'Unknown' END AS tier, coalesce(evidence, prov, 'no provenance recorded') AS because
FROM edges e LEFT JOIN nodes a ON a.node_id = e.src LEFT JOIN nodes b ON b.node_id = e.dst"""),
    "explain_nodes": with_ctes("nodes edges", """WITH b AS (SELECT src AS n, 1 AS o, 0 AS i, t FROM edges UNION ALL SELECT dst, 0, 1, t FROM edges)
SELECT node_id, logical_id, coalesce(sum(o), 0)::BIGINT AS n_out, coalesce(sum(i), 0)::BIGINT AS n_in, min(t)::BIGINT AS worst FROM nodes LEFT JOIN b ON b.n = node_id GROUP BY node_id, logical_id"""),
    "trigger_edges": "SELECT 'APP.' || s_name AS src, CASE WHEN s_nationkey % 2 = 0 THEN 'CORE' ELSE 'APP' END || '.T' || s_nationkey AS dst, 'TriggersOn' AS kind, 'High' AS conf_level FROM supplier",
    "constraint_edges": """SELECT DISTINCT 'APP.FK' || n_nationkey AS src, d AS dst, 'Constrains' AS kind, 'High' AS conf_level FROM (SELECT n_nationkey, 'APP.NATION' AS d FROM nation
UNION ALL SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'CORE' ELSE 'APP' END || '.REGION' || n_regionkey FROM nation WHERE n_nationkey % 3 > 0)""",
    "db_link_edges": """SELECT s_suppkey AS src, 'APP.T' || s_nationkey || '@LINK' || s_suppkey % 3 AS dst, 'DependsOn' AS kind, 'Opaque' AS conf_level, 'db link LINK' || s_suppkey % 3 AS evidence, 'APP.T' || s_nationkey AS object, 'LINK' || s_suppkey % 3 AS db_link FROM supplier WHERE s_suppkey % 4 <> 0""",
    "call_targets": with_ctes("nodes", """SELECT o_orderkey AS caller, CASE WHEN o_orderkey % 3 = 0 THEN 'c:' || o_custkey ELSE 'C:' || o_custkey || '.run' END AS callee, node_id AS dst, CASE WHEN o_orderkey % 3 = 0 THEN 'exact' ELSE 'package' END AS strategy
FROM orders JOIN nodes ON logical_id = 'C:' || o_custkey WHERE o_orderkey % 3 < 2"""),
    "minted_targets": "SELECT DISTINCT 'C:' || o_custkey * 2 AS logical_id, 'Unknown' AS identity_kind FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer)",
    "graphml": with_ctes("nodes edges", """SELECT 1 AS part, node_id AS id, '<node id="n' || node_id || '"><data key="label">' || logical_id || '</data></node>' AS line FROM nodes
UNION ALL SELECT 2, edge_id, '<edge id="e' || edge_id || '" source="n' || src || '" target="n' || dst || '"><data key="kind">' || kind || '</data></edge>' FROM edges"""),
    "dot": with_ctes("nodes edges", """SELECT 1 AS part, node_id AS id, '  n' || node_id || ' [label="' || logical_id || '"];' AS line FROM nodes UNION ALL SELECT 2, edge_id, '  n' || src || ' -> n' || dst || ' [label="' || kind || '"];' FROM edges"""),
}
QUERIES = [dependencies, reverse_reach, impact, impact_edges, shortest_path, explain_path, unsafe_paths, cycles, strong_components, recompile_order, recompile_leftovers, synonym_chains, neighbours, reverse_neighbours, edge_summaries, callers, resolve_node, column_readers, column_writers, graph_violations, orphans, orphan_doctor, graph_doctor, edge_kinds, identity_kinds, lineage_doctor, unknown_reasons, explain_edges, explain_nodes, trigger_edges, constraint_edges, db_link_edges, call_targets, minted_targets, graphml, dot]
