"""Queries of the outputs, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import graph as G
from ..operators import render as R
from ..operators import traverse as V
from ..schemas import TIERS, choose
from ..sources import reader
from . import carriers as C
from .carriers import with_ctes
from .graph_queries import REGION, _start
from .tables import table
from .text_units import units


def robot_envelopes(s, d):
    p = table(s, d, "supplier")
    return p.select("s_suppkey", R.envelope("supplier.v1", "1.2.0", F.struct("s_suppkey", "s_name")).alias("json"))


def redacted_customers(s, d):
    c = table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("c_name"), "c_acctbal", "c_mktsegment")
    return R.redact(c, ("c_acctbal",), ("c_name",))


def redacted_attributes(s, d):
    e = table(s, d, "events").select("event_id", F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type")).alias("m"))
    return e.select("event_id", R.redact_attributes("m", ("user",)).alias("m")).select("event_id", F.col("m")["user"].alias("user"), F.col("m")["type"].alias("type"))


def impact_page(s, d):
    got = V.impact(C.edges(s, d), _start(s, REGION), 3).join(C.nodes(s, d), "node_id")
    return R.impact_html(got.select("logical_id", choose("tier", TIERS).alias("tier"), "hops"), "R:1")


def orphans_page(s, d):
    return R.orphans_markdown(G.orphans(C.edges(s, d), C.nodes(s, d)))


def orphans_html(s, d):
    return R.orphans_html(G.orphans(C.edges(s, d), C.nodes(s, d)))


def impact_graphml(s, d):
    got = V.impact(C.edges(s, d), _start(s, REGION), 2).join(C.nodes(s, d), "node_id")
    return R.impact_graphml(got.select("node_id", "logical_id", choose("tier", TIERS).alias("tier"), "hops"), C.edges(s, d))


def bindings(s, d):
    li = table(s, d, "lineitem")
    mode = F.element_at(F.array(F.lit("IN"), F.lit("OUT"), F.lit("IN OUT")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    kind = F.element_at(F.array(F.lit("NUMBER(9)"), F.lit("VARCHAR2(30)"), F.lit("DATE"), F.lit("XMLTYPE")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    args = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", mode.alias("mode"), kind.alias("type")))), lambda x: F.struct(F.concat(F.lit("P"), x["l_linenumber"]).alias("name"), x["mode"].alias("mode"), x["type"].alias("type"))).alias("args"))
    r = args.select(F.concat(F.lit("PKG"), F.col("l_orderkey") % 9).alias("package"), F.concat(F.lit("R"), "l_orderkey").alias("routine"), F.when(F.col("l_orderkey") % 4 == 0, F.col("l_orderkey") % 3).alias("overload"), "args", F.when(F.col("l_orderkey") % 2 == 0, "CLOB").alias("return_type"))
    return R.bindings(r)


def unit_docs(s, d):
    u = units(s, d)
    return R.package_docs(reader.declared(u), N.doc_tags(u))


def nation_graph(s, d):
    return R.call_graph_svg(G.summaries(C.edges(s, d), C.nodes(s, d)).where("src_kind <> 'orders' and src_kind <> 'part'"))


_ORPHANS = "o AS (SELECT logical_id, CASE WHEN node_id IN (SELECT src FROM edges) THEN 'LikelyUnused' ELSE 'HighConfidenceUnused' END AS tier FROM nodes WHERE node_id NOT IN (SELECT dst FROM edges))"
_IMPACT = f"""w(t, n, k) AS (SELECT x, {REGION}::BIGINT, 0 FROM (VALUES (0), (1), (2)) v(x) UNION SELECT w.t, e.src, k + 1 FROM w JOIN edges e ON e.dst = w.n AND e.t >= w.t WHERE k < DEPTH),
b AS (SELECT n, t, min(k) AS k FROM w WHERE n <> {REGION} GROUP BY n, t),
m AS (SELECT n AS node_id, CASE max(t) WHEN 2 THEN 'Exact' WHEN 1 THEN 'Heuristic' ELSE 'Unknown' END AS tier, arg_max(k, t)::BIGINT AS hops FROM b GROUP BY n), i AS (SELECT * FROM m JOIN nodes USING (node_id))"""

SQL = {
    "robot_envelopes": """SELECT s_suppkey, '{"format":"robot-json","schema_id":"supplier.v1","schema_version":"1.2.0","payload":{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}}' AS json FROM supplier""",
    "redacted_customers": "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN '[REDACTED]' END AS c_name, c_mktsegment FROM customer",
    "redacted_attributes": """SELECT event_id, '[REDACTED]' AS "user", event_type AS type FROM events""",
    "orphans_page": with_ctes("nodes edges", f"""WITH {_ORPHANS}
SELECT 0 AS part, '' AS ordinal, '| object | tier |' || chr(10) || '|-|-|' AS line UNION ALL SELECT 1, tier || '|' || logical_id, '| ' || logical_id || ' | ' || tier || ' |' FROM o"""),
    "orphans_html": with_ctes("nodes edges", f"""WITH {_ORPHANS}
SELECT 0 AS part, '' AS ordinal, '<html><body><h1>Orphans</h1><table>' AS line UNION ALL SELECT 2, '', '</table></body></html>' UNION ALL SELECT 1, tier || '|' || logical_id, '<tr><td>' || logical_id || '</td><td>' || tier || '</td></tr>' FROM o"""),
    "impact_page": with_ctes("nodes edges", f"""WITH {_IMPACT.replace('DEPTH', '3')}
SELECT 0 AS part, '' AS ordinal, '<html><body><h1>R:1</h1><table>' AS line UNION ALL SELECT 2, '', '</table></body></html>'
UNION ALL SELECT 1, (CASE tier WHEN 'Exact' THEN '0' WHEN 'Heuristic' THEN '1' ELSE '2' END) || '|' || lpad(hops::VARCHAR, 10, '0') || '|' || logical_id, '<tr><td>' || logical_id || '</td><td>' || tier || '</td><td>' || hops || '</td></tr>' FROM i""", True),
    "impact_graphml": with_ctes("nodes edges", f"""WITH {_IMPACT.replace('DEPTH', '2')}
SELECT 0 AS part, '' AS ordinal, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">' AS line UNION ALL SELECT 2, '', '</graph></graphml>'
UNION ALL SELECT 1, 'n' || lpad(node_id::VARCHAR, 20, '0'), '<node id="n' || node_id || '"><data key="name">' || logical_id || '</data><data key="tier">' || tier || '</data><data key="hops">' || hops || '</data></node>' FROM i
UNION ALL SELECT 1, 'o' || lpad(edge_id::VARCHAR, 20, '0'), '<edge source="n' || src || '" target="n' || dst || '"><data key="kind">' || kind || '</data></edge>' FROM edges WHERE src IN (SELECT node_id FROM i) AND dst IN (SELECT node_id FROM i)""", True),
    "nation_graph": with_ctes("nodes edges", """WITH e AS (SELECT DISTINCT a.logical_id AS s, b.logical_id AS t FROM edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE a.identity_kind NOT IN ('orders', 'part')),
a AS (SELECT s AS n, row_number() OVER (ORDER BY s) * 20 AS y FROM (SELECT DISTINCT s FROM e)), b AS (SELECT t AS n, row_number() OVER (ORDER BY t) * 20 AS y FROM (SELECT DISTINCT t FROM e))
SELECT 0 AS part, '' AS ordinal, '<svg xmlns="http://www.w3.org/2000/svg" width="800">' AS line UNION ALL SELECT 2, '', '</svg>' UNION ALL SELECT 1, '1|' || n, '<text x="10" y="' || y || '">' || n || '</text>' FROM a
UNION ALL SELECT 1, '2|' || n, '<text x="400" y="' || y || '">' || n || '</text>' FROM b
UNION ALL SELECT 1, '3|' || s || '>' || t, '<line x1="200" y1="' || a.y || '" x2="390" y2="' || b.y || '" stroke="black"/>' FROM e JOIN a ON a.n = s JOIN b ON b.n = t"""),
    "bindings": """WITH l AS (SELECT l_orderkey AS k, list(l_linenumber ORDER BY l_linenumber) AS n FROM lineitem GROUP BY 1),
x AS (SELECT k, list_transform(list_filter(n, lambda i: i % 3 <> 1), lambda i: 'p' || i || ': ' || ['Decimal', 'str', 'datetime', 'object'][(i % 4 + 1)::INTEGER] || ' | None') AS ins,
list_concat(CASE WHEN k % 2 = 0 THEN ['str'] ELSE []::VARCHAR[] END, list_transform(list_filter(n, lambda i: i % 3 <> 0), lambda i: ['Decimal', 'str', 'datetime', 'object'][(i % 4 + 1)::INTEGER])) AS outs FROM l)
SELECT 'PKG' || k % 9 AS package, 'R' || k AS routine, CASE WHEN k % 4 = 0 THEN k % 3 END AS overload, 'def r' || k || CASE WHEN k % 4 = 0 THEN '_' || k % 3 ELSE '' END || '(' || array_to_string(list_concat(['connection'], ins), ', ') || ') -> ' ||
CASE len(outs) WHEN 0 THEN 'None' WHEN 1 THEN outs[1] ELSE 'tuple[' || array_to_string(outs, ', ') || ']' END || ': ...' AS line FROM x""",
}
QUERIES = [robot_envelopes, redacted_customers, redacted_attributes, impact_page, orphans_page, orphans_html, impact_graphml, bindings, unit_docs, nation_graph]
