"""Queries from texts of SQL to column lineage, facts, and impact over these facts; and the gates of repairs.

The statements are written out of order lines, so that what must be found in them can be said of the
lines themselves: each line of an order is a table with an alias, some with a schema; the order's key
decides on the verb, and on commas, joins or subqueries between the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frames import shared
from ..operators import factgraph as X
from ..operators import gaps as Y
from ..operators import joins as J
from ..operators import rules as R
from ..operators import traverse as V
from ..sources import sqlmodel as Q
from . import carriers as C
from .carriers import with_ctes
from .tables import table


def statements(spark: SparkSession, d: str) -> DataFrame:
    """(stmt_id, text): a statement an order."""
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", nth.alias("nth"))
    n = F.col("nth").cast("string")
    schema = F.when(F.col("nth") % 2 == 0, F.concat(F.lit("s"), F.col("l_suppkey") % 3, F.lit("."))).otherwise("")
    ref = F.concat(schema, F.when(F.col("nth") % 3 == 0, "Tab").otherwise("tab"), F.col("l_partkey") % 97, F.when(F.col("nth") % 4 == 0, " as").otherwise(""), F.lit(" x"), n)
    part = F.struct("nth", ref.alias("ref"), F.concat(F.lit("x"), n, F.lit(".c"), F.col("l_quantity").cast("int")).alias("col"), F.concat(F.lit("x"), n, F.lit(".k = x1.k")).alias("on"))
    o = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(part)).alias("p"))
    k = F.col("l_orderkey")
    refs, cols, ons = (F.col(f"p.{f}") for f in ("ref", "col", "on"))
    rest = F.slice(F.zip_with(refs, ons, lambda r, c: F.concat(F.lit(" join "), r, F.lit(" on "), c)), F.lit(2), F.size("p"))
    commas = F.concat(F.array_join(refs, ", "), F.lit(" where "), F.array_join(ons, " and "))
    source = F.when(k % 2 == 0, commas).otherwise(F.concat(F.element_at(refs, 1), F.array_join(rest, ""), F.lit(" where x1.k = x1.k")))
    target = F.concat(F.lit("app.t"), k % 7)
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("select /* from no.where */ "), F.array_join(cols, ", "), F.lit(", 'from x' lit from "), source))
        .when(k % 5 == 1, F.concat(F.lit("INSERT INTO "), target, F.lit(" (a, b) SELECT "), F.array_join(cols, ", "), F.lit(" FROM "), source))
        .when(k % 5 == 2, F.concat(F.lit("update "), target, F.lit(" g set g.v = 1, g.w = g.v where exists (select 1 from "), source, F.lit(")")))
        .when(k % 5 == 3, F.concat(F.lit("delete from "), target, F.lit(" g where g.id in (select x1.k from "), source, F.lit(")")))
        .otherwise(F.concat(F.lit("merge into "), target, F.lit(" g using (select * from "), source, F.lit(") q on (g.id = q.id) when matched then update set g.v = q.v when not matched then insert (id, v) values (q.id, q.v)")))
    )
    return o.select(k.alias("stmt_id"), text.alias("text"))


_LINES = """li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS nth FROM lineitem),
l AS (SELECT l_orderkey AS k, nth AS n, CASE WHEN nth % 2 = 0 THEN 'S' || l_suppkey % 3 ELSE '' END AS s, 'TAB' || l_partkey % 97 AS t, 'C' || l_quantity::INTEGER AS c FROM li),
o AS (SELECT DISTINCT k FROM l),
tb AS (SELECT k, s, t, 'Read' AS u FROM l UNION SELECT k, 'APP', 'T' || k % 7, CASE WHEN k % 5 = 4 THEN 'ReadWrite' ELSE 'Write' END FROM o WHERE k % 5 > 0)"""
_COLUMNS = f"""{_LINES},
al AS (SELECT k, 'X' || n AS a, s, t FROM l UNION ALL SELECT k, 'G', 'APP', 'T' || k % 7 FROM o WHERE k % 5 IN (2, 3, 4)),
cu AS (
  SELECT k, 'Read' AS w, 'X' || n AS q, c, 'Resolved' AS r FROM l WHERE k % 5 IN (0, 1)
  UNION SELECT k, 'Read', 'X' || n, 'K', 'Resolved' FROM l WHERE n > 1 OR k % 2 = 0 OR n = 1
  UNION SELECT k, 'Write', '', x, 'Unresolved' FROM o, (VALUES ('A'), ('B')) v(x) WHERE k % 5 = 1
  UNION SELECT k, w, 'G', x, 'Resolved' FROM o, (VALUES ('Write', 'V'), ('Write', 'W'), ('Read', 'V')) v(w, x) WHERE k % 5 = 2
  UNION SELECT k, 'Read', 'G', 'ID', 'Resolved' FROM o WHERE k % 5 IN (3, 4)
  UNION SELECT k, 'Read', '', '*', 'StarExpansion' FROM o WHERE k % 5 = 4
  UNION SELECT k, 'Read', 'Q', x, 'Unresolved' FROM o, (VALUES ('ID'), ('V')) v(x) WHERE k % 5 = 4
  UNION SELECT k, 'Write', 'G', 'V', 'Resolved' FROM o WHERE k % 5 = 4
  UNION SELECT k, 'Write', '', x, 'Unresolved' FROM o, (VALUES ('ID'), ('V')) v(x) WHERE k % 5 = 4),
ce AS (SELECT DISTINCT cu.k, CASE WHEN al.t IS NULL THEN '?' WHEN al.s = '' THEN al.t ELSE al.s || '.' || al.t END AS t, c,
  CASE WHEN r = 'StarExpansion' THEN 'DerivesColumn' WHEN r = 'Resolved' THEN w || 'sColumn' ELSE w || 'sUnknownColumnOfTable' END AS kind FROM cu LEFT JOIN al ON al.k = cu.k AND al.a = cu.q),
uf AS (SELECT k, CASE WHEN s = '' THEN t ELSE s || '.' || t END AS target, CASE u WHEN 'ReadWrite' THEN 'ReadsWrites' ELSE u || 's' END AS e FROM tb
  UNION SELECT k, t || '.' || c, CASE kind WHEN 'DerivesColumn' THEN 'ReadsColumn:expression' WHEN 'ReadsColumn' THEN 'ReadsColumn:exact' WHEN 'WritesColumn' THEN 'WritesColumn:exact' WHEN 'ReadsUnknownColumnOfTable' THEN 'ReadsColumn:unknown' ELSE 'WritesColumn:unknown' END FROM ce)"""


def sql_tables(s, d):
    return Q.tables_of(statements(s, d)).select("stmt_id", "schema", "table", "usage")


def sql_scopes(s, d):
    return Q.scopes_of(statements(s, d))


def sql_columns(s, d):
    return Q.columns_of(statements(s, d)).select("stmt_id", "access", F.upper("qualifier").alias("qualifier"), "column", "resolution")


def sql_projections(s, d):
    return Q.projections_of(statements(s, d).where("stmt_id % 5 = 0"))


def sql_column_edges(s, d):
    return Q.edges_of(statements(s, d))


def sql_use_facts(s, d):
    return Q.facts_of(statements(s, d))


def _facts(s, d):
    """Facts minted from the statements' texts, each order's by its customer; some customers' routines call others'."""
    owner = table(s, d, "orders").select(F.col("o_orderkey").alias("stmt_id"), F.concat(F.lit("app.c"), "o_custkey").alias("owner"))
    texts = statements(s, d).join(owner, "stmt_id").select("owner", "text")  # where the statements lie, before they are read
    uses = Q.table_facts_of(texts, "owner")
    calls = table(s, d, "customer").where("c_custkey > 0").select(F.concat(F.lit("App.C"), F.col("c_custkey") - 1).alias("owner"), F.concat(F.lit(" app.c"), "c_custkey").alias("target"), F.lit("Calls").alias("edge_kind")).where("cast(substring(owner, 6) as int) % 10 < 3")
    return X.use_facts(uses.unionByName(calls))


_FACTS = f"""{_COLUMNS},
fe AS (SELECT DISTINCT 'APP.C' || o_custkey AS src, target AS dst, e AS kind FROM uf JOIN orders ON o_orderkey = k WHERE e IN ('Reads', 'Writes', 'ReadsWrites')
  UNION SELECT 'APP.C' || (c_custkey - 1), 'APP.C' || c_custkey, 'Calls' FROM customer WHERE c_custkey > 0 AND (c_custkey - 1) % 10 < 3)"""


def dependency_facts(s, d):
    return X.edges(_facts(s, d))


def dependencies_from_facts(s, d):
    return X.dependencies_from_facts(_facts(s, d), ["app.c10 ", "APP.C21"], 3)


def impact_from_facts(s, d):
    return X.impact_from_facts(_facts(s, d), ["tab5", "S1.TAB7"])


def fact_graph(s, d):
    """A graph of facts, saved and loaded again: edges by the kinds of their ends."""
    at = f"{shared(s).rstrip('/')}/plumbline/fact-graph-{s.sparkContext.applicationId}-{abs(hash(d))}"
    X.save(*X.graph(_facts(s, d)), at)
    nodes, edges = X.load(s, at)
    n = nodes.select("node_id", F.substring_index("logical_id", ".", 1).alias("owner"))
    e = edges.join(n.toDF("src", "src_owner"), "src").join(n.toDF("dst", "dst_owner"), "dst")
    return e.groupBy("src_owner", F.when(F.col("dst_owner").startswith("TAB"), "TAB").otherwise(F.col("dst_owner")).alias("dst_owner"), "kind").agg(F.count("*").alias("n"))


def induced_edges(s, d):
    return X.induced(C.edges(s, d), C.nodes(s, d).where("identity_kind in ('nation', 'customer', 'supplier')")).select("edge_id", "src", "dst", "kind")


def dynamic_evidence(s, d):
    k = F.col("o_orderkey")
    hole = lambda i: F.when(k % 3 == 0, F.concat(F.lit("dbms_assert.simple_sql_name(v"), i, F.lit(")"))).otherwise(F.concat(F.lit("upper(v"), i, F.lit(")")))
    holes = F.array_join(F.transform(F.sequence(F.lit(1), (k % 4).cast("int")), lambda i: F.when(i <= k % 4, F.concat(F.lit(" || "), hole(i), F.lit(" || ' and ''q'' = '")))), "", "")
    using = F.when(k % 5 == 0, " using p1, p2").otherwise("")
    text = F.concat(F.lit("begin execute immediate 'select a from app.t"), k % 9, F.lit(" where 1 = '"), F.when(k % 4 > 0, holes).otherwise(""), using, F.lit("; open c for "), F.when(k % 2 == 0, "v_sql").otherwise("select 1 from dual"), F.lit("; end;"))
    return Q.dynamics_of(table(s, d, "orders").select(k.alias("unit"), text.alias("text")))


def set_operations(s, d):
    k = F.col("o_orderkey")
    ops = F.array(*(F.lit(x) for x in ("union all", "minus", "intersect", "except")))
    text = F.concat(F.lit("select a from t0"), F.array_join(F.transform(F.sequence(F.lit(1), (k % 5 + 1).cast("int")), lambda i: F.concat(F.lit(" "), F.element_at(ops, ((k + i) % 4 + 1).cast("int")), F.lit(" select 'union' from t"), i)), ""))
    return Q.set_operations_of(table(s, d, "orders").select(k.alias("stmt_id"), text.alias("text")))


def anchored_types(s, d):
    li = table(s, d, "lineitem")
    p, n = F.col("l_partkey") % 120, F.col("l_linenumber")
    name = F.concat(F.lit("Tab"), p)
    anchor = F.when(n % 4 == 0, F.concat(name, F.lit("%ROWTYPE"))).when(n % 4 == 1, F.concat(F.lit("app."), name, F.lit(".c"), n, F.lit("%type"))).when(n % 4 == 2, F.concat(name, F.lit(".c"), n, F.lit(" % TYPE"))).otherwise(F.concat(F.lit("v"), p, F.lit("%TYPE")))
    wanted = li.select(anchor.alias("anchor")).unionByName(s.createDataFrame([("a.b.c.d%TYPE",), ("number(9)",), ("a.b.c%ROWTYPE",)], "anchor string"))
    parts = table(s, d, "part").where("p_partkey < 120").select(F.col("p_partkey").alias("p"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("position"))
    column = F.concat(F.lit("C"), "position")
    cat = parts.where("p % 3 <> 1").select(F.lit("APP").alias("owner"), F.concat(F.lit("TAB"), "p").alias("object"), column.alias("column"), "position", F.concat(F.lit("NUMBER("), F.col("p") % 9 + 1, F.lit(")")).alias("type_name"))
    src = parts.where("p % 4 = 0").select(F.lit(None).cast("string").alias("owner"), F.concat(F.lit("tab"), "p").alias("object"), column.alias("column"), "position", F.concat(F.lit("VARCHAR2("), F.col("position"), F.lit(")")).alias("type_name"))
    variables = parts.where("p % 5 = 0 and position = 1").select(F.lit(None).cast("string").alias("owner"), F.concat(F.lit("v"), "p").alias("object"), F.lit(None).cast("string").alias("column"), "position", F.lit("DATE").alias("type_name"))
    return J.anchors(wanted, src.unionByName(variables), cat)


def taint_answers(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("unit"), F.concat(F.lit("V"), F.col("event_id") % 5).alias("name"), "event_id", "event_type")
    kind = F.when(F.col("event_type") == "click", F.array(F.lit("Parameter"))).when(F.col("event_type") == "view", F.array(F.lit("Table"), F.lit("Parameter"))).otherwise(F.array().cast("array<string>"))
    flows = e.where("event_type <> 'error'").select("unit", "name", kind.alias("kinds"), F.when(F.col("event_id") % 97 == 0, F.array(F.lit("DBMS_ASSERT.ENQUOTE_NAME"))).otherwise(F.array().cast("array<string>")).alias("cleansed"))
    returns = e.where("event_type = 'error' and event_id % 3 = 0").select("unit", "name", F.array(F.lit("Remote")).alias("kinds"))
    return J.taint_of(flows, returns)


def captured_gaps(s, d):
    e = table(s, d, "events")
    code = F.when(F.col("event_type") == "error", "UNCLASSIFIED_DECL").when(F.col("event_type") == "view", "PARSE_RECOVERY").otherwise("INFO")
    diagnostics = e.select(code.alias("code"), F.concat(F.lit("r"), F.col("user_id") % 20).alias("rule_path"), F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("s"), F.col("event_id") % 4)).alias("shape"), F.when(F.col("event_id") % 50 == 0, F.array(F.lit("WrappedSource"))).otherwise(F.array().cast("array<string>")).alias("unknown_reasons"))
    return Y.capture(diagnostics, "c0ffee")


def regressed_metrics(s, d):
    e = table(s, d, "events").groupBy(F.concat(F.lit("m"), "user_id").alias("metric"))
    return Y.regressed(e.agg(F.count("*").cast("double").alias("value")), e.agg(F.count_if(F.col("event_id") % 150 != 7).cast("double").alias("value")).where("metric <> 'm3'"))


def dishonest_repairs(s, d):
    k = F.col("o_orderkey")
    m = table(s, d, "orders").select(
        k.alias("candidate"),
        F.element_at(F.array(*(F.lit(x) for x in ("g", "l", "d", "unrepairable", "x"))), (k % 5 + 1).cast("int")).alias("repair_class"),
        F.when(k % 7 > 0, "sig").alias("signature"),
        F.when(k % 11 == 0, "weakened").when(k % 13 > 0, "kept").alias("posture"),
        (k % 4).alias("resolved"),
        (k % 6).alias("extracted"),
        F.when(k % 2 == 0, "DynamicSqlOpaque").alias("unknown_reason"),
    )
    return Y.dishonest(m)


def residue_texts(s, d):
    docs = table(s, d, "documents")
    text = F.when(F.col("doc_id") % 9 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" Planted_Leak here"))).when(F.col("doc_id") % 31 != 0, F.col("text"))
    return Y.residue(docs.select(F.col("doc_id").alias("name"), text.alias("text")))


def accepted_findings(s, d):
    f = table(s, d, "lineitem").select(F.concat(F.lit("fp:"), F.col("l_partkey") % 300).alias("fingerprint"))
    return R.build_baseline(f)


def recompile_within(s, d):
    """The order of recompiling some kinds of nodes only: what of it depends on what, by the edges among them."""
    some = C.nodes(s, d).where("identity_kind in ('region', 'nation')").select("node_id")
    return V.recompile_order(X.induced(C.edges(s, d), some), some)


QUERIES = [
    sql_tables, sql_scopes, sql_columns, sql_projections, sql_column_edges, sql_use_facts, dependency_facts, dependencies_from_facts, impact_from_facts, fact_graph, induced_edges, dynamic_evidence,
    set_operations, anchored_types, taint_answers, captured_gaps, regressed_metrics, dishonest_repairs, residue_texts, accepted_findings, recompile_within,
]
SQL = {
    "sql_tables": f'WITH {_LINES} SELECT DISTINCT k AS stmt_id, s AS schema, t AS "table", u AS usage FROM tb',
    "sql_scopes": f'WITH {_COLUMNS} SELECT k AS stmt_id, a AS alias, s AS schema, t AS "table" FROM al UNION ALL SELECT k, \'T\' || k % 7, \'APP\', \'T\' || k % 7 FROM o WHERE k % 5 = 1',
    "sql_columns": f'WITH {_COLUMNS} SELECT k AS stmt_id, w AS access, q AS qualifier, c AS "column", r AS resolution FROM cu',
    "sql_projections": f"""WITH {_LINES} SELECT k AS stmt_id, n AS ordinal, 'x' || n || '.' || lower(c) AS expression, '' AS alias, false AS star FROM l WHERE k % 5 = 0
UNION ALL SELECT k, count(*) + 1, '''from x''', 'lit', false FROM l WHERE k % 5 = 0 GROUP BY k""",
    "sql_column_edges": f'WITH {_COLUMNS} SELECT k AS stmt_id, t AS "table", c AS "column", kind FROM ce',
    "sql_use_facts": f"WITH {_COLUMNS} SELECT k AS stmt_id, target, e AS edge_kind FROM uf",
    "dependency_facts": f"WITH {_FACTS} SELECT src, dst, kind FROM fe",
    "dependencies_from_facts": f"WITH RECURSIVE {_FACTS}, w(n, k) AS (SELECT x, 0 FROM (VALUES ('APP.C10'), ('APP.C21')) v(x) UNION SELECT dst, k + 1 FROM w JOIN fe ON src = n WHERE k < 2) SELECT DISTINCT src, dst, kind FROM fe JOIN w ON src = n",
    "impact_from_facts": f"""WITH RECURSIVE {_FACTS}, w(n, k) AS (SELECT x, 0 FROM (VALUES ('TAB5'), ('S1.TAB7')) v(x) UNION SELECT src, k + 1 FROM w JOIN fe ON dst = n WHERE k < 20)
SELECT n AS node_id, 'Exact' AS tier, min(k)::INTEGER AS hops FROM w GROUP BY n HAVING min(k) > 0""",
    "fact_graph": f"""WITH {_FACTS} SELECT split_part(src, '.', 1) AS src_owner, CASE WHEN dst LIKE 'TAB%' THEN 'TAB' ELSE split_part(dst, '.', 1) END AS dst_owner, kind, count(*) AS n FROM fe GROUP BY 1, 2, 3""",
    "induced_edges": with_ctes("nodes edges", "SELECT edge_id, src, dst, kind FROM edges WHERE src IN (SELECT node_id FROM nodes WHERE identity_kind IN ('nation', 'customer', 'supplier')) AND dst IN (SELECT node_id FROM nodes WHERE identity_kind IN ('nation', 'customer', 'supplier'))"),
    "dynamic_evidence": """WITH o AS (SELECT o_orderkey AS k FROM orders)
SELECT k AS unit, 0::BIGINT AS site, 'ExecuteImmediate' AS form, 'select a from app.t' || k % 9 || ' where 1 = ' || repeat('|<expr>| and ''q'' = ', (k % 4)::INTEGER) AS fragments, (k % 4)::BIGINT AS interpolated, CASE WHEN k % 3 = 0 THEN k % 4 ELSE 0 END::BIGINT AS sanitised,
  k % 5 = 0 AS binds, 'APP.T' || k % 9 AS candidates, CASE WHEN k % 4 > 0 THEN 'ContainsExpression' ELSE 'LiteralOnly' END AS reason FROM o
UNION ALL SELECT k, 1, 'RefCursorBind', '<expr>', 1, 0, false, '', 'RefCursorBind' FROM o WHERE k % 2 = 0""",
    "set_operations": "SELECT o_orderkey AS stmt_id, i AS ordinal, ['UNION', 'MINUS', 'INTERSECT', 'EXCEPT'][((o_orderkey + i) % 4 + 1)::INTEGER] AS operation FROM (SELECT o_orderkey, unnest(range(1, o_orderkey % 5 + 2)) AS i FROM orders)",
    "anchored_types": """WITH w AS (SELECT DISTINCT l_partkey % 120 AS p, l_linenumber AS n, CASE l_linenumber % 4 WHEN 0 THEN 'Tab' || l_partkey % 120 || '%ROWTYPE' WHEN 1 THEN 'app.Tab' || l_partkey % 120 || '.c' || l_linenumber || '%type' WHEN 2 THEN 'Tab' || l_partkey % 120 || '.c' || l_linenumber || ' % TYPE' ELSE 'v' || l_partkey % 120 || '%TYPE' END AS anchor FROM lineitem),
x AS (SELECT DISTINCT anchor, p, CASE n % 4 WHEN 0 THEN 'Row' ELSE 'Column' END AS kind, CASE WHEN n % 4 IN (1, 2) THEN n END AS c, n % 4 = 3 AS v FROM w),
y AS (SELECT *, p IN (SELECT p_partkey FROM part) AS there FROM x),
z AS (SELECT anchor, kind, p, c, CASE WHEN NOT there THEN NULL WHEN v THEN CASE WHEN p % 5 = 0 THEN 'source' END WHEN c > 4 THEN NULL WHEN p % 4 = 0 THEN 'source' WHEN p % 3 <> 1 THEN 'catalog' END AS origin, v FROM y)
SELECT anchor, CASE WHEN origin IS NULL THEN 'Unresolved' ELSE kind END AS kind, CASE WHEN origin IS NULL THEN NULL WHEN v THEN 'DATE' WHEN kind = 'Row' THEN array_to_string(list_transform([1, 2, 3, 4], lambda i: 'C' || i || ' ' || CASE WHEN origin = 'source' THEN 'VARCHAR2(' || i || ')' ELSE 'NUMBER(' || p % 9 + 1 || ')' END), ', ')
  WHEN origin = 'source' THEN 'VARCHAR2(' || c || ')' ELSE 'NUMBER(' || p % 9 + 1 || ')' END AS type, origin FROM z
UNION ALL SELECT a, 'Unsupported', NULL, NULL FROM (VALUES ('a.b.c.d%TYPE'), ('number(9)'), ('a.b.c%ROWTYPE')) q(a)""",
    "taint_answers": """WITH e AS (SELECT user_id AS unit, 'V' || event_id % 5 AS name, event_id, event_type FROM events WHERE event_type <> 'error' OR event_id % 3 = 0),
g AS (SELECT unit, name, array_to_string(list_filter([CASE WHEN bool_or(event_type IN ('click', 'view')) THEN 'Parameter' END, CASE WHEN bool_or(event_type = 'error') THEN 'Remote' END, CASE WHEN bool_or(event_type = 'view') THEN 'Table' END], lambda x: x IS NOT NULL), ',') AS kinds,
  CASE WHEN bool_or(event_type <> 'error' AND event_id % 97 = 0) THEN 'DBMS_ASSERT.ENQUOTE_NAME' ELSE '' END AS cleansed FROM e GROUP BY 1, 2)
SELECT *, kinds <> '' AND cleansed = '' AS tainted FROM g""",
    "captured_gaps": """WITH e AS (SELECT CASE event_type WHEN 'error' THEN 'UNCLASSIFIED_DECL' WHEN 'view' THEN 'PARSE_RECOVERY' ELSE 'INFO' END AS code, 'r' || user_id % 20 AS rule_path, CASE WHEN event_id % 4 > 0 THEN 's' || event_id % 4 ELSE '' END AS shape, event_id FROM events WHERE event_type IN ('error', 'view') OR event_id % 50 = 0)
SELECT sha256(code || ';' || rule_path || ';' || shape) AS signature, any_value(code) AS diag_code, any_value(rule_path) AS rule_path, count(*) AS occurrence_count, 'c0ffee' AS first_seen_commit FROM e GROUP BY 1""",
    "regressed_metrics": """WITH g AS (SELECT 'm' || user_id AS metric, count(*)::DOUBLE AS was, CASE WHEN user_id <> 3 THEN count(*) FILTER (WHERE event_id % 150 <> 7) END::DOUBLE AS "is" FROM events GROUP BY user_id) SELECT * FROM g WHERE "is" IS NULL OR "is" < was""",
    "dishonest_repairs": """WITH m AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 4 THEN 'UnknownClass' WHEN o_orderkey % 7 = 0 THEN 'NoSignature' WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN 'WeakPosture'
  WHEN o_orderkey % 4 > 0 AND o_orderkey % 6 < o_orderkey % 4 THEN 'Suppression' WHEN o_orderkey % 5 = 2 AND o_orderkey % 2 = 1 THEN 'SilencedUnknown' END AS p FROM orders) SELECT k AS candidate, p AS problem FROM m WHERE p IS NOT NULL""",
    "residue_texts": """SELECT doc_id AS name, CASE WHEN doc_id % 9 = 0 THEN 'Marker PLANTED_LEAK' ELSE 'Unreadable' END AS problem FROM documents WHERE doc_id % 9 = 0 OR doc_id % 31 = 0 OR text IS NULL""",
    "accepted_findings": "SELECT DISTINCT 'fp:' || l_partkey % 300 AS accepted FROM lineitem",
    "recompile_within": with_ctes("nodes", """WITH r AS (SELECT node_id FROM nodes WHERE identity_kind = 'region'), n AS (SELECT n_nationkey::BIGINT * 8 + 1 AS node_id, n_regionkey::BIGINT * 8 AS dst FROM nation)
SELECT node_id, row_number() OVER (ORDER BY node_id) AS position FROM r UNION ALL SELECT node_id, (SELECT count(*) FROM r) + row_number() OVER (ORDER BY dst, node_id) FROM n"""),
}
