"""Queries of the scanners, rules and embedded-SQL operators over text units, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as R
from ..operators import scan as S
from ..operators.catalog import privilege_facts
from .tables import cut, table
from .text_units import STATEMENTS_SQL, UNITS_SQL, statements, units

_NAMES = {f.__name__: f for f in S.SCANNERS}


def _scanner(f):
    def query(s, d):
        return f(units(s, d)).distinct()

    query.__name__ = "scan_" + f.__name__
    return query


_DML = r"\b(insert\s+into|update\s|delete\s+from|merge\s+into)"
_none = "NULL::VARCHAR AS detail"


def _list(kind: str, expr: str, extra: str = "") -> str:
    return f"WITH {UNITS_SQL} SELECT DISTINCT unit, '{kind}' AS kind, detail FROM (SELECT unit, unnest({expr}) AS detail FROM v {extra})"


def _where(kind: str, cond: str, detail: str = "NULL::VARCHAR") -> str:
    return f"WITH {UNITS_SQL} SELECT unit, '{kind}' AS kind, {detail} AS detail FROM v WHERE {cond}"


def _marks(marks, col: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN contains({col}, '{m}') THEN '{m}' END" for m in marks) + "], lambda x: x IS NOT NULL)"


_hot = lambda c: " OR ".join(f"contains({c}, '{m}')" for m in S.SENSITIVE)
_SYN = r"public\s+synonym\s+([a-z0-9_$#.]+)\s+for\s+([a-z0-9_$#.]+)"
SQL = {
    "scan_exception_handlers": f"""WITH {UNITS_SQL}, h AS (SELECT unit, unnest(list_slice(regexp_split_to_array(regexp_extract(low, '(?s)\\bexception\\b(.*)$', 1), '\\bwhen\\s+'), 2, 100)) AS h FROM v),
p AS (SELECT unit, trim(regexp_extract(h, '(?s)^(.*?)\\s+then\\b', 1)) AS scope, trim(regexp_replace(regexp_extract(h, '(?s)\\bthen\\b(.*)$', 1), '(?s)\\bend\\b.*$', '')) AS body FROM h)
SELECT DISTINCT unit, 'exception_handler' AS kind, scope || '|' || CASE WHEN regexp_matches(body, '^(null\\s*;?)?$') THEN 'noop' WHEN regexp_matches(body, '\\bcommit\\b') THEN 'commit' WHEN regexp_matches(body, '\\brollback\\b') THEN 'rollback' ELSE 'other' END AS detail FROM p WHERE scope <> ''""",
    "scan_cursor_for_loops": _list("cursor_for_loop", "list_transform(regexp_extract_all(m, '\\bfor\\s+([a-z_][a-z0-9_]*)\\s+in\\s+(\\(\\s*select|[a-z_][a-z0-9_]*\\s+loop)', 1), lambda x: x || '|' || regexp_matches(m, '(?s)\\bloop\\b.*\\b(insert\\s+into|update|delete\\s+from|merge\\s+into)\\b.*\\bend\\s+loop\\b')::VARCHAR)"),
    "scan_missing_instrumentation": _where("missing_instrumentation", "regexp_matches(m, '\\bbegin') AND NOT (" + " OR ".join(f"contains(m, '{x}')" for x in S.INSTRUMENTS) + ")"),
    "scan_hardcoded_credentials": _list("hardcoded_credential", "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(low, '{x}[^;'']{{0,64}}''') THEN '{x}' END" for x in S.CREDENTIALS) + "], lambda x: x IS NOT NULL)"),
    "scan_invoker_rights": _where("invoker_rights", "contains(c, 'authid current_user')"),
    "scan_ref_cursor_return": _where("ref_cursor_return", "contains(c, 'return sys_refcursor') OR contains(c, 'return ref cursor')"),
    "scan_dml_in_function": _where("dml_in_function", f"regexp_matches(m, '\\bfunction') AND regexp_matches(m, '{_DML}')"),
    "scan_unbounded_bulk_collect": _where("unbounded_bulk_collect", "len(list_filter(regexp_extract_all(c, '(bulk collect into[^;]*)', 1), lambda x: NOT contains(x, 'limit'))) > 0"),
    "scan_deprecated_features": _list("deprecated_feature", _marks(("dbms_job", "(+)", "commit work", "rollback work"), "c")),
    "scan_deterministic_misuse": _list("deterministic_misuse", f"list_filter(list_concat([CASE WHEN regexp_matches(m, '{_DML}') THEN 'dml' END], " + _marks(("sysdate", "systimestamp", "current_timestamp", "dbms_random", ".nextval"), "m") + "), lambda x: x IS NOT NULL)", "WHERE contains(m, 'deterministic')"),
    "scan_mutating_triggers": f"WITH {UNITS_SQL}, w AS (SELECT unit, regexp_extract(c, '\\btrigger\\b.*? on ([a-z0-9_$#.]+)', 1) AS own, regexp_extract(c, '(for each row.*)$', 1) AS body FROM v) SELECT unit, 'mutating_table_trigger' AS kind, own AS detail FROM w WHERE own <> '' AND (contains(body, 'from ' || own) OR contains(body, 'update ' || own) OR contains(body, 'insert into ' || own) OR contains(body, 'merge into ' || own))",
    "scan_log_without_reraise": f"WITH {UNITS_SQL}, w AS (SELECT unit, regexp_split_to_array(regexp_extract(m, '(?s)\\bexception\\b\\s+when\\b(.*)$', 1), '\\bwhen\\s')[1] AS f FROM v) SELECT unit, 'log_without_reraise' AS kind, {_none} FROM w WHERE regexp_matches(f, 'log|dbms_output|trace|debug') AND NOT regexp_matches(f, '\\braise')",
    "scan_cross_schema_writes": _list("cross_schema_write", "list_filter(regexp_extract_all(m, '\\b(?:insert\\s+into|update|delete\\s+from|merge\\s+into)\\s+([a-z0-9_$#]+\\.[a-z0-9_$#]+)', 1), lambda x: split_part(x, '.', 1) <> 'app')"),
    "scan_sensitive_synonyms": f"WITH {UNITS_SQL}, w AS (SELECT unit, regexp_extract(m, '{_SYN}', 1) AS a, regexp_extract(m, '{_SYN}', 2) AS b FROM v), x AS (SELECT *, string_split(b, '.')[-1] AS l FROM w) SELECT unit, 'sensitive_public_synonym' AS kind, a || '>' || b AS detail FROM x WHERE a <> '' AND ({_hot('a')} OR {_hot('l')})",
    "scan_null_tests_on_indexed": _list("is_null_on_indexed_column", "list_intersect(flatten(list_transform(regexp_extract_all(m, 'create\\s+(?:unique\\s+|bitmap\\s+)?index\\s+\\S+\\s+on\\s+[a-z0-9_$#.]+\\s*\\(([^)]*)\\)', 1), lambda x: string_split(regexp_replace(x, '\\s+', '', 'g'), ','))), regexp_extract_all(m, '([a-z0-9_$#]+)\\s+is\\s+null', 1))"),
    "scan_db_links": _list("db_link_reference", "list_transform(regexp_extract_all(m, '([a-z0-9_$#.]+@[a-z0-9_$#]+)', 1), lambda x: upper(x))"),
    "scan_opaque_sites": _list("opacity", "CASE WHEN contains(m, 'dbms_sql.') THEN ['DBMS_SQL'] END"),
    "sql_verbs": f"""WITH {STATEMENTS_SQL}, w AS (SELECT *, upper(regexp_extract(regexp_replace(sql, '^(?:\\s*/\\*(?s:.*?)\\*/)*\\s*', ''), '^([A-Za-z]+)', 1)) AS w FROM s)
SELECT stmt_id, CASE WHEN w IN ('SELECT', 'INSERT', 'UPDATE', 'DELETE', 'MERGE', 'WITH') THEN w ELSE 'OTHER' END AS verb, w IN ('SELECT', 'WITH') AS read_only, CASE WHEN strlen(sql) > 72 THEN substring(sql, 1, 72) || '…' ELSE sql END AS preview FROM w""",
    "table_accesses": """WITH s(i, t, a) AS (VALUES (0, 'T1', 'Read'), (0, 'APP.T2', 'Read'), (1, 'T3', 'Write'), (1, 'T4', 'Read'), (2, 'T6', 'Write'), (2, 'T7', 'Read'), (3, 'T8', 'Write'), (4, 'T9', 'Write'), (4, 'T10', 'Read'), (5, 'Q', 'Read'))
SELECT o_orderkey AS stmt_id, t AS "table", a AS access FROM orders JOIN s ON o_orderkey % 7 = i""",
    "dynamic_sql": """WITH s(i, f, h, c, k) AS (VALUES (13, 'ExecuteImmediate', 1, 0, 'Low'), (14, 'ExecuteImmediate', 1, 1, 'Medium'), (15, 'DbmsSql', 0, 0, 'Opaque'), (16, 'RefCursor', 0, 0, 'Opaque'), (17, 'ExecuteImmediate', 0, 0, 'High'))
SELECT 'app.u' || o_orderkey AS unit, f AS form, h::BIGINT AS interpolated, c::BIGINT AS sanitised, k AS confidence FROM orders JOIN s ON o_orderkey % 20 = i""",
    "dynamic_sql_enriched": """WITH s(i, k) AS (VALUES (13, 'Low'), (14, 'Medium'), (15, 'Opaque'), (16, 'Opaque'), (17, 'High'))
SELECT 'app.u' || o_orderkey AS unit, CASE WHEN o_orderkey % 3 = 0 THEN 'High' WHEN o_orderkey % 3 = 1 AND k IN ('Low', 'Opaque') THEN 'Medium' ELSE k END AS confidence FROM orders JOIN s ON o_orderkey % 20 = i""",
    "column_edges": """SELECT DISTINCT l_orderkey AS stmt_id, CASE WHEN l_linenumber % 3 > 0 THEN 't' || l_linenumber ELSE '?' END AS "table", 'C' || l_suppkey % 5 AS "column",
CASE WHEN l_suppkey % 11 = 0 THEN 'DerivesColumn' WHEN (l_linenumber % 3 > 0 OR l_suppkey % 2 = 1) AND l_returnflag = 'R' THEN 'WritesColumn' WHEN l_linenumber % 3 > 0 OR l_suppkey % 2 = 1 THEN 'ReadsColumn' WHEN l_returnflag = 'R' THEN 'WritesUnknownColumnOfTable' ELSE 'ReadsUnknownColumnOfTable' END AS kind FROM lineitem""",
    "injection_findings": """WITH e AS (SELECT DISTINCT 'u' || user_id AS unit, 'N' || event_id % 7 AS name FROM events WHERE event_type = 'click'), o AS (SELECT DISTINCT 'u' || user_id AS unit FROM events WHERE event_type = 'error' AND event_id % 40 = 0),
t AS (SELECT DISTINCT 'u' || user_id AS unit, 'N' || event_id % 7 AS name FROM events WHERE event_type = 'purchase'),
h AS (SELECT 'u' || user_id AS unit, 'N' || event_id % 7 AS name, min(CASE WHEN event_id % 2 = 0 THEN 'Literal' ELSE 'Opaque' END) AS shape FROM events WHERE event_type = 'signup' GROUP BY 1, 2)
SELECT 'SEC001' AS rule_id, 'Critical' AS severity, 'tainted dynamic statement: ' || unit || ' ' || name AS message, unit, 'High' AS conf_level FROM e JOIN t USING (unit, name) JOIN h USING (unit, name) WHERE unit NOT IN (SELECT unit FROM o) AND shape NOT IN ('Literal', 'Empty')""",
    "baseline_status": """WITH f AS (SELECT DISTINCT l_partkey % 500 AS k FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber < 4), a AS (SELECT DISTINCT l_partkey % 500 AS k FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber > 5)
SELECT k AS fingerprint, CASE WHEN k IN (SELECT k FROM a) THEN 'suppressed' ELSE 'new' END AS status FROM f UNION ALL SELECT k, 'fixed' FROM a WHERE k NOT IN (SELECT k FROM f)""",
    "suppressed_findings": """WITH f AS (SELECT 'R' || event_id % 5 AS rule_id, 'src/m' || user_id % 3 || '/f' || user_id AS file, (event_id % 4)::INTEGER AS line, event_id FROM events WHERE event_type = 'error'),
d AS (SELECT 'src/m' || user_id % 3 || '/f' || user_id AS file, (event_id % 4)::INTEGER AS line, 'R' || event_id % 5 AS rule_id FROM events WHERE event_type = 'view' AND event_id % 9 = 0)
SELECT rule_id, file, line, event_id, coalesce(CASE WHEN rule_id = 'R1' THEN 'global' END, CASE WHEN rule_id = 'R2' AND starts_with(file, 'src/m1') THEN 'path src/m1' END,
  'line ' || (SELECT min(d.line) FROM d WHERE d.file = f.file AND d.rule_id = f.rule_id AND (f.line = 0 OR d.line = f.line OR d.line = f.line - 1))) AS suppressed FROM f""",
    "false_positive_rate": f"""WITH {UNITS_SQL}, h AS (SELECT unit, contains(low, 'exception when others then null') AS hit FROM v) SELECT count(*) AS units, count(*) FILTER (WHERE hit) AS flagged, round(count(*) FILTER (WHERE hit) / count(*)::DOUBLE, 9) AS rate FROM h""",
    "rule_counts": """WITH f(i, rule_id, severity) AS (VALUES (0, 'SEC007', 'Medium'), (0, 'QUAL007', 'Medium'), (1, 'QUAL001', 'Medium'), (2, 'QUAL004', 'Medium'), (3, 'PERF001', 'Low'), (4, 'PERF001', 'Low'), (3, 'PERF002', 'Medium'), (5, 'SEC003', 'Critical'), (5, 'SEC003', 'Critical'), (6, 'SEC004', 'Medium'),
  (7, 'QUAL003', 'Medium'), (8, 'QUAL005', 'Low'), (8, 'QUAL005', 'Low'), (8, 'QUAL005', 'Low'), (9, 'QUAL008', 'Medium'), (10, 'QUAL006', 'High'), (11, 'SEC005', 'High'), (12, 'PERF003', 'Medium'), (0, 'DEP001', 'Medium'), (18, 'DEP001', 'Medium'), (2, 'QUAL002', 'Medium'), (15, 'SEC002', 'Medium'), (0, 'STYLE001', 'Info'), (1, 'STYLE001', 'Info'), (3, 'STYLE001', 'Info'), (8, 'STYLE001', 'Info'), (9, 'STYLE001', 'Info'), (10, 'STYLE001', 'Info'), (13, 'STYLE001', 'Info'), (14, 'STYLE001', 'Info'), (15, 'STYLE001', 'Info'), (16, 'STYLE001', 'Info'), (17, 'STYLE001', 'Info'), (18, 'STYLE001', 'Info'), (19, 'STYLE001', 'Info')),
n AS (SELECT o_orderkey % 20 AS i, count(*) AS n FROM orders GROUP BY 1)
SELECT rule_id, sum(n)::BIGINT AS findings, any_value(severity) AS max_severity, 0::BIGINT AS skipped FROM f JOIN n USING (i) GROUP BY rule_id UNION ALL SELECT 'SEC006', count(*), 'High', 0 FROM customer WHERE c_custkey % 50 = 0""",
}


def sql_verbs(s, d):
    return statements(s, d).select("stmt_id", S.verb().alias("verb"), S.read_only().alias("read_only"), S.preview().alias("preview"))


def table_accesses(s, d):
    return S.table_accesses(statements(s, d))


def dynamic_sql(s, d):
    return S.dynamic_sql(units(s, d))


def dynamic_sql_enriched(s, d):
    shapes = table(s, d, "orders").select(F.concat(F.lit("app.u"), "o_orderkey").alias("unit"), F.when(F.col("o_orderkey") % 3 == 0, "Literal").when(F.col("o_orderkey") % 3 == 1, "InterpolatedWithFix").otherwise("FullyOpaque").alias("shape"))
    return S.enrich(S.dynamic_sql(units(s, d)), shapes)


def column_edges(s, d):
    n = F.col("l_linenumber")
    u = table(s, d, "lineitem").select(F.col("l_orderkey").alias("stmt_id"), F.concat(F.lit("c"), F.col("l_suppkey") % 5).alias("column"), F.when(n % 3 > 0, F.concat(F.lit("T"), n)).alias("table"), F.when(F.col("l_suppkey") % 2 == 1, 1).otherwise(2).alias("n_tables"), (F.col("l_returnflag") == "R").alias("write"), (F.col("l_suppkey") % 11 == 0).alias("star"))
    return S.column_edges(u)


def injection_findings(s, d):
    e = table(s, d, "events").withColumns({"unit": F.concat(F.lit("u"), "user_id"), "n": F.concat(F.lit("n"), F.col("event_id") % 7)})
    kinds = {"click": "dynamic_sql_evidence", "purchase": "taint", "signup": "string_shape"}
    shape = F.concat_ws("|", "n", F.when(F.col("event_id") % 2 == 0, "Literal").otherwise("Opaque"))
    f = e.where(F.col("event_type").isin(*kinds)).select("unit", F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))[F.col("event_type")].alias("kind"), F.when(F.col("event_type") == "signup", shape).otherwise(F.col("n")).alias("detail"))
    f = f.unionByName(e.where("event_type = 'error' and event_id % 40 = 0").select("unit", F.lit("opacity").alias("kind"), F.lit("DBMS_SQL").alias("detail")))
    return R.injection(f)[0]


def baseline_status(s, d):
    from ..operators.joins import baseline

    li = table(s, d, "lineitem").withColumn("fingerprint", F.col("l_partkey") % 500)
    return baseline(li.where("l_returnflag = 'R' and l_linenumber < 4"), li.where("l_returnflag = 'A' and l_linenumber > 5"))


def suppressed_findings(s, d):
    e = table(s, d, "events").withColumns({"file": F.concat(F.lit("src/m"), F.col("user_id") % 3, F.lit("/f"), "user_id"), "line": (F.col("event_id") % 4).cast("int"), "rule_id": F.concat(F.lit("R"), F.col("event_id") % 5)})
    f = e.where("event_type = 'error'").select("rule_id", "file", "line", "event_id")
    config = s.createDataFrame([("R1", None), ("R2", "src/m1")], "rule_id string, path string")
    return R.suppress(f, config, e.where("event_type = 'view' and event_id % 9 = 0").select("file", "line", "rule_id"))


def _findings(s, d):
    grants = table(s, d, "customer").select(F.concat(F.lit("app.o"), "c_custkey").alias("object"), F.when(F.col("c_custkey") % 50 == 0, "public").otherwise("u1").alias("grantee"), F.lit("select").alias("privilege"))
    return R.run(cut(S.all_sites(units(s, d)).unionByName(privilege_facts(grants))))


def scan_findings(s, d):
    return _findings(s, d)[0]


def rule_counts(s, d):
    found, skipped = _findings(s, d)
    return R.histogram(found, skipped)


def sarif(s, d):
    return R.sarif_results(_findings(s, d)[0])


def junit(s, d):
    return R.junit_cases(_findings(s, d)[0])


def false_positive_rate(s, d):
    found = _findings(s, d)[0].where("rule_id = 'QUAL001'")
    return R.false_positive_rate(found, units(s, d)).withColumn("rate", F.round("rate", 9))


QUERIES = [*(_scanner(f) for f in S.SCANNERS), sql_verbs, table_accesses, dynamic_sql, dynamic_sql_enriched, column_edges, injection_findings, baseline_status, suppressed_findings, scan_findings, rule_counts, sarif, junit, false_positive_rate]
