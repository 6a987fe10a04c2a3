"""SQL models, facts as graphs, documents, ledgers and the gates of repairs, against answers made by hand."""

import json
import time
import xml.etree.ElementTree as ET

import pytest

from plumbline.frames import cut, ranked
from plumbline.operators import changes, factgraph, gaps, graph, joins, ledger, render, rules, traverse
from plumbline.sources import sqlmodel as Q


def tables(sql):
    return [(s, t, u) for s, t, _, u in Q.resolve(sql).tables]


@pytest.mark.parametrize(
    "sql, want",
    [
        ("  select id from Staff st", [("", "STAFF", "Read")]),
        ("select 1 into v from hr.staff", [("HR", "STAFF", "Read")]),
        ("select 1 from p, q r, s where p.x = r.x", [("", "P", "Read"), ("", "Q", "Read"), ("", "S", "Read")]),
        ("select 1 from dual", []),
        ("insert into sums select id from staff join units u on u.id = staff.u", [("", "SUMS", "Write"), ("", "STAFF", "Read"), ("", "UNITS", "Read")]),
        ("insert into log values ('taken from cache')", [("", "LOG", "Write")]),
        ("update staff e set e.pay = 2", [("", "STAFF", "Write")]),
        ("delete hr.old where id in (select id from stage)", [("HR", "OLD", "Write"), ("", "STAGE", "Read")]),
        ("delete from old", [("", "OLD", "Write")]),
        ("merge into t using (select * from s1 a, s2) q on (t.k = q.k) when matched then update set v = 1", [("", "T", "ReadWrite"), ("", "S1", "Read"), ("", "S2", "Read")]),
        ("with c as (select * from base) select * from c join \"Odd\".x on x.a = c.a", [("", "BASE", "Read"), ("Odd", "X", "Read")]),
        ("select extract(day from d), trim('x' from n) from t -- from z", [("", "T", "Read")]),
        ("select a from t1 union all select b from t2 minus select c from far@link", [("", "T1", "Read"), ("", "T2", "Read"), ("", "FAR@LINK", "Read")]),
        ("select 1 from (a join b on a.i = b.i)", [("", "A", "Read"), ("", "B", "Read")]),
        ("delete é★ where x = 1", []),
        ("", []),
        (None, []),
    ],
)
def test_tables(sql, want):
    assert tables(sql) == want


def test_scope_is_shadowed_and_of_any_case():
    m = Q.resolve("select 1 from a x where exists (select 1 from s.b X)")
    assert m.resolve("x") == ("S", "B") and m.resolve("nobody") is None


def test_columns_of_one_and_several_tables():
    m = Q.columns("select pay, upper(name) n, count(*) from staff where unit = :u group by unit")
    assert m.reads == [("", "PAY", "Resolved"), ("", "NAME", "Resolved"), ("", "UNIT", "Resolved")]
    assert [(e, a) for e, a, _ in m.projection] == [("pay", ""), ("upper(name)", "n"), ("count(*)", "")]
    m = Q.columns("select e.pay, name, d.* from staff e join units d on e.u = d.id where z.q = 1")
    assert set(m.reads) == {("E", "PAY", "Resolved"), ("", "NAME", "Unresolved"), ("D", "*", "StarExpansion"), ("E", "U", "Resolved"), ("D", "ID", "Resolved"), ("Z", "Q", "Unresolved")}
    assert set(Q.column_edges(m)) == {("STAFF", "PAY", "ReadsColumn"), ("?", "NAME", "ReadsUnknownColumnOfTable"), ("UNITS", "*", "DerivesColumn"), ("STAFF", "U", "ReadsColumn"), ("UNITS", "ID", "ReadsColumn"), ("?", "Q", "ReadsUnknownColumnOfTable")}
    m = Q.columns("update t set (a, b) = (select 1, c from u), d = e + 1")
    assert {c for _, c, _ in m.writes} == {"A", "B", "D"} and {c for _, c, _ in m.reads} >= {"C", "E"}
    assert ("T", "Writes") in Q.use_facts(m) and ("?.D", "WritesColumn:unknown") in Q.use_facts(m)


def test_dynamic_statements():
    got = Q.dynamic("begin execute immediate 'drop table ' || dbms_assert.simple_sql_name(t); open c for 'select a from t1 where x = :b' using p; open d for select 1 from dual; dbms_sql.parse(c, 's'); end;")
    assert [r[1:] for r in got] == [
        ("ExecuteImmediate", "drop table |<expr>", 1, 1, False, "", "ContainsExpression"),
        ("RefCursorBind", "select a from t1 where x = :b", 0, 0, True, "T1", "LiteralOnly"),
        ("DbmsSql", "", 0, 0, False, "", "DbmsSqlChain"),
    ]


def test_facts_to_graph_to_impact(spark, tmp_path):
    uses = spark.createDataFrame([("app.a", " APP.B ", "Calls"), ("APP.b", "t", "Reads"), ("app.a", "app.b", "Calls"), ("x", None, "Reads"), ("app.c", "app.a", "Calls"), ("t", "app.a", "Fires")], "owner string, target string, edge_kind string")
    facts = cut(factgraph.use_facts(uses))
    assert {tuple(r) for r in factgraph.edges(facts).collect()} == {("APP.A", "APP.B", "Calls"), ("APP.B", "T", "Reads"), ("APP.C", "APP.A", "Calls"), ("T", "APP.A", "Fires")}
    assert {(r["node_id"], r["hops"]) for r in factgraph.impact_from_facts(facts, ["T"]).collect()} == {("APP.B", 1), ("APP.A", 2), ("APP.C", 3)}
    assert {(r["src"], r["dst"]) for r in factgraph.dependencies_from_facts(facts, ["app.a"], 1).collect()} == {("APP.A", "APP.B")}
    assert factgraph.edges(facts.limit(0)).count() == 0
    nodes, edges = factgraph.graph(facts)
    factgraph.save(nodes, edges, str(tmp_path / "g"))
    n2, e2 = factgraph.load(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, n2.collect())) == sorted(map(tuple, nodes.collect())) and e2.count() == 4
    assert [r["node_id"] for r in factgraph.sorted_nodes(n2).collect()] == sorted(r["node_id"] for r in nodes.collect())
    factgraph.save(nodes.limit(1), edges, str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        factgraph.load(spark, str(tmp_path / "bad"))


def test_long_statements_are_read_in_linear_time():
    n = 8_000
    sql = "select " + ", ".join(f"x{i}.c{i}" for i in range(n)) + " from " + ", ".join(f"s.t{i} x{i}" for i in range(n))
    began = time.monotonic()
    facts = Q.use_facts(Q.columns(sql))
    assert time.monotonic() - began < 4
    assert len(facts) == 2 * n and facts[0] == ("S.T0", "Reads") and facts[-1] == (f"S.T{n - 1}.C{n - 1}", "ReadsColumn:exact")
    assert Q.table_facts(Q.resolve(sql)) == facts[:n]


def test_facts_are_read_once_a_walk(spark):
    read = spark.sparkContext.accumulator(0)

    def count(parts):
        for p in parts:
            read.add(p.num_rows)
            yield p

    uses = spark.createDataFrame([(f"a{i}", f"a{i + 1}", "Calls") for i in range(6)], "owner string, target string, edge_kind string").repartition(1)
    for walk, rows in ((factgraph.impact_from_facts, 6), (factgraph.dependencies_from_facts, 0)):
        read.value = 0
        facts = factgraph.use_facts(uses.mapInArrow(count, uses.schema))
        assert walk(facts, ["a6"]).count() == rows and read.value == 6


def test_unsafe_paths_read_the_edges_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(parts):
        for p in parts:
            read.add(p.num_rows)
            yield p

    e = spark.createDataFrame([(i, i, i + 1, "Calls", "Low" if i == 2 else "High") for i in range(5)] + [(9, 70, 5, "Calls", "High")], "edge_id long, src long, dst long, kind string, conf_level string").repartition(1)
    got = traverse.unsafe_paths(e.mapInArrow(count, e.schema), 0, 5).collect()
    assert [r["node_ids"] for r in got] == [[0, 1, 2, 3, 4, 5]] and read.value == 6


def test_orphans_put_ends_together_before_they_are_joined(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (None, "e")], "node_id long, logical_id string")
    edges = spark.createDataFrame([(1, 2), (3, 3), (1, 2), (4, 2)], "src long, dst long")
    found = graph.orphans(edges, nodes)
    assert {(r["logical_id"], r["tier"]) for r in found.collect()} == {("a", "LikelyUnused"), ("c", "HighConfidenceUnused"), ("d", "LikelyUnused"), ("e", "HighConfidenceUnused")}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_shortest_path_by_queue_order(spark):
    e = spark.createDataFrame([(5, 1, 2), (3, 1, 3), (1, 2, 4), (2, 3, 4), (9, 4, 5), (8, 4, 5), (7, 5, 1)], "edge_id long, src long, dst long")
    got = sorted(tuple(r) for r in traverse.shortest_path(e, 1, 5).collect())
    assert got == [(0, 1, None), (1, 3, 3), (2, 4, 2), (3, 5, 8)]
    assert traverse.shortest_path(e, 5, 9).count() == 0 and [tuple(r) for r in traverse.shortest_path(e, 2, 2).collect()] == [(0, 2, None)]


def test_ranks_without_one_task(spark):
    df = spark.range(0, 1000).selectExpr("(id * 7919) % 1000 as v")
    assert {r["v"]: r["n"] for r in ranked(df, "n", "v", start=5).collect()} == {v: v + 6 for v in range(1000)}
    assert ranked(df.limit(0), "n", "v").count() == 0


def test_names_that_many_declare_are_resolved_without_their_pairs(spark):
    n = 40_000  # all pairs would be 1.6 thousand million
    refs = spark.range(n).selectExpr("id as ref_id", "'s' as schema", "'p' as package", "if(id % 2 = 0, 'S', null) as qualifier", "'f' as name")
    decls = spark.range(n).selectExpr("id + 7 as decl_id", "'S' as schema", "if(id % 2 = 0, 'P', 'Q') as package", "'F' as name")
    began = time.monotonic()
    got = joins.resolve(refs, decls, spark.createDataFrame([], "name string, schema string, target string")).groupBy("decl_id", "how").count()
    assert {tuple(r) for r in got.collect()} == {(7, "qualified", n // 2), (7, "package", n // 2)}
    assert time.monotonic() - began < 60


def test_policies():
    p = changes.parse_policy('max_invalidations = 5\nblocked_kinds = ["TRIGGER"]\nmin_confidence = "medium"\nblocking_unknown_reasons = ["WrappedSource"]\n')
    assert p == {"max_invalidations": 5, "blocked_kinds": ("TRIGGER",), "min_confidence": "Medium", "blocking_reasons": ("WrappedSource",)}
    for bad in ("odd = 1", 'max_invalidations = "5"', "max_invalidations = -1", 'min_confidence = "sure"', 'blocking_unknown_reasons = ["NoSuchReason"]', "= 3"):
        with pytest.raises(ValueError):
            changes.parse_policy(bad)


def findings(spark, rows):
    return rules.dedup(spark.createDataFrame(rows, "rule_id string, severity string, message string, unit string, conf_level string"))


def test_sarif_and_junit_documents(spark):
    rows = [("SEC003", "Critical", 'a "b" <c> & d', "app.u1", "High"), ("SEC003", "Critical", 'a "b" <c> & d', "app.u2", "High"), ("QUAL001", "Medium", "m", "app.u3", "High")]
    for some in (rows, []):
        f = findings(spark, some)
        text = "".join(r["text"] for r in sorted(rules.sarif_document(f).collect(), key=lambda r: (r["part"], r["ordinal"])))
        run = json.loads(text)["runs"][0]
        assert [r["ruleId"] for r in run["results"]] == (["QUAL001", "SEC003"] if some else []) and [r["id"] for r in run["tool"]["driver"]["rules"]] == (["QUAL001", "SEC003"] if some else [])
        text = "".join(r["text"] for r in sorted(rules.junit_document(f).collect(), key=lambda r: (r["part"], r["ordinal"])))
        suite = ET.fromstring(text.encode())[0]
        assert suite.get("tests") == str(len(suite)) == ("2" if some else "0")
    assert [r["accepted"] for r in rules.build_baseline(findings(spark, rows)).collect()] == sorted({r["fingerprint"] for r in findings(spark, rows).collect()})


def test_chains_break_where_they_are_changed(spark):
    rows = [("l", i, f"b{i}") for i in range(5)]
    good = ledger.chain(spark.createDataFrame(rows, "k string, seq int, body string"), "k")
    assert ledger.verify(good, "k").count() == 0
    rows[2] = ("l", 2, "other")
    bad = ledger.chain(spark.createDataFrame(rows, "k string, seq int, body string"), "k")
    a, b = ({r["seq"]: r["entry_id"] for r in x.collect()} for x in (good, bad))
    assert [s for s in range(5) if a[s] != b[s]] == [2, 3, 4]
    more = ledger.append_entries(good, spark.createDataFrame([("l", 9, "b4"), ("l", 10, "new")], "k string, seq int, body string"), "k")
    assert sorted(r["seq"] for r in more.collect()) == [0, 1, 2, 3, 4, 10] and ledger.verify(more, "k").count() == 0  # the tip's repetition is none


def test_stores_keep_each_content_once(spark, tmp_path):
    b = spark.createDataFrame([("s", b"a"), ("s", b"a"), ("t", b"a")], "strategy string, body binary")
    for _ in range(2):
        ledger.put_blobs(b, str(tmp_path / "blobs"))
    assert spark.read.parquet(str(tmp_path / "blobs")).count() == 2
    wanted = ledger.blobs(b).select("strategy", "digest").unionByName(spark.createDataFrame([("s", "none")], "strategy string, digest string"))
    assert sorted(r["body"] is None for r in ledger.get_blobs(wanted, str(tmp_path / "blobs")).collect()) == [False, False, True]
    f = ledger.mint(spark.createDataFrame([("k", "c", "s", "p"), ("k", "c", "s", "q"), ("j", "c", None, "p")], "kind string, component string, source_logical_id string, payload string"))
    for _ in range(2):
        ledger.put_facts(f, str(tmp_path / "facts"))
    assert ledger.get_facts(spark, str(tmp_path / "facts")).count() == 3 and ledger.get_facts(spark, str(tmp_path / "facts"), "k").count() == 2


def test_gates_of_repairs(spark):
    base = '{"dep_graph_edges": 10, "facts": 5, "extracted_semantics_ratio": 1.0}'
    assert gaps.regressions(base, "measured: edges=10 facts=6 ratio=1.0") == [] and gaps.regressions(base, "edges=9 facts=5 ratio=0.5") == ["edges 9 < 10", "ratio 0.5 < 1.0"]
    for text in ("edges=1 facts=2", "edges=x facts=1 ratio=1"):
        with pytest.raises(ValueError):
            gaps.regressions(base, text)
    assert gaps.min_fixture("a\nb\nbad\nc\n", lambda s: "bad" in s, 10) == "bad\n"
    for args in (("a", lambda s: "bad" in s, 10), ("bad bad bad", lambda s: "bad" in s, 5)):
        with pytest.raises(ValueError):
            gaps.min_fixture(*args)
    t = spark.createDataFrame([("a", "begin id_0123456789ab := 1; end;"), ("b", "begin secret := 1; end;"), ("c", None), ("d", "x acme corp y")], "name string, text string")
    got = {r["name"]: r["problem"] for r in gaps.residue(t, ("begin", "end")).collect()}
    assert got == {"b": "Word secret", "c": "Unreadable", "d": "Marker ACME CORP"}


def test_anchors_prefer_the_source(spark):
    s = "owner string, object string, column string, position int, type_name string"
    src = spark.createDataFrame([(None, "emp", "pay", 1, "NUMBER"), (None, "v", None, 1, "DATE")], s)
    cat = spark.createDataFrame([("HR", "EMP", "PAY", 1, "VARCHAR2"), ("HR", "EMP", "NAME", 2, "CHAR"), ("HR", "DEPT", "ID", 1, "NUMBER"), ("HR", "DEPT", "TOWN", 2, "CHAR")], s)
    w = spark.createDataFrame([(x,) for x in ("Emp.pay%TYPE", "hr.emp.name%type", "dept%ROWTYPE", "hr.dept%rowtype", "v%TYPE", "nobody%TYPE", "it's", None)], "anchor string")
    got = {r["anchor"]: (r["kind"], r["type"], r["origin"]) for r in joins.anchors(w, src, cat).collect()}
    row = ("Row", "ID NUMBER, TOWN CHAR", "catalog")
    assert got == {"Emp.pay%TYPE": ("Column", "NUMBER", "source"), "hr.emp.name%type": ("Column", "CHAR", "catalog"), "dept%ROWTYPE": row, "hr.dept%rowtype": row, "v%TYPE": ("Column", "DATE", "source"), "nobody%TYPE": ("Unresolved", None, None), "it's": ("Unsupported", None, None), None: ("Unsupported", None, None)}


def test_pages_are_lines_in_order(spark):
    o = spark.createDataFrame([("b|x", "Likely"), ("a<", "Likely")], "logical_id string, tier string")
    assert render.page_text(render.orphans_markdown(o)).first()["text"] == "| object | tier |\n|-|-|\n| a< | Likely |\n| b\\|x | Likely |"
    assert "<td>a&lt;</td>" in render.page_text(render.orphans_html(o)).first()["text"]
    got = render.bindings(spark.createDataFrame([("P", "R", None, [("A", "IN", "NUMBER"), ("B", "OUT", "DATE")], "CLOB"), ("P", "S", 2, [], None)], "package string, routine string, overload int, args array<struct<name string, mode string, type string>>, return_type string"))
    assert sorted(r["line"] for r in got.collect()) == ["def r(connection, a: Decimal | None) -> tuple[str, datetime]: ...", "def s_2(connection) -> None: ..."]


@pytest.mark.parametrize("task_edges", [1000, 0])
def test_unsafe_paths_against_enumeration(spark, task_edges):
    import random

    for seed in range(3):
        rng = random.Random(seed)
        rows = [(i, rng.randrange(8), rng.randrange(8), "OpaqueDynamic" if rng.random() < 0.2 else "Calls", rng.choice(["High", "High", "Low"]) if seed else "High") for i in rng.sample(range(500), 26)]
        want = []

        def walk(at, path, nodes, bad):
            if at == 7 and path:
                if bad:
                    want.append((path, nodes, len(path)))
                return
            for e, s, d, k, c in sorted(rows):
                if s == at and d not in nodes and len(path) < 5:
                    walk(d, [*path, e], [*nodes, d], bad or k == "OpaqueDynamic" or c == "Low")

        walk(0, [], [0], False)
        df = spark.createDataFrame(rows, "edge_id long, src long, dst long, kind string, conf_level string")
        got = sorted((list(r["path_ids"]), list(r["node_ids"]), r["length"]) for r in traverse.unsafe_paths(df, 0, 7, 5, 6, task_edges).collect())
        assert got == want[:6]


def test_explained_paths_and_comments(spark):
    from plumbline.operators import graph

    e = spark.createDataFrame([(1, "High", None), (2, "Low", "by name"), (3, "Medium", None), (4, "Low", "by name")], "edge_id long, conf_level string, evidence string")
    path = spark.createDataFrame([(0, None), (1, 3), (2, 2), (3, 1), (4, 4)], "step int, edge_id long")
    r = graph.explain_path(path, e).first()
    assert (r["length"], r["tier"], r["blockers"]) == (4, "Unknown", ["Medium", "by name"])
    f = spark.createDataFrame([("BlockedKindHit", "TRIGGER", 2), ("InvalidationsExceeded", "5", 9)], "failure string, subject string, observed long")
    r = changes.pr_comment(f, "gate").first()
    assert r["verdict"] == "blocked" and r["body"] == "<!-- gate -->\n**blocked**\n- BlockedKindHit (TRIGGER): 2\n- InvalidationsExceeded (5): 9"
    assert changes.pr_comment(f.limit(0), "gate").first()["verdict"] == "allowed"
    comments = spark.createDataFrame([(7, "x"), (9, r["body"]), (8, "y <!-- gate -->")], "comment_id long, body string")
    assert changes.existing_comment(comments, "gate").first()["comment_id"] == 8 and changes.existing_comment(comments, "other").count() == 0


def test_run_ids_and_docs(spark):
    from plumbline.functions import names
    from plumbline.sources import reader

    def djb2(paths):
        h = 5381
        for b in "".join(p + "\n" for p in sorted(set(paths))).encode():
            h = (h * 33 + b) % 2**64
        return f"{h:016x}"

    df = spark.createDataFrame([("r", "b.sql"), ("r", "a.sql"), ("r", "b.sql"), ("s", "é")], "run string, path string")
    assert {r["run"]: r["run_id"] for r in names.run_id(df, "run").collect()} == {"r": djb2(["a.sql", "b.sql"]), "s": djb2(["é"])}
    u = spark.createDataFrame([("u", "/** Does it.\n @param x the thing\n*/\ncreate procedure app.p is begin null; end;"), ("v", "create function f return date is begin return sysdate; end;")], "unit string, text string")
    got = {r["unit"]: r["text"] for r in render.package_docs(reader.declared(u), names.doc_tags(u)).collect()}
    assert got == {"u": "# u\n\n- procedure `P`\n\n## Tags\n\n- *param* x the thing", "v": "# v\n\n- function `F`"}
