"""Queries of cross-checks, catalog, privileges, changes, ledgers, reports and functions, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import literals as L
from ..functions import names as N
from ..operators import catalog as K
from ..operators import changes as H
from ..operators import joins as J
from ..operators import ledger as G
from ..operators import reports as P
from . import carriers as C
from .carriers import with_ctes
from .tables import table


# facts


def minted_facts(s, d):
    return G.mint(C.facts(s, d)).select("fact_id", "kind", "source_logical_id")


def facts_of_kind(s, d):
    return G.by_kind(G.mint(C.facts(s, d)), "error").select("fact_id", "payload")


def fact_kinds(s, d):
    return G.mint(C.facts(s, d)).groupBy("kind").agg(F.count("*").alias("n"))


def appended_facts(s, d):
    m = G.mint(C.facts(s, d))
    return G.append(m.where("kind in ('view', 'click')"), m.where("kind in ('view', 'error')")).select("fact_id", "kind")


def fact_edges(s, d):
    f = C.facts(s, d).where("kind = 'click'").select(F.upper(F.trim("source_logical_id")).alias("src"), F.concat(F.lit("K:"), F.get_json_object("payload", "$.k")).alias("dst"))
    return f.distinct()


def blob_stats(s, d):
    return G.blob_stats(G.blobs(table(s, d, "events").select(F.col("event_type").alias("strategy"), F.col("props").cast("binary").alias("body"))))


# cross-checks


def _refs(s, d, which: int):
    o = table(s, d, "orders")
    k = F.col("o_orderkey")
    if which:
        target = F.when(k % 7 != 0, F.concat(F.lit("T"), F.when(k % 5 == 0, k % 11 + 1).otherwise(k % 11)))
        o = o.where(k % 10 > 0)
    else:
        target = F.when(k % 13 != 0, F.concat(F.lit("t"), k % 11))
        o = o.where(k % 10 < 9)
    return o.select(F.lit("app").alias("owner"), F.concat(F.lit("p"), k % 50).alias("object"), k.cast("int").alias("line"), (k % 3).cast("int").alias("col"), target.alias("target"), k.alias("seq"))


def site_diff(s, d):
    return J.site_diff(_refs(s, d, 0), _refs(s, d, 1))


def site_summary(s, d):
    return J.site_summary(J.site_diff(_refs(s, d, 0), _refs(s, d, 1))).withColumn("agreement_rate", F.round("agreement_rate", 6))


def _checked(s, d):
    li = table(s, d, "lineitem")
    a = li.where("l_linenumber < 4").select(F.concat(F.lit("App.P"), F.col("l_partkey") % 200).alias("from_name"), F.concat(F.lit("app.s"), F.col("l_suppkey") % 50, F.lit(".m")).alias("to_name"), F.when(F.col("l_returnflag") == "N", "Calls").otherwise("References").alias("kind"), (F.col("l_suppkey") % 9 == 0).alias("opaque"))
    b = li.where("l_linenumber > 5").select(F.concat(F.lit("APP.p"), F.col("l_partkey") % 200).alias("from_name"), F.concat(F.lit("APP.S"), F.col("l_suppkey") % 50).alias("to_name"), F.when(F.col("l_partkey") % 5 == 0, "EXTENDED").when(F.col("l_partkey") % 2 == 0, "REF").otherwise("HARD").alias("kind"))
    return J.cross_check(a, b)


def cross_check(s, d):
    return _checked(s, d)


def cross_check_summary(s, d):
    return J.cross_check_summary(_checked(s, d))


def customer_report(s, d):
    return J.customer_report(_checked(s, d))


def dir_diff(s, d):
    o = table(s, d, "orders").withColumn("rel_path", F.concat(F.lit("src/f"), "o_orderkey"))
    k = F.col("o_orderkey")
    b = o.where(k % 10 < 9).select("rel_path", "o_orderstatus").withColumnRenamed("o_orderstatus", "content_hash")
    a = o.where(k % 10 > 0).select("rel_path", F.when(k % 4 == 0, "X").otherwise(F.col("o_orderstatus")).alias("content_hash"))
    return J.dir_diff(b, a)


def resolved_references(s, d):
    c = table(s, d, "customer")
    decls = c.select(F.col("c_custkey").alias("decl_id"), F.concat(F.lit("s"), F.col("c_nationkey") % 5).alias("schema"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("k"), F.col("c_custkey") % 7)).alias("package"), F.concat(F.lit("n"), F.col("c_custkey") % 40).alias("name"))
    k = F.col("o_orderkey")
    refs = table(s, d, "orders").select(k.alias("ref_id"), F.concat(F.lit("S"), k % 5).alias("schema"), F.concat(F.lit("K"), k % 7).alias("package"), F.when(k % 4 == 0, F.concat(F.lit("S"), k % 6)).alias("qualifier"), F.concat(F.lit("N"), k % 60).alias("name"))
    syn = table(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey") + 40).alias("name"), F.concat(F.lit("s"), F.col("n_nationkey") % 5).alias("schema"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("target"))
    return J.resolve(refs, decls, syn)


def propagated_taint(s, d):
    o = table(s, d, "orders")
    calls = o.select((F.col("o_custkey") % 20).alias("caller"), (F.col("o_orderkey") % 30).alias("callee"), (F.col("o_orderkey") % 2).alias("arg"), (F.col("o_orderkey") % 3 == 0).alias("tainted"))
    sums = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("callee"), (F.col("n_nationkey") % 2).cast("long").alias("param"), (F.col("n_regionkey") < 2).alias("returns_taint"))
    return J.propagate(calls, sums)


def bound_overloads(s, d):
    params = s.createDataFrame([("f1", 1, "a", "number", False), ("f1", 2, "b", "varchar2", True), ("f2", 1, "a", "varchar2", False), ("f3", 1, "a", "number", False), ("f3", 2, "c", "date", False)], "candidate string, position int, name string, type string, defaulted boolean")
    li = table(s, d, "lineitem")
    n = F.col("l_linenumber")
    args = li.where(n < 3).select(F.col("l_orderkey").alias("call_id"), n.cast("int").alias("position"), F.when((n == 2) & (F.col("l_orderkey") % 3 == 0), "c").alias("name"), F.when(n == 1, F.when(F.col("l_orderkey") % 2 == 0, "number").otherwise("varchar2")).alias("type"))
    return J.bind_overloads(params, args)


def rename_pairs(s, d):
    o = table(s, d, "orders")
    k = F.col("o_orderkey")
    hints = o.select(k.alias("seq"), F.when(k % 5 == 0, "explicit").when(k % 5 == 1, "persistent").otherwise("git").alias("source"), F.concat(F.lit("a"), k % 97).alias("old_id"), F.concat(F.lit("b"), k % 89).alias("new_id"), (k % 100).alias("similarity"))
    return J.rename_pairs(hints.select("old_id"), hints.select("new_id"), hints)


# catalog and privileges


def _objects(s, d):
    o = table(s, d, "orders")
    kind = F.element_at(F.array(*(F.lit(t) for t in ("TABLE", "VIEW", "PACKAGE", "JAVA CLASS"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return K.objects(o.select(F.concat(F.lit("U"), F.col("o_custkey") % 10).alias("owner"), F.concat(F.lit("O"), F.col("o_custkey")).alias("name"), kind.alias("object_type"), F.when(F.col("o_orderstatus") == "F", "valid").when(F.col("o_orderstatus") == "O", "INVALID").otherwise("N/A").alias("status"), F.col("o_orderkey").alias("seq")))


def catalog_objects(s, d):
    return _objects(s, d)


def catalog_doctor(s, d):
    return K.doctor(_objects(s, d))


def constraint_kinds(s, d):
    p = table(s, d, "part")
    letter = F.substring(F.lit("PRUCCX"), (F.col("p_partkey") % 6 + 1).cast("int"), F.lit(1))
    return K.constraint_kind(p.select(F.lit("APP").alias("owner"), F.col("p_name").alias("name"), letter.alias("letter"), F.when(F.col("p_partkey") % 6 == 3, '"A" is not null').otherwise("a > 0").alias("search_condition"), F.array(F.lit("A")).alias("columns"))).distinct()


def catalog_indexes(s, d):
    li = table(s, d, "lineitem")
    return K.indexes(li.select(F.lit("APP").alias("owner"), F.concat(F.lit("I"), "l_orderkey").alias("name"), F.col("l_linenumber").alias("position"), F.concat(F.lit("C"), F.col("l_partkey") % 9).alias("column")))


def catalog_routines(s, d):
    li = table(s, d, "lineitem")
    return K.routines(li.select(F.concat(F.lit("R"), "l_orderkey").alias("routine"), (F.col("l_linenumber") - F.when(F.col("l_orderkey") % 2 == 0, 1).otherwise(0)).alias("position"), F.concat(F.lit("T"), F.col("l_suppkey") % 9).alias("type")))


def _grants(s, d):
    o = table(s, d, "orders")
    priv = F.element_at(F.array(*(F.lit(t) for t in ("SELECT", "INSERT", "UPDATE", "EXECUTE"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    k = F.col("o_custkey")
    rows = o.select(F.concat(F.lit("U"), k % 6).alias("object_owner"), F.concat(F.lit("T"), k % 30).alias("object_name"), priv.alias("privilege"), F.when(k % 11 == 0, "public").otherwise(F.concat(F.lit("G"), k % 8)).alias("grantee"), (k % 5 == 0).alias("grantable"), (k % 3 == 0).alias("with_hierarchy"))
    users = s.createDataFrame([(f"g{i}",) for i in range(4)] + [(f"u{i}",) for i in range(6)], "user string")
    return K.grants(rows, users)


def classified_grants(s, d):
    return _grants(s, d)


def _privileges(s, d):
    return K.privileges(_grants(s, d), s.createDataFrame([("g5",), ("G6",)], "role string"))


def privilege_model(s, d):
    return _privileges(s, d)


def cross_schema_grants(s, d):
    return K.cross_schema_writes(_privileges(s, d))


def ambiguity_feed(s, d):
    return K.ambiguity_feed(_privileges(s, d))


def privilege_doctor(s, d):
    return K.privilege_doctor(_privileges(s, d))


def synonym_paths(s, d):
    n = table(s, d, "customer")
    return K.synonym_paths(n.select(F.concat(F.lit("U"), "c_nationkey").alias("owner"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 > 0, "CORE").alias("target_owner"), F.concat(F.lit("T"), F.col("c_custkey") % 10).alias("target_name")))


def accessible_by(s, d):
    n = table(s, d, "supplier")
    text = F.concat(F.lit("create package x ACCESSIBLE BY (package a"), F.col("s_suppkey") % 4, F.lit(", TRIGGER b"), F.col("s_nationkey"), F.lit(") as"))
    return K.accessible_by(n.select(F.lit("APP").alias("owner"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 5 > 0, text).otherwise("plain").alias("text")))


def authid_modes(s, d):
    n = table(s, d, "part")
    k = F.col("p_partkey")
    return K.authid(n.select(F.lit("APP").alias("owner"), F.concat(F.lit("P"), k).alias("name"), F.when(k % 3 == 0, "TABLE").otherwise("package").alias("object_type"), F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 2 == 0, "package a AUTHID  Current_User as").otherwise("package a as").alias("text")))


def plscope_availability(s, d):
    c = table(s, d, "customer")
    n = F.col("c_nationkey")
    return K.plscope_availability(c.select(F.concat(F.lit("S"), n).alias("schema"), F.when(n % 3 > 0, F.col("c_custkey") % 2).otherwise(0).alias("identifiers"), F.when(n % 3 == 1, F.col("c_custkey") % 2).otherwise(0).alias("statements")))


# changes


def name_status(s, d):
    o = table(s, d, "orders")
    k = F.col("o_orderkey")
    st = F.element_at(F.array(*(F.lit(t) for t in ("A", "D", "M", "R087", "T"))), (k % 5 + 1).cast("int"))
    ext = F.element_at(F.array(*(F.lit(t) for t in ("pks", "sql", "md"))), (k % 3 + 1).cast("int"))
    return H.classify_name_status(o.select(st.alias("status"), F.concat(F.lit("app/p"), k, F.lit("."), ext).alias("path"), F.when(k % 5 == 3, F.concat(F.lit("new/p"), k, F.lit("."), ext)).alias("path2")))


_KINDS = ("Column", "Signature", "Body", "SynonymRetargeting", "GrantOrRevoke", "TriggerChange", "IndexChange", "PackageBody", "ViewDefinitionChange")


def _changed(s, d):
    p = table(s, d, "part")
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*(F.lit(t) for t in _KINDS)), (k % len(_KINDS) + 1).cast("int"))
    oid = F.when(k % 4 == 0, F.concat(F.lit("p"), k)).when(k % 4 == 1, F.concat(F.lit("app.p"), k, F.lit(".m"))).otherwise(F.concat(F.lit("app.p"), k))
    return H.changed_objects(p.select(kind.alias("kind"), oid.alias("object_id"), F.when(k % 2 == 0, "Added").otherwise("Dropped").alias("detail")))


def changed_objects(s, d):
    return _changed(s, d)


def predicted(s, d):
    return H.predict(_changed(s, d))


def change_uncertainties(s, d):
    return H.uncertainties(_changed(s, d))


def change_doctor(s, d):
    return H.doctor(_changed(s, d))


def impact_by_type(s, d):
    return H.impact_by_type(H.predict(_changed(s, d)))


def lifecycle(s, d):
    return H.explain_lifecycle(H.predict(_changed(s, d)))


def _lineage(s, d):
    c = table(s, d, "customer")
    k = F.col("c_custkey")
    imp = c.select(F.concat(F.lit("L"), k).alias("logical_id"), (k % 3 + 1).cast("int").alias("hops"), F.when(k % 2 == 0, "High").otherwise("Low").alias("confidence"))
    meta = c.where(k % 5 > 0).select(F.concat(F.lit("L"), k).alias("logical_id"), F.lit("APP").alias("owner"), F.concat(F.lit("P"), k % 300).alias("name"), F.lit("VIEW").alias("object_type"))
    return H.predict_with_lineage(H.predict(_changed(s, d)), imp, meta)


def predicted_with_lineage(s, d):
    return _lineage(s, d)[0]


def lineage_uncertainties(s, d):
    return _lineage(s, d)[1]


def deployment_plan(s, d):
    re = table(s, d, "nation").select(F.lit("APP").alias("owner"), F.concat(F.lit("P"), F.col("n_nationkey") * 11).alias("name"), F.col("n_nationkey").alias("position"))
    return H.plan(_changed(s, d), re)


def change_risk(s, d):
    return H.risk(_changed(s, d))


def _gate(s, d):
    c = _changed(s, d)
    return H.gate(H.predict(c), H.uncertainties(c), 10, ("table", "Synonym"), "High", ("MissingCatalogObject",))


def gate_failures(s, d):
    return _gate(s, d)


def pr_comment(s, d):
    return H.pr_comment(_gate(s, d), "gate")


# ledgers and reports


def ledger_chain(s, d):
    o = table(s, d, "orders")
    return G.chain(o.select((F.col("o_custkey") % 50).alias("ledger"), F.col("o_orderkey").alias("seq"), F.concat_ws("/", "o_orderkey", "o_orderstatus").alias("body")), "ledger").select("ledger", "seq", "entry_id", "parent_entry_id")


def ledger_problems(s, d):
    o = table(s, d, "orders").select((F.col("o_custkey") % 50).alias("ledger"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("body"))
    from pyspark.sql import Window

    before = F.lag("seq", 1).over(Window.partitionBy("ledger").orderBy("seq"))
    eid = lambda c: F.sha2(F.concat(F.lit("e"), c), 256)
    e = o.select("ledger", "seq", "body", F.when(F.col("seq") % 17 == 0, "wrong").otherwise(F.coalesce(eid(before), F.lit(G.GENESIS))).alias("parent_entry_id"), eid(F.col("seq")).alias("entry_id"))
    return G.verify(e, "ledger")


def tripwire(s, d):
    o = table(s, d, "orders")
    return G.tripwire(o.select((F.col("o_custkey") % 50).alias("ledger"), F.col("o_orderkey").alias("seq"), F.round(F.col("o_totalprice"), 2).alias("value")), "ledger")


def gap_clusters(s, d):
    li = table(s, d, "lineitem")
    k = F.col("l_partkey")
    g = li.select(F.concat(F.lit("s"), k % 40).alias("signature"), F.concat(F.lit("D"), k % 3).alias("diag_code"), F.when(k % 2 == 0, "r").alias("rule_path"), F.col("l_quantity").cast("long").alias("occurrence_count"), F.concat(F.lit("c"), F.col("l_suppkey") % 90).alias("first_seen_commit"), F.concat(F.lit("f"), F.col("l_orderkey")).alias("fixture"), F.col("l_orderkey").alias("fixture_size"), (F.col("l_linenumber") == 1).alias("proven"))
    return G.clusters(g)


def accretion_index(s, d):
    o = table(s, d, "orders")
    return G.accretion_index(o.select((F.col("o_orderkey") % 9).alias("extracted"), (F.col("o_orderkey") % 4).alias("unrecognised"), F.array(F.concat(F.lit("s"), F.col("o_custkey") % 77), F.concat(F.lit("s"), F.col("o_orderkey") % 55)).alias("signatures"))).withColumn("index", F.round("index", 9))


def posture(s, d):
    k = F.col("o_orderkey")
    o = table(s, d, "orders")
    return P.posture(o.select(k.alias("run"), (k % 5).alias("files_total"), (k % 5 - k % 2).alias("files_clean"), (k % 2).alias("files_recovered"), (k % 7).alias("objects_total"), F.when(k % 7 == 0, 0).otherwise(k % 40).alias("extracted"), F.when(k % 3 == 0, k % 9).otherwise(0).alias("unrecognised"), F.when(k % 4 == 0, k % 13).otherwise(0).alias("diagnostics"))).withColumn("ratio", F.round("ratio", 6))


def symbol_doctor(s, d):
    return P.symbol_doctor(table(s, d, "orders").select((F.col("o_orderstatus") != "P").alias("resolved"), (F.col("o_orderkey") < 0).alias("chain_too_long")))


def doc_coverage(s, d):
    p = table(s, d, "part")
    return P.doc_coverage(p.select(F.col("p_brand").alias("kind"), (F.col("p_size") > 20).alias("has_comment"), (F.col("p_size") % 4).alias("n_tags")))


def undocumented_sample(s, d):
    p = table(s, d, "part")
    return P.undocumented_sample(p.select(F.concat_ws("-", "p_name", "p_partkey").alias("name"), (F.col("p_size") > 20).alias("has_comment")))


def bindings_coverage(s, d):
    t, diag = N.map_type()
    return P.bindings_coverage(_types(s, d).select(diag.alias("diagnostic")))


def _types(s, d):
    k = F.col("p_partkey")
    names = ("NUMBER", "varchar2", "DATE", "CLOB", "REF CURSOR", "TIMESTAMP", "BLOB", "SDO_GEOMETRY", "BINARY_DOUBLE", "JSON")
    return table(s, d, "part").select(k.alias("id"), F.element_at(F.array(*(F.lit(n) for n in names)), (k % 10 + 1).cast("int")).alias("type_name"), F.when(k % 20 != 0, (F.col("p_size") % 38 + 1).cast("int")).alias("precision"), F.when(k % 3 == 0, 2).alias("scale"))


def mapped_types(s, d):
    t, diag = N.map_type()
    return _types(s, d).select("id", t.alias("spark_type"), diag.alias("diagnostic"))


def memory_profile(s, d):
    return P.memory_profile(table(s, d, "supplier").select("s_name", "s_nationkey"), ["s_name", "s_nationkey"])


def routine_tables(s, d):
    li = table(s, d, "lineitem")
    return P.distinct_tables(li.select((F.col("l_orderkey") % 100).alias("routine"), F.concat(F.lit("s"), F.col("l_suppkey") % 3).alias("schema"), F.concat(F.lit("t"), F.col("l_partkey") % 8).alias("table")))


def value_sets(s, d):
    e = table(s, d, "events")
    k = F.col("event_id")
    form = F.when((F.col("user_id") % 3 == 0) & (k % 50 == 0), "Top").when((F.col("user_id") % 4 == 1) & (k % 60 == 1), "Range").when(F.col("user_id") % 5 == 0, "Bottom").when(F.col("user_id") % 7 == 1, "Bottom").otherwise("OneOf")
    return P.value_sets(e.select(F.concat(F.lit("v"), "user_id").alias("name"), form.alias("form"), F.concat(F.lit("x"), k % 4).alias("value")))


def merged_env(s, d):
    e = table(s, d, "events")
    k = F.col("event_id")
    r = e.select(F.concat(F.lit("v"), "user_id").alias("name"), k.alias("seq"), F.array("event_type").alias("kinds"), F.when(k % 2 == 0, F.array(F.lit("click"), F.lit("view"))).otherwise(F.array().cast("array<string>")).alias("cleansed"), F.when(F.col("user_id") % 3 == 0, "c").otherwise(F.concat(F.lit("c"), k % 2)).alias("constant"), F.concat(F.lit("s"), k % 10).alias("shape"))
    return P.merge_env(r)


def parse_metrics(s, d):
    return P.parse_metrics(table(s, d, "documents").select(F.col("doc_id").alias("unit"), "text"))


# functions


def _literals(s, d):
    k = F.col("event_id")
    forms = (F.concat(F.lit("pass_TOKEN="), k), F.lit(" select * from t"), F.lit("selected"), F.concat(F.lit("https://x.y/"), k), F.lit("2024-01-05 10:20:30"), F.lit("05-JAN-2024"), F.lit("-12.5e3"), F.lit("two words"), F.lit("one"), F.lit("  "), F.col("props"))
    out = None
    for i, f in enumerate(forms):
        out = F.when(k % len(forms) == i, f) if out is None else out.when(k % len(forms) == i, f)
    return table(s, d, "events").select(k.alias("id"), out.alias("value"))


def literal_classes(s, d):
    return _literals(s, d).select("id", L.classify().alias("class"))


def document_line_classes(s, d):
    lines = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    return lines.groupBy("doc_id", L.classify().alias("class")).agg(F.count("*").alias("n"))


def redaction_delta(s, d):
    return L.delta(table(s, d, "documents").select(F.col("doc_id").alias("unit"), "text"), [("the", "[A]"), ("tion", "[B]"), ("$$$", "")])


def normalised_ddl(s, d):
    t = F.concat(F.lit("CREATE   TABLE t"), F.col("o_orderkey"), F.lit(" (\n  a\tNUMBER \n)\n/\n"))
    return table(s, d, "orders").select("o_orderkey", t.alias("t")).select("o_orderkey", N.normalise_ddl("t").alias("ddl"))


def overload_names(s, d):
    p = table(s, d, "part")
    return N.overload_names(p.select(F.col("p_partkey").alias("routine_id"), F.col("p_brand").alias("name"), F.col("p_type").alias("signature")))


def suggested_names(s, d):
    w = table(s, d, "part").select(F.concat(F.substring("p_brand", 1, 6), F.lit("x")).alias("word")).distinct()
    return N.suggestions(w, table(s, d, "part").select(F.col("p_brand").alias("name")).distinct())


def escaped_labels(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(N.escape_xml(F.col("text")), 256).alias("xml"), F.sha2(N.escape_label(F.col("text")), 256).alias("label"))


def scrubbed_units(s, d):
    from .text_units import units

    return L.scrub(units(s, d))


def renamed_units(s, d):
    from .text_units import units

    return L.rename(units(s, d), "salt")


def run_ids(s, d):
    return N.run_id(table(s, d, "orders").select(F.col("o_custkey").alias("run"), F.concat(F.lit("src/f"), "o_orderkey").alias("path")), "run")


_X = "COALESCE('=' || {}, '-')"
_FACT = "'fact:' || sha256(" + " || '|' || ".join(_X.format(c) for c in ("kind", "component", "source_logical_id", "payload")) + ")"
_MINT = f"m AS (SELECT DISTINCT {_FACT} AS fact_id, kind, source_logical_id, payload FROM facts)"
_SITES = """a AS (SELECT 'APP' AS owner, 'P' || o_orderkey % 50 AS object, o_orderkey::INTEGER AS line, (o_orderkey % 3)::INTEGER AS col, CASE WHEN o_orderkey % 13 <> 0 THEN 't' || o_orderkey % 11 END AS t FROM orders WHERE o_orderkey % 10 < 9),
b AS (SELECT 'APP' AS owner, 'P' || o_orderkey % 50 AS object, o_orderkey::INTEGER AS line, (o_orderkey % 3)::INTEGER AS col, CASE WHEN o_orderkey % 7 <> 0 THEN 'T' || CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 11 + 1 ELSE o_orderkey % 11 END END AS t FROM orders WHERE o_orderkey % 10 > 0),
sd AS (SELECT coalesce(a.owner, b.owner) AS owner, coalesce(a.object, b.object) AS object, coalesce(a.line, b.line) AS line, coalesce(a.col, b.col) AS col,
CASE WHEN b.line IS NULL THEN 'our_only' WHEN a.line IS NULL THEN 'their_only' WHEN a.t IS NULL AND b.t IS NOT NULL THEN 'our_unknown_target' WHEN a.t IS NOT NULL AND b.t IS NULL THEN 'their_unknown_target' WHEN a.t IS NULL OR upper(a.t) = upper(b.t) THEN 'agreed' ELSE 'mismatched' END AS bucket, a.t AS our_target, b.t AS their_target
FROM a FULL JOIN b ON a.line = b.line AND a.object = b.object AND a.col = b.col)"""
_CHECK = """a AS (SELECT 'app.p' || l_partkey % 200 AS f, 'app.s' || l_suppkey % 50 AS t, CASE WHEN l_returnflag = 'N' THEN 'Calls' ELSE 'References' END AS k, bool_or(l_suppkey % 9 = 0) AS o FROM lineitem WHERE l_linenumber < 4 GROUP BY 1, 2, 3),
b AS (SELECT DISTINCT 'app.p' || l_partkey % 200 AS f, 'app.s' || l_suppkey % 50 AS t, CASE WHEN l_partkey % 5 = 0 THEN 'EXTENDED' WHEN l_partkey % 2 = 0 THEN 'REF' ELSE 'HARD' END AS k FROM lineitem WHERE l_linenumber > 5),
p AS (SELECT f, t, string_agg(k, ',' ORDER BY k) AS ks, bool_or(k = 'EXTENDED') AS e, bool_or(k = 'REF') AS r, bool_or(k = 'HARD') AS h FROM b GROUP BY f, t),
cc AS (SELECT f AS from_key, t AS to_key, a.k AS our_kind, ks AS catalog_kind, CASE WHEN ks IS NOT NULL AND (e OR (h AND a.k = 'Calls') OR (r AND a.k = 'References')) THEN 'match' WHEN ks IS NOT NULL THEN 'kind_mismatch' WHEN o THEN 'expected_gap' ELSE 'extra' END AS bucket FROM a LEFT JOIN p USING (f, t)
UNION ALL SELECT f, t, NULL, k, 'catalog_only' FROM b WHERE (f, t) NOT IN (SELECT (f, t) FROM a))"""
_OBJ = """oo AS (SELECT 'U' || o_custkey % 10 AS owner, 'O' || o_custkey AS name, ['TABLE', 'VIEW', 'PACKAGE', 'JAVA CLASS'][o_orderkey % 4 + 1] AS object_type, arg_max(CASE o_orderstatus WHEN 'F' THEN 'Valid' WHEN 'O' THEN 'Invalid' ELSE 'NotApplicable' END, o_orderkey) AS status FROM orders WHERE o_orderkey % 4 < 3 GROUP BY 1, 2, 3)"""
_GR = """gr AS (SELECT DISTINCT 'U' || o_custkey % 6 AS object_owner, 'T' || o_custkey % 30 AS object_name, ['SELECT', 'INSERT', 'UPDATE', 'EXECUTE'][o_orderkey % 4 + 1] AS privilege, CASE WHEN o_custkey % 11 = 0 THEN 'public' ELSE 'G' || o_custkey % 8 END AS grantee, o_custkey % 5 = 0 AS grantable, o_custkey % 3 = 0 AS with_hierarchy,
CASE WHEN o_custkey % 11 = 0 THEN 'Public' WHEN o_custkey % 8 < 4 THEN 'User' ELSE 'Role' END AS grantee_class FROM orders),
pv AS (SELECT object_owner, object_name, privilege, grantee, grantee_class, CASE WHEN grantable THEN 'Grantable' WHEN with_hierarchy THEN 'Hierarchy' ELSE 'None' END AS option, CASE WHEN grantee_class <> 'Role' OR grantee IN ('G5', 'G6') THEN 'High' ELSE 'Low' END AS confidence, CASE WHEN grantee_class = 'Role' AND grantee NOT IN ('G5', 'G6') THEN 'RuntimeGrantOrRole' END AS ambiguity FROM gr)"""
_CH = """ch AS (SELECT CASE WHEN p_partkey % 4 > 0 THEN 'APP' END AS owner, 'P' || p_partkey AS name, p_partkey AS k, CASE p_partkey % 9 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'TableAdditiveDdl' ELSE 'TableDestructiveDdl' END WHEN 1 THEN CASE WHEN p_partkey % 4 = 1 THEN 'PackageSpec' ELSE 'StandaloneRoutineSignature' END WHEN 2 THEN 'Unclassified' WHEN 3 THEN 'SynonymRetargeting' WHEN 4 THEN 'GrantOrRevoke' WHEN 5 THEN 'TriggerChange' WHEN 6 THEN 'IndexChange' WHEN 7 THEN 'PackageBody' ELSE 'ViewDefinitionChange' END AS kind,
CASE WHEN p_partkey % 4 = 0 OR p_partkey % 9 = 2 THEN 'MissingCatalogObject' END AS uncertainty FROM part),
rl(kind, object_type, reason, category) AS (VALUES ('PackageSpec', 'PACKAGE', 'PackageSpecChanged', 'Interface'), ('StandaloneRoutineSignature', 'ROUTINE', 'RoutineSignatureChanged', 'Interface'), ('TableAdditiveDdl', 'TABLE', 'TableAdditive', 'Data'), ('TableDestructiveDdl', 'TABLE', 'TableDestructive', 'Data'), ('SynonymRetargeting', 'SYNONYM', 'SynonymRetargeted', 'Naming'), ('GrantOrRevoke', 'PRIVILEGE', 'PrivilegeChange', 'Security'), ('ViewDefinitionChange', 'VIEW', 'Other', 'Other'), ('TriggerChange', 'TRIGGER', 'Other', 'Other')),
pr AS (SELECT owner, name, object_type, reason, 'Medium' AS confidence, 1 AS distance, category FROM ch JOIN rl USING (kind)),
un AS (SELECT DISTINCT owner, name, k, x AS reason FROM (SELECT *, uncertainty AS x FROM ch UNION ALL SELECT *, CASE kind WHEN 'PackageBody' THEN 'ConditionalCompilationBranch' WHEN 'IndexChange' THEN 'MissingCatalogObject' WHEN 'Unclassified' THEN 'MissingCatalogObject' END FROM ch) WHERE x IS NOT NULL)"""
_LIN = """im AS (SELECT c_custkey AS k, (c_custkey % 3 + 1)::INTEGER AS hops, CASE WHEN c_custkey % 2 = 0 THEN 'High' ELSE 'Low' END AS confidence, CASE WHEN c_custkey % 5 > 0 THEN 'P' || c_custkey % 300 END AS name FROM customer),
fr AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY hops, confidence = 'Low', 'L' || k) AS r FROM im WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM pr WHERE owner = 'APP'))"""
_TY = "ty AS (SELECT p_partkey AS id, ['NUMBER', 'VARCHAR2', 'DATE', 'CLOB', 'REF CURSOR', 'TIMESTAMP', 'BLOB', 'SDO_GEOMETRY', 'BINARY_DOUBLE', 'JSON'][p_partkey % 10 + 1] AS n, CASE WHEN p_partkey % 20 <> 0 THEN p_size % 38 + 1 END AS p, CASE WHEN p_partkey % 3 = 0 THEN 2 END AS s FROM part), dg AS (SELECT *, CASE WHEN n = 'NUMBER' AND p IS NULL THEN 'UnboundedNumber' WHEN n = 'REF CURSOR' THEN 'RefCursorUnsupported' WHEN n = 'TIMESTAMP' THEN 'NanosecondsLost' WHEN n = 'SDO_GEOMETRY' THEN 'UnknownType' END AS diagnostic FROM ty)"""
_LIT = "li AS (SELECT event_id AS id, trim(CASE event_id % 11 WHEN 0 THEN 'pass_TOKEN=' || event_id WHEN 1 THEN ' select * from t' WHEN 2 THEN 'selected' WHEN 3 THEN 'https://x.y/' || event_id WHEN 4 THEN '2024-01-05 10:20:30' WHEN 5 THEN '05-JAN-2024' WHEN 6 THEN '-12.5e3' WHEN 7 THEN 'two words' WHEN 8 THEN 'one' WHEN 9 THEN '  ' ELSE props END) AS t FROM events)"
SQL = {
    "minted_facts": with_ctes("facts", f"WITH {_MINT} SELECT fact_id, kind, source_logical_id FROM m"),
    "facts_of_kind": with_ctes("facts", f"WITH {_MINT} SELECT fact_id, payload FROM m WHERE kind = 'error'"),
    "fact_kinds": with_ctes("facts", f"WITH {_MINT} SELECT kind, count(*) AS n FROM m GROUP BY kind"),
    "appended_facts": with_ctes("facts", f"WITH {_MINT} SELECT fact_id, kind FROM m WHERE kind = 'error'"),
    "fact_edges": with_ctes("facts", "SELECT DISTINCT upper(trim(source_logical_id)) AS src, 'K:' || json_extract_string(payload, '$.k') AS dst FROM facts WHERE kind = 'click'"),
    "blob_stats": "SELECT count(*) AS entries, sum(strlen(props))::BIGINT AS bytes FROM (SELECT DISTINCT event_type, props FROM events)",
    "site_diff": f"WITH {_SITES} SELECT * FROM sd",
    "site_summary": f"""WITH {_SITES} SELECT count(*) FILTER (WHERE bucket = 'agreed') AS agreed, count(*) FILTER (WHERE bucket = 'mismatched') AS mismatched, count(*) FILTER (WHERE bucket = 'our_unknown_target') AS our_unknown_target, count(*) FILTER (WHERE bucket = 'their_unknown_target') AS their_unknown_target, count(*) FILTER (WHERE bucket = 'our_only') AS our_only, count(*) FILTER (WHERE bucket = 'their_only') AS their_only,
round(count(*) FILTER (WHERE bucket = 'agreed') / count(*) FILTER (WHERE bucket NOT LIKE '%only')::DOUBLE, 6) AS agreement_rate FROM sd""",
    "cross_check": f"WITH {_CHECK} SELECT * FROM cc",
    "customer_report": f"""WITH {_CHECK}, g AS (SELECT CASE bucket WHEN 'match' THEN 'Confirmed' WHEN 'extra' THEN 'Only in source' WHEN 'catalog_only' THEN 'Only in dictionary' WHEN 'kind_mismatch' THEN 'Differs' WHEN 'expected_gap' THEN 'Expected gap' END AS bucket, count(*) AS n FROM cc GROUP BY 1)
SELECT bucket, n, round(100.0::DOUBLE * n / sum(n) OVER (), 2) AS share FROM g""",
    "cross_check_summary": f"WITH {_CHECK} SELECT bucket, count(*) AS n FROM cc GROUP BY bucket",
    "dir_diff": "SELECT 'src/f' || o_orderkey AS rel_path, CASE WHEN o_orderkey % 10 = 9 THEN 'Created' WHEN o_orderkey % 10 = 0 THEN 'Dropped' ELSE 'Body' END AS change FROM orders WHERE o_orderkey % 10 IN (0, 9) OR o_orderkey % 4 = 0",
    "resolved_references": """WITH dc AS (SELECT c_custkey AS id, 'S' || c_nationkey % 5 AS s, CASE WHEN c_custkey % 3 = 0 THEN 'K' || c_custkey % 7 END AS p, 'N' || c_custkey % 40 AS n FROM customer), sy AS (SELECT 'N' || n_nationkey + 40 AS n, 'S' || n_nationkey % 5 AS s, 'N' || n_nationkey AS t FROM nation),
rf AS (SELECT o_orderkey AS id, 'S' || o_orderkey % 5 AS s, 'K' || o_orderkey % 7 AS p, CASE WHEN o_orderkey % 4 = 0 THEN 'S' || o_orderkey % 6 END AS q, 'N' || o_orderkey % 60 AS n FROM orders),
f AS (SELECT rf.id, dc.id AS d, 'qualified' AS how, 1 AS o FROM rf JOIN dc ON dc.s = q AND dc.n = rf.n UNION ALL SELECT rf.id, dc.id, 'package', 2 FROM rf JOIN dc ON dc.s = rf.s AND dc.p = rf.p AND dc.n = rf.n WHERE q IS NULL UNION ALL SELECT rf.id, dc.id, 'schema', 3 FROM rf JOIN dc ON dc.s = rf.s AND dc.p IS NULL AND dc.n = rf.n WHERE q IS NULL
UNION ALL SELECT rf.id, dc.id, 'synonym', 4 FROM rf JOIN sy ON sy.n = rf.n JOIN dc ON dc.s = sy.s AND dc.n = sy.t WHERE q IS NULL), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o, d) AS r FROM f)
SELECT rf.id AS ref_id, b.d AS decl_id, coalesce(b.how, CASE WHEN q IS NOT NULL THEN 'missing_in_schema' ELSE 'not_found' END) AS how FROM rf LEFT JOIN b ON b.id = rf.id AND b.r = 1""",
    "propagated_taint": """WITH c AS (SELECT o_custkey % 20 AS caller, o_orderkey % 30 AS callee, o_orderkey % 2 AS arg, o_orderkey % 3 = 0 AS tainted FROM orders)
SELECT caller, callee, arg, CASE WHEN caller = callee THEN 'RecursionCycle' WHEN n_nationkey IS NULL THEN 'MissingCalleeSummary' WHEN tainted AND n_regionkey < 2 THEN 'Tainted' ELSE 'Clean' END AS outcome FROM c LEFT JOIN nation ON n_nationkey = callee AND n_nationkey % 2 = arg""",
    "bound_overloads": """WITH a AS (SELECT l_orderkey AS c, max(CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END) AS two, bool_or(l_linenumber = 1) AS one FROM lineitem WHERE l_linenumber < 3 GROUP BY 1)
SELECT c AS call_id, CASE WHEN NOT one THEN 'NoMatch' WHEN c % 2 = 0 AND two = 0 THEN 'Resolved' WHEN c % 2 = 0 AND c % 3 = 0 THEN 'Resolved' WHEN c % 2 = 0 THEN 'Ambiguous' WHEN two = 0 THEN 'Resolved' ELSE 'NoMatch' END AS outcome,
CASE WHEN NOT one THEN NULL WHEN c % 2 = 0 AND two = 0 THEN 'f1' WHEN c % 2 = 0 AND c % 3 = 0 THEN 'f3' WHEN c % 2 = 1 AND two = 0 THEN 'f2' END AS candidate FROM a""",
    "catalog_objects": f"WITH {_OBJ} SELECT * FROM oo",
    "catalog_doctor": f"WITH {_OBJ} SELECT object_type, count(*) AS total, count(*) FILTER (WHERE status = 'Valid') AS valid, count(*) FILTER (WHERE status = 'Invalid') AS invalid, count(*) FILTER (WHERE status = 'NotApplicable') AS other FROM oo GROUP BY object_type",
    "constraint_kinds": "SELECT DISTINCT 'APP' AS owner, p_name AS name, ['PrimaryKey', 'ForeignKey', 'Unique', 'NotNull', 'Check', 'Other'][p_partkey % 6 + 1] AS kind FROM part",
    "catalog_indexes": "SELECT 'APP' AS owner, 'I' || l_orderkey AS name, string_agg('C' || l_partkey % 9, ',' ORDER BY l_linenumber, 'C' || l_partkey % 9) AS columns FROM lineitem GROUP BY l_orderkey",
    "catalog_routines": """WITH a AS (SELECT l_orderkey AS r, l_linenumber - CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 0 END AS p, 'T' || l_suppkey % 9 AS t FROM lineitem)
SELECT 'R' || r AS routine, CASE WHEN max(CASE WHEN p = 0 THEN t END) IS NOT NULL THEN 'Function' ELSE 'Procedure' END AS kind, coalesce(string_agg(CASE WHEN p > 0 THEN t END, ',' ORDER BY p, t), '') AS arguments, max(CASE WHEN p = 0 THEN t END) AS return_type FROM a GROUP BY r""",
    "classified_grants": f"WITH {_GR} SELECT * FROM gr",
    "privilege_model": f"WITH {_GR} SELECT * FROM pv",
    "cross_schema_grants": f"WITH {_GR} SELECT grantee, object_owner, object_name, privilege, confidence FROM pv WHERE privilege IN ('INSERT', 'UPDATE') AND grantee_class = 'User'",
    "ambiguity_feed": f"WITH {_GR} SELECT 1 AS part, grantee, object_owner || '.' || object_name AS object, privilege, ambiguity, 'Low' AS ceiling FROM pv WHERE ambiguity IS NOT NULL UNION ALL SELECT 2, grantee, object_owner || '.' || object_name, privilege, ambiguity, 'Low' FROM pv WHERE ambiguity IS NOT NULL AND privilege IN ('INSERT', 'UPDATE')",
    "privilege_doctor": f"WITH {_GR} SELECT count(*) AS grants, count(*) FILTER (WHERE confidence = 'High') AS high, count(ambiguity) AS ambiguous, count(DISTINCT object_owner) AS schemas, CASE WHEN count(*) = 0 THEN 'Unknown' WHEN count(ambiguity) = 0 THEN 'Clean' WHEN count(ambiguity) * 2 <= count(*) THEN 'Caution' ELSE 'Unknown' END AS posture FROM pv",
    "synonym_paths": "SELECT 'U' || c_nationkey AS owner, c_name AS name, CASE WHEN c_custkey % 3 > 0 THEN 'CORE' ELSE 'U' || c_nationkey END || '.T' || c_custkey % 10 AS target, 'Medium' AS confidence FROM customer",
    "accessible_by": "SELECT 'APP' AS owner, s_name AS name, 'a' || s_suppkey % 4 AS caller FROM supplier WHERE s_suppkey % 5 > 0 UNION SELECT 'APP', s_name, 'b' || s_nationkey FROM supplier WHERE s_suppkey % 5 > 0",
    "authid_modes": "SELECT 'APP' AS owner, 'P' || p_partkey AS name, CASE WHEN p_partkey % 3 = 0 THEN 'Definer' WHEN p_partkey % 5 = 0 THEN 'Unknown' WHEN p_partkey % 2 = 0 THEN 'Invoker' ELSE 'Definer' END AS authid FROM part",
    "plscope_availability": "SELECT 'S' || c_nationkey AS schema, CASE WHEN c_nationkey % 3 = 1 AND sum(c_custkey % 2) > 0 THEN 'IdentifiersAndStatements' WHEN c_nationkey % 3 > 0 AND sum(c_custkey % 2) > 0 THEN 'IdentifiersOnly' ELSE 'Stale' END AS availability FROM customer GROUP BY c_nationkey",
    "name_status": """WITH f AS (SELECT o_orderkey AS k, ['pks', 'sql', 'md'][o_orderkey % 3 + 1] AS x FROM orders WHERE o_orderkey % 3 < 2), r AS (SELECT CASE k % 5 WHEN 0 THEN 'Created' WHEN 1 THEN 'Dropped' WHEN 3 THEN 'Dropped' ELSE 'Body' END AS change, 'app/p' || k || '.' || x AS path, 'app.p' || k AS object_id FROM f UNION ALL SELECT 'Created', 'new/p' || k || '.' || x, 'new.p' || k FROM f WHERE k % 5 = 3) SELECT * FROM r""",
    "changed_objects": f"WITH {_CH} SELECT owner, name, kind, uncertainty FROM ch",
    "predicted": f"WITH {_CH} SELECT owner, name, object_type, reason, confidence, distance FROM pr",
    "change_uncertainties": f"WITH {_CH} SELECT owner, name, reason FROM un",
    "change_doctor": f"WITH {_CH} SELECT 'kind' AS report, kind AS item, count(*) AS n FROM ch GROUP BY kind UNION ALL SELECT 'uncertainty', reason, count(*) FROM un GROUP BY reason",
    "impact_by_type": f"WITH {_CH} SELECT object_type, count(*) AS n FROM pr GROUP BY object_type",
    "lifecycle": f"WITH {_CH} SELECT owner, name, reason, category, reason IN ('TableDestructive', 'PackageSpecChanged') AS warning FROM pr",
    "predicted_with_lineage": f"WITH {_CH}, {_LIN} SELECT owner, name, object_type, reason, confidence, distance FROM pr UNION ALL SELECT 'APP', name, 'VIEW', 'Transitive', confidence, hops FROM fr WHERE r = 1",
    "lineage_uncertainties": f"WITH {_CH}, {_LIN} SELECT 'L' || k AS logical_id, 'MissingCatalogObject' AS reason FROM im WHERE name IS NULL",
    "deployment_plan": f"""WITH {_CH}, c AS (SELECT owner, name, CASE kind WHEN 'TableAdditiveDdl' THEN 2 WHEN 'TableDestructiveDdl' THEN 2 WHEN 'ViewDefinitionChange' THEN 3 WHEN 'PackageSpec' THEN 4 WHEN 'PackageBody' THEN 5 WHEN 'StandaloneRoutineSignature' THEN 6 WHEN 'TriggerChange' THEN 7 WHEN 'SynonymRetargeting' THEN 8 WHEN 'IndexChange' THEN 9 WHEN 'GrantOrRevoke' THEN 10 WHEN 'Unclassified' THEN 13 ELSE 12 END AS w, 'Ddl' AS step FROM ch),
x AS (SELECT * FROM c UNION ALL SELECT 'APP', 'P' || n_nationkey * 11, n_nationkey + 100, 'Recompile' FROM nation WHERE ('P' || n_nationkey * 11) NOT IN (SELECT name FROM c WHERE owner = 'APP'))
SELECT row_number() OVER (ORDER BY w, owner NULLS FIRST, name, step) AS ordinal, step, owner, name FROM x""",
    "change_risk": "SELECT 'High' AS risk",
    "gate_failures": f"""WITH {_CH} SELECT 'InvalidationsExceeded' AS failure, '10' AS subject, count(*) AS observed FROM pr HAVING count(*) > 10 UNION ALL SELECT 'BlockedKindHit', object_type, count(*) FROM pr WHERE object_type IN ('TABLE', 'SYNONYM') GROUP BY object_type
UNION ALL SELECT 'ConfidenceBelowFloor', 'High', count(*) FROM pr UNION ALL SELECT 'BlockingUnknownReasonHit', reason, count(*) FROM un WHERE reason = 'MissingCatalogObject' GROUP BY reason""",
    "ledger_chain": f"""WITH RECURSIVE e AS (SELECT o_custkey % 50 AS ledger, o_orderkey AS seq, o_orderkey || '/' || o_orderstatus AS body, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS i FROM orders),
w(ledger, i, seq, parent_entry_id, entry_id) AS (SELECT ledger, i, seq, '{G.GENESIS}', sha256('{G.GENESIS}' || body) FROM e WHERE i = 1
UNION ALL SELECT e.ledger, e.i, e.seq, w.entry_id, sha256(w.entry_id || e.body) FROM w JOIN e ON e.ledger = w.ledger AND e.i = w.i + 1)
SELECT ledger, seq, entry_id, parent_entry_id FROM w""",
    "ledger_problems": "SELECT o_custkey % 50 AS ledger, o_orderkey AS seq, CASE WHEN o_orderkey % 17 = 0 THEN 'ParentMismatch' ELSE 'IdMismatch' END AS problem FROM orders",
    "tripwire": """WITH v AS (SELECT o_custkey % 50 AS ledger, o_orderkey AS seq, round(o_totalprice, 2) AS value FROM orders), w AS (SELECT *, max(value) OVER (PARTITION BY ledger ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM v) SELECT * FROM w WHERE value < best""",
    "gap_clusters": """WITH g AS (SELECT 's' || l_partkey % 40 AS signature, 'D' || l_partkey % 3 AS dc, CASE WHEN l_partkey % 2 = 0 THEN 'r' END AS rp, l_quantity::BIGINT AS n, 'c' || l_suppkey % 90 AS cm, l_orderkey AS f, l_linenumber = 1 AS ok FROM lineitem),
x AS (SELECT signature, list_slice(list_sort(list(DISTINCT f)), 1, 3) AS l FROM g WHERE ok GROUP BY signature)
SELECT g.signature, sum(n)::BIGINT AS occurrences, min(dc) AS diag_code, min(rp) AS rule_path, min(cm) AS first_seen_commit, coalesce(array_to_string(list_transform(any_value(l), lambda y: 'f' || y), ','), '') AS fixtures FROM g LEFT JOIN x ON x.signature = g.signature GROUP BY g.signature""",
    "accretion_index": """SELECT round(sum(o_orderkey % 9) / (sum(o_orderkey % 9) + sum(o_orderkey % 4))::DOUBLE, 9) AS "index", (SELECT count(DISTINCT s) FROM (SELECT 's' || o_custkey % 77 AS s FROM orders UNION ALL SELECT 's' || o_orderkey % 55 FROM orders)) AS signatures FROM orders""",
    "posture": """WITH r AS (SELECT o_orderkey AS run, o_orderkey % 5 AS ft, o_orderkey % 5 - o_orderkey % 2 AS fc, o_orderkey % 2 AS fr, o_orderkey % 7 AS ob, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey % 40 END AS e, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 9 ELSE 0 END AS u, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 13 ELSE 0 END AS dg FROM orders),
q AS (SELECT *, CASE WHEN e + u = 0 THEN CASE WHEN dg = 0 THEN 1.0 ELSE 0.0 END ELSE e / (e + u)::DOUBLE END AS ratio FROM r)
SELECT run, round(ratio::DOUBLE, 6) AS ratio, CASE WHEN e + u = 0 AND ob = 0 THEN CASE WHEN ft = 0 OR dg = 0 THEN 'Clean' ELSE 'Degraded' END WHEN ratio < 0.1 THEN 'Degraded' WHEN u > 0 OR ratio < 0.85 OR (greatest(e + u, ob) > 0 AND dg * 2 >= greatest(e + u, ob)) THEN 'LowConfidence' WHEN fr > 0 OR dg > 0 OR fc < ft THEN 'Partial' ELSE 'Clean' END AS posture FROM q""",
    "symbol_doctor": """WITH r AS (SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus <> 'P') AS resolved FROM orders) SELECT total, resolved, total - resolved AS unresolved, resolved * 100 // total AS percent, CASE WHEN resolved * 100 // total >= 95 THEN 'Clean' WHEN resolved * 100 // total >= 50 THEN 'Caution' ELSE 'Unknown' END AS posture FROM r""",
    "doc_coverage": "SELECT p_brand AS kind, count(*) AS total, count(*) FILTER (WHERE p_size > 20) AS documented, count(*) FILTER (WHERE p_size % 4 > 0) AS tagged, count(*) FILTER (WHERE p_size <= 20) AS undocumented, count(*) FILTER (WHERE p_size > 20) * 100 // count(*) AS percent FROM part GROUP BY p_brand",
    "undocumented_sample": "SELECT p_name || '-' || p_partkey AS name FROM part WHERE p_size <= 20 ORDER BY 1 LIMIT 100",
    "bindings_coverage": f"WITH {_TY} SELECT coalesce(diagnostic, 'Bound') AS diagnostic, count(*) AS n FROM dg GROUP BY 1",
    "mapped_types": f"""WITH {_TY} SELECT id, CASE n WHEN 'NUMBER' THEN CASE WHEN coalesce(s, 0) = 0 AND p <= 18 THEN 'BIGINT' ELSE 'DECIMAL(' || coalesce(p, 38) || ',' || coalesce(s, 0) || ')' END WHEN 'VARCHAR2' THEN 'STRING' WHEN 'CLOB' THEN 'STRING' WHEN 'DATE' THEN 'TIMESTAMP_NTZ' WHEN 'TIMESTAMP' THEN 'TIMESTAMP_NTZ' WHEN 'BLOB' THEN 'BINARY' WHEN 'BINARY_DOUBLE' THEN 'DOUBLE' WHEN 'JSON' THEN 'VARIANT' END AS spark_type, diagnostic FROM dg""",
    "memory_profile": """SELECT 's_name' AS part, sum(strlen(s_name) + 13)::BIGINT AS bytes FROM supplier UNION ALL SELECT 's_nationkey', sum(strlen(s_nationkey::VARCHAR) + 16)::BIGINT FROM supplier""",
    "routine_tables": """SELECT DISTINCT l_orderkey % 100 AS routine, 'S' || l_suppkey % 3 AS schema, 'T' || l_partkey % 8 AS "table" FROM lineitem""",
    "value_sets": """WITH f AS (SELECT 'v' || user_id AS name, CASE WHEN user_id % 3 = 0 AND event_id % 50 = 0 THEN 'Top' WHEN user_id % 4 = 1 AND event_id % 60 = 1 THEN 'Range' WHEN user_id % 5 = 0 OR user_id % 7 = 1 THEN 'Bottom' ELSE 'OneOf' END AS form, 'x' || event_id % 4 AS value FROM events),
g AS (SELECT name, bool_or(form = 'Top') AS top, count(*) FILTER (WHERE form = 'Range') AS r, count(*) FILTER (WHERE form = 'OneOf') AS o, string_agg(DISTINCT value, ',' ORDER BY value) FILTER (WHERE form = 'OneOf') AS v, max(value) FILTER (WHERE form = 'Range') AS rv FROM f GROUP BY name),
h AS (SELECT *, CASE WHEN top OR r > 1 OR (r = 1 AND o > 0) THEN 'Top' WHEN r = 1 THEN 'Range' WHEN o > 0 THEN 'OneOf' ELSE 'Bottom' END AS form FROM g) SELECT name, form, CASE form WHEN 'OneOf' THEN v WHEN 'Range' THEN rv END AS value FROM h""",
    "merged_env": """SELECT 'v' || user_id AS name, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, CASE WHEN bool_or(event_id % 2 = 0) THEN 'click,view' ELSE '' END AS cleansed, CASE WHEN user_id % 3 = 0 THEN 'c' WHEN count(DISTINCT event_id % 2) = 1 THEN 'c' || min(event_id % 2) END AS constant, 's' || max(event_id) % 10 AS shape,
count(*) FILTER (WHERE event_type NOT IN ('click', 'view')) > 0 OR NOT bool_or(event_id % 2 = 0) AS alarm FROM events GROUP BY user_id""",
    "parse_metrics": "SELECT doc_id AS unit, len(string_split(text, chr(10)))::BIGINT AS lines, len(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_$#]*)', 1))::BIGINT AS words, len(regexp_extract_all(text, '(--[^\\n]*)', 1))::BIGINT AS comments, strlen(text)::BIGINT AS bytes FROM documents",
    "literal_classes": f"WITH {_LIT} SELECT id, {L.CLASSIFY_SQL} AS class FROM li",
    "document_line_classes": f"WITH li AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS t FROM documents) SELECT doc_id, {L.CLASSIFY_SQL} AS class, count(*) AS n FROM li GROUP BY ALL",
    "redaction_delta": """WITH a AS (SELECT doc_id, text, regexp_replace(text, 'the', '[A]', 'gi') AS t1 FROM documents), b AS (SELECT *, regexp_replace(t1, 'tion', '[B]', 'gi') AS t2 FROM a), c AS (SELECT *, replace(t2, '$$$', '') AS t3 FROM b)
SELECT doc_id AS unit, sha256(text) AS before, sha256(t3) AS after, strlen(text)::BIGINT AS bytes_before, strlen(t3)::BIGINT AS bytes_after, (regexp_matches(text, '(?i)the')::INTEGER + regexp_matches(t1, '(?i)tion')::INTEGER + contains(t2, '$$$')::INTEGER)::BIGINT AS rules_hit FROM c""",
    "normalised_ddl": "SELECT o_orderkey, 'CREATE TABLE t' || o_orderkey || ' (' || chr(10) || 'a NUMBER' || chr(10) || ')' AS ddl FROM orders",
    "overload_names": """SELECT p_partkey AS routine_id, CASE WHEN count(*) OVER (PARTITION BY lower(p_brand)) = 1 THEN lower(p_brand) ELSE lower(p_brand) || '_' || row_number() OVER (PARTITION BY lower(p_brand) ORDER BY p_type, p_partkey) END AS name FROM part""",
    "suggested_names": """WITH w AS (SELECT DISTINCT substring(p_brand, 1, 6) || 'x' AS word FROM part), k AS (SELECT DISTINCT p_brand AS name FROM part), j AS (SELECT word, name, levenshtein(lower(word), lower(name)) AS d FROM w JOIN k ON lower(word[1]) = lower(name[1]) AND abs(length(word) - length(name)) <= 2)
SELECT word, name AS suggestion FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY d, name) AS r FROM j WHERE d <= 2) WHERE r = 1""",
    "escaped_labels": """SELECT doc_id, sha256(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) AS xml, sha256(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n')) AS label FROM documents""",
}
QUERIES = [minted_facts, facts_of_kind, fact_kinds, appended_facts, fact_edges, blob_stats, site_diff, site_summary, cross_check, cross_check_summary, customer_report, dir_diff, resolved_references, propagated_taint, bound_overloads, rename_pairs, catalog_objects, catalog_doctor, constraint_kinds, catalog_indexes, catalog_routines, classified_grants, privilege_model, cross_schema_grants, ambiguity_feed, privilege_doctor, synonym_paths, accessible_by, authid_modes, plscope_availability, name_status, changed_objects, predicted, change_uncertainties, change_doctor, impact_by_type, lifecycle, predicted_with_lineage, lineage_uncertainties, deployment_plan, change_risk, gate_failures, pr_comment, ledger_chain, ledger_problems, tripwire, gap_clusters, accretion_index, posture, symbol_doctor, doc_coverage, undocumented_sample, bindings_coverage, mapped_types, memory_profile, routine_tables, value_sets, merged_env, parse_metrics, literal_classes, document_line_classes, redaction_delta, normalised_ddl, overload_names, suggested_names, escaped_labels, scrubbed_units, renamed_units, run_ids]
