"""Comparisons and look-ups between frames: cross-checks, differences, resolution by priority."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import key

_SITE = ["owner", "object", "line", "col"]


def _first_by_site(refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the first reference of each site, others that differ from it). Equal repeats collapse."""
    r = refs.withColumns({"owner": key("owner"), "object": key("object")}).groupBy(*_SITE, "target").agg(F.min("seq").alias("seq"))
    n = F.row_number().over(Window.partitionBy(*_SITE).orderBy("seq"))
    r = r.withColumn("n", n)
    return r.where("n = 1").drop("n", "seq"), r.where("n > 1").drop("n", "seq")


def site_diff(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(owner, object, line, col, bucket, our_target, their_target) of two lists of references (owner,
    object, line, col, target, seq), matched by site. A second, different reference of a site stays alone."""
    a, a2 = _first_by_site(ours)
    b, b2 = _first_by_site(theirs)
    a = a.withColumnRenamed("target", "our_target").withColumn("x", F.lit(1))
    b = b.withColumnRenamed("target", "their_target").withColumn("y", F.lit(1))
    o, t = F.col("our_target"), F.col("their_target")
    bucket = (
        F.when(F.col("y").isNull(), "our_only")
        .when(F.col("x").isNull(), "their_only")
        .when(o.isNull() & t.isNotNull(), "our_unknown_target")
        .when(o.isNotNull() & t.isNull(), "their_unknown_target")
        .when(o.isNull() | (key("our_target") == key("their_target")), "agreed")
        .otherwise("mismatched")
    )
    out = a.join(b, _SITE, "full_outer").withColumn("bucket", bucket).select(*_SITE, "bucket", "our_target", "their_target")
    none = F.lit(None).cast("string")
    out = out.unionByName(a2.select(*_SITE, F.lit("our_only").alias("bucket"), F.col("target").alias("our_target"), none.alias("their_target")))
    return out.unionByName(b2.select(*_SITE, F.lit("their_only").alias("bucket"), none.alias("our_target"), F.col("target").alias("their_target")))


def site_summary(diff: DataFrame) -> DataFrame:
    """Counts by bucket and the rate of agreement among sites that both have (null if none)."""
    b = ("agreed", "mismatched", "our_unknown_target", "their_unknown_target", "our_only", "their_only")
    r = diff.agg(*(F.count_if(F.col("bucket") == x).alias(x) for x in b))
    return r.withColumn("agreement_rate", F.try_divide(F.col("agreed"), F.col("agreed") + F.col("mismatched") + F.col("our_unknown_target") + F.col("their_unknown_target")))


#: Which dictionary kinds an edge kind may correspond to; every edge kind fits these two.
_HARD = ("Calls", "Reads", "Writes", "ReadsColumn", "WritesColumn", "DependsOnType", "DependsOn")
_REF = ("References", "Constrains")


def kinds_fit(ours, theirs):
    return theirs.isin("EXTENDED", "OTHER") | ((theirs == "HARD") & ours.isin(*_HARD)) | ((theirs == "REF") & ours.isin(*_REF))


def cross_check(edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """(from_key, to_key, our_kind, catalog_kind, bucket) of engine edges (from_name, to_name, kind,
    opaque) against dictionary dependencies (from_name, to_name, kind), matched by lower-case names
    of two parts; each kind of a pair is judged alone."""

    def two(c: str):
        return F.lower(F.substring_index(c, ".", 2))

    a = edges.select(two("from_name").alias("f"), two("to_name").alias("t"), F.col("kind").alias("our_kind"), "opaque").groupBy("f", "t", "our_kind").agg(F.bool_or("opaque").alias("opaque"))
    b = catalog.select(two("from_name").alias("f"), two("to_name").alias("t"), F.col("kind").alias("catalog_kind")).distinct()
    pair = b.groupBy("f", "t").agg(F.sort_array(F.collect_set("catalog_kind")).alias("theirs"))  # four kinds at most
    left = a.join(pair, ["f", "t"], "left")
    fits = F.exists("theirs", lambda k: kinds_fit(F.col("our_kind"), k))
    bucket = F.when(F.col("theirs").isNotNull() & fits, "match").when(F.col("theirs").isNotNull(), "kind_mismatch").when(F.col("opaque"), "expected_gap").otherwise("extra")
    ours = left.select(F.col("f").alias("from_key"), F.col("t").alias("to_key"), "our_kind", F.array_join("theirs", ",").alias("catalog_kind"), bucket.alias("bucket"))
    alone = b.join(a.select("f", "t").distinct(), ["f", "t"], "left_anti").select(F.col("f").alias("from_key"), F.col("t").alias("to_key"), F.lit(None).cast("string").alias("our_kind"), "catalog_kind", F.lit("catalog_only").alias("bucket"))
    return ours.unionByName(alone)


def dir_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(rel_path, change): files (rel_path, content_hash) that came, went or differ."""
    j = before.withColumnRenamed("content_hash", "b").join(after.withColumnRenamed("content_hash", "a"), "rel_path", "full_outer")
    return j.select("rel_path", F.when(F.col("b").isNull(), "Created").when(F.col("a").isNull(), "Dropped").when(F.col("a") != F.col("b"), "Body").alias("change")).where("change is not null")


def baseline(findings: DataFrame, accepted: DataFrame, column: str = "fingerprint") -> DataFrame:
    """(fingerprint, status): new, suppressed, or fixed (accepted once, no longer found)."""
    f, a = findings.select(column).distinct(), accepted.select(column).distinct()
    both = f.join(a.withColumn("k", F.lit(True)), column, "left").select(column, F.when(F.col("k"), "suppressed").otherwise("new").alias("status"))
    return both.unionByName(a.join(f, column, "left_anti").select(column, F.lit("fixed").alias("status")))


def resolve(refs: DataFrame, decls: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(ref_id, decl_id, how): the declaration (decl_id, schema, package, name) of a reference (ref_id,
    schema, package, qualifier, name): a qualified name in its schema; else in its own package, then
    its own schema, then by a synonym (name, schema, target). Unresolved ones stay, with a reason."""
    d = decls.select(F.struct("decl_id").alias("d"), F.upper("schema").alias("ds"), F.upper("package").alias("dp"), F.upper("name").alias("dn"))
    s = synonyms.select(F.upper("name").alias("name"), F.upper("schema").alias("ds"), F.upper("target").alias("dn"))
    # only the smallest declaration of a name can be taken, so each join is with one row a name
    least = lambda df, *on: df.groupBy(*on).agg(F.min("d").alias("d"))
    named = least(d, "ds", "dn")
    qualified = named.toDF("qualifier", "name", "d1")
    package = least(d.where("dp is not null"), "ds", "dp", "dn").toDF("schema", "package", "name", "d2")
    schema = least(d.where("dp is null"), "ds", "dn").toDF("schema", "name", "d3")
    synonym = least(s.join(named, ["ds", "dn"]), "name").toDF("name", "d4")
    r = refs.select("ref_id", *(F.upper(c).alias(c) for c in ("schema", "package", "qualifier", "name")))
    r = r.join(qualified, ["qualifier", "name"], "left").join(package, ["schema", "package", "name"], "left").join(schema, ["schema", "name"], "left").join(synonym, "name", "left")
    far = F.col("qualifier").isNotNull()
    best = F.when(far, F.col("d1")).otherwise(F.coalesce("d2", "d3", "d4"))
    how = F.when(far, F.when(F.col("d1").isNotNull(), "qualified").otherwise("missing_in_schema")).when(F.col("d2").isNotNull(), "package").when(F.col("d3").isNotNull(), "schema").when(F.col("d4").isNotNull(), "synonym").otherwise("not_found")
    return r.select("ref_id", best["decl_id"].alias("decl_id"), how.alias("how"))


def propagate(calls: DataFrame, summaries: DataFrame) -> DataFrame:
    """One hop of taint between routines: calls (caller, callee, arg, tainted) with summaries (callee,
    param, returns_taint). A call of itself is a recursion, one without a summary an unknown."""
    s = summaries.select(F.col("callee").alias("c"), F.col("param").alias("p"), "returns_taint")
    j = calls.join(s, (F.col("callee") == F.col("c")) & (F.col("arg") == F.col("p")), "left")
    outcome = F.when(F.col("caller") == F.col("callee"), "RecursionCycle").when(F.col("c").isNull(), "MissingCalleeSummary").when(F.col("tainted") & F.col("returns_taint"), "Tainted").otherwise("Clean")
    return j.select("caller", "callee", "arg", outcome.alias("outcome"))


def bind_overloads(params: DataFrame, args: DataFrame) -> DataFrame:
    """(call_id, outcome, candidate): which candidate (candidate, position, name, type, defaulted) a
    call's arguments (call_id, position, name, type) bind to. Arguments go by name, else by position;
    types that are unknown fit any; parameters left over need defaults."""
    cands = params.groupBy("candidate").agg(F.count_if(~F.col("defaulted")).alias("needed"))
    p = params.select("candidate", F.col("position").alias("pp"), F.upper("name").alias("pn"), F.upper("type").alias("pt"), "defaulted")
    a = args.withColumns({"name": F.upper("name"), "type": F.upper("type")})
    on = F.when(F.col("name").isNotNull(), F.col("name") == F.col("pn")).otherwise(F.col("position") == F.col("pp"))
    fits = F.col("type").isNull() | F.col("pt").isNull() | (F.col("type") == F.col("pt"))
    met = a.join(p, on).where(fits).groupBy("call_id", "candidate").agg(F.count_distinct("position").alias("bound"), F.count_distinct("pp").alias("params"), F.count_distinct(F.when(~F.col("defaulted"), F.col("pp"))).alias("got"))
    size = a.groupBy("call_id").agg(F.count_distinct("position").alias("n"))
    good = met.join(size, "call_id").join(cands, "candidate").where("bound = n and params = n and got = needed")
    by = good.groupBy("call_id").agg(F.count("*").alias("k"), F.min("candidate").alias("c"))
    out = size.join(by, "call_id", "left")
    return out.select("call_id", F.when(F.col("k") == 1, "Resolved").when(F.col("k") > 1, "Ambiguous").otherwise("NoMatch").alias("outcome"), F.when(F.col("k") == 1, F.col("c")).alias("candidate"))


def rename_pairs(dropped: DataFrame, created: DataFrame, hints: DataFrame) -> DataFrame:
    """(old_id, new_id, source): drops and creations that are one object renamed, by hints (seq, source,
    old_id, new_id, similarity): explicit ones before persistent ids before similarities of 70 or more;
    each end is used once, the earlier hint first. A hint is taken when no better one wants its ends;
    rounds go on until none is left."""
    from ..frames import cut

    rank = F.when(F.col("source") == "explicit", 1).when(F.col("source") == "persistent", 2).otherwise(3)
    h = hints.where("source <> 'git' or similarity >= 70").select("old_id", "new_id", "source", F.struct(rank.alias("r"), "seq").alias("o"))
    h = cut(h.join(dropped.select("old_id").distinct(), "old_id", "left_semi").join(created.select("new_id").distinct(), "new_id", "left_semi"))
    done = None
    while h.take(1):
        a = h.groupBy("old_id").agg(F.min("o").alias("oa"))
        b = h.groupBy("new_id").agg(F.min("o").alias("ob"))
        got = cut(h.join(a, "old_id").join(b, "new_id").where("o = oa and o = ob").select("old_id", "new_id", "source"))
        done = got if done is None else done.unionByName(got)
        h = cut(h.join(got.select("old_id"), "old_id", "left_anti").join(got.select("new_id"), "new_id", "left_anti"))
    return done if done is not None else h.select("old_id", "new_id", "source")


ANCHOR = r"^\s*(?:\"?([A-Za-z0-9_$#]+)\"?\s*\.\s*)?(?:\"?([A-Za-z0-9_$#]+)\"?\s*\.\s*)?\"?([A-Za-z0-9_$#]+)\"?\s*%\s*(TYPE|ROWTYPE)\s*$"


def anchors(wanted: DataFrame, declared: DataFrame, catalog: DataFrame) -> DataFrame:
    """(anchor, kind, type, origin) of anchored types: a column's type (%TYPE) or a row's columns in
    order (%ROWTYPE), from declarations in the source first, from the catalog else. declared and
    catalog: (owner, object, column, position, type_name), owner may be null; a variable is an object without a column.
    An anchor of another form is Unsupported, one that nothing declares Unresolved."""
    up = F.upper(F.trim("anchor"))
    part = lambda i: F.nullif(F.regexp_extract(up, ANCHOR, i), F.lit(""))
    w = wanted.select("anchor").distinct().select("anchor", part(1).alias("p1"), part(2).alias("p2"), part(3).alias("p3"), part(4).alias("form"))
    row = F.col("form") == "ROWTYPE"
    w = w.withColumns({"column": F.when(~row & F.coalesce("p1", "p2").isNotNull(), F.col("p3")), "object": F.when(row | F.coalesce("p1", "p2").isNull(), F.col("p3")).otherwise(F.coalesce("p2", "p1")), "schema": F.when(row, F.coalesce("p1", "p2")).when(F.col("p1").isNotNull() & F.col("p2").isNotNull(), F.col("p1"))})
    w = w.withColumn("form", F.when(row & F.col("p1").isNotNull() & F.col("p2").isNotNull(), None).otherwise(F.col("form")))
    both = declared.withColumn("rank", F.lit(0)).unionByName(catalog.withColumn("rank", F.lit(1)))
    d = both.select(F.upper("owner").alias("d_owner"), F.upper("object").alias("object"), F.upper("column").alias("d_column"), "position", "type_name", "rank")
    on = (w["object"] == d["object"]) & (w["schema"].isNull() | d["d_owner"].isNull() | (w["schema"] == d["d_owner"])) & F.when(w["form"] == "ROWTYPE", d["d_column"].isNotNull()).otherwise(d["d_column"].eqNullSafe(w["column"]))
    j = w.join(d, on, "left").groupBy("anchor", "form", "rank").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("position", "d_column", "type_name"))), lambda x: F.when(x["d_column"].isNull() | (F.col("form") == "TYPE"), x["type_name"]).otherwise(F.concat_ws(" ", x["d_column"], x["type_name"]))), ", ").alias("type"))
    best = j.groupBy("anchor", "form").agg(F.min_by("type", F.coalesce("rank", F.lit(9))).alias("type"), F.min("rank").alias("rank"))
    kind = F.when(F.col("form").isNull(), "Unsupported").when(F.col("rank").isNull(), "Unresolved").when(F.col("form") == "ROWTYPE", "Row").otherwise("Column")
    origin = F.when(F.col("form").isNull(), None).when(F.col("rank") == 0, "source").when(F.col("rank") == 1, "catalog")
    return best.select("anchor", kind.alias("kind"), F.when(origin.isNotNull(), F.col("type")).alias("type"), origin.alias("origin"))


def taint_of(flows: DataFrame, returns: DataFrame) -> DataFrame:
    """(unit, name, kinds, cleansed, tainted) of names: kinds of taint that reach a name in its unit (flows:
    unit, name, kinds, cleansed as lists) or that a called routine's return brings to it (returns: unit, name, kinds).
    A name is tainted while it has a kind and nothing has cleansed it."""
    a = flows.select("unit", "name", "kinds", "cleansed").unionByName(returns.select("unit", "name", "kinds", F.array().cast("array<string>").alias("cleansed")))
    g = a.groupBy("unit", "name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("k"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("cleansed")))).alias("c"))
    return g.select("unit", "name", F.array_join("k", ",").alias("kinds"), F.array_join("c", ",").alias("cleansed"), ((F.size("k") > 0) & (F.size("c") == 0)).alias("tainted"))


def customer_report(checked: DataFrame) -> DataFrame:
    """(bucket, n, share): a cross-check's buckets by the names that readers of a report know, with their
    share of all rows in percent, to two places."""
    names = {"match": "Confirmed", "extra": "Only in source", "catalog_only": "Only in dictionary", "kind_mismatch": "Differs", "expected_gap": "Expected gap"}
    b = checked.select(F.coalesce(*(F.when(F.lower("bucket") == k, v) for k, v in names.items()), F.col("bucket")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    total = b.agg(F.sum("n").alias("t"))
    return b.crossJoin(F.broadcast(total)).select("bucket", "n", F.round(F.lit(100.0) * F.col("n") / F.col("t"), 2).alias("share"))  # one row


def cross_check_summary(checked: DataFrame) -> DataFrame:
    """(bucket, n) of a cross-check."""
    return checked.groupBy("bucket").agg(F.count("*").alias("n"))
