"""One-hop queries and reports over nodes (node_id, logical_id, persistent_id, identity_kind) and
edges (edge_id, src, dst, kind, conf_level, prov, evidence); src depends on dst."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import TIERS, choose, conf_rank, tier

READS = ("ReadsColumn", "ReadsUnknownColumnOfTable")
WRITES = ("WritesColumn", "WritesUnknownColumnOfTable", "DerivesColumn")


def resolve_node(nodes: DataFrame, logical_id: str) -> DataFrame:
    """The node of that logical id; of several the smallest."""
    return nodes.where(F.upper(F.trim("logical_id")) == logical_id.strip().upper()).groupBy().agg(F.min("node_id").alias("node_id")).where("node_id is not null")


def summaries(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the logical ids of their ends."""
    n = nodes.select("node_id", "logical_id", "identity_kind")
    a = n.toDF("src", "src_logical_id", "src_kind")
    b = n.toDF("dst", "dst_logical_id", "dst_kind")
    return edges.select("edge_id", "src", "dst", "kind", "conf_level").join(a, "src", "left").join(b, "dst", "left")


def neighbours(edges: DataFrame, nodes: DataFrame, node_id: int, reverse: bool = False) -> DataFrame:
    return summaries(edges.where(F.col("dst" if reverse else "src") == node_id), nodes)


def callers(edges: DataFrame, nodes: DataFrame, node_id: int) -> DataFrame:
    e = edges.where((F.col("dst") == node_id) & (F.col("kind") == "Calls"))
    return e.join(nodes.withColumnRenamed("node_id", "src"), "src").select("src", "logical_id", "identity_kind").distinct()


def column_access(edges: DataFrame, node_id: int, write: bool) -> DataFrame:
    """Who reads or writes a column; is_unknown: the column is only one of its table's."""
    e = edges.where((F.col("dst") == node_id) & F.col("kind").isin(*(WRITES if write else READS)))
    return e.select("src", "kind", F.col("kind").contains("Unknown").alias("is_unknown")).distinct()


def violations(edges: DataFrame) -> DataFrame:
    """Edges that break the graph's rules: each needs provenance, one that isn't High evidence."""
    a = edges.where("prov is null").select("edge_id", F.lit("MissingProvenance").alias("violation"))
    b = edges.where("conf_level <> 'High' and evidence is null").select("edge_id", F.lit("MissingEvidence").alias("violation"))
    return a.unionByName(b)


def orphans(edges: DataFrame, nodes: DataFrame, incomplete: bool = False) -> DataFrame:
    """Nodes that nothing refers to: without own references surely unused, else likely."""
    # a row an end, put together before it is sent: of most edges the target is one of few
    end = lambda c, out: F.struct(F.col(c).alias("node_id"), F.lit(out).alias("o"), F.lit(not out).alias("i"))
    ends = edges.where("src <> dst").select(F.inline(F.array(end("src", True), end("dst", False)))).groupBy("node_id").agg(F.bool_or("o").alias("o"), F.bool_or("i").alias("i"))
    free = nodes.select("node_id", "logical_id").join(ends, "node_id", "left").where("i is null or not i")
    t = F.lit("Inconclusive") if incomplete else F.when(F.col("o"), "LikelyUnused").otherwise("HighConfidenceUnused")
    return free.select("node_id", "logical_id", t.alias("tier"))


def orphan_doctor(found: DataFrame, window_days: int, audited: bool) -> DataFrame:
    """Counts by tier and whether unused objects may be dropped: none inconclusive, thirty days seen, audit on."""
    c = {"high_confidence": "HighConfidenceUnused", "likely": "LikelyUnused", "inconclusive": "Inconclusive"}
    r = found.agg(*(F.count_if(F.col("tier") == v).alias(k) for k, v in c.items()))
    return r.withColumn("window_sufficient", F.lit(window_days >= 30)).withColumn("safe_to_drop", (F.col("inconclusive") == 0) & F.lit(window_days >= 30 and audited))


def graph_doctor(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row of counts."""
    e = edges.agg(
        F.count("*").alias("edges"),
        F.count_if(conf_rank() <= 1).alias("low_confidence_edges"),
        F.count_if((F.col("kind") == "OpaqueDynamic") | (F.col("conf_level") == "Opaque")).alias("opaque_edges"),
        F.count_if(F.col("prov").isNull()).alias("missing_provenance"),
        F.count_if((F.col("conf_level") != "High") & F.col("evidence").isNull()).alias("missing_evidence"),
    )
    n = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("persistent_id").isNull()).alias("null_persistent_ids"))
    return n.crossJoin(e)  # one row by one


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def lineage_doctor(edges: DataFrame) -> DataFrame:
    """Edges by tier, with ratios (0 of none)."""
    r = edges.select(tier().alias("t")).agg(F.count("*").alias("total"), *(F.count_if(F.col("t") == k).alias(v.lower()) for k, v in TIERS.items()))
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("total")), F.lit(0.0))
    return r.withColumns({"exact_ratio": share("exact"), "unknown_ratio": share("unknown")})


def unknown_reasons(edges: DataFrame) -> DataFrame:
    """Why edges are of unknown confidence; without evidence for opacity."""
    return edges.where(tier() == 0).groupBy(F.coalesce("evidence", F.lit("Opaque")).alias("reason")).agg(F.count("*").alias("n"))


def explain_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends, tier, provenance and evidence in words."""
    why = F.coalesce("evidence", "prov", F.lit("no provenance recorded"))
    s = summaries(edges, nodes).join(edges.select("edge_id", why.alias("because")), "edge_id")
    return s.select("edge_id", "src_logical_id", "dst_logical_id", "kind", choose(tier(), TIERS).alias("tier"), "because")


def explain_node(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of each node, how many edges go out and come in, and the worst confidence among them."""
    both = edges.select(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i"), tier().alias("t")).unionByName(edges.select(F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i"), tier().alias("t")))
    by = both.groupBy("node_id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"), F.min("t").alias("worst"))
    zero = F.lit(0).cast("long")
    return nodes.select("node_id", "logical_id").join(by, "node_id", "left").select("node_id", "logical_id", F.coalesce("n_out", zero).alias("n_out"), F.coalesce("n_in", zero).alias("n_in"), "worst")


def explain_path(path: DataFrame, edges: DataFrame) -> DataFrame:
    """Of a path (step, edge_id): its length, tier (the worst edge's) and its blockers, in order."""
    p = path.where("edge_id is not null").join(edges.select("edge_id", tier().alias("t"), F.coalesce("evidence", "conf_level").alias("why")), "edge_id")
    bad = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("t") < 2, F.struct("step", "why")))), lambda x: x["why"]))
    return p.agg(F.count("*").alias("length"), choose(F.min("t"), TIERS).alias("tier"), bad.alias("blockers"))


def trigger_edges(triggers: DataFrame) -> DataFrame:
    """TriggersOn edges of dictionary rows (owner, name, target_owner, target_name)."""
    return triggers.where("target_name is not null").select(F.concat_ws(".", "owner", "name").alias("src"), F.concat_ws(".", F.coalesce("target_owner", "owner"), "target_name").alias("dst"), F.lit("TriggersOn").alias("kind"), F.lit("High").alias("conf_level"))


def constraint_edges(constraints: DataFrame) -> DataFrame:
    """Constrains edges: to the table, and for a foreign key also to the table it names."""
    c = constraints.withColumn("src", F.concat_ws(".", "owner", "name"))
    own = c.select("src", F.concat_ws(".", "table_owner", "table_name").alias("dst"))
    far = c.where("ref_table is not null").select("src", F.concat_ws(".", F.coalesce("ref_owner", "table_owner"), "ref_table").alias("dst"))
    return own.unionByName(far).distinct().select("src", "dst", F.lit("Constrains").alias("kind"), F.lit("High").alias("conf_level"))


def db_link_edges(uses: DataFrame) -> DataFrame:
    """Opaque edges for texts object@link, with the link as their evidence."""
    o, k = F.regexp_extract("raw", r"^\s*([A-Za-z0-9_$#.]+)@([A-Za-z0-9_$#.]+)\s*$", 1), F.regexp_extract("raw", r"^\s*([A-Za-z0-9_$#.]+)@([A-Za-z0-9_$#.]+)\s*$", 2)
    e = uses.select("src", F.upper(o).alias("object"), F.upper(k).alias("db_link")).where("object <> ''").distinct()
    return e.select("src", F.concat_ws("@", "object", "db_link").alias("dst"), F.lit("DependsOn").alias("kind"), F.lit("Opaque").alias("conf_level"), F.concat(F.lit("db link "), "db_link").alias("evidence"), "object", "db_link")


def ends_of_calls(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """Call edges (caller, callee_text): by the whole dotted name, else by its first part."""
    n = nodes.groupBy(F.upper("logical_id").alias("k")).agg(F.min("node_id").alias("node_id"))
    c = calls.withColumns({"full": F.upper("callee"), "head": F.upper(F.substring_index("callee", ".", 1))})
    a, b = n.toDF("full", "a"), n.toDF("head", "b")
    j = c.join(a, "full", "left").join(b, "head", "left")
    return j.where("a is not null or b is not null").select("caller", "callee", F.coalesce("a", "b").alias("dst"), F.when(F.col("a").isNotNull(), "exact").otherwise("package").alias("strategy"))


def with_missing_targets(access: DataFrame, nodes: DataFrame) -> DataFrame:
    """(logical_id, minted) of the targets of accesses that are no node yet, for which unknown nodes are made."""
    t = access.select(F.upper("target").alias("logical_id")).distinct()
    return t.join(nodes.select(F.upper("logical_id").alias("logical_id")), "logical_id", "left_anti").withColumn("identity_kind", F.lit("Unknown"))


def graphml(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lines of a GraphML text, in order: (part, id, line)."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    n = nodes.select(F.lit(1).alias("part"), F.col("node_id").alias("id"), F.concat(F.lit('<node id="n'), "node_id", F.lit('"><data key="label">'), esc("logical_id"), F.lit("</data></node>")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.col("edge_id").alias("id"), F.concat(F.lit('<edge id="e'), "edge_id", F.lit('" source="n'), "src", F.lit('" target="n'), "dst", F.lit('"><data key="kind">'), esc("kind"), F.lit("</data></edge>")).alias("line"))
    return n.unionByName(e)


def dot(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lines of a DOT text: (part, id, line)."""
    esc = F.replace(F.replace(F.col("logical_id"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    n = nodes.select(F.lit(1).alias("part"), F.col("node_id").alias("id"), F.concat(F.lit("  n"), "node_id", F.lit(' [label="'), esc, F.lit('"];')).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.col("edge_id").alias("id"), F.concat(F.lit("  n"), "src", F.lit(" -> n"), "dst", F.lit(' [label="'), "kind", F.lit('"];')).alias("line"))
    return n.unionByName(e)
