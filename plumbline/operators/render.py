"""Outputs: versioned envelopes, redaction, exports, and small texts for people.

Rows are rendered where they are: pages are frames of lines with their order. Only the page of one package is
joined to a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import ranked
from ..functions.names import escape_xml


def envelope(schema_id: str, version: str, payload: Column) -> Column:
    """A payload with the id and version of its schema, in JSON; nulls of the payload are left out."""
    return F.to_json(F.struct(F.lit("robot-json").alias("format"), F.lit(schema_id).alias("schema_id"), F.lit(version).alias("schema_version"), payload.alias("payload")))


def redact(df: DataFrame, drop: tuple = (), replace: tuple = ()) -> DataFrame:
    """Columns taken out, and such whose values become [REDACTED] (nulls stay null)."""
    df = df.drop(*drop)
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.lit("[REDACTED]")) for c in replace if c in df.columns})


def redact_attributes(attributes: str, hidden: tuple) -> Column:
    """A map column with the values of hidden keys replaced."""
    return F.transform_values(attributes, lambda k, v: F.when(k.isin(*hidden), F.lit("[REDACTED]")).otherwise(v))


def export_snapshot(rows: DataFrame, uri: str, version: str = "1.0.0") -> None:
    """Catalog rows as JSON lines, each with the schema's version."""
    rows.withColumn("schema_version", F.lit(version)).write.mode("overwrite").json(uri)


def _page(lines: DataFrame, head: str, foot: str) -> DataFrame:
    """(part, ordinal, line): a page by lines, to be written in this order; its length is no one task's matter."""
    spark = lines.sparkSession
    ends = spark.createDataFrame([(0, "", head), (2, "", foot)], "part int, ordinal string, line string").where("line <> ''")
    return lines.select(F.lit(1).alias("part"), "ordinal", "line").unionByName(ends)


def page_text(page: DataFrame) -> DataFrame:
    """(text) of a page that is known to be small."""
    return page.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "ordinal", "line"))), lambda x: x["line"]), "\n").alias("text"))


def impact_html(affected: DataFrame, title: str) -> DataFrame:
    """A page with the affected nodes (logical_id, tier, hops), surest and nearest first."""
    rank = F.when(F.col("tier") == "Exact", "0").when(F.col("tier") == "Heuristic", "1").otherwise("2")
    line = F.concat(F.lit("<tr><td>"), escape_xml(F.col("logical_id")), F.lit("</td><td>"), "tier", F.lit("</td><td>"), "hops", F.lit("</td></tr>"))
    ordinal = F.concat_ws("|", rank, F.lpad(F.col("hops").cast("string"), 10, "0"), "logical_id")
    return _page(affected.select(ordinal.alias("ordinal"), line.alias("line")), f"<html><body><h1>{title}</h1><table>", "</table></body></html>")


def orphans_markdown(found: DataFrame) -> DataFrame:
    """A table of orphans (logical_id, tier) by tier and name."""
    line = F.concat(F.lit("| "), F.replace("logical_id", F.lit("|"), F.lit("\\|")), F.lit(" | "), "tier", F.lit(" |"))
    return _page(found.select(F.concat_ws("|", "tier", "logical_id").alias("ordinal"), line.alias("line")), "| object | tier |\n|-|-|", "")


def orphans_html(found: DataFrame) -> DataFrame:
    """The same as a page."""
    line = F.concat(F.lit("<tr><td>"), escape_xml(F.col("logical_id")), F.lit("</td><td>"), "tier", F.lit("</td></tr>"))
    return _page(found.select(F.concat_ws("|", "tier", "logical_id").alias("ordinal"), line.alias("line")), "<html><body><h1>Orphans</h1><table>", "</table></body></html>")


def impact_graphml(affected: DataFrame, edges: DataFrame) -> DataFrame:
    """The affected nodes (node_id, logical_id, tier, hops) and the edges (edge_id, src, dst, kind) among them, as GraphML by lines."""
    n = affected.select(
        F.concat(F.lit("n"), F.lpad(F.col("node_id").cast("string"), 20, "0")).alias("ordinal"),
        F.concat(F.lit('<node id="n'), "node_id", F.lit('"><data key="name">'), escape_xml(F.col("logical_id")), F.lit('</data><data key="tier">'), "tier", F.lit('</data><data key="hops">'), "hops", F.lit("</data></node>")).alias("line"),
    )
    ids = affected.select("node_id")
    own = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    e = own.select(
        F.concat(F.lit("o"), F.lpad(F.col("edge_id").cast("string"), 20, "0")).alias("ordinal"),
        F.concat(F.lit('<edge source="n'), "src", F.lit('" target="n'), "dst", F.lit('"><data key="kind">'), "kind", F.lit("</data></edge>")).alias("line"),
    )
    return _page(n.unionByName(e), '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">', "</graph></graphml>")


def package_docs(declarations: DataFrame, tags: DataFrame) -> DataFrame:
    """(unit, text): a Markdown page for each unit of its declarations (unit, line, kind, name) and tags (unit, tag, value)."""
    d = declarations.groupBy("unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "kind", "name"))), lambda x: F.concat(F.lit("- "), F.lower(x["kind"]), F.lit(" `"), x["name"], F.lit("`"))), "\n").alias("d"))
    t = tags.groupBy("unit").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- *"), "tag", F.lit("* "), "value"))), "\n").alias("t"))
    return d.join(t, "unit", "left").select("unit", F.concat(F.lit("# "), "unit", F.lit("\n\n"), "d", F.coalesce(F.concat(F.lit("\n\n## Tags\n\n"), "t"), F.lit(""))).alias("text"))


def call_graph_svg(edges: DataFrame, width: int = 800) -> DataFrame:
    """A drawing by lines: nodes of edges (src_logical_id, dst_logical_id) in one column each, with lines between them."""
    a = ranked(edges.select(F.col("src_logical_id").alias("n")).distinct(), "y", "n")
    b = ranked(edges.select(F.col("dst_logical_id").alias("n")).distinct(), "y", "n")
    a, b = (x.select("n", (F.col("y") * 20).alias("y")) for x in (a, b))
    text = lambda x: F.concat(F.lit(f'<text x="{x}" y="'), "y", F.lit('">'), escape_xml(F.col("n")), F.lit("</text>"))
    lines = a.select(F.concat(F.lit("1|"), "n").alias("ordinal"), text(10).alias("line")).unionByName(b.select(F.concat(F.lit("2|"), "n").alias("ordinal"), text(width // 2).alias("line")))
    e = edges.select("src_logical_id", "dst_logical_id").distinct().join(a.toDF("src_logical_id", "y1"), "src_logical_id").join(b.toDF("dst_logical_id", "y2"), "dst_logical_id")
    drawn = F.concat(F.lit(f'<line x1="{width // 4}" y1="'), "y1", F.lit(f'" x2="{width // 2 - 10}" y2="'), "y2", F.lit('" stroke="black"/>'))
    lines = lines.unionByName(e.select(F.concat(F.lit("3|"), F.concat_ws(">", "src_logical_id", "dst_logical_id")).alias("ordinal"), drawn.alias("line")))
    return _page(lines, f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}">', "</svg>")


def bindings(routines: DataFrame) -> DataFrame:
    """(package, routine, overload, line): a typed wrapper's signature for each routine (package, routine,
    overload, args: array of (name, mode, type), return_type); OUT arguments are returned behind the result."""
    py = lambda t: F.when(F.upper(t).rlike("^(NUMBER|INTEGER|PLS_INTEGER|BINARY_INTEGER)"), "Decimal").when(F.upper(t).rlike("CHAR|CLOB"), "str").when(F.upper(t).rlike("^(DATE|TIMESTAMP)"), "datetime").when(F.upper(t).rlike("^(RAW|BLOB)"), "bytes").when(F.upper(t) == "BOOLEAN", "bool").otherwise("object")
    ins = F.transform(F.filter("args", lambda a: F.upper(a["mode"]) != "OUT"), lambda a: F.concat(F.lower(a["name"]), F.lit(": "), py(a["type"]), F.lit(" | None")))
    outs = F.transform(F.filter("args", lambda a: F.upper(a["mode"]) != "IN"), lambda a: py(a["type"]))
    back = F.concat(F.when(F.col("return_type").isNotNull(), F.array(py(F.col("return_type")))).otherwise(F.array().cast("array<string>")), outs)
    result = F.when(F.size(back) == 0, "None").when(F.size(back) == 1, F.element_at(back, 1)).otherwise(F.concat(F.lit("tuple["), F.array_join(back, ", "), F.lit("]")))
    name = F.concat_ws("_", F.lower("routine"), F.col("overload").cast("string"))
    line = F.concat(F.lit("def "), name, F.lit("("), F.array_join(F.concat(F.array(F.lit("connection")), ins), ", "), F.lit(") -> "), result, F.lit(": ..."))
    return routines.select("package", "routine", "overload", line.alias("line"))
