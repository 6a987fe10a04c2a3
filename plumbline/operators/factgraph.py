"""Dependencies and impact straight from facts, and saved graphs.

A fact of kind dependency_edge says that one object depends on another: payload from_logical_id,
to_logical_id, edge_kind. Objects are named by their logical ids, trimmed and in upper case; an edge
is one by source, target and kind. Facts are exact, so impact is a plain walk with hops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import cut
from ..schemas import EDGE, NODE, key
from .ledger import minted
from .traverse import dependencies, reach

PAYLOAD = "from_logical_id string, to_logical_id string, edge_kind string"


def use_facts(uses: DataFrame, component: str = "sql") -> DataFrame:
    """Minted dependency_edge facts of uses (owner, target, edge_kind), each use once before it is written out."""
    uses = uses.select("owner", "target", "edge_kind").distinct()
    payload = F.to_json(F.struct(F.col("owner").alias("from_logical_id"), F.col("target").alias("to_logical_id"), "edge_kind"))
    return minted(uses.select(F.lit("dependency_edge").alias("kind"), F.lit(component).alias("component"), F.col("owner").alias("source_logical_id"), payload.alias("payload")))


def edges(facts: DataFrame) -> DataFrame:
    """(src, dst, kind) of all dependency facts, once each; those without either end are none."""
    p = facts.where("kind = 'dependency_edge'").select(F.from_json("payload", PAYLOAD).alias("p")).select("p.*")
    e = p.select(key("from_logical_id").alias("src"), key("to_logical_id").alias("dst"), F.col("edge_kind").alias("kind"))
    return e.where("src <> '' and dst <> ''").distinct()


def _start(facts: DataFrame, anchors: list[str]) -> DataFrame:
    spark = facts.sparkSession
    return spark.createDataFrame([(a,) for a in anchors], "node_id string").select(key("node_id").alias("node_id"))


def dependencies_from_facts(facts: DataFrame, anchors: list[str], max_depth: int | None = None) -> DataFrame:
    """Every edge out of what the anchors depend on, within so many steps."""
    return dependencies(cut(edges(facts)), _start(facts, anchors), max_depth)


def impact_from_facts(facts: DataFrame, anchors: list[str], max_depth: int | None = None) -> DataFrame:
    """(node_id, tier, hops) of all that depend on the anchors; every fact's edge is exact."""
    found = reach(cut(edges(facts)), _start(facts, anchors), False, max_depth).where("hops > 0")
    return found.select("node_id", F.lit("Exact").alias("tier"), "hops")


def graph(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts as a graph's nodes and edges. Ids are hashes of names, so that any run gives the same ones."""
    e = cut(edges(facts))
    node_id = lambda c: F.xxhash64(c)
    names = e.select(F.col("src").alias("logical_id")).union(e.select(F.col("dst").alias("logical_id"))).distinct()
    nodes = names.select(node_id("logical_id").alias("node_id"), "logical_id", F.lit(None).cast("string").alias("persistent_id"), F.lit("Fact").alias("identity_kind"))
    out = e.select(F.xxhash64("src", "dst", "kind").alias("edge_id"), node_id("src").alias("src"), node_id("dst").alias("dst"), "kind", F.lit("High").alias("conf_level"), *(F.lit(None).cast("string").alias(c) for c in ("conf_explanation", "prov", "evidence")))
    return nodes, out


def save(nodes: DataFrame, edges_: DataFrame, uri: str) -> None:
    """A graph as JSON lines: nodes and edges each in a folder, ordered by id."""
    nodes.orderBy("node_id").write.mode("overwrite").json(f"{uri}/nodes")
    edges_.orderBy("edge_id").write.mode("overwrite").json(f"{uri}/edges")


def load(spark: SparkSession, uri: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a saved graph. Rows that aren't of the form are an error, and so are edges without both nodes."""
    nodes, found = (spark.read.schema(s).option("mode", "FAILFAST").json(f"{uri}/{n}") for n, s in (("nodes", NODE), ("edges", EDGE)))
    ends = found.select(F.explode(F.array("src", "dst")).alias("node_id"))
    lost = ends.join(nodes.select("node_id"), "node_id", "left_anti").take(1)
    if lost:
        raise ValueError(f"edge of an unknown node: {lost[0]['node_id']}")
    return nodes, found


def load_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph saved as one JSON document with the arrays nodes and edges."""
    doc = spark.read.schema(f"nodes array<struct<{NODE.replace(' ', ': ').replace(',: ', ', ')}>>, edges array<struct<{EDGE.replace(' ', ': ').replace(',: ', ', ')}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return doc.select(F.inline("nodes")), doc.select(F.inline("edges"))


def sorted_edges(edges_: DataFrame) -> DataFrame:
    return edges_.orderBy("edge_id")


def sorted_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("node_id")


def sorted_impact(affected: DataFrame) -> DataFrame:
    """Affected nodes (logical_id, tier, hops): the surest first, of these the nearest, then by name."""
    rank = F.when(F.col("tier") == "Exact", 0).when(F.col("tier") == "Heuristic", 1).otherwise(2)
    return affected.orderBy(rank, "hops", "logical_id")


def induced(edges_: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (node_id)."""
    ids = nodes.select("node_id").distinct()
    e = edges_.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi")
    return e.join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
