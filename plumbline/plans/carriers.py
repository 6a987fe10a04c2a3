"""The estate model's frames, made from the TPC-H-like tables by plain arithmetic, in Spark and in SQL.

Nodes: key * 8 + kind (region 0, nation 1, customer 2, supplier 3, order 4, part 5). Edges go from
the dependent to what it depends on. CTES has the same frames in DuckDB's SQL; with_ctes puts those
that a query needs before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import choose
from .tables import table

KINDS = (("region", "r_regionkey", "R"), ("nation", "n_nationkey", "N"), ("customer", "c_custkey", "C"), ("supplier", "s_suppkey", "S"), ("orders", "o_orderkey", "O"), ("part", "p_partkey", "P"))
_RANK = {"N": 3, "R": 2, "A": 1}


def nodes(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for i, (t, k, p) in enumerate(KINDS):
        c = F.col(k).cast("long")
        part = table(spark, d, t).select((c * 8 + i).alias("node_id"), F.concat(F.lit(p + ":"), c).alias("logical_id"), F.when(c % 7 != 0, F.concat(F.lit("p"), c)).alias("persistent_id"), F.lit(t).alias("identity_kind"))
        out = part if out is None else out.unionByName(part)
    return out


def edges(spark: SparkSession, d: str) -> DataFrame:
    def rel(t: str, a: str, i: int, b: str, j: int, kind: str, level):
        return table(spark, d, t).select((F.col(a).cast("long") * 8 + i).alias("src"), (F.col(b).cast("long") * 8 + j).alias("dst"), F.lit(kind).alias("kind"), level.alias("conf_level"))

    high = F.lit("High")
    parts = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max(choose("l_returnflag", _RANK, 1)).alias("m"))
    level = choose("m", {3: "High", 2: "Medium"}, "Low")
    out = rel("nation", "n_nationkey", 1, "n_regionkey", 0, "References", high)
    out = out.unionByName(rel("customer", "c_custkey", 2, "c_nationkey", 1, "References", high))
    out = out.unionByName(rel("supplier", "s_suppkey", 3, "s_nationkey", 1, "DependsOn", F.when(F.col("s_acctbal") < 0, "Medium").otherwise("High")))
    out = out.unionByName(rel("orders", "o_orderkey", 4, "o_custkey", 2, "Calls", high))
    out = out.unionByName(parts.select((F.col("l_partkey") * 8 + 5).alias("src"), (F.col("l_suppkey") * 8 + 3).alias("dst"), F.when(F.col("m") == 1, "OpaqueDynamic").otherwise("Reads").alias("kind"), level.alias("conf_level")))
    prov = F.when(F.col("src") % 11 != 0, F.lit("carrier"))
    evidence = F.when((F.col("conf_level") != "High") & (F.col("src") % 3 != 0), F.lit("return flag"))
    return out.select((F.col("src") * 1_000_000_000 + F.col("dst")).alias("edge_id"), "src", "dst", "kind", "conf_level", prov.alias("prov"), evidence.alias("evidence"))


def users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id").distinct()


def ring(spark: SparkSession, d: str) -> DataFrame:
    """A graph with cycles: user u depends on user (7 u + 3) % 150."""
    u = users(spark, d)
    e = u.select(F.col("user_id").alias("src"), ((F.col("user_id") * 7 + 3) % 150).alias("dst")).join(u.select(F.col("user_id").alias("dst")), "dst", "left_semi")
    return e.select((F.col("src") * 1000 + F.col("dst")).alias("edge_id"), "src", "dst", F.lit("Calls").alias("kind"), F.lit("High").alias("conf_level"))


def facts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("kind"), F.lit("events").alias("component"), F.concat(F.lit("U:"), "user_id").alias("source_logical_id"), F.col("props").alias("payload"))


CTES = {
    "nodes": "nodes AS (" + " UNION ALL ".join(f"SELECT {k}::BIGINT * 8 + {i} AS node_id, '{p}:' || {k} AS logical_id, CASE WHEN {k} % 7 <> 0 THEN 'p' || {k} END AS persistent_id, '{t}' AS identity_kind FROM {t}" for i, (t, k, p) in enumerate(KINDS)) + ")",
    "edges": """pairs AS (SELECT l_partkey, l_suppkey, max(CASE l_returnflag WHEN 'N' THEN 3 WHEN 'R' THEN 2 ELSE 1 END) AS m FROM lineitem GROUP BY 1, 2),
raw AS (SELECT n_nationkey::BIGINT * 8 + 1 AS src, n_regionkey::BIGINT * 8 AS dst, 'References' AS kind, 'High' AS conf_level FROM nation
  UNION ALL SELECT c_custkey::BIGINT * 8 + 2, c_nationkey::BIGINT * 8 + 1, 'References', 'High' FROM customer
  UNION ALL SELECT s_suppkey::BIGINT * 8 + 3, s_nationkey::BIGINT * 8 + 1, 'DependsOn', CASE WHEN s_acctbal < 0 THEN 'Medium' ELSE 'High' END FROM supplier
  UNION ALL SELECT o_orderkey::BIGINT * 8 + 4, o_custkey::BIGINT * 8 + 2, 'Calls', 'High' FROM orders
  UNION ALL SELECT l_partkey::BIGINT * 8 + 5, l_suppkey::BIGINT * 8 + 3, CASE WHEN m = 1 THEN 'OpaqueDynamic' ELSE 'Reads' END, CASE m WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END FROM pairs),
edges AS (SELECT src * 1000000000 + dst AS edge_id, src, dst, kind, conf_level, CASE WHEN src % 11 <> 0 THEN 'carrier' END AS prov,
  CASE WHEN conf_level <> 'High' AND src % 3 <> 0 THEN 'return flag' END AS evidence, CASE conf_level WHEN 'High' THEN 2 WHEN 'Medium' THEN 1 ELSE 0 END AS t FROM raw)""",
    "ring": "users AS (SELECT DISTINCT user_id FROM events), ring AS (SELECT user_id AS src, (user_id * 7 + 3) % 150 AS dst FROM users WHERE (user_id * 7 + 3) % 150 IN (SELECT user_id FROM users))",
    "facts": "facts AS (SELECT event_type AS kind, 'events' AS component, 'U:' || user_id AS source_logical_id, props AS payload FROM events)",
}


def with_ctes(names: str, sql: str, recursive: bool = False) -> str:
    heads = [CTES[n] for n in names.split()]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        body = ", " + body[5:]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(heads) + "\n" + body
