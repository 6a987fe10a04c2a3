"""Dictionary rows folded into catalog frames, and privileges over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def status(c="status"):
    u = F.upper(F.col(c))
    return F.when(u.isin("VALID", "ENABLED"), "Valid").when(u.isin("INVALID", "UNUSABLE", "DISABLED"), "Invalid").otherwise("NotApplicable")


#: Object types the catalog knows; rows of others are skipped.
TYPES = ("TABLE", "VIEW", "MATERIALIZED VIEW", "PACKAGE", "PACKAGE BODY", "PROCEDURE", "FUNCTION", "TRIGGER", "TYPE", "TYPE BODY", "SEQUENCE", "SYNONYM", "INDEX")


def objects(rows: DataFrame, types: tuple = TYPES) -> DataFrame:
    """Objects (owner, name, object_type, status, seq): of repeated rows the last counts."""
    last = Window.partitionBy("owner", "name", "object_type").orderBy(F.desc("seq"))
    r = rows.where(F.upper("object_type").isin(*types)).withColumn("n", F.row_number().over(last)).where("n = 1")
    return r.select("owner", "name", "object_type", status().alias("status"))


def constraint_kind(rows: DataFrame) -> DataFrame:
    """Kinds by letter; a check that only says IS NOT NULL of its columns is a NotNull."""
    not_null = (F.col("letter") == "C") & F.upper("search_condition").contains("IS NOT NULL") & (F.size("columns") > 0)
    kind = F.when(not_null, "NotNull").when(F.col("letter") == "P", "PrimaryKey").when(F.col("letter") == "R", "ForeignKey").when(F.col("letter") == "U", "Unique").when(F.col("letter") == "C", "Check").otherwise("Other")
    return rows.select("owner", "name", kind.alias("kind"))


def indexes(rows: DataFrame) -> DataFrame:
    """One row an index of rows (owner, name, position, column): its columns in order."""
    cols = F.transform(F.array_sort(F.collect_list(F.struct("position", "column"))), lambda x: x["column"])
    return rows.groupBy("owner", "name").agg(F.array_join(cols, ",").alias("columns"))


def routines(rows: DataFrame) -> DataFrame:
    """One row a routine of argument rows (routine, position, type); position 0 is what a function returns."""
    args = F.transform(F.array_sort(F.collect_list(F.when(F.col("position") > 0, F.struct("position", "type")))), lambda x: x["type"])
    r = rows.groupBy("routine").agg(args.alias("a"), F.max(F.when(F.col("position") == 0, F.col("type"))).alias("return_type"))
    return r.select("routine", F.when(F.col("return_type").isNotNull(), "Function").otherwise("Procedure").alias("kind"), F.array_join("a", ",").alias("arguments"), "return_type")


def grants(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Distinct grants with their grantee's class; one that is no known user counts as a role."""
    r = rows.distinct().join(users.select(F.upper("user").alias("u")).distinct(), F.upper("grantee") == F.col("u"), "left")
    return r.withColumn("grantee_class", F.when(F.upper("grantee") == "PUBLIC", "Public").when(F.col("u").isNotNull(), "User").otherwise("Role")).drop("u")


def plscope_availability(rows: DataFrame) -> DataFrame:
    """Of each schema (rows: schema, identifiers, statements, objects): what compiler data there is."""
    r = rows.groupBy("schema").agg(F.sum("identifiers").alias("i"), F.sum("statements").alias("s"), F.count("*").alias("n"))
    return r.select("schema", F.when(F.col("s") > 0, "IdentifiersAndStatements").when(F.col("i") > 0, "IdentifiersOnly").when(F.col("n") > 0, "Stale").otherwise("NotAvailable").alias("availability"))


def doctor(obj: DataFrame) -> DataFrame:
    """By object type: total, valid, invalid, other."""
    return obj.groupBy("object_type").agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(a) for s, a in (("Valid", "valid"), ("Invalid", "invalid"), ("NotApplicable", "other"))))


def privileges(g: DataFrame, enabled_roles: DataFrame) -> DataFrame:
    """Grants with confidence: users, PUBLIC and enabled roles High; other roles Low, and ambiguous."""
    r = g.join(enabled_roles.select(F.upper("role").alias("r")).distinct(), (F.upper("grantee") == F.col("r")) & (F.col("grantee_class") == "Role"), "left")
    sure = (F.col("grantee_class") != "Role") | F.col("r").isNotNull()
    option = F.when(F.col("grantable"), "Grantable").when(F.col("with_hierarchy"), "Hierarchy").otherwise("None")
    return r.select("object_owner", "object_name", "privilege", "grantee", "grantee_class", option.alias("option"), F.when(sure, "High").otherwise("Low").alias("confidence"), F.when(~sure, "RuntimeGrantOrRole").alias("ambiguity"))


def cross_schema_writes(p: DataFrame) -> DataFrame:
    """Grants to write another user's objects."""
    return p.where(F.col("privilege").isin("INSERT", "UPDATE", "DELETE") & (F.col("grantee_class") == "User") & (F.upper("grantee") != F.upper("object_owner"))).select("grantee", "object_owner", "object_name", "privilege", "confidence")


def synonym_paths(synonyms: DataFrame) -> DataFrame:
    """Where synonyms (owner, name, target_owner, target_name) lead: without an owner into their own schema."""
    return synonyms.select("owner", "name", F.concat_ws(".", F.coalesce("target_owner", "owner"), "target_name").alias("target"), F.lit("Medium").alias("confidence"))


def accessible_by(units: DataFrame) -> DataFrame:
    """(owner, name, caller): who an ACCESSIBLE BY clause names, in texts."""
    inside = F.regexp_extract(F.lower("text"), r"accessible\s+by\s*\(([^)]*)\)", 1)
    caller = F.explode(F.split(inside, ","))
    c = units.select("owner", "name", caller.alias("c")).select("owner", "name", F.regexp_replace(F.trim("c"), r"^(package|procedure|function|trigger|type)\s+", "").alias("caller"))
    return c.where("caller <> ''").distinct()


def authid(objects_: DataFrame) -> DataFrame:
    """Whose rights an object runs with: a program's clause, unknown without text, the definer's for other objects."""
    program = F.upper("object_type").isin("PACKAGE", "PROCEDURE", "FUNCTION", "TYPE")
    t = F.lower("text")
    return objects_.select("owner", "name", F.when(~program, "Definer").when(t.isNull(), "Unknown").when(t.rlike(r"authid\s+current_user"), "Invoker").otherwise("Definer").alias("authid"))


def ambiguity_feed(p: DataFrame) -> DataFrame:
    """Ambiguous grants with the confidence they leave; after them, writes that are ambiguous."""
    a = p.where("ambiguity is not null")
    ceiling = F.when(F.col("ambiguity").isin("RuntimeGrantOrRole", "InvokerRights"), "Low").otherwise("Opaque")
    out = a.select(F.lit(1).alias("part"), "grantee", F.concat_ws(".", "object_owner", "object_name").alias("object"), "privilege", "ambiguity", ceiling.alias("ceiling"))
    w = a.where(F.col("privilege").isin("INSERT", "UPDATE", "DELETE"))
    return out.unionByName(w.select(F.lit(2).alias("part"), "grantee", F.concat_ws(".", "object_owner", "object_name").alias("object"), "privilege", "ambiguity", ceiling.alias("ceiling")))


def privilege_doctor(p: DataFrame) -> DataFrame:
    """One row: grants by confidence, ambiguous ones, schemas, posture."""
    r = p.agg(F.count("*").alias("grants"), F.count_if(F.col("confidence") == "High").alias("high"), F.count("ambiguity").alias("ambiguous"), F.count_distinct("object_owner").alias("schemas"))
    return r.withColumn("posture", F.when(F.col("grants") == 0, "Unknown").when(F.col("ambiguous") == 0, "Clean").when(F.col("ambiguous") * 2 <= F.col("grants"), "Caution").otherwise("Unknown"))


def privilege_facts(grants: DataFrame) -> DataFrame:
    """(unit, kind, detail) facts for rules: a grant (object, grantee, privilege) as grantee|privilege of its object."""
    return grants.select(F.col("object").alias("unit"), F.lit("privilege").alias("kind"), F.concat_ws("|", F.upper("grantee"), F.upper("privilege")).alias("detail")).distinct()
