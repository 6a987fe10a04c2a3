"""Aggregate reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def posture(r: DataFrame) -> DataFrame:
    """Completeness of runs (run, files_total, files_clean, files_recovered, objects_total, extracted,
    unrecognised, diagnostics): the share of objects understood, and what that amounts to."""
    denom = F.col("extracted") + F.col("unrecognised")
    ratio = F.when(denom == 0, F.when(F.col("diagnostics") == 0, 1.0).otherwise(0.0)).otherwise(F.col("extracted") / F.greatest(denom, F.lit(1)))
    tried = F.greatest(denom, F.col("objects_total"))
    noisy = (tried > 0) & (F.col("diagnostics") * 2 >= tried)
    empty = (denom == 0) & (F.col("objects_total") == 0)
    p = (
        F.when(empty & ((F.col("files_total") == 0) | (F.col("diagnostics") == 0)), "Clean")
        .when(empty, "Degraded")
        .when(ratio < 0.10, "Degraded")
        .when((F.col("unrecognised") > 0) | (ratio < 0.85) | noisy, "LowConfidence")
        .when((F.col("files_recovered") > 0) | (F.col("diagnostics") > 0) | (F.col("files_clean") < F.col("files_total")), "Partial")
        .otherwise("Clean")
    )
    return r.select("run", ratio.cast("double").alias("ratio"), p.alias("posture"))


def symbol_doctor(res: DataFrame) -> DataFrame:
    """One row over resolutions (resolved, chain_too_long): counts, whole percent, posture."""
    r = res.agg(F.count("*").alias("total"), F.count_if("resolved").alias("resolved"), F.count_if("chain_too_long").alias("too_long"))
    pct = F.when(F.col("total") > 0, F.expr("resolved * 100 div greatest(total, 1)"))
    p = F.when(F.col("total") == 0, "Unknown").when(F.col("too_long") > 0, "Caution").when(pct >= 95, "Clean").when(pct >= 50, "Caution").otherwise("Unknown")
    return r.select("total", "resolved", (F.col("total") - F.col("resolved")).alias("unresolved"), pct.alias("percent"), p.alias("posture"))


def doc_coverage(objects: DataFrame) -> DataFrame:
    """By kind over objects (kind, has_comment, n_tags): documented, tagged, undocumented, whole percent."""
    r = objects.groupBy("kind").agg(F.count("*").alias("total"), F.count_if("has_comment").alias("documented"), F.count_if(F.col("n_tags") > 0).alias("tagged"))
    return r.select("kind", "total", "documented", "tagged", (F.col("total") - F.col("documented")).alias("undocumented"), F.expr("documented * 100 div total").alias("percent"))


def undocumented_sample(objects: DataFrame, limit: int = 100) -> DataFrame:
    """The first names without a comment (a report's sample, by its own limit)."""
    return objects.where("not has_comment").select("name").orderBy("name").limit(limit)


def bindings_coverage(bindings: DataFrame) -> DataFrame:
    """Bindings by diagnostic (null: bound)."""
    return bindings.groupBy(F.coalesce("diagnostic", F.lit("Bound")).alias("diagnostic")).agg(F.count("*").alias("n"))


def memory_profile(df: DataFrame, parts: list[str]) -> DataFrame:
    """(part, bytes): size of each column's values as JSON."""
    one = df.agg(*(F.sum(F.octet_length(F.to_json(F.struct(p)))).alias(p) for p in parts))
    return one.select(F.inline(F.array(*(F.struct(F.lit(p).alias("part"), F.coalesce(p, F.lit(0).cast("long")).alias("bytes")) for p in parts))))


def distinct_tables(uses: DataFrame) -> DataFrame:
    return uses.select("routine", F.upper("schema").alias("schema"), F.upper("table").alias("table")).distinct()


def value_sets(values: DataFrame) -> DataFrame:
    """Joins of value sets by name (name, form, value): Top absorbs all, Bottom changes nothing, sets of
    constants unite, a range with anything else is Top."""
    known = F.collect_set(F.when(F.col("form") == "OneOf", F.col("value")))
    r = values.groupBy("name").agg(F.bool_or(F.col("form") == "Top").alias("top"), F.count_if(F.col("form") == "Range").alias("ranges"), F.count_if(F.col("form").isin("OneOf")).alias("ones"), F.sort_array(known).alias("v"), F.max(F.when(F.col("form") == "Range", F.col("value"))).alias("r"))
    form = F.when(F.col("top") | (F.col("ranges") > 1) | ((F.col("ranges") == 1) & (F.col("ones") > 0)), "Top").when(F.col("ranges") == 1, "Range").when(F.col("ones") > 0, "OneOf").otherwise("Bottom")
    return r.select("name", form.alias("form"), F.when(form == "OneOf", F.array_join("v", ",")).when(form == "Range", F.col("r")).alias("value"))


def merge_env(flows: DataFrame) -> DataFrame:
    """Flows (name, seq, kinds, cleansed, constant, shape) of each name as one: kinds and cleansers unite,
    a constant stays if all agree, the latest shape counts."""
    r = flows.groupBy("name").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("k"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("cleansed")))).alias("c"), F.min("constant").alias("lo"), F.max("constant").alias("hi"), F.count("constant").alias("n"), F.count("*").alias("all"), F.max_by("shape", "seq").alias("shape"))
    live = F.array_except("k", "c")
    return r.select("name", F.array_join("k", ",").alias("kinds"), F.array_join("c", ",").alias("cleansed"), F.when((F.col("lo") == F.col("hi")) & (F.col("n") == F.col("all")), F.col("lo")).alias("constant"), "shape", (F.size(live) > 0).alias("alarm"))


def parse_metrics(units: DataFrame) -> DataFrame:
    """Of each text: lines, words, comments, bytes."""
    t = F.col("text")
    return units.select("unit", F.size(F.split(t, "\n")).cast("long").alias("lines"), F.size(F.regexp_extract_all(t, F.lit(r"([A-Za-z_][A-Za-z0-9_$#]*)"), F.lit(1))).cast("long").alias("words"), F.size(F.regexp_extract_all(t, F.lit(r"(--[^\n]*)"), F.lit(1))).cast("long").alias("comments"), F.octet_length(t).cast("long").alias("bytes"))
