"""Small functions over names, paths and types."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalise_ddl(c: str) -> Column:
    """Blanks collapsed, line ends kept, no lone slash at the end."""
    t = F.regexp_replace(F.col(c), r"[ \t]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n/\s*$", ""), r"^\s+|\s+$", "")


def escape_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_label(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def run_id(paths: DataFrame, by: str) -> DataFrame:
    """djb2 over a run's sorted paths, in 64 bits that wrap (so in Python, in batches)."""

    def one(p: list) -> str:
        h = 5381
        for path in p:
            for b in (path or "").encode() + b"\n":
                h = (h * 33 + b) & 0xFFFFFFFFFFFFFFFF
        return f"{h:016x}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({by: p[by], "run_id": [one(x) for x in p["paths"]]})

    g = paths.groupBy(by).agg(F.sort_array(F.collect_set("path")).alias("paths"))
    return g.mapInPandas(run, f"{by} {dict(paths.dtypes)[by]}, run_id string")


def map_type(name: str = "type_name", precision: str = "precision", scale: str = "scale") -> tuple[Column, Column]:
    """(Spark type, diagnostic) of a dictionary type."""
    n, p, s = F.upper(F.col(name)), F.col(precision), F.col(scale)
    simple = {"BINARY_FLOAT": "FLOAT", "BINARY_DOUBLE": "DOUBLE", "VARCHAR2": "STRING", "CHAR": "STRING", "CLOB": "STRING", "XMLTYPE": "STRING", "BLOB": "BINARY", "RAW": "BINARY", "DATE": "TIMESTAMP_NTZ", "TIMESTAMP": "TIMESTAMP_NTZ", "JSON": "VARIANT", "BOOLEAN": "BOOLEAN", "INTERVAL DS": "INTERVAL DAY TO SECOND", "INTERVAL YM": "INTERVAL YEAR TO MONTH"}
    t = F.when((n == "NUMBER") & (F.coalesce(s, F.lit(0)) == 0) & (p <= 18), "BIGINT").when(n == "NUMBER", F.format_string("DECIMAL(%d,%d)", F.least(F.coalesce(p, F.lit(38)), F.lit(38)), F.coalesce(s, F.lit(0))))
    for k, v in simple.items():
        t = t.when(n == k, v)
    d = F.when((n == "NUMBER") & p.isNull(), "UnboundedNumber").when(n == "REF CURSOR", "RefCursorUnsupported").when(n == "TIMESTAMP", "NanosecondsLost").when(t.isNull(), "UnknownType")
    return t, d


def overload_names(routines: DataFrame) -> DataFrame:
    """(routine_id, name): routines (routine_id, name, signature) of one name told apart by a number."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.lower("name"))
    n, k = F.count("*").over(w), F.row_number().over(w.orderBy("signature", "routine_id"))
    return routines.select("routine_id", F.when(n == 1, F.lower("name")).otherwise(F.concat(F.lower("name"), F.lit("_"), k)).alias("name"))


def doc_tags(units: DataFrame) -> DataFrame:
    """(unit, tag, value) of @tags in comments /** ... */."""
    comments = F.explode(F.regexp_extract_all("text", F.lit(r"/\*\*((?s:.*?))\*/"), F.lit(1))).alias("c")
    tags = F.explode(F.regexp_extract_all("c", F.lit(r"(@[a-z]+[^\n@*]*)"), F.lit(1))).alias("t")
    t = units.select("unit", comments).select("unit", tags)
    return t.select("unit", F.regexp_extract("t", r"^@([a-z]+)", 1).alias("tag"), F.trim(F.regexp_replace("t", r"^@[a-z]+", "")).alias("value"))


def _less(w: Column) -> Column:
    """All strings with one character less."""
    return F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: i <= F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))


def suggestions(words: DataFrame, known: DataFrame, most: int = 2) -> DataFrame:
    """(word, suggestion) of known names at an edit distance of most at most. Words and names meet where both
    give one string by leaving out most characters or fewer: all within that distance do, and
    no word meets all names."""

    def left(df: DataFrame, c: str) -> DataFrame:
        forms = F.array(F.lower(c))
        every = forms
        for _ in range(most):
            forms = F.array_distinct(F.flatten(F.transform(forms, _less)))
            every = F.concat(every, forms)
        return df.select(c, F.explode(F.array_distinct(every)).alias("form"))

    j = left(words.select("word").distinct(), "word").join(left(known.select("name").distinct(), "name"), "form").select("word", "name").distinct()
    j = j.withColumn("d", F.levenshtein(F.lower("word"), F.lower("name"))).where(F.col("d") <= most)
    return j.groupBy("word").agg(F.min(F.struct("d", "name"))["name"].alias("suggestion"))


EXTENSION_VERSIONS = {"JSON": "12.1", "SQL_MACRO": "19.7", "VECTOR": "23.4", "BOOLEAN_SQL": "23.1", "ACCESSIBLE_BY": "12.1", "WITH_FUNCTION": "12.1", "POLYMORPHIC_TABLE": "18.1", "QUALIFIED_EXPRESSION": "18.1"}


def earliest_version(c: str = "feature") -> Column:
    from ..schemas import choose

    return choose(c, EXTENSION_VERSIONS)
