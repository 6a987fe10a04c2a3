"""Scanners over source units (unit, text): sites of constructs, as frames (unit, kind, detail).

Column expressions only: texts in lower case, string literals blanked by a regular expression where
a scanner asks for it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CREDENTIALS = ("password", "passwd", "pwd", "secret", "api_key", "apikey", "access_key", "token", "credential")
INSTRUMENTS = ("dbms_application_info", "logger.", "log_pkg", "pkg_log", "dbms_output", "log_error", "log_message", "write_log", "trace(", "debug(", "apex_debug", "instrument")
SENSITIVE = ("password", "passwd", "secret", "credential", "salary", "payroll", "ssn", "credit", "card", "account", "user", "auth", "token", "key", "private", "personal", "medical", "bank", "tax", "audit")
BODY_END = r"(?s)\bend\b.*$"
_ID = r"[a-z0-9_$#.\"]+"


def lower(c="text") -> Column:
    return F.lower(F.col(c))


def masked(c="text") -> Column:
    """Lower case, with the contents of string literals gone."""
    return F.regexp_replace(lower(c), r"'(?:[^']|'')*'", "''")


def squeezed() -> Column:
    """Masked, with runs of spaces as one."""
    return F.regexp_replace(masked(), r"\s+", " ")


class _Gather:
    """Takes what scanners would do one after the other, to do it in one pass over the texts."""

    def __init__(self) -> None:
        self.found: list[Column] = []

    def add(self, kind: str, details: Column) -> None:
        self.found.append(F.transform(details, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("detail"))))


class _Text:
    """The columns of _read by name; made when asked for, as they need a session."""

    def __getattr__(self, c: str) -> Column:
        return F.col(f"__{c}")


_text = _Text()


def _read(units: DataFrame) -> DataFrame:
    """Units with their texts in the forms that scanners ask for, each made once however many ask."""
    return units.select("unit", lower().alias("__low"), masked().alias("__masked"), squeezed().alias("__squeezed"))


def _sites(units, kind: str, when: Column, detail: Column | None = None):
    detail = F.lit(None).cast("string") if detail is None else detail
    if isinstance(units, _Gather):
        return units.add(kind, F.when(when, F.array(detail)))
    return _read(units).where(when).select("unit", F.lit(kind).alias("kind"), detail.alias("detail"))


def _each(units, kind: str, details: Column, once: bool = True):
    details = F.array_distinct(details) if once else details
    if isinstance(units, _Gather):
        return units.add(kind, details)
    return _read(units).select("unit", F.lit(kind).alias("kind"), F.explode(details).alias("detail"))


def exception_handlers(units: DataFrame) -> DataFrame:
    """detail: scope|body, the scope others or a name, the body noop, commit, rollback or other."""
    tail = F.regexp_extract(_text.low, r"(?s)\bexception\b(.*)$", 1)
    parts = F.split(tail, r"\bwhen\s+")
    parts = F.slice(parts, 2, F.size(parts))
    scope = lambda h: F.trim(F.regexp_extract(h, r"(?s)^(.*?)\s+then\b", 1))

    def detail(h: Column) -> Column:
        b = F.trim(F.regexp_replace(F.regexp_extract(h, r"(?s)\bthen\b(.*)$", 1), BODY_END, ""))
        body = F.when(b.rlike(r"^(null\s*;?)?$"), "noop").when(b.rlike(r"\bcommit\b"), "commit").when(b.rlike(r"\brollback\b"), "rollback").otherwise("other")
        return F.concat_ws("|", scope(h), body)

    return _each(units, "exception_handler", F.transform(F.filter(parts, lambda h: scope(h) != ""), detail), once=False)


def cursor_for_loops(units: DataFrame) -> DataFrame:
    """detail: variable|whether its body changes data."""
    head = r"\bfor\s+([a-z_][a-z0-9_]*)\s+in\s+(\(\s*select|[a-z_][a-z0-9_]*\s+loop)"
    names = F.regexp_extract_all(_text.masked, F.lit(head), F.lit(1))
    dml = _text.masked.rlike(r"(?s)\bloop\b.*\b(insert\s+into|update|delete\s+from|merge\s+into)\b.*\bend\s+loop\b")
    return _each(units, "cursor_for_loop", F.transform(names, lambda v: F.concat_ws("|", v, dml.cast("string"))))


def missing_instrumentation(units: DataFrame) -> DataFrame:
    t = _text.masked
    marks = "|".join(re.escape(m) for m in INSTRUMENTS)
    return _sites(units, "missing_instrumentation", t.rlike(r"\bbegin") & ~t.rlike(marks))


def hardcoded_credentials(units: DataFrame) -> DataFrame:
    """detail: the marker, where a literal begins within 64 characters after it and before a semicolon."""
    found = F.concat(*(F.when(_text.low.rlike(m + r"[^;']{0,64}'"), F.array(F.lit(m))).otherwise(F.array().cast("array<string>")) for m in CREDENTIALS))
    return _each(units, "hardcoded_credential", found)


def invoker_rights(units: DataFrame) -> DataFrame:
    return _sites(units, "invoker_rights", F.contains(_text.squeezed, F.lit("authid current_user")))


def ref_cursor_return(units: DataFrame) -> DataFrame:
    t = _text.squeezed
    return _sites(units, "ref_cursor_return", F.contains(t, F.lit("return sys_refcursor")) | F.contains(t, F.lit("return ref cursor")))


def _dml(t: Column) -> Column:
    return t.rlike(r"\b(insert\s+into|update\s|delete\s+from|merge\s+into)")


def dml_in_function(units: DataFrame) -> DataFrame:
    t = _text.masked
    return _sites(units, "dml_in_function", t.rlike(r"\bfunction") & _dml(t))


def unbounded_bulk_collect(units: DataFrame) -> DataFrame:
    all_ = F.regexp_extract_all(_text.squeezed, F.lit(r"(bulk collect into[^;]*)"), F.lit(1))
    return _sites(units, "unbounded_bulk_collect", F.exists(all_, lambda s: ~F.contains(s, F.lit("limit"))))


def deprecated_features(units: DataFrame) -> DataFrame:
    t = _text.squeezed
    marks = ("dbms_job", "(+)", "commit work", "rollback work")
    return _each(units, "deprecated_feature", F.array_compact(F.array(*(F.when(F.contains(t, F.lit(m)), F.lit(m)) for m in marks))))


def deterministic_misuse(units: DataFrame) -> DataFrame:
    t = _text.masked
    marks = ("sysdate", "systimestamp", "current_timestamp", "dbms_random", ".nextval")
    found = F.array_compact(F.array(F.when(_dml(t), F.lit("dml")), *(F.when(F.contains(t, F.lit(m)), F.lit(m)) for m in marks)))
    return _each(units, "deterministic_misuse", F.when(F.contains(t, F.lit("deterministic")), found))


def mutating_triggers(units: DataFrame) -> DataFrame:
    """detail: the table, where a row trigger uses the table it stands on."""
    t = _text.squeezed
    own = F.regexp_extract(t, r"\btrigger\b.*? on (" + _ID + r")", 1)
    body = F.regexp_extract(t, r"(for each row.*)$", 1)
    uses = F.lit(False)
    for w in ("from ", "update ", "insert into ", "merge into "):
        uses = uses | F.contains(body, F.concat(F.lit(w), own))
    return _sites(units, "mutating_table_trigger", (own != "") & uses, own)


def log_without_reraise(units: DataFrame) -> DataFrame:
    body = F.regexp_extract(_text.masked, r"(?s)\bexception\b\s+when\b(.*)$", 1)
    first = F.element_at(F.split(body, r"\bwhen\s"), 1)
    logs = first.rlike(r"log|dbms_output|trace|debug")
    return _sites(units, "log_without_reraise", logs & ~first.rlike(r"\braise"))


def cross_schema_writes(units: DataFrame) -> DataFrame:
    """detail: schema.object written by a unit of another schema (the part of its name before the dot)."""
    all_ = F.regexp_extract_all(_text.masked, F.lit(r"\b(?:insert\s+into|update|delete\s+from|merge\s+into)\s+([a-z0-9_$#]+\.[a-z0-9_$#]+)"), F.lit(1))
    own = F.lower(F.substring_index("unit", ".", 1))
    return _each(units, "cross_schema_write", F.filter(all_, lambda o: F.substring_index(o, ".", 1) != own))


def sensitive_synonyms(units: DataFrame) -> DataFrame:
    """detail: synonym>target of public synonyms whose name or target sounds sensitive."""
    p = r"public\s+synonym\s+(" + _ID + r")\s+for\s+(" + _ID + ")"
    s, t = F.regexp_extract(_text.masked, p, 1), F.regexp_extract(_text.masked, p, 2)
    last = F.substring_index(t, ".", -1)
    hot = F.concat_ws(" ", s, last).rlike("|".join(SENSITIVE))
    return _sites(units, "sensitive_public_synonym", (s != "") & hot, F.concat_ws(">", s, t))


def null_tests_on_indexed(units: DataFrame) -> DataFrame:
    """detail: a column that an index of the same text holds and that is tested for null."""
    t = _text.masked
    cols = F.flatten(F.transform(F.regexp_extract_all(t, F.lit(r"create\s+(?:unique\s+|bitmap\s+)?index\s+\S+\s+on\s+[a-z0-9_$#.]+\s*\(([^)]*)\)"), F.lit(1)), lambda x: F.split(F.regexp_replace(x, r"\s+", ""), ",")))
    null = F.regexp_extract_all(t, F.lit(r"([a-z0-9_$#]+)\s+is\s+null"), F.lit(1))
    return _each(units, "is_null_on_indexed_column", F.array_intersect(cols, null))


def db_links(units: DataFrame) -> DataFrame:
    return _each(units, "db_link_reference", F.transform(F.regexp_extract_all(_text.masked, F.lit(r"([a-z0-9_$#.]+@[a-z0-9_$#]+)"), F.lit(1)), lambda x: F.upper(x)))


def opaque_sites(units: DataFrame) -> DataFrame:
    """detail: DBMS_SQL, where statements are built by that package's calls."""
    return _sites(units, "opacity", F.contains(_text.masked, F.lit("dbms_sql.")), F.lit("DBMS_SQL"))


SCANNERS = (exception_handlers, cursor_for_loops, missing_instrumentation, hardcoded_credentials, invoker_rights, ref_cursor_return, dml_in_function, unbounded_bulk_collect, deprecated_features, deterministic_misuse, mutating_triggers, log_without_reraise, cross_schema_writes, sensitive_synonyms, null_tests_on_indexed, db_links, opaque_sites)


def all_sites(units: DataFrame) -> DataFrame:
    """What all scanners find, in one pass over the texts."""
    g = _Gather()
    for f in SCANNERS:
        f(g)
    none = F.array().cast("array<struct<kind:string,detail:string>>")
    return _read(units).select("unit", F.inline(F.concat(*(F.coalesce(x, none) for x in g.found))))


# embedded SQL


def verb(c: str = "sql") -> Column:
    w = F.upper(F.regexp_extract(F.regexp_replace(F.col(c), r"^(?:\s*/\*(?s:.*?)\*/)*\s*", ""), r"^([A-Za-z]+)", 1))
    return F.when(w.isin("SELECT", "INSERT", "UPDATE", "DELETE", "MERGE", "WITH"), w).otherwise("OTHER")


def read_only(c: str = "sql") -> Column:
    """A query: behind leading block comments the first word is SELECT or WITH."""
    return verb(c).isin("SELECT", "WITH")


def preview(c: str = "sql") -> Column:
    """The first 72 characters of a statement of more bytes."""
    return F.when(F.octet_length(c) > 72, F.concat(F.substring(c, 1, 72), F.lit("…"))).otherwise(F.col(c))


def _after(c: str, word: str) -> Column:
    return F.regexp_extract_all(F.upper(masked(c)), F.lit(r"\b" + word + r"\s+([A-Z0-9_$#.]+)"), F.lit(1))


def table_accesses(stmts: DataFrame) -> DataFrame:
    """(stmt_id, table, access) of statements (stmt_id, sql): what each verb reads and writes; DUAL is no table."""
    v = verb()
    none = F.array().cast("array<string>")
    read, joined, into, using = _after("sql", "FROM"), _after("sql", "JOIN"), _after("sql", "INTO"), _after("sql", "USING")
    target = F.when(v == "UPDATE", F.slice(_after("sql", "UPDATE"), 1, 1)).when(v == "DELETE", F.slice(read, 1, 1)).when(v.isin("INSERT", "MERGE"), F.slice(into, 1, 1)).otherwise(none)
    reads = (
        F.when(v.isin("SELECT", "WITH"), F.concat(read, joined)).when(v == "INSERT", read).when(v == "UPDATE", read).when(v == "DELETE", F.concat(F.slice(read, 2, F.greatest(F.size(read), F.lit(1))), joined)).when(v == "MERGE", F.slice(using, 1, 1)).otherwise(none)
    )
    both = F.concat(F.transform(F.array_distinct(reads), lambda t: F.struct(t.alias("table"), F.lit("Read").alias("access"))), F.transform(target, lambda t: F.struct(t.alias("table"), F.lit("Write").alias("access"))))
    return stmts.select("stmt_id", F.inline(both)).where("table <> 'DUAL' and table <> ''").distinct()


def column_edges(uses: DataFrame) -> DataFrame:
    """(stmt_id, table, column, kind) of column uses (stmt_id, column, table, n_tables, write, star): a
    bare column belongs to the table if there is but one; else it is an unknown one of its table."""
    known = F.col("table").isNotNull() | (F.col("n_tables") == 1)
    kind = F.when(F.col("star"), "DerivesColumn").when(known & F.col("write"), "WritesColumn").when(known, "ReadsColumn").when(F.col("write"), "WritesUnknownColumnOfTable").otherwise("ReadsUnknownColumnOfTable")
    return uses.select("stmt_id", F.coalesce(F.lower("table"), F.lit("?")).alias("table"), F.upper("column").alias("column"), kind.alias("kind")).distinct()


def dynamic_sql(units: DataFrame) -> DataFrame:
    """(unit, form, interpolated, sanitised, confidence) of dynamic statements in texts."""
    t = lower()
    body = F.regexp_extract(t, r"execute\s+immediate\s+([^;]*)", 1)
    holes = F.size(F.regexp_extract_all(body, F.lit(r"(\|\|\s*[a-z_][a-z0-9_.]*)"), F.lit(1)))
    clean = F.size(F.regexp_extract_all(body, F.lit(r"(\|\|\s*dbms_assert\.(?:enquote_name|enquote_literal|simple_sql_name|qualified_sql_name|schema_name|sql_object_name))"), F.lit(1)))
    form = F.when(F.contains(t, F.lit("dbms_sql.")), "DbmsSql").when(t.rlike(r"\bopen\s+\S+\s+for\s+[a-z_]+\s*;"), "RefCursor").when(body != "", "ExecuteImmediate")
    conf = F.when(form.isin("DbmsSql", "RefCursor"), "Opaque").when(holes == 0, "High").when(holes == clean, "Medium").otherwise("Low")
    return units.where(form.isNotNull()).select("unit", form.alias("form"), holes.cast("long").alias("interpolated"), clean.cast("long").alias("sanitised"), conf.alias("confidence"))


def enrich(dynamic: DataFrame, shapes: DataFrame) -> DataFrame:
    """Confidence of dynamic statements (unit, confidence) by the shape of their string (unit, shape)."""
    j = dynamic.join(shapes, "unit", "left")
    s, c = F.col("shape"), F.col("confidence")
    return j.select("unit", F.when(s.isin("Literal", "Empty"), "High").when((s == "InterpolatedWithFix") & c.isin("Low", "Opaque"), "Medium").otherwise(c).alias("confidence"))
