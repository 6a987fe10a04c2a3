"""Findings: rules over fact sites, gates, fingerprints, suppression and reports.

A rule is a filter of facts of one kind and a message. Facts are (unit, kind, detail), as the
scanners give them. A rule whose facts' kinds are all absent is skipped, and says so."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SEVERITIES, choose


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    kinds: tuple
    message: str
    where: Callable[[], Column] | None = None
    needs_catalog: bool = False
    conf_level: str = "High"
    extra: dict = field(default_factory=dict)


def _others(*bodies: str):
    return lambda: F.concat(F.lit("|"), F.substring_index("detail", "|", -1)).isin(*["|" + b for b in bodies])


RULES = (
    Rule("SEC002", "Medium", ("opacity",), "statement built with DBMS_SQL", lambda: F.contains("detail", F.lit("DBMS_SQL")), conf_level="Medium"),
    Rule("SEC003", "Critical", ("hardcoded_credential",), "credential in the source"),
    Rule("SEC004", "Medium", ("invoker_rights",), "runs with its caller's rights"),
    Rule("SEC005", "High", ("sensitive_public_synonym",), "public synonym for a sensitive object"),
    Rule("SEC006", "High", ("privilege",), "privilege granted to everyone", lambda: F.upper(F.substring_index("detail", "|", 1)) == "PUBLIC", needs_catalog=True),
    Rule("SEC007", "Medium", ("ref_cursor_return",), "hands out an open cursor"),
    Rule("PERF001", "Low", ("cursor_for_loop",), "row-by-row loop over a cursor"),
    Rule("PERF002", "Medium", ("cursor_for_loop",), "row-by-row changes in a loop", lambda: F.endswith("detail", F.lit("|true"))),
    Rule("PERF003", "Medium", ("is_null_on_indexed_column",), "null test can't use the index"),
    Rule("STYLE001", "Info", ("missing_instrumentation",), "no instrumentation"),
    Rule("QUAL001", "Medium", ("exception_handler",), "all errors are swallowed", lambda: F.col("detail") == "others|noop"),
    Rule("QUAL002", "Medium", ("log_without_reraise",), "error is logged and lost"),
    Rule("QUAL003", "Medium", ("unbounded_bulk_collect",), "bulk collect without a limit"),
    Rule("QUAL004", "Medium", ("exception_handler",), "transaction ended in a handler", _others("commit", "rollback")),
    Rule("QUAL005", "Low", ("deprecated_feature",), "deprecated feature"),
    Rule("QUAL006", "High", ("mutating_table_trigger",), "row trigger uses its own table"),
    Rule("QUAL007", "Medium", ("dml_in_function",), "function changes data"),
    Rule("QUAL008", "Medium", ("deterministic_misuse",), "deterministic function isn't"),
    Rule("DEP001", "Medium", ("cross_schema_write",), "writes another schema's object"),
)


def injection(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SEC001, (findings, skipped): dynamic statements (kind dynamic_sql_evidence, detail the name)
    whose string is tainted. Opaque sites and those of unknown shape are skipped, not judged; a
    literal or empty shape is safe."""
    site = facts.where("kind = 'dynamic_sql_evidence'").select("unit", F.upper("detail").alias("name")).distinct()
    opaque = facts.where("kind = 'opacity'").select("unit").distinct().withColumn("opaque", F.lit(True))
    taint = facts.where("kind = 'taint'").select("unit", F.upper("detail").alias("name")).distinct().withColumn("taint", F.lit(True))
    shape = facts.where("kind = 'string_shape'").groupBy("unit", F.upper(F.substring_index("detail", "|", 1)).alias("name")).agg(F.min(F.substring_index("detail", "|", -1)).alias("shape"))
    j = site.join(opaque, "unit", "left").join(taint, ["unit", "name"], "left").join(shape, ["unit", "name"], "left")
    skip = j.where("opaque or (taint and shape is null)").select(F.lit("SEC001").alias("rule_id"), "unit", F.when(F.col("opaque"), "OpaqueSite").otherwise("MissingShape").alias("reason"))
    hit = j.where("opaque is null and taint and shape not in ('Literal', 'Empty')")
    return hit.select(F.lit("SEC001").alias("rule_id"), F.lit("Critical").alias("severity"), F.concat(F.lit("tainted dynamic statement: "), "unit", F.lit(" "), "name").alias("message"), "unit", F.lit("High").alias("conf_level")), skip


def fingerprint() -> Column:
    return F.concat(F.lit("fp:"), F.sha2(F.concat_ws("\x1f", "rule_id", "severity", "message"), 256))


def run(facts: DataFrame, catalog: bool = True, rules: tuple = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, skipped). Equal findings are one, by fingerprint; of several the one of the first
    rule and unit stays. All rules read the facts in one pass."""
    spark = facts.sparkSession
    have = {r["kind"] for r in facts.select("kind").distinct().collect()}  # kinds are a closed list of some dozens
    skipped = [(r.rule_id, "PreconditionUnmet" if r.needs_catalog and not catalog else "MissingFacts") for r in rules if (r.needs_catalog and not catalog) or not set(r.kinds) <= have]
    live = [r for r in rules if r.rule_id not in {s[0] for s in skipped}]
    hits = F.array_compact(
        F.array(
            *(
                F.when(F.col("kind").isin(*r.kinds) & (r.where() if r.where else F.lit(True)), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("text"), F.lit(r.conf_level).alias("conf_level")))
                for r in live
            )
        )
    )
    if live:
        f = facts.select("unit", "detail", F.explode(hits).alias("x")).select("x.rule_id", "x.severity", F.concat_ws(": ", "x.text", F.concat_ws(" ", "unit", "detail")).alias("message"), "unit", "x.conf_level")
    else:
        f = spark.createDataFrame([], "rule_id string, severity string, message string, unit string, conf_level string")
    return dedup(f), spark.createDataFrame(skipped, "rule_id string, reason string")


def dedup(findings: DataFrame) -> DataFrame:
    f = findings.withColumn("fingerprint", fingerprint())
    first = Window.partitionBy("fingerprint").orderBy("rule_id", "unit")
    return f.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def suppress(findings: DataFrame, config: DataFrame, directives: DataFrame) -> DataFrame:
    """Findings (rule_id, file, line, ...) with why each is suppressed, if it is: by rule everywhere
    (config: rule_id, path null), by rule and path prefix, or by a directive (file, line, rule_id) on
    its line or the one before; a finding without a line takes any directive of its file; the
    earliest directive counts."""
    every = config.where("path is null").select("rule_id").distinct().withColumn("g", F.lit("global"))
    paths = config.where("path is not null").select(F.col("rule_id").alias("cr"), "path").distinct()
    f = findings.withColumn("fid", F.xxhash64(*findings.columns)).join(every, "rule_id", "left")
    by_path = f.join(paths, (F.col("rule_id") == F.col("cr")) & F.startswith("file", F.col("path"))).groupBy("fid").agg(F.min("path").alias("p"))
    d = directives.select(F.col("file").alias("df"), F.col("line").alias("dl"), F.col("rule_id").alias("dr"))
    near = F.when(F.col("line") == 0, F.lit(True)).otherwise((F.col("dl") == F.col("line")) | (F.col("dl") == F.col("line") - 1))
    inline = f.join(d, (F.col("file") == F.col("df")) & (F.col("rule_id") == F.col("dr")) & near).groupBy("fid").agg(F.min("dl").alias("at"))
    j = f.join(by_path, "fid", "left").join(inline, "fid", "left")
    why = F.coalesce("g", F.when(F.col("p").isNotNull(), F.concat(F.lit("path "), "p")), F.when(F.col("at").isNotNull(), F.concat(F.lit("line "), "at")))
    return j.select(*findings.columns, why.alias("suppressed"))


def histogram(findings: DataFrame, skipped: DataFrame) -> DataFrame:
    """(rule_id, findings, max_severity, skipped) of every rule that fired or was skipped."""
    a = findings.groupBy("rule_id").agg(F.count("*").alias("findings"), F.max(choose("severity", SEVERITIES, 0)).alias("s"))
    b = skipped.groupBy("rule_id").agg(F.count("*").alias("skipped"))
    zero = F.lit(0).cast("long")
    return a.join(b, "rule_id", "full_outer").select("rule_id", F.coalesce("findings", zero).alias("findings"), choose("s", {v: k for k, v in SEVERITIES.items()}).alias("max_severity"), F.coalesce("skipped", zero).alias("skipped"))


def false_positive_rate(findings: DataFrame, clean_units: DataFrame) -> DataFrame:
    """Units that should be clean, those with a finding, and their share (0 of none)."""
    hit = clean_units.select("unit").distinct().join(findings.select("unit").distinct().withColumn("h", F.lit(1)), "unit", "left")
    return hit.agg(F.count("*").alias("units"), F.count("h").alias("flagged")).withColumn("rate", F.coalesce(F.try_divide("flagged", "units"), F.lit(0.0)))


_SARIF = {"Critical": "error", "High": "error", "Medium": "warning", "Low": "note", "Info": "note"}


def sarif_results(findings: DataFrame) -> DataFrame:
    """(fingerprint, result): each finding as a result object of that format, in JSON."""
    r = F.struct(F.col("rule_id").alias("ruleId"), choose("severity", _SARIF, "note").alias("level"), F.struct(F.col("message").alias("text")).alias("message"))
    return findings.select("fingerprint", F.to_json(r).alias("result"))


def junit_cases(findings: DataFrame) -> DataFrame:
    """(fingerprint, line): each finding as a failed test case, in XML."""
    x = F.col("message")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return findings.select("fingerprint", F.concat(F.lit('<testcase classname="'), "rule_id", F.lit('" name="'), "unit", F.lit('"><failure type="'), "severity", F.lit('" message="'), x, F.lit('"/></testcase>')).alias("line"))


def sarif_document(findings: DataFrame, tool: str = "plumbline", version: str = "1.0.0") -> DataFrame:
    """(part, ordinal, text): a whole SARIF 2.1.0 log by lines: head with the rules that occur, a line a
    result in the order of rule, unit and fingerprint, foot. Lines joined in order are one JSON document; none is joined here."""
    rules = findings.select("rule_id").distinct()
    # a row a rule: there are some twenty
    names = rules.agg(F.to_json(F.transform(F.array_sort(F.collect_list("rule_id")), lambda r: F.struct(r.alias("id")))).alias("r"))
    open_ = F.concat(F.lit(f'{{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{tool}","version":"{version}","rules":'), F.coalesce("r", F.lit("[]")), F.lit('}},"results":['))
    order = F.concat_ws("|", "rule_id", "unit", "fingerprint")
    first = findings.agg(F.min(order).alias("least"))
    r = F.struct(
        F.col("rule_id").alias("ruleId"),
        choose("severity", _SARIF, "note").alias("level"),
        F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.col("unit").alias("uri")).alias("artifactLocation")).alias("physicalLocation"))).alias("locations"),
        F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"),
    )
    body = findings.select(order.alias("ordinal"), F.to_json(r).alias("j")).crossJoin(F.broadcast(first))  # one row
    lines = body.select(F.lit(1).alias("part"), "ordinal", F.concat(F.when(F.col("ordinal") == F.col("least"), "").otherwise(","), "j").alias("text"))
    head = names.select(F.lit(0).alias("part"), F.lit("").alias("ordinal"), open_.alias("text"))
    foot = names.select(F.lit(2).alias("part"), F.lit("").alias("ordinal"), F.lit("]}]}").alias("text"))
    return head.unionByName(lines).unionByName(foot)


def junit_document(findings: DataFrame, tool: str = "plumbline") -> DataFrame:
    """(part, ordinal, text): the same as JUnit XML, a suite with a failed case a finding, and its number of them."""
    n = findings.agg(F.count("*").cast("string").alias("n"))
    head = n.select(F.lit(0).alias("part"), F.lit("").alias("ordinal"), F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><testsuites><testsuite name="{tool}" tests="'), "n", F.lit('" failures="'), "n", F.lit('">')).alias("text"))
    foot = n.select(F.lit(2).alias("part"), F.lit("").alias("ordinal"), F.lit("</testsuite></testsuites>").alias("text"))
    order = findings.select("fingerprint", F.concat_ws("|", "rule_id", "unit", "fingerprint").alias("ordinal"))
    lines = junit_cases(findings).join(order, "fingerprint").select(F.lit(1).alias("part"), "ordinal", F.col("line").alias("text"))
    return head.unionByName(lines).unionByName(foot)


def build_baseline(findings: DataFrame) -> DataFrame:
    """(accepted): the fingerprints of a scan, each once, in order."""
    return findings.select(F.col("fingerprint").alias("accepted")).distinct().orderBy("accepted")
