"""Changes of an estate: classified, predicted, planned and gated."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frames import ranked
from ..schemas import LEVELS, choose, conf_rank

EXTENSIONS = ("sql", "pks", "pkb", "pls", "plb")


def object_id(path: str = "path"):
    """A path's object id: without its last extension, dots for slashes."""
    return F.replace(F.regexp_replace(F.col(path), r"\.[^./]*$", ""), F.lit("/"), F.lit("."))


def classify_name_status(rows: DataFrame) -> DataFrame:
    """(change, path, object_id) of lines (status, path, path2) of a name-status listing; a rename or
    copy is a drop and a creation; other files than sources are left out."""
    s = F.substring("status", 1, 1)
    pair = F.array(F.struct(F.lit("Dropped").alias("change"), F.col("path").alias("path")), F.struct(F.lit("Created").alias("change"), F.col("path2").alias("path")))
    one = F.array(F.struct(F.when(s == "A", "Created").when(s == "D", "Dropped").otherwise("Body").alias("change"), F.col("path").alias("path")))
    r = rows.select(F.explode(F.when(s.isin("R", "C"), pair).otherwise(one)).alias("x")).select("x.change", "x.path")
    return r.where(F.lower(F.substring_index("path", ".", -1)).isin(*EXTENSIONS)).withColumn("object_id", object_id())


def changed_objects(records: DataFrame) -> DataFrame:
    """(owner, name, kind, uncertainty) of change records (kind, object_id, detail)."""
    parts = F.split("object_id", r"\.")
    kind = (
        F.when(F.col("kind") == "Column", F.when(F.col("detail") == "Added", "TableAdditiveDdl").otherwise("TableDestructiveDdl"))
        .when(F.col("kind") == "Signature", F.when(F.size(parts) >= 3, "PackageSpec").otherwise("StandaloneRoutineSignature"))
        .when(F.col("kind").isin("Created", "Dropped", "Body"), "Unclassified")
        .otherwise(F.col("kind"))
    )
    owner = F.when(F.size(parts) > 1, parts[0])
    name = F.when(F.size(parts) > 1, parts[1]).otherwise(parts[0])
    why = F.when((F.size(parts) < 2) | (kind == "Unclassified"), "MissingCatalogObject")
    return records.select(F.upper(owner).alias("owner"), F.upper(name).alias("name"), kind.alias("kind"), why.alias("uncertainty"))


#: What a change of each kind invalidates directly; body-only changes nothing.
RULES = {
    "PackageSpec": ("PACKAGE", "PackageSpecChanged"),
    "StandaloneRoutineSignature": ("ROUTINE", "RoutineSignatureChanged"),
    "TableAdditiveDdl": ("TABLE", "TableAdditive"),
    "TableDestructiveDdl": ("TABLE", "TableDestructive"),
    "TypeEvolution": ("TYPE", "TypeEvolution"),
    "SynonymRetargeting": ("SYNONYM", "SynonymRetargeted"),
    "GrantOrRevoke": ("PRIVILEGE", "PrivilegeChange"),
    "EditionedObjectChange": ("EDITIONED", "EditionedObjectChange"),
    "MaterializedViewRefreshAffecting": ("MATERIALIZED_VIEW", "MaterializedViewRefreshAffected"),
    "ViewDefinitionChange": ("VIEW", "Other"),
    "TriggerChange": ("TRIGGER", "Other"),
}
UNCERTAIN = {"PackageBody": "ConditionalCompilationBranch", "IndexChange": "MissingCatalogObject", "SequenceChange": "MissingCatalogObject", "Unclassified": "MissingCatalogObject"}
MODES = {"offline": "Medium", "live": "High"}


def predict(changed: DataFrame, mode: str = "offline") -> DataFrame:
    """(owner, name, object_type, reason, confidence, distance): direct invalidations."""
    t, r = (choose("kind", {k: v[i] for k, v in RULES.items()}) for i in (0, 1))
    return changed.select("owner", "name", t.alias("object_type"), r.alias("reason"), F.lit(MODES[mode]).alias("confidence"), F.lit(1).alias("distance")).where("object_type is not null")


def uncertainties(changed: DataFrame) -> DataFrame:
    by_kind = choose("kind", UNCERTAIN)
    both = F.array_distinct(F.array_compact(F.array(F.col("uncertainty"), by_kind)))
    return changed.select("owner", "name", F.explode(both).alias("reason"))


def predict_with_lineage(direct: DataFrame, impacted: DataFrame, metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(invalidations, uncertainties): impacted nodes (logical_id, hops, confidence) whose object is
    known (metadata: logical_id, owner, name, object_type) join the direct ones; of one object the
    nearest counts, then the surest; objects that are direct already are left out; unknown ones are
    uncertain."""
    j = impacted.join(metadata, "logical_id", "left")
    far = j.where("name is not null").join(direct.select("owner", "name"), ["owner", "name"], "left_anti")
    best = Window.partitionBy("owner", "name").orderBy("hops", F.desc(conf_rank("confidence")), "logical_id")
    far = far.withColumn("n", F.row_number().over(best)).where("n = 1").select("owner", "name", "object_type", F.lit("Transitive").alias("reason"), "confidence", F.col("hops").alias("distance"))
    return direct.unionByName(far), j.where("name is null").select("logical_id", F.lit("MissingCatalogObject").alias("reason"))


_WEIGHT = {"SequenceChange": 0, "TypeEvolution": 1, "TableAdditiveDdl": 2, "TableDestructiveDdl": 2, "ViewDefinitionChange": 3, "MaterializedViewRefreshAffecting": 3, "PackageSpec": 4, "PackageBody": 5, "StandaloneRoutineSignature": 6, "StandaloneRoutineBody": 6, "TriggerChange": 7, "SynonymRetargeting": 8, "IndexChange": 9, "GrantOrRevoke": 10, "EditionedObjectChange": 11, "Unclassified": 13}
_RISK = {"TableDestructiveDdl": 3, "TypeEvolution": 3, "Unclassified": 3, "PackageSpec": 2, "StandaloneRoutineSignature": 2, "ViewDefinitionChange": 2, "TableAdditiveDdl": 1, "GrantOrRevoke": 1}
_RISKS = {3: "High", 2: "Medium", 1: "Low", 0: "Low"}


def plan(changed: DataFrame, recompiles: DataFrame) -> DataFrame:
    """(ordinal, step, owner, name): definitions by kind, owner and name, then recompilations (owner,
    name, position) of objects that no definition covers."""
    a = changed.select(F.lit("Ddl").alias("step"), "owner", "name", choose("kind", _WEIGHT, 12).alias("w"))
    b = recompiles.join(changed.select("owner", "name").distinct(), ["owner", "name"], "left_anti").select(F.lit("Recompile").alias("step"), "owner", "name", (F.col("position") + 100).cast("int").alias("w"))
    steps = a.unionByName(b).withColumn("tie", F.monotonically_increasing_id())  # equal steps follow each other
    return ranked(steps, "ordinal", F.col("w"), F.col("owner").asc_nulls_first(), F.col("name"), F.col("step"), F.col("tie")).select("ordinal", "step", "owner", "name")


def risk(changed: DataFrame) -> DataFrame:
    return changed.agg(choose(F.coalesce(F.max(choose("kind", _RISK, 0)), F.lit(0)), _RISKS).alias("risk"))


def gate(invalidations: DataFrame, uncertain: DataFrame, max_invalidations: int | None = None, blocked_kinds: tuple = (), min_confidence: str | None = None, blocking_reasons: tuple = ()) -> DataFrame:
    """(failure, subject, observed): what of a policy is broken; no rows: allowed."""
    i = invalidations.withColumn("r", conf_rank("confidence"))
    spark = invalidations.sparkSession
    out = spark.createDataFrame([], "failure string, subject string, observed long")
    if max_invalidations is not None:
        out = out.unionByName(i.agg(F.count("*").alias("observed")).where(F.col("observed") > max_invalidations).select(F.lit("InvalidationsExceeded").alias("failure"), F.lit(str(max_invalidations)).alias("subject"), "observed"))
    if blocked_kinds:
        k = i.where(F.upper("object_type").isin(*[b.upper() for b in blocked_kinds])).groupBy(F.upper("object_type").alias("subject")).agg(F.count("*").alias("observed"))
        out = out.unionByName(k.select(F.lit("BlockedKindHit").alias("failure"), "subject", "observed"))
    if min_confidence:
        c = i.where(F.col("r") < conf_rank(F.lit(min_confidence))).agg(F.count("*").alias("observed")).where("observed > 0")
        out = out.unionByName(c.select(F.lit("ConfidenceBelowFloor").alias("failure"), F.lit(min_confidence).alias("subject"), "observed"))
    if blocking_reasons:
        u = uncertain.where(F.col("reason").isin(*blocking_reasons)).groupBy(F.col("reason").alias("subject")).agg(F.count("*").alias("observed"))
        out = out.unionByName(u.select(F.lit("BlockingUnknownReasonHit").alias("failure"), "subject", "observed"))
    return out


_LIFE = {"PackageSpecChanged": "Interface", "RoutineSignatureChanged": "Interface", "TableAdditive": "Data", "TableDestructive": "Data", "TypeEvolution": "Interface", "SynonymRetargeted": "Naming", "PrivilegeChange": "Security", "EditionedObjectChange": "Edition", "MaterializedViewRefreshAffected": "Data"}


def explain_lifecycle(invalidations: DataFrame) -> DataFrame:
    """Invalidations by the category of their reason; a destructive one or an interface warns."""
    return invalidations.select("owner", "name", "reason", choose("reason", _LIFE, "Other").alias("category"), F.col("reason").isin("TableDestructive", "TypeEvolution", "PackageSpecChanged").alias("warning"))


def doctor(changed: DataFrame) -> DataFrame:
    """(report, item, n): changes by kind and uncertainties by reason."""
    a = changed.groupBy(F.col("kind").alias("item")).agg(F.count("*").alias("n")).withColumn("report", F.lit("kind"))
    b = uncertainties(changed).groupBy(F.col("reason").alias("item")).agg(F.count("*").alias("n")).withColumn("report", F.lit("uncertainty"))
    return a.unionByName(b).select("report", "item", "n")


def impact_by_type(invalidations: DataFrame) -> DataFrame:
    return invalidations.groupBy("object_type").agg(F.count("*").alias("n"))


def pr_comment(failures: DataFrame, marker: str) -> DataFrame:
    """(body, verdict): one comment of a gate's failures, with a marker by which it is found again."""
    line = F.concat(F.lit("- "), "failure", F.lit(" ("), "subject", F.lit("): "), "observed")
    r = failures.agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("lines"), F.count("*").alias("n"))
    verdict = F.when(F.col("n") == 0, "allowed").otherwise("blocked")
    return r.select(F.concat(F.lit(f"<!-- {marker} -->\n**"), verdict, F.lit("**\n"), "lines").alias("body"), verdict.alias("verdict"))


def existing_comment(comments: DataFrame, marker: str) -> DataFrame:
    """The first comment (comment_id, body) that holds the marker."""
    return comments.where(F.contains("body", F.lit(f"<!-- {marker} -->"))).agg(F.min("comment_id").alias("comment_id")).where("comment_id is not null")


REASONS = ("DynamicSqlOpaque", "DbLinkRemoteObject", "WrappedSource", "MissingCatalogObject", "MissingPackageBody", "ConditionalCompilationBranch", "EditionedObject", "InvokerRightsRuntimeResolution", "RuntimeGrantOrRole", "UnsupportedDialectFeature", "ParserRecoveryRegion", "AnalysisRecursionLimit", "ResponseSanitized")


def parse_policy(text: str) -> dict:
    """The arguments of a gate from its TOML. Unknown keys, wrong types and reasons that nothing ever
    gives are a ValueError: a rule that can't fire must not look like one that passed."""
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ValueError(f"policy: {e}") from None
    out: dict = {"max_invalidations": None, "blocked_kinds": (), "min_confidence": None, "blocking_reasons": ()}
    for k, v in raw.items():
        lists = {"blocked_kinds": "blocked_kinds", "blocking_unknown_reasons": "blocking_reasons"}
        if k == "max_invalidations" and isinstance(v, int) and not isinstance(v, bool) and v >= 0:
            out[k] = v
        elif k == "min_confidence" and isinstance(v, str) and v.capitalize() in LEVELS:
            out[k] = v.capitalize()
        elif k in lists and isinstance(v, list) and all(isinstance(x, str) for x in v):
            out[lists[k]] = tuple(v)
        else:
            raise ValueError(f"policy: {k} = {v!r}")
    for r in out["blocking_reasons"]:
        if r not in REASONS:
            raise ValueError(f"policy: unknown reason {r}; known are {', '.join(REASONS)}")
    return out


def sorted_predictions(invalidations: DataFrame) -> DataFrame:
    """Nearest first, then by owner, name and type."""
    return invalidations.orderBy("distance", "owner", "name", "object_type")
