"""The loop that closes gaps: capture from diagnostics, smallest fixtures, and the gates a repair passes."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.literals import shrink
from .ledger import gap_signature

#: Diagnostics that a repair can mend.
REPAIRABLE = ("PARSE_RECOVERY", "UNCLASSIFIED_DECL", "DDL_NOT_LOWERED")
MARKERS = ("PRIVATE_ESTATE", "PRIVATEESTATE", "ACME_CORP", "ACME CORP", "CUSTOMER_SSN", "ESTATE_SECRET", "PLANTED_LEAK")
CLASSES = ("g", "l", "d", "unrepairable")


def capture(diagnostics: DataFrame, commit: str) -> DataFrame:
    """Gaps (signature, diag_code, rule_path, occurrence_count, first_seen_commit) of a run's
    diagnostics (code, rule_path, shape, unknown_reasons): those of a code that can be repaired, and those that
    leave something unknown, by what they have in common."""
    d = diagnostics.where(F.col("code").isin(*REPAIRABLE) | (F.size("unknown_reasons") > 0)).withColumn("signature", gap_signature("code", "rule_path", "shape"))
    g = d.groupBy("signature").agg(F.min("code").alias("diag_code"), F.min("rule_path").alias("rule_path"), F.count("*").alias("occurrence_count"))
    return g.withColumn("first_seen_commit", F.lit(commit))


def min_fixture(source: str, still_fails: Callable[[str], bool], max_bytes: int) -> str:
    """The smallest part of a source's lines that still shows the gap; ValueError if it can't be had in max_bytes."""
    if not still_fails(source):
        raise ValueError("the source doesn't show the gap")
    found = "".join(shrink(source.splitlines(keepends=True), lambda lines: still_fails("".join(lines))))
    if len(found.encode()) > max_bytes:
        raise ValueError(f"{len(found.encode())} bytes, {max_bytes} at most")
    return found


def metrics(text: str) -> dict[str, float]:
    """edges=, facts= and ratio= of a harness's output; one that is missing is a ValueError."""
    out = {}
    for name, kind in (("edges", int), ("facts", int), ("ratio", float)):
        m = re.search(rf"(?:^|\s){name}=(\S+)", text)
        try:
            out[name] = kind(m[1])
        except (TypeError, ValueError):
            raise ValueError(f"no {name}= metric") from None
    return out


def regressions(baseline: str, text: str) -> list[str]:
    """What of a run's metrics is below the baseline (JSON: dep_graph_edges, facts, extracted_semantics_ratio)."""
    base, now = json.loads(baseline), metrics(text)
    return [f"{n} {now[n]} < {base[k]}" for n, k in (("edges", "dep_graph_edges"), ("facts", "facts"), ("ratio", "extracted_semantics_ratio")) if now[n] + 1e-12 < base[k]]


def regressed(baseline: DataFrame, now: DataFrame) -> DataFrame:
    """(metric, was, is) of metrics (metric, value) that fell, or that the run hasn't."""
    j = baseline.select("metric", F.col("value").alias("was")).join(now.select("metric", F.col("value").alias("is")), "metric", "left")
    return j.where("is is null or is < was")


def dishonest(manifests: DataFrame) -> DataFrame:
    """(candidate, problem) of manifests (candidate, repair_class, signature, posture, resolved, extracted, unknown_reason)
    that don't stand: an unknown class, no signature, a weakened or missing posture, more diagnostics
    gone than semantics won, or a silenced unknown without a typed reason. The first that applies is named."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    p = (
        F.when(~F.coalesce(F.col("repair_class").isin(*CLASSES), F.lit(False)), "UnknownClass")
        .when(blank("signature"), "NoSignature")
        .when(blank("posture") | (F.col("posture") == "weakened"), "WeakPosture")
        .when((F.col("resolved") > 0) & (F.coalesce("extracted", F.lit(0)) < F.col("resolved")), "Suppression")
        .when((F.col("repair_class") == "d") & blank("unknown_reason"), "SilencedUnknown")
    )
    return manifests.select("candidate", p.alias("problem")).where("problem is not null")


_ALIAS = r"^(id_[0-9a-f]{12}|sx_[0-9a-f]{8})$"


def residue(texts: DataFrame, keywords: tuple[str, ...] = ()) -> DataFrame:
    """(name, problem) of texts (name, text) that may hold what is private: a planted marker in any case of
    letters, a word that is neither of the language nor a synthetic alias, or no readable text."""
    low = F.upper("text")
    marker = F.filter(F.array(*(F.lit(m) for m in MARKERS)), lambda m: F.contains(low, m))
    words = F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_$#]*)"), F.lit(1))
    known = [k.lower() for k in keywords]
    strange = F.filter(words, lambda w: ~F.lower(w).isin(*known) & ~w.rlike(_ALIAS)) if known else F.array().cast("array<string>")
    p = (
        F.when(F.col("text").isNull(), "Unreadable")
        .when(F.size(marker) > 0, F.concat(F.lit("Marker "), F.element_at(marker, 1)))
        .when(F.size(strange) > 0, F.concat(F.lit("Word "), F.element_at(strange, 1)))
    )
    return texts.select("name", p.alias("problem")).where("problem is not null")
