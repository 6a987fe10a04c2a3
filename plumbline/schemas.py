"""Row types of the estate model, and its one scale of confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = "edge_id long, src long, dst long, kind string, conf_level string, conf_explanation string, prov string, evidence string"
NODE = "node_id long, logical_id string, persistent_id string, identity_kind string"
FACT = "fact_id string, kind string, component string, component_version string, run_id string, source_logical_id string, source_file string, payload string"
FINDING = "rule_id string, severity string, message string, file string, line int, span_start int, span_end int, conf_level string, unit string"
CHANGE = "kind string, object_id string, detail string"

#: High to Opaque as 3 to 0; tiers of paths: High is exact, Medium heuristic, all else unknown.
LEVELS = {"High": 3, "Medium": 2, "Low": 1, "Opaque": 0}
TIERS = {2: "Exact", 1: "Heuristic", 0: "Unknown"}
SEVERITIES = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1, "Info": 0}


def choose(c, values: dict, otherwise=None) -> Column:
    """The value a constant maps to."""
    c = F.col(c) if isinstance(c, str) else c
    out = None
    for k, v in values.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(otherwise)) if out is not None else F.lit(otherwise)


def conf_rank(level="conf_level") -> Column:
    return choose(level, LEVELS, 0)


def tier(level="conf_level") -> Column:
    """2, 1 or 0."""
    return choose(level, {"High": 2, "Medium": 1}, 0)


def key(name) -> Column:
    """What names are joined on: trimmed, upper case."""
    return F.upper(F.trim(F.col(name) if isinstance(name, str) else name))


def compatible(producer: str, consumer: str) -> str:
    """Whether an output of one schema version can be read by a reader of another: the major decides;
    a newer minor is read with its additions unknown; patches don't matter."""
    p, c = (tuple(int(x) for x in v.split(".")[:2]) for v in (producer, consumer))
    return "Incompatible" if p[0] != c[0] else "ForwardCompatible" if p[1] > c[1] else "Compatible"
