"""Literals: what they look like, and taking them out of sources."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SECRET = "password|passwd|pwd=|secret|api_key|apikey|access_key|token|bearer |private key|credential"
_SQL = "select|insert|update|delete|merge|create|alter|drop|grant|revoke|begin|declare|execute|truncate|with"
_URL = "https?://|ftp://|jdbc:|ldaps?://|tcps?://|file://"
_DATE = r"^(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}-[A-Za-z]{3}-\d{4})([ T]\d{1,2}:\d{1,2}(:\d{1,2})?([.+][^ T]*)?Z*)?$"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def classify(c: str = "value") -> Column:
    """CredentialLike, SqlLike, UrlLike, DateTime, Numeric, FreeText or Unknown, the first that fits."""
    t = F.trim(F.col(c))
    low = F.lower(t)
    return (
        F.when(t == "", "Unknown")
        .when(low.rlike(_SECRET), "CredentialLike")
        .when(low.rlike(f"^({_SQL})([^a-z0-9_]|$)"), "SqlLike")
        .when(low.rlike(f"^({_URL})"), "UrlLike")
        .when(t.rlike(_DATE), "DateTime")
        .when(t.rlike(_NUMBER), "Numeric")
        .when(t.rlike(r"[A-Za-z]") & t.rlike(r"\S\s+\S"), "FreeText")
        .otherwise("Unknown")
    )


CLASSIFY_SQL = f"""CASE WHEN t = '' THEN 'Unknown' WHEN regexp_matches(lower(t), '{_SECRET}') THEN 'CredentialLike' WHEN regexp_matches(lower(t), '^({_SQL})([^a-z0-9_]|$)') THEN 'SqlLike'
WHEN regexp_matches(lower(t), '^({_URL})') THEN 'UrlLike' WHEN regexp_matches(t, '{_DATE}') THEN 'DateTime' WHEN regexp_matches(t, '{_NUMBER}') THEN 'Numeric'
WHEN regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '\\S\\s+\\S') THEN 'FreeText' ELSE 'Unknown' END"""

_TOKEN = re.compile(r"--[^\n]*|/\*.*?\*/|[nN]?[qQ]'(?:\[.*?\]|\{.*?\}|\(.*?\)|<.*?>|([^\s\[({<]).*?\1)'|'(?:[^']|'')*'|'(?:[^']|'')*\Z|/\*.*\Z|\b\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\b|[A-Za-z_][A-Za-z0-9_$#]*|\s+|.", re.S)


def scrub_text(text: str, longest: int = 0) -> tuple[str, int, int]:
    """(text, strings, numbers taken out): string literals longer than `longest` become '<S>', numbers
    0; comments stay, and an unclosed literal always goes."""
    out, strings, numbers = [], 0, 0
    for m in _TOKEN.finditer(text or ""):
        t = m.group(0)
        if t.startswith(("--", "/*")):
            out.append(t)
        elif t[0] == "'" or t[:2].lower() in ("q'", "n'") or t[:3].lower() == "nq'":
            open_ = t[0] == "'" and (len(t) == 1 or not t.endswith("'") or len(t.replace("''", "")) < 2)
            body = t[t.index("'") + 1 : -1]
            if open_ or len(body) > longest:
                out.append("'<S>'")
                strings += 1
            else:
                out.append(t)
        elif t[0].isdigit():
            out.append("0")
            numbers += 1
        else:
            out.append(t)
    return "".join(out), strings, numbers


RESERVED = frozenset("select from where and or not null is in into values insert update delete merge using set on join begin end if then else elsif loop for while exit when return function procedure package body create replace as type table view index trigger exception raise declare cursor open fetch close commit rollback varchar2 number date boolean integer constant default out nocopy sysdate dual order by group having union all distinct exists between like case".split())


def rename_text(text: str, salt: str) -> tuple[str, int]:
    """(text, identifiers renamed): each becomes id_ and a salted hash of its lower case; reserved words,
    literals and comments stay."""
    n = 0

    def one(m: re.Match) -> str:
        nonlocal n
        t = m.group(0)
        if re.match(r"[A-Za-z_]", t) and not re.match(r"[nN]?[qQ]?'", t) and t.lower() not in RESERVED and "'" not in t:
            n += 1
            return "id_" + hashlib.sha256((salt + t.lower()).encode()).hexdigest()[:10]
        return t

    return _TOKEN.sub(one, text or ""), n


def shape_text(text: str) -> str:
    """The kinds of a text's tokens: W word, K reserved word, S string, N number, C comment, or the sign itself."""
    out = []
    for m in _TOKEN.finditer(text or ""):
        t = m.group(0)
        if t.isspace():
            continue
        k = "C" if t.startswith(("--", "/*")) else "S" if "'" in t else "N" if t[0].isdigit() else "K" if t.lower() in RESERVED else "W" if re.match(r"[A-Za-z_]", t) else t
        out.append(k)
    return " ".join(out)


def _mapped(df: DataFrame, fn, schema: str, text_col: str) -> DataFrame:
    from .. import ship

    ship(df.sparkSession)
    names = [p.split()[0] for p in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [fn(t) for t in p[text_col]]
            p = p.drop(columns=[text_col])
            for i, n in enumerate(names):
                p[n] = [r[i] for r in rows]
            yield p

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text_col)
    return df.mapInPandas(run, f"{kept}, {schema}")


def scrub(df: DataFrame, longest: int = 0, text_col: str = "text") -> DataFrame:
    return _mapped(df, lambda t: scrub_text(t, longest), "scrubbed string, strings long, numbers long", text_col)


def rename(df: DataFrame, salt: str, text_col: str = "text") -> DataFrame:
    return _mapped(df, lambda t: rename_text(t, salt), "renamed string, identifiers long", text_col)


def shapes(df: DataFrame, text_col: str = "text") -> DataFrame:
    return _mapped(df, lambda t: (shape_text(t),), "shape string", text_col)


def apply_rules(c: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(text, number of rules that hit): replacements in order, without regard to case."""
    hits = F.lit(0).cast("long")
    for find, put in rules:
        pattern = "(?i)" + re.escape(find)
        hits = hits + c.rlike(pattern).cast("long")
        c = F.regexp_replace(c, pattern, put.replace("\\", "\\\\").replace("$", "\\$"))
    return c, hits


def delta(df: DataFrame, rules: list[tuple[str, str]], text_col: str = "text") -> DataFrame:
    """What a redaction did to each text: hashes and sizes before and after, rules that hit."""
    new, hits = apply_rules(F.col(text_col), rules)
    return df.select("unit", F.sha2(text_col, 256).alias("before"), F.sha2(new, 256).alias("after"), F.octet_length(text_col).cast("long").alias("bytes_before"), F.octet_length(new).cast("long").alias("bytes_after"), hits.alias("rules_hit"))


def verify_delta(df: DataFrame, manifest: DataFrame, rules: list[tuple[str, str]], text_col: str = "text") -> DataFrame:
    """Units whose redaction, done again, isn't what the manifest says."""
    return delta(df, rules, text_col).select("unit", "before", "after").exceptAll(manifest.select("unit", "before", "after")).select("unit").distinct()


def shrink(chunks: list[str], fails) -> list[str]:
    """A smallest list of chunks that still fails, by delta debugging (on the driver: each try needs the last)."""
    n = 2
    while len(chunks) > 1:
        size = -(-len(chunks) // n)
        parts = [chunks[i : i + size] for i in range(0, len(chunks), size)]
        for i in range(len(parts)):
            rest = [c for j, p in enumerate(parts) if j != i for c in p]
            if rest and fails(rest):
                chunks, n = rest, max(n - 1, 2)
                break
        else:
            if n >= len(chunks):
                break
            n = min(len(chunks), 2 * n)
    return chunks
