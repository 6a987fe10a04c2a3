"""Reading a project: files, their pairs, scripts and conditional text."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship

EXTENSIONS = ("sql", "pks", "pkb", "pls", "plb", "trg", "vw", "typ")


def manifest(path: str) -> dict:
    """A project's TOML manifest."""
    with open(path, "rb") as f:
        return tomllib.load(f)


def discover(spark: SparkSession, root: str, ignore: tuple = ()) -> DataFrame:
    """(rel_path, extension, size, text) of the source files under a folder, once each; paths that hold
    an ignored string are left out. The names are filtered before any content is read."""
    glob = "*.{" + ",".join(EXTENSIONS) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    for part in ignore:
        files = files.where(~F.contains("path", F.lit(part)))
    base = re.sub(r"^file:/*", "/", root).rstrip("/") + "/"
    rel = F.regexp_replace("path", "^.*?" + re.escape(base.lstrip("/")), "")
    return files.select(rel.alias("rel_path"), F.lower(F.substring_index("path", ".", -1)).alias("extension"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("text"))


def pairs(files: DataFrame) -> DataFrame:
    """Package specifications and bodies of one base name: complete, or one without the other."""
    base = F.lower(F.regexp_replace("rel_path", r"\.[^.]*$", ""))
    p = files.where(F.col("extension").isin("pks", "pkb")).groupBy(base.alias("base")).agg(F.max(F.when(F.col("extension") == "pks", F.col("rel_path"))).alias("spec"), F.max(F.when(F.col("extension") == "pkb", F.col("rel_path"))).alias("body"))
    return p.withColumn("status", F.when(F.col("body").isNull(), "OrphanSpec").when(F.col("spec").isNull(), "OrphanBody").otherwise("Complete"))


def wrapped(c: str = "text"):
    """Obfuscated source: within the first 64 lines and 4096 characters, a line with an object's keyword ends in WRAPPED."""
    head = F.slice(F.split(F.substring(c, 1, 4096), "\n"), 1, 64)
    return F.exists(head, lambda x: F.upper(F.rtrim(x)).rlike(r"\b(PACKAGE|PROCEDURE|FUNCTION|TYPE)\b.*\bWRAPPED\s*$"))


def snapshot(spark: SparkSession, path: str, schema: str, version: str = "1") -> DataFrame:
    """A versioned JSON document of catalog rows; another major version is an error."""
    df = spark.read.schema(f"schema_version string, rows array<struct<{schema}>>").option("multiLine", True).json(path)
    bad = df.where(~F.startswith("schema_version", F.lit(version))).take(1)
    if bad:
        raise ValueError(f"snapshot version {bad[0]['schema_version']}, not {version}")
    return df.select(F.inline("rows"))


def ddl_folder(spark: SparkSession, root: str) -> DataFrame:
    """(object_type, owner, name, text) of exported definitions, by their first statement."""
    t = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(root)
    head = r'(?is)create\s+(?:or\s+replace\s+)?(?:editionable\s+|noneditionable\s+|force\s+)*(package\s+body|type\s+body|materialized\s+view|table|view|package|procedure|function|trigger|type|sequence|index|synonym)\s+(?:"?([A-Za-z0-9_$#]+)"?\.)?"?([A-Za-z0-9_$#]+)"?'
    get = lambda i: F.regexp_extract("value", head, i)
    return t.select(F.upper(F.regexp_replace(get(1), r"\s+", " ")).alias("object_type"), F.nullif(F.upper(get(2)), F.lit("")).alias("owner"), F.upper(get(3)).alias("name"), F.col("value").alias("text")).where("name <> ''")


_DIRECTIVE = re.compile(r"^\s*(set|prompt|spool|define|undefine|whenever|show|connect|exit|quit|rem|remark|column|accept|pause|alter\s+session)\b", re.I)
_BLOCK = re.compile(r"^\s*(create\s+(or\s+replace\s+)?((non)?editionable\s+)?(package|procedure|function|trigger|type)\b|declare\b|begin\b)", re.I)


def split_script(text: str) -> list[tuple[int, str, str, bool]]:
    """(line, kind, text, has_variable) of a script's statements: sql to a semicolon, blocks to a lone
    slash, directives and includes by line. Strings and comments hide what they hold."""
    out: list[tuple[int, str, str, bool]] = []
    buf: list[str] = []
    start = 0
    state = ""  # of an open string or comment

    def add(kind: str, body: str, line: int) -> None:
        if body.strip():
            out.append((line, kind, body.strip(), bool(re.search(r"&&?\w", body))))

    for n, line in enumerate((text or "").split("\n"), 1):
        fresh = not "".join(buf).strip() and not state
        if fresh and re.match(r"^\s*@@?", line):
            add("include", line, n)
            continue
        if fresh and _DIRECTIVE.match(line):
            add("directive", line, n)
            continue
        if not state and line.strip() == "/":
            add("block" if _BLOCK.match("".join(buf).lstrip()) else "sql", "".join(buf), start)
            buf = []
            continue
        i = piece = 0
        while i < len(line):
            two = line[i : i + 2]
            if state == "'":
                if line[i] == "'":
                    if two == "''":
                        i += 1
                    else:
                        state = ""
            elif state == "/*":
                if two == "*/":
                    state, i = "", i + 1
            elif two == "--":
                break
            elif two == "/*":
                state, i = "/*", i + 1
            elif line[i] == "'":
                state = "'"
            elif line[i] == ";" and not _BLOCK.match(("".join(buf) + line[piece:i]).lstrip()):
                if not "".join(buf).strip():
                    start = n
                add("sql", "".join(buf) + line[piece:i], start)
                buf, piece = [], i + 1
            i += 1
        if line[piece:].strip() or "".join(buf).strip():
            if not "".join(buf).strip():
                start = n
            buf.append(line[piece:] + "\n")
    add("block" if _BLOCK.match("".join(buf).lstrip()) else "sql", "".join(buf), start)
    return out


_COND = re.compile(r"\$(if|elsif|else|end|error|then)\b", re.I)


def _true(expr: str, flags: dict) -> bool | None:
    """The value of a condition of flags, comparisons, and, or, not; None if it can't be told."""
    words = re.findall(r"\$\$\w+|\w+(?:\.\w+)*|'[^']*'|<=|>=|<>|!=|[=<>()]", expr)
    code = []
    for w in words:
        low = w.lower()
        if low in ("and", "or", "not", "true", "false", "(", ")"):
            code.append({"true": "True", "false": "False"}.get(low, low))
        elif w in ("=", "<>", "!="):
            code.append("==" if w == "=" else "!=")
        elif w in ("<", ">", "<=", ">="):
            code.append(w)
        elif w[0] == "'" or w.isdigit():
            code.append(repr(w[1:-1]) if w[0] == "'" else w)
        else:
            if low.lstrip("$") not in flags:
                return None
            code.append(repr(flags[low.lstrip("$")]))
    try:
        return bool(eval(" ".join(code), {"__builtins__": {}}))  # noqa: S307 - only literals and operators built above
    except Exception:
        return None


def preprocess(text: str, flags: dict) -> tuple[str, int, list[str]]:
    """(text, inactive lines, errors): branches of $IF whose condition doesn't hold are blanked, lines
    kept, so that numbers stay. An unknown condition counts as false, and is an error."""
    flags = {k.lower(): v for k, v in flags.items()}
    out, errors, stack, inactive = [], [], [], 0
    for line in (text or "").split("\n"):
        kept, pos, blank = [], 0, False
        for m in list(_COND.finditer(line)):
            if m.start() < pos:
                continue
            live = all(s[0] for s in stack)
            kept.append(line[pos : m.start()] if live else "")
            blank = blank or (not live and bool(line[pos : m.start()].strip()))
            word, pos = m.group(1).lower(), m.end()
            if word in ("if", "elsif"):
                stop = re.search(r"\$then\b", line[pos:], re.I)
                cond = line[pos : pos + stop.start()] if stop else line[pos:]
                pos = pos + stop.end() if stop else len(line)
                value = _true(cond, flags)
                if value is None:
                    errors.append(f"unknown condition:{cond.strip()}")
                if word == "if":
                    stack.append([bool(value), bool(value)])
                elif stack:
                    stack[-1] = [bool(value) and not stack[-1][1], stack[-1][1] or bool(value)]
            elif word == "else" and stack:
                stack[-1] = [not stack[-1][1], True]
            elif word == "error" and live:
                errors.append("error directive:" + line[pos:].replace("$END", "").replace("$end", "").strip())
                stack.append([False, True])
            elif word == "error":
                stack.append([False, True])
            elif word == "end":
                if stack:
                    stack.pop()
                else:
                    errors.append("end without if")
        live = all(s[0] for s in stack)
        kept.append(line[pos:] if live else "")
        blank = blank or (not live and bool(line[pos:].strip()))
        inactive += blank
        out.append("".join(kept))
    if stack:
        errors.append("if without end")
    return "\n".join(out), inactive, errors


def variants(text: str, most: int = 32) -> tuple[list[dict], bool]:
    """(assignments of the flags that conditions use, whether there are more than `most`)."""
    names = sorted({m.lower() for m in re.findall(r"\$\$(\w+)", text or "")})
    every = list(product((True, False), repeat=min(len(names), 16)))
    return [dict(zip(names, v)) for v in every[:most]], len(every) > most or len(names) > 16


_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
#: Rows that are sent on at once, however many a batch of texts gives.
_ROWS = 20_000


def _table(df: DataFrame, fn, schema: str, key: str) -> DataFrame:
    """What fn gives for each text, rows of the schema's columns, behind the text's key."""
    ship(df.sparkSession)
    names, types = zip(*(p.split() for p in schema.split(", ")))

    def send(keys: pa.Array, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, _ARROW[t]) for c, t in zip(zip(*rows), types)]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int32())), *columns], names=[key, *names])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            at: list[int] = []
            rows: list[tuple] = []
            for i, t in enumerate(p.column(1)):
                got = fn(t.as_py())
                for j in range(0, len(got), _ROWS):
                    some = got[j : j + _ROWS]
                    rows += some
                    at += [i] * len(some)
                    if len(rows) >= _ROWS:
                        yield send(p.column(0), at, rows)
                        at, rows = [], []
            if rows:
                yield send(p.column(0), at, rows)

    return df.select(key, "text").mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, {schema}")


def statements(files: DataFrame, key: str = "rel_path") -> DataFrame:
    """The statements of scripts, numbered."""
    return _table(files, lambda t: [(i, *s) for i, s in enumerate(split_script(t), 1)], "ordinal long, line long, kind string, statement string, has_variable boolean", key)


def preprocessed(files: DataFrame, flags: dict, key: str = "rel_path") -> DataFrame:
    return _table(files, lambda t: [(lambda r: (r[0], r[1], "; ".join(r[2])))(preprocess(t, flags))], "active string, inactive_lines long, errors string", key)


def variant_rows(files: DataFrame, key: str = "rel_path") -> DataFrame:
    def rows(t: str):
        v, more = variants(t)
        return [(i, " ".join(f"{k}={str(x).lower()}" for k, x in a.items()), more) for i, a in enumerate(v, 1)]

    return _table(files, rows, "variant long, flags string, truncated boolean", key)


def parse_diff(text: str) -> list[tuple[str, str, int, int]]:
    """(change, path, lines added, removed) of a unified diff. What is no diff is one row, with the change
    Error and, for the path, the line and what is wrong with it: one bad text doesn't end the others' reading."""
    try:
        return _parse_diff(text)
    except ValueError as e:
        return [("Error", str(e), 0, 0)]


def _parse_diff(text: str) -> list[tuple[str, str, int, int]]:
    out: list[list] = []
    old = None
    left = [0, 0]
    for n, line in enumerate((text or "").split("\n"), 1):
        if left[0] > 0 or left[1] > 0:
            if line[:1] == "+":
                left[1] -= 1
                out[-1][2] += 1
            elif line[:1] == "-":
                left[0] -= 1
                out[-1][3] += 1
            elif line[:1] in (" ", ""):
                left = [left[0] - 1, left[1] - 1]
            elif not line.startswith("\\"):
                raise ValueError(f"line {n}: not a line of a hunk")
        elif line.startswith("--- "):
            old = re.sub(r"^[ab]/", "", line[4:].split("\t")[0].strip())
        elif line.startswith("+++ "):
            if old is None:
                raise ValueError(f"line {n}: new file without an old one")
            new = re.sub(r"^[ab]/", "", line[4:].split("\t")[0].strip())
            out.append(["Created" if old == "/dev/null" else "Dropped" if new == "/dev/null" else "Body", old if new == "/dev/null" else new, 0, 0])
            old = None
        elif line.startswith("@@"):
            m = re.match(r"^@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@", line)
            if not m or not out:
                raise ValueError(f"line {n}: bad hunk header")
            left = [int(x) if x is not None else 1 for x in m.groups()]
    return [tuple(r) for r in out]


def diffs(df: DataFrame, key: str = "rel_path") -> DataFrame:
    return _table(df, parse_diff, "change string, path string, added long, removed long", key)
