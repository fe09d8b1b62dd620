"""Problem 5: source files that do not parse.

Each file is read by the recursive-descent recogniser of its extension's language; its statements are guarded one by one,
so that a fault is stored and reading goes on at the next statement. All faults are kept, the first is the cause.
"""

from __future__ import annotations

import keyword
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm.syntax import ecma, golang, python, rust
from symloom.llm.syntax.inner import unfold_fstrings, unfold_templates
from symloom.util import spread, table

LANGUAGES = {"py": "python", "rs": "rust", "go": "go", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript"}
RESULT = "file_id long, repo_id long, extension string, language string, valid boolean, faults array<struct<line:int,message:string>>"


_PLAIN = re.compile(r"\s*[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*\s*")
_WORDS = frozenset(keyword.kwlist) - {"None", "True", "False"}


@lru_cache(maxsize=50_000)
def _inner(expression: str, extension: str) -> str | None:
    """The fault of an expression inside a string, or None."""
    if _PLAIN.fullmatch(expression) and not _WORDS & set(expression.replace(".", " ").split()):
        return None
    found = python.check(f"({expression},)" if expression.strip() else "(,)") if extension == "py" else ecma.check(f"({expression}\n)", extension)
    return found[0][1] if found else None


def faults(text: str | None, extension: str) -> list[tuple[int, str]]:
    """(line, message) of every fault of a file, in order; none for an empty one. Expressions inside templates and f-strings
    are parsed as well."""
    text = (text or "").removeprefix("﻿")
    if not text.strip():
        return []
    inner: list[tuple[int, str]] = []
    if extension == "py":
        text, inner = unfold_fstrings(text)
        found, lang = python.check(text), python.PY
    elif extension == "rs":
        found, lang = rust.check(text), rust.RS
    elif extension == "go":
        found, lang = golang.check(text), golang.GO
    else:
        text, inner = unfold_templates(text)
        found, lang = ecma.check(text, extension), ecma.JS
    broken = [(text.count("\n", 0, at) + 1, message) for at, x in inner if (message := _inner(x, extension))]
    if not found:
        return sorted(broken)
    starts = [m.start(1) for m in lang.pattern.finditer(text)]
    out, line, seen = [], 1, 0
    for token, message in found:
        at = starts[token] if token < len(starts) else len(text)
        line += text.count("\n", seen, at)
        seen = at
        out.append((line, message))
    return sorted([*out, *broken]) if broken else out


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sys.setrecursionlimit(60_000)
    for b in batches:
        rows = []
        for fid, repo, extension, text in zip(b["file_id"], b["repo_id"], b["extension"], b["content"]):
            found = faults(text, extension)
            rows.append((fid, repo, extension, LANGUAGES[extension], not found, [{"line": n, "message": m} for n, m in found]))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])


def parse_files(files: DataFrame) -> DataFrame:
    """file_id, repo_id, extension, language, valid, faults (line, message), cause of each file of a known extension.

    The extension is that of the path, in lower case; files of others (and a null path) give no row. Null and empty
    contents are valid, as are a byte-order mark and CRLF. Nesting beyond 1,500 levels is a fault. Redelivered rows count
    once."""
    rows = files.where(F.col("file_id").isNotNull()).withColumn("extension", F.lower(F.element_at(F.split("path", r"\."), -1))).where(F.col("extension").isin(*LANGUAGES))
    rows = spread(rows.select(F.col("file_id").cast("long"), F.col("repo_id").cast("long"), "extension", "content"))
    found = rows.mapInPandas(_check, RESULT).dropDuplicates(["file_id"])
    return found.withColumn("cause", F.try_element_at("faults", F.lit(1)))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return parse_files(table(spark, folder, "files")).where("not valid").select("file_id")


def p5_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Files, invalid files and their share, by repository and language."""
    by = parse_files(table(spark, folder, "files")).groupBy("repo_id", "language")
    counted = by.agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("valid")).alias("invalid"))
    return counted.withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))


def p5_causes(spark: SparkSession, folder: str) -> DataFrame:
    """Every fault of the invalid files, with the first marked."""
    rows = parse_files(table(spark, folder, "files")).where("not valid").select("file_id", "language", F.posexplode("faults").alias("at", "fault"))
    return rows.select("file_id", "language", (F.col("at") == 0).alias("first"), "fault.line", "fault.message")


QUERIES = {"p5_found": p5_found, "p5_rates": p5_rates, "p5_causes": p5_causes}
SQL: dict[str, str] = {}
