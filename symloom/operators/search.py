"""Searching symbols, files and texts for terms; what is missing; which symbol encloses a line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions import columns as C


def terms(pattern: str) -> list[str]:
    """A pattern's terms in lower case: split at `|`, and at `,` outside brackets."""
    out = []
    for part in pattern.split("|"):
        depth, held = 0, ""
        for c in part:
            depth += (c in "([{<") - (c in ")]}>" and depth > 0)
            if c == "," and not depth:
                out.append(held)
                held = ""
            else:
                held += c
        out.append(held)
    return [t for t in (x.strip().lower() for x in out) if t]


def _any(values: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, values, F.lit(False))


def find_symbols(syms: DataFrame, wanted: list[str]) -> DataFrame:
    """Symbols whose name holds a term, exact names first, then by centrality and the length of the name."""
    name = F.lower("name")
    rows = syms.where(_any([name.contains(t) for t in wanted]))
    return rows.withColumn("exact", _any([name == t for t in wanted])).withColumn("bytes", F.octet_length("name"))


def find_files(files: DataFrame, wanted: list[str]) -> DataFrame:
    return files.where(_any([F.lower("path").contains(t) for t in wanted]))


def text_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1), text of every line."""
    return texts.select(key, F.posexplode(C.lines(text)).alias("line", "text")).withColumn("line", F.col("line") + 1)


def literal_hits(files: DataFrame, wanted: list[str]) -> DataFrame:
    """file_id, line, term: the lines that hold a term, without regard to case."""
    rows = text_lines(files.where(_any([F.lower("content").contains(t) for t in wanted])), "file_id", "content")
    hit = rows.select("file_id", "line", "text", F.explode(F.array(*[F.lit(t) for t in wanted])).alias("term"))
    return hit.where(F.lower("text").contains(F.col("term"))).select("file_id", "line", "term")


def enclosing(hits: DataFrame, syms: DataFrame) -> DataFrame:
    """The hits (file_id, line, ...) with sid of the innermost symbol around the line, null where there is none; the least
    span wins, then the least sid."""
    s = syms.select("file_id", "sid", "start_line", F.coalesce("end_line", "start_line").alias("stop"))
    held = hits.join(s, "file_id", "left")
    inside = F.when((F.col("start_line") <= F.col("line")) & (F.col("stop") >= F.col("line")), F.struct((F.col("stop") - F.col("start_line")).alias("span"), "sid"))
    return held.groupBy(*hits.columns).agg(F.min(inside).alias("m")).select(*hits.columns, F.col("m.sid").alias("sid"))


def unmatched(wanted: list[str], syms: DataFrame, files: DataFrame) -> DataFrame:
    """The terms that no symbol's name and no path holds; one pass over each table, a flag a term."""
    flag = lambda df, column: df.agg(*[F.coalesce(F.bool_or(F.lower(column).contains(t)), F.lit(False)).alias(f"t{i}") for i, t in enumerate(wanted)])
    both = flag(syms, "name").unionByName(flag(files, "path"))
    rows = both.agg(*[F.bool_or(f"t{i}").alias(f"t{i}") for i in range(len(wanted))])
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"t{i}").alias("seen")) for i, t in enumerate(wanted)]))
    return rows.select(pairs.alias("x")).where(~F.col("x.seen")).select("x.term")


def find(syms: DataFrame, files: DataFrame, wanted: list[str]) -> DataFrame:
    """what (symbol, file, line), id, line, sid: symbols and files whose name or path holds a term, and of the terms that
    neither holds the lines that do, with the innermost symbol around them. files: file_id, path, content."""
    no = F.lit(None).cast("int").alias("line")
    a = find_symbols(syms, wanted).select(F.lit("symbol").alias("what"), F.col("sid").alias("id"), no, "sid")
    b = find_files(files, wanted).select(F.lit("file").alias("what"), F.col("file_id").alias("id"), no, F.lit(None).cast("long").alias("sid"))
    rest = literal_hits(files, wanted).join(unmatched(wanted, syms, files), "term", "left_semi").select("file_id", "line").distinct()
    c = enclosing(rest, syms).select(F.lit("line").alias("what"), F.col("file_id").alias("id"), "line", "sid")
    return a.unionByName(b).unionByName(c)


def missing(files: DataFrame, pattern: str, defines: str | None = None) -> DataFrame:
    """Files that hold none of the alternatives of pattern (split at `|`, case kept), of those that hold one of defines."""
    holds = lambda p: _any([F.col("content").contains(x) for x in p.split("|") if x])
    rows = files.where(F.col("content").isNotNull())
    return rows.where((holds(defines) if defines else F.lit(True)) & ~holds(pattern))


def sweep(files: DataFrame, literals: list[str]) -> DataFrame:
    """file_id, line, text: the trimmed lines that hold a literal, case kept."""
    rows = text_lines(files.where(_any([F.col("content").contains(x) for x in literals])), "file_id", "content")
    return rows.where(_any([F.col("text").contains(x) for x in literals])).select("file_id", "line", F.trim("text").alias("text"))


def line_slice(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """The ranges (file_id, first, last, ...) with the text of those lines: reversed ones are turned, the first is at least 1,
    the last at most the end of the file; a range past the end gives no row."""
    more = [c for c in ranges.columns if c not in ("file_id", "first", "last")]
    one = F.lit(1).cast("long")
    turned = ranges.select("file_id", *more, F.greatest(F.least("first", "last"), one).alias("a"), F.greatest("first", "last", one).alias("b"))
    rows = turned.join(files.select("file_id", C.lines("content").alias("lines")), "file_id").where(F.col("a") <= F.size("lines"))
    last = F.least(F.col("b"), F.size("lines").cast("long"))
    text = F.array_join(F.slice("lines", F.col("a").cast("int"), (last - F.col("a") + 1).cast("int")), "\n")
    return rows.select("file_id", *more, F.col("a").alias("first"), last.alias("last"), text.alias("text"))


# A whole import statement of any of the languages, over as many lines as its brackets need.
IMPORT = (
    r"(?m)^[ \t]*(?:pub(?:\([a-z]+\))? )?use [^;]*;|^[ \t]*extern crate [^;\n]*;|^[ \t]*import \([^)]*\)"
    r"|^[ \t]*import\b[^'\"\n;({]*(?:\{[^}]*\})?[^'\"\n;]*['\"][^'\"\n]*['\"];?|^[ \t]*import [A-Za-z_][A-Za-z0-9_., ]*$"
    r"|^[ \t]*from [.A-Za-z0-9_]+ import (?:\([^)]*\)|(?:[^\n\\(]|\\\n)+)|^[ \t]*(?:const|let|var) [^=\n]*= require\([^)\n]*\);?"
)


def import_statements(files: DataFrame, most: int = 400) -> DataFrame:
    """file_id, place, text of the import statements that begin and end in the first `most` lines of a file, whole."""
    head = F.array_join(F.slice(C.lines("content"), 1, most), "\n")
    found = files.select("file_id", F.posexplode(F.regexp_extract_all(head, F.lit(IMPORT), F.lit(0))).alias("place", "text"))
    return found.select("file_id", (F.col("place") + 1).alias("place"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))


def import_header(files: DataFrame, most: int = 400) -> DataFrame:
    """The import statements, each on one line."""
    return import_statements(files, most).withColumn("text", F.regexp_replace("text", r"\s+", " "))


def budget_cut(texts: DataFrame, key: str, text: str, budget: int) -> DataFrame:
    """key, kept, lines: how many lines of a text fit into `budget` bytes; the first that doesn't cuts off the rest.

    The running sum is inside the row, so no line is shuffled."""
    n = F.transform(C.lines(text), lambda x: F.octet_length(x) + 1)
    step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), (acc["n"] + F.when(acc["sum"] + x <= budget, 1).otherwise(0)).alias("n"))
    kept = F.aggregate(n, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n")), step, lambda acc: acc["n"])
    return texts.select(key, kept.alias("kept"), F.size(n).alias("lines"))


def first_party(imports: DataFrame, patterns: DataFrame, packages: DataFrame) -> DataFrame:
    """The imports (with a column `spec`) that an alias pattern or a package of the workspace answers.

    patterns: prefix, suffix, wildcard; without a wildcard prefix is the whole spec. packages: package; a spec is the package
    or goes on with `/`. Specs meet the patterns by the prefixes they have, so nothing is compared pair by pair."""
    s = imports.select("spec").where("spec IS NOT NULL").distinct()
    starts = s.select("spec", F.explode(F.transform(F.sequence(F.lit(0), F.length("spec")), lambda n: F.left("spec", n))).alias("prefix"))
    ends = F.col("spec").endswith(F.col("suffix")) & (F.octet_length("spec") >= F.octet_length("prefix") + F.octet_length("suffix"))
    by_pattern = starts.join(patterns, "prefix").where(F.when(F.col("wildcard"), ends).otherwise(F.col("spec") == F.col("prefix"))).select("spec")
    parts = F.split("spec", "/")
    heads = s.select("spec", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("package"))
    known = by_pattern.unionByName(heads.join(packages.select("package").distinct(), "package").select("spec")).distinct()
    return imports.join(known, "spec", "left_semi")
