"""Column functions over symbols, paths, hunks and texts; all built in, so that they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CALLABLE = ("function", "method", "class", "struct", "enum")
TEST_FOLDERS = ("tests", "test", "__tests__", "spec", "__mocks__")
TEST_ENDINGS = ("_test.go", "_test.py", ".test.ts", ".test.tsx", ".test.js", ".test.jsx", ".spec.ts", ".spec.tsx", ".spec.js", ".spec.jsx")
FRAMEWORK_STEMS = ("page", "route", "layout", "loading", "error", "middleware", "server")
SOURCE_EXTENSIONS = ("rs", "ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "go")
IGNORED_FOLDERS = ("target", "node_modules", ".git", "dist", "build", "vendor")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- paths
def parent_dir(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"^(.*)/[^/]*$", 1)


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"([^/]*)$", 1)


def extension(path: Column | str) -> Column:
    return F.regexp_extract(base_name(path), r"\.([^.]*)$", 1)


def stem(path: Column | str) -> Column:
    """The second last dotted part of the base name, '' where it has no dot."""
    return F.coalesce(F.try_element_at(F.split(base_name(path), r"\."), F.lit(-2)), F.lit(""))


def component_suffix(a: Column | str, b: Column | str) -> Column:
    """Whether the shorter path is the end of the longer one, component by component."""
    x, y = F.split(col(a), "/"), F.split(col(b), "/")
    n = F.least(F.size(x), F.size(y))
    return F.slice(x, -n, n) == F.slice(y, -n, n)


def repository_path(path: Column | str) -> Column:
    """A path as the files table spells it: without `a/`, `b/`, `./` and leading slashes; null for /dev/null."""
    p = F.regexp_replace(F.regexp_replace(F.trim(col(path)), r"\\", "/"), r"^(\./|[ab]/|/)+", "")
    return F.when(col(path).isNull() | (F.trim(col(path)) == "/dev/null"), F.lit(None)).otherwise(p)


def in_scope_map(file: Column | str, scope: str) -> Column:
    """Equal, below, or any component equal."""
    return (col(file) == scope) | col(file).startswith(scope + "/") | F.array_contains(F.split(col(file), "/"), scope)


def in_scope_find(file: Column | str, scope: str) -> Column:
    s = "/".join(p for p in scope.replace("\\", "/").split("/") if p not in ("", "."))
    return F.lit(True) if not s else (col(file) == s) | col(file).startswith(s + "/")


def in_scope_missing(file: Column | str, scope: str) -> Column:
    s = scope.strip()
    while s.startswith("./"):
        s = s[2:]
    s = s.strip("/")
    return F.lit(True) if s in ("", ".") else (col(file) == s) | col(file).startswith(s + "/")


def ignored_folder(path: Column | str) -> Column:
    return F.arrays_overlap(F.split(col(path), "/"), F.array(*map(F.lit, IGNORED_FOLDERS)))


# -- names
def leaf(name: Column | str) -> Column:
    """After the last `::`."""
    return F.substring_index(col(name), "::", -1)


def index_names(name: Column | str) -> Column:
    """The names a symbol is found by: its own, after the last `::`, after the last `.` where that has no `::`."""
    n = col(name)
    dotted = F.substring_index(n, ".", -1)
    return F.array_distinct(F.array(n, leaf(n), F.when(dotted.contains("::"), n).otherwise(dotted)))


def mention_name(name: Column | str) -> Column:
    return F.element_at(F.split(col(name), "[:.]"), -1)


def named(name: Column | str, target: str) -> Column:
    return (col(name) == target) | col(name).endswith("::" + target) | col(name).endswith("." + target)


def coordinate(file: Column | str = "file", name: Column | str = "name") -> Column:
    return F.concat_ws(":", col(file), col(name))


def line_coordinate(file: Column | str = "file", start: Column | str = "start_line", end: Column | str = "end_line") -> Column:
    return F.concat(col(file), F.lit(":#L"), col(start).cast("string"), F.lit("-"), F.coalesce(col(end), col(start)).cast("string"))


# -- predicates over symbols
def is_callable(kind: Column | str = "kind") -> Column:
    return col(kind).isin(*CALLABLE)


def is_test(file: Column | str = "file", name: Column | str = "name") -> Column:
    base = base_name(file)
    ending = F.lit(False)
    for e in TEST_ENDINGS:
        ending = ending | base.endswith(e)
    starts = lambda c: c.startswith("test_") | c.startswith("Test")
    return F.arrays_overlap(F.split(col(file), "/"), F.array(*map(F.lit, TEST_FOLDERS))) | ending | starts(base) | starts(leaf(name))


def is_program_entry(name: Column | str = "name") -> Column:
    return (col(name) == "main") | col(name).endswith("::main")


def is_exported(file: Column | str = "file", name: Column | str = "name", signature: Column | str = "signature") -> Column:
    s, f, n = col(signature), col(file), col(name)
    first = F.substring(n, 1, 1)
    upper = (F.upper(first) == first) & (F.lower(first) != first)
    return s.startswith("pub ") | s.startswith("pub(") | s.startswith("export ") | (f.endswith(".go") & upper) | (f.endswith(".py") & ~n.startswith("_"))


def is_framework_entry(file: Column | str = "file", name: Column | str = "name", kind: Column | str = "kind", signature: Column | str = "signature") -> Column:
    s, n = stem(file), col(name)
    last = F.substring_index(leaf(name), ".", -1)
    router = (last == "appRouter") | (last == "router") | last.endswith("Router") | n.startswith("appRouter::") | n.startswith("appRouter.")
    barrel = (s == "index") | ((s == "mod") & ((col(kind) == "type") | col(signature).startswith("pub ")))
    return s.isin(*FRAMEWORK_STEMS) | router | barrel


def multiplicity_weight(n: Column | str) -> Column:
    """min(sqrt(max(n, 1)), 8)"""
    return F.least(F.sqrt(F.greatest(F.coalesce(col(n), F.lit(1)), F.lit(1)).cast("double")), F.lit(8.0))


# -- texts
def lines(text: Column | str) -> Column:
    """The lines of a text: split at line feeds, a carriage return before them dropped, no empty line after the last."""
    t = F.regexp_replace(col(text), r"\r?\n\z", "")
    return F.when(col(text).isNull() | (col(text) == ""), F.array().cast("array<string>")).otherwise(F.split(t, r"\r?\n", -1))


def token_estimate(text: Column | str, file: Column | str) -> Column:
    per = F.when(extension(file).isin("rs", "go"), 3).when(extension(file) == "py", 5).otherwise(4)
    return F.ceil(F.octet_length(col(text)) / per)


def truncated_body(body: Column | str, span: Column | str, limit: int = 250, head: int = 200, tail: int = 30) -> Column:
    """A long body with its middle left out."""
    x = lines(body)
    n = F.size(x)
    cut = F.concat(F.array_join(F.slice(x, 1, head), "\n"), F.lit("\n\n// ... ["), (n - head - tail).cast("string"), F.lit(" lines truncated for token efficiency] ...\n\n"), F.array_join(F.slice(x, -tail, tail), "\n"))
    return F.when((col(span) <= limit) | (n <= head + tail), col(body)).otherwise(cut)


def compact_signature(signature: Column | str, most: int = 120) -> Column:
    s = F.trim(F.regexp_replace(col(signature), r"\s+", " "))
    return F.when(F.length(s) > most, F.concat(F.left(s, F.lit(most)), F.lit("…"))).otherwise(s)


def hunk_range(header: Column | str) -> Column:
    """(first, last) line of the new side of a hunk header, null where it is none; an empty side is the line before."""
    start = F.regexp_extract(col(header), r"^@@ (?:\S+ +)*?\+(\d+)(?:,\d+)?(?: .*)? @@|^@@ (?:\S+ +)*?\+(\d+)(?:,\d+)? @@", 0)
    first = F.regexp_extract(start, r"\+(\d+)", 1).try_cast("long")
    count = F.coalesce(F.regexp_extract(start, r"\+\d+,(\d+)", 1).try_cast("long"), F.lit(1).cast("long"))
    low = F.greatest(first, F.lit(1).cast("long"))
    return F.when(first.isNull(), F.lit(None)).otherwise(F.struct(low.alias("first"), F.when(count == 0, low).otherwise(low + count - 1).alias("last")))


def percent(part: Column | str, whole: Column | str) -> Column:
    """Integer percentage, 100 of nothing."""
    return F.when(col(whole) == 0, F.lit(100).cast("long")).otherwise(F.floor(col(part) * 100 / col(whole)).cast("long"))
