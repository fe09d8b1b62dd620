"""Symbols of source files: declarations with their owners and spans, references, imports and aliases.

One pass over the lines of a file with a stack of open containers finds the declarations, in Arrow batches; each gives one
row with its own code, strings and comments blanked. Calls, member calls, counts, mentions, imports and aliases are column
functions over these rows and over the import statements of a file. Patterns accept what people write in the first place:
a declaration that does not begin its line is not found.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions import columns as C
from symloom.operators.search import import_statements
from symloom.sources.store import changes
from symloom.util import spread, written

LANGUAGE = {"py": "py", "rs": "rs", "go": "go", **dict.fromkeys(("ts", "tsx", "js", "jsx", "mjs", "cjs"), "ts")}
DECLARED = "file_id long, path string, lang string, kind string, name string, start_line int, end_line int, signature string, code string"

# What is no code: strings and comments of each language; line breaks in them are kept.
_TEXT = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_BLANK = {
    "py": re.compile(rf"\"\"\"(?:[^\\]|\\.)*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\.)*?(?:'''|\Z)|{_TEXT}|\#[^\n]*", re.S),
    "rs": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\br(#*)\".*?\"\1|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\\n]|\\[^\n]{1,9}?)'", re.S),
    "go": re.compile(rf"//[^\n]*|/\*.*?(?:\*/|\Z)|`[^`]*`|{_TEXT}", re.S),
    "ts": re.compile(rf"//[^\n]*|/\*.*?(?:\*/|\Z)|`(?:[^`\\]|\\.)*`|{_TEXT}|(?<=[(=,:\[!&|?{{;])[ \t]*/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*", re.S),
}
_PUB = r"[ \t]*(?:pub(?:\([^)]*\))? +)?(?:default +)?"
_EXP = r"[ \t]*(?:export +)?(?:declare +)?(?:default +)?"
_NOT = r"(?!(?:if|for|while|switch|catch|return|function|super|await|do|else|with|new|throw|typeof)\b)"
# (kind, pattern with the name as its only group, container); the first that matches a line decides.
_HEADS = {
    "py": [("function", r"[ \t]*(?:async +)?def +(\w+)", False), ("class", r"[ \t]*class +(\w+)", True), ("constant", r"([A-Z][A-Z0-9_]*) *(?::[^=\n]+)?= *(?!=)", False), ("variable", r"(\w+) *(?::[^=\n]+)?= *[\w.]+\(", False), ("constant", r"(\w+) *(?::[^=\n]+)?= *(?!=)", False)],
    "rs": [("function", rf"{_PUB}(?:const +|async +|unsafe +|extern +(?:\"[^\"]*\" +)?)*fn +(\w+)", False), ("struct", rf"{_PUB}(?:struct|union) +(\w+)", False), ("enum", rf"{_PUB}enum +(\w+)", False), ("trait", rf"{_PUB}(?:unsafe +)?trait +(\w+)", True), ("type", rf"{_PUB}type +(\w+)", False), ("constant", rf"{_PUB}(?:const|static)(?: +mut)? +(\w+)", False), ("impl", r"[ \t]*(?:unsafe +)?impl\b(?: *<(?:[^<>]|<[^<>]*>)*>)? *(?:[^{\n]*? for +)?(?:&(?:'\w+ +)?)?(?:\w+::)*(\w+)", True), ("mod", rf"{_PUB}mod +(\w+)", True)],
    "go": [("function", r"func +(\w+)", False), ("method", r"func *\([^)]*?\*?(\w+)(?:\[[^\]]*\])?\) *(\w+)", False), ("struct", r"(?:type +|[ \t]+)(\w+)(?:\[[^\]]*\])? +struct\b", False), ("interface", r"(?:type +|[ \t]+)(\w+)(?:\[[^\]]*\])? +interface\b", False), ("type", r"type +(\w+)", False), ("constant", r"(?:const|var) +(\w+)", False), ("group", r"(const|var|type) *\(", True)],
    "ts": [("function", rf"{_EXP}(?:async +)?function *\*? *(\w+)", False), ("class", rf"{_EXP}(?:abstract +)?class +([\w$]+)", True), ("interface", rf"{_EXP}interface +([\w$]+)", False), ("enum", rf"{_EXP}(?:const +)?enum +([\w$]+)", False), ("type", rf"{_EXP}type +([\w$]+) *(?:<|=)", False), ("function", rf"{_EXP}(?:const|let|var) +([\w$]+) *(?::[^=\n]+)?= *(?:async *)?(?:<[^>\n]*> *)?(?:\([^\n]*|[\w$]+ *)=>", False), ("function", rf"{_EXP}(?:const|let|var) +([\w$]+) *(?::[^=\n]+)?= *(?:async +)?function\b", False), ("function", rf"{_EXP}(?:const|let|var) +([\w$]+) *= *(?:async *)?\( *$", False), ("variable", rf"{_EXP}(?:const|let|var) +([\w$]+) *(?::[^=\n]+)?= *(?:await +|new +)?[\w$.]+(?:<[^>\n]*>)?\(", False), ("constant", rf"{_EXP}(?:const|let|var) +([\w$]+)", False), ("namespace", rf"{_EXP}(?:namespace|module) +([\w$.]+)", True)],
}
_MEMBERS = {
    "ts": [("method", rf"[ \t]*(?:(?:public|private|protected|static|async|get|set|override|abstract|readonly) +)*\*? *{_NOT}(#?[\w$]+) *(?:<[^>\n]*>)? *\(", False), ("field", rf"[ \t]*(?:(?:public|private|protected|static|override|readonly|declare) +)*{_NOT}(#?[\w$]+)[?!]? *(?:[:=;]|$)", False)],
}
_COMPILED = {k: [(kind, re.compile(p), c) for kind, p, c in v] for k, v in _HEADS.items()}
_INNER = {k: [(kind, re.compile(p), c) for kind, p, c in v] for k, v in _MEMBERS.items()}
_SPEC = re.compile(r"[ \t]+(\w+)\b")
_LEAD = re.compile(r"[ \t]*(?:@|#\[)")
_STOPS = re.compile(r"[()\[\]{};\n]|=>")


def _blanked(text: str, lang: str) -> str:
    """The text with strings and comments as spaces, line breaks in them as carriage returns; a string keeps its quote."""
    keep = lambda m: (m[0][0] if m[0][0] in "\"'`" else " ") + re.sub(r"[^\n]", " ", m[0][1:]).replace("\n", "\r")
    return _BLANK[lang].sub(keep, text)


def _end(code: str, at: int, lang: str, kind: str) -> tuple[int, int]:
    """(end of the head, end of the declaration) of one that begins at `at`, in a language with braces."""
    depth, head = 0, -1
    for m in _STOPS.finditer(code, at):
        x, i = m[0], m.start()
        if x in ("(", "[", "{"):
            if x == "{" and not depth and head < 0:
                head = i
            depth += 1
        elif x in (")", "]", "}"):
            depth -= 1
            if depth < 0:
                return (head if head >= 0 else i), i
            if not depth and x == "}" and head >= 0 and kind not in ("constant", "variable", "type", "field"):
                return head, i + 1
        elif depth:
            continue
        elif x == ";":
            return (head if head >= 0 else i), i + 1
        elif x == "=>":
            head = m.end() if head < 0 or kind == "function" else head
            follows = re.compile(r"\s*").match(code, m.end()).end()
            if code[follows : follows + 1] == "{":
                continue
        elif x == "\n" and lang != "rs" and code[at:i].strip() and not re.search(r"[=,(|&?:+.<-]\s*$|=>\s*$", code[max(at, i - 40) : i]) and not re.match(r"\s*(?:[.?:|&+{=]|=>)", code[i : i + 80]):
            return (head if head >= 0 else i), i
    return (head if head >= 0 else len(code)), len(code)


def _one_line(text: str) -> str:
    return re.sub(r"\s*\n\s*", " ", text).strip()


def scan_declarations(text: str, lang: str) -> Iterator[tuple[str, str, int, int, str, str]]:
    """(kind, name, start, end, signature, code) of the declarations of a file, by line; names of members as Owner::name.

    What stands in the body of a function is part of it and not declared by itself."""
    text = text.replace("\r\n", "\n")
    code = _blanked(text, lang)
    lines, raw = code.replace("\r", "\n").split("\n"), text.split("\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    if lang == "py":
        yield from _python(text, code, lines, raw, starts)
        return
    line, depth, busy = 0, 0, 0
    boxes: list[tuple[int, int, str, str]] = []  # (line of the end, depth inside, owner, kind)
    for line, x in enumerate(lines):
        while boxes and boxes[-1][0] < line:
            boxes.pop()
        inside = boxes[-1] if boxes else (len(lines), 0, "", "")
        if x.strip() and depth == inside[1] and line >= busy:
            got = None
            if inside[3] == "group":
                m = _SPEC.match(x)
                kinds = [k for k, p, _ in _COMPILED["go"][2:4] if p.match(x)]
                got = (kinds[0] if kinds else "type" if inside[2] == "type" else "constant", m[1], False) if m else None
            else:
                for kind, p, box in (_INNER if inside[3] == "class" else _COMPILED).get(lang, []):
                    if m := p.match(x):
                        got = (kind, m[m.lastindex] if kind != "method" or lang != "go" else f"{m[1]}::{m[2]}", box)
                        break
            if got:
                kind, name, box = got
                head, end = (starts[line + 1] - 1,) * 2 if kind == "group" else _end(code, starts[line], lang, kind)
                if kind == "group":
                    last = next((i for i in range(line + 1, len(lines)) if lines[i][:1] == ")"), line)
                    boxes.append((last, depth + 1, name, "group"))
                else:
                    last = bisect_right(starts, max(starts[line], end - 1)) - 1
                    first = line
                    while first and (_LEAD.match(lines[first - 1]) or raw[first - 1].strip() and not lines[first - 1].strip()):
                        first -= 1
                    owner = inside[2] if inside[3] in ("class", "impl", "trait") else ""
                    if kind not in ("impl", "mod", "namespace"):
                        own = code[max(starts[line], code.find("=", starts[line], end)) : end] if kind in ("constant", "variable", "field") else code[head:end]
                        shown = "method" if owner and kind == "function" else kind
                        sign = text[starts[line] : head] if kind != "constant" or lang == "go" else raw[line]
                        sign = _one_line(sign.rstrip("{ ;\n") if lang != "ts" or kind != "constant" else sign)
                        yield shown, f"{owner}::{name}" if owner else name, first + 1, last + 1, sign, "" if box and kind != "class" else own
                        if lang == "ts" and kind == "method" and name == "constructor":
                            for p in re.finditer(r"(?:public|private|protected|readonly) +(?:readonly +)?(\w+)", code[starts[line] : head]):
                                yield "field", f"{owner}::{p[1]}", line + 1, line + 1, p[0], ""
                        if lang == "ts" and kind == "variable":
                            for p in re.finditer(r"(?m)^[ \t]+([\w$]+) *(?:\([^)\n]*\) *\{|: *(?:async *)?(?:\(|function\b))", own):
                                yield "method", f"{name}.{p[1]}", line + 1, last + 1, p[1], ""
                    if box and end > starts[line + 1]:
                        boxes.append((last, depth + 1, name, kind))
                    else:
                        busy = last + (end < starts[last] + len(lines[last].rstrip()) - 1 or last > line or lang != "rs")
            elif lang == "ts" and (m := re.match(rf"{_EXP}(?:const|let|var) +[{{\[]([^}}\]\n]*)[}}\]] *=", x)):
                for n in re.findall(r"(?:^|,) *(?:\.\.\.)?(?:[\w$]+ *: *)?([\w$]+)", m[1]):
                    yield "variable", n, line + 1, line + 1, x.strip(), x[m.end() :]
        depth += sum(map(x.count, "([{")) - sum(map(x.count, ")]}"))


def _python(text: str, code: str, lines: list[str], raw: list[str], starts: list[int]) -> Iterator[tuple[str, str, int, int, str, str]]:
    depth, last = 0, 0
    open_: list[list] = []  # indent, kind, full name, first line, line of the head, end of the head

    def close(to: int) -> Iterator[tuple[str, str, int, int, str, str]]:
        while open_ and open_[-1][0] >= to:
            _, kind, name, first, line, head = open_.pop()
            if kind:
                sign = _one_line(text[starts[line] : head])
                plain = kind in ("class", "constant", "variable")
                yield kind, name, first + 1, last + 1, sign.rstrip(":") if plain else sign, code[head : starts[last + 1] - 1]

    for i, x in enumerate(lines):
        if not x.strip() and not (depth and raw[i].strip()):
            last = i if open_ and raw[i].strip() and not raw[i].lstrip().startswith("#") else last
            continue
        indent = len(x) - len(x.lstrip())
        if not depth:
            yield from close(indent)
            owner = open_[-1] if open_ else None
            got = None
            if owner is None or owner[1] == "class":
                for kind, p, _ in _COMPILED["py"][: 2 if owner else None]:
                    if m := p.match(x):
                        got = kind, m[1]
                        break
            if got:
                kind, name = got
                first = i
                while first and _LEAD.match(lines[first - 1]) and len(raw[first - 1]) - len(raw[first - 1].lstrip()) == indent:
                    first -= 1
                level, at = 0, starts[i + 1] - 1
                if kind in ("function", "class"):
                    for m in re.compile(r"[()\[\]{}]|:").finditer(code, starts[i]):
                        level += (m[0] in "([{") - (m[0] in ")]}")
                        if m[0] == ":" and level <= 0:
                            at = m.end()
                            break
                else:
                    at = starts[i] + x.index("=")
                full = f"{owner[2]}::{name}" if owner else name
                open_.append([indent, "method" if owner and kind == "function" else kind, full, first, i, at])
            elif owner is None:
                open_.append([indent, "", "", i, i, 0])  # another statement of the module
        last = i
        depth = max(0, depth + sum(map(x.count, "([{")) - sum(map(x.count, ")]}")))
    yield from close(0)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for fid, path, lang, text in zip(b["file_id"], b["path"], b["lang"], b["content"]):
            rows += [(fid, path, lang, *d) for d in scan_declarations(text or "", lang)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in DECLARED.split(", ")])


# Words before a bracket that call nothing.
NO_CALLS = ("if", "for", "while", "switch", "match", "return", "catch", "function", "fn", "func", "def", "with", "and", "or", "not", "in", "elif", "super", "await", "self", "cls", "this", "lambda", "typeof", "print", "assert", "del", "yield", "raise", "except")
PLAIN = ("true", "false", "null", "undefined", "None", "True", "False", "nil", "self", "cls", "this", "super", "mut", "const", "string", "number", "boolean", "void", "any", "unknown", "never")
HEAD = r"\b(?:def|fn|function\*?|func(?: \([^)]*\))?)\s+\w+\s*(?=\()"
CALL = r"((?:\.|::)\s*)?\b([A-Za-z_$][\w$]*)\s*(?:::\s*<[^<>()]*>\s*)?(?:<[\w, .\[\]|]*>)?\("
ARGUMENT = r"[(,=]\s*(?:&(?:mut )?|\*)?(?:\w+\s*=\s*)?([A-Za-z_$][\w$]*)((?:\s*\.\s*[A-Za-z_$][\w$]*)*)\s*(?=[,)])"
READ = r"\.\s*([A-Za-z_$][\w$]*)\b(?!\s*(?:[(!]|::))"
TYPE = r"(?:[:<>,|&]|->)\s*&?(?:'\w+ )?(?:mut )?\[?\]?\*?([A-Z]\w*)\b(?!\s*(?:\(|::|\{))"


def _words(code: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(code, F.lit(pattern), F.lit(group))


def references(declared: DataFrame) -> DataFrame:
    """The declarations with calls, call_counts, member_calls and mentions of their own code, each name once.

    `T::f()` of Rust calls `f` and `T::f`, and `T` too where f is new or default; `new X()` calls `X` and `X::constructor`;
    a name behind a dot is a member call. Macros are looked into but not called."""
    code = F.regexp_replace("code", HEAD, ";")
    quiet = lambda a, words: F.array_except(a, F.array(*map(F.lit, words)))
    called = F.filter(_words(code, CALL, 2), lambda x: ~x.isin(*NO_CALLS))
    made = F.transform(_words(code, r"\bnew\s+([A-Za-z_$][\w$.]*)", 1), lambda x: F.concat(F.substring_index(x, ".", -1), F.lit("::constructor")))
    owned = F.when(F.col("lang") == "rs", _words(code, r"\b([A-Z]\w*::\w+)\s*(?:::<[^<>()]*>)?\(", 1)).otherwise(F.array().cast("array<string>"))
    built = F.transform(F.filter(owned, lambda x: x.rlike("::(new|default)$")), lambda x: F.substring_index(x, "::", 1))
    rows = declared.withColumn("all", F.concat(called, made, owned, built))
    members = F.array_distinct(F.filter(_words(code, r"\.\s*([A-Za-z_$][\w$]*)\s*(?:::\s*<[^<>()]*>\s*)?\(", 1), lambda x: ~x.isin(*NO_CALLS)))
    names = F.array_distinct("all")
    counts = F.map_from_arrays(names, F.transform(names, lambda n: F.size(F.filter("all", lambda x: x == n))))
    mentioned = quiet(F.array_distinct(F.concat(_words(code, ARGUMENT, 1), _words(code, READ, 1), _words(F.concat_ws(" ", F.expr("substr(signature, instr(signature, '('))"), code), TYPE, 1))), (*PLAIN, *NO_CALLS))
    return rows.select("*", names.alias("calls"), counts.alias("call_counts"), members.alias("member_calls"), F.array_except(mentioned, names).alias("mentions")).drop("all", "code")


def declarations(files: DataFrame) -> DataFrame:
    """file_id, path, lang, kind, name, start_line, end_line, signature, calls, call_counts, member_calls, mentions of what
    the files declare. files: file_id, path, content.

    Decorators, attributes and documentation right above belong to a declaration. Null and empty contents and other
    extensions declare nothing; an unclosed block goes on to the end of the file."""
    lang = F.create_map(*[F.lit(x) for kv in LANGUAGE.items() for x in kv])
    rows = files.select(F.col("file_id").cast("long"), "path", F.try_element_at(lang, C.extension("path")).alias("lang"), "content").where("lang IS NOT NULL AND content IS NOT NULL")
    return references(spread(rows).mapInPandas(_scan, DECLARED))


# Modules of the Python standard library that count as foreign.
PYTHON_LIBRARY = ("os", "sys", "re", "json", "math", "time", "datetime", "collections", "itertools", "functools", "typing", "pathlib", "subprocess", "threading", "asyncio", "logging", "random", "string", "io", "abc", "copy", "enum", "dataclasses", "contextlib", "unittest", "tempfile", "shutil", "hashlib", "base64", "struct", "socket", "http", "urllib", "csv", "argparse", "inspect", "uuid")


def imports(files: DataFrame) -> DataFrame:
    """file_id, lang, spec, name, alias, external: a row per name that an import statement in the head of a file binds.

    spec is the module or path; alias the name it is bound to here where that differs. External are: crates other than
    crate, self and super; specs of TypeScript that are not relative; the standard library of Python; paths of Go without a
    dot. Globs bind nothing. files: file_id, path, content."""
    lang = F.create_map(*[F.lit(x) for kv in LANGUAGE.items() for x in kv])
    kinds = files.select("file_id", F.try_element_at(lang, C.extension("path")).alias("lang")).where("lang IS NOT NULL").distinct()
    t = F.col("text")
    one = lambda text: F.regexp_replace(text, r"[{}()]", " ")
    bound = lambda spec, part: F.struct(spec.alias("spec"), F.regexp_extract(part, r"([\w$*.]+)", 1).alias("name"), F.regexp_extract(part, r"\bas\s+([\w$]+)", 1).alias("alias"))
    parts = lambda text: F.filter(F.transform(F.split(one(text), ","), F.trim), lambda p: p != "")
    frm = F.regexp_extract(t, r"^from\s+([.\w]+)\s+import", 1)
    python = F.when(frm != "", F.transform(parts(F.regexp_replace(t, r"^from\s+[.\w]+\s+import", "")), lambda p: bound(frm, p))).otherwise(F.transform(parts(F.regexp_replace(t, r"^import\s+", "")), lambda p: bound(F.regexp_extract(p, r"([\w.]+)", 1), p)))
    source = F.regexp_extract(t, r"['\"]([^'\"]+)['\"]", 1)
    clause = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\s*from\s*['\"].*$|['\"].*$", ""), r"^import\s+(?:type\s+)?", ""), r"\*\s+as\s+(\w+)", "$1"), r"\btype\s+", "")
    script = F.when(t.startswith("import"), F.transform(parts(clause), lambda p: bound(source, p))).otherwise(F.transform(parts(F.regexp_extract(t, r"^(?:const|let|var)\s+(.*?)=", 1)), lambda p: bound(source, F.regexp_replace(p, ":", " as "))))
    tree = F.regexp_replace(F.regexp_replace(t, r"^(?:pub(?:\([^)]*\))?\s+)?use\s+|;$", ""), r"^extern crate\s+", "")
    root = F.regexp_extract(tree, r"^(?:::)?([\w:]*\w)", 1)
    leaves = _words(tree, r"([\w*]+(?:\s+as\s+\w+)?)\s*(?=,|\}|$)", 1)
    rust = F.transform(F.filter(leaves, lambda p: p != "*"), lambda p: bound(root, p))
    go = F.transform(F.filter(F.split(F.regexp_replace(t, r"^import\s*\(?|\)$", ""), r"[\n;]"), lambda p: p.contains('"')), lambda p: F.struct(F.regexp_extract(p, r'"([^"]+)"', 1).alias("spec"), F.regexp_extract(p, r'([^/"\s]+)"', 1).alias("name"), F.regexp_extract(p, r'^\s*(\w+)\s+"', 1).alias("alias")))
    rows = import_statements(files).join(kinds, "file_id")
    rows = rows.select("file_id", "lang", F.explode(F.when(F.col("lang") == "py", python).when(F.col("lang") == "ts", script).when(F.col("lang") == "rs", rust).otherwise(go)).alias("x")).select("file_id", "lang", "x.*")
    head = F.substring_index("spec", "::", 1)
    external = F.when(F.col("lang") == "rs", ~head.isin("crate", "self", "super")).when(F.col("lang") == "ts", ~F.col("spec").rlike(r"^[./~@]/|^\.")).when(F.col("lang") == "py", F.substring_index("spec", ".", 1).isin(*PYTHON_LIBRARY)).otherwise(~F.col("spec").contains("."))
    return rows.where("name <> '' AND name <> '*'").select("file_id", "lang", "spec", "name", F.when(F.col("alias") != "", F.col("alias")).alias("alias"), external.alias("external")).distinct()


def module_hint(spec: Column | str) -> Column:
    """The module that a spec names, as an ending of file paths: without dots, slashes and keywords before it and extension."""
    s = F.regexp_replace(F.regexp_replace(C.col(spec), r"::", "/"), r"^(?:(?:crate|self|super)/)+|^\.*/*(?:\.\./)*", "")
    return F.regexp_replace(F.when(s.contains("/"), s).otherwise(F.regexp_replace(s, r"\.", "/")), r"\.(?:ts|tsx|js|jsx|mjs|cjs)$", "")


def symbols_of(files: DataFrame) -> DataFrame:
    """The symbols of files as the resolver reads them: sid, file, repo_id and all lists, with external names and aliased
    calls. files: file_id, repo_id, path, content.

    A call of a name that an import renamed becomes `hint:original`; a call of what is imported from elsewhere stays and is
    listed in external_imports. sid is a hash of file, line, kind and name."""
    found = declarations(files)
    names = imports(files).groupBy("file_id").agg(
        F.collect_set(F.when(F.col("external"), F.coalesce("alias", "name"))).alias("external_imports"),
        F.map_from_entries(F.collect_set(F.when(~F.col("external") & F.col("alias").isNotNull(), F.struct("alias", F.concat_ws(":", module_hint("spec"), "name"))))).alias("renamed"),
    )
    repo = files.select(F.col("file_id").cast("long"), "repo_id").distinct()
    rows = found.join(names, "file_id", "left").join(repo, "file_id")
    new = lambda x: F.coalesce(F.try_element_at("renamed", x), x)
    kept = F.array_distinct(F.transform("calls", lambda x: F.when(F.array_contains("member_calls", x), x).otherwise(new(x))))
    counts = F.map_from_arrays(kept, F.transform(kept, lambda k: F.aggregate(F.map_entries("call_counts"), F.lit(0), lambda a, e: a + F.when((e["key"] == k) | (new(e["key"]) == k), e["value"]).otherwise(0))))
    sid = F.xxhash64("file_id", "start_line", "kind", "name")
    none = F.array().cast("array<string>")
    return rows.select(sid.alias("sid"), "file_id", "repo_id", F.col("path").alias("file"), "name", "kind", "start_line", "end_line", "signature", F.lit(0.0).alias("centrality"), kept.alias("calls"), "member_calls", "mentions", F.coalesce("external_imports", none).alias("external_imports"), counts.alias("call_counts"), C.is_test(F.col("path"), F.col("name")).alias("is_test"))


def refreshed(old_files: DataFrame, files: DataFrame, old_symbols: DataFrame) -> DataFrame:
    """The symbols of files where those of files with the same path and hash as before are kept and only the others are
    extracted again; symbols of files that are gone are left out. Files: file_id, repo_id, path, hash, content."""
    status = written(changes(old_files.select("path", "hash"), files.select("path", "hash")))
    kept = old_symbols.join(status.where("status = 'same'").select(F.col("path").alias("file")), "file", "left_semi")
    stale = files.join(status.where("status IN ('new', 'changed')").select("path"), "path", "left_semi")
    return kept.unionByName(symbols_of(stale))
