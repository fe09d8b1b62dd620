"""Problem 2: functions paired with their documentation.

The head of each declaration (comments, attributes, signature, the first statement of a Python body) is lexed to one
letter a token and parsed with a generalised LL grammar of its language, which also accepts what broken files leave of a
declaration: a token at which all alternatives fail is dropped. The grammar, not a search, decides which comment is the
declaration's own. The function that a description belongs to is then parsed whole (bodies.py): what follows its end is cut
off, and how many tokens and brackets recovery had to drop or add tells valid functions from broken ones. Descriptions that many differently named functions have word for word are templates; they are told by
counting hashes over the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm import bodies
from symloom.llm.gll import Parser, grammar
from symloom.util import spread, table, written

TEMPLATE_NAMES, WORDS = 25, 5
PAIRS = "symbol_id long, name string, code string, description string, faults int"

# Letters: D line of documentation, B block of documentation, H documentation attribute, A attribute or decorator,
# c other comment, e empty line, k the word that declares a function, w other token, g bracketed group, o start of the
# body (everything after it is one token), s docstring, q other string
GRAMMARS = {
    "py": """
Unit: Lead Head o Doc x | Lead Head o x | Lead Head o Doc | Lead Head o | Lead Head | Lead
Lead: Lead A | Lead c | Lead e | -
Head: Words k Words
Words: Words w | Words g | Words c | Words e | -
Doc: s
""",
    "lines": """
Unit: Lead Doc Marks Head | Lead Marks Head | Lead Doc Marks | Lead
Lead: Lead D | Lead B | Lead H | Lead A | Lead c | Lead e | -
Doc: Run | B
Run: Run D | Run H | Run A D | Run A H | D | H
Marks: Marks A | Marks c | -
Head: Begin Words o | Begin o | Begin Words
Begin: k | w | g
Words: Words w | Words g | Words c | Words e | Words k | -
""",
    "blocks": """
Unit: Lead Doc Marks Head | Lead Marks Head | Lead Doc Marks | Lead
Lead: Lead B | Lead A | Lead c | Lead e | -
Doc: B
Marks: Marks A | Marks c | Marks e | -
Head: Begin Words o | Begin o | Begin Words
Begin: k | w | g
Words: Words w | Words g | Words c | Words e | Words k | -
""",
}
FORMS = {"py": "py", "rs": "lines", "go": "lines", "ts": "blocks", "tsx": "blocks", "js": "blocks", "jsx": "blocks", "mjs": "blocks", "cjs": "blocks"}
_PARSERS = {k: Parser(grammar(v), "Unit", ("Lead",)) for k, v in GRAMMARS.items()}

_STRING = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_BRACE = re.compile(rf"(?P<e>\n[ \t\r]*(?=\n))|(?P<ws>\s+)|(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<rust>#!?\[)|(?P<deco>@[\w.]+)|(?P<word>\w+)|(?P<str>{_STRING}|`(?:[^`\\]|\\.)*`)|(?P<open>[(\[])|(?P<body>\{{|=>)|(?P<other>.)", re.S)
_PY = re.compile(rf"(?P<e>\n[ \t\r]*(?=\n))|(?P<ws>(?:\s|\\\r?\n)+)|(?P<c>\#[^\n]*)|(?P<deco>@[\w.]+)|(?P<s>[rRuU]?(?:\"\"\"(?:[^\\]|\\.)*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\.)*?(?:'''|\Z)|{_STRING}))|(?P<word>\w+)|(?P<open>[(\[{{])|(?P<body>:)|(?P<other>.)", re.S)
_INSIDE = re.compile(rf"{_STRING}|`(?:[^`\\]|\\.)*`|//[^\n]*|/\*.*?\*/|[(\[{{]|[)\]}}]", re.S)
_INSIDE_PY = re.compile(rf"\"\"\".*?\"\"\"|'''.*?'''|{_STRING}|\#[^\n]*|[(\[{{]|[)\]}}]", re.S)


def _group(text: str, at: int, inside: re.Pattern) -> int:
    """The end of the bracketed group that opens at `at`; of a broken one the end of its line."""
    depth = 0
    for m in inside.finditer(text, at):
        x = m.group()
        if x in "([{":
            depth += 1
        elif x in ")]}":
            depth -= 1
            if depth <= 0:
                return m.end()
    end = text.find("\n", at)
    return len(text) if end < 0 else end


def _lex_python(text: str) -> tuple[str, list[tuple[int, int]]]:
    kinds, spans, at = [], [], 0
    opened = False
    while at < len(text):
        m = _PY.match(text, at)
        kind, end = m.lastgroup, m.end()
        if kind != "ws":
            if opened:
                if kind == "s":
                    kinds += "sx"
                    spans += [(at, end), (end, len(text))]
                elif kind in ("e", "c"):
                    at = end
                    continue
                else:
                    kinds.append("x")
                    spans.append((at, len(text)))
                break
            if kind == "open":
                end = _group(text, at, _INSIDE_PY)
            elif kind == "deco" and "k" not in kinds and text[end : end + 1] == "(":
                end = _group(text, end, _INSIDE_PY)
            elif kind == "body" and "k" in kinds:
                opened = True
            letter = {"e": "e", "c": "c", "deco": "A", "open": "g"}.get(kind, "w")
            if kind == "word" and m.group() == "def":
                letter = "k"
            kinds.append("o" if opened else letter)
            spans.append((at, end))
        at = end
    return "".join(kinds), spans


_DECLARES = frozenset(("fn", "func", "function", "constructor"))


def _lex_brace(text: str, form: str) -> tuple[str, list[tuple[int, int]]]:
    kinds, spans, at = [], [], 0
    fresh = True  # at the start of a line
    rust = form == "rs"
    while at < len(text):
        m = _BRACE.match(text, at)
        kind, end, x = m.lastgroup, m.end(), m.group()
        if kind == "ws":
            fresh = fresh or "\n" in x
        else:
            letter = "w"
            if kind == "line":
                if rust:
                    letter = "D" if x[:3] == "///" and x[3:4] != "/" else "c"
                elif form == "go":
                    letter = "c" if re.match(r"//(?:go:|nolint|line |export |[a-z]+:[a-z])", x) else "D"
                else:
                    letter = "c"
            elif kind == "block":
                doc = x[:3] == "/**" and x[3:4] not in "*/" or x[:4] == "/**\n"
                letter = "B" if (form == "go" or doc) else "c"
            elif kind == "rust":
                if rust:
                    end = _group(text, at + x.index("["), _INSIDE)
                    letter = "H" if re.match(r"#\[\s*doc\s*=", text[at:end]) else "A"
            elif kind == "deco":
                if text[end : end + 1] == "(":
                    end = _group(text, end, _INSIDE)
                letter = "A"
            elif kind == "open":
                end, letter = _group(text, at, _INSIDE), "g"
            elif kind == "word" and x in _DECLARES:
                letter = "k"
            elif kind == "e":
                letter = "e"
            elif kind == "body":
                kinds.append("o")
                spans.append((at, len(text)))
                break
            kinds.append(letter)
            spans.append((at, end))
        at = end
    return "".join(kinds), spans


@lru_cache(maxsize=20_000)
def _own(form: str, kinds: str) -> tuple[tuple[tuple[int, int], ...], int]:
    """Token spans of the declaration's own documentation; the same shape of head is parsed once."""
    short = re.sub(r"w{2,}", "w", kinds)
    if short != kinds:  # runs of plain tokens are one, whatever their length
        back = [m.start() for m in re.finditer(r"w+|[^w]", kinds)] + [len(kinds)]
        found, dropped = _own(form, short)
        return tuple((back[a], back[b]) for a, b in found), dropped
    found, dropped = _PARSERS[form].spans(kinds, "Doc")
    return tuple(found), len(dropped)


_TAG = re.compile(r"^\s*(?:[@:\\]\w+|(?:Args|Arguments|Returns?|Raises|Yields|Parameters|Examples?|Throws|Note)\s*:?\s*$|#+\s*\w+\s*$)", re.I)
_EMPTY = re.compile(r"^\W*(?:todo|fixme|xxx|hack|tbd|placeholder|undocumented|no docs|n/?a|see (?:above|below)|auto-?generated|eslint|noqa|nolint|pragma|type:|pylint|istanbul|prettier|ts-ignore|noinspection|inheritdoc)\b", re.I)
_DIRECTIVE = re.compile(r"^\W*(?:eslint[-\w]*|noqa|nolint|pylint|prettier-ignore|@ts-\w+|istanbul|noinspection|go:\w+|pragma|tslint)[: \w-]*", re.I)
_ENDS = re.compile(r"(?<=[.!?])\s+(?=\S)|\n\s*\n|\n(?=\s*(?:[@:\\]\w|[-*]\s))|(?<=[。！？])")
_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_A-Za-z]+|\d+")
# Words that say nothing by themselves in a restatement of a name.
FILLER = frozenset("the a an this that of to for in on by with and or is are it its as at be from function method returns return returning gets get sets set does do performs perform helper handles handle implements implementation given value values der die das den el la los las un una".split())


def text_of(comment: str, form: str) -> str:
    """The words of a documentation comment or docstring, without its marks."""
    if form == "py":
        m = re.match(r"[rRuU]?(\"\"\"|'''|\"|')", comment)
        quote = m.group(1)
        body = comment[m.end() :]
        return (body[: -len(quote)] if body.endswith(quote) else body).strip()
    out = []
    for m in re.finditer(r"///?/?!?([^\n]*)|/\*+(.*?)(?:\*/|\Z)|#\[\s*doc\s*=\s*\"((?:[^\"\\]|\\.)*)\"\s*\]", comment, re.S):
        line, block, attribute = m.groups()
        if line is not None:
            out.append(line.strip())
        elif block is not None:
            out += [re.sub(r"^\s*\*+ ?", "", x).strip() for x in block.split("\n")]
        else:
            out.append(attribute.replace('\\"', '"').strip())
    return "\n".join(out).strip()


def _stem(w: str) -> str:
    w = w.lower()
    for end in ("ing", "es", "ed", "s"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)]
            break
    return w[:-1] if w.endswith("e") and len(w) > 3 else w


def says_something(text: str, name: str, least: int = WORDS) -> bool:
    """Whether a sentence of at least `least` words adds something to the name."""
    own = {_stem(p) for p in _PARTS.findall(name.replace("::", " "))} | {_stem(name.rpartition("::")[2])}
    for s in _ENDS.split(text):
        s = _DIRECTIVE.sub(" ", s.replace("\n", " ")).strip()
        if not s or _EMPTY.match(s) or _TAG.match(s):
            continue
        found = _WORDS.findall(s)
        if len(found) < least:
            continue
        new = [w for w in found if w.lower() not in FILLER and _stem(w) not in own and not all(_stem(p) in own for p in _PARTS.findall(w))]
        if len(new) >= 2:
            return True
    return False


def pair(body: str, name: str, file: str) -> tuple[str, str, int] | None:
    """(code, description, faults) of one declaration; None without documentation of its own that says something. The code
    ends where the function does; faults are 0 for a valid function, else what recovery dropped, closed or added."""
    ext = file.rpartition(".")[2].lower()
    form = FORMS.get(ext)
    if form is None or not body:
        return None
    kinds, spans = _lex_python(body) if form == "py" else _lex_brace(body, ext)
    if not ("s" in kinds if form == "py" else any(c in kinds for c in "DBH")):
        return None
    found, dropped = _own(form, kinds)
    if not found:
        return None
    a, b = found[-1]
    lo, hi = spans[a][0], spans[b - 1][1]
    description = text_of(body[lo:hi], form)
    if not says_something(description, name or ""):
        return None
    faults, end = bodies.parse(body, ext if ext in ("py", "rs", "go") else "ts")
    return body[:lo] + body[hi : max(hi, end)], description, dropped + faults


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for sid, name, file, body in zip(b["symbol_id"], b["name"], b["file"], b["body"]):
            got = pair(body, name or "", file or "")
            if got:
                rows.append((sid, name, *got))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAIRS.split(", ")])


def documented(symbols: DataFrame, names: int = TEMPLATE_NAMES) -> DataFrame:
    """symbol_id, name, code, description, faults of each function or method with a description of its own.

    Null or empty bodies and other kinds give no row, a null name has no words to restate, a file of an unknown extension
    no documentation. A description that at least `names` functions of different names have is a template and dropped.
    Redelivered rows count once."""
    rows = symbols.where(F.col("kind").isin("function", "method") & F.col("body").isNotNull() & F.col("symbol_id").isNotNull())
    found = spread(rows.select(F.col("symbol_id").cast("long"), "name", "file", "body")).mapInPandas(_pairs, PAIRS)
    found = found.withColumn("key", F.xxhash64(F.regexp_replace(F.lower("description"), r"\W+", " ")))
    found = written(found.dropDuplicates(["symbol_id"]))
    each = found.groupBy("key", F.element_at(F.split("name", "::"), -1).alias("own")).agg(F.lit(1).alias("one"))
    templates = each.groupBy("key").agg(F.sum("one").alias("n")).where(F.col("n") >= names).select("key")
    return found.join(templates, "key", "left_anti").drop("key")


def p2_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return documented(table(spark, folder, "symbols")).select("symbol_id", "code", "description", "faults")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return documented(table(spark, folder, "symbols")).select("symbol_id")


QUERIES = {"p2_found": p2_found, "p2_pairs": p2_pairs}
SQL: dict[str, str] = {}
