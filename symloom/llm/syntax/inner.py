"""Expressions inside strings: `${...}` of templates and `{...}` of f-strings, to any depth.

A text is scanned once with a stack; each outermost template or f-string is replaced by a plain one of the same length and
line breaks, and the expressions that it holds come out by themselves, so that they can be parsed by the same rules.
"""

from __future__ import annotations

import re

Found = list[tuple[int, str]]  # (place in the text, expression)

_JS = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|(?:(?<=[(=,:\[!&|?{;+*%~^\n-])|(?<=return)|(?<=typeof)|(?<=case)|(?<==>))[ \t]*/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/|[`{}]", re.S)
_TEMPLATE = re.compile(r"\\.|`|\$\{", re.S)


def _blank(text: str) -> str:
    return re.sub(r"[^\n\r]", " ", text)


def _template(text: str, at: int, found: Found) -> int:
    """The end of the template that opens at `at`, -1 where it has none."""
    i = at + 1
    while m := _TEMPLATE.search(text, i):
        i = m.end()
        if m[0] == "`":
            return i
        if m[0] == "${":
            end = _code(text, i, found, True)
            if end < 0:
                return -1
            i = end + 1
    return -1


def _code(text: str, at: int, found: Found, inside: bool, out: list[str] | None = None) -> int:
    """Reads code from `at` to the brace that closes it, or to the end; templates come out plain."""
    depth, i, last, parts = 0, at, at, out if out is not None else []
    while m := _JS.search(text, i):
        i = m.end()
        x = m[0]
        if x == "`":
            end = _template(text, m.start(), found)
            if end < 0:
                if inside:
                    return -1
                break
            parts += [text[last : m.start()], "`", _blank(text[m.start() + 1 : end - 1]), "`"]
            i = last = end
        elif x == "{":
            depth += 1
        elif x == "}":
            depth -= 1
            if depth < 0 and inside:
                found.append((at, "".join(parts) + text[last : m.start()]))
                return m.start()
            depth = max(depth, 0)
    if inside:
        return -1
    parts.append(text[last:])
    return len(text)


def unfold_templates(text: str) -> tuple[str, Found]:
    """(text with plain templates, the expressions of all templates). A template without an end is left as it is."""
    if "`" not in text or "${" not in text:
        return text, []
    parts: list[str] = []
    found: Found = []
    _code(text, 0, found, False, parts)
    return "".join(parts), found


_PY = re.compile(r"\#[^\n]*|(?<!\w)(?P<f>(?:[fFtT][rR]?|[rR][fFtT])(?P<q>\"\"\"|'''|\"|'))|(?:(?<!\w)[rRbBuU]{1,2})?(?:\"\"\"(?:[^\\]|\\.)*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\.)*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')", re.S)
_INSIDE = re.compile(r"(?P<f>(?<!\w)(?:[fFtT][rR]?|[rR][fFtT])(?P<q>\"\"\"|'''|\"|'))|(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|!=|[()\[\]{}!:]|=(?=\s*[!:}])", re.S)


def _field(text: str, at: int, quote: str, raw: bool, found: Found) -> int:
    """Behind the brace that closes the field whose expression begins at `at`; -1 where none does."""
    depth, i, last, parts = 0, at, at, []
    while m := _INSIDE.search(text, i):
        x, i = m[0], m.end()
        if m["f"]:
            end = _fstring(text, m.end(), m["q"], "r" in m["f"].lower(), found)
            if end < 0:
                return -1
            parts += [text[last : m.start()], "''", " " * (end - m.start() - 2)]
            i = last = end
        elif x in ("(", "[", "{"):
            depth += 1
        elif x in (")", "]", "}") and depth:
            depth -= 1
        elif not depth and x in ("!", ":", "=", "}"):
            found.append((at, "".join(parts) + text[last : m.start()]))
            if x == "=":
                i = re.compile(r"\s*").match(text, i).end()
                x = text[i : i + 1]
                i += 1
            if x == "!":
                m = re.compile(r"\s*[rsa]\s*").match(text, i)
                if not m:
                    return -1
                x, i = text[m.end() : m.end() + 1], m.end() + 1
            if x == ":":
                return _spec(text, i, quote, raw, found)
            return i if x == "}" else -1
        elif x in (")", "]"):
            return -1
    return -1


def _spec(text: str, at: int, quote: str, raw: bool, found: Found) -> int:
    i = at
    while i < len(text):
        if text.startswith(quote, i) or text[i] == "\n" and len(quote) == 1:
            return -1
        if text[i] == "{":
            i = _field(text, i + 1, quote, raw, found)
            if i < 0:
                return -1
        elif text[i] == "}":
            return i + 1
        else:
            i += 1
    return -1


def _fstring(text: str, at: int, quote: str, raw: bool, found: Found) -> int:
    """The end of the f-string whose text begins at `at`; -1 where it has none or a field is broken."""
    i = at
    while i < len(text):
        c = text[i]
        if text.startswith(quote, i):
            return i + len(quote)
        if c == "\\":
            if not raw and text[i + 1 : i + 3] == "N{" and "}" in text[i:]:
                i = text.index("}", i) + 1
            else:
                i += 1 if text[i + 1 : i + 2] in ("{", "}") else 2
        elif c == "{":
            if text[i + 1 : i + 2] == "{":
                i += 2
            else:
                i = _field(text, i + 1, quote, raw, found)
                if i < 0:
                    return -1
        elif c == "}":
            if text[i + 1 : i + 2] != "}":
                return -1
            i += 2
        elif c == "\n" and len(quote) == 1:
            return -1
        else:
            i += 1
    return -1


def unfold_fstrings(text: str) -> tuple[str, Found]:
    """(text with plain strings for f-strings, the expressions of all fields); a broken field leaves an odd sign."""
    parts: list[str] = []
    found: Found = []
    i = last = 0
    while m := _PY.search(text, i):
        i = m.end()
        if not m["f"]:
            continue
        end = _fstring(text, m.end(), m["q"], "r" in m["f"].lower(), found)
        if end < 0:
            # an open string is left to the lexer, a broken field is marked
            plain = re.compile(r"(?:[^\\]|\\.)*?" + re.escape(m["q"]), re.S).match(text, m.end())
            if plain is None or len(m["q"]) == 1 and "\n" in plain[0]:
                continue
            end = plain.end()
            parts += [text[last : m.start()], "?", _blank(text[m.start() + 1 : end])]
        else:
            parts += [text[last : m.start()], m["q"], _blank(text[m.start() + len(m["q"]) : end - len(m["q"])]), m["q"]]
        i = last = end
    return "".join(parts) + text[last:], found
