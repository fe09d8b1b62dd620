"""Whole functions as token strings, parsed level by level with generalised LL grammars.

A function is lexed to one letter a token; bracketed groups are one token of the level around them and a level of their
own. Every level is cut into statements at its separators, and every statement is parsed by the grammar of its language:
GLL takes all readings that a brace or a name may have. A statement without a reading drops the tokens at which all
alternatives fail and is parsed again; an unclosed group is closed where the text ends, a stray closer is dropped. Equal
statements are parsed once.
"""

from __future__ import annotations

import re
from functools import lru_cache

from symloom.llm.gll import Parser, grammar

# Letters: i name or literal, o operator between operands, u operator before one, b either, a assignment, d dot, c comma,
# x colon, t question mark, f arrow, P ( ) group, Q [ ] group, R { } group, K word that opens a statement with a head,
# W word that stands before an expression, V word that declares, J word alone, F function, E else-like, m separator, z step by one
_EXPRESSION = """
E: E o E | E b E | U | z U | E K E L E | E t E x E | E W E | E a E | E f E | E f | b List b E | b List b f E | b b E
U: u U | b U | W U | W | Post | U u | U t
Post: Atom | Post z | Post P | Post Q | Post R | Post d i | Post d P | Post i | Post d W | Post d K | Post d V | Post d F | Post u P | Post u Q | Post u R
Atom: i | P | Q | R | F Rest | V i | V
Rest: Rest i | Rest P | Rest Q | Rest x E | Rest f E | Rest o | Rest b | Rest R | Rest W | -
List: Items | Items c | -
Items: Item | Items c Item
Item: E | b | u E | E x E | E a E | x | E x | x E | W E x E | E x E a E | Item x E | Item K E | V E | V E a E | V E x E | V E x E a E
"""
GRAMMARS = {
    "brace": "S: Seq\nSeq: One | Block Seq\nOne: Block | Head | List | Label | Case\n"
    "Block: K List R | K P R | K R | K List f List R | L R | L K P R | L K List R | L P R | F i P R | F P R | F Rest R | F i P f List R | V F i P R | W Block | W P Block | i x Block\n"
    "Head: K List | K P Head | K P List | K P Case | K P J | L One | J | J i | V List | V Items a Items | V Items a Items L R | V F Rest | F i P f List | F i P | W Head | W P Head | W V List | W V Items a Items | W K List\n"
    "Label: i x Head | i x\nCase: K List x List | K List x | K x | K x List | K x Head | K List x Head | L x | L x List | K List f Seq"
    + _EXPRESSION,
    "py": "S: Head | List | List a List | Anno\nAnno: E x E | E x E a List\n"
    "Head: K List x List | K List x | K x | K x List | K List a E x | L x | L List x | L x List | F i P x | F i P f E x | F i P x List | F i Q P x | F i Q P f E x | J | J List | W F i P x | W F i P f E x | W K List x | K x Head | L x Head | K List x Head | L List x List | K i P x | K i x"
    + _EXPRESSION.replace("F Rest | ", ""),
}


def _merged(base: str, more: str) -> str:
    """The rules of both, alternatives of equal names together."""
    rules: dict[str, list[str]] = {}
    for line in (base + more).strip().splitlines():
        name, _, body = line.partition(":")
        rules.setdefault(name, []).append(body)
    return "\n".join(f"{k}: {'|'.join(v)}" for k, v in rules.items())


_PARSERS = {k: Parser(grammar(v), "S") for k, v in GRAMMARS.items()}
# Inside brackets: the three parts of a loop, the length of an array, items left out
_INSIDE = {"(": "S: List | Part m Part m Part\nPart: List | List a List | V List | V Items a Items | -\n", "[": "S: List | List m List\nItems: Items c | c Items\nItem: x x | x x E | E x x | E x x E | E x E x | E x E x E | x E x | x E x E\n"}
_INNER = {(k, o): Parser(grammar(_merged(_EXPRESSION if k != "py" else _EXPRESSION.replace("F Rest | ", ""), x)), "S") for k in GRAMMARS for o, x in _INSIDE.items()}

_HEADS = frozenset("if for while switch match try loop with select case default unsafe class struct enum impl trait interface namespace do".split())
_BEFORE = frozenset("return await async yield throw new typeof void delete go defer not in is and or as lambda mut ref raise assert del from import of instanceof chan range move dyn keyof extends readonly static public private protected get set satisfies where print fallthrough export pub extern".split())
_DECLARE = frozenset("let const var type global nonlocal use".split())
_ALONE = frozenset("break continue pass".split())
_FUNCTION = frozenset("function func fn def".split())
_ELSE = frozenset("else finally catch elif except".split())
_TEXT = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_COMMON = r"(?P<ws>[ \t\r\f]+|\\\r?\n)|(?P<nl>\n)|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<num>\d[\w.]*|\.\d\w*)|(?P<asg>(?:[-+*/%&|^]|\*\*|<<|>>>?|&&|\|\||\?\?|//|&\^|:|@)?=(?![=>]))"
_MARKS = r"(?P<arrow>=>|->|<-)|(?P<inc>\+\+|--)|(?P<op>===?|!==?|<=|>=|\?\?|&&|\|\||<<|>>>?|\.\.[.=]?|&\^)|(?P<dot>\?\.|::|\.)|(?P<mark>.)"
_LEX = {
    "py": re.compile(rf"(?P<skip>\#[^\n]*)|(?P<str>[rRbBfFuU]{{0,2}}(?:\"\"\"(?:[^\\]|\\.)*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\.)*?(?:'''|\Z)|{_TEXT}))|{_COMMON}|{_MARKS}", re.S),
    "rs": re.compile(rf"(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z)|#!?\[[^\]\n]*\])|(?P<str>b?r(#*)\".*?\"\2|b?\"(?:[^\"\\]|\\.)*\"|b?'(?:[^'\\\n]|\\[^\n]{{1,9}}?)'|'\w+)|{_COMMON}|{_MARKS}".replace(r"\2", r"\3"), re.S),
    "go": re.compile(rf"(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<str>`[^`]*`|{_TEXT})|{_COMMON}|{_MARKS}", re.S),
    "ts": re.compile(rf"(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z)|@[\w.]+)|(?P<str>`(?:[^`\\]|\\.)*`|{_TEXT}|(?:(?<=[(=,:\[!&|?{{;\n])|(?<=return))[ \t]*/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*)|{_COMMON}|{_MARKS}", re.S),
}
_GENERIC = re.compile(r"(?<=[\w:])<[\w\s,.:&'\[\]|?*-]*(?:<[\w\s,.:&'\[\]|?*-]*(?:<[\w\s,.:&'\[\]|?]*>[\w\s,.:&'\[\]|?]*)*>[\w\s,.:&'\[\]|?]*)*>(?=[\s({,;=)>:.\[\]|&]|\Z)")
_CLOSERS = {")": "(", "]": "[", "}": "{"}
_GROUP = {"(": "P", "[": "Q", "{": "R"}


def _letter(kind: str, x: str, form: str) -> str:
    if kind in ("num", "str"):
        return "i"
    if kind == "name":
        if x in _ELSE:
            return "L"
        if x in _HEADS:
            return "K"
        if x in _FUNCTION:
            return "F"
        if x in _DECLARE:
            return "V"
        if x in _ALONE:
            return "J"
        return "W" if x in _BEFORE else "i"
    if kind == "asg":
        return "a"
    if kind == "arrow":
        return "f" if x != "<-" else "b"
    if kind == "op":
        return "b" if x in ("..", "...", "..=", "&&", "||") else "o"
    if kind == "inc":
        return "z" if form != "py" else "b"
    if kind == "dot":
        return "xx" if x == "::" and form == "py" else "d"
    return {",": "c", ":": "x", ";": "m", "?": "t", "!": "u", "~": "u", "=": "a", "#": "u", "@": "b"}.get(x) or ("b" if x in "+-*&|<>" else "o" if x in "/%^" else "u")


def parse(text: str, form: str) -> tuple[int, int]:
    """(faults, end): how many tokens and brackets recovery dropped, closed or added, and where the function ends: behind
    the group that closes its body, or the end of the text. form: py, rs, go or ts."""
    pattern = _LEX[form]
    if form in ("rs", "ts"):
        text = _GENERIC.sub(lambda m: " " * len(m[0]), text)
    python = form == "py"
    grammar_ = "py" if python else "brace"
    faults, end = 0, len(text)
    stack: list[tuple[str, list[str]]] = [("", [])]
    for m in pattern.finditer(text):
        kind, x = m.lastgroup, m[0]
        if kind in ("ws", "skip"):
            continue
        level = stack[-1][1]
        if kind == "nl":
            if level and level[-1] != "\n" and (stack[-1][0] != "(" and stack[-1][0] != "[" if not python else len(stack) == 1):
                level.append("\n")
            continue
        if kind == "mark" and x in "([{":
            stack.append((x, []))
        elif kind == "mark" and x in ")]}":
            if len(stack) > 1 and stack[-1][0] == _CLOSERS[x]:
                opener, inner = stack.pop()
                faults += _level(grammar_, opener, "".join(inner))
                stack[-1][1].append(_GROUP[opener])
                if len(stack) == 1 and x == "}" and not python:
                    rest = text[m.end() :].lstrip()
                    if "F" in stack[0][1] or not rest or rest[0] not in ".,([{":
                        end = m.end()
            else:
                faults += 1
        else:
            level.append(_letter(kind, x, form))
    while len(stack) > 1:
        opener, inner = stack.pop()
        faults += 1 + _level(grammar_, opener, "".join(inner))
        stack[-1][1].append(_GROUP[opener])
    return faults + _level(grammar_, "", "".join(stack[0][1])), end


def _level(grammar_: str, opener: str, kinds: str) -> int:
    """Faults of one level. Statements end at separators and at line breaks that neither neighbour continues over."""
    if opener in ("(", "["):
        return _faults(grammar_, opener, _short(kinds.replace("\n", "")))
    if grammar_ != "py":
        kinds = re.sub(r"(?<=[obuacdtfW])\n|\n(?=[oacdtfxL])|(?<=L)\n", "", kinds)
    return sum(_faults(grammar_, "", _short(s)) for s in re.split(r"[m\n]", kinds) if s)


def _short(kinds: str) -> str:
    """Equal readings in fewer tokens: dotted names are one, and so are long lists of equal items."""
    kinds = re.sub(r"i(?:di)+", "i", kinds)
    kinds = re.sub(r"(?:(?<=[cmPQR])|^)((?:ixi|ix?[PQR]|i|[PQR])c)\1{2,}", r"\1\1", kinds)
    return re.sub(r"((?:[ob]i|iP|dP|diP)+?)\1{2,}", r"\1\1", kinds)


@lru_cache(maxsize=200_000)
def _faults(grammar_: str, opener: str, kinds: str) -> int:
    if not kinds:
        return 0
    if len(kinds) > 120:  # parts between commas have their readings by themselves
        return sum(_faults(grammar_, opener, x) for x in kinds.split("c") if x) if "c" in kinds else sum(_faults(grammar_, opener, kinds[i : i + 100]) for i in range(0, len(kinds), 100))
    return (_INNER[grammar_, opener] if opener else _PARSERS[grammar_]).dropped(kinds)
