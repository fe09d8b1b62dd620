"""Python 3: logical lines are parsed one by one, then the block structure by indentation."""

from __future__ import annotations

import re

from symloom.llm.syntax.base import END, IDENT, MEMO_LENGTH, MEMO_SIZE, NUMBER, STRING, Language, SyntaxFault

_WORDS = "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type".split()
_OPS = "**= //= >>= <<= ... -> := == != <= >= += -= *= /= %= &= |= ^= @= ** // << >>".split()
PY = Language(
    re.compile(
        r"(?:[ \t\f]++|\\\r?\n|#[^\n]*+)*+"
        r"(\r?\n[ \t\f]*|(?:[rRbBuUfFtT]{0,2})(?:\"\"\"(?:[^\"\\]++|\\.|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]++|\\.|'(?!''))*+'''|\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+')|[^\W\d]\w*"
        r"|0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.?\d[\d_]*\.?(?:[eE][+-]?\d[\d_]*)?[jJ]?"
        r"|" + "|".join(map(re.escape, sorted(_OPS, key=len, reverse=True))) + r"|.|\Z)",
        re.S,
    ),
    _WORDS,
    _OPS,
)
K = PY.kind
for _w in ("None", "True", "False"):
    PY.kinds[_w] = NUMBER
for _c in "$?!\\":
    PY.kinds[_c] = "\x7f"
_classify = PY.classify
PY.classify = lambda token: "\n" if token[0] in "\r\n" and token[-1:] != "\r" else _classify(token)  # type: ignore[method-assign]

NAME = IDENT + K["match"] + K["case"] + K["type"]
AUGMENTED = "".join(K[o] for o in "+= -= *= /= //= %= **= >>= <<= &= |= ^= @=".split())
PRECEDENCE = {K["or"]: 1, K["and"]: 2, **dict.fromkeys([K["in"], K["is"], K["not"], "<", ">", K["=="], K["!="], K["<="], K[">="]], 4), "|": 5, "^": 6, "&": 7, K["<<"]: 8, K[">>"]: 8, "+": 9, "-": 9, **dict.fromkeys(["*", "/", "%", "@", K["//"]], 10)}
HEADERS = {K[w]: w for w in "if elif else for while try except finally with def class".split()}


class Line:
    """One logical line."""

    memo: dict[str, tuple[str, bool, int, str]] = {}

    def __init__(self, kinds: str):
        self.k, self.p, self.n = kinds + END, 0, len(kinds)

    def at(self, kinds: str) -> bool:
        return self.p < self.n and self.k[self.p] in kinds

    def take(self, kinds: str) -> bool:
        if self.p < self.n and self.k[self.p] in kinds:
            self.p += 1
            return True
        return False

    def need(self, kinds: str, what: str) -> None:
        if not self.take(kinds):
            self.fail(what)

    def fail(self, what: str) -> None:
        got = "end of line" if self.p >= self.n else repr(PY.name.get(self.k[self.p], self.k[self.p]))
        raise SyntaxFault(self.p, f"expected {what}, found {got}")

    # -- the line
    @classmethod
    def read(cls, kinds: str) -> tuple[str, bool, int, str]:
        """(what it is, whether a block must follow, place of the fault or -1, message)."""
        got = cls.memo.get(kinds)
        if got is None:
            line = cls(kinds)
            try:
                what, block = line.line()
                got = (what, block, -1, "")
            except SyntaxFault as e:
                c = kinds[:1]
                got = (HEADERS.get(c, "other"), kinds[-1:] == ":", e.at, e.message)
            except RecursionError:
                got = ("other", kinds[-1:] == ":", -1, "")
            if len(kinds) <= MEMO_LENGTH:
                if len(cls.memo) >= MEMO_SIZE:
                    cls.memo.clear()
                cls.memo[kinds] = got
        return got

    def line(self) -> tuple[str, bool]:
        c = self.k[0]
        if c == "@":
            self.p = 1
            self.named()
            self.end()
            return "decorator", False
        prefix = ""
        if c == K["async"]:
            self.p = 1
            prefix, c = "async", self.k[1]
            if c not in K["def"] + K["for"] + K["with"]:
                self.fail("'def', 'for' or 'with'")
        if c in HEADERS:
            what = HEADERS[c]
            self.p += 1
            getattr(self, "h_" + what)()
            return what, self.suite()
        if c in K["match"] + K["case"] and self.k[self.n - 1] == ":" and self.k[1] not in "=.,:)" and not prefix:
            try:
                self.p = 1
                if c == K["match"]:
                    self.stars()
                else:
                    self.patterns()
                    if self.take(K["if"]):
                        self.named()
                self.need(":", "':'")
                self.end()
                return ("match" if c == K["match"] else "case"), True
            except SyntaxFault:
                self.p = 0
        elif c == K["case"] and not prefix:
            at = self.p
            try:
                self.p = 1
                self.patterns()
                if self.take(K["if"]):
                    self.named()
                self.need(":", "':'")
                self.simples()
                return "case", False
            except SyntaxFault:
                self.p = at
        self.simples()
        return "other", False

    def end(self) -> None:
        if self.p < self.n:
            self.fail("the end of the line")

    def suite(self) -> bool:
        self.need(":", "':'")
        if self.p == self.n:
            return True
        self.simples()
        return False

    def simples(self) -> None:
        self.simple()
        while self.take(";") and self.p < self.n:
            self.simple()
        self.end()

    def h_if(self) -> None:
        self.named()

    h_elif = h_while = h_if

    def h_else(self) -> None:
        pass

    h_try = h_finally = h_else

    def h_for(self) -> None:
        self.targets()
        self.need(K["in"], "'in'")
        self.stars()

    def h_except(self) -> None:
        self.take("*")
        if not self.at(":"):
            self.test()
            while self.take(","):
                self.test()
            if self.take(K["as"]):
                self.need(NAME, "a name")

    def h_with(self) -> None:
        if self.at("("):
            start = self.p
            try:
                self.p += 1
                while not self.take(")"):
                    self.with_item()
                    if not self.take(","):
                        self.need(")", "')'")
                        break
                if self.at(":"):
                    return
            except SyntaxFault:
                pass
            self.p = start
        self.with_item()
        while self.take(","):
            self.with_item()

    def with_item(self) -> None:
        self.test()
        if self.take(K["as"]):
            self.binary(5)

    def h_def(self) -> None:
        self.need(NAME, "the name of a function")
        self.type_parameters()
        self.need("(", "'('")
        self.parameters(")", True)
        if self.take(K["->"]):
            self.stars()

    def h_class(self) -> None:
        self.need(NAME, "the name of a class")
        self.type_parameters()
        if self.take("("):
            self.arguments()

    def type_parameters(self) -> None:
        if self.take("["):
            while not self.take("]"):
                self.take("*" + K["**"])
                self.need(NAME, "a type parameter")
                if self.take(":"):
                    self.test()
                if self.take("="):
                    self.star()
                if not self.take(","):
                    self.need("]", "']'")
                    return

    def parameters(self, close: str, typed: bool) -> None:
        while not self.take(close):
            if self.take("/"):
                pass
            elif self.take("*"):
                if self.at(NAME):
                    self.p += 1
                    if typed and self.take(":"):
                        self.star()
            else:
                self.take(K["**"])
                self.need(NAME, "a parameter")
                if typed and self.take(":"):
                    self.test()
                if self.take("="):
                    self.test()
            if not self.take(","):
                self.need(close, f"',' or '{close}'")
                return

    def simple(self) -> None:
        c = self.k[self.p]
        if c in K["pass"] + K["break"] + K["continue"]:
            self.p += 1
        elif c == K["return"]:
            self.p += 1
            if self.p < self.n and not self.at(";"):
                self.stars()
        elif c == K["raise"]:
            self.p += 1
            if self.p < self.n and not self.at(";"):
                self.test()
                if self.take(K["from"]):
                    self.test()
        elif c in K["global"] + K["nonlocal"]:
            self.p += 1
            self.need(NAME, "a name")
            while self.take(","):
                self.need(NAME, "a name")
        elif c == K["del"]:
            self.p += 1
            self.targets()
        elif c == K["assert"]:
            self.p += 1
            self.test()
            if self.take(","):
                self.test()
        elif c == K["import"]:
            self.p += 1
            self.dotted_as()
            while self.take(","):
                self.dotted_as()
        elif c == K["from"]:
            self.from_()
        elif c == K["type"] and self.k[self.p + 1] in NAME:
            self.p += 2
            self.type_parameters()
            self.need("=", "'='")
            self.test()
        else:
            self.expression_statement()

    def dotted(self) -> None:
        self.need(NAME, "the name of a module")
        while self.take("."):
            self.need(NAME, "the name of a module")

    def dotted_as(self) -> None:
        self.dotted()
        if self.take(K["as"]):
            self.need(NAME, "a name")

    def from_(self) -> None:
        self.p += 1
        dots = False
        while self.take("." + K["..."]):
            dots = True
        if not (dots and self.at(K["import"])):
            self.dotted()
        self.need(K["import"], "'import'")
        if self.take("*"):
            return
        paren = self.take("(")
        while True:
            self.need(NAME, "a name")
            if self.take(K["as"]):
                self.need(NAME, "a name")
            if not self.take(","):
                break
            if paren and self.at(")"):
                break
        if paren:
            self.need(")", "')'")

    def expression_statement(self) -> None:
        start = self.p
        self.value()
        if self.take(AUGMENTED):
            self.value()
        elif self.take(":"):
            self.test()
            if self.take("="):
                self.value()
        else:
            while self.at("="):
                if self.k[self.p - 1] in NUMBER + STRING and self.p - start == 1:
                    self.fail("a target before '='")
                self.p += 1
                start = self.p
                self.value()

    def value(self) -> None:
        if self.at(K["yield"]):
            self.yield_()
        else:
            self.stars()

    # -- expressions
    def stars(self) -> None:
        self.star()
        while self.take(","):
            if self.p >= self.n or self.at(")]}=:;" + AUGMENTED):
                return
            self.star()

    def star(self) -> None:
        if self.take("*"):
            self.binary(5)
        else:
            self.named()

    def named(self) -> None:
        self.test()
        if self.take(K[":="]):
            self.test()

    def targets(self) -> None:
        self.take("*")
        self.binary(5)
        while self.take(","):
            if self.p >= self.n or self.at(K["in"] + ";)]"):
                return
            self.take("*")
            self.binary(5)

    def test(self) -> None:
        if self.take(K["lambda"]):
            self.parameters(":", False)
            self.test()
            return
        self.binary(1)
        if self.take(K["if"]):
            self.binary(1)
            self.need(K["else"], "'else'")
            self.test()

    def binary(self, least: int) -> None:
        if least <= 3 and self.take(K["not"]):
            self.binary(3)
        else:
            self.unary()
        while True:
            c = self.k[self.p]
            rank = PRECEDENCE.get(c, 0)
            if rank < least or self.p >= self.n:
                return
            if c == K["not"]:
                if self.k[self.p + 1] != K["in"]:
                    return
                self.p += 2
            elif c == K["is"]:
                self.p += 1
                self.take(K["not"])
            else:
                self.p += 1
            self.binary(rank + 1)

    def unary(self) -> None:
        while self.take("+-~"):
            pass
        self.take(K["await"])
        self.primary()
        if self.take(K["**"]):
            self.unary()

    def primary(self) -> None:
        c = self.k[self.p]
        if self.p >= self.n:
            self.fail("an expression")
        if c in NAME or c == NUMBER or c == K["..."]:
            self.p += 1
        elif c == STRING:
            while self.take(STRING):
                pass
        elif c == "(":
            self.p += 1
            if self.at(K["yield"]):
                self.yield_()
            elif not self.at(")"):
                self.star()
                if self.at(K["for"] + K["async"]):
                    self.comprehension()
                elif self.take(",") and not self.at(")"):
                    self.stars()
            self.need(")", "')'")
        elif c == "[":
            self.p += 1
            if not self.at("]"):
                self.star()
                if self.at(K["for"] + K["async"]):
                    self.comprehension()
                elif self.take(",") and not self.at("]"):
                    self.stars()
            self.need("]", "']'")
        elif c == "{":
            self.braces()
        else:
            self.fail("an expression")
        while True:
            if self.take("."):
                self.need(NAME, "a name")
            elif self.take("("):
                self.arguments()
            elif self.take("["):
                self.subscripts()
            else:
                return

    def braces(self) -> None:
        self.p += 1
        first = True
        while not self.take("}"):
            if self.take(K["**"]):
                self.binary(5)
            else:
                self.star()
                if self.take(":"):
                    self.test()
            if first and self.at(K["for"] + K["async"]):
                self.comprehension()
            first = False
            if not self.take(","):
                self.need("}", "',' or '}'")
                return

    def arguments(self) -> None:
        while not self.take(")"):
            if self.take("*" + K["**"]):
                self.test()
            else:
                self.named()
                if self.take("="):
                    if self.k[self.p - 2] not in NAME:
                        self.fail("a name before '='")
                    self.test()
                elif self.at(K["for"] + K["async"]):
                    self.comprehension()
            if not self.take(","):
                self.need(")", "',' or ')'")
                return

    def subscripts(self) -> None:
        while not self.take("]"):
            if not self.at(":"):
                self.star()
            while self.take(":"):
                if not self.at(":],"):
                    self.test()
            if not self.take(","):
                self.need("]", "']'")
                return

    def comprehension(self) -> None:
        while self.at(K["for"] + K["async"]):
            self.take(K["async"])
            self.need(K["for"], "'for'")
            self.targets()
            self.need(K["in"], "'in'")
            self.binary(1) if not self.at(K["lambda"]) else self.test()
            while self.take(K["if"]):
                self.binary(1)
                if self.take(K[":="]):
                    self.binary(1)

    def yield_(self) -> None:
        self.p += 1
        if self.take(K["from"]):
            self.test()
        elif self.p < self.n and not self.at(")]};=" ):
            self.stars()

    # -- patterns
    def patterns(self) -> None:
        self.pattern()
        while self.take(","):
            if self.at(":" + K["if"]):
                return
            self.pattern()

    def pattern(self) -> None:
        self.take("*")
        self.closed()
        while self.take("|"):
            self.closed()
        if self.take(K["as"]):
            self.need(NAME, "a name")

    def closed(self) -> None:
        if self.take("-"):
            self.need(NUMBER, "a number")
        elif self.take(NUMBER):
            if self.take("+-"):
                self.need(NUMBER, "a number")
        elif self.at(STRING):
            while self.take(STRING):
                pass
        elif self.at("(["):
            close = ")" if self.k[self.p] == "(" else "]"
            self.p += 1
            while not self.take(close):
                self.pattern()
                if not self.take(","):
                    self.need(close, f"'{close}'")
                    return
        elif self.take("{"):
            while not self.take("}"):
                if self.take(K["**"]):
                    self.need(NAME, "a name")
                else:
                    self.closed()
                    self.need(":", "':'")
                    self.pattern()
                if not self.take(","):
                    self.need("}", "'}'")
                    return
        else:
            self.need(NAME, "a pattern")
            while self.take("."):
                self.need(NAME, "a name")
            if self.take("("):
                while not self.take(")"):
                    self.pattern()
                    if self.take("="):
                        self.pattern()
                    if not self.take(","):
                        self.need(")", "')'")
                        return


_FOLLOW = {
    "elif": {"if", "elif"},
    "else": {"if", "elif", "for", "while", "except"},
    "except": {"try", "except"},
    "finally": {"try", "except", "else of try"},
}


def _column(indent: str) -> int:
    n = 0
    for c in indent:
        n = n + 8 - n % 8 if c == "\t" else 0 if c == "\f" else n + 1
    return n


def check(text: str) -> list[tuple[int, str]]:
    tokens = [t for t in PY.pattern.findall(text) if t]
    kinds = "".join(map(PY.kinds.__getitem__, tokens))
    indents = [""] + [t.lstrip("\r\n") for t in tokens if t[0] in "\r\n" and len(t.strip(" \t\f")) > 0 and "\n" in t]
    first = text[: len(text) - len(text.lstrip(" \t\f"))]
    indents[0] = first
    faults: list[tuple[int, str]] = []
    logical: list[tuple[int, str, str]] = []  # token number, indentation, kinds
    at, open_, held, begin, margin = 0, 0, "", 0, ""
    for i, part in enumerate(kinds.split("\n")):
        if open_ or held:
            held += part
        elif part:
            held, begin, margin = part, at, indents[i]
        at += len(part) + 1
        if part:
            open_ += part.count("(") + part.count("[") + part.count("{") - part.count(")") - part.count("]") - part.count("}")
        if held and open_ <= 0:
            logical.append((begin, margin, held))
            held, open_ = "", 0
    if held:
        logical.append((begin, margin, held))
    if open_ > 0:
        faults.append((len(tokens), "expected a closing bracket, found end of file"))
    stack, last, inside = [0], ["other"], ["other"]
    owner, decorated = "", False
    for begin, margin, line in logical:
        what, block, fault, message = Line.read(line)
        col = _column(margin)
        if owner:
            if col > stack[-1]:
                stack.append(col)
                last.append("other")
                inside.append(owner)
            else:
                faults.append((begin, f"expected an indented block after '{owner}'"))
            owner = ""
        elif col > stack[-1]:
            faults.append((begin, "unexpected indentation"))
            stack.append(col)
            last.append("other")
            inside.append("other")
        while col < stack[-1]:
            if last[-1] == "try":
                faults.append((begin, "expected 'except' or 'finally' after 'try'"))
            stack.pop()
            last.pop()
            inside.pop()
            if stack[-1] < col:
                faults.append((begin, "the indentation matches no outer block"))
                stack.append(col)
                last.append("other")
                inside.append("other")
                break
        before = last[-1]
        if what in _FOLLOW:
            if before not in _FOLLOW[what]:
                faults.append((begin, f"'{what}' follows no statement it belongs to"))
            what_now = ("else of try" if before == "except" else "other") if what == "else" else what
        else:
            if before == "try":
                faults.append((begin, "expected 'except' or 'finally' after 'try'"))
            what_now = what
        if (what == "case") != (inside[-1] == "match") and fault < 0:
            faults.append((begin, "'case' stands outside 'match'" if what == "case" else "expected 'case' inside 'match'"))
        if decorated and what not in ("decorator", "def", "class"):
            faults.append((begin, "expected a function or class after a decorator"))
        decorated = what == "decorator"
        last[-1] = "other" if what == "finally" else what_now
        if fault >= 0:
            faults.append((begin + fault, message))
        if block:
            owner = what
    if owner:
        faults.append((len(tokens), f"expected an indented block after '{owner}'"))
    if "try" in last:
        faults.append((len(tokens), "expected 'except' or 'finally' after 'try'"))
    if decorated:
        faults.append((len(tokens), "expected a function or class after a decorator"))
    return sorted(set(faults))
