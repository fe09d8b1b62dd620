"""Go. Semicolons are put in at line ends, as the language says."""

from __future__ import annotations

import re

from symloom.llm.syntax.base import IDENT, NUMBER, STRING, Descent, Language

_WORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
_OPS = "&^= <<= >>= ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^".split()
GO = Language(
    re.compile(
        r"(?:[ \t\r\f]++|//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/)*+"
        r"(\n|[^\W\d]\w*|(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.?\d[\d_]*\.?(?:[eE][+-]?\d+)?)i?|\"(?:[^\"\\\n]++|\\.)*+\"|`[^`]*`|'(?:[^'\\\n]|\\[^\n]{1,9}?)'"
        r"|" + "|".join(map(re.escape, sorted(_OPS, key=len, reverse=True))) + r"|.|\Z)",
        re.S,
    ),
    _WORDS,
    _OPS,
)
GO.kinds["'"] = "\x7f"
K = GO.kind
_ENDS = set(IDENT + NUMBER + STRING + "t)]}" + K["break"] + K["continue"] + K["fallthrough"] + K["return"] + K["++"] + K["--"])
ASSIGN = "=" + "".join(K[o] for o in ":= += -= *= /= %= &= |= ^= <<= >>= &^=".split())
PRECEDENCE = {K["||"]: 1, K["&&"]: 2, **dict.fromkeys([K["=="], K["!="], "<", ">", K["<="], K[">="]], 3), **dict.fromkeys("+-|^", 4), **dict.fromkeys(["*", "/", "%", "&", K["<<"], K[">>"], K["&^"]], 5)}
UNARY = "+-!^*&" + K["<-"]
TYPE_START = IDENT + "*[(" + "".join(K[w] for w in ("func", "map", "chan", "struct", "interface", "<-"))


_LINE_END = re.compile("([" + re.escape("".join(sorted(_ENDS))) + "])(\n|\\Z)")


def with_semicolons(kinds: str) -> str:
    return _LINE_END.sub(r"\1;\2", kinds)


class Go(Descent):
    lang, memo, newlines = GO, {}, False

    def opening(self) -> None:
        self.need(K["package"], "'package'")
        self.need(IDENT, "the name of the package")
        self.need(";", "the end of the clause")

    def top(self) -> None:
        if self.take(K["import"]):
            if self.take("("):
                self.lines(")", self.import_spec)
            else:
                self.import_spec()
        elif self.at(K["func"]):
            self.function()
        elif self.at(K["type"] + K["var"] + K["const"]):
            self.declaration()
        elif not self.at(";"):
            self.fail("a declaration")
        self.need(";", "the end of the declaration")

    def lines(self, close: str, item) -> None:
        while not self.take(close):
            if self.p >= self.n:
                self.fail(f"'{close}'")
            item()
            if not self.take(";"):
                self.need(close, f"';' or '{close}'")
                return

    def import_spec(self) -> None:
        self.take(IDENT + ".")
        self.need(STRING + "t", "an import path")

    def declaration(self) -> None:
        kind = self.k[self.p]
        self.p += 1
        item = self.type_spec if kind == K["type"] else self.value_spec
        if self.take("("):
            self.lines(")", item)
        else:
            item()

    def type_spec(self) -> None:
        self.need(IDENT, "the name of a type")
        if self.at("[") and self.k[self.p + 1] == IDENT and self.k[self.p + 2] not in "]" :
            self.balanced()
        self.take("=")
        self.type()

    def names(self) -> None:
        self.need(IDENT, "a name")
        while self.take(","):
            self.need(IDENT, "a name")

    def value_spec(self) -> None:
        self.names()
        if not self.at("=;)"):
            self.type()
        if self.take("="):
            self.expressions()

    def function(self) -> None:
        self.p += 1
        if self.at("("):
            self.parameters()
        self.need(IDENT, "the name of a function")
        if self.at("["):
            self.balanced()
        self.signature()
        if self.at("{"):
            self.block()

    def signature(self) -> None:
        self.parameters()
        if self.at("("):
            self.parameters()
        elif self.at(TYPE_START):
            self.type()

    def parameters(self) -> None:
        self.need("(", "'('")
        self.listed(")", self.parameter)

    def parameter(self) -> None:
        if self.take(K["..."]):
            self.type()
            return
        self.type()
        if self.take(K["..."]) or self.at(TYPE_START):
            self.type()

    def type(self) -> None:
        if self.take("*"):
            self.type()
        elif self.take("("):
            self.type()
            self.need(")", "')'")
        elif self.take("["):
            if not self.take("]"):
                if not self.take(K["..."]):
                    self.expression()
                self.need("]", "']'")
            self.type()
        elif self.take(K["map"]):
            self.need("[", "'['")
            self.type()
            self.need("]", "']'")
            self.type()
        elif self.take(K["<-"]):
            self.need(K["chan"], "'chan'")
            self.type()
        elif self.take(K["chan"]):
            self.take(K["<-"])
            self.type()
        elif self.take(K["func"]):
            self.signature()
        elif self.take(K["struct"]):
            self.need("{", "'{'")
            self.lines("}", self.field)
        elif self.take(K["interface"]):
            self.need("{", "'{'")
            self.lines("}", self.method)
        else:
            self.need(IDENT, "a type")
            if self.take("."):
                self.need(IDENT, "a name")
            if self.at("[") and self.k[self.p + 1] != "]":
                self.p += 1
                self.listed("]", self.type)

    def field(self) -> None:
        if self.take("*"):
            self.type()
        else:
            self.need(IDENT, "a field")
            if self.take("."):
                self.need(IDENT, "a name")
            elif not self.at(STRING + "t;}"):
                while self.take(","):
                    self.need(IDENT, "a field")
                self.type()
        self.take(STRING + "t")

    def method(self) -> None:
        if self.k[self.p] == IDENT and self.k[self.p + 1] == "(":
            self.p += 1
            self.signature()
            return
        self.take("~")
        self.type()
        while self.take("|"):
            self.take("~")
            self.type()

    # -- statements
    def block(self) -> None:
        self.need("{", "'{'")
        self.body("}")
        self.need("}", "'}'")

    def body(self, close: str) -> None:
        while self.p < self.n and not self.at(close):
            if not self.take(";"):
                self.guarded("s", self.statement_end, ";" + close)

    def statement_end(self) -> None:
        self.statement()
        if not self.at("}" + K["case"] + K["default"]):
            self.need(";", "the end of the statement")

    def statement(self) -> None:
        c = self.k[self.p]
        if c in K["var"] + K["const"] + K["type"]:
            self.declaration()
        elif c == "{":
            self.block()
        elif c == K["if"]:
            self.if_()
        elif c == K["for"]:
            self.for_()
        elif c == K["switch"]:
            self.switch()
        elif c == K["select"]:
            self.p += 1
            self.cases(False)
        elif c == K["return"]:
            self.p += 1
            if not self.at(";}"):
                self.expressions()
        elif c in K["break"] + K["continue"]:
            self.p += 1
            self.take(IDENT)
        elif c == K["goto"]:
            self.p += 1
            self.need(IDENT, "a label")
        elif c == K["fallthrough"]:
            self.p += 1
        elif c in K["go"] + K["defer"]:
            self.p += 1
            self.expression()
        elif c == IDENT and self.k[self.p + 1] == ":":
            self.p += 2
            if not self.at(";}"):
                self.statement()
        else:
            self.simple()

    def simple(self) -> None:
        self.expressions()
        if self.take(ASSIGN):
            if not self.take(K["range"]):
                self.expressions()
            else:
                self.expression()
        elif self.take(K["<-"]):
            self.expression()
        else:
            self.take(K["++"] + K["--"])

    def header(self, stops: str) -> None:
        """[simple ;] [expression] before a block; composite literals need parentheses here."""
        held, self.literal = self.literal, False
        if not self.at("{"):
            if not self.at(";"):
                self.simple()
            if self.take(";") and not self.at("{"):
                self.simple()
        self.literal = held

    literal = True

    def if_(self) -> None:
        self.p += 1
        if self.at("{"):
            self.fail("a condition")
        self.header("{")
        self.block()
        if self.take(K["else"]):
            if self.at(K["if"]):
                self.if_()
            else:
                self.block()

    def for_(self) -> None:
        self.p += 1
        held, self.literal = self.literal, False
        if self.take(K["range"]):
            self.expression()
        elif not self.at("{"):
            if not self.at(";"):
                self.simple()
            if self.take(";"):
                if not self.at(";{"):
                    self.expression()
                if self.take(";") and not self.at("{"):
                    self.simple()
        self.literal = held
        self.block()

    def switch(self) -> None:
        self.p += 1
        self.header("{")
        self.cases(True)

    def cases(self, values: bool) -> None:
        self.need("{", "'{'")
        held, self.literal = self.literal, True
        while not self.take("}"):
            if self.take(K["case"]):
                if values:
                    self.case_values()
                else:
                    self.simple()
            else:
                self.need(K["default"], "'case' or '}'")
            self.need(":", "':'")
            self.body("}" + K["case"] + K["default"])
        self.literal = held

    def case_values(self) -> None:
        while True:
            if self.at(K["func"] + K["map"] + K["chan"] + "[" + K["interface"] + K["struct"]):
                self.type()
                if self.at("({"):
                    self.postfix()
            else:
                self.expression()
            if not self.take(","):
                return

    # -- expressions
    def expressions(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def expression(self, least: int = 1) -> None:
        while self.take(UNARY):
            pass
        self.primary()
        while (rank := PRECEDENCE.get(self.k[self.p], 0)) >= least:
            self.p += 1
            self.expression(rank + 1)

    def primary(self) -> None:
        c = self.k[self.p]
        if c in NUMBER + STRING + "t" and c != "\x00":
            self.p += 1
        elif c == IDENT:
            self.p += 1
        elif c == "(":
            self.p += 1
            held, self.literal = self.literal, True
            if self.at(K["func"] + K["map"] + K["chan"] + "[*" + K["struct"] + K["interface"]):
                start = self.p
                try:
                    self.expression()
                except Exception:
                    self.p = start
                    self.type()
            else:
                self.expression()
            self.literal = held
            self.need(")", "')'")
        elif c == K["func"]:
            self.p += 1
            self.signature()
            if self.at("{"):
                held, self.literal = self.literal, True
                self.block()
                self.literal = held
        elif c in "[" + K["map"] + K["chan"] + K["struct"] + K["interface"]:
            self.type()
            if self.at("{"):
                self.composite()
        else:
            self.fail("an expression")
        self.postfix()

    def postfix(self) -> None:
        while True:
            if self.take("."):
                if self.take("("):
                    if not self.take(K["type"]):
                        self.type()
                    self.need(")", "')'")
                else:
                    self.need(IDENT, "a name")
            elif self.take("("):
                held, self.literal = self.literal, True
                self.listed(")", self.argument)
                self.literal = held
            elif self.take("["):
                held, self.literal = self.literal, True
                if not self.at(":"):
                    self.argument()
                while self.take(",:"):
                    if not self.at("]:"):
                        self.argument()
                self.literal = held
                self.need("]", "']'")
            elif self.at("{") and self.literal and self.k[self.p - 1] in IDENT + "]":
                self.composite()
            else:
                return

    def argument(self) -> None:
        if self.at(K["map"] + K["chan"] + K["interface"] + K["struct"]) or self.at("[*"):
            start = self.p
            try:
                self.expression()
            except Exception:
                self.p = start
                self.type()
        else:
            self.expression()
        self.take(K["..."])

    def composite(self) -> None:
        self.need("{", "'{'")
        held, self.literal = self.literal, True
        self.listed("}", self.element)
        self.literal = held

    def element(self) -> None:
        self.value()
        if self.take(":"):
            self.value()

    def value(self) -> None:
        if self.at("{"):
            self.composite()
        else:
            self.expression()


def check(text: str) -> list[tuple[int, str]]:
    kinds = GO.lex(text)
    marked = with_semicolons(kinds)
    if not marked.strip("\n"):
        return []
    faults = Go(marked).run()
    if not faults:
        return []
    # a semicolon that was put in has no token of its own
    real, k = [], 0
    for c in marked:
        real.append(k)
        k += k < len(kinds) and kinds[k] == c
    return [(real[p] if p < len(real) else len(kinds), m) for p, m in faults]
