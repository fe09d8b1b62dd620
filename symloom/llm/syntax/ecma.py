"""ECMAScript modules and TypeScript, with markup in jsx and tsx."""

from __future__ import annotations

import re

from symloom.llm.syntax.base import END, IDENT, NUMBER, ODD, STRING, Descent, Language, SyntaxFault

_RESERVED = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield await let enum null".split()
_SOFT = "async of as from get set static type interface namespace module declare abstract readonly keyof infer is asserts implements public private protected override satisfies unique accessor global using out".split()
_OPS = ">>>= ... === !== **= <<= >>= &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= ** <<".split()
_REGEX = r"/(?![/*])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*"
_TEMPLATE = r"`(?:[^`\\$]|\\.|\$(?!\{)|\$\{(?:[^{}`]|`[^`]*`|\{(?:[^{}]|\{[^{}]*\})*\})*\})*`"


def _pattern() -> re.Pattern:
    return re.compile(
        r"(?:[ \t\r\f\v ﻿]+|//[^\n]*|/\*(?:[^*]++|\*(?!/))*+\*/|\A#![^\n]*)*+"
        r"(\n|(?:=>|\|\||&&|\?\?|===?|!==?|[(,=:\[!&|?{;+*%~^-]|\breturn|\btypeof|\bcase|\bin|\bof)\s*" + _REGEX + r"|[#@]?(?:[^\W\d]|\$)[\w$]*"
        r"|(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+)n?|(?:\d[\d_]*)?\.?\d[\d_]*\.?(?!\.)(?:[eE][+-]?\d[\d_]*)?n?"
        r"|\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+'|" + _TEMPLATE + r"|\?\.(?=\d)|" + "|".join(map(re.escape, sorted(_OPS, key=len, reverse=True))) + r"|^" + _REGEX + r"|.|\Z)",
        re.S | re.M,
    )


JS = Language(_pattern(), [*_RESERVED, *_SOFT], _OPS)
K = JS.kind
for _w in ("null",):
    JS.kinds[_w] = NUMBER
JS.kinds["\\"] = ODD
_classify = JS.classify
_HEAD_OF_REGEX = re.compile(r"(=>|\|\||&&|\?\?|===?|!==?|[a-z]+|[^\w\s])\s*/", re.S)


def _kind(token: str) -> str:
    if len(token) > 2:
        c = token[0]
        if c == "/":
            return NUMBER
        if c in "(,=:[!&|?{;+*%~^-" or token[-1] not in "\"'`" and "/" in token:
            m = _HEAD_OF_REGEX.match(token)
            if m:
                return JS.kinds[m.group(1)] + NUMBER
    if token[0] in "#@":
        if len(token) == 1:
            return token
        # a decorator is its mark and a name, a private name is a name
        return "@" + JS.kinds[token[1:]] if token[0] == "@" else IDENT
    return _classify(token)


JS.classify = _kind  # type: ignore[method-assign]

SOFT = "".join(K[w] for w in _SOFT)
NAME = IDENT + SOFT + K["yield"] + K["await"] + K["let"]
WORD = NAME + "".join(K[w] for w in _RESERVED) + NUMBER
ASSIGN = "=" + "".join(K[o] for o in "+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
PRECEDENCE = {K["??"]: 1, K["||"]: 2, K["&&"]: 3, "|": 4, "^": 5, "&": 6, **dict.fromkeys([K["=="], K["!="], K["==="], K["!=="]], 7)}
PRECEDENCE |= {**dict.fromkeys(["<", ">", K["<="], K[">="], K["instanceof"], K["in"]], 8), K["<<"]: 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, K["**"]: 12}
UNARY = "!~+-" + "".join(K[w] for w in ("++", "--", "typeof", "void", "delete", "await"))
MODIFIERS = "".join(K[w] for w in "static public private protected readonly override abstract declare async accessor".split())


class Ecma(Descent):
    lang, memo = JS, {}
    typed = markup = False
    no_in = False
    goes_on = ".,;?:=+-*/%&|^<>([" + ")" + "".join(K[o] for o in _OPS if o not in ("++", "--", "...")) + "".join(K[w] for w in "else catch finally instanceof in as satisfies".split()) + "t"

    # -- statements
    def semi(self) -> None:
        if not (self.take(";") or self.p >= self.n or self.at("}") or self.fresh()):
            self.fail("';'")

    def top(self) -> None:
        if self.at(K["import"]) and self.k[self.p + 1] not in "(.":
            self.import_()
        elif self.at(K["export"]):
            self.export()
        elif self.at("}"):
            self.fail("a statement")
        else:
            self.statement()

    def body(self, close: str = "}") -> None:
        while self.p < self.n and not self.at(close):
            self.guarded("s", self.statement, close)

    def block(self) -> None:
        self.need("{", "'{'")
        held, self.no_in = self.no_in, False
        self.body()
        self.no_in = held
        self.need("}", "'}'")

    def statement(self) -> None:
        c, after = self.k[self.p], self.k[self.p + 1] if self.p < self.n else END
        if c == "{":
            self.block()
        elif c == ";":
            self.p += 1
        elif c == K["using"] and after in NAME and self.nl[self.p + 1] == "0" or c == K["await"] and after == K["using"] and self.k[self.p + 2 : self.p + 3] in NAME:
            self.take(K["await"])
            self.variables()
            self.semi()
        elif c in K["var"] + K["const"] or c == K["let"] and after in NAME + "[{":
            self.variables()
            self.semi()
        elif c == K["function"] or c == K["async"] and after == K["function"] and self.nl[self.p + 1] == "0":
            self.function(True)
        elif c in K["class"] + "@":
            self.class_(True)
        elif c == K["if"]:
            self.p += 1
            self.parens()
            self.statement_guard()
            if self.take(K["else"]):
                self.statement_guard()
        elif c == K["for"]:
            self.for_()
        elif c == K["while"]:
            self.p += 1
            self.parens()
            self.statement_guard()
        elif c == K["do"]:
            self.p += 1
            self.statement_guard()
            self.need(K["while"], "'while'")
            self.parens()
            self.take(";")
        elif c == K["switch"]:
            self.switch()
        elif c == K["try"]:
            self.p += 1
            self.block()
            caught = self.take(K["catch"])
            if caught:
                if self.take("("):
                    self.binding()
                    self.annotation()
                    self.need(")", "')'")
                self.block()
            if self.take(K["finally"]):
                self.block()
            elif not caught:
                self.fail("'catch' or 'finally'")
        elif c == K["return"]:
            self.p += 1
            if not (self.at(";}") or self.p >= self.n or self.fresh()):
                self.expression()
            self.semi()
        elif c == K["throw"]:
            self.p += 1
            if self.fresh():
                self.fail("an expression on the line of 'throw'")
            self.expression()
            self.semi()
        elif c in K["break"] + K["continue"]:
            self.p += 1
            if self.at(NAME) and not self.fresh():
                self.p += 1
            self.semi()
        elif c == K["debugger"]:
            self.p += 1
            self.semi()
        elif c in NAME and after == ":":
            self.p += 2
            self.statement_guard()
        elif self.typed and self.typescript(c, after):
            pass
        else:
            self.expression()
            self.semi()

    def statement_guard(self) -> None:
        if self.p >= self.n:
            self.fail("a statement")
        self.level += 1
        if self.level > self.deepest:
            raise SyntaxFault(self.n, "nesting too deep")
        self.statement()
        self.level -= 1

    def parens(self) -> None:
        self.need("(", "'('")
        self.expression()
        self.need(")", "')'")

    def variables(self) -> None:
        if self.take(K["const"]) and self.typed and self.at(K["enum"]):
            self.enum()
            return
        if self.k[self.p - 1] != K["const"]:
            self.p += 1
        while True:
            self.binding()
            self.take("!")
            self.annotation()
            if self.take("="):
                self.assignment()
            if not self.take(","):
                return

    def for_(self) -> None:
        self.p += 1
        self.take(K["await"])
        self.need("(", "'('")
        held, self.no_in = self.no_in, True
        if not self.at(";"):
            if self.at(K["var"] + K["const"]) or self.at(K["let"]) and self.k[self.p + 1] in NAME + "[{":
                self.variables()
            else:
                self.expression()
        self.no_in = held
        if self.take(K["of"]):
            self.assignment()
        elif self.take(K["in"]):
            self.expression()
        else:
            self.need(";", "';', 'of' or 'in'")
            if not self.at(";"):
                self.expression()
            self.need(";", "';'")
            if not self.at(")"):
                self.expression()
        self.need(")", "')'")
        self.statement_guard()

    def switch(self) -> None:
        self.p += 1
        self.parens()
        self.need("{", "'{'")
        while not self.take("}"):
            if self.take(K["case"]):
                self.expression()
            else:
                self.need(K["default"], "'case' or '}'")
            self.need(":", "':'")
            self.body("}" + K["case"] + K["default"])

    def import_(self) -> None:
        self.p += 1
        if self.take(STRING):
            self.semi()
            return
        if self.typed and self.at(K["type"]) and self.k[self.p + 1] in NAME + "{*" and not (self.k[self.p + 1] == K["from"] and self.k[self.p + 2] == STRING):
            self.p += 1
        if self.take(NAME):
            if self.typed and self.take("="):
                self.expression()
                self.semi()
                return
            if self.take(","):
                self.imported()
        else:
            self.imported()
        self.need(K["from"], "'from'")
        self.need(STRING, "the name of a module")
        self.with_clause()
        self.semi()

    def with_clause(self) -> None:
        if self.take(K["with"]) or self.at(IDENT) and self.k[self.p + 1] == "{" and self.take(IDENT):
            self.balanced()

    def imported(self) -> None:
        if self.take("*"):
            self.need(K["as"], "'as'")
            self.need(NAME, "a name")
        else:
            self.need("{", "'{'")
            self.listed("}", self.specifier)

    def specifier(self) -> None:
        if self.at(K["type"]) and self.k[self.p + 1] in WORD and self.k[self.p + 1] != K["as"]:
            self.p += 1
        self.need(WORD + STRING, "a name")
        if self.take(K["as"]):
            self.need(WORD + STRING, "a name")

    def export(self) -> None:
        self.p += 1
        if self.take(K["default"]):
            if self.at(K["function"]) or self.at(K["async"]) and self.k[self.p + 1] == K["function"]:
                self.function(False)
            elif self.at(K["class"] + "@" + K["abstract"]):
                self.take(K["abstract"])
                self.class_(False)
            elif self.typed and self.at(K["interface"]):
                self.typescript(self.k[self.p], self.k[self.p + 1])
            else:
                self.assignment()
                self.semi()
        elif self.take("*"):
            if self.take(K["as"]):
                self.need(WORD + STRING, "a name")
            self.need(K["from"], "'from'")
            self.need(STRING, "the name of a module")
            self.with_clause()
            self.semi()
        elif self.at("{") or self.typed and self.at(K["type"]) and self.k[self.p + 1] in "{*":
            self.take(K["type"])
            if self.take("*"):
                if self.take(K["as"]):
                    self.need(NAME, "a name")
            else:
                self.need("{", "'{'")
                self.listed("}", self.specifier)
            if self.take(K["from"]):
                self.need(STRING, "the name of a module")
                self.with_clause()
            self.semi()
        elif self.typed and self.take("="):
            self.expression()
            self.semi()
        elif self.typed and self.take(K["as"]):
            self.need(K["namespace"], "'namespace'")
            self.need(NAME, "a name")
            self.semi()
        elif self.at(K["var"] + K["const"] + K["let"] + K["function"] + K["async"] + K["class"] + "@") or self.typed and self.at(SOFT + K["enum"] + K["import"]):
            if self.at(K["import"]):
                self.import_()
            else:
                self.statement()
        else:
            self.fail("a declaration")

    # -- functions and classes
    def function(self, named: bool) -> None:
        self.take(K["async"])
        self.need(K["function"], "'function'")
        self.take("*")
        if named or self.at(NAME):
            self.need(NAME, "the name of a function")
        self.callable()

    def callable(self, body: bool = True) -> None:
        self.type_parameters()
        self.parameters()
        if self.typed and self.take(":"):
            self.returned()
        if self.at("{"):
            self.block()
        elif self.typed:
            self.semi()
        else:
            self.fail("'{'")

    def parameters(self) -> None:
        self.need("(", "'('")
        self.listed(")", self.parameter)

    def parameter(self) -> None:
        while self.at("@"):
            self.decorator()
        if self.typed:
            while self.at(MODIFIERS) and self.k[self.p + 1] in NAME + "{[":
                self.p += 1
            if self.at(K["this"]):
                self.p += 1
                self.annotation()
                return
        self.take(K["..."])
        self.binding()
        if self.typed:
            self.take("?")
        self.annotation()
        if self.take("="):
            self.assignment()

    def binding(self) -> None:
        if self.take("{"):
            self.listed("}", self.property_binding)
        elif self.take("["):
            self.listed("]", self.element_binding)
        else:
            self.need(NAME, "a name")

    def property_binding(self) -> None:
        if self.take(K["..."]):
            self.need(NAME, "a name")
            return
        self.key()
        if self.take(":"):
            self.binding()
        if self.take("="):
            self.assignment()

    def element_binding(self) -> None:
        if self.at(",]"):
            return
        self.take(K["..."])
        self.binding()
        if self.take("="):
            self.assignment()

    def key(self) -> None:
        if self.take("["):
            held, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = held
            self.need("]", "']'")
        else:
            self.need(WORD + STRING + NUMBER, "a name")

    def decorator(self) -> None:
        self.need("@", "'@'")
        if self.at("("):
            self.parens()
            return
        self.need(WORD, "a name")
        while self.take("."):
            self.need(WORD, "a name")
        self.type_arguments()
        if self.at("("):
            self.arguments()

    def class_(self, named: bool) -> None:
        while self.at("@"):
            self.decorator()
        self.take(K["export"])
        self.take(K["default"])
        self.take(K["abstract"])
        self.need(K["class"], "'class'")
        if self.at(NAME) and not (self.at(K["implements"]) and not named):
            self.p += 1
        self.type_parameters()
        if self.take(K["extends"]):
            self.unary()
            self.type_arguments()
        if self.typed and self.take(K["implements"]):
            self.type()
            while self.take(","):
                self.type()
        self.need("{", "'{'")
        held, self.no_in = self.no_in, False
        while self.p < self.n and not self.at("}"):
            if not self.take(";"):
                self.guarded("m", self.member, "}")
        self.no_in = held
        self.need("}", "'}'")

    def member(self) -> None:
        while self.at("@"):
            self.decorator()
        if self.at(K["static"]) and self.k[self.p + 1] == "{":
            self.p += 1
            self.block()
            return
        while self.at(MODIFIERS) and self.k[self.p + 1] not in "(=;:?!<}" + END and not (self.nl[self.p + 1] == "1" and not self.at(K["static"] + K["public"] + K["private"] + K["protected"])):
            self.p += 1
        star = self.take("*")
        if not star and self.at(K["get"] + K["set"]) and self.k[self.p + 1] not in "(=;:?!<}" + END:
            self.p += 1
        if self.typed and self.at("[") and self.k[self.p + 1] in NAME and self.k[self.p + 2] in ":" + K["in"]:
            self.balanced()
            self.annotation()
            self.semi()
            return
        self.key()
        if self.typed:
            self.take("?!")
        if self.at("(<"):
            self.callable()
            return
        self.annotation()
        if self.take("="):
            self.assignment()
        self.semi()

    # -- expressions
    def expression(self) -> None:
        self.assignment()
        while self.take(","):
            self.assignment()

    def assignment(self) -> None:
        self.level += 1
        if self.level > self.deepest:
            raise SyntaxFault(self.n, "nesting too deep")
        c = self.k[self.p]
        after = self.k[self.p + 1] if self.p < self.n else END
        if c == K["yield"]:
            self.p += 1
            if not (self.at(")]},;:") or self.p >= self.n or self.fresh()):
                self.take("*")
                self.assignment()
        elif c in NAME and after == K["=>"] or c == K["async"] and after in NAME and self.nl[self.p + 1] == "0" and self.k[self.p + 2 : self.p + 3] == K["=>"]:
            self.p += 1 + (after != K["=>"])
            self.arrow_body()
        elif (c in "(<" or c == K["async"] and after in "(<") and c != END and self.arrow():
            pass
        else:
            self.conditional()
            if self.at(ASSIGN):
                if self.k[self.p - 1] in NUMBER + STRING + "t":
                    self.fail("a target before the assignment")
                self.p += 1
                self.assignment()
        self.level -= 1

    def arrow_body(self) -> None:
        self.need(K["=>"], "'=>'")
        if self.at("{"):
            self.block()
        else:
            self.assignment()

    def closing(self, at: int) -> int:
        """The token after the bracket that closes the one at `at`; -1 without one."""
        depth = 0
        for i in range(at, self.n):
            c = self.k[i]
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
                if not depth:
                    return i + 1
        return -1

    def arrow(self) -> bool:
        """An arrow function with parentheses, if there is one here."""
        start, level, known = self.p, self.level, len(self.faults)
        at = start + (self.k[start] == K["async"])
        if self.k[at] == "<":
            if not self.typed:
                return False
        else:
            end = self.closing(at)
            if end < 0 or not (self.k[end] == K["=>"] or self.typed and self.k[end] == ":"):
                return False
        try:
            self.p = at
            self.type_parameters()
            self.parameters()
            if self.typed and self.take(":"):
                self.returned()
            if not self.at(K["=>"]):
                raise SyntaxFault(self.p, "expected '=>'")
        except SyntaxFault:
            self.p, self.level = start, level
            del self.faults[known:]
            return False
        self.arrow_body()
        return True

    def conditional(self) -> None:
        self.binary(1)
        if self.take("?"):
            held, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = held
            self.need(":", "':'")
            self.assignment()

    def binary(self, least: int) -> None:
        self.unary()
        while self.p < self.n:
            c = self.k[self.p]
            if self.typed and c in K["as"] + K["satisfies"] and not self.fresh():
                self.p += 1
                if not self.take(K["const"]):
                    self.type()
                continue
            rank = PRECEDENCE.get(c, 0)
            if rank < least or c == K["in"] and self.no_in:
                return
            self.p += 1
            if c == ">":
                while self.at(">") and self.nl[self.p] == "0":
                    self.p += 1
                    rank = 9
                if self.at(K[">="]):  # >>=
                    self.p += 1
                    self.assignment()
                    return
            self.binary(rank + (c != K["**"]))

    def unary(self) -> None:
        while self.take(UNARY):
            pass
        self.postfix()
        if self.at(K["++"] + K["--"]) and not self.fresh():
            self.p += 1

    def postfix(self) -> None:
        if self.take(K["new"]):
            if self.take("."):
                self.need(NAME, "'target'")
            else:
                self.new()
        else:
            self.primary()
        self.tail(True)

    def new(self) -> None:
        if self.take(K["new"]):
            self.new()
        else:
            self.primary()
        self.tail(False)
        self.type_arguments()
        if self.at("("):
            self.arguments()

    def tail(self, calls: bool) -> None:
        while self.p < self.n:
            c = self.k[self.p]
            if c == ".":
                self.p += 1
                self.need(WORD, "a name")
            elif c == K["?."]:
                self.p += 1
                if self.at("("):
                    self.arguments()
                elif self.take("["):
                    self.expression()
                    self.need("]", "']'")
                else:
                    self.need(WORD, "a name")
            elif c == "[":
                self.p += 1
                held, self.no_in = self.no_in, False
                self.expression()
                self.no_in = held
                self.need("]", "']'")
            elif c == "(" and calls:
                self.arguments()
            elif c == "t":
                self.p += 1
            elif c == "!" and self.typed and not self.fresh():
                self.p += 1
            elif c == "<" and self.typed and calls and self.called_with_types():
                pass
            else:
                return

    def called_with_types(self) -> bool:
        start = self.p
        try:
            self.type_arguments()
            if self.at("(t") or self.p > start and (self.at(");,]}:") or self.fresh()):
                return self.p > start
        except SyntaxFault:
            pass
        self.p = start
        return False

    def arguments(self) -> None:
        self.need("(", "'('")
        held, self.no_in = self.no_in, False
        self.listed(")", self.argument)
        self.no_in = held

    def argument(self) -> None:
        self.take(K["..."])
        self.assignment()

    def element(self) -> None:
        if not self.at(",]"):
            self.argument()

    def primary(self) -> None:
        if self.p >= self.n:
            self.fail("an expression")
        c = self.k[self.p]
        if c == K["async"] and self.k[self.p + 1] == K["function"]:
            self.function(False)
        elif c in NAME + NUMBER + STRING + "t" + K["this"] + K["super"]:
            self.p += 1
        elif c == "(":
            self.p += 1
            held, self.no_in = self.no_in, False
            self.expression()
            self.no_in = held
            self.need(")", "')'")
        elif c == "[":
            self.p += 1
            held, self.no_in = self.no_in, False
            self.listed("]", self.element)
            self.no_in = held
        elif c == "{":
            self.p += 1
            held, self.no_in = self.no_in, False
            self.listed("}", self.property)
            self.no_in = held
        elif c == K["function"]:
            self.function(False)
        elif c in K["class"] + "@":
            self.class_(False)
        elif c == K["import"]:
            self.p += 1
            if self.take("."):
                self.need(WORD, "a name")
            else:
                self.arguments()
        elif c == "<" and self.markup:
            self.element_markup()
        elif c == "<" and self.typed:
            self.p += 1
            self.type()
            self.need(">", "'>'")
            self.unary()
        else:
            self.fail("an expression")

    def property(self) -> None:
        if self.take(K["..."]):
            self.assignment()
            return
        while self.at(K["async"] + K["get"] + K["set"]) and self.k[self.p + 1] not in "(,:=}<" + END:
            self.p += 1
        self.take("*")
        name = self.at(NAME)
        self.key()
        if self.at("(<"):
            self.callable()
        elif self.take(":"):
            self.assignment()
        elif self.take("="):
            self.assignment()
        elif not name or self.k[self.p - 1] == "]":
            self.fail("':'")

    # -- markup
    def element_markup(self) -> None:
        self.need("<", "'<'")
        if self.take(">"):
            self.children()
            return
        self.tag()
        self.type_arguments()
        while not self.at(">/"):
            if self.take("{"):
                self.need(K["..."], "'...'")
                self.assignment()
                self.need("}", "'}'")
                continue
            self.need(WORD, "an attribute")
            while self.take("-:"):
                self.need(WORD, "an attribute")
            if self.take("="):
                if self.take("{"):
                    self.assignment()
                    self.need("}", "'}'")
                elif self.at("<"):
                    self.element_markup()
                else:
                    self.need(STRING, "a value")
        if self.take("/"):
            self.need(">", "'>'")
        else:
            self.need(">", "'>'")
            self.children()

    def tag(self) -> None:
        self.need(WORD, "the name of an element")
        while self.take(".:-"):
            self.need(WORD, "the name of an element")

    def children(self) -> None:
        while True:
            if self.p >= self.n:
                self.fail("a closing tag")
            if self.at("<"):
                if self.k[self.p + 1] == "/":
                    self.p += 2
                    if not self.take(">"):
                        self.tag()
                        self.need(">", "'>'")
                    return
                self.element_markup()
            elif self.take("{"):
                if not self.at("}"):
                    self.take(K["..."])
                    self.expression()
                self.need("}", "'}'")
            elif self.at("}"):
                self.fail("a closing tag")
            else:
                self.p += 1

    # -- types
    def annotation(self) -> None:
        if self.typed and self.take(":"):
            self.type()

    def returned(self) -> None:
        if self.at(K["asserts"]) and self.k[self.p + 1] in NAME + K["this"] and self.nl[self.p + 1] == "0":
            self.p += 2
            if self.take(K["is"]):
                self.type()
        elif self.at(NAME + K["this"]) and self.k[self.p + 1] == K["is"]:
            self.p += 2
            self.type()
        else:
            self.type()

    def type_parameters(self) -> None:
        if self.typed and self.take("<"):
            while not self.take(">"):
                while self.at(K["const"] + K["in"] + K["out"]) and self.k[self.p + 1] in NAME + K["in"]:
                    self.p += 1
                self.need(NAME, "a type parameter")
                if self.take(K["extends"]):
                    self.type()
                if self.take("="):
                    self.type()
                if not self.take(","):
                    self.need(">", "'>'")
                    return

    def type_arguments(self) -> None:
        if self.typed and self.take("<"):
            while True:
                self.type()
                if not self.take(","):
                    break
            self.need(">", "'>'")

    def type(self) -> None:
        self.level += 1
        if self.level > self.deepest:
            raise SyntaxFault(self.n, "nesting too deep")
        self.take("|&")
        self.operand_type()
        while self.take("|&"):
            self.operand_type()
        if self.at(K["extends"]) and not self.fresh() and self.conditional_follows():
            self.p += 1
            self.type()
            self.need("?", "'?'")
            self.type()
            self.need(":", "':'")
            self.type()
        self.level -= 1

    def conditional_follows(self) -> bool:
        start, level = self.p, self.level
        try:
            self.p += 1
            self.take("|&")
            self.operand_type()
            while self.take("|&"):
                self.operand_type()
            return self.at("?")
        except SyntaxFault:
            return False
        finally:
            self.p, self.level = start, level

    def operand_type(self) -> None:
        while self.at(K["keyof"] + K["readonly"] + K["infer"] + K["unique"] + K["typeof"] + K["abstract"]) and self.k[self.p + 1] in WORD + "([{" + STRING + NUMBER + K["new"]:
            self.p += 1
        c = self.k[self.p]
        if self.p >= self.n:
            self.fail("a type")
        if c == K["new"] or c == "(" or c == "<":
            self.take(K["new"])
            end = self.closing(self.p) if self.at("(") else -1
            if c != "(" or end > 0 and self.k[end] == K["=>"]:
                start, level = self.p, self.level
                try:
                    self.type_parameters()
                    self.parameters()
                    self.need(K["=>"], "'=>'")
                    self.returned()
                    return
                except SyntaxFault:
                    if c != "(":
                        raise
                    self.p, self.level = start, level
            self.p += 1
            self.type()
            self.need(")", "')'")
        elif c == "{":
            self.object_type()
        elif c == "[":
            self.p += 1
            self.listed("]", self.tuple_element)
        elif c == K["import"]:
            self.p += 1
            self.balanced()
        elif c == "-":
            self.p += 1
            self.need(NUMBER, "a number")
        elif c in STRING + NUMBER + "t":
            self.p += 1
        else:
            inferred = self.k[self.p - 1] == K["infer"]
            self.need(NAME + K["this"] + K["void"], "a type")
            if inferred and self.at(K["extends"]) and not self.conditional_follows():
                self.p += 1
                self.operand_type()
        while True:
            if self.take("."):
                self.need(WORD, "a name")
            elif self.at("<") and not self.fresh():
                self.type_arguments()
            elif self.at("[") and not self.fresh():
                self.p += 1
                if not self.at("]"):
                    self.type()
                self.need("]", "']'")
            else:
                return

    def tuple_element(self) -> None:
        self.take(K["..."])
        if self.at(NAME) and self.k[self.p + 1] in ":?" and (self.k[self.p + 1] == ":" or self.k[self.p + 2] == ":"):
            self.p += 1
            self.take("?")
            self.take(":")
        self.type()
        self.take("?")

    def object_type(self) -> None:
        self.need("{", "'{'")
        while not self.take("}"):
            if self.p >= self.n:
                self.fail("'}'")
            if self.take(";,"):
                continue
            self.type_member()
            if not (self.take(";,") or self.at("}") or self.fresh()):
                self.fail("';' or '}'")

    def type_member(self) -> None:
        self.take("+-")
        while self.at(K["readonly"] + K["get"] + K["set"]) and self.k[self.p + 1] not in "(:?;,}<" + END:
            self.p += 1
        if self.at("(<" + K["new"]) and not (self.at(K["new"]) and self.k[self.p + 1] in ":?"):
            self.take(K["new"])
            self.type_parameters()
            self.parameters()
            if self.take(":"):
                self.returned()
            return
        if self.at("["):
            self.balanced()
        else:
            self.key()
        self.take("+-")
        self.take("?")
        if self.at("(<"):
            self.type_parameters()
            self.parameters()
            if self.take(":"):
                self.returned()
        else:
            self.annotation()

    def enum(self) -> None:
        self.need(K["enum"], "'enum'")
        self.need(NAME, "a name")
        self.need("{", "'{'")
        self.listed("}", self.enum_member)

    def enum_member(self) -> None:
        self.key()
        if self.take("="):
            self.assignment()

    def typescript(self, c: str, after: str) -> bool:
        """A declaration of TypeScript, if one begins here."""
        same = self.p < self.n and self.nl[self.p + 1] == "0"
        if c == K["enum"]:
            self.enum()
        elif c == K["interface"] and after in NAME and same:
            self.p += 2
            self.type_parameters()
            if self.take(K["extends"]):
                self.type()
                while self.take(","):
                    self.type()
            self.object_type()
        elif c == K["type"] and after in NAME and same:
            self.p += 2
            self.type_parameters()
            self.need("=", "'='")
            self.type()
            self.semi()
        elif c in K["namespace"] + K["module"] and after in NAME + STRING and same:
            self.p += 2
            while self.take("."):
                self.need(NAME, "a name")
            if self.take("{"):
                while self.p < self.n and not self.at("}"):
                    self.guarded("top", self.top, "}")
                self.need("}", "'}'")
            else:
                self.semi()
        elif c == K["global"] and after == "{":
            self.p += 1
            self.block()
        elif c == K["declare"] and after in WORD and same:
            self.p += 1
            self.top()
        elif c == K["abstract"] and after == K["class"]:
            self.class_(True)
        else:
            return False
        return True


class Markup(Ecma):
    memo, markup = {}, True


class Typed(Ecma):
    memo, typed = {}, True


class TypedMarkup(Ecma):
    memo, typed, markup = {}, True, True


FORMS = {"js": Ecma, "mjs": Ecma, "cjs": Ecma, "jsx": Markup, "ts": Typed, "tsx": TypedMarkup}


def check(text: str, ext: str) -> list[tuple[int, str]]:
    return FORMS[ext](JS.lex(text)).run()


LANGUAGES = dict.fromkeys(FORMS, JS)
