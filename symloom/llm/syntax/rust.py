"""Rust."""

from __future__ import annotations

import re

from symloom.llm.syntax.base import END, IDENT, NUMBER, ODD, STRING, Descent, Language, SyntaxFault

_WORDS = "as async await box break const continue crate dyn else enum extern fn for if impl in let loop macro_rules match mod move mut pub ref return self Self static struct super trait type union unsafe use where while yield default auto".split()
_OPS = "..= ... :: -> => == != <= >= && || += -= *= /= %= ^= &= |= ..".split()
_BLOCK = r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]++|\*(?!/))*+\*/)*\*/)*\*/"
RS = Language(
    re.compile(
        r"(?:[ \t\r\f]++|//[^\n]*+|" + _BLOCK + r"|\A#!(?!\[)[^\n]*)*+"
        r"(\n|[bc]?r(#*)\".*?\"\2|[bc]?\"(?:[^\"\\]++|\\.)*+\"|b?'(?:[^'\\\n]|\\(?:u\{[^}\n]*\}|x..|.))'|'[^\W\d]\w*(?!')|r\#[^\W\d]\w*|[^\W\d]\w*"
        r"|0[xX][\da-fA-F_]+\w*|0[bB][01_]+\w*|0[oO][0-7_]+\w*|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?\d[\d_]*)?\w*"
        r"|" + "|".join(map(re.escape, sorted(_OPS, key=len, reverse=True))) + r"|.|\Z)",
        re.S,
    ),
    _WORDS,
    _OPS,
)
K = RS.kind
LIFE = "'"
RS.kinds["$"] = "$"
RS.kinds["\\"] = ODD
RS.kinds["`"] = ODD
RS.kinds["'"] = ODD
RS.kinds['"'] = ODD
_classify = RS.classify


def _kind(token: str) -> str:
    if token[0] == "'" and token[-1] != "'":
        return LIFE
    if token[-1] in "\"'#" and len(token) > 1 and token[0] in "\"'bcr" and ('"' in token or "'" in token):
        return STRING
    return _classify(token) if not token.startswith("r#") else IDENT


RS.classify = _kind  # type: ignore[method-assign]


def _lex(text: str) -> str:
    return "".join([RS.kinds[t] for t, _ in RS.pattern.findall(text)])


RS.lex = _lex  # type: ignore[method-assign]

SOFT = K["union"] + K["default"] + K["auto"] + K["box"] + K["macro_rules"] + K["yield"]
NAME = IDENT + SOFT
PATH = NAME + K["self"] + K["Self"] + K["super"] + K["crate"]
ASSIGN = "=" + "".join(K[o] for o in "+= -= *= /= %= ^= &= |=".split())
PRECEDENCE = {K["||"]: 3, K["&&"]: 4, **dict.fromkeys([K["=="], K["!="], "<", ">", K["<="], K[">="]], 5), "|": 6, "^": 7, "&": 8, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11}
BLOCKLIKE = "".join(K[w] for w in "if match while for loop unsafe".split()) + "{"
RANGES = K[".."] + K["..="]


class Rust(Descent):
    lang, memo, newlines = RS, {}, False
    goes_on = ".?=+-/%|^<>)" + K["else"] + K["where"] + K["as"] + "".join(K[o] for o in _OPS if o not in ("..", "..=", "...", "::", "&&", "||"))
    literal = True

    def attributes(self) -> None:
        while self.at("#"):
            self.p += 1
            self.take("!")
            if not self.at("["):
                self.fail("'['")
            self.balanced()

    # -- items
    def top(self) -> None:
        self.attributes()
        if self.p >= self.n:
            return
        if not self.item():
            self.fail("an item")

    def visibility(self) -> None:
        if self.take(K["pub"]) and self.at("(") and self.k[self.p + 1] in K["crate"] + K["self"] + K["super"] + K["in"]:
            self.balanced()

    def item(self) -> bool:
        """An item, if one begins here."""
        self.visibility()
        c, after = self.k[self.p], self.k[self.p + 1] if self.p < self.n else END
        if self.p >= self.n:
            return False
        if c == K["fn"] or c in K["const"] + K["async"] + K["unsafe"] + K["extern"] + K["default"] and self.is_function():
            while not self.take(K["fn"]):
                self.p += 1
            self.function()
        elif c == K["use"]:
            self.p += 1
            self.use()
            self.need(";", "';'")
        elif c == K["struct"] or c == K["union"] and after in NAME:
            self.struct()
        elif c == K["enum"]:
            self.p += 1
            self.need(NAME, "the name of an enum")
            self.generics()
            self.where()
            self.need("{", "'{'")
            self.listed("}", self.variant)
        elif c == K["trait"] or c in K["unsafe"] + K["auto"] and K["trait"] in self.k[self.p : self.p + 3]:
            while not self.take(K["trait"]):
                self.p += 1
            self.need(NAME, "the name of a trait")
            self.generics()
            if self.take(":"):
                self.bounds()
            self.where()
            self.members()
        elif c == K["impl"] or c in K["unsafe"] + K["default"] and after == K["impl"]:
            self.take(K["unsafe"] + K["default"])
            self.p += 1
            self.generics()
            self.take("!")
            self.type()
            if self.take(K["for"]):
                self.type()
            self.where()
            self.members()
        elif c == K["mod"] or c == K["unsafe"] and after == K["mod"]:
            self.take(K["unsafe"])
            self.p += 1
            self.need(NAME, "the name of a module")
            if not self.take(";"):
                self.need("{", "'{'")
                while self.p < self.n and not self.at("}"):
                    self.guarded("top", self.top, "}")
                self.need("}", "'}'")
        elif c == K["const"] and after in NAME + K["mut"] or c == K["static"]:
            self.p += 1
            self.take(K["mut"])
            self.need(NAME, "a name")
            if self.take(":"):
                self.type()
            if self.take("="):
                self.expression()
            self.need(";", "';'")
        elif c == K["type"]:
            self.p += 1
            self.need(NAME, "the name of a type")
            self.generics()
            if self.take(":"):
                self.bounds()
            self.where()
            if self.take("="):
                self.type()
                self.where()
            self.need(";", "';'")
        elif c == K["extern"] or c == K["unsafe"] and after == K["extern"]:
            self.take(K["unsafe"])
            self.p += 1
            if self.take(K["crate"]):
                self.need(PATH, "the name of a crate")
                if self.take(K["as"]):
                    self.need(NAME, "a name")
                self.need(";", "';'")
            else:
                self.take(STRING)
                self.members()
        elif c == K["macro_rules"] and after == "!":
            self.p += 2
            self.need(NAME, "the name of a macro")
            braces = self.at("{")
            self.tree()
            if not braces:
                self.need(";", "';'")
        elif c in PATH + K["::"] and self.macro_here():
            self.path(False)
            self.need("!", "'!'")
            self.take(NAME)
            braces = self.at("{")
            self.tree()
            if not braces:
                self.need(";", "';'")
        else:
            return False
        return True

    def is_function(self) -> bool:
        i = self.p
        while self.k[i] in K["const"] + K["async"] + K["unsafe"] + K["extern"] + K["default"] + STRING and i < self.n:
            i += 1
        return self.k[i] == K["fn"]

    def macro_here(self) -> bool:
        i = self.p
        while self.k[i] in PATH + K["::"] and i < self.n:
            i += 1
        return self.k[i] == "!" and self.k[i + 1] in "([{" + NAME

    def tree(self) -> None:
        if not self.at("([{"):
            self.fail("a token tree")
        self.balanced()

    def use(self) -> None:
        self.take(K["::"])
        while True:
            if self.take("{"):
                self.listed("}", self.use)
                return
            if self.take("*"):
                return
            self.need(PATH, "a path")
            if not self.take(K["::"]):
                break
        if self.take(K["as"]):
            self.need(NAME, "a name")

    def function(self) -> None:
        self.need(NAME, "the name of a function")
        self.generics()
        self.need("(", "'('")
        self.listed(")", self.parameter)
        if self.take(K["->"]):
            self.type()
        self.where()
        if not self.take(";"):
            self.block()

    def parameter(self) -> None:
        self.attributes()
        if self.take(K["..."]):
            return
        i = self.p
        while self.k[i] in "&" + LIFE + K["mut"] and i < self.n:
            i += 1
        if self.k[i] == K["self"]:
            self.p = i + 1
            if self.take(":"):
                self.type()
            return
        start = self.p
        self.pattern(False)
        if self.take(":"):
            if self.at(K["..."]):
                self.p += 1
            else:
                self.type()
        else:  # a trait's method may leave the name out
            self.p = start
            self.type()

    def struct(self) -> None:
        self.p += 1
        self.need(NAME, "the name of a struct")
        self.generics()
        self.where()
        if self.take("{"):
            self.listed("}", self.field)
        elif self.take("("):
            self.listed(")", self.unnamed)
            self.where()
            self.need(";", "';'")
        else:
            self.need(";", "';'")

    def field(self) -> None:
        self.attributes()
        self.visibility()
        self.need(NAME, "a field")
        self.need(":", "':'")
        self.type()

    def unnamed(self) -> None:
        self.attributes()
        self.visibility()
        self.type()

    def variant(self) -> None:
        self.attributes()
        self.visibility()
        self.need(NAME, "a variant")
        if self.take("{"):
            self.listed("}", self.field)
        elif self.take("("):
            self.listed(")", self.unnamed)
        if self.take("="):
            self.expression()

    def members(self) -> None:
        self.need("{", "'{'")
        while self.p < self.n and not self.at("}"):
            self.guarded("top", self.top, "}")
        self.need("}", "'}'")

    def generics(self) -> None:
        if self.take("<"):
            while not self.take(">"):
                self.attributes()
                if self.take(K["const"]):
                    self.need(NAME, "a parameter")
                    self.need(":", "':'")
                    self.type()
                else:
                    self.need(NAME + LIFE, "a parameter")
                    if self.take(":"):
                        self.bounds()
                if self.take("="):
                    if self.at(NUMBER + STRING + "-"):
                        self.take("-")
                        self.p += 1
                    elif self.at("{"):
                        self.block()
                    else:
                        self.type()
                if not self.take(","):
                    self.need(">", "'>'")
                    return

    def where(self) -> None:
        if self.take(K["where"]):
            while self.at(PATH + LIFE + "&[(<*!" + K["for"] + K["fn"] + K["dyn"] + K["impl"] + K["::"]):
                if not self.take(LIFE):
                    self.type()
                self.need(":", "':'")
                self.bounds()
                if not self.take(","):
                    return

    def bounds(self) -> None:
        while self.at(LIFE + "?~(" + PATH + K["for"] + K["::"] + K["dyn"] + K["async"] + K["const"] + K["use"]):
            if self.at(K["use"]) and self.k[self.p + 1] == "<":
                self.p += 1
                self.generic_arguments()
            elif not self.take(LIFE):
                paren = self.take("(")
                self.take("?~")
                self.take(K["const"] + K["async"])
                self.higher()
                self.path(True)
                if paren:
                    self.need(")", "')'")
            if not self.take("+"):
                return

    def higher(self) -> None:
        if self.take(K["for"]):
            self.generics()

    def type(self) -> None:
        self.level += 1
        if self.level > self.deepest:
            raise SyntaxFault(self.n, "nesting too deep")
        if self.take("&") or self.take(K["&&"]):
            self.take(LIFE)
            self.take(K["mut"])
            self.type()
        elif self.take("*"):
            self.need(K["const"] + K["mut"], "'const' or 'mut'")
            self.type()
        elif self.take("("):
            self.listed(")", self.type)
        elif self.take("["):
            self.type()
            if self.take(";"):
                self.expression()
            self.need("]", "']'")
        elif self.take("!"):
            pass
        elif self.take(K["dyn"] + K["impl"]):
            self.bounds()
        else:
            self.higher()
            if self.at("&*([") or self.at(K["&&"]):
                self.type()
            elif self.at(K["fn"] + K["unsafe"] + K["extern"]):
                self.take(K["unsafe"])
                if self.take(K["extern"]):
                    self.take(STRING)
                self.need(K["fn"], "'fn'")
                self.need("(", "'('")
                self.listed(")", self.function_type_parameter)
                if self.take(K["->"]):
                    self.type()
            else:
                self.path(True)
                if self.take("!"):
                    self.tree()
        self.level -= 1

    def function_type_parameter(self) -> None:
        if self.take(K["..."]):
            return
        if self.at(NAME) and self.k[self.p + 1] == ":":
            self.p += 2
        self.type()

    def path(self, types: bool) -> None:
        """A path; in types generic arguments need no `::`."""
        if self.take("<"):
            self.type()
            if self.take(K["as"]):
                self.path(True)
            self.need(">", "'>'")
            self.need(K["::"], "'::'")
        else:
            self.take(K["::"])
        while True:
            self.take("$")
            self.need(PATH, "a path")
            if types:
                self.take(K["::"]) if self.k[self.p + 1 : self.p + 2] == "<" else None
                if self.at("<"):
                    self.generic_arguments()
                elif self.at("("):
                    self.p += 1
                    self.listed(")", self.type)
                    if self.take(K["->"]):
                        self.type()
                if not self.take(K["::"]):
                    return
            else:
                if not self.take(K["::"]):
                    return
                if self.at("<"):
                    self.generic_arguments()
                    if not self.take(K["::"]):
                        return

    def generic_arguments(self) -> None:
        self.need("<", "'<'")
        while not self.take(">"):
            if self.take(LIFE):
                pass
            elif self.at(NUMBER + STRING + "-"):
                self.take("-")
                self.need(NUMBER + STRING, "a value")
            elif self.at("{"):
                self.block()
            else:
                self.type()
                if self.take("="):
                    if self.at(NUMBER + STRING + "-{"):
                        self.unary()
                    else:
                        self.type()
                elif self.take(":"):
                    self.bounds()
            if not self.take(","):
                self.need(">", "'>'")
                return

    # -- statements
    def block(self) -> None:
        self.need("{", "'{'")
        held, self.literal = self.literal, True
        while self.p < self.n and not self.at("}"):
            if not self.take(";"):
                self.guarded("s", self.statement, ";}")
        self.literal = held
        self.need("}", "'}'")

    def statement(self) -> None:
        self.attributes()
        if self.at("}"):
            return
        if self.take(K["let"]):
            self.pattern(True)
            if self.take(":"):
                self.type()
            if self.take("="):
                self.expression()
                if self.take(K["else"]):
                    self.block()
            self.need(";", "';'")
            return
        c = self.k[self.p]
        if c == K["pub"] or self.starts_item(c):
            if self.item():
                return
        if c in BLOCKLIKE or c == LIFE or c in K["const"] + K["async"] and self.k[self.p + 1] in "{":
            self.take(K["const"])
            self.blocklike()
            if self.at(".?"):
                self.tail()
                self.rest()
            elif self.at(K["as"]):
                self.binary(3, True)
            else:
                return
        else:
            braces = c in PATH and self.macro_here()
            self.expression()
            if braces and self.k[self.p - 1] == "}":
                self.take(";")
                return
        if not self.at("}"):
            self.need(";", "';'")

    def starts_item(self, c: str) -> bool:
        after = self.k[self.p + 1]
        if c in K["fn"] + K["use"] + K["struct"] + K["enum"] + K["trait"] + K["impl"] + K["mod"] + K["static"] + K["type"] + K["extern"]:
            return not (c == K["static"] and after in "|" + K["||"] + K["move"])
        if c == K["const"]:
            return after not in "{|" + K["||"]
        if c == K["macro_rules"]:
            return after == "!"
        if c == K["union"]:
            return after in NAME
        return c in K["async"] + K["unsafe"] and self.is_function() or c == K["unsafe"] and after in K["impl"] + K["trait"]

    def rest(self) -> None:
        """What may follow an operand: operators, ranges, assignments."""
        self.binary(3, True)
        if self.take(ASSIGN):
            self.expression()

    def blocklike(self) -> None:
        if self.take(LIFE):
            self.need(":", "':'")
        c = self.k[self.p]
        if c == "{":
            self.block()
        elif self.take(K["unsafe"]) or self.take(K["loop"]):
            self.block()
        elif self.take(K["async"]):
            self.take(K["move"])
            self.block()
        elif self.take(K["if"]):
            self.condition()
            self.block()
            if self.take(K["else"]):
                if self.at(K["if"]):
                    self.blocklike()
                else:
                    self.block()
        elif self.take(K["while"]):
            self.condition()
            self.block()
        elif self.take(K["for"]):
            self.pattern(True)
            self.need(K["in"], "'in'")
            self.plain()
            self.block()
        elif self.take(K["match"]):
            self.plain()
            self.need("{", "'{'")
            held, self.literal = self.literal, True
            while not self.take("}"):
                if self.p >= self.n:
                    self.fail("'}'")
                self.arm()
            self.literal = held
        else:
            self.fail("a block")

    def condition(self) -> None:
        self.plain()

    def plain(self) -> None:
        """An expression in which a brace begins a block."""
        held, self.literal = self.literal, False
        self.expression()
        self.literal = held

    def arm(self) -> None:
        self.attributes()
        self.pattern(True)
        if self.take(K["if"]):
            self.expression()
        self.need(K["=>"], "'=>'")
        if self.at("{"):
            self.block()
            if self.take(",") or self.at("}"):
                return
            if self.at(".?" + ASSIGN) or PRECEDENCE.get(self.k[self.p], 0) >= 9 and not self.at("-*&"):
                self.tail()
                self.rest()
            else:
                return
        else:
            self.expression()
        if not self.take(","):
            if not self.at("}") and self.k[self.p - 1] != "}":
                self.fail("',' or '}'")

    # -- patterns
    def pattern(self, alternatives: bool) -> None:
        if alternatives:
            self.take("|")
        self.one_pattern()
        while alternatives and self.take("|"):
            self.one_pattern()

    def inner(self) -> None:
        self.attributes()
        self.pattern(True)

    def one_pattern(self) -> None:
        if self.take("&") or self.take(K["&&"]):
            self.take(K["mut"])
            self.one_pattern()
        elif self.take("("):
            self.listed(")", self.inner)
        elif self.take("["):
            self.listed("]", self.inner)
        elif self.take(RANGES):
            if self.at(NUMBER + STRING + "-" + PATH):
                self.limit()
        elif self.at(NUMBER + STRING + "-"):
            self.limit()
            self.range_end()
        elif self.at(K["ref"] + K["mut"]):
            self.take(K["ref"])
            self.take(K["mut"])
            self.need(PATH, "a name")
            if self.take("@"):
                self.one_pattern()
        elif self.at(K["const"]) and self.k[self.p + 1] == "{":
            self.p += 1
            self.block()
        else:
            self.path(False)
            if self.take("@"):
                self.one_pattern()
            elif self.take("("):
                self.listed(")", self.inner)
            elif self.at("{") and self.k[self.p - 1] in PATH:
                self.p += 1
                self.listed("}", self.field_pattern)
            elif self.at("!") and self.k[self.p + 1] in "([{":
                self.p += 1
                self.tree()
            else:
                self.range_end()

    def limit(self) -> None:
        self.take("-")
        if not self.take(NUMBER + STRING):
            self.path(False)

    def range_end(self) -> None:
        if self.take(RANGES + K["..."]) and self.at(NUMBER + STRING + "-" + PATH):
            self.limit()

    def field_pattern(self) -> None:
        self.attributes()
        if self.take(K[".."]):
            return
        self.take(K["ref"])
        self.take(K["mut"])
        self.need(NAME + NUMBER, "a field")
        if self.take(":"):
            self.pattern(True)

    # -- expressions
    def expression(self) -> None:
        self.level += 1
        if self.level > self.deepest:
            raise SyntaxFault(self.n, "nesting too deep")
        if self.take(RANGES):
            if self.operand_here():
                self.binary(3)
        else:
            self.binary(3)
            if self.take(RANGES) and self.operand_here():
                self.binary(3)
        if self.take(ASSIGN):
            self.expression()
        self.level -= 1

    def operand_here(self) -> bool:
        c = self.k[self.p]
        return self.p < self.n and (c in PATH + NUMBER + STRING + "-!*&(|[<" + K["||"] + K["&&"] + K["if"] + K["match"] + K["unsafe"] + K["::"] + K["move"] + K["return"] or c == "{" and self.literal)

    def binary(self, least: int, have: bool = False) -> None:
        if not have:
            self.unary()
        while True:
            c = self.k[self.p]
            if self.p >= self.n:
                return
            if c == K["as"]:
                self.p += 1
                self.type()
                continue
            if c == ">" and self.k[self.p + 1] in ">" + K[">="] and self.nl[self.p + 1] == "0":
                shift = self.k[self.p + 1] == ">"
                self.p += 2
                if shift:
                    self.binary(10)
                else:
                    self.expression()
                continue
            if c == "<" and self.k[self.p + 1] in "<" + K["<="] and self.nl[self.p + 1] == "0":
                if self.k[self.p + 2] == "<":
                    self.fail("an operand")
                shift = self.k[self.p + 1] == "<"
                self.p += 2
                if shift:
                    self.binary(10)
                else:
                    self.expression()
                continue
            rank = PRECEDENCE.get(c, 0)
            if rank < least:
                return
            self.p += 1
            self.binary(rank + 1)

    def unary(self) -> None:
        while True:
            if self.take("-!*"):
                continue
            if self.take("&") or self.take(K["&&"]):
                if self.at(NAME) and self.k[self.p + 1] in K["const"] + K["mut"]:
                    self.p += 1
                self.take(K["mut"])
                continue
            break
        if self.take(K["let"]):
            self.pattern(True)
            self.need("=", "'='")
            self.binary(5)
            return
        self.primary()
        self.tail()

    def tail(self) -> None:
        while True:
            if self.take("?"):
                pass
            elif self.take("."):
                if self.take(K["await"]):
                    continue
                self.need(PATH + NUMBER, "a name")
                if self.at(K["::"]):
                    self.p += 1
                    self.generic_arguments()
            elif self.at("("):
                self.p += 1
                held, self.literal = self.literal, True
                self.listed(")", self.argument)
                self.literal = held
            elif self.at("["):
                self.p += 1
                held, self.literal = self.literal, True
                self.expression()
                self.literal = held
                self.need("]", "']'")
            else:
                return

    def argument(self) -> None:
        self.attributes()
        self.expression()

    def primary(self) -> None:
        c = self.k[self.p]
        if self.p >= self.n:
            self.fail("an expression")
        if c in NUMBER + STRING:
            self.p += 1
        elif c == "(":
            self.p += 1
            held, self.literal = self.literal, True
            self.listed(")", self.argument)
            self.literal = held
        elif c == "[":
            self.p += 1
            held, self.literal = self.literal, True
            if not self.at("]"):
                self.argument()
                if self.take(";"):
                    self.expression()
                    self.need("]", "']'")
                    self.literal = held
                    return
                if not self.take(","):
                    self.need("]", "',' or ']'")
                    self.literal = held
                    return
            self.listed("]", self.argument)
            self.literal = held
        elif c in "|" + K["||"] + K["move"] + K["static"] or c == K["async"] and self.k[self.p + 1] in "|" + K["||"] + K["move"] and "{" != self.k[self.p + 2 : self.p + 3]:
            self.closure()
        elif c in BLOCKLIKE + LIFE + K["async"] or c == K["const"] and self.k[self.p + 1] == "{":
            self.take(K["const"])
            self.blocklike()
        elif c in K["return"] + K["break"]:
            self.p += 1
            self.take(LIFE)
            if self.operand_here() or self.at(K["loop"] + K["while"] + K["for"] + K["break"] + K["async"] + RANGES):
                self.expression()
        elif c == K["continue"]:
            self.p += 1
            self.take(LIFE)
        elif c in PATH + "<$" + K["::"]:
            self.path(False)
            if self.at("!") and self.k[self.p + 1] in "([{":
                self.p += 1
                self.tree()
            elif self.at("{") and self.literal and self.k[self.p - 1] in PATH + ">":
                self.p += 1
                self.listed("}", self.field_value)
        else:
            self.fail("an expression")

    def closure(self) -> None:
        while self.take(K["static"] + K["async"] + K["move"]):
            pass
        if not self.take(K["||"]):
            self.need("|", "'|'")
            self.listed("|", self.closure_parameter)
        if self.take(K["->"]):
            self.type()
            self.block()
        else:
            self.expression()

    def closure_parameter(self) -> None:
        self.attributes()
        self.pattern(False)
        if self.take(":"):
            self.type()

    def field_value(self) -> None:
        self.attributes()
        if self.take(K[".."]):
            if not self.at("}"):
                self.expression()
            return
        self.need(NAME + NUMBER, "a field")
        if self.take(":"):
            self.expression()


def check(text: str) -> list[tuple[int, str]]:
    return Rust(RS.lex(text)).run()
