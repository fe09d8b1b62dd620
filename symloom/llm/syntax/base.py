"""Tokens as one character each, the shared descent, and recovery.

A source is a string of token kinds. Recognisers compare kinds only, so equal shapes parse alike: a statement that has
been accepted once is looked up by its kinds the next time, whatever its names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

IDENT, NUMBER, STRING, ODD, END = "i", "n", "s", "\x7f", "\x00"
_POOL = [chr(c) for c in (*range(161, 256), *range(1, 9), *range(14, 32), *range(128, 160))]
MEMO_SIZE, MEMO_LENGTH, DEEPEST = 30_000, 800, 1500


class SyntaxFault(Exception):
    def __init__(self, at: int, message: str):
        self.at, self.message = at, message


@dataclass
class Language:
    """How a language is lexed: `pattern` has one group, the token; trivia stand before it, a newline is a token."""

    pattern: re.Pattern
    words: list[str]
    operators: list[str]

    def __post_init__(self) -> None:
        names = [*self.words, *[o for o in self.operators if len(o) > 1]]
        self.kind = dict(zip(names, _POOL, strict=False))
        assert len(names) <= len(_POOL)
        singles = {c: c for c in "()[]{}<>.,;:?!~=+-*/%&|^@#\n$\\"}
        self.name = {v: k for k, v in self.kind.items()}
        outer = self

        class Kinds(dict):
            def __missing__(self, token: str) -> str:
                return outer.classify(token)

        self.kinds = Kinds({**singles, **self.kind, "$": IDENT, "": ""})

    def classify(self, token: str) -> str:
        c = token[0]
        if c.isalpha() or c == "_" or c == "$":
            return STRING if token[-1] in "\"'#" and len(token) > 1 else IDENT
        if c.isdigit() or c == "." and token[1:2].isdigit():
            return NUMBER
        if c in "\"'" and len(token) > 1:
            return STRING
        if c == "`" and len(token) > 1:
            return "t"
        return ODD

    def lex(self, text: str) -> str:
        return "".join(map(self.kinds.__getitem__, self.pattern.findall(text)))

    def line_of(self, text: str, token: int) -> int:
        """The line of the token of that number, counted from 1."""
        at = len(text)
        for i, m in enumerate(self.pattern.finditer(text)):
            if i == token:
                at = m.start(1)
                break
        return text.count("\n", 0, at) + 1


class Descent:
    """One file. Subclasses give `top` (a declaration or statement of the file) and their grammar."""

    lang: Language
    memo: dict
    goes_on = ""  # kinds that continue a statement when they open a line
    deepest = DEEPEST

    def __init__(self, kinds: str):
        self.faults: list[tuple[int, str]] = []
        self.source = kinds
        a = np.frombuffer(kinds.encode("latin-1"), np.uint8)
        real = a != 10
        self.place = np.flatnonzero(real)  # token number of each kept token
        self.k = kinds.replace("\n", "") + END
        n = len(self.k) - 1
        before = np.zeros(n + 1, bool)
        if n:
            gap = np.diff(np.concatenate([[-1], self.place])) > 1
            before[:n] = gap
            before[0] = True
        before[n] = True
        self.nl = (before.astype(np.uint8) + 48).tobytes().decode("latin-1")
        step = np.zeros(256, np.int32)
        step[[40, 91, 123]] = 1
        step[[41, 93, 125]] = -1
        depth = np.concatenate([[0], np.cumsum(step[a[real]])])
        self.depth = depth
        starts = np.flatnonzero(before)
        # of each line the next line that is not deeper
        self.after: dict[int, int] = {}
        stack: list[int] = []
        for s, d in zip(starts.tolist(), depth[starts].tolist()):
            while stack and depth[stack[-1]] >= d:
                self.after[stack.pop()] = s
            stack.append(s)
        for s in stack:
            self.after.setdefault(s, n)
        self.n, self.p, self.level = n, 0, 0

    # -- tokens
    def at(self, kinds: str) -> bool:
        return self.k[self.p] in kinds and self.k[self.p] != END

    def take(self, kinds: str) -> bool:
        if self.k[self.p] in kinds and self.p < self.n:
            self.p += 1
            return True
        return False

    def need(self, kinds: str, what: str) -> None:
        if not self.take(kinds):
            self.fail(what)

    def fail(self, what: str) -> None:
        got = "end of file" if self.p >= self.n else repr(self.lang.name.get(self.k[self.p], self.k[self.p]))
        raise SyntaxFault(self.p, f"expected {what}, found {got}")

    def fresh(self) -> bool:
        return self.nl[self.p] == "1"

    def balanced(self) -> None:
        """A bracketed token tree, taken whole."""
        closers = {"(": ")", "[": "]", "{": "}"}
        stack = [closers[self.k[self.p]]]
        self.p += 1
        while stack:
            c = self.k[self.p]
            if self.p >= self.n or c == ODD:
                self.fail(f"'{stack[-1]}'")
            if c in closers:
                stack.append(closers[c])
            elif c in ")]}":
                if c != stack.pop():
                    self.fail("a matching bracket")
            self.p += 1

    def listed(self, close: str, item, between: str = ",") -> None:
        """item (between item)* up to close; a last separator is allowed."""
        while not self.take(close):
            if self.p >= self.n:
                self.fail(f"'{close}'")
            item()
            if not self.take(between):
                self.need(close, f"'{between}' or '{close}'")
                return

    # -- statements with lookup and recovery
    def memoised(self, rule: str, parse) -> None:
        """parse(), or nothing where the same kinds have been accepted by the same rule."""
        p = self.p
        end = self.after.get(p) if self.nl[p] == "1" else None
        while end is not None and end < self.n and self.k[end] in self.goes_on:
            end = self.after.get(end)
        if end is None or end - p > MEMO_LENGTH:
            parse()
            return
        key = (rule, self.k[p : end + 1], self.nl[p:end] if self.newlines else None)
        if key in self.memo:
            self.p = end
            return
        faults = len(self.faults)
        parse()
        if self.p == end and len(self.faults) == faults:
            if len(self.memo) >= MEMO_SIZE:
                self.memo.clear()
            self.memo[key] = True

    newlines = True

    def guarded(self, rule: str, parse, close: str) -> None:
        """One statement; a fault is stored and the rest of the statement skipped."""
        p = self.p
        self.level += 1
        try:
            if self.level > self.deepest:
                self.faults.append((p, "nested too deeply"))
                self.skip(p, close)
                return
            self.memoised(rule, parse)
            if self.p == p:
                self.fail("a statement")
        except SyntaxFault as e:
            self.faults.append((e.at, e.message))
            self.skip(max(p, e.at), close)
            if self.p == p:
                self.p += 1
        finally:
            self.level -= 1

    def skip(self, at: int, close: str) -> None:
        """On to the next line that is no deeper than the statement began, or to what closes the block."""
        floor = self.depth[self.p if self.p <= at else at]
        self.p = min(max(at, self.p), self.n)
        while self.p < self.n:
            d = self.depth[self.p]
            if d <= floor and self.k[self.p] in close:
                return
            self.p += 1
            if self.p < self.n and self.nl[self.p] == "1" and self.depth[self.p] <= floor:
                return

    def run(self) -> list[tuple[int, str]]:
        """(token number, message) of all faults, in order."""
        try:
            self.opening()
        except SyntaxFault as e:
            self.faults.append((e.at, e.message))
        while self.p < self.n:
            self.guarded("top", self.top, "")
        if not self.faults and self.depth[self.n] != 0:
            self.faults.append((self.n, "expected a closing bracket, found end of file"))
        last = len(self.source)
        return sorted({(int(self.place[p]) if p < len(self.place) else last, m) for p, m in self.faults})

    def opening(self) -> None:
        """What must stand first in a file."""

    def top(self) -> None:
        raise NotImplementedError
