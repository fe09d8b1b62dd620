"""Generalised LL parsing over short token strings: any context-free grammar, one graph-structured stack."""

from __future__ import annotations

Grammar = dict[str, list[tuple[str, ...]]]


def grammar(text: str) -> Grammar:
    """Rules `Name: a b | c`, one a line; an upper-case word with a rule is a nonterminal, every other symbol a terminal
    of one character; an empty alternative is written `-`. Earlier alternatives are preferred."""
    rules: Grammar = {}
    for line in text.strip().splitlines():
        name, _, body = line.partition(":")
        rules[name.strip()] = [tuple(x for x in alt.split() if x != "-") for alt in body.split("|")]
    return rules


class Parser:
    def __init__(self, rules: Grammar, start: str, lazy: tuple[str, ...] = ()):
        """lazy: nonterminals of which the shortest match is preferred, not the longest."""
        self.rules, self.start, self.lazy = rules, start, lazy

    def _complete(self, tokens: str) -> tuple[dict[tuple[str, int], set[int]], int]:
        """Ends of each nonterminal from each position, and the furthest position where a terminal was looked for."""
        rules, n = self.rules, len(tokens)
        ends: dict[tuple[str, int], set[int]] = {}
        edges: dict[tuple[str, int], set[tuple]] = {}  # the graph-structured stack: node -> (slot to go on with, node)
        done: set[tuple] = set()
        todo: list[tuple] = []
        furthest = 0

        def add(name: str, alt: int, dot: int, node: tuple[str, int], at: int) -> None:
            d = (name, alt, dot, node, at)
            if d not in done:
                done.add(d)
                todo.append(d)

        def open_(name: str, at: int) -> tuple[str, int]:
            node = (name, at)
            if node not in edges:
                edges[node], ends[node] = set(), set()
                for k in range(len(rules[name])):
                    add(name, k, 0, node, at)
            return node

        open_(self.start, 0)
        while todo:
            name, alt, dot, node, at = todo.pop()
            body = rules[name][alt]
            while dot < len(body) and body[dot] not in rules:
                if at >= n or tokens[at] != body[dot]:
                    furthest = max(furthest, at)
                    break
                dot, at = dot + 1, at + 1
            else:
                if dot == len(body):
                    if at not in ends[node]:
                        ends[node].add(at)
                        for slot, parent in edges[node]:
                            add(*slot, parent, at)
                    continue
                child, edge = open_(body[dot], at), ((name, alt, dot + 1), node)
                if edge not in edges[child]:
                    edges[child].add(edge)
                    for end in list(ends[child]):
                        add(*edge[0], node, end)
        return ends, furthest

    def dropped(self, tokens: str) -> int:
        """How many tokens recovery drops until the rest has a parse; all of them where nothing is left that has one."""
        n = 0
        while True:
            ends, furthest = self._complete(tokens)
            if len(tokens) in ends[self.start, 0]:
                return n
            if not tokens:
                return n
            at = min(furthest, len(tokens) - 1)  # an end that comes too soon drops the last token
            n, tokens = n + 1, tokens[:at] + tokens[at + 1 :]

    def spans(self, tokens: str, wanted: str) -> tuple[list[tuple[int, int]], list[int]]:
        """(spans of the nonterminal `wanted` in the preferred derivation, tokens that recovery dropped). Where the text
        has no parse, the token at which every alternative failed is dropped and the rest is parsed again."""
        place = list(range(len(tokens)))
        dropped: list[int] = []
        while True:
            ends, furthest = self._complete(tokens)
            if len(tokens) in ends[self.start, 0]:
                break
            if furthest >= len(tokens):
                return [], dropped
            dropped.append(place.pop(furthest))
            tokens = tokens[:furthest] + tokens[furthest + 1 :]
        out: list[tuple[int, int]] = []
        failed: set[tuple] = set()

        def derive(symbol: str, i: int, j: int, open_: frozenset) -> list | None:
            if symbol not in self.rules:
                return [] if j == i + 1 and tokens[i] == symbol else None
            key = (symbol, i, j)
            if key in open_ or key in failed or j not in ends.get((symbol, i), ()):
                return None
            for body in self.rules[symbol]:
                got = sequence(body, 0, i, j, open_ | {key})
                if got is not None:
                    return [key, *got]
            failed.add(key)
            return None

        def sequence(body: tuple[str, ...], k: int, i: int, j: int, open_: frozenset) -> list | None:
            if k == len(body):
                return [] if i == j else None
            symbol = body[k]
            options = sorted((e for e in ends.get((symbol, i), ()) if e <= j), reverse=symbol not in self.lazy) if symbol in self.rules else [i + 1]
            for e in options:
                if e > j:
                    continue
                head = derive(symbol, i, e, open_)
                if head is not None:
                    tail = sequence(body, k + 1, e, j, open_)
                    if tail is not None:
                        return head + tail
            return None

        for name, i, j in derive(self.start, 0, len(tokens), frozenset()) or []:
            if name == wanted and j > i:
                out.append((place[i], place[j - 1] + 1))
        return out, dropped
