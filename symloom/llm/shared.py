"""Problem 4: long exact spans shared between records.

Tokens are words, runs of white space and single marks; runs beyond a limit are cut where their content says so, so that
what is inside a span is cut alike wherever it stands. Each shingle of five words and the tokens between them has a hash
under each of HASHES hash functions; a span's signature under one of them is the least hash of the shingles that lie inside it. The Cartesian tree
over the hashes of a text gives its compact windows: a node is the least of all ranges between the nearest lesser hashes
on both sides, so each node stands for an interval of span starts that share their signature, and a text has about two
windows a span length instead of a signature per character.

1. Windows under the first function are joined on their signature; those that one file has alone are dropped.
2. What is left is cut by the windows of all functions: the interval join across the hashes gives cells of span starts
   that agree on all signatures. Equal spans agree on all of them, so cells whose signatures one file has alone hold none.
3. Cells are compared text to text: those whose whole text several files have are shared; of the others, whose signatures
   other cells share, each span is compared by a digest of its text.

No pairs are formed: whether a text is shared is told by the least and the greatest file that hold it, and results are
intervals of span starts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.util import spread, table, written

SPAN, SHINGLE, HASHES, CHUNK = 200, 5, 3, 1 << 20
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_FAR = 1 << 60


@lru_cache(maxsize=4)
def _table(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return _table(base, max(2 * CHUNK, 1 << int(n).bit_length()))[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _MIX
    h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


@dataclass(frozen=True)
class Scheme:
    """Limits that leave at least one shingle inside every span: margin + space + word characters may be lost before the
    first, which takes at most longest + space, and a margin behind it."""

    span: int = SPAN

    def __post_init__(self) -> None:
        assert self.span >= 25

    @property
    def space(self) -> int:
        return self.span * 2 // 25

    @property
    def word(self) -> int:
        return self.span * 2 // 25

    @property
    def longest(self) -> int:
        return self.span * 2 // 5

    @property
    def window(self) -> int:
        return max(1, self.span // 25)

    @property
    def gram(self) -> int:
        return max(1, self.span // 50)

    @property
    def margin(self) -> int:
        """So many characters from the ends of a span on, the cuts between tokens depend on the span alone."""
        return max(self.space + 1, 2 * self.window + self.gram - 3)


class Grams:
    """Hashes of the substrings of a block of texts, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, texts: list[str]):
        self.codes = np.concatenate([np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts])
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        n = len(self.codes)
        self.inverse = _powers(_INVERSE, n + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.codes.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), dtype=np.uint64)])

    def at(self, i: np.ndarray | slice, j: np.ndarray | slice) -> np.ndarray:
        """Hashes of the substrings from i to j."""
        return mixed((self.sums[j] - self.sums[i]) * self.inverse[i])


# 0 mark, 1 word, 2 space; letters beyond ASCII are words
_CLASS = np.ones(129, np.uint8)
for _c in range(128):
    _CLASS[_c] = 1 if chr(_c).isalnum() or _c == 95 else 2 if chr(_c).isspace() else 0


def _chosen(g: Grams, scheme: Scheme) -> np.ndarray:
    """Positions that begin the least gram (the last of equals) of some window of consecutive positions."""
    n, w, k = len(g.codes), scheme.window, scheme.gram
    if n < w + k:
        return np.arange(n)
    h = g.at(slice(0, n - k + 1), slice(k, n + 1))
    bits = np.uint64(int(n).bit_length())
    at = np.arange(len(h), dtype=np.uint64)
    top = np.uint64(len(h))
    low = (h >> bits << bits) | (top - at)
    have = 1
    while 2 * have <= w:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < w:
        low = np.minimum(low[: len(low) - (w - have)], low[w - have :])
    least = (top - (low & ((np.uint64(1) << bits) - np.uint64(1)))).astype(np.int64)
    return least[np.concatenate([[True], least[1:] != least[:-1]])]  # it never goes back


def shingles(g: Grams, scheme: Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the shingles of the block: from each token that is not plain white space to the end of the
    fifth word, or of the token at which they get too long."""
    n = len(g.codes)
    kind = _CLASS[np.minimum(g.codes, 128)]
    new = np.ones(n, bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 0)
    new[g.starts] = True
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    long = size > np.where(kind[start] == 2, scheme.space, scheme.word)
    plain = (kind[start] == 2) & ~long
    if long.any():
        inside = np.repeat(long, size)
        cut = _chosen(g, scheme)
        new[cut[inside[cut]]] = True
        begins = np.zeros(n, bool)
        begins[start[plain]] = True
        start = np.flatnonzero(new)
        plain = begins[start]
    end = np.append(start[1:], n)
    text = np.repeat(np.arange(len(g.ends)), np.diff(np.searchsorted(start, np.append(g.starts, n))))
    words = np.cumsum(kind[start] == 1)
    k = np.flatnonzero(~plain)
    stop = np.searchsorted(words, words[k] - (kind[start[k]] == 1) + SHINGLE)
    stop = np.minimum(stop, np.searchsorted(end, start[k] + scheme.longest))
    k, stop = k[stop < len(end)], stop[stop < len(end)]
    whole = text[k] == text[stop]
    return text[k[whole]], start[k[whole]], end[stop[whole]]


def nearest_lesser(v: np.ndarray, nodes: np.ndarray, step: int) -> np.ndarray:
    """Of each node the nearest position before it (step -1; one that is equal counts) or after it (step 1) with a lesser
    value. Pointers skip what is greater through the pointers found so far. These neighbours are the Cartesian tree: the
    greater of the two is the parent."""
    p = np.arange(len(v)) + step
    live = nodes
    while True:
        other, own = v[p[live]], v[live]
        live = live[other > own if step < 0 else other >= own]
        if not len(live):
            return p
        p[live] = p[p[live]]


class Windows:
    """The compact windows of a block of texts under any of the hash functions."""

    def __init__(self, texts: list[str], scheme: Scheme):
        self.scheme, self.g = scheme, Grams(texts)
        text, start, end = shingles(self.g, scheme)
        self.text, self.hash = text, self.g.at(start, end)
        # a guard before and behind the shingles of each text
        self.slot = np.arange(len(text)) + text + 1
        size = len(text) + len(texts) + 1
        self.start, self.end = np.full(size, -_FAR), np.full(size, _FAR)
        self.start[self.slot], self.end[self.slot] = start, end

    def under(self, function: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first, last, signature): the spans that start at first..last of the block have that least hash."""
        s, g = self.scheme, self.g
        seed = np.uint64((function + 1) * 0xA24BAED4963EE407 % (1 << 64))
        v = np.zeros(len(self.start), np.uint64)
        v[self.slot] = mixed(self.hash ^ seed) | np.uint64(1)
        before, after = nearest_lesser(v, self.slot, -1), nearest_lesser(v, self.slot, 1)
        c, m = self.slot, s.margin
        first = np.maximum(np.maximum(self.start[before[c]] - m + 1, self.end[c] - s.span + m), g.starts[self.text])
        last = np.minimum(np.minimum(self.end[after[c]] - s.span + m - 1, self.start[c] - m), g.ends[self.text] - s.span)
        keep = first <= last
        return self.text[keep], first[keep], last[keep], v[c[keep]]


def _blocks(b: pd.DataFrame, text: str) -> Iterator[pd.DataFrame]:
    """Parts of a batch of about CHUNK characters; a longer text is a part of its own."""
    size = b[text].str.len().cumsum() // CHUNK
    for _, part in b.groupby(size, sort=False):
        yield part


def _signed(scheme: Scheme):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # copies in a batch are one text with the least and the greatest of their files
            b = b.groupby("copy", sort=False).agg(body=("body", "first"), sid=("symbol_id", "min"), least=("file_id", "min"), most=("file_id", "max")).reset_index(drop=True)
            for part in _blocks(b, "body"):
                w = Windows(part["body"].tolist(), scheme)
                text, first, last, low = w.under(0)
                base = w.g.starts[text]
                least, most = part["least"].to_numpy()[text], part["most"].to_numpy()[text]
                out = pd.DataFrame({"key": low.view(np.int64), "sid": part["sid"].to_numpy()[text], "file": least, "first": (first - base).astype(np.int32), "last": (last - base).astype(np.int32)})
                yield out
                if (several := least < most).any():
                    yield out[several].assign(file=most[several])

    return run


def _pieces(part: pd.DataFrame, span: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pieces, owner, offset, first, last): the parts of the texts that hold the spans of their intervals, and these
    intervals of starts within the pieces laid end to end."""
    texts, owner, offset, firsts, lasts, at = [], [], [], [], [], 0
    for i, (body, spans) in enumerate(zip(part["body"], part["spans"])):
        low = high = -1
        todo = sorted((s["first"], s["last"]) for s in spans)
        for k, (a, b) in enumerate(todo):
            if a > high:
                low = a
            firsts.append(at + a - low)
            lasts.append(at + b - low)
            high = max(high, b + span)
            if k + 1 == len(todo) or todo[k + 1][0] > high:
                texts.append(body[low:high])
                owner.append(i)
                offset.append(low)
                at += len(texts[-1])
    return texts, np.array(owner), np.array(offset), np.array(firsts, np.int64), np.array(lasts, np.int64)


def _celled(scheme: Scheme, hashes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in _blocks(b, "body"):
                texts, owner, offset, firsts, lasts = _pieces(part, scheme.span)
                w = Windows(texts, scheme)
                under = [w.under(f) for f in range(hashes)]
                start = np.unique(np.concatenate([x[1] for x in under]))
                own = np.searchsorted(under[0][1], start, side="right") - 1
                stop = np.minimum(np.append(start[1:] - 1, _FAR), under[0][2][own])
                sign = under[0][3][own]
                for _, f, _, v in under[1:]:
                    sign = mixed(sign * _BASE + v[np.searchsorted(f, start, side="right") - 1])
                # a piece also holds spans between its intervals
                k = np.searchsorted(firsts, start, side="right") - 1
                keep = (k >= 0) & (start <= lasts[k]) & (start <= stop)
                piece, start, stop, sign = under[0][0][own[keep]], start[keep], stop[keep], sign[keep]
                t, base = owner[piece], w.g.starts[piece] - offset[piece]
                yield pd.DataFrame({"sign": sign.view(np.int64), "copy": part["copy"].to_numpy()[t], "least": part["least"].to_numpy()[t], "most": part["most"].to_numpy()[t], "first": (start - base).astype(np.int32), "last": (stop - base).astype(np.int32)})

    return run


def _regions(span: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in _blocks(b, "body"):
                rows = []
                for copy, least, most, body, cells in zip(part["copy"], part["least"], part["most"], part["body"], part["cells"]):
                    rows += [(copy, least, most, c["sign"], c["first"], body[c["first"] : c["last"] + span]) for c in cells]
                yield pd.DataFrame(rows, columns=["copy", "least", "most", "sign", "first", "region"])

    return run


def _rows(symbols: DataFrame) -> DataFrame:
    ok = F.col("symbol_id").isNotNull() & F.col("body").isNotNull()
    return symbols.where(ok).select(F.col("symbol_id").cast("long"), F.col("file_id").cast("long"), "body", F.unhex(F.md5("body")).alias("copy"), F.length("body").alias("n_chars"))


def _several(df: DataFrame, key: str) -> DataFrame:
    """The rows whose key several files have; told by the extremes, so that no group is gathered."""
    keys = df.groupBy(key).agg(F.min("least").alias("a"), F.max("most").alias("b")).where("a < b").select(key)
    return df.join(keys, key, "left_semi")


def _shared(symbols: DataFrame, span: int, hashes: int) -> tuple[DataFrame, DataFrame]:
    """(records, intervals): each record with its class of equal texts and whether the class is in several files; copy,
    first, last: intervals of starts of the spans of a class that stand in another file."""
    scheme = Scheme(span)
    rows = _rows(symbols)
    known = F.col("file_id").isNotNull()
    copies = rows.where(known).groupBy("copy").agg(F.min("file_id").alias("least"), F.max("file_id").alias("most"), F.min("symbol_id").alias("sid"))
    records = rows.select("symbol_id", "copy", "n_chars").distinct().join(copies.drop("sid"), "copy", "left")
    records = records.withColumn("whole", F.coalesce(F.col("least") < F.col("most"), F.lit(False)) & (F.col("n_chars") >= span))
    long = spread(rows.where(known & (F.col("n_chars") >= span)).select("symbol_id", "file_id", "body", "copy"))
    w = written(long.mapInPandas(_signed(scheme), "key long, sid long, file long, first int, last int"))
    w = _several(w.select("key", "sid", "first", "last", F.col("file").alias("least"), F.col("file").alias("most")), "key")
    some = w.groupBy("sid").agg(F.collect_set(F.struct("first", "last")).alias("spans")).join(copies, "sid").select(F.col("sid").alias("symbol_id"), "copy", "least", "most", "spans")
    bodies = long.select("symbol_id", "copy", "body")
    cells = written(bodies.join(some.hint("shuffle_hash"), ["symbol_id", "copy"]).select("copy", "least", "most", "body", "spans").mapInPandas(_celled(scheme, hashes), "sign long, copy binary, least long, most long, first int, last int"))
    cells = _several(cells, "sign").groupBy("copy", "least", "most").agg(F.collect_set(F.struct("sign", "first", "last")).alias("cells"))
    cells = cells.join(copies.select("copy", F.col("sid").alias("symbol_id")), "copy")
    found = bodies.join(cells.hint("shuffle_hash"), ["symbol_id", "copy"]).select("copy", "least", "most", "body", "cells")
    found = written(found.mapInPandas(_regions(span), "copy binary, least long, most long, sign long, first int, region string").withColumn("id", F.unhex(F.md5("region"))))
    kinds = written(found.groupBy("sign", "id", "region").agg(F.min("least").alias("least"), F.max("most").alias("most")))
    whole = found.select("copy", "first", "id", "sign", F.length("region").alias("n")).join(kinds.where("least < most").select("sign", "id"), ["sign", "id"], "left_semi")
    whole = whole.select("copy", "first", (F.col("first") + F.col("n") - span).alias("last"))
    # the others share spans at most with cells of the same signatures
    mixed_ = kinds.groupBy("sign").agg(F.min("least").alias("a"), F.max("most").alias("b"), F.min("id").alias("c"), F.max("id").alias("d"), F.max(F.col("least") == F.col("most")).alias("open")).where("a < b AND c < d AND open").select("sign")
    spans = kinds.join(mixed_, "sign", "left_semi").select("sign", "id", "least", "most", "region", F.explode(F.sequence(F.lit(0), F.length("region") - span)).alias("at"))
    spans = written(spans.select("sign", "id", "least", "most", "at", F.unhex(F.md5(F.substr("region", F.col("at") + 1, F.lit(span)))).alias("digest")))
    hot = _several(spans, "digest").where("least = most").select("sign", "id", "at").distinct()
    part = found.select("copy", "first", "sign", "id").join(hot, ["sign", "id"]).select("copy", (F.col("first") + F.col("at")).alias("first"), (F.col("first") + F.col("at")).alias("last"))
    return records, whole.unionByName(part)


def shared_spans(symbols: DataFrame, span: int = SPAN, hashes: int = HASHES) -> DataFrame:
    """symbol_id, n_chars, shared_chars, share of every symbol: the characters that lie in a span of at least `span`
    characters which stands verbatim in a body with another file_id.

    Null bodies are left out, a null file_id shares with none; empty and short bodies share 0. Redelivered rows count
    once. A text that several files have whole is shared whole."""
    records, intervals = _shared(symbols, span, hashes)
    order = Window.partitionBy("copy").orderBy("first", "last")
    before = F.max(F.col("last") + span).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("last") + span - F.greatest(F.col("first"), F.coalesce(before, F.lit(0)))
    covered = intervals.withColumn("fresh", F.greatest(fresh, F.lit(0))).groupBy("copy").agg(F.sum("fresh").alias("n"))
    out = records.join(covered, "copy", "left")
    shared = F.when(F.col("whole"), F.col("n_chars")).otherwise(F.coalesce("n", F.lit(0))).cast("long")
    return out.select("symbol_id", F.col("n_chars").cast("long"), shared.alias("shared_chars"), F.round(F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(0.0), 6).alias("share"))


def p4_shared(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans(table(spark, folder, "symbols"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_shared(spark, folder).where("shared_chars > 0").select("symbol_id").distinct()


QUERIES = {"p4_found": p4_found, "p4_shared": p4_shared}
SQL: dict[str, str] = {}
