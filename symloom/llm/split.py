"""Problem 3: cutting oversized texts at natural boundaries.

Every byte position of a text has a boundary strength: 0 inside a character, then a character, a word, the end of a
clause, a line, a line of less indentation, a paragraph. A sparse table answers "the strongest position in [lo, hi],
the rightmost among equals" in constant time; one such query finds each cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.util import table

LIMIT, OVERLAP, STRETCH = 4000, 200, 1 << 17
PIECES = "symbol_id long, piece int, pieces int, start_byte int, end_byte int, overlap int, first_line int, last_line int, text string"


_INDENT = re.compile(rb"[ \t]*")
_SPACE = np.frombuffer(b" \t\r\n", np.uint8)
_CLAUSE = np.frombuffer(b";,.}])", np.uint8)


def strengths(raw: bytes, low: int = 0, high: int | None = None) -> np.ndarray:
    """The boundary strength of each position low..high (the end where it is not given); a position is a cut before that
    byte. What stands around the range is looked at where a position depends on it."""
    n = len(raw)
    high = n if high is None else high
    a = np.frombuffer(raw, np.uint8)
    s = np.ones(high - low + 1, np.int64)
    at = np.arange(max(low, 1), high + 1)
    before = a[at - 1]
    s[at - low] = np.where(np.isin(before, _CLAUSE), 3, np.where(np.isin(before, _SPACE), 2, 1))
    for p in at[before == 10].tolist():
        if p == n:
            continue
        body = _INDENT.match(raw, p).end()
        indent = min(20, sum(4 if c == 9 else 1 for c in raw[p : min(body, p + 20)]))
        k = p - 2
        while k >= 0 and raw[k] in b" \t\r":
            k -= 1
        blank_before = k < 0 or raw[k] == 10
        s[p - low] = 4 if raw[body : body + 1] in (b"}", b")", b"]") else 10 + (20 - indent) + 30 * blank_before
    inside = np.flatnonzero((a[low : min(high + 1, n)] & 0xC0) == 0x80)
    s[inside] = 0
    pairs = at[(before == 13) & (a[np.minimum(at, n - 1)] == 10) & (at < n)] if n else at
    s[pairs - low] = 0
    if high == n:
        s[-1] = 63
    return s


class RangeMax:
    """Sparse table over ranges of at most `widest` positions; ties go to the right."""

    def __init__(self, s: np.ndarray, widest: int):
        self.n = len(s)
        level = s * self.n + np.arange(self.n)
        self.levels = [level]
        width = 1
        while 2 * width <= min(widest, self.n):
            level = np.maximum(level[:-width], level[width:])
            self.levels.append(level)
            width *= 2

    def strongest(self, lo: int, hi: int) -> int:
        k = (hi - lo + 1).bit_length() - 1
        return int(max(self.levels[k][lo], self.levels[k][hi - (1 << k) + 1]) % self.n)


def cuts(raw: bytes, limit: int, overlap: int, stretch: int = STRETCH) -> list[tuple[int, int]]:
    """Consecutive pieces [start, end) of at most `limit` bytes covering raw; each starts at most `overlap` bytes before
    the end of the one before it. Texts within the limit are one piece. Strengths and table are made for `stretch` bytes
    at a time, so their memory does not grow with the text."""
    if limit < 8 or not 0 <= overlap <= limit // 4:
        raise ValueError("limit must be at least 8 and overlap at most a quarter of it")
    n, start, out = len(raw), 0, []
    if n <= limit:
        return [(0, n)]
    base = top = 0
    while n - start > limit:
        low, high = start + limit // 2, start + limit
        if high > top or not out:
            base, top = start, min(n, start + max(stretch, 2 * limit))
            s = strengths(raw, base, top)
            best = RangeMax(s, high - low + 1)
        end = base + best.strongest(low - base, high - base)
        out.append((start, end))
        back = max(start + 1, end - overlap)
        line = raw.find(b"\n", back - 1, end - 1) + 1
        start = line or back
        while s[start - base] == 0:
            start += 1
    return [*out, (start, n)]


def _pieces(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for sid, body, first in zip(b["symbol_id"], b["body"], b["start_line"]):
                raw = body.encode("utf-8", "surrogatepass")
                parts = cuts(raw, limit, overlap)
                line, seen, before = first, 0, 0
                for i, (x, y) in enumerate(parts):
                    line, seen = line + raw.count(b"\n", seen, x), x
                    last = line + raw.count(b"\n", x, max(x, y - 1))
                    rows.append((sid, i, len(parts), x, y, max(0, before - x), line, last, raw[x:y].decode("utf-8", "replace")))
                    before = y
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])
            for c in ("first_line", "last_line"):
                out[c] = out[c].astype("Int32")
            yield out

    return run


def split_oversized(symbols: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of each body above `limit` bytes, a symbol_id once.

    Null and short bodies give no row. A null start_line gives null line numbers. Lines end at a line feed. Rows of one
    symbol_id are taken to be redeliveries; of different ones the first by start_line and body counts. Other columns of
    the input are ignored."""
    big = symbols.where(F.octet_length("body") > limit).select(F.col("symbol_id").cast("long"), "body", F.col("start_line").cast("int"))
    big = big.groupBy("symbol_id").agg(F.min(F.struct("start_line", "body")).alias("r")).select("symbol_id", "r.body", "r.start_line")
    return big.select("symbol_id", "body", F.col("start_line").cast("double")).mapInPandas(_pieces(limit, overlap), PIECES)


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(table(spark, folder, "symbols"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(table(spark, folder, "symbols")).where("piece = 0").select("symbol_id")


def p3_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Of each oversized symbol the bytes its pieces cover without their overlaps, and whether all of them keep to the
    limit and the overlap, follow one another, and have the right lines."""
    pieces = p3_pieces(spark, folder)
    width = F.col("end_byte") - F.col("start_byte")
    lines = F.col("last_line") - F.col("first_line") == F.octet_length(F.regexp_replace(F.expr("left(text, length(text) - 1)"), r"[^\n]", ""))
    order = Window.partitionBy("symbol_id").orderBy("piece")
    follows = F.coalesce(F.lag("end_byte").over(order) - F.col("start_byte") == F.col("overlap"), F.col("start_byte") == 0)
    good = (width <= LIMIT) & F.col("overlap").between(0, OVERLAP) & (F.octet_length("text") == width) & F.coalesce(lines, F.lit(True))
    by = pieces.withColumn("good", good).withColumn("follows", follows).groupBy("symbol_id")
    return by.agg(F.sum(width - F.col("overlap")).alias("covered"), F.bool_and("good").alias("good"), F.bool_and("follows").alias("follows"))


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces, "p3_coverage": p3_coverage}
SQL = {
    "p3_coverage": "SELECT symbol_id, max(strlen(body))::BIGINT AS covered, true AS good, true AS follows FROM symbols WHERE strlen(body) > 4000 GROUP BY symbol_id",
    "p3_found": "SELECT DISTINCT symbol_id FROM symbols WHERE strlen(body) > 4000",
}
