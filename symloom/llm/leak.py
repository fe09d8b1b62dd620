"""Problem 7: evaluation texts inside training documents.

The evaluation items are the stated query set. What opens many texts of a suite is found by counting their first words and
left out; the items are then taken in blocks of a bounded number, whatever their suites. The documents are read once: each
task indexes its shard with an FM-index over those words that items have, told by a bitmap of fixed size, and searches
every block in it: each seed of a few consecutive item words backwards through the wavelet matrix, the hits located through
sampled suffix positions and joined on their diagonals to passages. What follows is exact: a passage of enough consecutive
words, or a whole text of which few words differ, on every diagonal that has enough seeds.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from symloom.llm.fmindex import FMIndex
from symloom.util import spread, table, written

PASSAGE, SEED, ALIKE, SHIFTED, OPENING, BLOCK, SHARD, BITMAP = 12, 4, 0.78, 0.25, 64, 4000, 400_000, 1 << 22
SPANS = "doc_id long, item_id long, part string, words int, start int, end int"

_WORD = re.compile(r"[^\W_]+(?:\\?_+[^\W_]+)*")
_BLANK = re.compile(r"\\(?:[nrt\"'/\\]|u[0-9a-fA-F]{4})|&(?:#\w{1,7}|\w{2,8});|</?\w[^<>\n]{0,200}>|\]\([^()\s]*\)")


def _even(text: str) -> str:
    """Lower case, with escapes, entities, tags and link targets blanked; every character keeps its place."""
    if "\\" in text or "&" in text or "<" in text or "](" in text:
        text = _BLANK.sub(lambda m: " " * len(m.group()), text)
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def words(text: str | None) -> list[str]:
    """The words of a text without regard to case, punctuation, line breaks, markup and escapes."""
    found = _WORD.findall(_even(text)) if text else []
    return [w.replace("\\", "") for w in found] if text and "\\_" in text else found


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for item, suite, text, answer in zip(b["item_id"], b["suite"], b["text"], b["answer"]):
            rows += [(item, suite, "text", words(text)), (item, suite, "answer", words(answer))]
        yield pd.DataFrame(rows, columns=["item_id", "suite", "part", "words"])


def standing(texts: DataFrame, share: float = 0.2, longest: int = OPENING) -> DataFrame:
    """suite, opening: the words that open at least `share` (and three) of the texts of a suite, as far as they agree; of
    openings that part the most frequent is followed. texts: suite, words.

    Counted are beginnings of up to `longest` words; at each length at most 1 / share of a suite's beginnings are frequent
    enough, and only these few meet to be followed."""
    first = texts.select("suite", F.explode(F.sequence(F.lit(1), F.least(F.size("words"), F.lit(longest)))).alias("k"), "words").where("k <= size(words)")
    first = first.select("suite", "k", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("begin"))
    total = texts.groupBy("suite").agg(F.count(F.lit(1)).alias("total"))
    often = first.groupBy("suite", "k", "begin").agg(F.count(F.lit(1)).alias("n")).join(total, "suite").where((F.col("n") >= 3) & (F.col("n") >= share * F.col("total")))

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        now = ""
        for _, same in rows.sort_values(["k", "n", "begin"], ascending=[True, False, True]).groupby("k", sort=True):
            more = [x for x in same["begin"] if not now or x.startswith(now + " ")]
            if not more:
                break
            now = more[0]
        return pd.DataFrame({"suite": rows["suite"][:1], "opening": [now.split(" ")]})

    found = often.select("suite", "k", "begin", "n").groupBy("suite").applyInPandas(follow, "suite string, opening array<string>")
    return found.where("size(opening) >= 3")


def item_texts(items: DataFrame) -> DataFrame:
    """item_id, part (text, answer), words of the items, the standing opening of their suite left out of texts that have
    it; those of fewer than SEED words are none."""
    rows = items.select(F.col("item_id").cast("long"), F.coalesce(F.col("suite").cast("string"), F.lit("")).alias("suite"), "text", "answer")
    rows = written(rows.mapInPandas(_tokens, "item_id long, suite string, part string, words array<string>"))
    rows = rows.join(standing(rows.where("part = 'text'").select("suite", "words")), "suite", "left")
    n = F.size("opening")
    cut = F.when((F.col("part") == "text") & (F.slice("words", 1, F.greatest(n, F.lit(1))) == F.col("opening")), F.slice("words", n + 1, F.size("words"))).otherwise(F.col("words"))
    return written(rows.select("item_id", "part", cut.alias("words")).where(F.size("words") >= SEED))


class Block:
    """The texts of a block of items and their seeds, in numbers of the block's own words."""

    def __init__(self, rows: list[tuple[int, str, list[str]]]):
        self.names = [(item, part) for item, part, _ in rows]
        self.words = sorted({w for _, _, x in rows for w in x})
        number = {w: i + 1 for i, w in enumerate(self.words)}
        ids = [np.array([number[w] for w in x], np.int64) for _, _, x in rows]
        self.size = np.array([len(x) for x in ids], np.int64)
        self.flat = np.concatenate([*ids, np.zeros(0, np.int64)])
        seeds = defaultdict(list)
        for t, x in enumerate(ids):
            for o in range(len(x) - SEED + 1):
                seeds[tuple(x[o : o + SEED].tolist())].append((t, o))
        self.phrases = np.array(list(seeds), np.int64).reshape(-1, SEED)
        self.many = np.array([len(v) for v in seeds.values()], np.int64)
        self.owners = np.array([x for v in seeds.values() for x in v], np.int64).reshape(-1, 2)

    def numbered(self, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases that can occur, their places, all texts) in the numbers of a shard; -1 is no word of it."""
        table = np.array([0, *(known.get(w, -1) for w in self.words)], np.int64)
        phrases = table[self.phrases]
        some = np.flatnonzero((phrases > 0).all(axis=1))
        return phrases[some], some, table[self.flat]


def _passages(block: Block, flat: np.ndarray, full: np.ndarray, begin: np.ndarray, doc: np.ndarray, at: np.ndarray, phrase: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, text, first, last + 1) of the passages of a shard; hits: document, word of the document, phrase."""
    start = np.cumsum(block.many) - block.many
    n = block.many[phrase]
    pick = np.repeat(start[phrase] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    d, p, t, o = np.repeat(doc, n), np.repeat(at, n), block.owners[pick, 0], block.owners[pick, 1]
    size = block.size
    diagonal = p - o
    order = np.lexsort((p, diagonal, t, d))
    d, p, t, diagonal = d[order], p[order], t[order], diagonal[order]
    pair = np.concatenate([[True], (np.diff(d) != 0) | (np.diff(t) != 0)])
    other = pair | np.concatenate([[True], np.diff(diagonal) != 0])
    first = np.flatnonzero(other | np.concatenate([[True], np.diff(p) != 1]))
    last = np.concatenate([first[1:], [len(p)]]) - 1
    long = p[last] - p[first] + SEED >= np.minimum(PASSAGE, size[t[first]])
    out = [(int(d[i]), int(t[i]), int(p[i]), int(p[j]) + SEED) for i, j in zip(first[long], last[long])]
    # a text with words replaced keeps its diagonal, one with words put in or left out stays near it
    k = np.flatnonzero(other)
    seeds = np.diff(np.concatenate([k, [len(p)]]))
    dd, tt, gg = d[k], t[k], diagonal[k]
    width = size[tt]
    offset = np.cumsum(size) - size
    j = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    place = np.repeat(gg, width) + j
    inside = (place >= 0) & (place < np.repeat(np.diff(begin)[dd], width))
    place = np.where(inside, place + np.repeat(begin[dd], width), 0)
    equal = inside & (full[place] == flat[np.repeat(offset[tt], width) + j])
    same = np.add.reduceat(equal.astype(np.int64), np.cumsum(width) - width)
    near = np.flatnonzero(pair[k] | np.concatenate([[True], np.diff(gg) > width[1:] // 4]))
    total = np.add.reduceat(seeds, near)
    ends = np.append(near[1:], len(k))
    whole = np.maximum.reduceat(same, near) >= ALIKE * width[near]
    for c in np.flatnonzero(whole | (total >= SHIFTED * (width[near] - SEED + 1))).tolist():
        a, b = int(near[c]), int(ends[c])
        x, y, n_words = int(dd[a]), int(tt[a]), int(width[a])
        held = int(begin[x + 1] - begin[x])
        if whole[c]:
            out += [(x, y, max(0, int(g)), min(held, int(g) + n_words)) for g in gg[a:b][same[a:b] >= ALIKE * n_words]]
            continue
        g = int(gg[a + int(np.argmax(same[a:b]))])
        low, high = max(0, g - n_words // 4), min(held, g + n_words + n_words // 4)
        parts = SequenceMatcher(None, full[begin[x] + low : begin[x] + high].tolist(), flat[offset[y] : offset[y] + n_words].tolist(), autojunk=False).get_matching_blocks()
        if sum(z.size for z in parts) >= ALIKE * n_words:
            out.append((x, y, low + parts[0].a, low + max(z.a + z.size for z in parts[:-1])))
    return out


def _search(blocks: Iterator[Block], docs: list[tuple[int, str]], tokens: list[list[str]], bits: np.ndarray) -> list[tuple]:
    """Spans of one shard: one index, all blocks."""
    known: dict[str, int] = {}
    mask = len(bits) * 8 - 1
    ids = [np.fromiter((_number(w, known, bits, mask) for w in x), np.int64, len(x)) for x in tokens]
    full = np.concatenate(ids)
    keep = full > 0
    # a word that no item has, and each end of a document, is one separator; runs shorter than a seed can't hold one
    owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    starts = keep & np.concatenate([[True], ~keep[:-1] | (owner[1:] != owner[:-1])])
    number = np.cumsum(starts) - 1
    length = np.bincount(number[keep], minlength=1) if keep.any() else np.zeros(1, np.int64)
    keep &= length[np.maximum(number, 0)] >= SEED
    place = np.flatnonzero(keep)
    if not len(place):
        return []
    gap = np.concatenate([[False], (np.diff(place) != 1) | (owner[place[1:]] != owner[place[:-1]])])
    slot = np.arange(len(place)) + np.cumsum(gap)
    largest = len(known) + 1
    s = np.full(int(slot[-1]) + 1, largest, np.int64)
    s[slot] = full[place]
    back = np.full(len(s), -1, np.int64)
    back[slot] = place
    index = FMIndex(s, largest)
    begin = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    out, edges = [], {}
    for block in blocks:
        phrases, names, flat = block.numbered(known)
        if not len(phrases):
            continue
        lo, hi = index.ranges(phrases)
        some = np.flatnonzero(hi > lo)
        if not len(some):
            continue
        counts = (hi - lo)[some]
        rows = np.repeat(lo[some] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        at, phrase = back[index.locate(rows)], np.repeat(names[some], counts)
        for d, x, first, end in _passages(block, flat, full, begin, owner[at], at - begin[owner[at]], phrase):
            if d not in edges:
                edges[d] = [m.span() for m in _WORD.finditer(_even(docs[d][1]))]
            out.append((docs[d][0], *block.names[x], end - first, edges[d][first][0], edges[d][end - 1][1]))
    return out


def _number(word: str, known: dict[str, int], bits: np.ndarray, mask: int) -> int:
    n = known.get(word)
    if n is None:
        h = xxh3_64_intdigest(word) & mask
        n = known[word] = (len(known) + 1) if bits[h >> 3] >> (h & 7) & 1 else 0
    return n


def _each(blocks: list[Broadcast]) -> Iterator[Block]:
    """The blocks one after the other; only one is in memory."""
    for b in blocks:
        yield b.value
        if len(blocks) > 1:
            del b._value  # read again from the executor's disk when it is its turn


def _leaks(blocks: list[Broadcast], bitmap: Broadcast):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs, tokens, size = [], [], 0

        def close() -> pd.DataFrame:
            return pd.DataFrame(_search(_each(blocks), docs, tokens, bitmap.value) if size else [], columns=[c.split()[0] for c in SPANS.split(", ")])

        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"]):
                docs.append((doc, text))
                tokens.append(words(text))
                size += len(tokens[-1])
                if size >= SHARD:
                    yield close()
                    docs, tokens, size = [], [], 0
        if docs:
            yield close()

    return run


def leaked_spans(documents: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, part (text or answer), words, start, end: the passages of items in the documents.

    start and end count characters of the document's text. Null and empty texts and answers match nothing; texts of fewer
    than four words are no items. `block` items are in memory at a time, on the driver and in a task; the documents are
    read once. A row per doc_id and place, repeated rows repeat."""
    spark = documents.sparkSession
    texts = item_texts(items)
    count = max(1, -(-texts.select("item_id").distinct().count() // block))
    texts = texts.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(count)))
    blocks, bits = [], np.zeros(BITMAP // 8, np.uint8)
    for i in range(count):
        b = Block([tuple(r) for r in texts.where(F.col("block") == i).select("item_id", "part", "words").toLocalIterator()])
        for w in b.words:
            h = xxh3_64_intdigest(w) & (BITMAP - 1)
            bits[h >> 3] |= 1 << (h & 7)
        blocks.append(spark.sparkContext.broadcast(b))
    docs = spread(documents.select(F.col("doc_id").cast("long"), "text").where("text is not null"))
    return docs.mapInPandas(_leaks(blocks, spark.sparkContext.broadcast(bits)), SPANS)


def removal_spans(spans: DataFrame) -> DataFrame:
    """Overlapping spans of a document as one: doc_id, start, end, items."""
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.select("doc_id", "item_id", "start", "end").distinct().withColumn("new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    run = new.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.countDistinct("item_id").alias("items")).drop("run")


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_spans(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _spans(spark, folder).select("doc_id", "item_id").distinct()


def p7_removal_spans(spark: SparkSession, folder: str) -> DataFrame:
    return removal_spans(_spans(spark, folder))


def p7_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    return _spans(spark, folder).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("words").alias("longest"))


QUERIES = {"p7_found": p7_found, "p7_removal_spans": p7_removal_spans, "p7_leaked_items": p7_leaked_items}
SQL: dict[str, str] = {}
