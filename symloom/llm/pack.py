"""Problem 6: filling containers of fixed capacity with whole documents.

1. Each text is measured in tokens of a public tokenizer; one longer than the capacity is cut into full containers and
   a rest, at token limits.
2. The histogram of lengths is at most `capacity` numbers whatever the corpus holds. Dynamic programming over it
   chooses the bucket limits that minimise padding: an item of a bucket is padded to the share of a container that the
   longest items of its bucket take, capacity / floor(capacity / limit).
3. Token-budget batches form inside each bucket, the longest bucket first: a batch takes items of its bucket alone while
   its budget of `capacity` tokens admits one.
4. A last step fills the room that a bucket's closed batches leave from shorter buckets: an item of exactly that length
   closes it; else it is filled from the bucket with the longest limit that fits whole, down to the shortest, and at the
   end from the one that the room lies in.
   Both steps are counts over the histogram, so the plan is a small table of (length, how many, into which containers).
5. The plan is cut at the salts of each length and joined to the items through their number within length and salt;
   nothing but the histogram and the plan meets the driver.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.util import mix, spread, table, written

CAPACITY, BUCKETS, SALTS = 2048, 32, (64, 1024)
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("symloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and tokens of each row; a null or empty text has 0. Texts are encoded whole. The vocabulary is sent along."""
    documents.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(SparkFiles.get(name))
        for b in batches:
            n = [len(e.encode_ordinary(t)) if t else 0 for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": np.array(n, np.int64)})

    return documents.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, tokens long")


def boundaries(histogram: dict[int, int], buckets: int, capacity: int | None = None) -> list[int]:
    """The upper limits of at most `buckets` ranges of length, chosen to minimise the padding of all items to the limit
    of their bucket, or with a capacity to the share of a container that the limit takes. Exact dynamic programming over
    the lengths that occur."""
    sizes = sorted(k for k, v in histogram.items() if k > 0 and v > 0)
    if not sizes:
        return []
    x = np.array([capacity / (capacity // k) if capacity else k for k in sizes], np.float64)
    count = np.concatenate([[0.0], np.cumsum([histogram[k] for k in sizes])])
    mass = np.concatenate([[0.0], np.cumsum([histogram[k] * float(k) for k in sizes])])
    m = len(sizes)
    best = np.concatenate([[0.0], np.full(m, np.inf)])
    back = []
    for _ in range(min(buckets, m)):
        now, where = best.copy(), np.full(m + 1, -1)
        for j in range(1, m + 1):
            cost = best[:j] + x[j - 1] * (count[j] - count[:j]) - (mass[j] - mass[:j])
            i = int(np.argmin(cost))
            if cost[i] < now[j]:
                now[j], where[j] = cost[i], i
        back.append(where)
        best = now
    out, j = [], m
    for where in reversed(back):
        if j and where[j] >= 0:
            out.append(sizes[j - 1])
            j = int(where[j])
    return sorted(out)


class _Stock:
    """How many items of each length are left, by bucket."""

    def __init__(self, histogram: dict[int, int], limits: list[int]):
        self.left = {k: v for k, v in histogram.items() if k > 0 and v > 0}
        self.used = dict.fromkeys(self.left, 0)
        self.limits = limits
        self.inside = [[k for k in sorted(self.left, reverse=True) if low < k <= high] for low, high in zip([0, *limits], limits)]

    def take(self, bucket: int, room: int) -> list[tuple[int, int]]:
        """(length, how many) of the bucket, the longest that fits each time, until none fits."""
        batch = []
        for k in self.inside[bucket]:
            if k <= room and self.left[k]:
                n = min(room // k, self.left[k])
                batch.append((k, n))
                room -= n * k
        return batch

    def repeats(self, batch: list[tuple[int, int]], most: int | None = None) -> int:
        times = min(self.left[k] // n for k, n in batch)
        return times if most is None else min(times, most)

    def book(self, batch: list[tuple[int, int]], times: int, container: int, bucket: int) -> list[tuple[int, int, int, int, int, int]]:
        runs = []
        for k, n in batch:
            runs.append((k, self.used[k], self.used[k] + n * times - 1, n, container, bucket))
            self.used[k] += n * times
            self.left[k] -= n * times
        return runs


def plan(histogram: dict[int, int], capacity: int, buckets: int) -> tuple[list[tuple[int, int, int, int, int, int]], list[int]]:
    """(runs, limits). Runs (size, first, last, per, container, bucket): the items numbered first..last of that size go
    `per` to a container, into consecutive containers from `container`, whose batches formed in the bucket of that limit.
    The length of the plan depends on the capacity, not on the corpus."""
    limits = boundaries(histogram, buckets, capacity)
    stock = _Stock(histogram, limits)
    runs, container = [], 0
    for b in reversed(range(len(limits))):
        rooms: list[tuple[int, int, int]] = []  # (room, first container, how many) of the closed batches
        while batch := stock.take(b, capacity):
            times = stock.repeats(batch)
            runs += stock.book(batch, times, container, limits[b])
            rooms.append((capacity - sum(k * n for k, n in batch), container, times))
            container += times
        # the widest rooms last: they still can take the long items that narrow ones can't
        rooms.sort()
        while rooms:
            room, first, many = rooms.pop()
            whole = [x for x in range(b) if limits[x] <= room]
            own = [x for x in range(b) if limits[x] > room][:1]
            closing = [x for x in own if stock.left.get(room)]
            for x in [*closing, *reversed(whole), *own]:
                batch = stock.take(x, room)
                if batch:
                    times = stock.repeats(batch, many)
                    runs += stock.book(batch, times, first, limits[b])
                    if times < many:
                        rooms.append((room, first + times, many - times))
                    rooms.append((room - sum(k * n for k, n in batch), first, times))
                    break
    return runs, limits


def pack(documents: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS, path: str = VOCABULARY) -> DataFrame:
    """A container for every document or piece: doc_id, piece, first_token, tokens, bucket (the limit of the bucket that
    its length lies in), batch (that of the bucket whose batch it is in; greater where it fills another's room), container.

    A text of 0 tokens (null, empty) takes no room and gets bucket and batch 0 and container -1. Rows with the same doc_id
    are each packed. Containers hold at most `capacity` tokens; only longer texts are cut."""
    spark = documents.sparkSession
    counted = token_counts(spread(documents), path)
    rest, full = F.col("tokens") % capacity, F.floor(F.col("tokens") / capacity).cast("long")
    pieces = F.when(F.col("tokens") == 0, F.lit(1)).otherwise(full + F.when(rest > 0, 1).otherwise(0))
    items = counted.select("doc_id", F.col("tokens").alias("total"), F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("piece"))
    items = items.select("doc_id", "piece", (F.col("piece") * capacity).alias("first_token"), F.least(F.lit(capacity).cast("long"), F.col("total") - F.col("piece") * capacity).alias("tokens"))
    # one length may hold a third of all items: salts split it, more of them on a larger cluster
    salts = min(max(SALTS[0], int(spark.conf.get("spark.sql.shuffle.partitions"))), SALTS[1])
    items = written(items.withColumn("salt", (mix(F.col("doc_id"), F.col("piece")) % salts).cast("int")))
    part = items.groupBy("tokens", "salt").agg(F.count(F.lit(1)).alias("n"))
    # at most `capacity` rows of two numbers
    histogram = {r["tokens"]: r["n"] for r in part.groupBy("tokens").agg(F.sum("n").alias("n")).collect()}
    runs, limits = plan(histogram, capacity, buckets)
    steps = spark.createDataFrame(runs, "tokens long, first long, last long, per long, start long, batch long")
    # the items of a salt are numbered from `low`: at most `salts` rows a length
    upto = Window.partitionBy("tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)
    part = part.withColumn("low", F.sum("n").over(upto) - F.col("n"))
    cut = part.join(steps, "tokens").where("first < low + n AND last >= low").drop("n")
    order = Window.partitionBy("tokens", "salt").orderBy("doc_id", "piece")
    numbered = items.withColumn("at", F.row_number().over(order) - 1)
    placed = numbered.join(cut, ["tokens", "salt"], "left").where("tokens = 0 OR (at + low >= first AND at + low <= last)")
    bucket = F.element_at(F.array_compact(F.array(*[F.when(F.col("tokens") <= x, x) for x in limits], F.lit(0))), 1)
    container = F.coalesce(F.col("start") + F.floor((F.col("at") + F.col("low") - F.col("first")) / F.col("per")), F.lit(-1)).cast("long")
    return placed.select("doc_id", "piece", "first_token", "tokens", F.when(F.col("tokens") > 0, bucket).otherwise(0).cast("long").alias("bucket"), F.coalesce("batch", F.lit(0)).alias("batch"), container.alias("container"))


def padding(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A row per bucket: the containers whose batches formed in it, their tokens, those of them that fill from shorter
    buckets, and the tokens of room that stay empty."""
    own = F.sum(F.when(F.col("bucket") == F.col("batch"), F.col("tokens")).otherwise(0))
    by = packed.where("container >= 0").groupBy("batch", "container").agg(F.sum("tokens").alias("tokens"), own.alias("own"))
    out = by.groupBy(F.col("batch").alias("bucket")).agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum("own").alias("own"))
    return out.select("bucket", "containers", "tokens", (F.col("tokens") - F.col("own")).alias("filled"), (F.col("containers") * capacity - F.col("tokens")).alias("empty"))


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, and the share of the room that is used."""
    return packed.where("container >= 0").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens")).withColumn("used", F.round(F.col("tokens") / (F.col("containers") * capacity), 6))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))


def p6_padding(spark: SparkSession, folder: str) -> DataFrame:
    return padding(pack(table(spark, folder, "documents")))


QUERIES = {"p6_containers": p6_containers, "p6_padding": p6_padding}
SQL: dict[str, str] = {}
