"""Entry points, sinks, dead weight, hubs and ranked maps of each repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions import columns as C


def degrees(syms: DataFrame, e: DataFrame) -> DataFrame:
    """The symbols with fan_in and fan_out (distinct callers and callees), 0 where there are none."""
    into = e.groupBy(F.col("dst").alias("sid")).agg(F.count(F.lit(1)).alias("fan_in"))
    out = e.groupBy(F.col("src").alias("sid")).agg(F.count(F.lit(1)).alias("fan_out"))
    return syms.join(into, "sid", "left").join(out, "sid", "left").fillna(0, ["fan_in", "fan_out"])


def entry_points(d: DataFrame) -> DataFrame:
    """Programs' entries, and exported symbols outside tests that nothing calls."""
    return d.where(C.is_program_entry() | (~C.is_test() & (F.col("fan_in") == 0) & C.is_exported()))


def sinks(d: DataFrame) -> DataFrame:
    return d.where(F.col("fan_out") == 0)


def dead_weight(d: DataFrame) -> DataFrame:
    """Isolated symbols that are no entry, test or framework entry, with tier: likely (functions and methods) or review."""
    lonely = d.where((F.col("fan_in") == 0) & (F.col("fan_out") == 0) & ~C.is_program_entry() & ~C.is_test() & ~C.is_framework_entry())
    return lonely.withColumn("tier", F.when(F.col("kind").isin("function", "method"), "likely").otherwise("review"))


def top_per_repository(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of each repository; Spark keeps n rows a task before it shuffles."""
    w = Window.partitionBy("repo_id").orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def ranked_dead_weight(d: DataFrame, likely: int | None = 50, review: int | None = None) -> DataFrame:
    """dead_weight by tier, the least central first, with `place`; each tier up to its limit, None for all of it."""
    w = Window.partitionBy("repo_id", "tier").orderBy(F.asc_nulls_first("centrality"), "sid")
    rows = dead_weight(d).withColumn("place", F.row_number().over(w))
    most = F.when(F.col("tier") == "likely", F.lit(likely)).otherwise(F.lit(review))
    return rows.where(most.isNull() | (F.col("place") <= most))


def hubs(d: DataFrame, n: int = 5) -> DataFrame:
    return top_per_repository(d.where("fan_in > 0"), n, F.desc("fan_in"), F.desc_nulls_last("centrality"), F.asc("sid"))


def totals(d: DataFrame, e: DataFrame) -> DataFrame:
    """A row per repository: files, symbols, edges, isolated symbols."""
    count = e.groupBy("repo_id").agg(F.count(F.lit(1)).alias("edges"))
    out = d.groupBy("repo_id").agg(F.countDistinct("file").alias("files"), F.count(F.lit(1)).alias("symbols"), F.count_if((F.col("fan_in") == 0) & (F.col("fan_out") == 0)).alias("isolated"))
    return out.join(count, "repo_id", "left").fillna(0, ["edges"])


def module_map(syms: DataFrame, scope: str | None = None, limit: int | None = None) -> DataFrame:
    """A row per file: its symbols by falling centrality, and its place among the files of its repository by the highest.

    With limit only the first symbols of each repository are kept; `kept` and `total` tell how many of how many."""
    rows = syms if scope is None else syms.where(C.in_scope_map("file", scope))
    total = rows.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total"))
    score = F.coalesce("centrality", F.lit(0.0))
    if limit is not None:
        rows = top_per_repository(rows, limit, score.desc(), F.asc("sid")).drop("place")
    one = F.struct((-score).alias("c"), F.col("sid"), F.concat_ws(" ", "kind", "name").alias("label"))
    by = rows.groupBy("repo_id", "file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["label"]), "; ").alias("symbols"), F.max(score).alias("top"), F.count(F.lit(1)).alias("kept"))
    return by.join(total, "repo_id").withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("top"), "file")))


def map_limit(chars: Column | int) -> Column:
    """How many symbols a map gets for so many characters: one a hundred, 3 to 40."""
    c = F.lit(chars) if isinstance(chars, int) else chars
    return F.greatest(F.lit(3), F.least(F.lit(40), F.floor(c / 100)))


def dump(ledger_lines: DataFrame, syms: DataFrame, budget: int = 1500, reserved: int = 150) -> DataFrame:
    """repo_id, part (ledger, map), place, text: what of a repository's ledger and map fits into budget x 4 bytes.

    ledger_lines: repo_id, doc_id, line, text. The ledger comes first, line by line while it fits with `reserved` left
    over; the first line that doesn't cuts off the rest. The map has as many symbols as the bytes that are left allow, the
    most central first, cut in the same way."""
    room = budget * 4 - reserved
    # a line takes at least its line feed, so no more than `room` lines can be kept
    first = Window.partitionBy("repo_id").orderBy("doc_id", "line")
    upto = Window.partitionBy("repo_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = ledger_lines.withColumn("place", F.row_number().over(first)).where(F.col("place") <= room)
    rows = rows.withColumn("sum", F.sum(F.octet_length("text") + 1).over(upto)).where(F.col("sum") <= room)
    spent = rows.groupBy("repo_id").agg(F.max("sum").alias("spent"))
    label = F.concat_ws(" ", F.concat("file", F.lit(":")), "kind", "name")
    score = F.coalesce("centrality", F.lit(0.0))
    top = top_per_repository(syms.select("repo_id", "sid", score.alias("score"), label.alias("text")), 40, F.desc("score"), F.asc("sid")).join(spent, "repo_id", "left")
    left = F.lit(room) - F.coalesce("spent", F.lit(0))
    top = top.where(F.col("place") <= map_limit(left)).withColumn("sum", F.sum(F.octet_length("text") + 1).over(upto)).where(F.col("sum") <= left)
    return rows.select("repo_id", F.lit("ledger").alias("part"), "place", "text").unionByName(top.select("repo_id", F.lit("map").alias("part"), "place", "text"))
