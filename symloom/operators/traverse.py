"""Depth-bounded traversals and PageRank over the call graph, for many sources or repositories at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.functions import columns as C
from symloom.util import bucketed, discard, written

ROWS_A_BUCKET = 500_000


def reach(e: DataFrame, seeds: DataFrame, depth: int, up: bool = True) -> DataFrame:
    """source, sid, depth: what is reached from the seeds (source, sid) in at most `depth` calls, with the least number;
    the seeds have depth 0. A frontier that is empty ends the walk early. Each hop is one join on the symbol, whose hot
    ones Spark's skew join splits, and one anti join on (source, sid). The result has a row per pair it reaches; where only
    the distance from a set is wanted, diff.cone() has a row per symbol."""
    a, b = ("dst", "src") if up else ("src", "dst")
    step = e.select(F.col(a).alias("sid"), F.col(b).alias("next")).distinct()
    frontier = seeds.select("source", "sid").distinct().withColumn("depth", F.lit(0))
    levels = [frontier]
    for d in range(1, depth + 1):
        seen = reduce(DataFrame.unionByName, levels).select("source", "sid")
        found = frontier.join(step, "sid").select("source", F.col("next").alias("sid")).distinct()
        frontier = written(found.join(seen, ["source", "sid"], "left_anti").withColumn("depth", F.lit(d)))
        levels.append(frontier)
        if frontier.isEmpty():
            break
    return reduce(DataFrame.unionByName, levels)


def transitions(e: DataFrame) -> DataFrame:
    """src, dst, p: the share of each edge in the weight that leaves its source."""
    total = e.groupBy("src").agg(F.sum("w").alias("total"))
    return e.join(total, "src").select("repo_id", "src", "dst", (F.col("w") / F.col("total")).alias("p"))


def pagerank(nodes: DataFrame, e: DataFrame, rounds: int = 100, tolerance: float = 1e-6, damping: float = 0.85, focus: DataFrame | None = None, weighted: bool = True) -> DataFrame:
    """repo_id, sid, rank. nodes: repo_id, sid, is_test; every repository is a graph of its own that sums to 1.

    Without focus the prior and, after the last round, the ranks of test symbols count a quarter; with focus (sid) the
    prior is uniform over the focus and tests are not demoted. What dangles flows back by the prior. Ends when the ranks
    of no repository change by `tolerance` together. A round writes a table of ranks only, and those of older rounds are
    deleted; the totals it needs have a row per repository and are broadcast only where Spark finds them small enough."""
    if focus is None:
        weight = nodes.withColumn("m", F.when(F.col("is_test"), 0.25).otherwise(1.0))
    else:
        weight = nodes.join(focus.select("sid").distinct().withColumn("m", F.lit(1.0)), "sid", "left").fillna(0.0, ["m"])
    mass = weight.groupBy("repo_id").agg(F.sum("m").alias("mass"), F.count(F.lit(1)).alias("size")).where("mass > 0")
    t = transitions(e if weighted else e.withColumn("w", F.lit(1.0)))
    out = t.select(F.col("src").alias("sid")).distinct().withColumn("flows", F.lit(True))
    base = weight.join(mass, "repo_id").join(out, "sid", "left").select("repo_id", "sid", "is_test", (F.col("m") / F.col("mass")).alias("prior"), F.coalesce("flows", F.lit(False)).alias("flows"), (F.lit(1.0) / F.col("size")).alias("rank"))
    base = written(base)
    # what stays the same is laid out by symbol once: a round shuffles only the sums that flow along the edges
    n = max(nodes.sparkSession.sparkContext.defaultParallelism, base.count() // ROWS_A_BUCKET)
    t = bucketed(t.select(F.col("src").alias("sid"), "dst", "p").repartition(n, "sid"), "sid", n)
    still = bucketed(base.drop("rank").repartition(n, "sid"), "sid", n)
    now = bucketed(base.select("sid", "rank").repartition(n, "sid"), "sid", n)
    spent: list[DataFrame] = []
    for k in range(rounds):
        have = still.join(now.withColumnRenamed("rank", "old"), "sid")
        loose = have.where(~F.col("flows")).groupBy("repo_id").agg(F.sum("old").alias("loose"))
        inflow = now.join(t, "sid").groupBy(F.col("dst").alias("sid")).agg(F.sum(F.col("rank") * F.col("p")).alias("inflow"))
        rank = F.lit(1 - damping) * F.col("prior") + F.lit(damping) * (F.coalesce("inflow", F.lit(0.0)) + F.coalesce("loose", F.lit(0.0)) * F.col("prior"))
        nxt = bucketed(have.join(inflow, "sid", "left").join(loose, "repo_id", "left").select("repo_id", "sid", rank.alias("rank"), F.abs(rank - F.col("old")).alias("moved")), "sid", n)
        moved = nxt.groupBy("repo_id").agg(F.sum("moved").alias("moved")).agg(F.max("moved")).first()[0]
        now = nxt.select("sid", "rank")
        spent.append(nxt)
        if len(spent) > 2:
            discard(spent.pop(0))  # no later round reads the one before the last
        if k % 10 == 9:
            nodes.sparkSession._jvm.System.gc()  # lets Spark delete the shuffle files of finished rounds
        if moved is None or moved < tolerance:
            break
    now = still.join(now, "sid")
    if focus is None:
        now = now.withColumn("rank", F.col("rank") * F.when(F.col("is_test"), 0.25).otherwise(1.0))
        total = now.groupBy("repo_id").agg(F.sum("rank").alias("total"))
        now = now.join(total, "repo_id").withColumn("rank", F.when(F.col("total") > 0, F.col("rank") / F.col("total")).otherwise(0.0))
    return now.select("repo_id", "sid", "rank")


def call_sites(symbols_with_body: DataFrame, pairs: DataFrame) -> DataFrame:
    """source, sid, line: the lines of each caller's body that call a name of its source. pairs: source, sid, names.

    The head line of a longer body and comment lines are skipped; the name must begin at a word boundary and be followed
    by a call, a macro mark or type arguments. The words that are called on each line are taken out once and meet the pairs
    by (sid, word); only names that are no plain words are looked for line by line."""
    wanted = pairs.select("source", "sid", F.explode("names").alias("name")).where("name <> ''")
    plain = F.col("name").rlike(r"^[A-Za-z0-9_]+$")
    rows = symbols_with_body.join(wanted.select("sid").distinct(), "sid", "left_semi").select("sid", "start_line", C.lines("body").alias("lines"))
    at = rows.select("sid", "start_line", F.size("lines").alias("n"), F.posexplode("lines").alias("i", "text"))
    text = F.trim(F.col("text"))
    skipped = text.startswith("//") | text.startswith("#") | text.startswith("*") | text.startswith("/*")
    at = at.where(((F.col("i") > 0) | (F.col("n") == 1)) & ~skipped).select("sid", (F.col("start_line") + F.col("i")).alias("line"), "text")
    words = at.select("sid", "line", F.explode(F.array_distinct(F.expr(r"regexp_extract_all(text, '([A-Za-z0-9_]+)\\s*(?:[(!<]|::<)', 1)"))).alias("name"))
    pattern = F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), F.col("name"), F.lit(r"\E\s*(?:[(!<]|::<)"))
    odd = at.join(wanted.where(~plain), "sid").where(F.col("text").contains(F.col("name")) & F.regexp_like("text", pattern)).select("source", "sid", "line")
    return words.join(wanted.where(plain), ["sid", "name"]).select("source", "sid", "line").unionByName(odd).distinct()


def word_hits(symbols_with_body: DataFrame, words: DataFrame) -> DataFrame:
    """source, sid, file, line of each line of a body that holds a word as an identifier. words: repo_id, source, word."""
    rows = symbols_with_body.select("repo_id", "sid", "file", "start_line", F.posexplode(C.lines("body")).alias("i", "text"))
    found = rows.select("repo_id", "sid", "file", (F.col("start_line") + F.col("i")).alias("line"), F.explode(F.array_distinct(F.expr("regexp_extract_all(text, '[A-Za-z0-9_]+', 0)"))).alias("word"))
    return found.join(words.where(F.octet_length("word") >= 3), ["repo_id", "word"]).select("source", "sid", "file", "line").distinct()
