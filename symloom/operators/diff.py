"""From hunks of a change to the symbols it touches and what depends on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions import columns as C
from symloom.operators.traverse import call_sites, reach, word_hits
from symloom.util import table, written


def hunks(spark: SparkSession, folder: str) -> DataFrame:
    """hunk_id, file, first, last of each hunk once; without those of files that are gone and of unreadable headers."""
    df = table(spark, folder, "hunks").select("hunk_id", C.repository_path("path").alias("file"), C.hunk_range("header").alias("r"))
    return df.where("file IS NOT NULL AND r IS NOT NULL").select("hunk_id", "file", "r.first", "r.last").distinct()


def mutated(syms: DataFrame, h: DataFrame) -> DataFrame:
    """hunk_id, sid: symbols whose lines overlap the hunk's. The file is an equality, so the range is only tested within it;
    a path begins with its repository, so it names one file of all repositories."""
    s = syms.select("sid", "repo_id", "file", "start_line", F.coalesce("end_line", "start_line").alias("stop"))
    return s.join(h, "file").where("start_line <= last AND stop >= first").select("hunk_id", "repo_id", "sid").distinct()


def affected(e: DataFrame, touched: DataFrame, depth: int = 3) -> DataFrame:
    """sid, depth, sources: what reaches a touched symbol, with the least distance and how many touched symbols it reaches;
    touched symbols themselves are left out. To count them every touched symbol walks by itself; cone() has the distances
    alone from one walk."""
    seeds = touched.select(F.col("sid").alias("source"), "sid").distinct()
    cone = reach(e, seeds, depth).where("depth > 0")
    by = cone.groupBy("sid").agg(F.min("depth").alias("depth"), F.countDistinct("source").alias("sources"))
    return by.join(seeds.select("sid"), "sid", "left_anti")


def cone(e: DataFrame, touched: DataFrame, depth: int = 3) -> DataFrame:
    """sid, depth, other: what a walk of 1..depth calls from any touched symbol reaches, with the least distance, and
    whether one of those it reaches is another symbol than itself. One walk from the whole set: of the touched symbols only
    the two extremes are carried along, so a hop has a row per symbol however many there are."""
    step = e.select(F.col("dst").alias("at"), F.col("src").alias("sid")).distinct()
    front = touched.select("sid").distinct().select("sid", F.col("sid").alias("low"), F.col("sid").alias("high"))
    hops = None
    for d in range(1, depth + 1):
        moved = front.withColumnRenamed("sid", "at").join(step, "at").groupBy("sid").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        front = written(moved)
        hop = front.withColumn("depth", F.lit(d))
        hops = hop if hops is None else hops.unionByName(hop)
    other = (F.col("low") != F.col("sid")) | (F.col("high") != F.col("sid"))
    return hops.groupBy("sid").agg(F.min("depth").alias("depth"), F.max(other).alias("other"))


def report(syms: DataFrame, e: DataFrame, touched: DataFrame, depth: int = 3) -> DataFrame:
    """what, sid, depth, lines, file of a change: `affected` symbols with their distance and the lines at which direct
    callers call a touched symbol; `entry` points, `suite` files and literal `mention` lines of tests that it reaches.

    syms: symbols with body and fan_in. Touched symbols are no affected ones, but count as entries and suites where another
    touched symbol reaches them. A test that the walk reaches is no mention."""
    seeds = touched.select("sid").distinct()
    found = written(cone(e, seeds, depth))
    calls = e.join(seeds.withColumnRenamed("sid", "dst"), "dst").join(syms.select(F.col("sid").alias("dst"), F.array(C.mention_name("name")).alias("names")), "dst")
    calls = calls.select(F.col("dst").alias("source"), F.col("src").alias("sid"), "names")
    sites = call_sites(syms.select("sid", "start_line", "body"), calls).groupBy("sid").agg(F.array_join(F.sort_array(F.collect_set("line")), " ").alias("lines"))
    columns = ("what", "sid", "depth", "lines", "file")
    of = syms.select("sid", "file", "name", "kind", "signature", "fan_in")
    hit = found.join(of, "sid")
    reached = hit.where("other")
    none = F.lit(None)
    affected_ = hit.join(seeds, "sid", "left_anti").join(sites, "sid", "left").select(F.lit("affected").alias("what"), "sid", "depth", F.coalesce("lines", F.lit("")).alias("lines"), "file")
    entry = C.is_program_entry() | (~C.is_test() & (F.col("fan_in") == 0) & C.is_exported())
    entries = reached.where(entry).select(F.lit("entry").alias("what"), "sid", "depth", none.cast("string").alias("lines"), "file")
    suites = reached.where(C.is_test()).groupBy("file").agg(F.min("depth").alias("depth")).select(F.lit("suite").alias("what"), none.cast("long").alias("sid"), "depth", none.cast("string").alias("lines"), "file")
    words = syms.join(seeds, "sid", "left_semi").select("repo_id", F.col("sid").alias("source"), C.mention_name("name").alias("word"))
    lines = word_hits(syms.where(C.is_test()).select("repo_id", "sid", "file", "start_line", "body"), words).where("sid <> source").join(found.select("sid"), "sid", "left_anti")
    mentions = lines.groupBy("sid", "file").agg(F.array_join(F.sort_array(F.collect_set("line")), " ").alias("lines")).select(F.lit("mention").alias("what"), "sid", none.cast("int").alias("depth"), "lines", "file")
    return affected_.select(*columns).unionByName(entries).unionByName(suites).unionByName(mentions)


def ranges_of_diffs(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, file, first, last of every hunk in unified diffs: `+++` lines name the file until the next one, /dev/null none.

    The few lines that matter are folded in order inside the row of their text."""
    start = F.struct(F.lit(None).cast("string").alias("file"), F.array().cast("array<struct<file:string,header:string>>").alias("all"))

    def step(acc, x):
        named = F.when(x.startswith("+++ "), C.repository_path(F.regexp_replace(F.substring(x, 5, 1_000_000), r"\t.*$", ""))).otherwise(acc["file"])
        hit = x.startswith("@@ ") & acc["file"].isNotNull()
        more = F.when(hit, F.array(F.struct(acc["file"].alias("file"), x.alias("header")))).otherwise(F.array().cast("array<struct<file:string,header:string>>"))
        return F.struct(named.alias("file"), F.concat(acc["all"], more).alias("all"))

    marked = F.filter(C.lines(text), lambda x: x.startswith("+++ ") | x.startswith("@@ "))
    rows = texts.select(key, F.explode(F.aggregate(marked, start, step, lambda acc: acc["all"])).alias("h"))
    return rows.select(key, "h.file", C.hunk_range("h.header").alias("r")).where("r IS NOT NULL").select(key, "file", "r.first", "r.last")
