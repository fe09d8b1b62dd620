"""The registered queries over the given tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.functions import columns as C
from symloom.operators import coordinates, diff, graph, health, ledger, search, slices, traverse
from symloom.plans import sql as Q
from symloom.sources import extract, store
from symloom.util import table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

FIND = "bridge|cache, router<a,b>"
TERMS = ("bridge", "cache", "router<a,b>")
LITERALS = ("errors.New", "unwrap_or_else", "raise ValueError")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _symbols(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    return graph.symbols(spark, folder, *more)


_shared: dict[str, DataFrame] | None = None


def share_graphs() -> None:
    """From now on the call graph of a folder is resolved and written once for all queries of this session."""
    global _shared
    _shared = {}


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    """The call graph, written once a query: several operators read it."""
    if _shared is None:
        return written(graph.call_edges(graph.arrivals(spark, folder)))
    if folder not in _shared:
        _shared[folder] = written(graph.call_edges(graph.arrivals(spark, folder)))
    return _shared[folder]


def _files(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "files").select("file_id", *columns).dropDuplicates(["file_id"])


# -- names and references
@query("name_index", Q.with_(["idx"], "SELECT repo_id, lookup, count(*) AS candidates, min(sid) AS first_sid FROM idx GROUP BY ALL"))
def _(spark, folder):
    return graph.name_index(graph.arrivals(spark, folder)).groupBy("repo_id", "lookup").agg(F.count(F.lit(1)).alias("candidates"), F.min("sid").alias("first_sid"))


@query("resolve_edges", Q.with_(["e"], "SELECT repo_id, src, dst, round(w, 6) AS w FROM e"))
def _(spark, folder):
    return graph.call_edges(graph.arrivals(spark, folder)).select("repo_id", "src", "dst", F.round("w", 6).alias("w"))


@query("resolve_stats", Q.with_(["res"], "SELECT repo_id, outcome, count(*) AS refs FROM res GROUP BY ALL"))
def _(spark, folder):
    return graph.resolve(graph.arrivals(spark, folder)).groupBy("repo_id", "outcome").agg(F.count(F.lit(1)).alias("refs"))


@query("reference_weights", Q.with_(["res"], "SELECT src, ref, round(w, 6) AS w FROM res"))
def _(spark, folder):
    return graph.resolve(graph.arrivals(spark, folder)).select("src", "ref", F.round("w", 6).alias("w"))


@query("transitions", Q.with_(["e"], "SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS p FROM e"))
def _(spark, folder):
    return traverse.transitions(_edges(spark, folder)).select("src", "dst", F.round("p", 6).alias("p"))


# -- neighbours of the busiest symbol of each repository
@query("callers_1hop", Q.with_(["s", "top"], "SELECT DISTINCT e.repo_id, s.file || ':' || s.name AS coordinate FROM e JOIN top ON top.sid = e.dst JOIN s ON s.sid = e.src"))
def _(spark, folder):
    e, s = _edges(spark, folder), _symbols(spark, folder)
    callers = e.join(graph.busiest(e).select(F.col("sid").alias("dst")), "dst").select("repo_id", F.col("src").alias("sid"))
    return callers.join(s.select("sid", C.coordinate().alias("coordinate")), "sid").select("repo_id", "coordinate").distinct()


@query("callees", Q.with_(["s", "e"], "SELECT e.repo_id, e.src, count(*) AS callees, string_agg(s.file || ':' || s.name, ' ' ORDER BY e.dst) AS coordinates FROM e JOIN s ON s.sid = e.dst GROUP BY ALL"))
def _(spark, folder):
    e = _edges(spark, folder).join(_symbols(spark, folder).select(F.col("sid").alias("dst"), C.coordinate().alias("coordinate")), "dst")
    one = F.sort_array(F.collect_list(F.struct("dst", "coordinate")))
    return e.groupBy("repo_id", "src").agg(F.count(F.lit(1)).alias("callees"), F.array_join(F.transform(one, lambda x: x["coordinate"]), " ").alias("coordinates"))


@query("mentioners", Q.with_(["words"], "SELECT DISTINCT t.sid AS target, w.sid FROM s t JOIN words w ON w.repo_id = t.repo_id AND w.word IN (t.name, regexp_extract(t.name, '([^:.]*)$', 1)) WHERE w.sid <> t.sid"))
def _(spark, folder):
    s = _symbols(spark, folder)
    return graph.mentioners(s, s).select("target", "sid")


@query("upstream_split", Q.with_(["e", "words"], """SELECT target, count(*) FILTER (tier = 'call') AS callers, count(*) FILTER (tier = 'mention') AS mentioners FROM (
SELECT e.dst AS target, e.src AS sid, 'call' AS tier FROM e UNION ALL
SELECT DISTINCT t.sid, w.sid, 'mention' FROM s t JOIN words w ON w.repo_id = t.repo_id AND w.word IN (t.name, regexp_extract(t.name, '([^:.]*)$', 1)) WHERE w.sid <> t.sid AND (t.sid, w.sid) NOT IN (SELECT dst, src FROM e)) GROUP BY target"""))
def _(spark, folder):
    s, e = _symbols(spark, folder), _edges(spark, folder)
    calls = e.select(F.col("dst").alias("target"), F.col("src").alias("sid"))
    weak = graph.mentioners(s, s).select("target", "sid").join(calls, ["target", "sid"], "left_anti")
    both = calls.withColumn("tier", F.lit("call")).unionByName(weak.withColumn("tier", F.lit("mention")))
    return both.groupBy("target").agg(F.count_if(F.col("tier") == "call").alias("callers"), F.count_if(F.col("tier") == "mention").alias("mentioners"))


@query("ctor_fold", Q.with_(["s"], "SELECT t.sid AS target, c.sid FROM s t JOIN s c ON c.repo_id = t.repo_id AND c.file = t.file AND c.name IN (t.name || '::constructor', t.name || '::new') WHERE t.kind IN ('class', 'struct') UNION SELECT sid, sid FROM s"))
def _(spark, folder):
    s = _symbols(spark, folder)
    return graph.with_constructors(s, s).select("target", "sid")


@query("follow_local", Q.with_(["s", "e"], "SELECT e.src, e.dst, strlen(d.body) AS bytes FROM e JOIN s a ON a.sid = e.src JOIN s d ON d.sid = e.dst WHERE a.file = d.file"))
def _(spark, folder):
    s = _symbols(spark, folder, "body").select("sid", "file", F.octet_length("body").alias("bytes"))
    a, d = s.select(F.col("sid").alias("src"), F.col("file").alias("at")), s.withColumnRenamed("sid", "dst")
    return _edges(spark, folder).join(a, "src").join(d, "dst").where("at = file").select("src", "dst", "bytes")


@query("name_resolution", Q.with_(["s"], f"SELECT target, CASE WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS status, n AS hits FROM (SELECT t.name AS target, count(DISTINCT s.sid) AS n FROM (SELECT DISTINCT {Q.leaf('name')} AS name FROM s) t JOIN s ON {Q.leaf('s.name')} = t.name GROUP BY t.name)"))
def _(spark, folder):
    by = _symbols(spark, folder).where("name IS NOT NULL").groupBy(C.leaf("name").alias("target")).agg(F.count(F.lit(1)).alias("hits"))
    return by.select("target", F.when(F.col("hits") == 1, "unique").otherwise("ambiguous").alias("status"), "hits")


# -- ranks
def _nodes(s: DataFrame) -> DataFrame:
    return s.select("repo_id", "sid", C.is_test().alias("is_test"))


@query("pagerank_global", Q.pagerank(f"(CASE WHEN {Q.is_test('file', 'name')} THEN 0.25 ELSE 1.0 END)", "w", True))
def _(spark, folder):
    r = traverse.pagerank(_nodes(_symbols(spark, folder)), _edges(spark, folder))
    return r.select("repo_id", "sid", F.round("rank", 6).alias("rank"))


@query("pagerank_focus", Q.pagerank("(CASE WHEN contains(lower(name), 'bridge') OR contains(lower(file), 'bridge') THEN 1.0 ELSE 0.0 END)", "w", False))
def _(spark, folder):
    s = _symbols(spark, folder)
    focus = s.where(F.lower("name").contains("bridge") | F.lower("file").contains("bridge")).select("sid")
    r = traverse.pagerank(_nodes(s), _edges(spark, folder), focus=focus)
    return r.select("repo_id", "sid", F.round("rank", 6).alias("rank"))


@query("pagerank_unweighted", Q.pagerank(f"(CASE WHEN {Q.is_test('file', 'name')} THEN 0.25 ELSE 1.0 END)", "1.0", True))
def _(spark, folder):
    r = traverse.pagerank(_nodes(_symbols(spark, folder)), _edges(spark, folder), weighted=False)
    return r.select("repo_id", "sid", F.round("rank", 6).alias("rank"))


MAIN = "name = 'main' OR ends_with(name, '::main') OR ends_with(name, '.main')"


@query("pagerank_seeds", Q.pagerank(f"(CASE WHEN contains(lower(name), 'cache') OR contains(lower(file), 'cache') OR {MAIN} THEN 1.0 ELSE 0.0 END)", "w", False))
def _(spark, folder):
    """The focus is what a coordinate names together with what a seed term finds, each symbol once."""
    s = _symbols(spark, folder)
    seeds = s.where(F.lower("name").contains("cache") | F.lower("file").contains("cache")).select("sid")
    focus = s.where(C.named("name", "main")).select("sid").union(seeds).distinct()
    r = traverse.pagerank(_nodes(s), _edges(spark, folder), focus=focus)
    return r.select("repo_id", "sid", F.round("rank", 6).alias("rank"))


# -- traversals from the busiest symbol of each repository, constructors included
def _seeds(s: DataFrame, e: DataFrame) -> DataFrame:
    t = s.join(graph.busiest(e).select("sid"), "sid")
    return graph.with_constructors(s, t).select(F.col("target").alias("source"), "sid")


SEEDS = "SELECT t.sid AS source, t.sid FROM top t UNION SELECT t.sid, c.sid FROM top t JOIN s x ON x.sid = t.sid JOIN s c ON c.repo_id = x.repo_id AND c.file = x.file AND c.name IN (x.name || '::constructor', x.name || '::new') WHERE x.kind IN ('class', 'struct')"


@query("blast_up_3", Q.with_(["s", "top"], "SELECT source, sid, depth FROM reached", *Q.reach(SEEDS, True)))
def _(spark, folder):
    s, e = _symbols(spark, folder), _edges(spark, folder)
    return traverse.reach(e, _seeds(s, e), 3)


CALLING = "SELECT src AS source, src AS sid FROM e"


@query("blast_down_3", Q.with_(["e"], "SELECT source, r.sid, depth, r.sid NOT IN (SELECT src FROM e) AS is_sink FROM reached r", *Q.reach(CALLING, False)))
def _(spark, folder):
    """What each symbol that calls something reaches, and where that ends."""
    e = _edges(spark, folder)
    down = traverse.reach(e, e.select(F.col("src").alias("source"), F.col("src").alias("sid")), 3, up=False)
    calls = e.select(F.col("src").alias("sid"), F.lit(True).alias("calls")).distinct()
    return down.join(calls, "sid", "left").select("source", "sid", "depth", F.col("calls").isNull().alias("is_sink"))


@query("blast_report", Q.with_(["s", "top", "deg"], f"SELECT source, count(*) AS affected, count(*) FILTER ({Q.is_program('name')} OR (NOT {Q.is_test('file', 'name')} AND fan_in = 0 AND {Q.is_exported('file', 'name', 'signature')})) AS entry_points, count(DISTINCT CASE WHEN {Q.is_test('file', 'name')} THEN file END) AS test_suites FROM reached JOIN deg USING (sid) WHERE depth > 0 GROUP BY source", *Q.reach(SEEDS, True)))
def _(spark, folder):
    s, e = _symbols(spark, folder), _edges(spark, folder)
    cone = traverse.reach(e, _seeds(s, e), 3).where("depth > 0")
    d = health.degrees(s, e)
    d = d.select("sid", "file", C.is_test().alias("test"), (C.is_program_entry() | (~C.is_test() & (F.col("fan_in") == 0) & C.is_exported())).alias("entry"))
    return cone.join(d, "sid").groupBy("source").agg(F.count(F.lit(1)).alias("affected"), F.count_if("entry").alias("entry_points"), F.countDistinct(F.when(F.col("test"), F.col("file"))).alias("test_suites"))


IS_ENTRY = f"({Q.is_program('name')} OR (NOT {Q.is_test('file', 'name')} AND fan_in = 0 AND {Q.is_exported('file', 'name', 'signature')}))"


@query("blast_lists", Q.with_(["s", "top", "deg"], f"SELECT source, coalesce(string_agg(file || ':' || name, ' ' ORDER BY depth, sid) FILTER ({IS_ENTRY}), '') AS entry_points, coalesce((SELECT string_agg(file, ' ' ORDER BY depth, file) FROM (SELECT min(r2.depth) AS depth, d2.file FROM reached r2 JOIN deg d2 ON d2.sid = r2.sid WHERE r2.source = x.source AND r2.depth > 0 AND {Q.is_test('d2.file', 'd2.name')} GROUP BY d2.file)), '') AS test_suites FROM (SELECT * FROM reached JOIN deg USING (sid) WHERE depth > 0) x GROUP BY source", *Q.reach(SEEDS, True)))
def _(spark, folder):
    """The entry points and test files of each blast, each once, in the order in which the walk meets them."""
    s, e = _symbols(spark, folder), _edges(spark, folder)
    cone = traverse.reach(e, _seeds(s, e), 3).where("depth > 0")
    d = health.degrees(s, e)
    d = d.select("sid", "file", C.coordinate().alias("coordinate"), C.is_test().alias("test"), (C.is_program_entry() | (~C.is_test() & (F.col("fan_in") == 0) & C.is_exported())).alias("entry"))
    rows = cone.join(d, "sid")
    listed = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", F.col(c).alias("o"), "text"))), lambda x: x["text"]), " ")
    suites = rows.where("test").groupBy("source", F.col("file").alias("text")).agg(F.min("depth").alias("depth")).groupBy("source").agg(listed("text").alias("test_suites"))
    entries = rows.where("entry").withColumn("text", F.col("coordinate")).groupBy("source").agg(listed("sid").alias("entry_points"))
    out = rows.select("source").distinct().join(entries, "source", "left").join(suites, "source", "left")
    return out.select("source", F.coalesce("entry_points", F.lit("")).alias("entry_points"), F.coalesce("test_suites", F.lit("")).alias("test_suites"))


@query("call_sites", Q.with_(["s", "e"], f"""SELECT DISTINCT source, sid, line FROM (SELECT t.sid AS source, c.sid, c.start_line + i - 1 AS line, {Q.trim('l[i]')} AS text, regexp_extract(t.name, '([^:.]*)$', 1) AS word, i, len(l) AS n
FROM (SELECT e.dst, c.sid, c.start_line, {Q.lines('c.body')} AS l, unnest(range(1, len({Q.lines('c.body')}) + 1)) AS i FROM e JOIN s c ON c.sid = e.src) c JOIN s t ON t.sid = c.dst)
WHERE (i > 1 OR n = 1) AND NOT starts_with(text, '//') AND NOT starts_with(text, '#') AND NOT starts_with(text, '*') AND NOT starts_with(text, '/*') AND word <> '' AND regexp_matches(text, '(^|[^A-Za-z0-9_])' || word || '\\s*([(!<]|::<)')"""))
def _(spark, folder):
    e = _edges(spark, folder)
    names = _symbols(spark, folder).select(F.col("sid").alias("dst"), F.array(C.mention_name("name")).alias("names"))
    pairs = e.join(names, "dst").select(F.col("dst").alias("source"), F.col("src").alias("sid"), "names")
    return traverse.call_sites(_symbols(spark, folder, "body"), pairs)


@query("value_uses", Q.with_(["s", "top", "words"], "SELECT DISTINCT t.sid AS source, w.sid FROM top JOIN s t ON t.sid = top.sid JOIN words w ON w.repo_id = t.repo_id AND w.word IN (t.name, regexp_extract(t.name, '([^:.]*)$', 1)) WHERE w.sid <> t.sid AND (t.sid, w.sid) NOT IN (SELECT source, sid FROM reached)", *Q.reach(SEEDS, True)))
def _(spark, folder):
    s, e = _symbols(spark, folder), _edges(spark, folder)
    seeds = _seeds(s, e)
    targets = s.join(seeds.select(F.col("source").alias("sid")).distinct(), "sid")
    uses = graph.mentioners(s, targets).select(F.col("target").alias("source"), "sid")
    return uses.join(traverse.reach(e, seeds, 3), ["source", "sid"], "left_anti")


@query("test_mentions", Q.with_(["s", "top"], f"""SELECT DISTINCT source, sid, line FROM (SELECT t.sid AS source, c.sid, c.start_line + i - 1 AS line, l[i] AS text, regexp_extract(t.name, '([^:.]*)$', 1) AS word
FROM (SELECT repo_id, sid, start_line, {Q.lines('body')} AS l, unnest(range(1, len({Q.lines('body')}) + 1)) AS i FROM s WHERE {Q.is_test('file', 'name')}) c JOIN top USING (repo_id) JOIN s t ON t.sid = top.sid)
WHERE strlen(word) >= 3 AND regexp_matches(text, '(^|[^A-Za-z0-9_])' || word || '([^A-Za-z0-9_]|$)') AND (source, sid) NOT IN (SELECT source, sid FROM reached)""", *Q.reach(SEEDS, True)))
def _(spark, folder):
    s, e = _symbols(spark, folder), _edges(spark, folder)
    seeds = _seeds(s, e)
    words = s.join(graph.busiest(e).select("sid"), "sid").select("repo_id", F.col("sid").alias("source"), C.mention_name("name").alias("word"))
    hits = traverse.word_hits(_symbols(spark, folder, "body").where(C.is_test()), words)
    return hits.join(traverse.reach(e, seeds, 3), ["source", "sid"], "left_anti").select("source", "sid", "line")


# -- health
ENTRY = f"({Q.is_program('name')} OR (NOT {Q.is_test('file', 'name')} AND fan_in = 0 AND {Q.is_exported('file', 'name', 'signature')}))"
DEAD = f"fan_in = 0 AND fan_out = 0 AND NOT {Q.is_program('name')} AND NOT {Q.is_test('file', 'name')} AND NOT {Q.is_framework('file', 'name', 'kind', 'signature')}"


def _degrees(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    e = _edges(spark, folder)
    return health.degrees(_symbols(spark, folder), e), e


@query("entry_points", Q.with_(["deg"], f"SELECT sid, file || ':' || name AS coordinate FROM deg WHERE {ENTRY}"))
def _(spark, folder):
    return health.entry_points(_degrees(spark, folder)[0]).select("sid", C.coordinate().alias("coordinate"))


@query("sinks", Q.with_(["deg"], "SELECT sid, name FROM deg WHERE fan_out = 0"))
def _(spark, folder):
    return health.sinks(_degrees(spark, folder)[0]).select("sid", "name")


@query("dead_weight", Q.with_(["deg"], f"SELECT sid, CASE WHEN kind IN ('function', 'method') THEN 'likely' ELSE 'review' END AS tier FROM deg WHERE {DEAD}"))
def _(spark, folder):
    return health.dead_weight(_degrees(spark, folder)[0]).select("sid", "tier")


@query("dead_ranked", Q.with_(["deg"], f"SELECT repo_id, sid, tier, row_number() OVER w AS place FROM (SELECT *, CASE WHEN kind IN ('function', 'method') THEN 'likely' ELSE 'review' END AS tier FROM deg WHERE {DEAD}) WINDOW w AS (PARTITION BY repo_id, tier ORDER BY centrality ASC NULLS FIRST, sid) QUALIFY tier = 'review' OR row_number() OVER w <= 50"))
def _(spark, folder):
    rows = health.ranked_dead_weight(_degrees(spark, folder)[0])
    return rows.select("repo_id", "sid", "tier", F.col("place").cast("long").alias("place"))


@query("hubs_top5", Q.with_(["deg"], "SELECT repo_id, sid, fan_in, row_number() OVER w AS place FROM deg WHERE fan_in > 0 WINDOW w AS (PARTITION BY repo_id ORDER BY fan_in DESC, centrality DESC NULLS LAST, sid) QUALIFY row_number() OVER w <= 5"))
def _(spark, folder):
    return health.hubs(_degrees(spark, folder)[0]).select("repo_id", "sid", F.col("fan_in").cast("long").alias("fan_in"), F.col("place").cast("long").alias("place"))


@query("doctor_totals", Q.with_(["deg"], "SELECT d.repo_id, count(DISTINCT file) AS files, count(*) AS symbols, any_value(coalesce(x.n, 0)) AS edges, count(*) FILTER (fan_in = 0 AND fan_out = 0) AS isolated FROM deg d LEFT JOIN (SELECT repo_id, count(*) AS n FROM e GROUP BY repo_id) x ON x.repo_id = d.repo_id GROUP BY d.repo_id"))
def _(spark, folder):
    d, e = _degrees(spark, folder)
    return health.totals(d, e).select("repo_id", "files", "symbols", F.col("edges").cast("long").alias("edges"), "isolated")


MAP = "SELECT repo_id, file, string_agg(kind || ' ' || name, '; ' ORDER BY coalesce(centrality, 0) DESC, sid) AS symbols, count(*) AS kept, any_value(total) AS total, row_number() OVER (PARTITION BY repo_id ORDER BY max(coalesce(centrality, 0)) DESC, file) AS place FROM {rows} GROUP BY repo_id, file"


@query("map_modules", Q.with_(["s"], MAP.format(rows="(SELECT *, count(*) OVER (PARTITION BY repo_id) AS total FROM s)")))
def _(spark, folder):
    return health.module_map(_symbols(spark, folder)).select("repo_id", "file", "symbols", "kept", "total", F.col("place").cast("long").alias("place"))


@query("map_ranked", Q.with_(["s"], MAP.format(rows="(SELECT *, count(*) OVER (PARTITION BY repo_id) AS total FROM s QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY coalesce(centrality, 0) DESC, sid) <= 20)")))
def _(spark, folder):
    return health.module_map(_symbols(spark, folder), limit=20).select("repo_id", "file", "symbols", "kept", "total", F.col("place").cast("long").alias("place"))


@query("map_scope", Q.with_(["s"], MAP.format(rows="(SELECT *, count(*) OVER (PARTITION BY repo_id) AS total FROM s WHERE file = 'internal' OR starts_with(file, 'internal/') OR list_contains(string_split(file, '/'), 'internal'))")))
def _(spark, folder):
    return health.module_map(_symbols(spark, folder), "internal").select("repo_id", "file", "symbols", "kept", "total", F.col("place").cast("long").alias("place"))


# -- changes
@query("hunk_ranges", Q.with_(["hk"], "SELECT hunk_id, file, first, last FROM hk"))
def _(spark, folder):
    return diff.hunks(spark, folder)


TOUCHED = "touched AS MATERIALIZED (SELECT DISTINCT hk.hunk_id, s.repo_id, s.sid FROM hk JOIN s ON s.file = hk.file AND s.start_line <= hk.last AND coalesce(s.end_line, s.start_line) >= hk.first)"


@query("diff_mutated", Q.with_(["hk", "s"], "SELECT hunk_id, sid FROM touched", TOUCHED))
def _(spark, folder):
    return diff.mutated(_symbols(spark, folder), diff.hunks(spark, folder)).select("hunk_id", "sid")


@query("diff_affected", Q.with_(["hk", "s", "e"], "SELECT sid, min(depth) AS depth, count(DISTINCT source) AS sources FROM reached WHERE depth > 0 AND sid NOT IN (SELECT sid FROM touched) GROUP BY sid", TOUCHED, *Q.reach("SELECT sid AS source, sid FROM touched", True)))
def _(spark, folder):
    s = _symbols(spark, folder)
    return diff.affected(_edges(spark, folder), written(diff.mutated(s, diff.hunks(spark, folder))))


HOPS = [
    "t AS MATERIALIZED (SELECT DISTINCT sid FROM touched)",
    "p AS MATERIALIZED (SELECT source, sid, depth FROM reached WHERE depth > 0)",
    "c AS MATERIALIZED (SELECT sid, min(depth) AS depth FROM p GROUP BY sid)",
]


@query("diff_depths", Q.with_(["hk", "s", "e"], "SELECT repo_id, c.sid, c.depth, row_number() OVER (PARTITION BY repo_id ORDER BY depth, file || ':' || name, c.sid) AS place FROM c JOIN s ON s.sid = c.sid WHERE c.sid NOT IN (SELECT sid FROM t)", TOUCHED, *Q.reach("SELECT sid AS source, sid FROM touched", True), *HOPS))
def _(spark, folder):
    """What a change reaches, by distance and coordinate; one walk from all touched symbols."""
    s = _symbols(spark, folder)
    touched = written(diff.mutated(s, diff.hunks(spark, folder)))
    rows = diff.cone(_edges(spark, folder), touched).join(touched.select("sid"), "sid", "left_anti").join(s.select("sid", "repo_id", C.coordinate().alias("coordinate")), "sid")
    order = Window.partitionBy("repo_id").orderBy("depth", "coordinate", "sid")
    return rows.select("repo_id", "sid", "depth", F.row_number().over(order).cast("long").alias("place"))


REPORT = f"""
SELECT 'affected' AS what, c.sid, c.depth, coalesce(l.lines, '') AS lines, s.file FROM c JOIN s ON s.sid = c.sid LEFT JOIN (SELECT sid, string_agg(line::VARCHAR, ' ' ORDER BY line) AS lines FROM (
  SELECT DISTINCT sid, line FROM (SELECT c.sid, c.start_line + i - 1 AS line, {Q.trim('l[i]')} AS text, regexp_extract(t.name, '([^:.]*)$', 1) AS word, i, len(l) AS n
  FROM (SELECT e.dst, c.sid, c.start_line, {Q.lines('c.body')} AS l, unnest(range(1, len({Q.lines('c.body')}) + 1)) AS i FROM e JOIN s c ON c.sid = e.src WHERE e.dst IN (SELECT sid FROM t)) c JOIN s t ON t.sid = c.dst)
  WHERE (i > 1 OR n = 1) AND NOT starts_with(text, '//') AND NOT starts_with(text, '#') AND NOT starts_with(text, '*') AND NOT starts_with(text, '/*') AND word <> '' AND regexp_matches(text, '(^|[^A-Za-z0-9_])' || word || '\\s*([(!<]|::<)')) GROUP BY sid) l ON l.sid = c.sid WHERE c.sid NOT IN (SELECT sid FROM t)
UNION ALL SELECT 'entry', o.sid, c.depth, NULL, d.file FROM (SELECT DISTINCT sid FROM p WHERE source <> sid) o JOIN c ON c.sid = o.sid JOIN deg d ON d.sid = o.sid WHERE {IS_ENTRY}
UNION ALL SELECT 'suite', NULL, min(c.depth), NULL, d.file FROM (SELECT DISTINCT sid FROM p WHERE source <> sid) o JOIN c ON c.sid = o.sid JOIN deg d ON d.sid = o.sid WHERE {Q.is_test('d.file', 'd.name')} GROUP BY d.file
UNION ALL SELECT 'mention', sid, NULL, string_agg(line::VARCHAR, ' ' ORDER BY line), file FROM (SELECT DISTINCT c.sid, c.file, c.start_line + i - 1 AS line FROM (
  SELECT repo_id, sid, file, start_line, {Q.lines('body')} AS l, unnest(range(1, len({Q.lines('body')}) + 1)) AS i FROM s WHERE {Q.is_test('file', 'name')} AND sid NOT IN (SELECT sid FROM c)) c
  JOIN (SELECT s.repo_id, s.sid, regexp_extract(s.name, '([^:.]*)$', 1) AS word FROM s JOIN t ON t.sid = s.sid) w ON w.repo_id = c.repo_id AND w.sid <> c.sid AND strlen(w.word) >= 3 AND list_contains(regexp_extract_all(l[i], '[A-Za-z0-9_]+'), w.word)) GROUP BY sid, file"""


@query("diff_report", Q.with_(["hk", "s", "e", "deg"], REPORT, TOUCHED, *Q.reach("SELECT sid AS source, sid FROM touched", True), *HOPS))
def _(spark, folder):
    """Affected symbols with the lines that call into the change, and the entry points, suites and test lines it reaches."""
    s, e = _symbols(spark, folder, "body"), _edges(spark, folder)
    touched = written(diff.mutated(s, diff.hunks(spark, folder)))
    return diff.report(health.degrees(s, e), e, touched)


@query("diff_text_ranges", Q.with_(["hk"], "SELECT DISTINCT file, first, last FROM hk"))
def _(spark, folder):
    """The hunks as the diff texts that hold them, read again."""
    h = table(spark, folder, "hunks").where("header IS NOT NULL AND path IS NOT NULL")
    text = F.concat(F.lit("+++ b/"), F.col("path"), F.lit("\t\n"), F.col("header"), F.lit("\n+ line\n"))
    texts = h.select("hunk_id", F.when(F.trim("path") == "/dev/null", F.concat(F.lit("+++ /dev/null\n"), "header")).otherwise(text).alias("text"))
    return diff.ranges_of_diffs(texts, "hunk_id", "text").select("file", "first", "last").distinct()


OLD, NEW = "ingested_at < TIMESTAMP{} '2025-12-01'", "ingested_at >= TIMESTAMP{} '2025-03-01'"
ONE = "SELECT file_id, min(hash) AS hash FROM files WHERE {} GROUP BY file_id"


@query("cdc_status", f"SELECT file_id, CASE WHEN o.file_id IS NULL THEN 'new' WHEN n.file_id IS NULL THEN 'deleted' WHEN o.hash IS NOT DISTINCT FROM n.hash THEN 'same' ELSE 'changed' END AS status FROM ({ONE.format(OLD.format(''))}) o FULL JOIN ({ONE.format(NEW.format(''))}) n USING (file_id)")
def _(spark, folder):
    """What had arrived before one day against what arrived from an earlier one on: the snapshots overlap."""
    f = table(spark, folder, "files")
    state = lambda when: f.where(when.format("_NTZ")).groupBy("file_id").agg(F.min("hash").alias("hash"))
    return store.changes(state(OLD), state(NEW), "file_id")


# -- search
CONTAINS = " OR ".join("contains(lower({c}), '" + t + "')" for t in TERMS)
EXACT = "(" + " OR ".join(f"lower(name) = '{t}'" for t in TERMS) + ")"


@query("find_symbols", Q.with_(["s"], f"SELECT sid, {EXACT} AS exact, strlen(name) AS bytes FROM s WHERE {CONTAINS.format(c='name')}"))
def _(spark, folder):
    return search.find_symbols(_symbols(spark, folder), search.terms(FIND)).select("sid", "exact", "bytes")


@query("find_files", Q.with_(["f"], f"SELECT file_id, path FROM f WHERE {CONTAINS.format(c='path')}"))
def _(spark, folder):
    return search.find_files(_files(spark, folder, "path"), search.terms(FIND)).select("file_id", "path")


HITS = f"hits AS MATERIALIZED (SELECT file_id, i AS line, term FROM (SELECT file_id, {Q.lines('content')} AS l, unnest(range(1, len({Q.lines('content')}) + 1)) AS i FROM f) CROSS JOIN (SELECT unnest({list(TERMS)}) AS term) WHERE contains(lower(l[i]), term))"


@query("find_literal", Q.with_(["f"], "SELECT file_id, line, term FROM hits", HITS))
def _(spark, folder):
    return search.literal_hits(_files(spark, folder, "content"), search.terms(FIND)).select("file_id", F.col("line").cast("long").alias("line"), "term")


@query("find_union", Q.with_(["s", "f"], f"""SELECT 'symbol' AS what, sid AS id, NULL::BIGINT AS line, sid FROM s WHERE {CONTAINS.format(c='name')} UNION ALL SELECT 'file', file_id, NULL, NULL FROM f WHERE {CONTAINS.format(c='path')}
UNION ALL SELECT 'line', h.file_id, h.line, arg_min(s.sid, (coalesce(s.end_line, s.start_line) - s.start_line, s.sid)) FILTER (s.start_line <= h.line AND coalesce(s.end_line, s.start_line) >= h.line) FROM (SELECT DISTINCT file_id, line FROM hits WHERE NOT EXISTS (SELECT 1 FROM s WHERE contains(lower(name), term)) AND NOT EXISTS (SELECT 1 FROM f WHERE contains(lower(path), term))) h LEFT JOIN s ON s.file_id = h.file_id GROUP BY h.file_id, h.line""", HITS))
def _(spark, folder):
    return search.find(_symbols(spark, folder), _files(spark, folder, "path", "content"), search.terms(FIND)).withColumn("line", F.col("line").cast("long"))


LOST = ["errors.new", "zzz", "unwrap_or_else"]
LOST_HITS = HITS.replace(str(list(TERMS)), str(LOST))


@query("find_lost", Q.with_(["s", "f"], f"""SELECT h.file_id AS id, h.line, arg_min(s.sid, (coalesce(s.end_line, s.start_line) - s.start_line, s.sid)) FILTER (s.start_line <= h.line AND coalesce(s.end_line, s.start_line) >= h.line) AS sid FROM (SELECT DISTINCT file_id, line FROM hits WHERE NOT EXISTS (SELECT 1 FROM s WHERE contains(lower(name), term)) AND NOT EXISTS (SELECT 1 FROM f WHERE contains(lower(path), term))) h LEFT JOIN s ON s.file_id = h.file_id GROUP BY h.file_id, h.line""", LOST_HITS))
def _(spark, folder):
    """The literal lines of terms that no name and no path holds."""
    rows = search.find(_symbols(spark, folder), _files(spark, folder, "path", "content"), search.terms("|".join(LOST)))
    return rows.where("what = 'line'").select("id", F.col("line").cast("long").alias("line"), "sid")


@query("unmatched_terms", Q.with_(["s", "f"], "SELECT term FROM (SELECT unnest(['bridge', 'router<a,b>', 'zzz']) AS term) t WHERE NOT EXISTS (SELECT 1 FROM s WHERE contains(lower(name), term)) AND NOT EXISTS (SELECT 1 FROM f WHERE contains(lower(path), term))"))
def _(spark, folder):
    return search.unmatched(["bridge", "router<a,b>", "zzz"], _symbols(spark, folder), _files(spark, folder, "path"))


@query("enclosing_symbol", Q.with_(["s", "f"], "SELECT h.file_id, h.line, h.term, arg_min(s.sid, (coalesce(s.end_line, s.start_line) - s.start_line, s.sid)) FILTER (s.start_line <= h.line AND coalesce(s.end_line, s.start_line) >= h.line) AS sid FROM hits h LEFT JOIN s ON s.file_id = h.file_id GROUP BY ALL", HITS))
def _(spark, folder):
    hits = search.literal_hits(_files(spark, folder, "content"), search.terms(FIND))
    return search.enclosing(hits, _symbols(spark, folder)).select("file_id", F.col("line").cast("long").alias("line"), "term", "sid")


@query("missing_files", Q.with_(["f"], "SELECT file_id, path FROM f WHERE NOT contains(content, 'bridge') AND NOT contains(content, 'cache')"))
def _(spark, folder):
    return search.missing(_files(spark, folder, "path", "content"), "bridge|cache").select("file_id", "path")


@query("missing_defines", Q.with_(["f"], "SELECT file_id, path FROM f WHERE (contains(content, 'class ') OR contains(content, 'struct ')) AND NOT contains(content, 'Error')"))
def _(spark, folder):
    return search.missing(_files(spark, folder, "path", "content"), "Error", "class |struct ").select("file_id", "path")


@query("sink_sweep", Q.with_(["f"], f"SELECT file_id, i AS line, {Q.trim('l[i]')} AS text FROM (SELECT file_id, {Q.lines('content')} AS l, unnest(range(1, len({Q.lines('content')}) + 1)) AS i FROM f) WHERE " + " OR ".join(f"contains(l[i], '{x}')" for x in LITERALS)))
def _(spark, folder):
    return search.sweep(_files(spark, folder, "content"), list(LITERALS)).select("file_id", F.col("line").cast("long").alias("line"), "text")


@query("line_slice", Q.with_(["f", "hk"], f"SELECT DISTINCT hunk_id, greatest(first - 2, 1) AS first, least(last + 2, n) AS last, strlen(array_to_string(l[greatest(first - 2, 1):least(last + 2, n)], chr(10))) AS bytes FROM (SELECT hk.*, {Q.lines('content')} AS l, len({Q.lines('content')}) AS n FROM hk JOIN f ON f.path = hk.file) WHERE greatest(first - 2, 1) <= n"))
def _(spark, folder):
    """The lines of each hunk with two around them; the ranges are handed over back to front."""
    f = _files(spark, folder, "path", "content")
    h = diff.hunks(spark, folder).join(f.select("file_id", F.col("path").alias("file")), "file")
    cut = search.line_slice(f, h.select("file_id", "hunk_id", (F.col("last") + 2).alias("first"), (F.col("first") - 2).alias("last")))
    return cut.select("hunk_id", "first", "last", F.octet_length("text").alias("bytes")).distinct()


@query("find_ranked", Q.with_(["s"], f"SELECT repo_id, sid, row_number() OVER w AS place FROM s WHERE {CONTAINS.format(c='name')} WINDOW w AS (PARTITION BY repo_id ORDER BY {EXACT} DESC, centrality DESC NULLS LAST, strlen(name), sid) QUALIFY row_number() OVER w <= 50"))
def _(spark, folder):
    rows = search.find_symbols(_symbols(spark, folder), search.terms(FIND))
    best = health.top_per_repository(rows, 50, F.desc("exact"), F.desc_nulls_last("centrality"), F.asc("bytes"), F.asc("sid"))
    return best.select("repo_id", "sid", F.col("place").cast("long").alias("place"))


@query("coordinate_index", Q.with_(["s"], "SELECT repo_id, suffix || ':' || name AS coordinate, count(*) AS hits, min(sid) AS first_sid FROM (SELECT repo_id, sid, name, array_to_string(p[n:], '/') AS suffix FROM (SELECT repo_id, sid, name, string_split(file, '/') AS p, unnest(range(1, len(string_split(file, '/')) + 1)) AS n FROM s)) GROUP BY ALL"))
def _(spark, folder):
    return slices.coordinate_index(_symbols(spark, folder))


ENDING = "array_to_string(string_split({f}, '/')[-least(len(string_split({f}, '/')), len(string_split(p, '/'))):], '/') = array_to_string(string_split(p, '/')[-least(len(string_split({f}, '/')), len(string_split(p, '/'))):], '/')"
ASKED = f"""asked AS MATERIALIZED (SELECT DISTINCT CASE sid % 4 WHEN 0 THEN file WHEN 1 THEN array_to_string(string_split(file, '/')[-2:], '/') WHEN 2 THEN 'checkout/' || file ELSE 'elsewhere/' || {Q.base('file')} END AS p, {Q.leaf('name')} AS name FROM s WHERE name IS NOT NULL UNION ALL SELECT DISTINCT NULL, name FROM s WHERE name IS NOT NULL),
found AS MATERIALIZED (SELECT p, name, sid, centrality, min(tier) OVER (PARTITION BY p, name) AS best, tier FROM (SELECT a.p, a.name, s.sid, s.centrality, CASE WHEN a.p IS NULL THEN 3 WHEN s.file = a.p THEN 0 WHEN {ENDING.format(f='s.file')} THEN 1 WHEN {Q.base('s.file')} = {Q.base('a.p')} THEN 2 END AS tier
  FROM asked a JOIN (SELECT *, unnest(list_distinct([name, {Q.leaf('name')}, CASE WHEN contains(string_split(name, '.')[-1], '::') THEN name ELSE string_split(name, '.')[-1] END])) AS key FROM s) s ON s.key = a.name) WHERE tier IS NOT NULL)"""


@query("resolve_coordinates", Q.with_(["s"], "SELECT coalesce(p || ':', '') || name AS target, ['exact', 'suffix', 'basename', 'name'][tier + 1] AS tier, CASE WHEN count(*) OVER w = 1 THEN 'unique' ELSE 'ambiguous' END AS status, count(*) OVER w AS hits, row_number() OVER (w ORDER BY centrality DESC NULLS LAST, sid) AS place, sid FROM found WHERE tier = best WINDOW w AS (PARTITION BY p, name)", ASKED))
def _(spark, folder):
    """Coordinates of all symbols, spelled in full, shortened, under another root, in another folder, and as bare names."""
    s = _symbols(spark, folder).where("name IS NOT NULL")
    short = F.array_join(F.slice(F.concat(F.array(F.lit("")), F.split("file", "/")), -2, 2), "/")
    way = F.col("sid") % 4
    path = F.when(way == 0, F.col("file")).when(way == 1, short).when(way == 2, F.concat(F.lit("checkout/"), "file")).otherwise(F.concat(F.lit("elsewhere/"), C.base_name("file")))
    targets = s.select(F.concat_ws(":", path, C.leaf("name")).alias("target")).unionByName(s.select(F.col("name").alias("target")))
    out = coordinates.resolve(targets, s)
    return out.select("target", "tier", "status", F.col("hits").cast("long").alias("hits"), F.col("place").cast("long").alias("place"), "sid")


@query("suggestions", Q.with_(["s", "res"], """SELECT file, wanted, sid, near, row_number() OVER w AS place FROM (SELECT m.file, m.wanted, s.sid, s.start_line, contains(lower(s.name), lower(m.wanted)) OR contains(lower(m.wanted), lower(s.name)) AS near
FROM (SELECT DISTINCT a.file, ref AS wanted FROM res JOIN s a ON a.sid = res.src WHERE outcome = 'unresolved') m JOIN s ON s.file = m.file) WINDOW w AS (PARTITION BY file, wanted ORDER BY near DESC, start_line, sid) QUALIFY row_number() OVER w <= 10"""))
def _(spark, folder):
    """For each call that no name answers, the symbols of its file that come closest."""
    s = _symbols(spark, folder)
    lost = graph.resolve(graph.arrivals(spark, folder)).where("outcome = 'unresolved'").select(F.col("src").alias("sid"), F.col("ref").alias("wanted"))
    got = slices.suggestions(lost.join(s.select("sid", "file"), "sid"), s)
    return got.select("file", "wanted", "sid", "near", F.col("place").cast("long").alias("place"))


CALLERS = "SELECT dst, count(*) AS n, string_agg(c, ' ' ORDER BY src) FILTER (i <= 5) AS head FROM (SELECT e.dst, e.src, a.file || ':' || a.name AS c, row_number() OVER (PARTITION BY e.dst ORDER BY e.src) AS i FROM e JOIN s a ON a.sid = e.src) GROUP BY dst"
CALLEES = "SELECT src, count(*) AS n, sum(CASE WHEN a.file = d.file THEN strlen(d.body) ELSE 0 END)::BIGINT AS local_bytes FROM e JOIN s a ON a.sid = e.src JOIN s d ON d.sid = e.dst GROUP BY src"
SLICE = f"SELECT s.sid, coalesce(i.head, '') AS callers, greatest(coalesce(i.n, 0) - 5, 0) AS more_callers, coalesce(o.n, 0) AS callees, coalesce(o.local_bytes, 0) AS local_bytes, coalesce(len(s.external_imports), 0) AS imports, strlen(s.body) AS core FROM s LEFT JOIN ({CALLERS}) i ON i.dst = s.sid LEFT JOIN ({CALLEES}) o ON o.src = s.sid"


def _slices(spark: SparkSession, folder: str) -> DataFrame:
    s = _symbols(spark, folder, "body")
    return slices.slices(s, _edges(spark, folder)).join(s.select("sid", F.octet_length("body").alias("core")), "sid")


@query("slices", Q.with_(["s", "e"], SLICE))
def _(spark, folder):
    d = _slices(spark, folder)
    return d.select("sid", "callers", *[F.col(c).cast("long").alias(c) for c in ("more_callers", "callees", "local_bytes", "imports", "core")])


@query("slice_budget", Q.with_(["s", "e"], f"SELECT sid, trim(CASE WHEN t > 900 AND a > 0 THEN 'locals ' ELSE '' END || CASE WHEN t - a > 900 AND b > 0 THEN 'callees ' ELSE '' END || CASE WHEN t - a - b > 900 AND c > 0 THEN 'callers ' ELSE '' END || CASE WHEN t - a - b - c > 900 AND d > 0 THEN 'imports' ELSE '' END) AS dropped FROM (SELECT *, core + a + b + c + d AS t FROM (SELECT sid, core, local_bytes AS a, callees * 40 AS b, strlen(callers) AS c, imports * 12 AS d FROM ({SLICE})))"))
def _(spark, folder):
    """Which parts of each slice go first when it has to fit 900 bytes."""
    d = _slices(spark, folder)
    parts = [("locals", F.col("local_bytes")), ("callees", F.col("callees") * 40), ("callers", F.octet_length("callers")), ("imports", F.col("imports") * 12)]
    return d.select("sid", slices.fitted(F.col("core"), parts, 900).alias("dropped"))


# -- texts
@query("doc_lines", f"SELECT doc_id, len({Q.lines('text')}) AS lines, coalesce(list_max(list_transform({Q.lines('text')}, lambda x: strlen(x))), 0) AS longest FROM documents")
def _(spark, folder):
    x = C.lines("text")
    return table(spark, folder, "documents").select("doc_id", F.size(x).cast("long").alias("lines"), F.coalesce(F.array_max(F.transform(x, F.octet_length)), F.lit(0)).cast("long").alias("longest"))


@query("token_estimate", Q.with_(["s"], f"SELECT sid, CAST(ceil(strlen(body) / (CASE WHEN {Q.ext('file')} IN ('rs', 'go') THEN 3 WHEN {Q.ext('file')} = 'py' THEN 5 ELSE 4 END)::DOUBLE) AS BIGINT) AS tokens FROM s"))
def _(spark, folder):
    return _symbols(spark, folder, "body").select("sid", C.token_estimate("body", "file").cast("long").alias("tokens"))


@query("truncated_bodies", Q.with_(["f"], f"SELECT file_id, md5(CASE WHEN n <= 250 THEN content ELSE array_to_string(l[1:200], chr(10)) || chr(10) || chr(10) || '// ... [' || (n - 230) || ' lines truncated for token efficiency] ...' || chr(10) || chr(10) || array_to_string(l[n - 29:n], chr(10)) END) AS digest FROM (SELECT file_id, content, {Q.lines('content')} AS l, len({Q.lines('content')}) AS n FROM f)"))
def _(spark, folder):
    f = _files(spark, folder, "content").withColumn("span", F.size(C.lines("content")))
    return f.select("file_id", F.md5(C.truncated_body("content", "span")).alias("digest"))


@query("budget_cut", f"SELECT doc_id, len(list_filter(range(1, len(l) + 1), lambda i: list_sum(list_transform(l[1:i], lambda x: strlen(x) + 1)) <= 2000)) AS kept, len(l) AS lines FROM (SELECT doc_id, {Q.lines('text')} AS l FROM documents)")
def _(spark, folder):
    return search.budget_cut(table(spark, folder, "documents"), "doc_id", "text", 2000).select("doc_id", F.col("kept").cast("long").alias("kept"), F.col("lines").cast("long").alias("lines"))


@query("compact_signatures", Q.with_(["s"], "SELECT sid, CASE WHEN length(t) > 120 THEN left(t, 120) || '…' ELSE t END AS signature FROM (SELECT sid, trim(regexp_replace(signature, '\\s+', ' ', 'g')) AS t FROM s)"))
def _(spark, folder):
    return _symbols(spark, folder).select("sid", C.compact_signature("signature").alias("signature"))


_IMPORT = search.IMPORT.replace("'", "''")


@query("import_headers", Q.with_(["f"], f"SELECT file_id, generate_subscripts(m, 1) AS place, trim(regexp_replace(unnest(m), '\\s+', ' ', 'g')) AS text FROM (SELECT file_id, regexp_extract_all(array_to_string({Q.lines('content')}[1:400], chr(10)), '{_IMPORT}') AS m FROM f)"))
def _(spark, folder):
    return search.import_header(_files(spark, folder, "content")).select("file_id", F.col("place").cast("long").alias("place"), "text")


# -- ledgers
SECTION = "CASE WHEN contains(h, 'epic') THEN 'epics' WHEN contains(h, 'debt') THEN 'debt' WHEN contains(h, 'vocab') OR contains(h, 'gotcha') THEN 'vocab' ELSE 'other' END"
LEDGER = f"""numbered AS MATERIALIZED (SELECT doc_id, i, l[i] AS text FROM (SELECT doc_id, {Q.lines('text')} AS l, unnest(range(1, len({Q.lines('text')}) + 1)) AS i FROM documents)),
heads AS (SELECT *, starts_with({Q.trim('text')}, '## ') AS is_head, lower(regexp_replace({Q.trim('text')}, '^#+\\s*', '')) AS h FROM numbered),
filled AS MATERIALIZED (SELECT doc_id, i AS line, text, coalesce(last_value(CASE WHEN is_head THEN {SECTION} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i), '') AS section, is_head FROM heads)"""


@query("ledger_sections", f"WITH {LEDGER} SELECT doc_id, section, count(*) AS lines, min(line) AS first_line FROM filled WHERE NOT is_head GROUP BY ALL")
def _(spark, folder):
    rows = ledger.sections(table(spark, folder, "documents"))
    return rows.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("lines"), F.min("line").cast("long").alias("first_line"))


DEBT = """SELECT doc_id, line, CASE WHEN lft > 0 THEN trim(substr(c, 1, lft - 1), ' ') END AS what, CASE WHEN rgt > 0 THEN trim(substr(rest, 1, rgt - 1), ' ') END AS why, CASE WHEN rgt > 0 THEN trim(substr(rest, rgt + 2), ' ') END AS trigger, lft, rgt FROM (
SELECT *, CASE WHEN lft > 0 THEN substr(c, lft + 2) END AS rest, coalesce(instr(substr(c, lft + 2), '->'), 0) AS rgt FROM (SELECT doc_id, line, substr(ltrim(text, ' '), 3) AS c, instr(substr(ltrim(text, ' '), 3), '<-') AS lft FROM filled WHERE (starts_with(ltrim(text, ' '), '- ') OR starts_with(ltrim(text, ' '), '* '))))"""


@query("debt_items", f"WITH {LEDGER} SELECT doc_id, line, what, why, trigger, CASE WHEN lft = 0 THEN 'missing <-' WHEN rgt = 0 THEN 'missing ->' WHEN what = '' THEN 'empty what' WHEN why = '' THEN 'empty why' WHEN trigger = '' THEN 'empty trigger' END AS reason FROM ({DEBT})")
def _(spark, folder):
    """The bulleted lines of all documents read as debt lines, with the rule that a line breaks."""
    rows = search.text_lines(table(spark, folder, "documents"), "doc_id", "text")
    t = F.ltrim("text")
    rows = rows.where(t.startswith("- ") | t.startswith("* "))
    return rows.select("doc_id", F.col("line").cast("long").alias("line"), *ledger.debt_fields("text"))


@query("ledger_lint", f"WITH {LEDGER} SELECT doc_id, line, CASE WHEN contains(text, '~~') THEN 'strikethrough' WHEN contains(text, '[x]') OR contains(text, '[X]') THEN 'completed checkbox' WHEN contains(text, '[ ]') THEN 'checkbox' WHEN NOT (starts_with(ltrim(text, ' '), '- ') OR starts_with(ltrim(text, ' '), '* ')) THEN 'missing bullet' WHEN NOT contains(substr(ltrim(text, ' '), 3), '<-') THEN 'missing <-' ELSE 'other' END AS reason FROM filled WHERE NOT is_head AND section <> '' AND {Q.trim('text')} <> '' AND NOT starts_with({Q.trim('text')}, '#')")
def _(spark, folder):
    """Every line below a heading, judged as a debt line: the corpus has few headings that name debt."""
    rows = ledger.sections(table(spark, folder, "documents")).where((F.col("section") != "") & (F.trim("text") != "") & ~F.trim("text").startswith("#"))
    reason = ledger.lint_reason("text")
    few = ("strikethrough", "completed checkbox", "checkbox", "missing bullet", "missing <-")
    return rows.select("doc_id", F.col("line").cast("long").alias("line"), F.when(reason.isin(*few), reason).otherwise("other").alias("reason"))


@query("lint_totals", f"WITH {LEDGER} SELECT doc_id, count(*) AS lines, count(*) FILTER (reason <> 'other') AS refused, count(DISTINCT section) AS sections FROM (SELECT doc_id, section, CASE WHEN contains(text, '~~') THEN 'strikethrough' WHEN contains(text, '[x]') OR contains(text, '[X]') THEN 'completed checkbox' WHEN contains(text, '[ ]') THEN 'checkbox' WHEN NOT (starts_with(ltrim(text, ' '), '- ') OR starts_with(ltrim(text, ' '), '* ')) THEN 'missing bullet' WHEN NOT contains(substr(ltrim(text, ' '), 3), '<-') THEN 'missing <-' ELSE 'other' END AS reason FROM filled WHERE NOT is_head AND section <> '' AND {Q.trim('text')} <> '' AND NOT starts_with({Q.trim('text')}, '#')) GROUP BY doc_id")
def _(spark, folder):
    """Of each ledger the lines that lint judges, those it refuses before it looks for `->`, and the sections."""
    rows = ledger.sections(table(spark, folder, "documents")).where((F.col("section") != "") & (F.trim("text") != "") & ~F.trim("text").startswith("#"))
    few = ("strikethrough", "completed checkbox", "checkbox", "missing bullet", "missing <-")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(ledger.lint_reason("text").isin(*few)).alias("refused"), F.countDistinct("section").alias("sections"))


@query("ledger_resolved", f"WITH {LEDGER} SELECT doc_id, count(*) FILTER (NOT coalesce(gone, false)) AS lines, count(*) FILTER (gone) AS resolved FROM (SELECT doc_id, NOT is_head AND section = 'debt' AND regexp_matches(ltrim(text, ' '), '^[-*] ') AND contains(lower(text), 'the') AS gone FROM filled) GROUP BY doc_id")
def _(spark, folder):
    """Lines left of each ledger when the debts that hold a word are resolved."""
    d = table(spark, folder, "documents")
    left = ledger.resolved(d, "the").select("doc_id", F.col("text").alias("left"))
    n = F.size(C.lines("text"))
    m = F.when(F.col("left") == "", 0).otherwise(F.size(F.split("left", "\n", -1)))
    return d.where(n > 0).join(left, "doc_id").select("doc_id", m.cast("long").alias("lines"), (n - m).cast("long").alias("resolved"))


QUOTED, QUOTED_MORE = r'"[^"\\]*(?:\\.[^"\\]*)*"|`[^`\\]*(?:\\.[^`\\]*)*`', r"|''[^''\\]*(?:\\.[^''\\]*)*''"
MARKERS = f"""marked AS MATERIALIZED (SELECT file_id, repo_id, line, substr(t, 1) AS c FROM (SELECT file_id, repo_id, line, trim(regexp_replace(regexp_extract(plain, '(?i)(?:#|//|/\\*|--) todo:(.*)$', 1), '\\*/.*$', ''), ' ') AS t, regexp_matches(plain, '(?i)(?:#|//|/\\*|--) todo:(.*)$') AS hit FROM (
SELECT file_id, repo_id, i AS line, regexp_replace(l[i], CASE WHEN ext = 'rs' THEN '{QUOTED}' ELSE '{QUOTED}{QUOTED_MORE}' END, '', 'g') AS plain FROM (SELECT file_id, repo_id, {Q.ext('path')} AS ext, {Q.lines('content')} AS l, unnest(range(1, len({Q.lines('content')}) + 1)) AS i FROM f WHERE contains(lower(content), 'todo:')))) WHERE hit),
item AS MATERIALIZED (SELECT file_id, repo_id, line, CASE WHEN lft > 0 THEN trim(substr(c, 1, lft - 1), ' ') END AS what, CASE WHEN rgt > 0 THEN trim(substr(rest, 1, rgt - 1), ' ') END AS why, CASE WHEN rgt > 0 THEN trim(substr(rest, rgt + 2), ' ') END AS trigger, lft, rgt FROM (SELECT *, CASE WHEN lft > 0 THEN substr(c, lft + 2) END AS rest, coalesce(instr(substr(c, lft + 2), '->'), 0) AS rgt FROM (SELECT *, instr(c, '<-') AS lft FROM marked))),
marker AS MATERIALIZED (SELECT *, CASE WHEN lft = 0 THEN 'missing <-' WHEN rgt = 0 THEN 'missing ->' WHEN what = '' THEN 'empty what' WHEN why = '' THEN 'empty why' WHEN trigger = '' THEN 'empty trigger' END AS reason FROM item)"""


@query("marker_totals", Q.with_(["f"], "SELECT repo_id, count(DISTINCT file_id) AS files, count(*) AS markers, count(*) FILTER (reason IS NULL) AS valid FROM marker GROUP BY repo_id", MARKERS))
def _(spark, folder):
    f = _files(spark, folder, "repo_id", "path", "content")
    rows = ledger.markers(f, "todo").join(f.select("file_id", "repo_id"), "file_id")
    return rows.groupBy("repo_id").agg(F.countDistinct("file_id").alias("files"), F.count(F.lit(1)).alias("markers"), F.count_if(F.col("reason").isNull()).alias("valid"))


@query("dump", f"WITH {LEDGER}, " + Q.with_(["s"], """SELECT repo_id, 'ledger' AS part, place, text FROM kept UNION ALL SELECT repo_id, 'map', place, text FROM (SELECT *, sum(strlen(text) + 1) OVER (PARTITION BY repo_id ORDER BY place) AS sum FROM (SELECT s.repo_id, row_number() OVER (PARTITION BY s.repo_id ORDER BY coalesce(centrality, 0) DESC, sid) AS place, file || ': ' || kind || ' ' || name AS text, 5850 - coalesce(spent, 0) AS rest FROM s LEFT JOIN (SELECT repo_id, max(sum) AS spent FROM kept GROUP BY repo_id) k ON k.repo_id = s.repo_id) WHERE place <= greatest(3, least(40, floor(rest / 100)))) WHERE sum <= rest""",
"kept AS MATERIALIZED (SELECT * FROM (SELECT *, sum(strlen(text) + 1) OVER (PARTITION BY repo_id ORDER BY place) AS sum FROM (SELECT d.repo_id, row_number() OVER (PARTITION BY d.repo_id ORDER BY d.doc_id, line) AS place, filled.text FROM filled JOIN documents d ON d.doc_id = filled.doc_id WHERE d.doc_type = 'ledger' AND NOT is_head)) WHERE sum <= 5850)").removeprefix("WITH "))
def _(spark, folder):
    """The ledgers of each repository and its map, packed into the bytes of 1,500 tokens."""
    d = table(spark, folder, "documents").where("doc_type = 'ledger'")
    lines = ledger.sections(d).join(d.select("doc_id", "repo_id"), "doc_id").select("repo_id", "doc_id", "line", "text")
    out = health.dump(lines, _symbols(spark, folder))
    return out.select("repo_id", "part", F.col("place").cast("long").alias("place"), "text")


@query("comment_markers", Q.with_(["f"], "SELECT file_id, line, what, why, trigger, reason FROM marker", MARKERS))
def _(spark, folder):
    return ledger.markers(table(spark, folder, "files").select("file_id", "path", "content").dropDuplicates(["file_id"]), "todo")


# -- predicates, paths, nested values
@query("path_functions", Q.with_(["f"], f"SELECT file_id, {Q.folder('path')} AS dir, {Q.base('path')} AS base, {Q.stem('path')} AS stem, {Q.ext('path')} AS extension FROM f"))
def _(spark, folder):
    return _files(spark, folder, "path").select("file_id", C.parent_dir("path").alias("dir"), C.base_name("path").alias("base"), C.stem("path").alias("stem"), C.extension("path").alias("extension"))


@query("test_predicate", Q.with_(["s"], f"SELECT sid, {Q.is_test('file', 'name')} AS is_test FROM s"))
def _(spark, folder):
    return _symbols(spark, folder).select("sid", C.is_test().alias("is_test"))


@query("framework_entries", Q.with_(["s"], f"SELECT sid, name FROM s WHERE {Q.is_framework('file', 'name', 'kind', 'signature')}"))
def _(spark, folder):
    return _symbols(spark, folder).where(C.is_framework_entry()).select("sid", "name")


@query("scope_predicates", Q.with_(["f"], "SELECT file_id, (path = 'src' OR starts_with(path, 'src/') OR list_contains(string_split(path, '/'), 'src')) AS map, (path = 'monolith/src' OR starts_with(path, 'monolith/src/')) AS find, (path = 'monolith/lib' OR starts_with(path, 'monolith/lib/')) AS missing FROM f"))
def _(spark, folder):
    return _files(spark, folder, "path").select("file_id", C.in_scope_map("path", "src").alias("map"), C.in_scope_find("path", "./monolith//src").alias("find"), C.in_scope_missing("path", " ./monolith/lib/").alias("missing"))


@query("coordinates", Q.with_(["s"], "SELECT sid, file || ':' || name AS coordinate, file || ':#L' || start_line || '-' || coalesce(end_line, start_line) AS lines FROM s"))
def _(spark, folder):
    return _symbols(spark, folder).select("sid", C.coordinate().alias("coordinate"), C.line_coordinate().alias("lines"))


@query("ext_histogram", Q.with_(["f"], f"SELECT {Q.ext('path')} AS extension, count(*) AS files FROM f GROUP BY ALL"))
def _(spark, folder):
    return store.extension_histogram(_files(spark, folder, "path"))


@query("coverage", Q.with_(["f", "s"], "SELECT f.repo_id, count(*) AS files, count(x.file_id) AS indexed, CAST(floor(count(x.file_id) * 100 / count(*)) AS BIGINT) AS percent FROM f LEFT JOIN (SELECT DISTINCT file_id FROM s) x ON x.file_id = f.file_id GROUP BY f.repo_id"))
def _(spark, folder):
    have = table(spark, folder, "symbols").select("file_id", F.lit(1).alias("one")).distinct()
    by = _files(spark, folder, "repo_id").join(have, "file_id", "left").groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"), F.count("one").alias("indexed"))
    return by.withColumn("percent", C.percent("indexed", "files"))


@query("call_multiplicity", Q.with_(["s"], "SELECT sid, coalesce(list_sum(map_values(call_counts)), 0)::BIGINT AS calls, len(map_keys(call_counts)) AS names, coalesce(array_to_string(list_sort(list_filter(map_keys(call_counts), lambda k: call_counts[k] > 1)), ' '), '') AS repeated FROM s"))
def _(spark, folder):
    m = F.col("call_counts")
    return _symbols(spark, folder).select("sid", F.coalesce(F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).alias("calls"), F.size(m).cast("long").alias("names"), F.array_join(F.sort_array(F.map_keys(F.map_filter(m, lambda k, v: v > 1))), " ").alias("repeated"))


@query("array_functions", Q.with_(["s"], "SELECT sid, len(list_filter(calls, lambda x: NOT list_contains(member_calls, x))) AS free_calls, list_contains(external_imports, 'log') AS logs, len(list_distinct(coalesce(mentions, []))) AS mentioned FROM s"))
def _(spark, folder):
    return _symbols(spark, folder).select("sid", F.size(F.filter("calls", lambda x: ~F.array_contains("member_calls", x))).cast("long").alias("free_calls"), F.array_contains("external_imports", "log").alias("logs"), F.size(F.array_distinct(F.coalesce("mentions", F.array().cast("array<string>")))).cast("long").alias("mentioned"))


@query("json_roundtrip", Q.with_(["s"], "SELECT sid, len(calls) AS calls, coalesce(array_to_string(calls, ','), '') AS joined FROM s"))
def _(spark, folder):
    """The calls of each symbol through JSON and back."""
    back = F.from_json(F.to_json("calls"), "array<string>")
    return _symbols(spark, folder).select("sid", F.size(back).cast("long").alias("calls"), F.array_join(back, ",").alias("joined"))


# -- extraction and hashes
@query("extract_symbols")
def _(spark, folder):
    found = extract.declarations(_files(spark, folder, "path", "content"))
    one = lambda c: F.array_join(F.sort_array(c), " ").alias(c)
    repeated = F.array_join(F.sort_array(F.map_keys(F.map_filter("call_counts", lambda k, v: v > 1))), " ")
    return found.select("file_id", "kind", "name", "start_line", "end_line", "signature", one("calls"), one("member_calls"), one("mentions"), repeated.alias("repeated"))


@query("extract_agreement")
def _(spark, folder):
    """By kind: how many symbols of the table extraction finds under their full name at the same first and last line, and
    how many of their calls and member calls it finds there."""
    mine = extract.declarations(_files(spark, folder, "path", "content")).select("file_id", "name", "start_line", F.col("end_line").alias("stop"), F.col("calls").alias("c"), F.col("member_calls").alias("m"))
    s = _symbols(spark, folder).select("sid", "kind", "file_id", "name", "start_line", "end_line", "calls", "member_calls")
    both = s.join(mine, ["file_id", "name", "start_line"], "left")
    hit = F.col("stop").isNotNull() & F.coalesce(F.col("end_line") == F.col("stop"), F.lit(True))
    common = lambda a, b: F.when(hit, F.size(F.array_intersect(a, b))).otherwise(0)
    best = both.groupBy("sid", "kind").agg(F.max(hit.cast("int")).alias("hit"), F.max(F.size("calls")).alias("calls"), F.max(common("calls", "c")).alias("c"), F.max(F.size("member_calls")).alias("members"), F.max(common("member_calls", "m")).alias("m"))
    return best.groupBy("kind").agg(F.count(F.lit(1)).alias("symbols"), F.sum("hit").alias("found"), F.sum("calls").alias("calls"), F.sum("c").alias("calls_found"), F.sum("members").alias("member_calls"), F.sum("m").alias("member_calls_found"))


@query("extract_imports")
def _(spark, folder):
    return extract.imports(_files(spark, folder, "path", "content")).withColumn("hint", extract.module_hint("spec"))


@query("import_agreement")
def _(spark, folder):
    """By language: the packages that the symbols table has of a file, and how many of them its import statements name."""
    got = extract.imports(_files(spark, folder, "path", "content"))
    words = F.split(F.concat_ws("/", "spec", "name", "alias"), "[/:.]+")
    got = got.groupBy("file_id", "lang").agg(F.array_distinct(F.flatten(F.collect_list(words))).alias("words"))
    have = _symbols(spark, folder).select("file_id", F.explode("external_imports").alias("package")).distinct()
    both = have.join(got, "file_id", "left")
    return both.groupBy("lang").agg(F.count(F.lit(1)).alias("packages"), F.count_if(F.array_contains("words", F.col("package"))).alias("found"))


@query("first_party_imports")
def _(spark, folder):
    """By language: the imports that stay within the workspace: relative ones, those of the own crate, and of packages that
    are named like a repository."""
    got = extract.imports(_files(spark, folder, "path", "content"))
    patterns = spark.createDataFrame([("./", "", True), ("../", "", True), (".", "", True), ("crate::", "", True)], "prefix string, suffix string, wildcard boolean")
    packages = table(spark, folder, "repos").select(F.col("repo_name").alias("package")).where("package IS NOT NULL")
    mine = search.first_party(got, patterns, packages)
    return got.groupBy("lang").agg(F.count(F.lit(1)).alias("imports")).join(mine.groupBy("lang").agg(F.count(F.lit(1)).alias("first_party")), "lang", "left").fillna(0, ["first_party"])


@query("extracted_mentions")
def _(spark, folder):
    """Who mentions the busiest symbol of each repository, of the symbols extracted from the files, by file, line and name."""
    s = written(extract.symbols_of(_files(spark, folder, "repo_id", "path", "content")))
    named = s.select("repo_id", "sid", F.explode(F.array_distinct(F.array("name", C.mention_name("name")))).alias("word"))
    often = graph.mentions(s).select("repo_id", "word").join(named.withColumnRenamed("sid", "target"), ["repo_id", "word"]).groupBy("repo_id", "target").agg(F.count(F.lit(1)).alias("n"))
    top = often.groupBy("repo_id").agg(F.max_by("target", F.struct("n", "target")).alias("sid"))
    found = graph.mentioners(s, s.join(top.select("sid"), "sid", "left_semi")).join(s.select("sid", "file", "start_line", "name"), "sid")
    order = Window.partitionBy("target").orderBy("file", "start_line", "name", "sid")
    return found.select("repo_id", "target", "sid", "file", "start_line", F.row_number().over(order).alias("place"))


@query("extracted_graph")
def _(spark, folder):
    """The outcomes of all references of the graph that is built from the files alone."""
    s = written(extract.symbols_of(_files(spark, folder, "repo_id", "path", "content")))
    return graph.resolve(s).groupBy("repo_id", "outcome").agg(F.count(F.lit(1)).alias("refs"), F.count("dst").alias("edges"))


@query("fnv_hash")
def _(spark, folder):
    return store.fnv1a(_files(spark, folder, "content"), "file_id", "content")
