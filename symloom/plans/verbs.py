"""The verbs of the engine over one data folder, each a DataFrame; nothing runs until it is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions import columns as C
from symloom.operators import coordinates, diff, graph, health, ledger, search, slices, traverse
from symloom.sources import extract, store
from symloom.util import table, written


class NotFound(LookupError):
    pass


class Workspace:
    """files, symbols and hunks of a folder of Parquet tables, or of a folder of sources. The call graph is resolved and
    written once; bodies and contents are read only by the verbs that show or search them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.symbols = graph.symbols(spark, folder)
        self.files = table(spark, folder, "files").select("file_id", "repo_id", "path").dropDuplicates(["file_id"])
        self._edges: DataFrame | None = None

    @classmethod
    def of_sources(cls, spark: SparkSession, root: str, tables: str) -> Workspace:
        """Scan and extract the sources below a folder into tables of another one."""
        files = written(store.scan(spark, root).select(F.xxhash64("path").alias("file_id"), F.lit(0).cast("long").alias("repo_id"), "path", "mtime", "hash", "content"))
        files.write.parquet(f"{tables}/files.parquet")
        lines = files.select("file_id", C.lines("content").alias("x"))
        syms = extract.symbols_of(files).join(lines, "file_id")
        body = F.array_join(F.slice("x", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
        syms.withColumn("body", body).drop("x").withColumnRenamed("sid", "symbol_id").write.parquet(f"{tables}/symbols.parquet")
        return cls(spark, tables)

    @property
    def bodies(self) -> DataFrame:
        return graph.symbols(self.spark, self.folder, "body")

    @property
    def contents(self) -> DataFrame:
        return table(self.spark, self.folder, "files").select("file_id", "repo_id", "path", "content").dropDuplicates(["file_id"])

    @property
    def edges(self) -> DataFrame:
        if self._edges is None:
            self._edges = written(graph.call_edges(graph.arrivals(self.spark, self.folder)))
        return self._edges

    def resolve(self, *targets: str) -> DataFrame:
        """target, tier, status, hits, place, sid of coordinates such as `pkg/mod.rs:run`, `mod.rs:#L3-9` or `run`."""
        return coordinates.resolve(self.spark.createDataFrame([(t,) for t in targets], "target string"), self.symbols)

    def target(self, coordinate: str) -> DataFrame:
        """All symbols that a coordinate names on its first tier with a hit."""
        return self.symbols.join(self.resolve(coordinate).where("sid IS NOT NULL").select("sid"), "sid", "left_semi")

    def up(self, coordinate: str) -> DataFrame:
        """sid, tier: callers of the target and its constructors, then those that only mention it."""
        t = self.target(coordinate)
        seeds = graph.with_constructors(self.symbols, t).select(F.col("sid").alias("dst"))
        calls = self.edges.join(seeds, "dst").select(F.col("src").alias("sid")).distinct()
        weak = graph.mentioners(self.symbols, t).select("sid").distinct().join(calls, "sid", "left_anti")
        return calls.withColumn("tier", F.lit("call")).unionByName(weak.withColumn("tier", F.lit("mention")))

    def down(self, coordinate: str) -> DataFrame:
        return self.edges.join(self.target(coordinate).select(F.col("sid").alias("src")), "src").select(F.col("dst").alias("sid")).distinct()

    def uses(self, coordinate: str) -> DataFrame:
        return graph.mentioners(self.symbols, self.target(coordinate)).select("sid").distinct()

    def blast(self, coordinate: str, depth: int = 3, down: bool = False) -> DataFrame:
        """sid, depth of what a change of the target reaches (or, down, of what it reaches). Raises NotFound without a target."""
        t = self.target(coordinate)
        if t.isEmpty():
            raise NotFound(coordinate)
        t = t if down else graph.with_constructors(self.symbols, t)
        cone = traverse.reach(self.edges, t.select(F.lit(0).alias("source"), "sid"), depth, up=not down)
        return cone.where("depth > 0").select("sid", "depth")

    def diff(self, depth: int = 3) -> DataFrame:
        touched = written(diff.mutated(self.symbols, diff.hunks(self.spark, self.folder)))
        return diff.affected(self.edges, touched, depth)

    def report(self, depth: int = 3) -> DataFrame:
        """Affected symbols, entry points, suites and test lines of the hunks."""
        touched = written(diff.mutated(self.symbols, diff.hunks(self.spark, self.folder)))
        return diff.report(health.degrees(self.bodies, self.edges), self.edges, touched, depth)

    def search(self, pattern: str) -> DataFrame:
        """what, id, line, sid: symbols, files, and the lines of those terms that neither of them holds."""
        return search.find(self.symbols, self.contents, search.terms(pattern))

    def find(self, pattern: str, scope: str = "", limit: int = 50) -> DataFrame:
        """The best matches of each repository: exact names, then by centrality and length."""
        rows = search.find_symbols(self.symbols, search.terms(pattern)).where(C.in_scope_find("file", scope))
        return health.top_per_repository(rows, limit, F.desc("exact"), F.desc_nulls_last("centrality"), F.asc("bytes"), F.asc("sid")).select("repo_id", "place", "sid")

    def missing(self, pattern: str, defines: str | None = None, scope: str = "") -> DataFrame:
        return search.missing(self.contents.where(C.in_scope_missing("path", scope)), pattern, defines).select("path")

    def map(self, scope: str | None = None, limit: int | None = None) -> DataFrame:
        return health.module_map(self.symbols, scope, limit)

    def rank(self, focus: str | None = None, tolerance: float = 1e-6) -> DataFrame:
        nodes = self.symbols.select("repo_id", "sid", C.is_test().alias("is_test"))
        return traverse.pagerank(nodes, self.edges, tolerance=tolerance, focus=None if focus is None else self.target(focus).select("sid"))

    def doctor(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Totals, dead weight and hubs of each repository."""
        d = health.degrees(self.symbols, self.edges)
        return health.totals(d, self.edges), health.dead_weight(d), health.hubs(d)

    def dump(self, budget: int = 1500) -> DataFrame:
        """The ledgers and the map of each repository, packed into a budget of tokens."""
        d = table(self.spark, self.folder, "documents").where("doc_type = 'ledger'")
        lines = ledger.sections(d).join(d.select("doc_id", "repo_id"), "doc_id").select("repo_id", "doc_id", "line", "text")
        return health.dump(lines, self.symbols, budget)

    def slice(self, coordinate: str) -> DataFrame:
        """The slice of exactly one symbol. Raises NotFound where the coordinate names none or several."""
        t = self.target(coordinate)
        n = t.limit(2).count()
        if n != 1:
            raise NotFound(f"{coordinate}: {'several symbols' if n else 'no symbol'}")
        return slices.slices(self.bodies, self.edges).join(self.bodies.select("sid", "signature", "body").join(t.select("sid"), "sid"), "sid")

    @staticmethod
    def json(df: DataFrame) -> DataFrame:
        return df.select(F.to_json(F.struct("*")).alias("json"))
