"""Workspaces as tables: scanning folders, comparing snapshots, and versioned tables that change by a pointer."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions import columns as C
from symloom.util import written

# 64-bit FNV-1a.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
FEW = 16


def scan(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """path (below root), mtime (ns), bytes, and content of the source files under a folder; ignored and hidden folders and
    files that are not UTF-8 are left out. Without content the files are not opened."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace(F.substr(F.col("path"), F.instr(F.col("path"), base) + len(base)), r"^/+", "")
    df = df.withColumn("rel", path).where(C.extension("rel").isin(*C.SOURCE_EXTENSIONS) & ~C.ignored_folder("rel") & ~F.exists(F.split("rel", "/"), lambda x: x.startswith(".")))
    stat = df.select(F.col("rel").alias("path"), (F.unix_micros("modificationTime") * 1000).alias("mtime"), F.col("length").alias("bytes"), *(["content"] if content else []))
    if not content:
        return stat
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return stat.withColumn("content", text).where("content IS NOT NULL").withColumn("hash", F.sha2("content", 256))


def extension_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy(C.extension("path").alias("extension")).agg(F.count(F.lit(1)).alias("files"))


def changes(old: DataFrame, new: DataFrame, key: str = "path", version: str = "hash") -> DataFrame:
    """key, status (new, changed, deleted, same) of a snapshot against the one before; a null version differs from any other
    but a null one."""
    o = old.select(F.col(key), F.col(version).alias("was"), F.lit(True).alias("a"))
    n = new.select(F.col(key), F.col(version).alias("now"), F.lit(True).alias("b"))
    status = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "deleted").when(F.col("was").eqNullSafe(F.col("now")), "same").otherwise("changed")
    return o.join(n, key, "full_outer").select(key, status.alias("status"))


def fnv1a(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, fnv: the 64-bit FNV-1a hash of the UTF-8 bytes in hex; null of a null text. Bytes are folded in order, all texts
    of a batch side by side."""
    import numpy as np
    import pandas as pd

    def run(batches):
        prime, mask = np.uint64(FNV_PRIME), np.uint64(FNV_OFFSET)
        for b in batches:
            raw = [t.encode() if t is not None else b"" for t in b[text]]
            order = np.argsort([-len(r) for r in raw], kind="stable")
            size = np.array([len(raw[i]) for i in order], np.int64)
            data = np.frombuffer(b"".join(raw[i] for i in order), np.uint8)
            start = np.cumsum(size) - size
            h = np.full(len(raw), mask, np.uint64)
            live = len(raw)
            i = 0
            for i in range(int(size.max(initial=0))):
                live = int(np.searchsorted(-size[:live], -i, side="left"))
                if live < FEW:  # a few long texts go faster one by one
                    break
                h[:live] = (h[:live] ^ data[start[:live] + i]) * prime
            else:
                live = 0
            for k in range(live):
                one = int(h[k])
                for byte in raw[order[k]][i:]:
                    one = ((one ^ byte) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
                h[k] = one
            out = np.empty(len(raw), object)
            out[order] = [f"{x:016x}" for x in h.tolist()]
            yield pd.DataFrame({key: b[key], "fnv": [x if t is not None else None for x, t in zip(out, b[text])]})

    return files.select(key, text).mapInPandas(run, f"{key} {files.schema[key].dataType.simpleString()}, fnv string")


class Versioned:
    """A Parquet table under a folder of its own, written in versions: a full snapshot, or a part that adds to it or
    replaces rows of the same key. A version counts once its number stands in the log, which only ever gets rows added, so
    readers never see half a write. `schema_version` in the path makes tables of an older layout invisible."""

    def __init__(self, spark: SparkSession, folder: str, schema_version: int = 1):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/v{schema_version}"

    def _live(self) -> list[int]:
        """The versions that make up the table: the last snapshot and the parts after it."""
        try:
            log = self.spark.read.schema("version long, whole boolean").parquet(f"{self.folder}/log")
        except AnalysisException:
            return []
        last = log.where("whole").agg(F.max("version")).first()[0]
        return sorted(r[0] for r in log.where(F.col("version") >= (last or 0)).select("version").distinct().collect())

    def version(self) -> int | None:
        return max(self._live(), default=None)

    def read(self, key: str = "path", newest: tuple[str, ...] = ("ingested_at", "hash")) -> DataFrame | None:
        """The table; of rows of one key in several versions the one that is greatest by the columns of `newest`."""
        live = self._live()
        if not live:
            return None
        df = self.spark.read.parquet(*[f"{self.folder}/data/version={v}" for v in live])
        return df if len(live) == 1 else latest(df, key, newest)

    def write(self, df: DataFrame, whole: bool = True) -> int:
        """Add a version: a snapshot, or with whole=False a part, whose cost is that of its own rows."""
        v = (self.version() or 0) + 1
        df.write.parquet(f"{self.folder}/data/version={v}")
        self.spark.createDataFrame([(v, whole)], "version long, whole boolean").coalesce(1).write.mode("append").parquet(f"{self.folder}/log")
        return v

    def merge(self, new: DataFrame, key: str = "path", version: str = "hash") -> DataFrame:
        """Make `new` the snapshot; what changed against the last one. Unchanged rows keep what the store has of them."""
        old = self.read(key)
        if old is None:
            self.write(new)
            return new.select(key, F.lit("new").alias("status"))
        status = written(changes(old, new, key, version))
        kept = old.join(status.where("status = 'same'"), key, "left_semi")
        fresh = new.join(status.where("status IN ('new', 'changed')"), key, "left_semi")
        self.write(kept.unionByName(fresh, allowMissingColumns=True))
        return status

    def purge(self) -> None:
        """Delete the versions that are no longer part of the table."""
        live = {f"version={v}" for v in self._live()}
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/data")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for s in fs.listStatus(path) if fs.exists(path) else []:
            if s.getPath().getName() not in live:
                fs.delete(s.getPath(), True)


def latest(df: DataFrame, key: str, newest: tuple[str, ...]) -> DataFrame:
    """One row per key, the greatest by the columns of `newest` that df has."""
    order = [F.col(c) for c in newest if c in df.columns] or [F.lit(1)]
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_r")).select("_r.*")
