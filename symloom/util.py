"""Reading tables, removing redelivered rows and cutting lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application: their Python need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        here = Path(__file__).resolve().parent
        at = Path(tempfile.mkdtemp(prefix="symloom-")) / "symloom.zip"
        with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        sc.addPyFile(str(at))
        _shipped.add(sc.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset a local master takes a temporary folder of this machine;
    on a cluster, whose executors would each write to their own disk, it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "symloom-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/symloom-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows, read from a table written to the shared folder: later jobs read it instead of computing it again,
    only the columns they need, and an executor that is lost takes nothing along."""
    at = shared_folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def bucketed(df: DataFrame, key: str, n: int) -> DataFrame:
    """The same rows as a table of n buckets in the shared folder: joins and aggregates on key with tables of as many
    buckets need no shuffle. df should be partitioned by key already."""
    spark, at = df.sparkSession, shared_folder(df.sparkSession)
    name = "symloom_" + uuid.uuid4().hex
    df.write.bucketBy(n, key).option("path", at).saveAsTable(name)
    return spark.table(name)


def discard(df: DataFrame) -> None:
    """Delete the table that written() made of df; only when nothing that is still to run reads it."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if folder.rpartition("/")[2].startswith("symloom-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mix(*columns: Column) -> Column:
    """A number that is spread evenly over the rows, for salting."""
    return F.abs(F.xxhash64(*columns) % F.lit(1 << 40))


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """df in at least as many partitions as there are cores; unchanged where it has them already."""
    ship(df.sparkSession)
    n = least or df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)
