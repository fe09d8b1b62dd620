"""Keeping a store in step with arriving files: each micro-batch merges the rows that arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symloom.sources.store import Versioned, latest


def latest_arrivals(files: DataFrame, delay: str = "30 days") -> DataFrame:
    """A stream without redeliveries: of a file_id and hash that arrive again within `delay` only the first row is kept; state
    older than the watermark is dropped."""
    stream = files.withColumn("arrived", F.col("ingested_at").cast("timestamp")).withWatermark("arrived", delay)
    return stream.dropDuplicatesWithinWatermark(["file_id", "hash"]).drop("arrived")


def follow(spark: SparkSession, source: str, store: str, checkpoint: str, schema: str, compact: int = 50) -> StreamingQuery:
    """Merge the Parquet files that appear in `source` into a versioned table, by path; runs until no file is left.

    Each micro-batch adds the newest row of each of its paths; what the table shows of a path is the row with the greatest
    ingested_at of all, so a row that arrives late replaces none that is newer. After `compact` batches the table is
    written as one snapshot."""

    def batch(df: DataFrame, number: int) -> None:
        table = Versioned(df.sparkSession, store)
        table.write(latest(df, "path", ("ingested_at", "hash")), whole=False)
        if number % compact == compact - 1:
            table.write(table.read())

    stream = spark.readStream.schema(schema).parquet(source)
    return latest_arrivals(stream).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
