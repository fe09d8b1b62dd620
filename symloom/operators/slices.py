"""What belongs to a symbol: its callers, callees, local helpers and imports, cut to a budget; names that come close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions import columns as C


def slices(syms: DataFrame, e: DataFrame, shown: int = 5) -> DataFrame:
    """sid, callers (the first `shown` coordinates by sid), more_callers, callees, local_bytes, imports of every symbol.

    A caller list is cut while it is gathered: only its first sids are kept, whatever their number."""
    names = syms.select("sid", C.coordinate().alias("coordinate"))
    first = Window.partitionBy("dst").orderBy("src")
    head = e.select("dst", "src", F.row_number().over(first).alias("i")).where(F.col("i") <= shown).join(names.withColumnRenamed("sid", "src"), "src")
    head = head.groupBy(F.col("dst").alias("sid")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "coordinate"))), lambda x: x["coordinate"]), " ").alias("callers"))
    into = e.groupBy(F.col("dst").alias("sid")).agg(F.count(F.lit(1)).alias("n_in"))
    sides = syms.select("sid", "file", F.octet_length("body").alias("bytes"))
    out = e.join(sides.select(F.col("sid").alias("src"), F.col("file").alias("at")), "src").join(sides.withColumnRenamed("sid", "dst"), "dst")
    out = out.groupBy(F.col("src").alias("sid")).agg(F.count(F.lit(1)).alias("callees"), F.sum(F.when(F.col("at") == F.col("file"), F.col("bytes")).otherwise(0)).alias("local_bytes"))
    rows = syms.select("sid", F.coalesce(F.size("external_imports"), F.lit(0)).alias("imports")).join(head, "sid", "left").join(into, "sid", "left").join(out, "sid", "left")
    return rows.select("sid", F.coalesce("callers", F.lit("")).alias("callers"), F.greatest(F.coalesce("n_in", F.lit(0)) - shown, F.lit(0)).alias("more_callers"), F.coalesce("callees", F.lit(0)).alias("callees"), F.coalesce("local_bytes", F.lit(0)).alias("local_bytes"), "imports")


def fitted(core: Column, parts: list[tuple[str, Column]], budget: int) -> Column:
    """The names of the parts that are dropped, in their order, until what is left fits the budget; the core never is."""
    total = core
    for _, size in parts:
        total = total + size
    dropped, left = [], total
    for name, size in parts:
        dropped.append(F.when((left > budget) & (size > 0), F.lit(name)))
        left = F.when(left > budget, left - size).otherwise(left)
    return F.array_join(F.array_compact(F.array(*dropped)), " ")


def path_suffixes(path: Column | str) -> Column:
    """Every ending of a path at a component, the whole path included."""
    parts = F.split(C.col(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "/"))


def coordinate_index(syms: DataFrame) -> DataFrame:
    """repo_id, coordinate (path ending and name), hits: how many symbols a partly given coordinate names. One symbol: unique;
    several: ambiguous; no row: not found. A symbol is found by each ending of its path, so no pairs are compared."""
    rows = syms.where("name IS NOT NULL").select("repo_id", "sid", "name", F.explode(path_suffixes("file")).alias("suffix"))
    return rows.groupBy("repo_id", F.concat_ws(":", "suffix", "name").alias("coordinate")).agg(F.count(F.lit(1)).alias("hits"), F.min("sid").alias("first_sid"))


def suggestions(misses: DataFrame, syms: DataFrame, most: int = 10) -> DataFrame:
    """For each miss (file, wanted) the symbols of its file: those whose name holds the wanted one or is held by it first,
    then by line; the first `most`."""
    have = syms.select("file", "sid", "start_line", F.lower("name").alias("n"))
    w = F.lower("wanted")
    near = misses.select("file", "wanted").distinct().join(have, "file").withColumn("near", F.col("n").contains(w) | w.contains(F.col("n")))
    order = Window.partitionBy("file", "wanted").orderBy(F.desc("near"), "start_line", "sid")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("file", "wanted", "place", "sid", "near")
