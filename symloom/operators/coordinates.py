"""Coordinates of symbols and lines as people write them, and the symbols they name. Nothing is guessed: of the tiers that
a path can match on, only the first with a hit counts, and several hits stay several."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions import columns as C
from symloom.operators.slices import path_suffixes

TIERS = ("exact", "suffix", "basename", "name")
_LINES = re.compile(r"^(?P<file>.+?)(?::?#L?|:L?)(?P<a>\d+)(?:-L?(?P<b>\d+))?$", re.I)
_NOTE = re.compile(r"\s*\(L\d+(?:-L?\d+)?\)\s*$", re.I)


@dataclass(frozen=True)
class Coordinate:
    """file and name, file and lines, or a bare name."""

    file: str | None = None
    name: str | None = None
    first: int | None = None
    last: int | None = None


def parse(text: str) -> Coordinate:
    """`path:name`, `path:#L3-9`, `path#L3`, `path:3-9`, `name`; a note `(L3-9)` at the end is dropped, a drive letter
    belongs to the path, reversed lines are turned and begin at 1."""
    text = _NOTE.sub("", text.strip()).replace("\\", "/")
    drive = text[:2] if re.match(r"[A-Za-z]:/", text) else ""
    rest = text[len(drive) :]
    if m := _LINES.match(rest):
        a, b = int(m["a"]), int(m["b"] or m["a"])
        return Coordinate(drive + m["file"], None, max(1, min(a, b)), max(1, a, b))
    m = re.match(r"([^:]+):(?!:)(.+)$", rest)
    return Coordinate(drive + m[1], m[2]) if m else Coordinate(name=rest)


def parts(target: Column | str) -> list[Column]:
    """path (null without one), name (null of lines), first, last of a column of coordinates; the forms of parse()."""
    t = F.regexp_replace(F.regexp_replace(F.trim(C.col(target)), r"(?i)\s*\(L\d+(?:-L?\d+)?\)$", ""), r"\\", "/")
    lines = r"(?i)^((?:[A-Za-z]:/)?.+?)(?::?#L?|:L?)(\d+)(?:-L?(\d+))?$"
    named = r"^((?:[A-Za-z]:/)?[^:]+):(?!:)(.+)$"
    is_lines = t.rlike(lines)
    a = F.regexp_extract(t, lines, 2).try_cast("int")
    b = F.coalesce(F.regexp_extract(t, lines, 3).try_cast("int"), a)
    path = F.when(is_lines, F.regexp_extract(t, lines, 1)).when(t.rlike(named), F.regexp_extract(t, named, 1))
    name = F.when(~is_lines, F.when(t.rlike(named), F.regexp_extract(t, named, 2)).otherwise(t))
    one = F.lit(1)
    return [path.alias("path"), name.alias("name"), F.when(is_lines, F.greatest(F.least(a, b), one)).alias("first"), F.when(is_lines, F.greatest(a, b, one)).alias("last")]


def resolve(targets: DataFrame, syms: DataFrame) -> DataFrame:
    """target, tier, status (unique, ambiguous, not_found), hits, place, sid: the symbols that each coordinate names.

    targets: target. A name answers for what it equals or ends behind `::` or `.`; lines for every symbol they overlap. A
    path matches exactly, else where the shorter of both is the end of the longer one by whole components, else by its last
    component; only the first tier with a hit counts. Symbols are found through the endings of their paths and names,
    candidates stand by falling centrality, then sid. Without a hit there is one row with a null sid."""
    wanted = targets.select("target", *parts("target")).where("target IS NOT NULL").distinct()
    rows = syms.where("name IS NOT NULL").select("sid", "file", "centrality", "start_line", F.coalesce("end_line", "start_line").alias("stop"), F.explode(C.index_names("name")).alias("name"))
    by_name = wanted.where("name IS NOT NULL")
    pathed = by_name.where("path IS NOT NULL").withColumn("p", F.regexp_replace("path", r"^(?:\./)+|^/+", ""))
    tier = F.when(F.col("file") == F.col("p"), 0)
    keep = ("target", "tier", "sid", "centrality")
    shorter = pathed.withColumn("key", F.col("p")).join(rows.withColumn("key", F.explode(path_suffixes("file"))), ["name", "key"]).select("target", tier.otherwise(1).alias("tier"), "sid", "centrality")
    longer = pathed.withColumn("key", F.explode(path_suffixes("p"))).join(rows.withColumn("key", F.col("file")), ["name", "key"]).select("target", tier.otherwise(1).alias("tier"), "sid", "centrality")
    based = pathed.withColumn("key", C.base_name("p")).join(rows.withColumn("key", C.base_name("file")), ["name", "key"]).select("target", F.lit(2).alias("tier"), "sid", "centrality")
    bare = by_name.where("path IS NULL").join(rows, "name").select("target", F.lit(3).alias("tier"), "sid", "centrality")
    ranged = wanted.where("first IS NOT NULL").withColumn("key", F.regexp_replace("path", r"^(?:\./)+|^/+", ""))
    spans = syms.select("sid", "file", "centrality", "start_line", F.coalesce("end_line", "start_line").alias("stop"))
    near = ranged.join(spans.withColumn("key", F.explode(path_suffixes("file"))), "key").where("start_line <= last AND stop >= first")
    lined = near.select("target", F.when(F.col("file") == F.col("key"), 0).otherwise(1).alias("tier"), "sid", "centrality")
    every = shorter.unionByName(longer).unionByName(based).unionByName(bare).unionByName(lined).groupBy("target", "sid").agg(F.min("tier").alias("tier"), F.max("centrality").alias("centrality"))
    best = every.groupBy("target").agg(F.min("tier").alias("tier"))
    hits = every.join(best, ["target", "tier"])
    order = Window.partitionBy("target").orderBy(F.desc_nulls_last("centrality"), "sid")
    hits = hits.withColumn("place", F.row_number().over(order)).join(hits.groupBy("target").agg(F.count(F.lit(1)).alias("hits")), "target")
    out = wanted.select("target").join(hits, "target", "left")
    status = F.when(F.col("hits").isNull(), "not_found").when(F.col("hits") == 1, "unique").otherwise("ambiguous")
    label = F.lit(None).cast("string")
    for i, name in enumerate(TIERS):
        label = F.when(F.col("tier") == i, name).otherwise(label)
    return out.select("target", label.alias("tier"), status.alias("status"), F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("place", F.lit(1)).alias("place"), "sid")
