"""The call graph: symbols, references, the tiered resolver and the neighbours of a symbol.

A workspace is a repository: names are looked up within `repo_id`. No reference is guessed: where more than one candidate
remains on the tier that decides, the reference is ambiguous. Candidates are never enumerated: counts and the two extreme
ids of each (name), (name, folder) and (name, file) tell the only candidate, if there is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions import columns as C
from symloom.util import table

SYMBOL_COLUMNS = ("sid", "file_id", "repo_id", "file", "name", "kind", "start_line", "end_line", "signature", "centrality", "calls", "member_calls", "mentions", "external_imports", "call_counts", "is_test")


def symbols(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """The symbols once each; bodies only if asked for."""
    df = table(spark, folder, "symbols").withColumnRenamed("symbol_id", "sid").where("sid IS NOT NULL")
    return df.select(*SYMBOL_COLUMNS, *more).dropDuplicates(["sid"])


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """The symbols as often as they arrived, for operators that count equal rows once themselves: these shuffle and hash the
    few columns they need, where symbols() has to sort whole rows."""
    df = table(spark, folder, "symbols").withColumnRenamed("symbol_id", "sid").where("sid IS NOT NULL")
    return df.select(*SYMBOL_COLUMNS)


def name_index(syms: DataFrame) -> DataFrame:
    """repo_id, lookup, sid, file, dir of each callable symbol under each of its names; equal rows once."""
    rows = syms.where(C.is_callable() & F.col("name").isNotNull())
    return rows.select("repo_id", F.explode(C.index_names("name")).alias("lookup"), "sid", "file", C.parent_dir("file").alias("dir")).distinct()


def references(syms: DataFrame) -> DataFrame:
    """One row per symbol and called name: src, ref, hint, lookup, n, is_member, is_external, is_test and where it stands;
    equal rows count once."""
    rows = syms.select(F.col("sid").alias("src"), "repo_id", "file", C.parent_dir("file").alias("dir"), F.col("name").alias("src_name"), C.is_test().alias("is_test"), C.is_callable().alias("callable"), "member_calls", "external_imports", "call_counts", F.explode("calls").alias("ref"))
    hinted = F.col("ref").contains(":") & ~F.col("ref").contains("::")
    listed = lambda c: F.coalesce(F.array_contains(c, F.col("ref")), F.lit(False))
    return rows.where("ref IS NOT NULL").select(
        "src", "repo_id", "file", "dir", "src_name", "is_test", "callable", "ref",
        F.when(hinted, F.substring_index("ref", ":", 1)).alias("hint"),
        F.when(hinted, F.expr("substr(ref, instr(ref, ':') + 1)")).otherwise(F.col("ref")).alias("lookup"),
        F.coalesce(F.try_element_at("call_counts", F.col("ref")), F.lit(1)).alias("n"),
        listed("member_calls").alias("is_member"), listed("external_imports").alias("is_external"),
    ).distinct()


def _only(n: str, low: str, high: str, mine: Column) -> tuple[Column, Column]:
    """(how many candidates besides the caller itself, the one of them if it is one)."""
    count = F.coalesce(F.col(n), F.lit(0)) - mine
    return count, F.when(count == 1, F.when(F.col(low) == F.col("src"), F.col(high)).otherwise(F.col(low)))


def _hint_matches(file: Column, hint: Column) -> Column:
    h = F.regexp_replace(F.regexp_replace(hint, r"^(\./)*(\.\./)*", ""), r"^/+|/+$", "")
    plain = F.regexp_replace(F.regexp_replace(file, r"\.[^./]*$", ""), r"/(index|mod)$", "")
    return (h != "") & ((plain == h) | C.component_suffix(plain, h) | C.component_suffix(file, h))


def resolve(syms: DataFrame) -> DataFrame:
    """Every reference with its outcome (external, unresolved, hinted, same_file, self, member, same_dir, generic, global or
    ambiguous_*), the symbol it resolves to and its weight.

    A null name is found by none; a null list calls nothing. Rows of one sid are taken to be one symbol."""
    refs, index = references(syms), name_index(syms)
    extremes = lambda by, p: index.groupBy(*by).agg(F.count(F.lit(1)).alias(p + "n"), F.min("sid").alias(p + "low"), F.max("sid").alias(p + "high"))
    out = refs.join(extremes(["repo_id", "lookup"], "g"), ["repo_id", "lookup"], "left")
    out = out.join(extremes(["repo_id", "lookup", "dir"], "d"), ["repo_id", "lookup", "dir"], "left")
    out = out.join(extremes(["repo_id", "lookup", "file"], "f"), ["repo_id", "lookup", "file"], "left")
    mine = F.when(F.col("callable") & F.array_contains(C.index_names("src_name"), F.col("lookup")), 1).otherwise(0)
    in_file, file_one = _only("fn", "flow", "fhigh", mine)
    in_dir, dir_one = _only("dn", "dlow", "dhigh", mine)
    anywhere, global_one = _only("gn", "glow", "ghigh", mine)
    generic = F.col("lookup").isin("new", "default")
    itself = (mine == 1) & (F.col("src_name") == F.col("ref"))
    # the rare references with a module hint look at their candidates one by one
    hinted = refs.where("hint IS NOT NULL AND NOT is_external").select("src", "ref", "repo_id", "lookup", "hint", F.col("file").alias("at"))
    far = hinted.join(index, ["repo_id", "lookup"]).where("file <> at").groupBy("src", "ref").agg(F.count(F.lit(1)).alias("hn"), F.min("sid").alias("hone"), F.count_if(_hint_matches(F.col("file"), F.col("hint"))).alias("hm"), F.min(F.when(_hint_matches(F.col("file"), F.col("hint")), F.col("sid"))).alias("hmone"))
    out = out.join(far, ["src", "ref"], "left")
    outcome = (
        F.when(F.col("is_external"), "external").when(F.coalesce(F.col("gn"), F.lit(0)) == 0, "unresolved")
        .when(F.col("hint").isNotNull(), F.when((F.col("hm") == 1) | ((F.col("hm") == 0) & (F.col("hn") == 1)), "hinted").otherwise("ambiguous_hint"))
        .when(itself, "self").when(in_file == 1, "same_file").when(in_file > 1, "ambiguous_file")
        .when(mine == 1, "self")
        .when(F.col("is_member"), "member")
        .when(~generic & (in_dir == 1), "same_dir").when(~generic & (in_dir > 1), "ambiguous_dir").when(generic, "generic")
        .when(anywhere == 1, "global").otherwise("ambiguous_global")
    )
    out = out.withColumn("outcome", outcome)
    dst = F.when(F.col("outcome") == "hinted", F.when(F.col("hm") == 1, F.col("hmone")).otherwise(F.col("hone"))).when(F.col("outcome") == "same_file", file_one).when(F.col("outcome") == "same_dir", dir_one).when(F.col("outcome") == "global", global_one)
    weight = C.multiplicity_weight("n") * F.when(F.col("is_test"), 0.25).otherwise(1.0)
    return out.select("repo_id", "src", "ref", "outcome", dst.alias("dst"), weight.alias("w"))


def edges(resolved: DataFrame) -> DataFrame:
    """repo_id, src, dst, w: weights of equal pairs summed."""
    return resolved.where("dst IS NOT NULL").groupBy("repo_id", "src", "dst").agg(F.sum("w").alias("w"))


def call_edges(syms: DataFrame) -> DataFrame:
    return edges(resolve(syms))


def fan_in(e: DataFrame) -> DataFrame:
    return e.groupBy("repo_id", F.col("dst").alias("sid")).agg(F.count(F.lit(1)).alias("fan_in"))


def busiest(e: DataFrame) -> DataFrame:
    """repo_id, sid: of each repository the symbol with most callers, the least sid among equals."""
    top = fan_in(e).groupBy("repo_id").agg(F.max(F.struct("fan_in", (-F.col("sid")).alias("m"))).alias("t"))
    return top.select("repo_id", (-F.col("t.m")).alias("sid"))


def mentions(syms: DataFrame) -> DataFrame:
    """repo_id, word, sid: the names a symbol mentions without calling."""
    return syms.select("repo_id", F.explode("mentions").alias("word"), "sid").where("word IS NOT NULL").distinct()


def mentioners(syms: DataFrame, targets: DataFrame) -> DataFrame:
    """target, sid of the symbols that mention a target by its name or short name, itself excepted."""
    words = targets.select("repo_id", F.col("sid").alias("target"), F.explode(F.array_distinct(F.array("name", C.mention_name("name")))).alias("word"))
    return mentions(syms).join(words, ["repo_id", "word"]).where("sid <> target").select("repo_id", "target", "sid").distinct()


def with_constructors(syms: DataFrame, targets: DataFrame) -> DataFrame:
    """The targets, and of classes and structs among them the constructors in the same file."""
    t = targets.select("repo_id", F.col("sid").alias("target"), "name", "kind", "file")
    folded = t.where(F.col("kind").isin("class", "struct")).select("repo_id", "target", "file", F.explode(F.array(F.concat("name", F.lit("::constructor")), F.concat("name", F.lit("::new")))).alias("name"))
    found = syms.select("repo_id", "file", "name", "sid").join(folded, ["repo_id", "file", "name"]).select("repo_id", "target", "sid")
    return t.select("repo_id", "target", F.col("target").alias("sid")).unionByName(found).distinct()
