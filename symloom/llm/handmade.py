"""Problem 1: files that nobody wrote by hand in their repository.

Copies: files with the same significant lines are one class. The hashes of the lines of all classes form an inverted
index of the lines that several repositories have, with how many classes have each. A class of n lines contained in
another one to the share c has at least one of its n - ceil(c n) + 1 rarest lines in common with it, so only these rare
lines are looked up; no pair that reaches the share is lost. Each class is compared first with the one class that most of
its rare lines point to. Classes so linked form groups, and only pairs of classes in different groups that share a rare
line are compared further: a family of copies needs a number of comparisons in proportion to its size, yet which classes
are connected comes out as if all pairs had been compared. The containment of each compared pair is counted exactly.
A copy is vendored where it or any of those it is connected with shows signs of a foreign project: a folder for
dependencies or a notice of another project.

The other files are judged by their token composition: notices of tools in the first lines, methods stamped from one
shape, minified text, and the share that literal data has.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.util import spread, table, written

LEAST_LINE, LEAST_SHARED, CONTAINED, JUMPS, LEAST_VALUES = 12, 3, 0.6, 3, 150
MARKS = "file_id long, repo_id long, path string, generated boolean, stamped boolean, minified boolean, data boolean, notice boolean, folder boolean, digest binary, lines array<long>"

_HEAD = re.compile(r"^\s*(?://+|#+|/\*+!?|\*+|--+|;+|<!--|\"\"\"|'''|@)\s*(.*?)\s*(?:\*/|-->|\"\"\"|''')?\s*$")
# What tools write about their output is told by kinds of words: a verb of making whose agent or end follows, a warning
# that edits do not last, the file itself as the subject; a line about what people keep by hand is none.
_MARKED = re.compile(r"@generated\b|<auto-?generated\b|^\W*(?:warning\W+)?do not (?:edit|modify)\W*$", re.I)
_AUTO = r"(?:auto(?:matically)?[- ]?|machine[- ])"
_AFTER = r"(?= *(?:automatically )?(?:by|from|with|using|file|code|on)\b| *(?:[,;.:(-]|$))"
_MADE = re.compile(rf"\b(?:{_AUTO}?generated|{_AUTO}(?:made|produced|emitted|created|written)){_AFTER}|\bautomatisch (?:erzeugt|generiert)\b|\b(?:generado|creado) autom[aá]ticamente|\bg[eé]n[eé]r[eé] automatiquement", re.I)
_MADE_BY = re.compile(r"\b(?:produced|emitted|created|made|written(?: out)?) (?:automatically )?(?:by|from|with|using)\b", re.I)
_SUBJECT = re.compile(r"^\W*(?:(?:this|the|diese|este|ce) )?(?:(?:\w+ )?(?:file|code|module|source|datei|archivo|fichier))?\s*(?:(?:was|is|has been|wird|fue|est) (?:von \S+ )?)?(?:automatically )?$", re.I)
_WARNS = re.compile(r"\b(?:do not|don't|never|must not be|not be) (?:be )?(?:edit|modif|chang|touch)\w*|\b(?:edits?|changes?|änderungen)\b.*\b(?:lost|overwritten|discarded|verloren)\b|\bregenerate\b|\bsource of truth\b", re.I)
_KEPT = re.compile(r"\b(?:kept|maintained|edited|written|rewritten|updated|typed in)\b[^.;]*\b(?:by hand|manually)\b", re.I)
_NOT = re.compile(r"\b(?:not|never|don't|cannot)\b[^.;]*$", re.I)
_NOTICE = re.compile(r"^copied from \S+|^(?:bundled|vendored|third-party) copy of\b|\(c\) the \S+ authors\b|\bpermission is (?:hereby )?granted\b|^vendored from\b|\breport bugs upstream\b|\bupstream (?:tag|version|commit)\b", re.I)
_FOLDER = re.compile(r"(?:^|/)(?:node_modules|bower_components|vendor|_?vendored|_vendor|third[_-]?party|3rdparty|externals?|deps|contrib|libs/ext|site-packages|dist-packages|Godeps|Pods)/", re.I)
_NAMED = re.compile(r"(?:\.min\.\w+|_pb2(?:_grpc)?\.py|\.pb\.go|_pb\.[jt]s|\.g\.\w+|\.gen\.\w+|_generated\.\w+|\.generated\.\w+)$")
_BUILD = re.compile(r"(?:^|/)(?:__generated__|generated|autogen|gen)/")
_VALUE = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|0[xX][0-9a-fA-F_]+|\b\d[\w.]*")
_BARE = re.compile(r"^[\s\[\](){},;:&|+\-]*(?:\w+ *: *)?$")
_HEADS = re.compile(r"^[ \t]*(?:(?:pub |async |static )*(?:def|func|fn) [^\n]*|\w+\([^\n;]*\)[^\n;]*\{[ \t]*)$", re.M)
_ODD = re.compile(r"0x[0-9a-f]{6,}|[\"'/][0-9a-f]{8,}[\"']|_?\d{4,}\b")
_HEX = re.compile(r"0x[0-9a-f]{8,}|[\"'/][0-9a-f]{8,}[\"']")
_DOCSTRING = ('"""', "'''", 'r""')
_STARTS = "\"'{}[]()-0123456789"
_KEY = re.compile(r"\"\w+\" *:|\b\w+ *:")
_CALL = re.compile(r"\w\(")
_NAME = re.compile(r"[A-Za-z_]\w*")
_DECL = re.compile(r"^[ \t]*(?:(?:pub(?:\([a-z]+\))?|export|default|static|public|private|async|const|let|var|unsafe|final) +)*(?:def|fn|func|function|class|struct|impl|enum|trait|interface|type|if|for|while|return|match|switch|try|case)\b", re.M)


def _opening(text: str) -> list[str]:
    """The comments before the first code however long they are, those right after its first line, and those in the first
    15 lines. Of a docstring only the first line counts."""
    out, closing, code = [], "", 0
    for i, line in enumerate(text.lstrip("﻿").split("\n")):
        s = line.strip()
        if code > 1 and i >= 15:
            break
        m = _HEAD.match(line)
        if closing:
            found = m.group(1) if m else s.removesuffix("*/").strip() if closing == "*/" else ""
            closing = "" if closing in s else closing
        else:
            found = m.group(1) if m else ""
            opens = next((x for x in ("/*", "<!--", *_DOCSTRING[:2]) if s.startswith(x)), "")
            ends = {"/*": "*/", "<!--": "-->"}.get(opens, opens)
            closing = ends if opens and ends not in s[len(opens) :] else ""
            code += bool(s and not m)
        if found:
            out.append(found)
    return out


def _foreign_notice(comments: list[str], path: str) -> bool:
    """A notice of another project; one that names the file's own repository is none."""
    own = path.partition("/")[0].lower()
    return any(_NOTICE.search(c) and not (own and re.search(rf"\b{re.escape(own)}\b", c.lower())) for c in comments)


def _generated(comments: list[str]) -> bool:
    return any(map(_tool_notice, comments))


def _tool_notice(line: str) -> bool:
    kept = _KEPT.search(line)
    if kept and not _NOT.search(line[: kept.start()]):
        return False
    if _MARKED.search(line):
        return True
    made = _MADE.search(line)
    warns = bool(_WARNS.search(line))
    return bool(made and (warns or _SUBJECT.match(line[: made.start()]))) or warns and bool(_MADE_BY.search(line))


def _stamped(text: str, lines: list[str]) -> bool:
    """Whether most of the code is one short shape repeated with other names and numbers, as tools write accessors."""
    heads = _HEADS.findall(text)
    if len(heads) < 3 or len(_ODD.findall(text)) < 0.8 * len(heads):
        return False
    if len(heads) < 6 and len(_HEX.findall(text)) < len(heads):  # a few are a sign only with keys that nobody types
        return False
    code = [s for x in lines if (s := x.strip()) and s[0] not in "#*@" and s[:2] not in ("//", "/*") and s[:3] not in _DOCSTRING]
    if len(code) > 40 * len(heads):
        return False
    code = [x for x in code if not _BARE.match(_VALUE.sub("", x)) or x[0] in "})"]
    if not 2 * len(heads) <= len(code) <= 7 * len(heads) + 10:
        return False
    shapes = Counter(re.sub(r"\d+", "0", _NAME.sub("x", _VALUE.sub("0", x))) for x in code)
    top = sum(n for _, n in shapes.most_common(4))
    distinct = len({re.sub(r"\d+", "0", _NAME.sub("x", x.strip())) for x in heads})
    return distinct <= (1 if len(heads) < 6 else max(2, len(heads) // 6)) and top >= 0.7 * (len(code) - 8)


def _minified(text: str, lines: list[str]) -> bool:
    """Long lines, hardly a space beside operators, names of few letters."""
    dense = [x for x in lines if len(x) > 180]
    size = sum(map(len, dense))
    if size < 0.7 * max(1, len(text.strip())):
        return False
    body = "".join(_VALUE.sub("0", x) for x in dense)
    if len(body) < 0.3 * size:
        return False
    marks = len(re.findall(r"[;{}()=,]", body))
    names = _NAME.findall(body)
    return marks > 0.12 * len(body) and body.count(" ") < 0.12 * len(body) and bool(names) and float(np.median([len(n) for n in names])) <= 5


def _data(text: str, lines: list[str]) -> float:
    """The share of the file that is values without logic; 0 where there is logic too, or hardly any value."""
    if len(text) < LEAST_VALUES or len(_CALL.findall(text)) > len(text) // 120:
        return 0.0
    values = total = logic = 0
    for x in lines:
        s = x.strip()
        if not s or s[0] in "#*" or s[:2] in ("//", "/*"):
            continue
        total += len(s)
        if not (s[0] in _STARTS or len(s) > 200):
            logic += bool(_DECL.match(x))
            continue
        found = sum(map(len, _VALUE.findall(s)))
        rest = _VALUE.sub("", _KEY.sub("", s) if ":" in s else s)
        if found and (_BARE.match(rest) or found > 0.85 * len(s) and found > 60):
            values += len(s)
        elif _DECL.match(x):
            logic += 1
    return values / total if values >= LEAST_VALUES and logic <= 2 + values // 4000 else 0.0


def _marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from xxhash import xxh3_64_intdigest as digest

    for b in batches:
        rows = []
        for fid, repo, path, text in zip(b["file_id"], b["repo_id"], b["path"], b["content"]):
            path, text = path or "", (text or "").replace("\r\n", "\n")
            lines = text.split("\n")
            opening = _opening(text)
            minified = _minified(text, lines)
            values = 0.0 if minified else _data(text, lines)
            generated = _generated(opening) or (values >= 0.4 and bool(_NAMED.search(path) or _BUILD.search(path)))
            known = np.array(sorted({digest(s) - (1 << 63) for s in map(str.strip, lines) if len(s) >= LEAST_LINE}), np.int64)
            rows.append((fid, repo, path, generated, _stamped(text, lines), minified, values >= 0.8, _foreign_notice(opening, path), bool(_FOLDER.search(path)), blake2b(known.tobytes(), digest_size=16).digest(), known))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in MARKS.split(", ")])


def composition(files: DataFrame) -> DataFrame:
    """The marks of each file and the hashes of its lines of at least LEAST_LINE characters; one row per file_id."""
    rows = files.where(F.col("file_id").isNotNull()).select(F.col("file_id").cast("long"), F.col("repo_id").cast("long"), "path", "content")
    return spread(rows).mapInPandas(_marks, MARKS)


def classes(marks: DataFrame) -> DataFrame:
    """class, digest, n, low, high, foreign, lines of each set of significant lines: the least file that has it, how many
    lines, the least and greatest repository of the files that have it, and whether one of them shows a sign. Sets of fewer
    than LEAST_SHARED lines are left out; a null repo_id is a repository of its own."""
    repo = F.coalesce("repo_id", -F.col("file_id"))
    rows = marks.select("file_id", "digest", "lines", F.size("lines").alias("n"), repo.alias("repo"), (F.col("notice") | F.col("folder")).alias("foreign")).where(F.col("n") >= LEAST_SHARED)
    return rows.groupBy("digest").agg(F.min("file_id").alias("class"), F.max("n").alias("n"), F.min("repo").alias("low"), F.max("repo").alias("high"), F.max("foreign").alias("foreign"), F.first("lines").alias("lines"))


def _needed(n: Column, contained: float) -> Column:
    return F.ceil(n * contained - 1e-9)


def _verified(pairs: DataFrame, known: DataFrame, contained: float) -> DataFrame:
    """a, b of the pairs of classes of which one contains `contained` of the lines of the other, counted exactly."""
    side = lambda x: known.select(F.col("class").alias(x), F.col("n").alias("n_" + x), F.col("lines").alias("lines_" + x))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("lines_a", "lines_b"))
    return both.where(shared >= F.greatest(F.lit(LEAST_SHARED), _needed(F.least("n_a", "n_b"), contained))).select("a", "b")


def links(known: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """a, b: verified pairs of classes of different repositories that connect the same classes as all such pairs do."""
    line = known.select("class", "low", "high", F.explode("lines").alias("h"))
    first, last = F.struct("low", "class"), F.struct("high", "class")
    index = line.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("low").alias("least"), F.max("high").alias("most"), F.min(first)["class"].alias("first"), F.max(last)["class"].alias("last")).where("df > 1 AND least < most")
    posted = line.select("class", "h").join(index.select("h", "df", "first", "last"), "h").join(known.select("class", "n", "low", "high"), "class")
    posted = written(posted)
    # lines that no other repository has are the rarest; they share nothing
    by = Window.partitionBy("class")
    rare = posted.withColumn("place", F.row_number().over(by.orderBy("df", "h")) + F.col("n") - F.count(F.lit(1)).over(by))
    rare = written(rare.where(F.col("place") <= F.col("n") - _needed(F.col("n"), contained) + 1).select("class", "n", "low", "high", "h", "first", "last"))
    # one pivot a class, always of a lesser id, so that following pivots ends
    votes = rare.select("class", F.explode(F.array("first", "last")).alias("other")).where(F.col("other") < F.col("class")).groupBy("class", "other").agg(F.count(F.lit(1)).alias("votes"))
    pivot = votes.groupBy(F.col("class").alias("a")).agg(F.max(F.struct("votes", F.col("other").alias("b")))["b"].alias("b"))
    foreign = lambda p: F.least(p("low"), p("low_")) < F.greatest(p("high"), p("high_"))
    ends = known.select("class", "low", "high")
    pivot = pivot.join(ends.withColumnRenamed("class", "a"), "a").join(ends.select(F.col("class").alias("b"), F.col("low").alias("low_"), F.col("high").alias("high_")), "b").where(foreign(F.col)).select("a", "b")
    stars = written(_verified(pivot, known, contained))
    label = stars.select(F.col("a").alias("class"), F.col("b").alias("group"))
    for _ in range(JUMPS):
        label = label.join(stars.select(F.col("a").alias("group"), F.col("b").alias("next")), "group", "left").select("class", F.coalesce("next", "group").alias("group"))
    label = written(label)
    grouped = lambda df: df.join(label, "class", "left").withColumn("group", F.coalesce("group", "class"))
    seekers = written(grouped(rare.select("class", "n", "low", "high", "h")))
    holders = written(grouped(posted.join(rare.select("h").distinct(), "h", "left_semi").select("class", "n", "low", "high", "h")))
    crossing = seekers.select("h", "group").distinct().join(holders.select("h", F.col("group").alias("there")).distinct(), "h").where("group <> there")
    here = seekers.join(crossing, ["h", "group"]).select("h", "there", F.col("class").alias("a"), "n", "low", "high")
    there = holders.select("h", F.col("group").alias("there"), F.col("class").alias("b"), F.col("n").alias("n_"), F.col("low").alias("low_"), F.col("high").alias("high_"))
    pairs = here.join(there, ["h", "there"]).where((F.col("n_") >= _needed(F.col("n"), contained)) & foreign(F.col))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return stars.unionByName(_verified(pairs, known, contained))


def connected(seeds: DataFrame, pairs: DataFrame) -> DataFrame:
    """class: all that are connected with a seed. A round per step away from the seeds, each over the links of the last
    round's classes only, so the work grows with the links; rounds are written."""
    both = written(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    frontier = seeds.select("class").distinct()
    reached = [frontier]
    while True:
        seen = reduce(DataFrame.unionByName, reached)
        found = frontier.select(F.col("class").alias("a")).join(both, "a").select(F.col("b").alias("class")).distinct()
        frontier = written(found.join(seen, "class", "left_anti"))
        if frontier.isEmpty():
            return seen
        reached.append(frontier)


def not_by_hand(files: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """file_id, reason (generated, minified, data, vendored) of each file that is not hand-written, one row a file.

    Empty and null texts are hand-written unless their folder or notice says that they are copied. A notice of another
    project or a folder for dependencies is enough by itself; copies without either are told by those they are connected
    with. Redelivered rows count once; of a file with several reasons the first in the order above is given."""
    marks = written(composition(files))
    known = written(classes(marks))
    pairs = written(links(known, contained))
    # the files of a class are connected through another repository: one of the class's own, or one of a linked class
    joined = pairs.select(F.explode(F.array("a", "b")).alias("class")).unionByName(known.where("low < high").select("class")).distinct()
    vendored = connected(known.where("foreign").select("class").join(joined, "class", "left_semi"), pairs).withColumn("vendored", F.lit(True))
    vendored = known.select("digest", "class").join(vendored, "class").select("digest", "vendored")
    judged = marks.drop("lines").dropDuplicates(["file_id"]).join(vendored, "digest", "left")
    copied = F.coalesce("vendored", F.lit(False)) | F.col("notice") | F.col("folder")
    reason = F.when(F.col("generated") | F.col("stamped"), "generated").when(F.col("minified"), "minified").when(F.col("data"), "data").when(copied, "vendored")
    return judged.select("file_id", reason.alias("reason")).where("reason is not null")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return not_by_hand(table(spark, folder, "files")).select("file_id")


def p1_hand_written(spark: SparkSession, folder: str) -> DataFrame:
    """The symbols of files that people wrote, by repository: what is left for training."""
    symbols = table(spark, folder, "symbols").select("symbol_id", "file_id", "repo_id", F.octet_length("body").alias("bytes")).dropDuplicates(["symbol_id"])
    kept = symbols.join(not_by_hand(table(spark, folder, "files")).select("file_id"), "file_id", "left_anti")
    return kept.groupBy("repo_id").agg(F.count(F.lit(1)).alias("symbols"), F.sum("bytes").alias("bytes"))


QUERIES = {"p1_found": p1_found, "p1_hand_written": p1_hand_written}
SQL: dict[str, str] = {}
