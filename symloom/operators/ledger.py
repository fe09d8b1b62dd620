"""Sections and debt lines of markdown ledgers, and debt markers in source comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions import columns as C

# The sections a heading opens, by what it contains, in this order.
SECTIONS = (("epic", "epics"), ("debt", "debt"), ("vocab", "vocab"), ("gotcha", "vocab"))


def sections(documents: DataFrame) -> DataFrame:
    """doc_id, line, text, section: every line with the section that the last `## ` heading above it opened ('' before the
    first); heading lines themselves are left out. The headings cut a text inside its row, so no line is shuffled."""
    part = _parts(documents).select("doc_id", "x", F.explode("parts").alias("s"))
    inside = F.slice("x", F.col("s.line") + 1, F.col("s.stop") - F.col("s.line") - 1)
    return part.select("doc_id", "s", F.posexplode(inside).alias("i", "text")).select("doc_id", (F.col("s.line") + F.col("i") + 1).alias("line"), "text", "s.section")


def _parts(documents: DataFrame) -> DataFrame:
    """doc_id, x (the lines), parts: (line of the heading, section, line of the next heading), the first with line 0."""
    heading = lambda x: F.lower(F.regexp_replace(F.trim(x), r"^#+\s*", ""))

    def kind(h: Column) -> Column:
        out = F.lit("other")
        for word, name in reversed(SECTIONS):
            out = F.when(h.contains(word), name).otherwise(out)
        return out

    rows = documents.select("doc_id", C.lines("text").alias("x"))
    marks = F.transform("x", lambda t, i: F.when(F.trim(t).startswith("## "), F.struct((i + 1).alias("line"), kind(heading(t)).alias("section"))))
    marks = F.concat(F.array(F.struct(F.lit(0).alias("line"), F.lit("").alias("section"))), F.filter(marks, lambda m: m.isNotNull()))
    rows = rows.withColumn("m", marks)
    spans = F.transform("m", lambda m, i: F.struct(m["line"].alias("line"), m["section"].alias("section"), F.coalesce(F.try_element_at("m", i + 2)["line"], F.size("x") + 1).alias("stop")))
    return rows.select("doc_id", "x", spans.alias("parts"))


def resolved(documents: DataFrame, word: str) -> DataFrame:
    """doc_id, text without the bulleted lines of debt sections that hold the word, whatever its case."""
    gone = lambda t: F.ltrim(t).rlike(r"^[-*] ") & F.lower(t).contains(word.lower())

    def kept(s: Column) -> Column:
        whole = F.slice("x", F.greatest(s["line"], F.lit(1)), s["stop"] - F.greatest(s["line"], F.lit(1)))
        return F.when(s["section"] == "debt", F.filter(whole, lambda t: ~gone(t))).otherwise(whole)

    return _parts(documents).select("doc_id", F.array_join(F.flatten(F.transform("parts", kept)), "\n").alias("text"))


def debt_fields(text: Column | str) -> list[Column]:
    """what, why, trigger and the first rule that a debt line `- what <- why -> trigger` breaks (null if none)."""
    raw = F.ltrim(C.col(text))
    bullet = raw.startswith("- ") | raw.startswith("* ")
    content = F.substring(raw, 3, 2_000_000_000)
    left = F.instr(content, "<-")
    rest = F.when(left > 0, F.substr(content, left + 2))
    right = F.instr(rest, "->")
    what = F.when(left > 0, F.trim(F.substr(content, F.lit(1), left - 1)))
    why = F.when(right > 0, F.trim(F.substr(rest, F.lit(1), right - 1)))
    trigger = F.when(right > 0, F.trim(F.substr(rest, right + 2)))
    reason = F.when(~bullet, "missing bullet").when(left == 0, "missing <-").when(right == 0, "missing ->").when(what == "", "empty what").when(why == "", "empty why").when(trigger == "", "empty trigger")
    return [what.alias("what"), why.alias("why"), trigger.alias("trigger"), reason.alias("reason")]


def lint_reason(text: Column | str) -> Column:
    """Why a line of a debt section is refused, null if it is not."""
    t = C.col(text)
    return F.when(t.contains("~~"), "strikethrough").when(t.contains("[x]") | t.contains("[X]"), "completed checkbox").when(t.contains("[ ]"), "checkbox").otherwise(debt_fields(t)[3])


def is_accepted(what: Column | str) -> Column:
    w = F.lower(C.col(what))
    return w.startswith("accepted") | w.startswith("[accepted]")


def markers(files: DataFrame, word: str) -> DataFrame:
    """file_id, line, what, why, trigger, reason of the comments `// word: what <- why -> trigger` (also #, --, /*).

    Strings before the comment are skipped, so that a marker inside one is none; in Rust a single quote opens no string."""
    rows = files.where(F.lower("content").contains(word.lower() + ":")).select("file_id", C.extension("path").alias("ext"), F.posexplode(C.lines("content")).alias("i", "text"))
    quoted = r"\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"|`[^`\\]*+(?:\\.[^`\\]*+)*+`"
    body = rf"(?i)(?:#|//|/\*|--) {word}:(.*)$"
    plain = F.when(F.col("ext") == "rs", F.regexp_replace("text", quoted, "")).otherwise(F.regexp_replace("text", quoted + r"|'[^'\\]*+(?:\\.[^'\\]*+)*+'", ""))
    rest = F.trim(F.regexp_replace(F.regexp_extract(plain, body, 1), r"\*/.*$", ""))
    found = rows.where(F.regexp_like(plain, F.lit(body))).select("file_id", (F.col("i") + 1).alias("line"), F.concat(F.lit("- "), rest).alias("t"))
    return found.select("file_id", "line", *debt_fields("t"))
