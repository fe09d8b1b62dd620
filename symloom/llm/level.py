"""Problem 8: the reading level of each document.

Words of the prose are ranked by their frequency in the whole corpus. The coverage rank of a document is the size of
the smallest frequency-ranked vocabulary that covers a fixed share of its words. Together with the complexity of its
sentences (words to a sentence, letters to a word) it is calibrated against the raters' levels in SQL: the median level
of labelled documents that fall into the same cell of coverage, length and letters, of coarser cells where few do.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.llm.prose import language, sentences
from symloom.util import spread, table, written

SHARE, HOT, LEAST, TYPICAL = 0.9, 50_000, 4, 0.6
PROFILE = "doc_id long, lang string, sentences int, n_words long, length double, letters double, words array<string>, counts array<int>"


def _typical(values: list[float]) -> float:
    """The value at the TYPICAL quantile: a text is as demanding as the larger part of its sentences, whatever single ones are."""
    return float(sorted(values)[round(TYPICAL * (len(values) - 1))]) if values else 0.0


def _declared(lang: str | None) -> str:
    """The language a row declares, for texts without a function word; English where it declares none."""
    return (lang or "en").lower()[:2]


def _profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc, text, lang in zip(b["doc_id"], b["text"], b["lang"]):
            s = sentences(text)
            count: Counter[str] = Counter()
            for words in s:
                count.update(words)
            length = _typical([len(w) for w in s])
            letters = _typical([sum(map(len, w)) / len(w) for w in s])
            rows.append((doc, language(count) or _declared(lang), len(s), sum(count.values()), length, letters, list(count), list(count.values())))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PROFILE.split(", ")])


def profiles(documents: DataFrame) -> DataFrame:
    """What the prose of each document is made of, in one pass over the whole texts."""
    return spread(documents.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"))).mapInPandas(_profile, PROFILE)


def vocabulary(profile: DataFrame) -> DataFrame:
    """word, rank: one more than the number of words that are more frequent; equally frequent words share a rank.

    Frequencies are ordered within octaves; how many words all greater octaves hold comes from one count an octave, of
    which there are at most 63, so the words themselves are never sorted in one task."""
    words = profile.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy(F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("n"))
    words = written(words)
    steps = words.groupBy("n").count().withColumn("octave", F.floor(F.log2("n")).cast("int"))
    above, before = 0, {}
    for r in sorted(steps.groupBy("octave").agg(F.sum("count").alias("m")).collect(), reverse=True):
        before[r["octave"]] = above
        above += r["m"]
    start = F.coalesce(*[F.when(F.col("octave") == o, F.lit(n)) for o, n in before.items()], F.lit(0))
    inside = F.sum("count").over(Window.partitionBy("octave").orderBy(F.desc("n"))) - F.col("count")
    steps = steps.select("n", (start + inside + 1).alias("rank"))
    return words.join(steps, "n").select("word", "rank")


def coverage(profile: DataFrame, share: float = SHARE, hot: int = HOT) -> DataFrame:
    """doc_id, cover: the least rank up to which `share` of the words lie; null without prose.

    Ranks up to `hot` (a parameter, so many words at most but for ties at the end) are looked up in each task. Only a
    document that they cover too little takes its remaining words through a join, whose words are rare."""
    ranked = written(vocabulary(profile))
    spark = profile.sparkSession
    few = ranked.where(F.col("rank") <= hot).orderBy("rank", "word").limit(hot).toPandas()
    known = spark.sparkContext.broadcast(dict(zip(few["word"], few["rank"])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = known.value.get
        for b in batches:
            out = []
            for words, counts in zip(b["words"], b["counts"]):
                r = np.array([rank(w, 0) for w in words], np.int64)
                c = np.asarray(counts, np.int64)
                total = int(c.sum())
                if not total:
                    out.append((None, None, None))
                    continue
                order = np.argsort(np.where(r == 0, np.iinfo(np.int64).max, r), kind="stable")
                at = int(np.searchsorted(np.cumsum(c[order]), np.ceil(share * total - 1e-9)))
                if r[order[at]]:
                    out.append((int(r[order[at]]), None, None))
                else:
                    out.append((None, int(np.ceil(share * total - 1e-9)) - int(c[r > 0].sum()), [(words[i], int(c[i])) for i in np.flatnonzero(r == 0)]))
            yield pd.DataFrame({"doc_id": b["doc_id"], "cover": pd.array([x[0] for x in out], "Int64"), "open": pd.array([x[1] for x in out], "Int64"), "tail": [x[2] for x in out]})

    got = profile.select("doc_id", "words", "counts").mapInPandas(run, "doc_id long, cover long, open long, tail array<struct<word:string,n:int>>")
    got = written(got)
    tail = got.where("open is not null").select("doc_id", "open", F.explode("tail").alias("x")).select("doc_id", "open", "x.word", "x.n")
    tail = tail.join(ranked, "word")
    upto = Window.partitionBy("doc_id").orderBy("rank", "word").rowsBetween(Window.unboundedPreceding, 0)
    tail = tail.withColumn("sum", F.sum("n").over(upto)).where("sum >= open").groupBy("doc_id").agg(F.min("rank").alias("cover"))
    return got.where("open is null").select("doc_id", "cover").unionByName(tail)


def features(documents: DataFrame) -> DataFrame:
    """doc_id, lang, sentences, length, letters, cover; a row for each row of documents with a distinct doc_id."""
    p = written(profiles(documents).dropDuplicates(["doc_id"]))
    return p.select("doc_id", "lang", "sentences", "length", "letters").join(coverage(p).hint("merge"), "doc_id", "left")


CELLS = """
SELECT *, cast(round(letters * 2) AS int) AS c1, cast(round(ln(greatest(length, 1)) * 4) AS int) AS c2,
       cast(round(ln(greatest(coalesce(cover, 1), 1)) * 4) AS int) AS c3
FROM features
"""
CALIBRATED = """
WITH rated AS (SELECT doc_id, avg(level) AS level FROM labels WHERE level IS NOT NULL GROUP BY doc_id),
     known AS (SELECT /*+ MERGE(r) */ c.*, r.level FROM cells c JOIN rated r USING (doc_id) WHERE c.lang = 'en' AND c.sentences > 0),
     fine AS (SELECT c1, c2, c3, median(level) AS l3 FROM known GROUP BY c1, c2, c3 HAVING count(*) >= {least}),
     mid AS (SELECT c1, c2, median(level) AS l2 FROM known GROUP BY c1, c2 HAVING count(*) >= {least}),
     wide AS (SELECT c1, median(level) AS l1 FROM known GROUP BY c1 HAVING count(*) >= {least}),
     line AS (SELECT coalesce(regr_slope(level, letters), 0) AS b, coalesce(regr_intercept(level, letters), avg(level), 3) AS a FROM known),
     read AS (SELECT c.*, coalesce(l3, l2, l1, a + b * letters) AS raw
              FROM cells c LEFT JOIN fine USING (c1, c2, c3) LEFT JOIN mid USING (c1, c2) LEFT JOIN wide USING (c1) CROSS JOIN line)
SELECT doc_id, lang, cover, round(length, 4) AS length, round(letters, 4) AS letters,
       CASE WHEN sentences = 0 THEN NULL ELSE round(raw, 4) END AS score,
       CASE WHEN sentences = 0 THEN NULL
            WHEN lang <> 'en' THEN least(4, greatest(1, cast(floor(raw + 0.5) AS int)))
            ELSE least(5, greatest(1, cast(floor(raw + 0.5) AS int))) END AS level
FROM read
"""


def reading_level(documents: DataFrame, labels: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, lang, cover, length, letters, score, level (1 to 5) of each document.

    Null, empty and code-only texts have a null level. Texts not in English are at most 4. `lang` is told from the text,
    from the column only where no function word tells it. Without labels every level is 3. The one cross join is with a row of two coefficients."""
    spark = documents.sparkSession
    cells = spark.sql(CELLS.replace("features", "{features}"), features=features(documents))
    sql = CALIBRATED.replace("{least}", str(int(least))).replace("FROM cells", "FROM {cells}").replace("FROM labels", "FROM {labels}")
    return spark.sql(sql, cells=written(cells), labels=labels)


def p8_levels(spark: SparkSession, folder: str) -> DataFrame:
    return reading_level(table(spark, folder, "documents"), table(spark, folder, "level_labels"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_levels(spark, folder).where("level = 5").select("doc_id")


QUERIES = {"p8_found": p8_found, "p8_levels": p8_levels}
SQL: dict[str, str] = {}
