"""Problem 8 on a small corpus of known levels."""

import random
from collections import Counter

from symloom.llm import level, prose

EASY = "the cat sat on the red mat and it was good"
HARD = "notwithstanding the methodological instrumentation of architectural contingencies the combinatorial reconciliation precipitates an asymptotic parameterization that conventional characterization systematically underestimates"
DOCS = "doc_id long, text string, lang string, cover string, level string"


def corpus():
    random.seed(1)
    rows, labels = [], []
    for i in range(80):
        hard = i % 2
        words = (HARD if hard else EASY).split()
        text = ". ".join(" ".join(random.sample(words, len(words) - 1)) for _ in range(6)) + "."
        rows.append((i, text, "en", None, None))
        if i < 60:
            labels += [(i, "a", 5 if hard else 1), (i, "b", 5 if hard else 1)]
    return rows, labels


def test_levels(spark):
    rows, labels = corpus()
    code = "```py\n" + HARD + "\n```\n" + rows[0][1] + '\n> ' + HARD + '.\n| ' + HARD + ' |\n\nThey said "' + HARD + '" here and it was good.\n'
    german = "der hund und die katze sind nicht auf dem dach und das ist ein problem mit der methodologischen instrumentalisierung von architekturen. " * 4
    rows += [(100, code, None, None, None), (101, german, "en", None, None), (102, None, None, None, None), (103, "", "en", None, None), (104, "```\nx = 1\n```", "en", None, None), (0, rows[0][1], "en", None, None)]
    d = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame([*labels, (1, "c", None)], "doc_id long, rater string, level int")
    got = {r["doc_id"]: r for r in level.reading_level(d, lab).collect()}
    assert len(got) == 85
    assert all(got[i]["level"] == (5 if i % 2 else 1) for i in range(80))
    assert got[100]["level"] == 1 and got[101]["lang"] == "de" and got[101]["level"] <= 4
    assert all(got[i]["level"] is None for i in (102, 103, 104))
    assert level.reading_level(d.limit(0), lab).count() == 0
    assert {r["level"] for r in level.reading_level(d.where("doc_id < 3"), lab.limit(0)).collect()} == {3}


def test_coverage_rank_is_exact_beyond_the_hot_words(spark):
    rows, _ = corpus()
    p = level.profiles(spark.createDataFrame(rows[:20], DOCS)).cache()
    count = Counter()
    for r in p.collect():
        for w, n in zip(r["words"], r["counts"]):
            count[w] += n
    rank = {w: 1 + sum(m > n for m in count.values()) for w, n in count.items()}
    want = {}
    for r in p.collect():
        ranks = sorted(x for w, n in zip(r["words"], r["counts"]) for x in [rank[w]] * n)
        want[r["doc_id"]] = ranks[-(-9 * len(ranks) // 10) - 1]
    for hot in (5, 50_000):
        assert {r["doc_id"]: r["cover"] for r in level.coverage(p, hot=hot).collect()} == want


def test_prose():
    assert prose.plain("# head\n- one two\n  three\n\n    code()\n`x` go [here](http://a.b) now") == "one two three\n  go here now"
    assert prose.sentences(None) == [] and prose.sentences("a b. c d e!") == []
    assert prose.sentences("aa bb cc. dd ee ff") == [["aa", "bb", "cc"], ["dd", "ee", "ff"]]
