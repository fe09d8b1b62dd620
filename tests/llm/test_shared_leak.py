"""Problems 4 and 7 against brute force."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from symloom.llm import fmindex, leak, shared


def brute(rows, span):
    where = {}
    for _, f, b in rows:
        for k in range(len(b) - span + 1):
            where.setdefault(b[k : k + span], set()).add(f)
    out = {}
    for s, _, b in rows:
        hit = [False] * len(b)
        for k in range(len(b) - span + 1):
            if len(where[b[k : k + span]]) > 1:
                hit[k : k + span] = [True] * span
        out[s] = sum(hit)
    return out


def test_shared_characters(spark):
    random.seed(3)
    word = lambda: "".join(random.choice("abé") for _ in range(5))
    common = [" ".join(word() for _ in range(8)) for _ in range(4)]
    rows = []
    for i in range(60):
        body = " ".join([word(), random.choice(common), word(), *([random.choice(common)] if i % 3 else []), "zz" * (i % 7)])
        rows.append((i, i // 2, body))
    rows += [(100, 50, rows[0][2]), (101, 51, "q" * 300), (102, 52, "q" * 260), (103, 53, "short"), (104, 54, "")]
    df = spark.createDataFrame(rows, "symbol_id long, file_id long, body string")
    got = {r["symbol_id"]: r["shared_chars"] for r in shared.shared_spans(df, 40).collect()}
    assert got == brute(rows, 40)


def test_windows_cover_every_span_once_with_its_least_hash():
    random.seed(8)
    texts = ["".join(random.choice(["ab", " ", "x_1", "(", "\n    ", "é", " " * 40, "q" * 50, "=="]) for _ in range(90)) for _ in range(20)]
    for span in (25, 40, 200):
        scheme = shared.Scheme(span)
        part = [t for t in texts if len(t) >= span]
        w = shared.Windows(part, scheme)
        text, start, end = shared.shingles(w.g, scheme)
        for f in range(2):
            t, first, last, low = w.under(f)
            seen = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
            want = np.concatenate([np.arange(a, b - span + 1) for a, b in zip(w.g.starts, w.g.ends)])
            assert seen.tolist() == want.tolist()
            v = np.zeros(len(w.start), np.uint64)
            seed = np.uint64((f + 1) * 0xA24BAED4963EE407 % (1 << 64))
            v = shared.mixed(w.hash ^ seed) | np.uint64(1)
            for a, b, x in zip(first, last, low):
                for s in {int(a), int(b)}:
                    inside = (start >= s + scheme.margin) & (end <= s + span - scheme.margin)
                    assert inside.any() and v[inside].min() == x


def test_equal_spans_have_equal_signatures():
    """Whatever stands around a span, also where it cuts words and white space."""
    random.seed(9)
    make = lambda n: "".join(random.choice(["ab", " ", "x_1", "(", "\n    ", "é", " " * 30, "longer_name_of_a_thing", "q" * 50, "=="]) for _ in range(n))
    scheme = shared.Scheme(200)
    for _ in range(60):
        core = make(120)[:200]
        texts = [random.choice(["", "q", "  "]) + make(random.randint(0, 30)) + core + random.choice(["q", " ", "9"]) + make(random.randint(0, 30)) for _ in range(2)]
        w = shared.Windows(texts, scheme)
        for f in range(2):
            _, first, last, low = w.under(f)
            at = [int(b) + t.index(core) for b, t in zip(w.g.starts, texts)]
            got = [int(low[np.searchsorted(first, x, side="right") - 1]) for x in at]
            assert got[0] == got[1]


def test_shared_edge_cases(spark):
    schema = "symbol_id long, file_id long, body string, copy string, start int"
    same = "abc " * 80
    rows = [(1, 1, same, None, 1), (1, 1, same, "x", 2), (2, 1, same, None, 1), (3, None, same, None, 1), (4, 2, None, None, 1), (None, 3, same, None, 1)]
    got = {r["symbol_id"]: r["shared_chars"] for r in shared.shared_spans(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: 0, 2: 0, 3: 0}
    assert shared.shared_spans(spark.createDataFrame([], schema)).count() == 0
    # a third of all rows in one class of copies
    rows = [(i, i, same if i % 3 == 0 else f"{i} " * 100, None, 1) for i in range(60)]
    got = {r["symbol_id"] for r in shared.shared_spans(spark.createDataFrame(rows, schema)).where("share = 1").collect()}
    assert got == {i for i in range(60) if i % 3 == 0}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=120))
def test_suffix_array_and_search(values):
    s = np.array(values, np.int64)
    assert fmindex.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: values[i:])
    if len(values) >= 3:
        f = fmindex.FMIndex(s, 4)
        phrases = np.array([values[i : i + 3] for i in range(len(values) - 2)])
        for p, a, b in zip(phrases, *f.ranges(phrases)):
            want = [i for i in range(len(values) - 2) if values[i : i + 3] == p.tolist()]
            assert sorted(f.locate(np.arange(a, b)).tolist()) == want


ITEMS = "item_id long, suite string, text string, answer string, words int"
ASK = "Read what follows and answer in one short line. "
Q1 = "After 512 retries the ranker named peel_grain still points at bucket 238 instead of walkBeacon and nobody has noticed the shift of the older column yet"
Q2 = "How many hidden carriers remain if load_corner drops 929 percent and stageNeedle restores 248 before the loose window closes for the evening again"


def leaks(spark, *docs):
    items = [(1, "s", ASK + Q1, None, 1), (2, "s", ASK + Q2, "Only 516 survive because split_frame discards each pinned canopy above 892 while settleMarker keeps its ladder", 1), (3, "s", ASK + "Other text stands here that nobody repeats anywhere else in any of these documents at all", "no", 1), (4, "t", None, None, None)]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, item_id int")
    rows = leak.leaked_spans(d, spark.createDataFrame(items, ITEMS))
    return {(r["doc_id"], r["item_id"]) for r in rows.collect()}, rows


def test_leaks(spark):
    w = Q1.split()
    swapped = " ".join("other" if i in (4, 15) else x for i, x in enumerate(w))
    decoy = Q1.replace("512", "77").replace("ranker", "gauge").replace("peel_grain", "trim_x").replace("bucket", "lever").replace("238", "9").replace("walkBeacon", "foldIt").replace("column", "spool").replace("noticed", "heard").replace("older", "late")
    got, rows = leaks(
        spark,
        "before " + Q1.upper() + " after", "> " + Q1.replace(" ", "\n> "), "x &quot;" + "&nbsp;".join(w) + "&quot;", '{"t": "' + Q1.replace("retries", "retries\\n") + '"}', " ".join(w[3:15]), " ".join(w[3:14]),
        "noise " + swapped + " noise", decoy, ASK, ASK + ASK, None, "", "so: Only 516 survive because split\\_frame discards each **pinned** canopy above 892, while settleMarker keeps its ladder", "<b>" + "</b> <i>".join(w) + "</i>",
    )
    assert got == {(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (6, 1), (12, 2), (13, 1)}
    spans = {r["doc_id"]: (r["start"], r["end"]) for r in rows.collect()}
    assert spans[0] == (7, 7 + len(Q1))
    merged = leak.removal_spans(rows.unionByName(rows)).collect()
    assert len(merged) == 8


def test_words_left_out_or_put_in(spark):
    w = Q2.split()
    got, _ = leaks(spark, " ".join(w[:5] + ["really"] + w[5:11] + w[12:]))
    assert got == {(0, 2)}


def test_altered_copies_are_removed_whole(spark):
    """Also beside an exact passage, and each of several copies."""
    w = Q1.split()
    altered = " ".join("other" if i == 14 else x for i, x in enumerate(w))
    doc = f"{altered} {'filler ' * 60}{Q1} {'filler ' * 60}{' '.join('new' if i in (5, 18) else x for i, x in enumerate(w))}"
    got, rows = leaks(spark, doc)
    assert got == {(0, 1)}
    merged = sorted((r["start"], r["end"]) for r in leak.removal_spans(rows).collect())
    texts = [doc[a:b].split() for a, b in merged]
    assert [len(t) for t in texts] == [len(w)] * 3


def test_openings_of_suites(spark):
    rows = [("a", f"Read this and answer now question {i} about {i}".split()) for i in range(9)] + [("b", f"{i} odd text".split()) for i in range(9)] + [("c", "Please do it".split())] * 2 + [("d", [])]
    got = {r["suite"]: r["opening"] for r in leak.standing(spark.createDataFrame(rows, "suite string, words array<string>")).collect()}
    assert got == {"a": "Read this and answer now question".split()}


def test_blocks_give_the_same(spark):
    d = spark.createDataFrame([(1, Q1), (2, Q2)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"s{i}", t, None) for i, t in enumerate([Q1, Q2, Q1 + " more words"])], "item_id long, suite string, text string, answer string")
    rows = lambda b: sorted({(r["doc_id"], r["item_id"]) for r in leak.leaked_spans(d, items, b).collect()})
    assert rows(1) == rows(100) == [(1, 0), (1, 2), (2, 1)]
    assert leak.leaked_spans(d.limit(0), items).count() == 0
    assert leak.leaked_spans(d, items.limit(0)).count() == 0
