"""Slices, coordinates, diffs and the verbs over a folder of tables."""

import pytest
from pyspark.sql import functions as F

from symloom.operators import coordinates, diff, graph, health, search, slices
from symloom.plans.verbs import NotFound, Workspace


@pytest.fixture(scope="module")
def workspace(spark, make_symbols, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("ws"))
    s = make_symbols(
        {"file": "src/engine.rs", "name": "run", "calls": ["load"], "centrality": 0.2, "file_id": 1, "end_line": 5}, {"file": "src/store.rs", "name": "load", "centrality": 0.4, "file_id": 2, "end_line": 4}, {"file": "src/api.ts", "name": "Job", "kind": "class", "file_id": 3, "end_line": 9},
        {"file": "src/api.ts", "name": "Job::constructor", "kind": "method", "file_id": 3, "start_line": 2, "end_line": 4}, {"file": "src/queue.ts", "name": "push", "calls": ["Job::constructor"], "mentions": ["load"], "file_id": 4}, {"file": "lib/store.rs", "name": "load", "file_id": 5},
    )
    rows = s.withColumnRenamed("sid", "symbol_id").withColumn("indexed_at", F.expr("TIMESTAMP_NTZ '2025-01-01'"))
    rows.unionByName(rows.limit(2).withColumn("indexed_at", F.expr("TIMESTAMP_NTZ '2025-02-01'"))).write.parquet(f"{folder}/symbols.parquet")
    spark.createDataFrame([(1, 1, "src/engine.rs", "fn run() { load() }"), (2, 1, "src/store.rs", "fn load() {}"), (3, 1, "src/api.ts", "class Job {}")], "file_id long, repo_id long, path string, content string").write.parquet(f"{folder}/files.parquet")
    spark.createDataFrame([(1, "b/src/store.rs", "@@ -1 +2,2 @@"), (2, "/dev/null", "@@ -1 +1 @@"), (3, "./src/api.ts", "oops")], "hunk_id long, path string, header string").write.parquet(f"{folder}/hunks.parquet")
    return Workspace(spark, folder)


def ids(df):
    return {r["sid"] for r in df.collect()}


def test_verbs(workspace):
    assert {(r["sid"], r["tier"]) for r in workspace.up("src/store.rs:load").collect()} == {(0, "call"), (4, "mention")}
    assert ids(workspace.up("Job")) == {4}
    assert ids(workspace.down("run")) == {1}
    assert ids(workspace.uses("load")) == {4}
    assert {(r["sid"], r["depth"]) for r in workspace.blast("store.rs:load").collect()} == {(0, 1)}
    assert {(r["sid"], r["depth"]) for r in workspace.blast("run", down=True).collect()} == {(1, 1)}
    assert ids(workspace.diff()) == {0}
    assert [r["sid"] for r in workspace.find("load").orderBy("place").collect()] == [1, 5]
    assert {r["path"] for r in workspace.missing("load", scope="./src").collect()} == {"src/api.ts"}
    assert workspace.map("src").count() == 4
    assert abs(workspace.rank(tolerance=0.05).agg(F.sum("rank")).first()[0] - 1) < 1e-9
    totals, dead, hubs = workspace.doctor()
    assert totals.first()["symbols"] == 6 and ids(hubs) == {1, 3}
    assert workspace.slice("src/store.rs:load").first()["callers"] == "src/engine.rs:run"
    assert '"sid":1' in Workspace.json(workspace.down("run")).first()["json"]
    assert ids(workspace.report().where("what = 'affected'")) == {0}
    assert {(r["what"], r["id"], r["line"]) for r in workspace.search("load|fn run").collect()} == {("symbol", 1, None), ("symbol", 5, None), ("line", 1, 1)}
    with pytest.raises(NotFound):
        workspace.slice("load")
    with pytest.raises(NotFound):
        workspace.blast("nothing")


def test_coordinates(make_symbols):
    s = make_symbols({"file": "src/alpha/mod.rs", "name": "handler"}, {"file": "src/beta/mod.rs", "name": "handler"}, {"file": "x.rs", "name": None})
    got = {r["coordinate"]: r["hits"] for r in slices.coordinate_index(s).collect()}
    assert got["mod.rs:handler"] == 2 and got["alpha/mod.rs:handler"] == 1 and got["src/alpha/mod.rs:handler"] == 1 and "ha/mod.rs:handler" not in got


def test_callers_are_cut(make_symbols):
    s = make_symbols({"file": "t.rs", "name": "target"}, *[{"file": f"d{i}/c.rs", "name": f"c{i}", "calls": ["target"]} for i in range(8)])
    r = slices.slices(s, graph.call_edges(s)).where("sid = 0").first()
    assert r["callers"].split() == [f"d{i}/c.rs:c{i}" for i in range(5)] and r["more_callers"] == 3


def test_budget_drops_in_order(spark):
    df = spark.createDataFrame([(10, 5, 0, 7), (10, 50, 50, 50), (200, 5, 5, 5)], "core long, a long, b long, c long")
    got = [r[0] for r in df.select(slices.fitted(F.col("core"), [("a", F.col("a")), ("b", F.col("b")), ("c", F.col("c"))], 70)).collect()]
    assert got == ["", "a b", "a b c"]


def test_diff_text(spark):
    text = "diff --git a/x b/x\n--- a/x.rs\n+++ b/x.rs\n@@ -1 +4,2 @@ fn\n+a\n--- a/y.rs\n+++ /dev/null\n@@ -1,3 +0,0 @@\n--- /dev/null\n+++ b/d/z.go\n@@ -0,0 +1,9 @@\n@@ bad\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, t string")
    assert {tuple(r) for r in diff.ranges_of_diffs(df, "id", "t").collect()} == {(1, "x.rs", 4, 5), (1, "d/z.go", 1, 9)}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("src/a.rs:run", ("src/a.rs", "run", None, None)), ("src/a.rs:T::run (L3-9)", ("src/a.rs", "T::run", None, None)), ("T::run", (None, "T::run", None, None)), ("a.rs:#L10-L20", ("a.rs", None, 10, 20)), ("a.rs#L7", ("a.rs", None, 7, 7)),
        ("a.rs:9-3", ("a.rs", None, 3, 9)), ("a.rs:0", ("a.rs", None, 1, 1)), ("C:\\x\\a.rs:run", ("C:/x/a.rs", "run", None, None)), ("D:/x/a.rs:4-5", ("D:/x/a.rs", None, 4, 5)), ("run", (None, "run", None, None)),
    ],
)
def test_forms_of_coordinates(spark, text, want):
    c = coordinates.parse(text)
    assert (c.file, c.name, c.first, c.last) == want
    assert tuple(spark.createDataFrame([(text,)], "t string").select(*coordinates.parts("t")).first()) == want


def test_coordinate_tiers(spark, make_symbols):
    s = make_symbols(
        {"file": "src/a/mod.rs", "name": "run", "centrality": 0.1, "end_line": 4}, {"file": "lib/src/a/mod.rs", "name": "run", "centrality": 0.3}, {"file": "x/mod.rs", "name": "T::run", "kind": "method", "centrality": 0.2}, {"file": "src/a/mod.rs", "name": "far", "start_line": 6, "end_line": 9}, {"file": "q.rs", "name": None},
    )
    asked = ["src/a/mod.rs:run", "a/mod.rs:run", "root/x/mod.rs:run", "other/mod.rs:run", "run", "none", "src/a/mod.rs:#L4-6", "q/zz.rs:run"]
    rows = coordinates.resolve(spark.createDataFrame([(t,) for t in [*asked, None, "run"]], "target string"), s).orderBy("place").collect()
    got = {}
    for r in rows:
        got.setdefault(r["target"], (r["tier"], r["status"], []))[2].append(r["sid"])
    assert got == {
        "src/a/mod.rs:run": ("exact", "unique", [0]), "a/mod.rs:run": ("suffix", "ambiguous", [1, 0]), "root/x/mod.rs:run": ("suffix", "unique", [2]), "other/mod.rs:run": ("basename", "ambiguous", [1, 2, 0]),
        "run": ("name", "ambiguous", [1, 2, 0]), "none": (None, "not_found", [None]), "src/a/mod.rs:#L4-6": ("exact", "ambiguous", [0, 3]), "q/zz.rs:run": (None, "not_found", [None]),
    }
    assert coordinates.resolve(spark.createDataFrame([("run",)], "target string"), s.limit(0)).first()["status"] == "not_found"


def test_lines_only_of_lost_terms(spark, make_symbols):
    s = make_symbols({"file": "a.rs", "name": "alpha", "file_id": 1, "end_line": 3}, {"file": "a.rs", "name": "outer", "file_id": 1, "end_line": 9})
    f = spark.createDataFrame([(1, "a.rs", "alpha beta\nBETA\nx\nbeta"), (2, "gamma.rs", "gamma"), (3, None, None)], "file_id long, path string, content string")
    got = {tuple(r) for r in search.find(s, f, ["alpha", "beta", "gamma"]).collect()}
    assert got == {("symbol", 0, None, 0), ("file", 2, None, None), ("line", 1, 1, 0), ("line", 1, 2, 0), ("line", 1, 4, 1)}


def test_reports_of_a_change(spark, make_symbols):
    s = make_symbols(
        {"file": "a.rs", "name": "base", "body": "fn base() {}"}, {"file": "b.rs", "name": "user", "calls": ["base"], "body": "fn user() {\n    // base()\n    base();\n    base ( 1 );\n}", "start_line": 10}, {"file": "tests/t.rs", "name": "test_user", "calls": ["user"], "body": "fn test_user() { user() }"},
        {"file": "tests/u.rs", "name": "test_other", "body": "fn test_other() {\n  let x = base;\n}"}, {"file": "m.rs", "name": "main", "calls": ["user"], "body": "fn main() { user() }"}, {"file": "z.rs", "name": "lone", "body": ""},
    )
    e = graph.call_edges(s).cache()
    d = health.degrees(s, e)
    touched = s.where("name IN ('base', 'user')").select("sid")
    got = {tuple(r) for r in diff.report(d, e, touched).collect()}
    assert got == {("affected", 2, 1, "1", "tests/t.rs"), ("affected", 4, 1, "1", "m.rs"), ("entry", 4, 1, None, "m.rs"), ("suite", None, 1, None, "tests/t.rs"), ("mention", 3, None, "2", "tests/u.rs")}
    one = {tuple(r) for r in diff.report(d, e, touched.where("sid = 0")).collect()}
    assert ("affected", 1, 1, "12 13", "b.rs") in one and ("affected", 2, 2, "", "tests/t.rs") in one
    assert diff.report(d, e, touched.limit(0)).count() == 0
    walk = {(r["sid"], r["depth"]) for r in diff.affected(e, touched).select("sid", "depth").collect()}
    assert walk == {(r["sid"], r["depth"]) for r in diff.cone(e, touched).join(touched, "sid", "left_anti").collect()}


def test_dump_fits_the_budget(spark, make_symbols):
    s = make_symbols(*[{"file": f"f{i}.rs", "name": f"name{i}", "centrality": i / 10} for i in range(9)])
    lines = spark.createDataFrame([(1, 1, i, "x" * 30) for i in range(1, 30)] + [(2, 2, 1, None)], "repo_id long, doc_id long, line int, text string")
    rows = health.dump(lines, s, budget=100, reserved=150).collect()
    kept = [r for r in rows if r["repo_id"] == 1]
    assert sum(r["part"] == "ledger" for r in kept) == 8 and sum(len(r["text"]) + 1 for r in kept) <= 250
    plain = health.dump(lines.limit(0), s, budget=100).orderBy("place").collect()
    assert [r["text"] for r in plain] == ["f8.rs: function name8", "f7.rs: function name7", "f6.rs: function name6"]


def test_a_folder_of_sources(spark, tmp_path):
    root = tmp_path / "it's src"
    root.mkdir()
    (root / "a.py").write_text("def one():\n    two()\n")
    (root / "b.py").write_text("def two():\n    return 1\n")
    w = Workspace.of_sources(spark, str(root), str(tmp_path / "tables"))
    assert [r["tier"] for r in w.up("two").collect()] == ["call"]
    assert w.slice("b.py:two").first()["body"] == "def two():\n    return 1"
