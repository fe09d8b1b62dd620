"""Column functions, search, ledgers, the store and extraction."""

import pytest
from pyspark.sql import functions as F

from symloom.functions import columns as C
from symloom.operators import graph, ledger, search
from symloom.sources import extract, store
from symloom.streaming import sync


def value(spark, column, **given):
    names = list(given)
    schema = ", ".join(f"{n} {'bigint' if isinstance(v, int) else 'string'}" for n, v in given.items())
    return spark.createDataFrame([tuple(given[n] for n in names)], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("header", "want"),
    [("@@ -1 +10 @@", (10, 10)), ("@@ -10 +12 @@ f", (12, 12)), ("@@ -1,3 +20,5 @@", (20, 24)), ("@@ -9,2 +44,0 @@", (44, 44)), ("@@ -1 +0,0 @@", (1, 1)), ("nothing", None), ("@@ -1 +x @@", None), (None, None)],
)
def test_hunk_ranges(spark, header, want):
    got = value(spark, C.hunk_range("h"), h=header)
    assert (None if got is None else tuple(got)) == want


@pytest.mark.parametrize(("text", "want"), [("a\nb\n", ["a", "b"]), ("a\r\n\r\nb", ["a", "", "b"]), ("", []), (None, []), ("\n", [""]), ("a\n\n", ["a", ""])])
def test_lines(spark, text, want):
    assert value(spark, C.lines("t"), t=text) == want


@pytest.mark.parametrize(("file", "name", "want"), [("tests/x.rs", "f", True), ("src/latest.rs", "contest", False), ("a/b_test.go", "f", True), ("src/a.ts", "T::test_x", True), ("src/a.spec.ts", "f", True), ("specs/a.ts", "f", False)])
def test_test_predicate(spark, file, name, want):
    assert value(spark, C.is_test("f", "n"), f=file, n=name) is want


def test_paths(spark):
    assert value(spark, C.component_suffix("a", "b"), a="src/alpha/mod.rs", b="alpha/mod.rs") is True
    assert value(spark, C.component_suffix("a", "b"), a="src/alpha/mod.rs", b="ha/mod.rs") is False
    assert value(spark, C.stem("a"), a="x/page.tsx") == "page"
    assert value(spark, C.stem("a"), a="x/Makefile") == ""
    assert value(spark, C.repository_path("a"), a="b/src/x.rs") == "src/x.rs"
    assert value(spark, C.repository_path("a"), a="/dev/null") is None
    assert value(spark, C.in_scope_map("a", "b"), a="x/b/c.rs") is True
    assert value(spark, C.in_scope_find("a", "./x//b/"), a="x/b/c.rs") is True
    assert value(spark, C.in_scope_missing("a", "."), a="x/b/c.rs") is True


def test_truncation_and_tokens(spark):
    body = "\n".join(f"l{i}" for i in range(300))
    cut = value(spark, C.truncated_body("b", "s"), b=body, s=300)
    assert "[70 lines truncated" in cut and cut.endswith("l299")
    assert value(spark, C.truncated_body("b", "s"), b=body, s=250) == body
    assert value(spark, C.token_estimate("b", "f"), b="ééé", f="a.rs") == 2
    assert value(spark, C.compact_signature("b"), b="a   b\n c") == "a b c"


def test_terms():
    assert search.terms("a|b, c<x,y>") == ["a", "b", "c<x,y>"]
    assert search.terms(" , |") == []


FILES = "file_id long, path string, content string"


@pytest.fixture
def files(spark):
    return spark.createDataFrame([(1, "u/lanes.ts", "export const lanes = getServerId();\nrun()"), (2, "u/remote.ts", "const x = 1;"), (3, "u/web.ts", "export const web = 2;"), (4, "u/null.ts", None)], FILES)


def test_missing(files):
    assert {r["file_id"] for r in search.missing(files, "getServerId|zzz").collect()} == {2, 3}
    assert {r["file_id"] for r in search.missing(files, "getServerId", "export const").collect()} == {3}


def test_literals_and_enclosing(files, make_symbols):
    s = make_symbols({"file": "u/lanes.ts", "name": "outer", "file_id": 1, "sid": 5, "end_line": 2}, {"file": "u/lanes.ts", "name": "inner", "file_id": 1, "sid": 6, "start_line": 2, "end_line": 2})
    hits = search.literal_hits(files, ["run(", "web"])
    assert {(r["file_id"], r["line"], r["sid"]) for r in search.enclosing(hits, s).collect()} == {(1, 2, 6), (3, 1, None)}
    assert [r["term"] for r in search.unmatched(["lanes", "nope"], s, files).collect()] == ["nope"]
    assert search.sweep(files, ["run("]).first()["text"] == "run()"


def test_line_slices(files, spark):
    r = spark.createDataFrame([(1, 2, 1), (1, 0, 1), (1, 9, 12)], "file_id long, first long, last long")
    assert {(x["first"], x["last"], x["text"]) for x in search.line_slice(files, r).collect()} == {(1, 2, "export const lanes = getServerId();\nrun()"), (1, 1, "export const lanes = getServerId();")}


def test_budget(spark):
    d = spark.createDataFrame([(1, "aaa\nbb\ncccccc\nd"), (2, ""), (3, None)], "doc_id long, text string")
    assert {(r["doc_id"], r["kept"], r["lines"]) for r in search.budget_cut(d, "doc_id", "text", 8).collect()} == {(1, 2, 4), (2, 0, 0), (3, 0, 0)}


def test_first_party_imports(spark):
    i = spark.createDataFrame([(1, "@/db/x"), (2, "@/"), (3, "react"), (4, "our/pkg/deep"), (5, "our/pkgs"), (6, "~lib"), (7, "~libs"), (8, None), (9, "#a.ts")], "id long, spec string")
    p = spark.createDataFrame([("@/", "", True), ("~lib", "", False), ("#", ".ts", True), ("#a.t", ".ts", True)], "prefix string, suffix string, wildcard boolean")
    k = spark.createDataFrame([("our/pkg",)], "package string")
    assert {r["id"] for r in search.first_party(i, p, k).collect()} == {1, 2, 4, 6, 9}


def test_ledger(spark):
    text = "intro\n## Epics\n- one\n## Known Debt\n- a <- b -> c\n- [ ] d\n~~x~~\n- [accepted] k <- l -> m\nno bullet\n- a <- b\n- <- b -> c"
    d = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    rows = ledger.sections(d)
    assert {(r["line"], r["section"]) for r in rows.collect()} >= {(1, ""), (3, "epics"), (5, "debt"), (11, "debt")}
    got = {r["line"]: r["reason"] for r in rows.where("section = 'debt'").select("line", ledger.lint_reason("text").alias("reason")).collect()}
    assert got == {5: None, 6: "checkbox", 7: "strikethrough", 8: None, 9: "missing bullet", 10: "missing ->", 11: "empty what"}
    left = {r["doc_id"]: r["text"] for r in ledger.resolved(d, "K <- L").collect()}
    assert left == {1: text.replace("\n- [accepted] k <- l -> m", ""), 2: ""}
    accepted = rows.select(*ledger.debt_fields("text")).where(ledger.is_accepted("what")).collect()
    assert [r["what"] for r in accepted] == ["[accepted] k"]


def test_markers(spark):
    f = spark.createDataFrame([(1, "a.py", "x = '# todo: no'\n# todo: a <- b -> c\n"), (2, "b.rs", "fn f<'a>() {} // TODO: x <- y\nlet s = \"// todo: z\";"), (3, "c.sql", "-- todo: q <- r -> s */")], FILES)
    assert {(r["file_id"], r["line"], r["what"], r["reason"]) for r in ledger.markers(f, "todo").collect()} == {(1, 2, "a", None), (2, 1, "x", "missing ->"), (3, 1, "q", None)}


def test_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("d", "4"), ("c", None)], "path string, hash string")
    assert {(r["path"], r["status"]) for r in store.changes(old, new).collect()} == {("a", "same"), ("b", "changed"), ("d", "new"), ("c", "same")}


def test_versioned_table(spark, tmp_path):
    t = store.Versioned(spark, f"file://{tmp_path}/t")
    assert t.read() is None
    a = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string")
    assert {r["status"] for r in t.merge(a).collect()} == {"new"}
    b = spark.createDataFrame([("a", "1"), ("b", "9")], "path string, hash string")
    assert {(r["path"], r["status"]) for r in t.merge(b).collect()} == {("a", "same"), ("b", "changed")}
    assert {tuple(r) for r in t.read().collect()} == {("a", "1"), ("b", "9")}
    t.purge()
    assert t.read().count() == 2
    assert store.Versioned(spark, f"file://{tmp_path}/t", 2).read() is None


def test_scan(spark, tmp_path):
    for p, c in {"src/a.rs": b"fn a() {}", "src/b.txt": b"x", "node_modules/c.js": b"x", ".hid/d.py": b"x", "src/bad.py": b"\xff\xfe"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(c)
    assert [r["path"] for r in store.scan(spark, str(tmp_path)).collect()] == ["src/a.rs"]
    assert {r["path"] for r in store.scan(spark, str(tmp_path), content=False).collect()} == {"src/a.rs", "src/bad.py"}


def test_fnv(spark):
    def one(text):
        h = store.FNV_OFFSET
        for x in text.encode():
            h = ((h ^ x) * store.FNV_PRIME) % (1 << 64)
        return f"{h:016x}"

    texts = ["", "a", "foobar", "größer", "x" * 500]
    f = spark.createDataFrame([*enumerate(texts), (9, None)], "file_id long, content string")
    got = {r["file_id"]: r["fnv"] for r in store.fnv1a(f, "file_id", "content").collect()}
    assert got == {**{i: one(t) for i, t in enumerate(texts)}, 9: None}


def test_extraction(spark):
    py = "import os\n\nLIMIT = 3\n\nclass A(Base):\n    @cached\n    def run(self):\n        return helper(self.x)\n\n\ndef helper(\n    v,\n):\n    \"\"\"def no():\"\"\"\n    if v:\n        print(v)\n        again(v); again(v, w)\n"
    rs = "#[derive(Debug)]\npub struct S {\n    x: u8,\n}\n\nimpl<T> Tr for S {\n    /// Goes.\n    pub fn go(&self) -> u8 {\n        other(1);\n        S::new(2).go_on::<u8>();\n        println!(\"{}\", inner(3));\n        self.x\n    }\n}\n"
    go = "package m\n\ntype (\n\tA struct {\n\t\tx int\n\t}\n\tB = string\n)\n\nfunc (s *S) Do(a int) error {\n\treturn call(a, b.c)\n}\n\nconst K = 1\n"
    ts = "export class C {\n  private n = 1;\n  constructor(private q: Q) {}\n  go(a: number) {\n    if (a) { run(a); }\n    return new Thing(a).start();\n  }\n}\n\nexport const f = async (x) => {\n  await g(x);\n};\nconst api = build({\n  list() { return 1; },\n});\nconst { p, q: r } = api\nconst T = `\na {\n`;\n"
    f = spark.createDataFrame([(1, "a.py", py), (2, "b.rs", rs), (3, "c.go", go), (4, "d.ts", ts), (5, "e.md", "x"), (6, "n.py", None), (7, "z.ts", ""), (8, "broken.rs", "fn a() {\n    b(;\n")], FILES)
    rows = extract.declarations(f).collect()
    got = {(r["file_id"], r["kind"], r["name"]): (r["start_line"], r["end_line"], sorted(r["calls"])) for r in rows}
    assert got[1, "class", "A"] == (5, 8, ["helper"]) and got[1, "method", "A::run"] == (6, 8, ["helper"])
    assert got[1, "function", "helper"] == (11, 17, ["again"]) and got[1, "constant", "LIMIT"][:2] == (3, 3)
    assert got[2, "struct", "S"][:2] == (1, 4) and got[2, "method", "S::go"] == (7, 13, ["S", "S::new", "go_on", "inner", "new", "other"])
    assert got[3, "struct", "A"][:2] == (4, 6) and got[3, "type", "B"][:2] == (7, 7)
    assert got[3, "method", "S::Do"] == (10, 12, ["call"]) and got[3, "constant", "K"][:2] == (14, 14)
    assert got[4, "method", "C::go"] == (4, 7, ["Thing", "Thing::constructor", "run", "start"]) and got[4, "function", "f"] == (10, 12, ["g"])
    assert got[4, "field", "C::n"][:2] == (2, 2) and got[4, "field", "C::q"][:2] == (3, 3) and got[4, "method", "C::constructor"]
    assert got[4, "variable", "api"][:2] == (13, 15) and got[4, "method", "api.list"] and got[4, "variable", "p"] and got[4, "variable", "r"]
    assert got[4, "constant", "T"][:2] == (17, 19) and got[8, "function", "a"] == (1, 2, ["b"])
    assert {k[0] for k in got} == {1, 2, 3, 4, 8}
    by = {(r["file_id"], r["name"]): r for r in rows}
    assert by[1, "helper"]["call_counts"] == {"again": 2} and by[4, "C::go"]["member_calls"] == ["start"]
    assert {"b", "c"} & set(by[3, "S::Do"]["mentions"]) and "x" in by[2, "S::go"]["mentions"] and by[1, "helper"]["signature"] == "def helper( v, ):"


def test_only_stale_files_are_extracted_again(spark):
    schema = "file_id long, repo_id long, path string, hash string, content string"
    old = spark.createDataFrame([(1, 1, "a.py", "x", "def one():\n    two()\n"), (2, 1, "b.py", "y", "def two():\n    pass\n"), (3, 1, "c.py", "z", "def gone(): pass\n")], schema)
    new = spark.createDataFrame([(1, 1, "a.py", "x", "def one():\n    two()\n"), (2, 1, "b.py", "y2", "def two():\n    one()\n"), (4, 1, "d.py", None, "def four(): pass\n")], schema)
    before = extract.symbols_of(old).withColumn("signature", F.lit("kept")).cache()
    got = extract.refreshed(old, new, before)
    same = lambda df: {(r["sid"], r["name"], tuple(r["calls"])) for r in df.collect()}
    assert same(got) == same(extract.symbols_of(new))
    assert {r["name"] for r in got.where("signature = 'kept'").collect()} == {"one"}


def test_imports(spark):
    py = "import os, a.b as ab\nfrom .near import (\n    one,\n    two as second,\n)\n"
    ts = "import D, { x as y, z } from './local/mod';\nimport * as ns from 'pkg';\nimport type {\n  T,\n} from '../types';\nconst { r: s } = require('lib');\nimport 'side';\n"
    rs = "use crate::deep::{\n    a::One,\n    Two as Other,\n};\nuse serde::*;\npub use std::fmt;\n"
    go = "package m\n\nimport (\n\t\"fmt\"\n\tq \"host.example/x/quick\"\n)\n"
    f = spark.createDataFrame([(1, "a.py", py), (2, "d.ts", ts), (3, "b.rs", rs), (4, "c.go", go), (5, "n.go", None)], FILES)
    got = {(r["file_id"], r["name"], r["alias"], r["external"]) for r in extract.imports(f).collect()}
    assert got == {
        (1, "os", None, True), (1, "a.b", "ab", False), (1, "one", None, False), (1, "two", "second", False),
        (2, "D", None, False), (2, "x", "y", False), (2, "z", None, False), (2, "ns", None, True), (2, "T", None, False), (2, "r", "s", True),
        (3, "One", None, False), (3, "Two", "Other", False), (3, "fmt", None, True), (4, "fmt", None, True), (4, "quick", "q", False),
    }


def test_graph_from_a_folder(spark, tmp_path):
    """Files are scanned, extracted and resolved; an aliased call reaches its original by the module hint."""
    for name, text in {"src/app.ts": "import { load as fetchIt } from './store';\nimport { join } from 'path';\nexport function run() {\n  fetchIt(1);\n  join(2);\n}\n", "src/store.ts": "export function load(x) {\n  return x;\n}\n", "src/other.ts": "export function load(x) {\n  return x;\n}\n", "node_modules/q.ts": "export function run() {}\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    files = store.scan(spark, str(tmp_path)).select(F.xxhash64("path").alias("file_id"), F.lit(1).cast("long").alias("repo_id"), "path", "content")
    s = extract.symbols_of(files).cache()
    names = {r["sid"]: (r["file"], r["name"]) for r in s.collect()}
    got = {r["ref"]: (r["outcome"], names.get(r["dst"])) for r in graph.resolve(s).collect()}
    assert got == {"store:load": ("hinted", ("src/store.ts", "load")), "join": ("external", None)}


def test_stream_keeps_the_store_in_step(spark, tmp_path):
    schema = "file_id long, path string, hash string, ingested_at timestamp_ntz"
    rows = lambda *r: spark.createDataFrame(list(r), "file_id long, path string, hash string, at string").select("file_id", "path", "hash", F.expr("to_timestamp_ntz(at)").alias("ingested_at"))
    rows((1, "a", "x", "2025-01-01 00:00:00"), (1, "a", "x", "2025-01-02 00:00:00"), (2, "b", "y", "2025-01-01 00:00:00")).write.parquet(f"{tmp_path}/in/1")
    go = lambda: sync.follow(spark, f"{tmp_path}/in/*", f"file://{tmp_path}/store", f"{tmp_path}/cp", schema).awaitTermination(120)
    assert go()
    rows((2, "b", "z", "2025-01-03 00:00:00")).write.parquet(f"{tmp_path}/in/2")
    assert go()
    kept = store.Versioned(spark, f"file://{tmp_path}/store")
    assert {(r["path"], r["hash"]) for r in kept.read().collect()} == {("a", "x"), ("b", "z")}
    rows((2, "b", "old", "2025-01-02 00:00:00")).write.parquet(f"{tmp_path}/in/3")  # late, and older than what is stored
    assert go()
    assert {(r["path"], r["hash"]) for r in kept.read().collect()} == {("a", "x"), ("b", "z")}


def test_catalogue_imports_without_the_subpackage():
    from symloom import catalog

    assert set(catalog.SQL) <= set(catalog.QUERIES)
