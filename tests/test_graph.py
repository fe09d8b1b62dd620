"""The resolver, neighbours, ranks and traversals on small graphs."""

import pytest
from pyspark.sql import functions as F

from symloom import catalog
from symloom.functions import columns as C
from symloom.operators import diff, graph, health, traverse


def outcomes(symbols, name="caller"):
    src = symbols.where(F.col("name") == name).first()["sid"]
    return {r["ref"]: (r["outcome"], r["dst"]) for r in graph.resolve(symbols).where(F.col("src") == src).collect()}


def edge_pairs(symbols):
    return {(r["src"], r["dst"]) for r in graph.call_edges(symbols).collect()}


def test_same_file_is_preferred(make_symbols):
    s = make_symbols({"file": "a.rs", "name": "caller", "calls": ["target"]}, {"file": "a.rs", "name": "target"}, {"file": "b.rs", "name": "target"})
    assert outcomes(s) == {"target": ("same_file", 1)}


def test_unique_across_files(make_symbols):
    s = make_symbols({"file": "p/a.rs", "name": "caller", "calls": ["only_one"]}, {"file": "q/b.rs", "name": "only_one"})
    assert outcomes(s) == {"only_one": ("global", 1)}


def test_other_repository_is_not_searched(make_symbols):
    s = make_symbols({"file": "a.rs", "name": "caller", "calls": ["only_one"]}, {"file": "b.rs", "name": "only_one", "repo_id": 2})
    assert outcomes(s) == {"only_one": ("unresolved", None)}


def test_ambiguous_new_makes_no_edge(make_symbols):
    s = make_symbols({"file": "x/a.rs", "name": "caller", "calls": ["new"]}, *[{"file": f"{d}/b.rs", "name": "new"} for d in "pqr"])
    assert outcomes(s) == {"new": ("generic", None)}


def test_drop_counters(make_symbols):
    s = make_symbols({"file": "x/a.rs", "name": "caller", "calls": ["thing", "gone", "only_one"]}, {"file": "p/b.rs", "name": "thing"}, {"file": "q/b.rs", "name": "thing"}, {"file": "r/c.rs", "name": "only_one"})
    assert {k: v[0] for k, v in outcomes(s).items()} == {"thing": "ambiguous_global", "gone": "unresolved", "only_one": "global"}


def test_same_file_ambiguity(make_symbols):
    s = make_symbols({"file": "a.rs", "name": "caller", "calls": ["target"]}, {"file": "a.rs", "name": "target"}, {"file": "a.rs", "name": "M::target", "kind": "method"})
    assert outcomes(s) == {"target": ("ambiguous_file", None)}


def test_same_directory_tier(make_symbols):
    s = make_symbols({"file": "src/a/x.rs", "name": "caller", "calls": ["helper"]}, {"file": "src/a/y.rs", "name": "helper"}, {"file": "src/b/y.rs", "name": "helper"})
    assert outcomes(s) == {"helper": ("same_dir", 1)}


def test_member_calls_stay_in_the_file(make_symbols):
    s = make_symbols({"file": "a.rs", "name": "caller", "calls": ["input"], "member_calls": ["input"]}, {"file": "b.rs", "name": "input"})
    assert outcomes(s) == {"input": ("member", None)}


def test_only_callables_are_candidates(make_symbols):
    s = make_symbols({"file": "a.rs", "name": "caller", "calls": ["flag"]}, {"file": "a.rs", "name": "flag", "kind": "constant"})
    assert outcomes(s) == {"flag": ("unresolved", None)}


def test_external_import(make_symbols):
    s = make_symbols({"file": "a.ts", "name": "caller", "calls": ["key"], "external_imports": ["key"]}, {"file": "b.ts", "name": "key"})
    assert outcomes(s) == {"key": ("external", None)}


def test_recursion_is_resolved_without_an_edge(make_symbols):
    s = make_symbols({"file": "a.rs", "name": "caller", "calls": ["caller"]}, {"file": "b.rs", "name": "caller", "sid": 7})
    got = {r["src"]: r["outcome"] for r in graph.resolve(s).collect()}
    assert got == {0: "self"}


def test_short_name_self_leaves_the_other_candidate(make_symbols):
    s = make_symbols({"file": "a.rs", "name": "T::run", "kind": "method", "calls": ["run"]}, {"file": "a.rs", "name": "U::run", "kind": "method"})
    assert outcomes(s, "T::run") == {"run": ("same_file", 1)}


def test_hints(make_symbols):
    s = make_symbols(
        {"file": "app/main.ts", "name": "caller", "calls": ["./db/store:save", "lib/none:save", "x:gone"]},
        {"file": "db/store.ts", "name": "save"}, {"file": "net/store.ts", "name": "save"}, {"file": "app/main.ts", "name": "save"},
    )
    assert outcomes(s) == {"./db/store:save": ("hinted", 1), "lib/none:save": ("ambiguous_hint", None), "x:gone": ("unresolved", None)}


def test_weights(make_symbols):
    s = make_symbols(
        {"file": "a.rs", "name": "caller", "calls": ["one", "hot", "huge"], "call_counts": {"hot": 50, "huge": 1000}}, {"file": "tests/t.rs", "name": "t", "calls": ["one"]},
        {"file": "b.rs", "name": "one"}, {"file": "b.rs", "name": "hot"}, {"file": "b.rs", "name": "huge"},
    )
    w = {(r["src"], r["dst"]): round(r["w"], 6) for r in graph.call_edges(s).collect()}
    assert w == {(0, 2): 1.0, (0, 3): round(50**0.5, 6), (0, 4): 8.0, (1, 2): 0.25}


def test_nulls_and_empty(make_symbols, spark):
    s = make_symbols({"file": "a.rs", "name": None, "calls": None}, {"file": "b.rs", "name": "x", "calls": [None, "y"], "member_calls": None, "external_imports": None, "call_counts": None})
    assert [r["outcome"] for r in graph.resolve(s).collect()] == ["unresolved"]
    assert graph.call_edges(s.limit(0)).count() == 0


def test_mentions_are_not_edges(make_symbols):
    s = make_symbols({"file": "c.ts", "name": "serverId", "kind": "constant"}, *[{"file": f"r{i}.ts", "name": f"reader{i}", "mentions": ["serverId"]} for i in range(12)])
    assert edge_pairs(s) == set()
    assert graph.mentioners(s, s.where("name = 'serverId'")).count() == 12


def test_constructors_fold_in(make_symbols):
    s = make_symbols({"file": "e.ts", "name": "E", "kind": "class"}, {"file": "e.ts", "name": "E::constructor", "kind": "method"}, {"file": "f.ts", "name": "E::constructor", "kind": "method"})
    got = {(r["target"], r["sid"]) for r in graph.with_constructors(s, s.where("name = 'E'")).collect()}
    assert got == {(0, 0), (0, 1)}


@pytest.fixture
def chain(make_symbols):
    return make_symbols(
        {"file": "db.rs", "name": "query", "signature": "pub fn query()"}, {"file": "service.rs", "name": "serve", "calls": ["query"], "start_line": 10, "body": "fn serve() {\n  // query()\n  let x = query(1);\n  my_query();\n}"},
        {"file": "controller.rs", "name": "control", "calls": ["serve"]}, {"file": "main.rs", "name": "main", "calls": ["control"]}, {"file": "tests/test_db.rs", "name": "test_query", "calls": ["query"]},
    )


def test_reach_and_depth(chain):
    e, seeds = graph.call_edges(chain), chain.where("name = 'query'").select(F.col("sid").alias("source"), "sid")
    assert {(r["sid"], r["depth"]) for r in traverse.reach(e, seeds, 3).collect()} == {(0, 0), (1, 1), (4, 1), (2, 2), (3, 3)}
    assert {r["sid"] for r in traverse.reach(e, seeds, 1).collect()} == {0, 1, 4}
    down = chain.where("name = 'main'").select(F.col("sid").alias("source"), "sid")
    assert {(r["sid"], r["depth"]) for r in traverse.reach(e, down, 9, up=False).collect()} == {(3, 0), (2, 1), (1, 2), (0, 3)}


def test_reach_ends_in_cycles(make_symbols):
    s = make_symbols({"file": "a.rs", "name": "a", "calls": ["b"]}, {"file": "a.rs", "name": "b", "calls": ["a"]})
    e = graph.call_edges(s)
    got = traverse.reach(e, s.select(F.col("sid").alias("source"), "sid"), 50)
    assert {(r["source"], r["sid"], r["depth"]) for r in got.collect()} == {(0, 0, 0), (1, 1, 0), (0, 1, 1), (1, 0, 1)}


def test_call_sites_skip_head_and_comments(chain, spark):
    pairs = spark.createDataFrame([(0, 1, ["query"])], "source long, sid long, names array<string>")
    assert [(r["sid"], r["line"]) for r in traverse.call_sites(chain, pairs).collect()] == [(1, 12)]


def test_health(chain):
    e = graph.call_edges(chain)
    d = health.degrees(chain, e)
    assert {r["name"] for r in health.entry_points(d).collect()} == {"main"}
    assert {r["name"] for r in health.sinks(d).collect()} == {"query"}
    t = health.totals(d, e).first()
    assert (t["files"], t["symbols"], t["edges"], t["isolated"]) == (5, 5, 4, 0)
    assert [r["sid"] for r in health.hubs(d).orderBy("place").collect()][0] == 0


def test_dead_weight_tiers(make_symbols):
    s = make_symbols({"file": "a.rs", "name": "lonely"}, {"file": "a.rs", "name": "Shape", "kind": "struct"}, {"file": "app/page.tsx", "name": "Page"}, {"file": "r.ts", "name": "userRouter"}, {"file": "tests/t.rs", "name": "t"}, {"file": "m.rs", "name": "main"})
    d = health.degrees(s, graph.call_edges(s))
    assert {(r["name"], r["tier"]) for r in health.dead_weight(d).collect()} == {("lonely", "likely"), ("Shape", "review")}


def brute_rank(n, pairs, prior, rounds):
    out = {}
    for a, b, w in pairs:
        out.setdefault(a, []).append((b, w))
    r = [1 / n] * n
    for _ in range(rounds):
        loose = sum(r[i] for i in range(n) if i not in out)
        new = [0.15 * prior[i] + 0.85 * loose * prior[i] for i in range(n)]
        for a, ts in out.items():
            for b, w in ts:
                new[b] += 0.85 * r[a] * w / sum(x for _, x in ts)
        r = new
    return r


def test_pagerank(chain):
    nodes = chain.select("repo_id", "sid", C.is_test().alias("is_test"))
    e = graph.call_edges(chain)
    pairs = [(r["src"], r["dst"], r["w"]) for r in e.collect()]
    p = [1, 1, 1, 1, 0.25]
    r = brute_rank(5, pairs, [x / sum(p) for x in p], 12)
    r[4] *= 0.25
    want = [x / sum(r) for x in r]
    got = {x["sid"]: x["rank"] for x in traverse.pagerank(nodes, e, rounds=12, tolerance=0).collect()}
    assert all(abs(got[i] - want[i]) < 1e-9 for i in range(5))
    focus = traverse.pagerank(nodes, e, tolerance=1e-3, focus=chain.where("name = 'main'").select("sid"))
    got = {x["sid"]: x["rank"] for x in focus.collect()}
    want = brute_rank(5, pairs, [0, 0, 0, 1, 0], 100)
    assert all(abs(got[i] - want[i]) < 1e-2 for i in range(5))


def test_same_graph_twice_is_the_same(chain):
    rows = lambda: sorted(map(tuple, graph.call_edges(chain.repartition(3)).collect()))
    assert rows() == rows()


def test_diff(chain, spark):
    h = spark.createDataFrame([(1, "db.rs", 1, 1), (2, "gone.rs", 1, 9), (3, "service.rs", 2, 9)], "hunk_id long, file string, first long, last long")
    touched = diff.mutated(chain, h)
    assert {(r["hunk_id"], r["sid"]) for r in touched.collect()} == {(1, 0)}
    got = {(r["sid"], r["depth"]) for r in diff.affected(graph.call_edges(chain), touched).collect()}
    assert got == {(1, 1), (4, 1), (2, 2), (3, 3)}


def test_map_limit(make_symbols):
    s = make_symbols({"file": "a.rs", "name": "x", "centrality": 0.5}, {"file": "b.rs", "name": "y", "centrality": 0.7}, {"file": "a.rs", "name": "z", "centrality": None})
    rows = health.module_map(s, limit=2).orderBy("place").collect()
    assert [(r["file"], r["symbols"], r["kept"], r["total"]) for r in rows] == [("b.rs", "function y", 1, 3), ("a.rs", "function x", 1, 3)]


def folder_of(symbols, tmp_path):
    symbols.withColumnRenamed("sid", "symbol_id").write.parquet(f"{tmp_path}/symbols.parquet")
    return str(tmp_path)


def test_blast_down_starts_from_every_caller(spark, make_symbols, tmp_path):
    calls = {"a": ["b", "c"], "b": ["d"], "c": ["d", "a"], "d": ["e"], "e": ["f"], "f": [], "g": ["b"], "alone": []}
    names = list(calls)
    s = make_symbols(*[{"file": "a.rs", "name": n, "calls": c} for n, c in calls.items()], {"file": "z.rs", "name": "y", "calls": ["x"], "repo_id": 2}, {"file": "z.rs", "name": "x", "repo_id": 2})
    to = {i: [names.index(c) for c in calls[n]] for i, n in enumerate(names)} | {8: [9], 9: []}
    want = set()
    for source in (i for i in to if to[i]):
        depth, frontier = {source: 0}, [source]
        for d in (1, 2, 3):
            frontier = [y for x in frontier for y in to[x] if y not in depth and not depth.update({y: d})]
        want |= {(source, x, d, not to[x]) for x, d in depth.items()}
    rows = [(r["source"], r["sid"], r["depth"], r["is_sink"]) for r in catalog.QUERIES["blast_down_3"](spark, folder_of(s, tmp_path)).collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_registered_ranks_converge(spark, make_symbols, tmp_path):
    """A chain whose ranks still move after eight rounds."""
    n = 10
    rows = [{"file": "a.rs" if i < n - 1 else "bridge.rs", "name": f"f{i}", "calls": [f"f{i + 1}"] if i < n - 1 else []} for i in range(n)]
    rows[0]["file"] = "bridge.rs"
    rows[3] |= {"calls": ["f4", "f8"], "call_counts": {"f4": 9}}
    s = make_symbols(*rows)
    folder = folder_of(s, tmp_path)
    e = [(r["src"], r["dst"], r["w"]) for r in graph.call_edges(s).collect()]
    flat = [1 / n] * n
    wants = {
        "pagerank_global": brute_rank(n, e, flat, 1000),
        "pagerank_focus": brute_rank(n, e, [0.5] + [0.0] * (n - 2) + [0.5], 1000),
        "pagerank_unweighted": brute_rank(n, [(a, b, 1.0) for a, b, _ in e], flat, 1000),
    }
    assert len(e) == n and wants["pagerank_global"] != wants["pagerank_unweighted"]
    for name, want in wants.items():
        got = {r["sid"]: r["rank"] for r in catalog.QUERIES[name](spark, folder).collect()}
        assert sum(abs(got[i] - want[i]) for i in range(n)) < 5e-5, name  # ranks are rounded to six digits
