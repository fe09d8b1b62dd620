"""Problems 1, 2 and 5."""

import ast
import random

import pytest

from symloom.llm import bodies, docs, gll, handmade, parses

FILES = "file_id long, repo_id long, path string, content string, lines string, reason string, valid string"
CODE = "".join(f"def step_{i}(a, b):\n    total = a + {i}\n    if total > b:\n        return combine(total, b)\n    return total * {i}\n\n" for i in range(12))
OTHER = "".join(f"def other_{i}(x):\n    value = lookup(x, {i})\n    for item in value:\n        yield item + {i}\n\n" for i in range(12))


def reasons(spark, *rows):
    df = spark.createDataFrame([(i, r[0], r[1], r[2], None, None, None) for i, r in enumerate(rows)], FILES)
    return {r["file_id"]: r["reason"] for r in handmade.not_by_hand(df).collect()}


def test_marks(spark):
    data = "TABLE = [\n" + "".join(f"    {i * 7919 % 65536}, {i}, {i * 31},\n" for i in range(200)) + "]\n"
    kept = "TABLE = [\n" + "".join(f"    {i},  # measured in run {i}\n" for i in range(20)) + "]\n" + CODE
    mini = "".join(f"function f{i}(a,b){{return a.x({i},b)||{i}}}var q{i}=[{i},2,3];" for i in range(60))
    stamped = "class A(object):\n" + "".join(f"    def get_field_{i}(self):\n        return self.q.pull({10000 + i}, 0x{i:02d}ab12cd34)\n\n" for i in range(20))
    got = reasons(
        spark,
        (1, "a/gen.py", "# Code generated by tool 1.2 from x.schema. DO NOT EDIT.\n" + CODE), (1, "a/hand.py", "# Do not edit the limits below without telling us.\n" + CODE), (1, "a/reads.py", "# Reads machine-generated logs, see the notes.\n" + CODE),
        (1, "a/data.py", data), (1, "a/kept.py", kept), (1, "a/app.js", mini), (1, "a/stamped.py", stamped), (1, "a/empty.py", ""), (1, "a/null.py", None), (None, None, None), (1, "a/stub.py", "def f():\n    '''Auto-generated method stub'''\n"), (1, "a/de.py", "# Diese Datei wird von x automatisch erzeugt. Änderungen gehen verloren.\nx = f(1)\n"),
    )
    assert got == {0: "generated", 3: "data", 5: "minified", 6: "generated", 11: "generated"}


def test_copies(spark):
    edited = CODE.replace("combine", "merge", 3)
    got = reasons(spark, (1, "a/vendor/lib/x.py", CODE), (2, "b/src/y.py", edited), (3, "c/src/z.py", OTHER), (4, "d/src/plain.py", OTHER + "# more\n"), (5, "e/src/small.py", "x = 1\n"), (6, "f/vendor_portal/w.py", CODE.replace("step", "walk").replace("total", "sum").replace("combine", "join")))
    # the group of z and plain shows no sign of another project
    assert got == {0: "vendored", 1: "vendored"}
    notice = "# plumlib v1.2 | (c) the plumlib authors | released under a licence\n"
    got = reasons(spark, (1, "a/src/x.py", notice + CODE), (2, "plumlib/src/y.py", notice + OTHER), (3, "c/deps/q-1.0/z.py", CODE.replace("step", "move")))
    assert got == {0: "vendored", 2: "vendored"}


def test_a_third_of_all_files_is_one_text(spark):
    rows = [(i, f"r{i}/deps/p/x.py", CODE) if i % 3 == 0 else (i, f"r{i}/x.py", f"value_{i} = compute({i})\n" * 9) for i in range(30)]
    assert {k for k, v in reasons(spark, *rows).items() if v == "vendored"} == {i for i in range(30) if i % 3 == 0}


@pytest.mark.parametrize(
    ("line", "tool"),
    [
        ("Code generated by protoc-gen-go. DO NOT EDIT.", True), ("@generated", True), ("DO NOT EDIT", True), ("Do not edit by hand: generated from a.proto", True), ("This code must not be edited manually, it is generated by x", True), ("This file was written out by loom; changes will be lost", True),
        ("Created by a person in 2019", False), ("Parses the code generated by protoc.", False), ("The list is generated from the index, then sorted", False), ("This file is kept by hand, do not regenerate", False), ("Auto-generated method stub", False), ("Do not edit the limits below", False),
    ],
)
def test_notices_of_tools(line, tool):
    assert handmade._tool_notice(line) == tool


def linked(files, share=0.6):
    """Components by comparing all pairs of files of different repositories."""
    lines = {f: {x.strip() for x in text.split("\n") if len(x.strip()) >= handmade.LEAST_LINE} for f, _, text in files}
    repo = {f: r for f, r, _ in files}
    group = {f: f for f in lines}
    for a in lines:
        for b in lines:
            n = len(lines[a])
            if repo[a] != repo[b] and n >= 3 and len(lines[b]) >= 3 and len(lines[a] & lines[b]) >= max(3, share * n):
                x, y = group[a], group[b]
                group = {k: (x if v == y else v) for k, v in group.items()}
    return group


def test_copies_equal_all_pairs(spark):
    random.seed(11)
    pool = [f"shared statement number {i}" for i in range(60)]
    for trial in range(3):
        files = []
        for i in range(45):
            base = random.choice((0, 20, 40))
            kept = random.sample(pool[base : base + 20], random.randint(4, 14)) if i % 3 else []
            own = [f"own line {trial} {i} {k} of this file" for k in range(random.randint(0, 8))]
            common = random.sample(["return None here", "import os, sys, re", "value = compute()"], random.randint(0, 3))
            files.append((i, i % 7, "\n".join(kept + own + common)))
        files.append((100, 50, files[1][2]))
        group = linked(files)
        signs = {files[k][0] for k in (1, 17, 32)}
        want = {f for f in group if any(group[f] == group[s] for s in signs)}
        rows = [(f, r, f"r{r}/deps/x{f}.py" if f in signs else f"r{r}/x{f}.py", t, None, None, None) for f, r, t in files]
        got = {r["file_id"] for r in handmade.not_by_hand(spark.createDataFrame(rows, FILES)).where("reason = 'vendored'").collect()}
        assert got == want


def test_shared_lines_that_others_have_too(spark):
    """A copy at the very limit, whose shared lines mostly stand in other files as well."""
    body = [f"line {i} of the library" for i in range(12)]
    a = body + [f"first {i} edits of mine" for i in range(8)]
    b = body + [f"second {i} edits of mine" for i in range(8)]
    rows = [(5, "m/deps/a.py", a), (6, "n/b.py", b), (1, "c/low.py", body[:7] + [f"low {i} other things" for i in range(30)]), (9, "z/high.py", body[:7] + [f"high {i} other things" for i in range(30)])]
    got = reasons(spark, *[(r, p, "\n".join(x)) for r, p, x in rows])
    assert got == {0: "vendored", 1: "vendored"}


def test_signs_go_through_a_chain_of_edits(spark):
    lines = [f"statement {i} of the chain" for i in range(40)]
    rows = [(i, f"r{i}/{'vendor/' if i == 0 else ''}x.py", "\n".join(lines[3 * i : 3 * i + 10])) for i in range(6)]
    assert set(reasons(spark, *rows)) == {0, 1, 2, 3, 4, 5}


def test_no_files(spark):
    df = spark.createDataFrame([], FILES)
    assert handmade.not_by_hand(df).count() == 0
    assert parses.parse_files(df).count() == 0


# -- problem 2
SAYS = "Walks every node reachable from the root and returns those that still miss a parent."


@pytest.mark.parametrize(
    ("file", "body", "found"),
    [
        ("a.py", f'def f(x):\n    """{SAYS}"""\n    return x\n', True), ("a.py", f"def f(x):\n    # {SAYS}\n    return x\n", False), ("a.py", f'def f(x):\n    def g():\n        """{SAYS}"""\n    return g\n', False),
        ("a.py", f"@cached(a=[1, 2])\nasync def f(\n    x: dict[str, int] = {{}},\n) -> int:\n    r'''\n    {SAYS}\n    '''\n", True), ("a.py", f'def f(): "{SAYS}"', True), ("a.py", 'def f():\n    """TODO: move the handling of this out of here."""\n', False), ("a.py", f'def f(x:\n    """{SAYS}"""\n', False),
        ("a.rs", f"/// {SAYS}\n#[inline]\npub fn f<'a>(x: &'a str) -> u8 {{ 1 }}", True), ("a.rs", f"// {SAYS}\nfn f() {{}}", False), ("a.rs", f"#[cfg(x)]\n/// {SAYS}\n/// TODO: more.\nfn f() {{}}", True), ("a.rs", f'#[doc = "{SAYS}"]\nfn f() {{}}', True), ("a.rs", f"fn f() {{\n    /// {SAYS}\n}}", False),
        ("a.go", f"// f {SAYS}\nfunc f() {{}}", True), ("a.go", f"// {SAYS}\n\nfunc f() {{}}", False), ("a.go", "//nolint:errcheck and some more words that say nothing\nfunc f() {}", False), ("a.go", f"/*\nf {SAYS}\n*/\nfunc (x *T) f(a map[string]int) error {{ return nil }}", True),
        ("a.ts", f"/** {SAYS} */\nexport async function f(a: Map<string, number>): Promise<void> {{}}", True), ("a.ts", f"/**\n * {SAYS}\n * @returns x\n */\n// eslint-disable-next-line\nconst f = async () => {{}};", True), ("a.ts", f"// {SAYS}\nfunction f() {{}}", False), ("a.ts", f"/* {SAYS} */\nfunction f() {{}}", False),
        ("a.js", "/**\n * @param value the value of the thing\n * @returns nothing of any interest here\n */\nfunction f() {}", False), ("a.js", "/** getWarmNodeParentList returns the warm node parent list */\nfunction getWarmNodeParentList() {}", False), ("a.txt", f"/** {SAYS} */ function f() {{}}", False), ("a.js", "", False),
    ],
)
def test_own_documentation(file, body, found):
    name = "getWarmNodeParentList" if "getWarm" in body else "f"
    assert (docs.pair(body, name, file) is not None) == found


def test_head_of_a_broken_file():
    code, text, dropped = docs.pair("/** " + SAYS + " */\n)) function f(a { return 1 }", "f", "a.js")
    assert text == SAYS and "function f" in code


WHOLE = {
    "py": "async def f(a: int, *b, c=(1, 2), **d) -> dict[str, int]:\n    x, y = [i for i in a if i and not b], lambda q: q + 1\n    with open(x) as g, h: pass\n    if (n := y(x)) > 3: return {**d, 'k': x[1:2, ::3]}\n    elif n not in b:\n        raise E(f'{n}') from None\n    else:\n        yield await n\n    while True: break\n    try:\n        del x[0]; a += -1\n    except (A, B) as e:\n        global z\n    return x if y else z\n",
    "rs": "#[inline]\npub(crate) async fn f<'a, T: Fn(u8) -> u8>(x: &'a mut [T; 3], y: Vec<Vec<u8>>) -> Result<(), E> where T: Copy {\n    let Some(v) = x.get(0)? else { return Err(E::new(1)) };\n    for (i, c) in y.iter().enumerate() { if c[i] > 3 && !v { continue; } }\n    match v { 1..=3 | 5 if a > b => { go() } S { a, .. } => 'q', _ => vec![1; 3].len(), }\n    let g = |a: u8, b| -> u8 { *a + b };\n    loop { println!(\"{}\", g(1, 2)); break }\n    Ok(())\n}\n",
    "go": "func (t *T[K]) F(a ...int) (x int, err error) {\n\tif v, ok := m[a[0]]; ok && !v {\n\t\treturn 1, nil\n\t}\n\tfor i := range 10 {\n\t\tswitch x := y.(type) {\n\t\tcase int, []byte:\n\t\t\ti++\n\t\tdefault:\n\t\t\tgo func() { ch <- <-d }()\n\t\t}\n\t}\n\tvar s = map[string][]int{\"a\": {1}}\n\tselect {\n\tcase <-c:\n\t\tdefer u.Unlock()\n\t}\n\treturn len(s), &E{A: 1}\n}\n",
    "ts": "export async function f<T extends K>(a: Map<string, T[]>, b?: number, ...c: any[]): Promise<void> {\n  const { x, y: z = 1, ...r } = await g(a), [d, , e] = b;\n  for (const [k, v] of a) if (v) continue; else break;\n  try { throw new E(`${x}`) } catch { } finally { i++; }\n  const h = async (q: T) => ({ ...q, n: q?.m ?? 2, [k]: q! as U });\n  switch (x) { case 1: case 'a': return; default: y = typeof z; }\n  do { x ||= y ? z : -1 } while (x < 3)\n  label: while (1) { delete r.q }\n  return /[/]a+/.test(x) && (function () { return 1 })();\n}\n",
}


@pytest.mark.parametrize(("form", "text"), WHOLE.items())
def test_whole_functions_have_a_reading(form, text):
    assert bodies.parse(text, form) == (0, len(text.rstrip()) if form != "py" else len(text))


@pytest.mark.parametrize(
    ("form", "text"),
    [
        ("ts", "function f(x) { return x +* (; }"), ("ts", "function f(x) { return ((; }}}"), ("ts", "function f(x) { return x"), ("ts", "function f(x) { let a = = 1; }"), ("ts", "function f(x) { if (x { } }"), ("py", "def f(x):\n    return x +\n"), ("py", "def f(x):\n    y = (x, [1)\n"), ("py", "def f(x)\n    return x\n"),
        ("go", "func f() {\n\tx := \n}"), ("go", "func f() {\n\treturn a b c)\n}"), ("rs", "fn f() { let x = ; }"), ("rs", "fn f() { match x { 1 => } "),
    ],
)
def test_broken_functions_are_counted(form, text):
    assert bodies.parse(text, form)[0] > 0


def test_a_function_ends_with_its_body():
    body = f"/** {SAYS} */\nfunction f(a) {{ return {{ a }}; }}\n<<<<<<< HEAD\nfunction g( {{"
    code, text, faults = docs.pair(body, "f", "a.cjs")
    assert code == "\nfunction f(a) { return { a }; }" and text == SAYS and faults > 0
    assert docs.pair(body[: body.index("<<<")], "f", "a.cjs")[2] == 0
    assert docs.pair(f"/** {SAYS} */\nfunction f(a) {{ if (a) {{ return 1", "f", "a.js")[2] == 2


def test_gll_accepts_ambiguous_and_left_recursive_grammars():
    p = gll.Parser(gll.grammar("S: S S | x | -"), "S")
    assert p.spans("xxxx", "S")[0][0] == (0, 4)
    e = gll.Parser(gll.grammar("E: E + E | n"), "E")
    assert e.spans("n+n+n", "E") and e.spans("n++n", "E")[1] == [2]


def test_templates_are_dropped(spark):
    schema = "symbol_id long, name string, kind string, file string, body string, key string, code string"
    body = '"""{}"""'
    rows = [(i, f"name_{i}", "function", "a.py", f"def name_{i}():\n    " + body.format("The usual words stand here for every such thing."), None, None) for i in range(30)]
    rows += [(100 + i, "same", "method", "a.py", "def same():\n    " + body.format("Real words that only copies of one function share."), None, None) for i in range(30)]
    rows += [(200, None, "function", "a.py", "def q():\n    " + body.format(SAYS), None, None), (200, None, "function", "a.py", "def q():\n    " + body.format(SAYS), None, None), (201, "c", "class", "a.py", body.format(SAYS), None, None), (202, "n", "function", None, None, None, None)]
    got = {r["symbol_id"] for r in docs.documented(spark.createDataFrame(rows, schema)).collect()}
    assert got == {200, *range(100, 130)}
    assert docs.documented(spark.createDataFrame([], schema)).count() == 0


# -- problem 5
GOOD = {
    "py": "import a.b as c\nfrom . import x\n@d(1)\nasync def f(a, /, b: int = 2, *c, d=3, **e) -> int:\n    if (n := len(a)) > 1: return [i async for i in x if i]\n    elif a:\n        pass\n    else:\n        x[1:2, ::3] = lambda q, *r: q ** -r\n    try:\n        raise E from None\n    except* (A, B) as e:\n        pass\n    finally:\n        del a, b\n    match a:\n        case {'k': [1, *_], **r} if r: pass\n        case P(x=1) | None: pass\n    with (open(a) as b, c): print(f'{a!r:>{b}}', sep='')\n    return not a is not b\n",
    "rs": "#![allow(x)]\nuse a::{b, c as d, *};\npub(crate) struct S<'a, T: Fn(u8) -> u8 + 'a = D> where T: Copy { pub a: &'a [T; 4], }\nimpl<T> Tr for S<'_, T> { const N: usize = 1 << 3; fn f(&mut self) -> Result<Vec<Vec<u8>>, E> { let Some(x) = y else { return Err(e)? }; match x { 1..=3 | 5 if a > b => {} S { a, .. } => 'l: loop { break 'l 1 }, _ => x.0.y::<u8>()[1] as u8, } if let Ok(v) = z && a < b { } vec![1; 3]; |a: u8, &b| -> u8 { a }; &mut *p; ..; a..b; Ok(()) } }\nmacro_rules! m { ($a:expr) => { $a }; }\n",
    "go": 'package m\n\nimport (\n\t"a"\n\t. "b"\n)\n\ntype T[K comparable, V any] struct {\n\tA, B int `x:"y"`\n\t*E\n}\n\nfunc (t *T[K, V]) F(a ...int) (x int, err error) {\n\tif v, ok := m[a[0]]; ok && !v {\n\t\treturn\n\t}\n\tfor i := range 10 {\n\t\tswitch x := y.(type) {\n\t\tcase int, []byte:\n\t\t\tfallthrough\n\t\tdefault:\n\t\t\tgo func() { ch <- <-d }()\n\t\t}\n\t}\n\ts := []T{{A: 1}, {B: 2}}[1:2:3]\nL:\n\tselect {\n\tcase <-c:\n\t\tbreak L\n\t}\n\treturn 1, nil\n}\n',
    "ts": "import type { A } from 'a';\nexport abstract class C<T extends keyof B = any> extends D<T> implements E, F { private readonly x?: Map<string, T[]> = new Map(); constructor(public a: number, b?: string) { super(); } get y(): string { return `${this.a}`; } [k: string]: unknown; @dec() async *gen(): AsyncGenerator<void> {} }\ntype U = A extends infer R ? { [K in keyof R]-?: R[K] } : (x: number) => asserts x is string;\nenum N { A = 1, B }\nconst f = async <T,>(x: T): Promise<T> => (x as unknown as T)!;\ndeclare module 'm' { export function g(a: number): void; }\nlet v = a?.b?.[0]?.() ?? c < d ? e : f;\n",
    "js": "#!/usr/bin/env node\nimport x, { y as z } from 'm';\nexport default class extends A { static #p = 1; static { this.q = 2; } }\nconst { a = 1, ...b } = c, [d, , e] = f\nfor (const x of y) if (/[/\\]]\\/+/.test(x)) continue; else { label: while (1) break label }\nlet g = async (x) => { await x }, h = x => ({ [x]: 1, get y() { return 2 }, async *z() {} })\ntry { throw new E } catch { } finally { }\na ||= b ** c\n++d\n",
    "tsx": "const a = <T,>(x: T) => <div className=\"x\" {...p}>it {x ? <b>y</b> : null}<C.D on={() => 1} /></div>;\n",
    "jsx": "export default () => <><p>don't stop</p></>;\n",
}
BAD = {
    "py": ["def f(:\n  pass", "x = (1, [2)", "if a:\nb", "print 'x'", "esle a b", "a = 'x", "try:\n    pass\n", "  x = 1\ny = 2\n z = 3", "<<<<<<< HEAD\nx = 1", "class A\n    pass", "x = 1 +", '"""', "f(a b)", "else:\n    pass", "@d\nx = 1"],
    "rs": ["fn f( {}", "fn f() { let x = ; }", "fn f() { a b }", "struct S { a u8 }", "fn f() { match x { 1 2 } }", "use a b;", "fn f() {}\n}", "let x = 1;", 'fn f() { "x }'],
    "go": ["package m\nfunc f( {", "import \"a\"", "package m\nfunc f() {\n\tx = \n}", "package m\nfunc f() {\n\tif x { }}\n}", "package m\nvar s = \"x\n", "package m\nesle a b\n", "package m\nfunc f() {\n\treturn a b\n}"],
    "ts": ["const x: = 1;", "function f(a: number { }", "class A { foo( }", "interface I { a: }", "let x = (a, [b);"],
    "js": ["const x = ;", "function f( {}", "if (a { }", "retrun a b", "let s = 'x\nlet t = 1", "x = {a: 1", "a = b c", "}", "for (let i = 0; i < 3) {}", "class A { x y }", "import a b from 'c'", "const x: number = 1"],
}


@pytest.mark.parametrize(("ext", "text"), GOOD.items())
def test_valid_sources(ext, text):
    for variant in (text, "\ufeff" + text, text.replace("\n", "\r\n"), text.rstrip("\n"), text + "// the end" * (ext != "py")):
        assert parses.faults(variant, ext) == []


@pytest.mark.parametrize(("ext", "text"), [(e, t) for e, ts in BAD.items() for t in ts])
def test_invalid_sources(ext, text):
    assert parses.faults(text, ext)


@pytest.mark.parametrize(
    ("ext", "text", "valid"),
    [
        ("js", "let a = `x ${b} ${c.d(1)}`;", True), ("js", 'a(`${x ? "{" : `q ${[`${{y: {z: {w: {v: 1}}}}}`]}`}`)', True), ("js", "a = `${a b}`;", False), ("js", "a = `${)}`;", False), ("js", "a = `${}`;", False), ("js", "a = `x ${b`;", False), ("js", "a = `\\${ no } $5 {`;", True),
        ("ts", "f(`${(x as T).y}`, `${`}`}`)", True), ("tsx", "const a = <b c={`${d}`}>it's `q</b>;", True), ("js", "a = /`/.test(b); c = `${d}`;", True), ("js", "// it`s ${\nlet c = 'a`b';", True), ("js", "a = `\n${\n  b +\n}\n`;", False),
        ("py", "a = f'{d['a']}'", True), ("py", "a = f'{x!r:>{w}} {y=} {z:%Y-%m} {{}} {a[1:2]} {b if c != d else e}'", True), ("py", "a = f'{a b}'", False), ("py", "a = f'{}'", False), ("py", "a = f'{x'", False), ("py", "a = f'x}'", False), ("py", "a = f'{x!z}'", False),
        ("py", "a = rf'\\d{n}\\{' '}'", True), ("py", "a = f'\\N{DASH} {x}'", True), ("py", "a = f'''{\n  x\n} {f'{y}'}'''", True), ("py", "a = f'{(lambda x: 1)(2)} {[i for i in x]}' f'{*y, z}'", True), ("py", "a = 'f' + b'{' + r'{'  # f'{'", True), ("py", "a = f'{x +}'", False),
    ],
)
def test_expressions_inside_strings(ext, text, valid):
    assert (parses.faults(text, ext) == []) == valid


def test_python_agrees_with_its_compiler():
    random.seed(5)
    text = GOOD["py"] + CODE
    for _ in range(400):
        i = random.randrange(len(text))
        broken = text[:i] + random.choice(["", "(", ")", ":", "\n", " if", "=", "'", ",", "x "]) + text[i + random.randrange(3) :]
        try:
            compile(broken.encode(), "x", "exec", ast.PyCF_ONLY_AST)
            valid = True
        except (SyntaxError, ValueError) as e:
            valid = "cannot" in str(e) or "assign" in str(e) or "default" in str(e) or "argument" in str(e) or "f-string" in str(e)
        if valid is False:
            assert parses.faults(broken, "py"), broken


def test_all_faults_are_kept():
    text = "function a() { x = ; }\nfunction b() { return 1 }\nfunction c() { y = ( }\n"
    got = parses.faults(text, "js")
    assert [n for n, _ in got][0] == 1 and {n for n, _ in got} >= {1, 3}


def test_parse_cases(spark):
    rows = [(1, 1, "a.py", "x = ("), (1, 1, "a.py", "x = ("), (2, 1, "b.js", ""), (3, 1, "c.md", "("), (4, 1, None, "("), (5, None, "d.GO", "package m"), (6, 1, "e.ts", None)]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], FILES)
    got = {r["file_id"]: r["valid"] for r in parses.parse_files(df).collect()}
    assert got == {1: False, 2: True, 5: True, 6: True}


def test_deep_nesting_ends():
    import sys

    sys.setrecursionlimit(60_000)
    assert parses.faults("x = " + "(" * 900 + "1" + ")" * 900 + ";", "js") == []
    assert isinstance(parses.faults("x = " + "[" * 5000, "js"), list)


def test_notices_after_a_long_licence():
    licence = [f"Licence term {i} of many." for i in range(40)]
    mark, taken = "Code generated by protoc-gen-go. DO NOT EDIT.", "vendored from github.com/x/y"
    slashes = "\n".join(f"// {x}" for x in licence)
    for head in (slashes, "/*\n" + "\n".join(licence) + "\n*/", "/*\n * " + "\n * ".join(licence) + "\n */"):
        for between in ("\n\n", "\n\npackage m\n\n"):
            assert handmade._generated(handmade._opening(f"{head}{between}// {mark}\n\nfunc a() {{}}\n"))
            assert handmade._foreign_notice(handmade._opening(f"{head}{between}// {taken}\n\nfunc a() {{}}\n"), "own/a.go")
    assert handmade._generated(handmade._opening("/*\n" + "\n".join([*licence, mark]) + "\n*/\npackage m\n"))
    far = slashes + "\npackage m\nfunc a() {}\n" + f"// {mark}\n"
    assert not handmade._generated(handmade._opening(far))
