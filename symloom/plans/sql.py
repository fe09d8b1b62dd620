"""SQL that states what the registered queries compute, in the dialect of the check; candidates are enumerated here."""

from __future__ import annotations

from symloom.functions import columns as C


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def base(c: str) -> str:
    return f"regexp_extract({c}, '([^/]*)$', 1)"


def ext(c: str) -> str:
    return f"regexp_extract({base(c)}, '\\.([^.]*)$', 1)"


def folder(c: str) -> str:
    return f"regexp_extract({c}, '^(.*)/[^/]*$', 1)"


def stem(c: str) -> str:
    return f"coalesce(string_split({base(c)}, '.')[-2], '')"


def leaf(c: str) -> str:
    return f"string_split({c}, '::')[-1]"


def is_test(file: str, name: str) -> str:
    ends = " OR ".join(f"ends_with({base(file)}, '{e}')" for e in C.TEST_ENDINGS)
    folders = "[" + ", ".join(f"'{x}'" for x in C.TEST_FOLDERS) + "]"
    starts = " OR ".join(f"starts_with({x}, '{p}')" for x in (base(file), leaf(name)) for p in ("test_", "Test"))
    return f"(list_has_any(string_split({file}, '/'), {folders}) OR {ends} OR {starts})"


def is_exported(file: str, name: str, signature: str) -> str:
    return f"(starts_with({signature}, 'pub ') OR starts_with({signature}, 'pub(') OR starts_with({signature}, 'export ') OR (ends_with({file}, '.go') AND regexp_matches({name}, '^[A-Z]')) OR (ends_with({file}, '.py') AND NOT starts_with({name}, '_')))"


def is_program(name: str) -> str:
    return f"({name} = 'main' OR ends_with({name}, '::main'))"


def is_framework(file: str, name: str, kind: str, signature: str) -> str:
    last = f"string_split({leaf(name)}, '.')[-1]"
    return f"({stem(file)} IN {_in(C.FRAMEWORK_STEMS)} OR {last} IN ('appRouter', 'router') OR ends_with({last}, 'Router') OR starts_with({name}, 'appRouter::') OR starts_with({name}, 'appRouter.') OR {stem(file)} = 'index' OR ({stem(file)} = 'mod' AND ({kind} = 'type' OR starts_with({signature}, 'pub '))))"


def lines(c: str) -> str:
    """The lines of a text as a list."""
    return f"(CASE WHEN {c} IS NULL OR {c} = '' THEN [] ELSE string_split(replace(regexp_replace({c}, '\\r?\\n\\z', ''), chr(13) || chr(10), chr(10)), chr(10)) END)"


def trim(c: str) -> str:
    return f"trim({c}, ' ')"


CTES = {
    "s": "s AS MATERIALIZED (SELECT symbol_id AS sid, * EXCLUDE (symbol_id) FROM symbols QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY indexed_at) = 1)",
    "f": "f AS MATERIALIZED (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ingested_at) = 1)",
    "idx": f"idx AS MATERIALIZED (SELECT DISTINCT repo_id, sid, file, {folder('file')} AS dir, unnest([name, {leaf('name')}, CASE WHEN contains(string_split(name, '.')[-1], '::') THEN name ELSE string_split(name, '.')[-1] END]) AS lookup FROM s WHERE kind IN {_in(C.CALLABLE)})",
    "refs": f"refs AS MATERIALIZED (SELECT sid AS src, repo_id, file, {folder('file')} AS dir, name AS src_name, {is_test('file', 'name')} AS is_test, member_calls, external_imports, call_counts, unnest(calls) AS ref FROM s)",
    "res": """res AS MATERIALIZED (
SELECT repo_id, src, ref, CASE WHEN external THEN 'external' WHEN total = 0 THEN 'unresolved' WHEN itself THEN 'self' WHEN nf = 1 THEN 'same_file' WHEN nf > 1 THEN 'ambiguous_file'
  WHEN mine > 0 THEN 'self' WHEN member THEN 'member' WHEN ref NOT IN ('new', 'default') AND nd = 1 THEN 'same_dir' WHEN ref NOT IN ('new', 'default') AND nd > 1 THEN 'ambiguous_dir'
  WHEN ref IN ('new', 'default') THEN 'generic' WHEN ng = 1 THEN 'global' ELSE 'ambiguous_global' END AS outcome, f1, d1, g1,
  least(sqrt(greatest(coalesce(n, 1), 1)), 8) * (CASE WHEN is_test THEN 0.25 ELSE 1 END) AS w
FROM (SELECT r.repo_id, r.src, r.ref, any_value(r.is_test) AS is_test, bool_or(list_contains(r.external_imports, r.ref)) AS external, bool_or(list_contains(r.member_calls, r.ref)) AS member, any_value(r.call_counts[r.ref]) AS n,
    count(i.sid) AS total, count(i.sid) FILTER (i.sid = r.src) AS mine, bool_or(i.sid = r.src AND r.src_name = r.ref) AS itself,
    count(i.sid) FILTER (i.sid <> r.src AND i.file = r.file) AS nf, min(i.sid) FILTER (i.sid <> r.src AND i.file = r.file) AS f1,
    count(i.sid) FILTER (i.sid <> r.src AND i.dir = r.dir) AS nd, min(i.sid) FILTER (i.sid <> r.src AND i.dir = r.dir) AS d1,
    count(i.sid) FILTER (i.sid <> r.src) AS ng, min(i.sid) FILTER (i.sid <> r.src) AS g1
  FROM refs r LEFT JOIN idx i ON i.repo_id = r.repo_id AND i.lookup = r.ref GROUP BY r.repo_id, r.src, r.ref))""",
    "e": "e AS MATERIALIZED (SELECT repo_id, src, dst, sum(w) AS w FROM (SELECT repo_id, src, w, CASE outcome WHEN 'same_file' THEN f1 WHEN 'same_dir' THEN d1 WHEN 'global' THEN g1 END AS dst FROM res) WHERE dst IS NOT NULL GROUP BY ALL)",
    "top": "top AS MATERIALIZED (SELECT repo_id, arg_min(dst, (-n, dst)) AS sid FROM (SELECT repo_id, dst, count(*) AS n FROM e GROUP BY ALL) GROUP BY repo_id)",
    "deg": "deg AS MATERIALIZED (SELECT s.*, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM s LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY dst) i ON i.dst = s.sid LEFT JOIN (SELECT src, count(*) AS n FROM e GROUP BY src) o ON o.src = s.sid)",
    "words": "words AS MATERIALIZED (SELECT DISTINCT repo_id, sid, unnest(mentions) AS word FROM s)",
    "hk": f"""hk AS MATERIALIZED (SELECT DISTINCT hunk_id, file, greatest(a, 1) AS first, CASE WHEN c = 0 THEN greatest(a, 1) ELSE greatest(a, 1) + c - 1 END AS last FROM (
SELECT hunk_id, regexp_replace(replace(trim(path), '\\', '/'), '^(\\./|[ab]/|/)+', '') AS file, try_cast(regexp_extract(header, '^@@ (?:[^ ]+ +)*?\\+(\\d+)(?:,\\d+)?(?: .*)? @@|^@@ (?:[^ ]+ +)*?\\+(\\d+)', 1) AS BIGINT) AS a,
  coalesce(try_cast(regexp_extract(header, '^@@ (?:[^ ]+ +)*?\\+\\d+,(\\d+)', 1) AS BIGINT), 1) AS c FROM hunks WHERE path IS NOT NULL AND trim(path) <> '/dev/null') WHERE a IS NOT NULL)""",
}
NEEDS = {"idx": ["s"], "refs": ["s"], "res": ["idx", "refs"], "e": ["res"], "top": ["e"], "deg": ["s", "e"], "words": ["s"]}


def with_(names: list[str], query: str, *more: str) -> str:
    """The query with the named common tables and those they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for x in NEEDS.get(n, []):
            add(x)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join([*[CTES[n] for n in order], *more]) + "\n" + query


def reach(seeds: str, up: bool, depth: int = 3) -> list[str]:
    """Common tables r0..r<depth> of (source, sid, depth), each hop without what is reached before."""
    a, b = ("dst", "src") if up else ("src", "dst")
    out = [f"r0 AS MATERIALIZED (SELECT DISTINCT source, sid, 0 AS depth FROM ({seeds}))"]
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT source, sid FROM r{i}" for i in range(d))
        out.append(f"r{d} AS MATERIALIZED (SELECT DISTINCT source, e.{b} AS sid, {d} AS depth FROM r{d - 1} JOIN e ON e.{a} = r{d - 1}.sid WHERE (source, e.{b}) NOT IN ({seen}))")
    out.append("reached AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(depth + 1)) + ")")
    return out


def pagerank(mass: str, weight: str, demote: bool, rounds: int = 100, tolerance: float = 1e-6) -> str:
    """Rounds go on until no repository's ranks move by `tolerance` together, as the operator's do."""
    parts = [
        f"node AS MATERIALIZED (SELECT repo_id, sid, {is_test('file', 'name')} AS is_test, {mass} AS m FROM s)",
        f"t AS MATERIALIZED (SELECT src, dst, {weight} / sum({weight}) OVER (PARTITION BY src) AS p FROM e)",
        "b AS MATERIALIZED (SELECT repo_id, sid, is_test, m / sum(m) OVER (PARTITION BY repo_id) AS prior, 1.0::DOUBLE / count(*) OVER (PARTITION BY repo_id) AS rank, sid IN (SELECT src FROM t) AS flows FROM node QUALIFY sum(m) OVER (PARTITION BY repo_id) > 0)",
        f"""k AS (SELECT 0 AS round, repo_id, sid, is_test, prior, flows, rank, 1.0::DOUBLE AS moved FROM b UNION ALL
SELECT round, repo_id, sid, is_test, prior, flows, rank, max(change) OVER () AS moved FROM (
  SELECT n.round + 1 AS round, n.repo_id, n.sid, n.is_test, n.prior, n.flows, x.rank, sum(abs(x.rank - n.rank)) OVER (PARTITION BY n.repo_id) AS change FROM k n
  JOIN (SELECT n.sid, 0.15 * n.prior + 0.85 * (coalesce(i.x, 0) + coalesce(l.x, 0) * n.prior) AS rank FROM k n
    LEFT JOIN (SELECT t.dst, sum(k.rank * t.p) AS x FROM k JOIN t ON t.src = k.sid GROUP BY t.dst) i ON i.dst = n.sid
    LEFT JOIN (SELECT repo_id, sum(rank) AS x FROM k WHERE NOT flows GROUP BY repo_id) l ON l.repo_id = n.repo_id) x ON x.sid = n.sid
  WHERE n.round < {rounds} AND n.moved >= {tolerance}))""",
    ]
    value = "rank * (CASE WHEN is_test THEN 0.25 ELSE 1 END)" if demote else "rank"
    total = f"/ sum({value}) OVER (PARTITION BY repo_id)" if demote else ""
    return "WITH RECURSIVE" + with_(["s", "e"], f"SELECT repo_id, sid, round({value} {total}, 6) AS rank FROM k WHERE round = (SELECT max(round) FROM k)", *parts)[4:]
