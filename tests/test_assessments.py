"""Scores, tool rules, flows, references and mapped lines on small tables."""

import difflib
import random

from pyspark.sql import functions as F

from siftkite.functions import findings as N
from siftkite.functions import priorities as P
from siftkite.operators import linking as L
from siftkite.operators import matching as M
from siftkite.operators import patterns as O


def test_tool_rules(spark):
    rows = [("a.sql-injection.b", "semgrep"), ("x/UnknownXss2", "codeql"), ("", "codeql"), ("java:s2076", "sonarqube"), ("x S0", "sonar"), ("B608", "bandit 1"), ("p/no-eval", "eslint"), ("B701", "z"), (None, None)]
    df = spark.createDataFrame(rows, "rule string, tool string").select(N.tool_cwe(F.col("rule"), F.col("tool")).alias("c"))
    assert [r.c for r in df.collect()] == ["CWE-89", "CWE-79", "CWE-89", "CWE-78", "", "CWE-89", "CWE-95", "CWE-79", "CWE-89"]


def test_scores_of_nulls(spark):
    none = F.lit(None).cast("string")
    row = spark.range(1).select(P.exploit_score(none, none, none, none, F.lit(None).cast("boolean"), F.lit(None).cast("boolean")).alias("e"), P.api_first(F.lit("a/util.js"), none, none).alias("a"), P.stem(F.lit("x/.env")).alias("s")).first()
    assert row.e == round(0.3 + 0.65 * 0.25 + 0.95 * 0.25 + 0.5 * 0.2, 4) and row.a.port_config == 0 and row.s == ".env"


def test_flows_count_what_pairs_would(spark):
    rng = random.Random(5)
    rows = [(f"f{rng.randrange(4)}", rng.randrange(25), i, rng.choice(["source", "sink", "sanitizer", "auth", "transform"])) for i in range(160)]
    df = spark.createDataFrame(rows, "path string, line int, pos int, family string")
    got = {(r.path, r.line, r.n_open, r.n_guarded) for r in O.input_flows(df).collect()}
    want = set()
    for path, line, _, family in rows:
        sinks = [r[1] for r in rows if r[0] == path and r[3] == "sink"]
        guarded = sum(any(r[0] == path and r[3] == "sanitizer" and line < r[1] < s for r in rows) for s in sinks)
        if family == "source" and sinks:
            want.add((path, line, len(sinks) - guarded, guarded))
    assert got == want
    direct = {r.path: r.n_direct for r in O.token_flows(df.withColumnRenamed("family", "category")).collect()}
    for path in direct:
        own = [r for r in rows if r[0] == path]
        pairs = [(a, b) for a in own for b in own if a[3] == "source" and b[3] == "sink" and b[1] > a[1]]
        assert direct[path] == sum(not any(g[3] == "sanitizer" and a[1] < g[1] < b[1] for g in own) for a, b in pairs)


def test_references(spark):
    entities = spark.createDataFrame([("s", "file", "app.py", 1, 1), ("s", "function", "load", 9, 2), ("s", "class", "Load", 2, 3), ("s", "variable", "x", 3, 4), ("s", "file", "b.py", 9, 5), ("s", "port", "p", 9, 6), ("s", "port", "q", 9, 7)], "scope string, type string, name string, seen int, pos int")
    asked = {1: "it", 2: " The File", 3: "the class", 4: "LOAD", 5: "Load", 6: "oa", 7: "", 8: "none", 9: None}
    df = spark.createDataFrame([("s", k, v) for k, v in asked.items()] + [("t", 10, "it")], "scope string, k int, reference string")
    got = {r.k: r.name for r in L.resolve_references(df, entities, scope="scope", key="k").collect()}
    assert got == {1: "load", 2: "b.py", 3: None, 4: "load", 5: "Load", 6: "load", 7: "app.py", 8: None, 9: None, 10: None}


def plain_line(snippet, content, reported, reach):
    """What map_lines is defined to give, over whole files."""
    if not (snippet or "").strip() or not content:
        return -1, "NOT_FOUND"
    lines, snippet = content.split("\n"), snippet.strip()
    flat = lambda s: " ".join(s.split())
    for same in (lambda x: x.strip() == snippet, lambda x: flat(x) == flat(snippet)):
        at = [i + 1 for i, x in enumerate(lines) if x.strip() and same(x)]
        if at:
            return (reported, "EXACT") if reported in at else (at[0], "ADJUSTED")
    centre = (reported or len(lines) // 2) - 1
    scored = []
    for i in range(max(0, centre - reach), min(len(lines), centre + reach)):
        ratio = difflib.SequenceMatcher(None, snippet.lower(), lines[i].strip().lower()).ratio()
        if lines[i].strip() and ratio >= 0.65:
            scored.append((-ratio, i + 1))
    for i in range(max(0, centre - 2 * reach), min(len(lines), centre + 2 * reach)) if not scored else []:
        x = lines[i].strip()
        d = list(range(len(x) + 1))
        for a, c in enumerate(snippet):
            last, d[0] = d[0], a + 1
            for b, e in enumerate(x):
                last, d[b + 1] = d[b + 1], min(d[b + 1] + 1, d[b] + 1, last + (c != e))
        if x and 1 - d[-1] / max(len(x), len(snippet)) >= 0.5:
            scored.append((-(1 - d[-1] / max(len(x), len(snippet))), i + 1))
    if not scored:
        words = M.code_keywords(snippet)
        scored = [(0, i + 1) for i in range(max(0, centre - reach), min(len(lines), centre + reach)) if any(w in lines[i].lower() for w in words)]
    if not scored:
        return -1, "NOT_FOUND"
    line = min(scored)[1]
    return line, "EXACT" if line == reported else "ADJUSTED"


def test_lines_map_as_defined(spark):
    rng = random.Random(3)
    words = ["load", "x1", "=", "def", "run(", ")", "value", "if", "return", "Token", "", "  "]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(7)))
    files = {f"f{i}": "\n".join(line() for _ in range(rng.randrange(60))) for i in range(6)} | {"null": None, "empty": ""}
    rows = []
    for k in range(250):
        path = rng.choice([*files, "missing"])
        known = (files.get(path) or "").split("\n")
        snippet = rng.choice([rng.choice(known), rng.choice(known).replace(" ", "   "), line(), rng.choice(known)[:9] + "zq", None, "TOKEN nothing alike at all", "zzzz"])
        rows.append((str(k), path, snippet, rng.choice([None, 0, rng.randrange(1, 70)])))
    asked = spark.createDataFrame(rows, "key string, path string, snippet string, reported int")
    texts = spark.createDataFrame(list(files.items()), "path string, content string")
    got = {r.key: (r.line, r.status) for r in M.map_lines(asked, texts, reach=10).collect()}
    assert got == {k: plain_line(s, files.get(p), r, 10) for k, p, s, r in rows}
    assert len({v[1] for v in got.values()}) == 3


def test_a_block_of_lines_goes_to_python_once_and_not_for_each_snippet(spark):
    """Windows for each snippet took hundreds of times the text; a file that is there twice answers twice, as a join of the two does."""
    texts = spark.createDataFrame([("a", "\n".join(f"load value {i} of table {i * i}" for i in range(120)))] * 2 + [("b", "x = 1\ny = 2")], "path string, content string")
    asked = spark.createDataFrame([(k, "a", f"load valu {k} of table {k * k}", k + 1) for k in range(60)] + [(90, "b", "y  =  2", 1), (91, "c", "y", 1)], "key int, path string, snippet string, reported int")
    out = M.map_lines(asked, texts, reach=5)
    assert sorted((r.key, r.line, r.status) for r in out.collect()) == sorted([(k, k + 1, "EXACT") for k in range(60)] * 4 + [(90, 2, "ADJUSTED"), (91, -1, "NOT_FOUND")])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


def test_white_space_goes_as_in_spark(spark):
    texts = ["", " ", "\x85", " a\t", "a \x85", "a \u2028", " \x85 ", "a\x85\x85", "\xa0 a\xa0", "\x1c a \x1c", "a \r\u2029", "\u2029", "a\x0b\f\r"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", F.regexp_replace("x", r"^\s+|\s+$", "").alias("t"))
    assert {r.i: r.t for r in got.collect()} == {i: M._trimmed(x) for i, x in enumerate(texts)}


def test_code_keywords():
    assert M.code_keywords("def load(x): return Token(this)") == ["load", "load", "token", "return "]


def test_edit_distances_are_those_of_the_table():
    rng = random.Random(3)

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    for _ in range(400):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randrange(0, 90))) for _ in range(2))
        b = b if rng.random() < 0.5 else a[: rng.randrange(len(a) + 1)] + b[:3] + a[rng.randrange(len(a) + 1) :]
        assert M.edit_distance(a, b) == table(a, b)
        ratio = difflib.SequenceMatcher(None, a, b).ratio()
        assert 2 * M._longest_common(M._places(a), len(a), b) >= ratio * (len(a) + len(b)) - 1e-6
    assert M._longest_common(M._places("abcbdab"), 7, "bdcaba") == 4
    long = "".join(rng.choice("abcdefgh ") for _ in range(20000))
    assert M.edit_distance(long, long[: 12000]) == 8000 and 0 < M.edit_distance(long, long[::-1]) < 20000  # a table of 4 * 10^8 places
    assert M.closest_by_edits("abcd", ["", "zbzz", "abzz", "zzcd"], 4, 0.5) == 7 and M.closest_by_edits("abcd", ["zzzd"], 0, 0.5) is None
