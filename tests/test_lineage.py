import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftkite.operators import lineage as G


@pytest.mark.parametrize("strict", [True, False])
def test_as_of_is_the_last_mark_before(spark, strict):
    rng = random.Random(4)
    some = lambda n: rng.choice([None, *range(n)])
    rows = [(rng.choice(["a", "hot", "hot", None]), some(3), some(40), i) for i in range(200)] + [("hot", 1, 7, 900)] * 2
    marks = {(rng.choice(["a", "hot", None]), some(3), some(40)): f"m{i}" for i in range(120)}
    left = spark.createDataFrame(rows, "x string, y int, at int, r int").repartition(5)
    right = spark.createDataFrame([(*k, v) for k, v in marks.items()], "x string, y int, at int, name string").repartition(3)
    want = Counter()
    for x, y, at, r in rows:
        known = [(b, n) for (u, v, b), n in marks.items() if None not in (x, y, at, u, v, b) and (u, v) == (x, y) and (b < at or (b == at and not strict))]
        want[r, *(max(known) if known else (None, None))] += 1
    assert Counter((r.r, r.mark_at, r.name) for r in G.as_of(left, right, ["x", "y"], "at", strict=strict).collect()) == want
    assert G.as_of(left, right.limit(0), ["x", "y"], "at").filter("name is not null").count() == 0 and G.as_of(left.limit(0), right, ["x", "y"], "at").count() == 0


def trace(lines, start, var):
    """The search itself: upwards line by line, through copies, no further than the line that starts a method."""
    out = []
    while True:
        for i in range(start - 2, max(0, start - 50), -1):
            found = re.search(rf"\b{var}\b\s*=", lines[i]) and re.search(r"(\w+)\s*=\s*(.+)", lines[i])
            if found or re.search(r"\b(public|private|protected)\s+\w+", lines[i]):
                break
        else:
            return out
        if not found:
            return out
        value = found.group(2).strip()
        copy = value if re.fullmatch(r"\w+", value) else None
        out.append((i + 1, copy))
        if not copy:
            return out
        start, var = i + 1, copy


def test_traces_are_those_of_the_search(spark):
    rng = random.Random(9)
    names = ["a", "b", "c", "dd"]
    files = {}
    for f in range(6):
        lines = ["first = a"]
        for _ in range(160):
            kind = rng.random()
            lines.append(f"public {rng.choice(names)} = {rng.choice(names)}" if kind < 0.03 else f"private int m{f}() {{" if kind < 0.08 else f"{rng.choice(names)} = {rng.choice(names)}" if kind < 0.5 else f"{rng.choice(names)} = f(1)" if kind < 0.6 else "call();")
        files[f"f{f}"] = lines
    table = spark.createDataFrame([(f, i + 1, x) for f, lines in files.items() for i, x in enumerate(lines)], "file string, line long, text string")
    given = G.assignments(table, F.col("text")).groupBy("file", "line", "var").agg(F.min_by("source", "var").alias("source"))
    starts = [(f, line, v) for f in files for line in range(1, 163, 3) for v in names]
    got = {}
    for r in G.trace_origin(given, spark.createDataFrame(starts, "file string, line long, var string"), G.method_starts(table, F.col("text"))).collect():
        got.setdefault((r.file, r.line, r.var), {})[r.hop] = (r["at"], r.origin)
    want = {s: dict(enumerate(t, 1)) for s in starts if (t := trace(files[s[0]], s[1], s[2]))}
    assert got == want and max(map(len, got.values())) > 4


def test_a_long_chain_and_the_line_of_the_use(spark):
    rows = [("f", i, f"v{i}", f"v{i - 1}" if i > 2 else None) for i in range(2, 16)]
    a = spark.createDataFrame(rows, "file string, line long, var string, source string")
    start = spark.createDataFrame([("f", 16, "v15")], "file string, line long, var string")
    assert sorted((r.hop, r["at"], r.origin) for r in G.trace_origin(a, start).collect()) == [(h, 16 - h, f"v{15 - h}" if h < 14 else None) for h in range(1, 15)]
    own = spark.createDataFrame([("f", 15, "v15"), ("f", 3, "v15")], "file string, line long, var string")
    got = {r.line: r.mark_at for r in G.nearest_assignment(own, a, spark.createDataFrame([("f", 15)], "file string, line long"), reach=None, strict=False).collect()}
    assert got == {15: 15, 3: None}


def test_long_traces_take_few_tables(spark, monkeypatch):
    rows = [("f", i, f"v{i}", f"v{i - 1}" if i > 2 else None) for i in range(2, 103)]
    a = spark.createDataFrame(rows, "file string, line long, var string, source string")
    start = spark.createDataFrame([("f", 103, "v102"), ("f", 60, "v59"), ("g", 9, "v8")], "file string, line long, var string")
    made, stage = [], G.stage
    monkeypatch.setattr(G, "stage", lambda df, name, *more: (made.append(name), stage(df, name, *more))[1])
    got = sorted((r.line, r.hop, r["at"], r.origin) for r in G.trace_origin(a, start).collect())
    assert got == sorted((n, h, n - h, f"v{n - h - 1}" if n - h > 2 else None) for n in (60, 103) for h in range(1, n - 1))
    assert sum(name in ("hop", "hops", "traces") for name in made) < 20
