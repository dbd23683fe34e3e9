"""Operators without SQL against plain Python, and the semantics that are easy to get wrong."""

import datetime
import math
import random
from difflib import SequenceMatcher
from fractions import Fraction

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftkite.functions import findings as X
from siftkite.functions import scoring as S
from siftkite.functions import text as T
from siftkite.functions import versions as V
from siftkite.operators import findings as O
from siftkite.operators import retrieval as R
from siftkite.operators import warehouse as W
from siftkite.streaming import signals as G


def one(spark, column, **values):
    names = {k: ("string" if isinstance(v, str) or v is None else "boolean" if isinstance(v, bool) else "int" if isinstance(v, int) else "double") for k, v in values.items()}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in names.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize("rule,family", [("RULE_windows", "RULE"), ("SQL_INJECTION_1", "SQL_INJECTION"), ("RemoteTokenServices_SSRF", "SSRF"), ("Spring_Cloud_Vulnerability", "SPRING_CLOUD_VULNERABILITY"), ("A_B_2", "A_B"), ("A_2", "A_2"), ("xVuln", "X"), ("", ""), ("Plain", "Plain"), ("路径变量未经验证", "UNVALIDATED_PATH_VARIABLE")])
def test_rule_families(spark, rule, family):
    assert one(spark, X.normal_rule(F.col("r")), r=rule) == family


def test_buckets_are_not_distances(spark):
    assert [one(spark, X.line_bucket(F.col("l")), l=i) for i in (9, 10, 14)] == [5, 10, 10]


@pytest.mark.parametrize("path,want", [("./a/src/B.py", "src/b.py"), ("C:\\x\\LIB\\y\\", "lib/y"), ("././q", "q"), ("", ""), ("/code/app/z", "app/z")])
def test_paths(spark, path, want):
    assert one(spark, X.normal_path(F.col("p")), p=path) == want


@pytest.mark.parametrize("level,tool,want", [("HIGH", "bandit", "high"), ("error", "x", "high"), ("9.1", "sonar", "critical"), ("0", "x", "info"), ("Critical", "x", "critical"), ("odd", "x", "medium")])
def test_tool_severity(spark, level, tool, want):
    assert one(spark, X.tool_severity(F.col("l"), F.col("t")), l=level, t=tool) == want


def test_location(spark):
    assert [one(spark, X.location_line(F.col("l")), l=v) for v in ("a:b:7", "a", "a:x")] == [7, -1, -1]
    assert one(spark, X.location_path(F.col("l")), l="C:/a:7") == "C:/a"
    assert one(spark, T.path_line(F.col("l")), l="C:/a.py:7") == ("C:/a.py", 7)


def test_worked_example(spark):
    rows = [(0, "SQL_INJECTION_1", "f", 10, 0.9, "a", "d"), (1, "SQL_INJECTION_2", "f", 12, 0.8, "b", "d"), (2, "XSS", "f", 50, 0.7, "c", "d"), (3, "XSS", "f", 50, 0.7, "c", "d")]
    df = spark.createDataFrame(rows, "pos long, rule_id string, file_path string, line int, confidence double, code_snippet string, description string")
    assert O.deduplicate(df).count() == 3
    assert sorted((r.pos, r.confidence) for r in O.smart_deduplicate(df).collect()) == [(0, 0.9), (2, 0.7)]


def test_votes_and_their_ties(spark):
    rows = [(0, "A", "F1", "REJECTED", 0.5, "low", 1, 1), (1, "B", "F1", "CONFIRMED", 0.5, "high", 3, 1), (2, "A", "F2", "REFINED", 0.0, "low", 1, 1)]
    d = {r.finding_id: r for r in O.decide(O.votes_by_finding(spark.createDataFrame(rows, "pos long, agent_id string, finding_id string, decision string, confidence double, severity string, execution_time_ms long, token_cost long"))).collect()}
    assert (d["F1"].majority, d["F1"].severity, d["F1"].controversial, d["F1"].consensus) == ("CONFIRMED", "high", True, "REFINED")
    assert (d["F2"].weighted, d["F2"].weighted_share, d["F2"].level) == ("REJECTED", 0.0, "unanimous")


def test_round_half_even_and_bands(spark):
    assert one(spark, S.composite({k: F.col("s") for k in S.WEIGHTS}), s=80.0) == 80.0
    assert [one(spark, S.to_cvss(F.col("s")), s=v) for v in (100.0, 80.0, 55.0, 25.0, 1.0, 0.0)] == [10.0, 9.0, 7.0, 4.0, 0.1, 0.0]
    assert one(spark, F.bround(F.col("s")), s=2.5) == 2.0


def test_longest_prefix(spark):
    assert [tuple(one(spark, S.model_price(F.col("m")), m=v)) for v in ("gpt-4o-mini-x", "gpt-4o", "who")] == [S.PRICES["gpt-4o-mini"], S.PRICES["gpt-4o"], S.PRICES["default"]]


def test_versions(spark):
    assert one(spark, V.compare(F.col("a"), F.col("b")), a="1.10", b="1.9") == 1
    assert one(spark, V.version_key(F.col("a"), 4), a="1.0rc1") == [1, 1, 0, 0]
    for a, b, sign in [("1.0.0", "1", 0), ("1.010", "1.10", 0), ("", "0.0", 0), ("1.2.3.4.5.6.7.8.9.1", "1.2.3.4.5.6.7.8.9", 1), ("1." + "9" * 30, "1.1" + "0" * 30, -1), ("2..0.", "2.0.1", -1), ("v10", "9.9", 1)]:
        assert one(spark, V.compare(F.col("a"), F.col("b")), a=a, b=b) == sign, (a, b)
    cpe = spark.createDataFrame([("v", "p", "", None, "including", "excluding", "C1"), ("v", "p", "1.9", "1.10", "excluding", "including", "C2")], "vendor string, product string, version_start string, version_end string, version_start_type string, version_end_type string, cve_id string").withColumn("version", F.lit(""))
    target = lambda v: spark.createDataFrame([("v", "p", v)], "vendor string, product string, version string")
    assert {r.cve_id for r in W.scan_product_version(cpe, target("1.10")).collect()} == {"C1", "C2"}
    assert {r.cve_id for r in W.scan_product_version(cpe, target("1.9")).collect()} == {"C1"}
    assert {r.cve_id for r in W.scan_product_version(cpe, target("1.10"), lexicographic=True).collect()} == {"C1"}


def brute_pack(text, limit):
    out, now = [], ""
    for s in text.split(". "):
        joined = s if not now else f"{now}. {s}"
        if len(joined) <= limit:
            now = joined
        else:
            if now:
                out.append(now)
            now = s if len(s) <= limit else ""
    return out + [now] if now else out


def test_sentence_packing(spark):
    rng = random.Random(1)
    texts = [". ".join("x" * rng.randrange(0, 40) for _ in range(rng.randrange(1, 12))) for _ in range(60)] + [""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", T.pack_sentences(F.col("t"), 30).alias("p")).collect()}
    assert all(got[i] == brute_pack(t, 30) for i, t in enumerate(texts))


def test_masks_and_chunks(spark):
    assert [one(spark, T.mask(F.col("t")), t=v) for v in ("abc", "secret12")] == ["***", "secr****"]
    assert one(spark, T.strip_tags(F.col("t")), t="a <b>c</b>\n\n d") == "a c d"
    assert [tuple(x) for x in one(spark, T.char_chunks(F.col("t"), 4, 1), t="abcdefg")] == [(0, "abcd"), (3, "defg"), (6, "g")]
    assert one(spark, T.char_chunks(F.col("t"), 4, 1), t="") == []
    assert T.glob_regex("a.**.b*") == r"a\..*\.b[^.]*"


def test_fpr_bounds(spark):
    df = spark.createDataFrame([(0.1, None, "PLACEHOLDER", "low")] * 3, "confidence double, status string, title string, severity string")
    assert {r.severity: r.rate for r in O.false_positive_rate(df).collect()} == {"all": 40.0, "low": 60.0}


def test_evidence(spark):
    item = "array<struct<confidence:double,code_snippet:string,location:string,reason:string>>"
    df = spark.createDataFrame([(0, []), (1, [(0.9, "x" * 11, "f", "y" * 21)]), (2, [(0.5, None, "N/A", None), (0.9, "", "f", "")])], f"i int, e {item}")
    got = {r.i: r.x for r in df.select("i", S.evidence_confidence(F.col("e")).alias("x")).collect()}
    assert got[0] == 0 and got[1] == pytest.approx((0.12 + 0.27 + 0.25 + 0.15) * 0.85) and got[2] == pytest.approx(0.12 + 0.21 + 0.1)


def test_bm25_gives_common_terms_a_little(spark):
    docs = spark.createDataFrame([(1, "A a b"), (2, "a c"), (3, "a d d"), (4, ""), (5, "z z")], "id int, t string")
    got = {r.id: r.score for r in R.bm25(docs, ["a", "d"], "id", "t").collect()}
    idf = {"a": math.log((5 - 3 + 0.5) / 3.5), "d": math.log(4.5 / 1.5)}
    floor = 0.25 * abs((idf["a"] + idf["d"]) / 2)
    part = lambda w, f, n: w * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * n / 2))
    assert set(got) == {1, 2, 3} and got[3] == pytest.approx(part(floor, 1, 3) + part(idf["d"], 2, 3)) and got[1] == pytest.approx(part(floor, 2, 3))
    assert R.bm25(docs.limit(0), ["a"], "id", "t").count() == 0


def test_cosines(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(R.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, pytest.approx(1.0)]
    assert [r[0] for r in df.select(R.l2_similarity(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]
    bad = spark.createDataFrame([([float("nan")],), ([],), ([1.0],), (None,)], "a array<double>")
    assert [r[0] for r in bad.select(R.valid_vector(F.col("a"))).collect()] == [False, False, True, False]


def test_similar_pairs_against_all_pairs(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.sample("abcdefghijkl", rng.randrange(1, 9)))) for i in range(80)] + [(90, None), (91, ""), (92, "a b c")]
    sets = {}
    for i, t in rows:
        if t:
            sets.setdefault(frozenset(t.split()), i)
    items = sorted((i, s) for s, i in sets.items())
    want = {(a, b) for a, x in items for b, y in items if a < b and len(x & y) / len(x | y) > 0.6}
    got = {(r.a, r.b) for r in R.similar_pairs(spark.createDataFrame(rows, "i long, t string"), "i", "t", 0.6).collect()}
    assert got == want and want


def test_fusion_divides_by_the_candidates_best(spark):
    leg = lambda *rows: spark.createDataFrame(list(rows), "id int, score double")
    out = {r.id: r.score for r in R.fuse_scores({"a": (leg((1, 4.0), (2, 2.0)), 0.5), "b": (leg((2, 1.0)), 0.3), "c": (leg((3, 0.0)), 0.2)}, "id", 10).collect()}
    assert out == {1: 0.5, 2: pytest.approx(0.55), 3: 0.0}
    assert R.added_words("find xss", R.expand_query("find xss")) == ["OR", "cross-site", "scripting"]


def test_sequence_similarity(spark):
    rows = [("abc", "abd"), ("", ""), (None, "x")]
    got = [r.ratio for r in R.sequence_similarity(spark.createDataFrame(rows, "a string, b string"), "a", "b").collect()]
    assert got == [SequenceMatcher(None, a or "", b or "").ratio() for a, b in rows]


def test_near_lines_against_all_pairs(spark):
    rng = random.Random(7)
    rows = [(i, f"f{rng.randrange(3)}", rng.randrange(40)) for i in range(120)]
    df = spark.createDataFrame(rows, "pos long, file_path string, line int")
    got = {(r.pos, r.r_pos) for r in O.near_lines(df, df, 4).collect()}
    assert got == {(a, b) for a, f, x in rows for b, g, y in rows if f == g and abs(x - y) <= 4}


def at(s):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


EVENTS = [("S", at(0), 0, "NEW"), ("S", at(2), 1, "CONFIRMED"), ("S", at(6), 2, "CONFIRMED"), ("S", at(20), 3, "REFINED"), ("S", at(30), 4, "REJECTED"), ("S", at(60), 5, "CONFIRMED"), ("T", at(0), 6, "REFINED")]
REASONS = ["created", "cooldown", "changed", "not allowed", "changed", "terminal", "created"]


def test_state_machine(spark):
    df = spark.createDataFrame(EVENTS, "signal_id string, ts timestamp, pos long, state string")
    out = sorted(G.replay(df).collect(), key=lambda r: (r.signal_id, r.ts))
    assert [r.reason for r in out] == REASONS and out[5].state == "REJECTED"
    m = G.Machine()
    for i in range(40):
        m.step(i * 10.0, "UNCERTAIN" if i % 2 else "CONFIRMED")
    assert m.changes == G.MAX_CHANGES


def test_streams_agree_with_batch(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, "signal_id string, ts timestamp, pos long, state string").withColumn("location", F.lit("f:1")).withColumn("description", F.col("state"))
    for i, part in enumerate(([0, 1, 2, 6], [3, 4, 5])):
        df.filter(F.col("pos").isin(part)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(make, mode):
        name = f"out_{make.__name__}"
        src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = make(src).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    rows = sorted(run(G.stream, "append"), key=lambda r: (r.signal_id, r.ts))
    assert [r.reason for r in rows] == REASONS

    def windows(s):
        return G.rate_stream(s, 60, "10 minutes")

    def firsts(s):
        return G.first_seen_stream(s, "10 minutes")

    assert sum(r["count"] for r in run(windows, "complete")) == len(EVENTS)
    assert len(run(firsts, "append")) == 4


def test_upsert_and_replace(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, kept string")
    new = spark.createDataFrame([(2, "B", "Z", 1), (2, "BB", "Z", 2), (3, "c", "w", 1)], "k int, v string, kept string, n int")
    assert sorted(map(tuple, W.upsert(old, new, ["k"], keep=["kept"], order="n").collect())) == [(1, "a", "x"), (2, "BB", "y"), (3, "c", "w")]
    assert sorted(r.v for r in W.insert_ignore(old, new, ["k"], "n").collect()) == ["a", "b", "c"]


def test_code_blocks_and_features(spark):
    code = "import a\n\ndef f(x):\n    return x\n\nclass B:\n    def g(self):\n        pass\n"
    assert one(spark, T.code_blocks(F.col("t")), t=code) == ["import a", "def f(x):\n    return x", "class B:\n    def g(self):\n        pass"]
    v = one(spark, R.text_features(F.col("t"), 12), t="def f():\n return 1")
    assert len(v) == 12 and v[0] == v[10] and v[2] == pytest.approx(0.1)


def test_typosquats_against_all_pairs(spark):
    from siftkite.operators import matching as M

    rng = random.Random(3)
    known = ["requests", "numpy", "flask", "pandas"]
    names = list({"".join(c for c in w if rng.random() > 0.1) + rng.choice(["", "s", "x"]) for w in known * 30} | {"reque5ts", "f1ask", "flask"})
    got = {(r.name, r.known) for r in M.typosquats(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(k,) for k in known], "known string"), [("l", "1"), ("s", "5")]).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    assert got == {(n, k) for n in names for k in known if distance(n, k) == 1 or (n != k and n in (k.replace("l", "1"), k.replace("s", "5")))}


def test_similar_classes_keep_every_row(spark):
    texts = {1: "a b c d", 2: "d C b a", 3: "a a b c d", 4: "a b c d e", 5: "e d c b a", 6: "x y", 7: "", 8: None}
    df = spark.createDataFrame(list(texts.items()), "i long, t string")
    classes = {r.i: r.id for r in R.similar_classes(df, "i", "t").collect()}
    assert classes == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    linked = {(r.a, r.b) for r in R.similar_pairs(df, "i", "t", 0.6).collect()}
    got = {(i, j) for i in classes for j in classes if i < j and (classes[i] == classes[j] or tuple(sorted((classes[i], classes[j]))) in linked)}
    sets = {i: set(t.lower().split()) for i, t in texts.items() if t}
    assert got == {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) > 0.6}


def test_scan_finds_every_match_of_a_line(spark):
    import re

    from siftkite.operators import patterns as P

    text = "12 345 x345 é 6789 345\n# 111\nnone\n222 \\ 222"
    catalog = [P.Pattern("number", "[0-9]{3,}"), P.Pattern("word", r"\b345\b")]
    df = spark.createDataFrame([("p", text)], "path string, content string")
    got = [(r.line, r.col, r.rule_id, r.match) for r in P.scan_lines(df, catalog).collect()]
    want = [(i, m.start(), p.rule_id, m.group()) for i, line in enumerate(text.split("\n"), 1) if not line.startswith("#") for p in catalog for m in re.finditer(p.regex, line)]
    assert sorted(got) == sorted(want)
    assert P.scan_lines(df, catalog, first=True).count() == 3


def test_evidence_of_two_rows_is_that_of_a_scan_in_order(spark):
    """Two rows 0.1 apart have a spread of 0.05 but for the last bits; the side is that of Welford's steps from the first row to the last."""
    rows = [(g, i, x / 100) for a in range(66, 91) for g, pair in ((a, (a, a + 10)), (-a, (a + 10, a))) for i, x in enumerate(pair)]
    score = S.evidence_score(F.col("x"), F.lit("long enough to count"), F.lit("N/A"), F.lit(""), order=F.col("i"))
    got = {r.g: r.s for r in spark.createDataFrame(rows, "g long, i long, x double").repartition(7, "i", "x").groupBy("g").agg(score.alias("s")).collect()}
    for a, (first, last) in {g: [x for h, _, x in rows if h == g] for g in got}.items():
        spread = (((last - (first + (last - first) / 2)) * (last - first)) / 2) ** 0.5
        full = 0.12 + (first + last) / 2 * 0.3 + 0.3
        assert abs(got[a] - min(0.95, full * (0.85 if spread < 0.05 and (first + last) / 2 > 0.7 else 1.0))) < 1e-12


def test_evidence_of_many_rows_is_that_of_a_scan_in_order(spark):
    """Spreads of 0.05 and means of 0.7 but for the last bits, of four rows and more, in any order and over several tasks; other groups, a null key and null values."""
    rng = random.Random(6)
    groups = {(f"r{a}", k): rng.sample([a] * k + [a + 10] * k, 2 * k) for a in range(60, 90) for k in (2, 3, 8)} | {("m", k): [70] * k for k in range(3, 30)} | {("n", k): [50, 90, 70] * k for k in range(2, 20)}
    groups |= {(None, 1): [90, 80, 80, 90], ("o", 1): [None, 20, 90], ("o", 2): [71]}
    rows = [(i, g, k, None if x is None else x / 100) for i, (g, k, x) in enumerate((g, k, x) for (g, k), values in groups.items() for x in values)]
    texts = [F.lit("long enough to count").alias("snippet"), F.lit("N/A").alias("location"), F.lit("").alias("reason")]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "pos long, g string, k int, x double").select("*", *texts).repartition(7)
    got = {(r.g, r.k): r.confidence for r in O.evidence_by(df, ["g", "k"], "x", "snippet", "location", "reason", "pos").collect()}
    want = {}
    for (g, k), values in groups.items():
        total = mean = square = 0.0
        for n, x in enumerate((0.5 if x is None else x / 100 for x in values), 1):
            new = mean + (x - mean) / n
            total, square, mean = total + x, square + (x - new) * (x - mean), new
        full = (0.3 if n <= 3 else 0.5 if n <= 6 else 0.7) * 0.4 + total / n * 0.3 + min(0.15 * n, 0.3)
        want[g, k] = min(0.95, full * (0.85 if math.sqrt(square / n) < 0.05 and total / n > 0.7 else 1.0))
    assert got == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("threshold, reach", [(0.0, False), (0.3, True), (1 / 3, True), (0.3333333333, False), (0.5, False), (0.8, False), (1.0, True)])
def test_similar_sets_are_those_of_all_pairs(spark, threshold, reach):
    """Sets on both sides of SHORT, common words in most of them."""
    rng = random.Random(3)
    sets = [(i, sorted({f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8, 10, 11, 12, 20, 30]))}), rng.choice(["x", None])) for i in range(160)]
    likeness = {(a, b): len({*x} & {*y}) / len({*x} | {*y}) for a, x, p in sets for b, y, q in sets if a < b and p == q and {*x} & {*y}}
    got = {(r.a, r.b): r.similarity for r in R.similar_sets(spark.createDataFrame(sets, "id long, w array<string>, by string"), threshold, reach=reach).collect()}
    assert got == {k: s for k, s in likeness.items() if (s >= threshold if reach else s > threshold)}


def test_large_sets_that_are_not_alike_are_not_written_out(spark):
    """Sets of 200 words of a vocabulary of 600 meet on many words; their maps tell nearly all of the pairs apart before any is shuffled."""
    rng = random.Random(9)
    sets = [(i, sorted(rng.sample([f"w{n}" for n in range(600)], 200))) for i in range(300)] + [(900, sorted(f"w{n}" for n in range(200))), (901, sorted(f"w{n}" for n in range(20, 200)))]
    out = R.similar_sets(spark.createDataFrame(sets, "id long, w array<string>"), 0.5)
    assert [tuple(r) for r in out.collect()] == [(900, 901, 0.9)]
    found, nodes = [], [out._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if "Aggregate" in node.nodeName() and "keys=[a#" in node.toString().split("\n")[0]:
            found.append(node.metrics().apply("numOutputRows").value())
        nodes += [node.plan()] if "QueryStage" in node.nodeName() else [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.children().apply(i) for i in range(node.children().size())]
    assert found and max(found) < 100


def test_sets_of_few_kinds_of_words_make_few_candidates(spark):
    """32,000 sets of four words, each of which thousands have: a join on single words would make over a hundred million pairs."""
    sets = spark.range(32_000).selectExpr("id", "array(concat('a', id % 8), concat('b', id div 8 % 8), concat('c', id div 64 % 10), concat('d', id div 640)) as w")
    assert R.similar_sets(sets, 0.5).count() == 32_000 * (7 + 7 + 9 + 49) // 2


def test_pairs_within_a_large_group_are_dealt_to_many_tasks(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"g{i % 20}", f"n{i % 7}") for i in range(600)], "k long, g string, name string")
    pairs = R.pairs_within(rows, ["g"], "k", {"k": "other", "name": "o_name"}, piece=20)
    got = [(r.k, r.other, r["name"], r.o_name) for r in pairs.collect()]
    of = {r.k: (r.g, r["name"]) for r in rows.collect()}
    assert sorted(got) == [(a, b, of[a][1], of[b][1]) for a in of for b in of if a < b and of[a][0] == of[b][0]]
    assert pairs.groupBy(F.spark_partition_id()).count().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_score_of_texts_is_found_once_for_each_kind(spark):
    rows = spark.createDataFrame([(i, 1, None if i == 5 else f"n{i % 2}") for i in range(8)], "k long, g long, name string")
    pairs = R.pairs_within(rows, ["g"], "k", {"k": "other", "name": "o_name"})
    asked = []
    got = R.by_kind(pairs, rows.select("g", "name").distinct(), "name", "o_name", ["g"], lambda x: asked.append(x.count()) or R.sequence_similarity(x, "name", "o_name"))
    assert got.count() == 28 and asked == [9] and {(r["name"], r.o_name): r.ratio for r in got.collect()}["n0", "n1"] == 0.5


def test_nearest_each_is_that_of_row_by_row(spark, monkeypatch):
    """Blocks smaller than a group, ties, copies, zero, null, broken and shorter vectors."""
    monkeypatch.setattr(R, "BLOCK", 20)
    rng = random.Random(5)
    vector = lambda i: {7: None, 8: [1.0, None, 2.0], 9: [1.0, 2.0], 10: [0.0] * 3, 11: [float("nan"), 1.0, 2.0]}.get(i, [float(rng.randint(-2, 2)) for _ in range(3)])
    df = spark.createDataFrame([(i, vector(i), i % 3 if i % 11 else None) for i in range(240)], "vec_id long, embedding array<float>, label int")
    queries = df.filter("vec_id % 5 = 0 or vec_id < 12")
    q = queries.select(F.col("vec_id").alias("query"), F.col("embedding").alias("_q"), F.col("label").alias("_by"))
    rows = df.join(q, (F.col("label") == F.col("_by")) & (F.col("vec_id") != F.col("query"))).select("query", "vec_id", F.round(R.cosine(F.col("embedding"), F.col("_q")), 9).alias("similarity"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "vec_id"))
    key = lambda r: (r.query, r.nth, r.vec_id, repr(r.similarity))
    assert sorted(map(key, R.nearest_each(df, queries).collect())) == sorted(map(key, rows.withColumn("nth", place).filter("nth <= 5").collect()))
    assert "cogroup" in R.nearest_each(df, queries)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_means_do_not_depend_on_the_order_of_rows(spark):
    values = [0.1, 0.7, 0.29, 0.57, 0.83, 0.01, 0.99, 0.58] * 24 + [0.4] * 8
    rows = [("f", "a", v, "low", "r") for v in values]
    odd = [("g", "a", 1e300, "low", "r"), ("g", "a", 1e300, "low", "r"), ("h", None, None, "low", "r"), ("i", "b", 1e-25, "low", "r"), ("i", "b", None, "low", "r"), ("j", "b", float("nan"), "low", "r")]
    exact = float(sum(map(Fraction, map(str, values)), Fraction()) / len(values))
    for order in (rows, sorted(rows), sorted(rows, reverse=True)):
        df = spark.createDataFrame(order + odd, "file_path string, source string, confidence double, severity string, rule_id string").coalesce(1)
        means = {r.file_path: r.confidence_by_source for r in O.confidence_by_source(df, ["file_path"]).collect()}
        assert means["f"] == {"a": exact} and means["g"] == {"a": 1e300} and means["h"] == {"Unknown": None} and means["i"] == {"b": 1e-25} and means["j"]["b"] != means["j"]["b"]
        assert {r.file_path: r.confidence for r in O.fuse(df, ["file_path"]).collect()}["f"] == exact


def test_means_by_source_add_up_in_the_order_of_positions(spark):
    rng = random.Random(4)
    rows = [(i, f"f{rng.randint(0, 2)}", rng.choice(["a", None]), rng.randint(0, 100) / 100 if i % 9 else None) for i in range(400)] + [(900, "g", "a", None)]
    sums = {}
    for _, f, s, x in rows:
        total, n = sums.setdefault((f, s or "Unknown"), (0.0, 0))
        sums[f, s or "Unknown"] = (total, n) if x is None else (total + x, n + 1)
    want = {k: total / n if n else None for k, (total, n) in sums.items()}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "pos long, file_path string, source string, confidence double").repartition(5)
    got = {(r.file_path, s): x for r in O.confidence_by_source(df, ["file_path"], "pos").collect() for s, x in r.confidence_by_source.items()}
    assert got == want


def test_confidence_by_source_has_the_digits_of_its_sql(spark, sf):
    """Lists of doubles are compared as they are, so all digits count."""
    import oracle

    from siftkite.plans import registry

    con = oracle.connect(sf)
    con.execute("set threads = 1")
    got = registry.queries()["confidence_by_source"](spark, sf).select("file_path", "sources", "means").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"select file_path, sources, means from ({registry.oracle_sql()['confidence_by_source']})").fetchall())


def test_links_are_dealt_to_as_many_tasks_as_they_ask_for(spark, sf, monkeypatch):
    from siftkite import staging
    from siftkite.plans.roles import Tables

    t = Tables(spark, sf)
    plain = sorted(map(tuple, t.cve_cwe.collect()))
    monkeypatch.setattr(staging, "TASK_ROWS", 100)
    assert t.cve_cwe.rdd.getNumPartitions() == -(-t.lineitem.count() // 100) and sorted(map(tuple, t.cve_cwe.collect())) == plain

    links = [(f"C{n}", "hot") for n in range(900)] + [(f"C{n}", f"W{n % 7}") for n in range(50)] * 2 + [("C1", None), ("none", "W8"), ("void", "W9"), ("nan", "W0")]
    scores = [(f"C{n}", n % 40 / 4) for n in range(0, 900, 2)] + [("C2", 9.75), ("C898", 9.75), ("void", None), ("nan", float("nan"))]
    cwe = spark.createDataFrame([(w, w.lower()) for w in ["hot", "bare", "W8", "W9", *(f"W{n}" for n in range(7))]], "cwe_id string, name string")
    out = W.cwe_with_cves(cwe, spark.createDataFrame(links, "cve_id string, cwe_id string"), spark.createDataFrame(scores, "cve_id string, score double"), 3)
    got = {r.cwe_id: r for r in out.collect()}
    for w in cwe.toPandas().cwe_id:
        own = sorted({c for c, x in links if x == w})
        joined = [(c, s) for c in own for s in ([s for k, s in scores if k == c] or [None])]
        joined.sort(key=lambda x: (x[1] is None, x[1] == x[1], -(x[1] or 0.0), x[0]))
        values = [s for _, s in joined if s is not None]
        assert (got[w].cves, got[w].top_cves) == (len(own), [c for c, _ in joined[:3]] or None)
        assert w == "W0" or (got[w].avg_score, got[w].max_score, got[w].min_score) == ((pytest.approx(sum(values) / len(values)), max(values), min(values)) if values else (0, 0, 0))
