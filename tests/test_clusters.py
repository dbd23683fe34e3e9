import random
import re

import pytest

from siftkite import scan
from siftkite.operators import clusters as C

ROW = "g string, k long, t string, seed int"


def greedy(rows, threshold):
    """The loop that the operator's rounds stand for."""
    out, seeds = {}, {}
    for g, k, t in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        own = set(re.findall(r"\w+", (t or "").lower()))
        seed = next((s for s, w in seeds.setdefault(g, []) if own & w and len(own & w) / len(own | w) > threshold), None)
        if seed is None:
            seeds[g].append((k, own))
        out[g, k] = k if seed is None else seed
    return out


@pytest.mark.parametrize("block", [10, 8192])
def test_greedy_clusters_are_those_of_the_loop(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rng = random.Random(block)
    words = ["a", "b", "C", "dé", "e_1", "f", "g", "h"]
    rows = [(rng.choice(["g", "h", None]), k, " ".join(rng.choices(words, k=rng.randrange(0, 6)))) for k in range(250)]
    rows += [("chain", k, " ".join(f"w{i}" for i in range(k, k + 8))) for k in range(150)]  # each resembles those around it
    rows += [("order", 1, "a b c d"), ("order", 2, "b c d e"), ("order", 3, "c d e f"), ("h", 900, None), ("h", 901, "...")]
    df = spark.createDataFrame([(*r, 1) for r in rows], ROW).repartition(4)
    got = {(r.g, r.k): r.seed for r in C.greedy_clusters(df, "g", "k", "t", 0.55).collect()}
    assert got == greedy(rows, 0.55)
    assert C.greedy_clusters(df.limit(0), "g", "k", "t", 0.55).count() == 0


def test_a_group_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 20_000)
    rows = [("hot", k, f"a{k % 50_000} b{k % 50_000} c{(k * 7) % 3} d{(k + 1) % 50_000}") for k in range(100_000)]
    got = {(r.g, r.k): r.seed for r in C.greedy_clusters(spark.createDataFrame([(*r, 1) for r in rows], ROW), "g", "k", "t", 0.7).collect()}
    sets, want = {}, {}
    for g, k, t in rows:  # only rows of equal k % 50000 share three words
        w = set(t.split())
        seed = next((s for s, u in sets.setdefault(k % 50_000, []) if len(w & u) / len(w | u) > 0.7), None)
        if seed is None:
            sets[k % 50_000].append((k, w))
        want[g, k] = k if seed is None else seed
    assert got == want


def votes_loop(rows):
    clusters, out = [], {}
    for file, pos, line, finding, text in sorted(rows, key=lambda r: r[1]):
        file, words, line = file or "", set((text or "").lower().split()), -1 if line is None else line
        mine = None
        for c in clusters:
            same_file = file == c["file"]
            both = line >= 0 and c["line"] >= 0
            near = same_file and (not both or abs(line - c["line"]) <= 5)
            alike = bool(words and c["words"]) and len(words & c["words"]) / len(words | c["words"]) >= 0.6
            if (finding and finding in c["findings"]) or (near and alike) or (same_file and both and abs(line - c["line"]) <= 2):
                mine = c
                break
        if mine is None:
            mine = {"file": file, "line": line, "words": words, "findings": set(), "seed": pos}
            clusters.append(mine)
        mine["findings"].add(finding)
        out[pos] = mine["seed"]
    return out


@pytest.mark.parametrize(("case", "block"), [(0, 4), (1, 50), (2, 8192), (3, 50)])
def test_vote_clusters_are_those_of_the_loop(spark, monkeypatch, case, block):
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "RUN", 3)
    rng = random.Random(case)
    lines = [[10, 12, 14, 16, 40, None], [*range(60)], [7, 8, -1, None], [*range(0, 400, 2)]][case]
    words = ["a", "b", "c", "d", "e", "f"]
    rows = []
    for pos in range(260):
        line = lines[pos % len(lines)] if case == 3 else rng.choice(lines)
        rows.append((rng.choice(["f", "g", None]) if case != 3 else "f", pos * 3, line, rng.choice([None, "", f"F{rng.randrange(90)}", f"G{pos}"]), rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(1, 6)))])))
    df = spark.createDataFrame(rows, "file string, pos long, line int, finding_id string, description string").repartition(3)
    got = {r.pos: r.seed for r in C.vote_clusters(df).collect()}
    assert got == votes_loop(rows)
    if case == 0:
        assert C.vote_clusters(df.limit(0)).count() == 0


def test_decide_long_chains(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 500)
    n, rng = 3000, random.Random(2)
    inputs = {i: ([i - 1] if i else []) if i < 1500 else sorted({i - 1, i - 2, rng.randrange(i)}) for i in range(n)}
    nor = {i: i % 3 > 0 or i < 1500 for i in range(n)}
    want = {}
    for i in range(n):
        want[i] = any(want[x] for x in inputs[i]) != nor[i]
    df = spark.createDataFrame([(i, nor[i], inputs[i]) for i in range(n)], "at long, nor boolean, inputs array<long>")
    assert {r["at"]: r.value for r in C.decide(df).collect()} == want


def test_scan_is_shared(spark):
    df = spark.createDataFrame([(2, 5), (1, 3), (2, 4)], "g long, v long")
    out = scan.prefix_sums(df, "g", ["v"], ["v"]).collect()
    assert sorted((r.g, r.v, r["at"], r.before_v) for r in out) == [(1, 3, 0, 0), (2, 4, 0, 0), (2, 5, 1, 4)]


def test_clusters_become_one_item(spark):
    import hashlib

    rows = [("a", 1, "t", "x y z", "s", 0.5, ["q", "p"], {"k": "1", "m": "1"}), ("b", 2, "t", "x y z w", "s", 0.75, ["p"], {"k": "2"}), ("c", 3, "t", "other", "s", 0.1, None, None), ("d", 4, "u", "x y z", "s", 0.2, [], {})]
    df = spark.createDataFrame(rows, "id string, pos long, type string, content string, source string, confidence double, tags array<string>, metadata map<string,string>")
    got = {(r.id, r.type, r.content, r.source, r.confidence, tuple(r.tags), tuple(sorted(r.metadata.items())), r.n) for r in C.merged_knowledge(df).collect()}
    merged = hashlib.sha256(b"merged_a_b").hexdigest()[:16]
    assert got == {(merged, "t", "x y z x y z w", "merged_learning", 0.625, ("p", "q"), (("k", "2"), ("m", "1")), 2), ("c", "t", "other", "s", 0.1, (), (), 1), ("d", "u", "x y z", "s", 0.2, (), (), 1)}
