import hashlib
import random
import zlib
from collections import Counter

import oracle
import pytest

from siftkite import scan
from siftkite.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, rank string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, key, role, text))
    own = {c: [(role, text) for *_, role, text in sorted(v)] for c, v in own.items()}
    nodes = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c / 5) * 5
        seq = tuple(own.get(c - base, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append((c, len(seq) == d))
    leaves, saved, children = Counter(), Counter(), Counter()
    for path, members in nodes.items():
        weight = (len(members) - 1) * (len(path[-1][1].encode()) if path else 0)
        if path:
            children[path[:-1]] += 1
        for d in range(len(path) + 1):
            saved[path[:d]] += weight
    for path in nodes:
        if not children[path]:
            for d in range(len(path) + 1):
                leaves[path[:d]] += 1
    out = Counter()
    for path, members in nodes.items():
        ends = ",".join(str(c) for c, last in sorted(members) if last)
        parent = min(nodes[path[:-1]])[0] if path else None
        out[min(members)[0], len(path), parent, len(members), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def some_rows():
    rng = random.Random(5)
    rows = []
    for c in [*range(150), *range(-12, 0), 10**12, 10**12 + 3]:
        for k in range(rng.choice([1, 1, 2, 3, 4, 9, 12])):
            rows.append((c, rng.choice([k, k, k, None]), rng.choice(["user", "bot", None, ""]), rng.choice(["a", "é", None, "", "aa"])))
    for c in (200, 205, 210, 1000, 1005):  # deep ones that share most of their turns, and a hot group of copies
        rows += [(c, k, "u", f"turn {k if k != 150 else c}") for k in range(160 + c % 7)]
    rows += [(c, k, "u", f"copy {k}") for c in range(300, 400) for k in range(3)]
    rows += [(None, 1, "u", "lost"), (500, 1, "u", "x" * 200_000), (501, 1, "u", "x" * 200_000)]
    return rows + rows[10:20] * 2


def test_the_trie_is_that_of_the_definition(spark, monkeypatch):
    rows = some_rows()
    want = brute(rows)
    convs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(6)
    for block, piece in ((4, 7), (64, 4096)):
        monkeypatch.setattr(trie, "BLOCK", block)
        monkeypatch.setattr(trie, "PIECE", piece)
        out = trie.rebuilt_trie(convs).collect()
        assert Counter(tuple(r[c] for c in COLUMNS) for r in out) == want
        by = sorted(out, key=lambda r: r.first_at)
        assert [r.first_at for r in by] == list(range(len(by)))
        for r in by:  # the interval is the subtree: deeper nodes up to the next that isn't
            end = next((x.first_at for x in by[r.first_at + 1 :] if x.depth <= r.depth), len(by))
            assert r.last_at == end - 1
    assert trie.rebuilt_trie(convs.limit(0)).count() == 0


def test_conversations_without_turns_end_at_the_root(spark):
    turns = spark.createDataFrame([(1, 0, "k", 3)], "conv_id long, at long, key string, size long")
    out = trie.prefix_trie(turns, spark.createDataFrame([(1,), (2,), (0,)], "conv_id long")).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in out) == [(0, 0, None, 3, 1, 1, 0, hashlib.sha256(b"0,2").hexdigest()), (1, 1, 0, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]
    assert trie.prefix_trie(turns.limit(0), spark.createDataFrame([(4,)], "conv_id long")).count() == 1


@pytest.mark.parametrize("group", ["g", None])
def test_prefix_sums(spark, group):
    rng = random.Random(1)
    rows = [(rng.choice([3, 3, 3, 3, 5, -2, 9]), rng.randrange(1000), rng.randrange(-(2**63), 2**63), i % 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, o long, v long, w long").repartition(9)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        for merged in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
            out = scan.prefix_sums(df, group, ["o", "v"], ["v", "w"]).collect()
            assert Counter((r.g, r.o, r.v, r.w) for r in out) == Counter(rows)
            for key in {r.g if group else 0 for r in out}:
                own = sorted((r for r in out if not group or r.g == key), key=lambda r: r["at"])
                v = w = 0
                for k, r in enumerate(own):
                    assert (r["at"], (r.before_v - v) % 2**64, r.before_w) == (k, 0, w)
                    v, w = v + r.v, w + r.w
                assert [(r.o, r.v) for r in own] == sorted((r.o, r.v) for r in own)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert scan.prefix_sums(df.limit(0), group, ["o"], ["w"]).count() == 0


def test_op11_is_its_sql(spark, sf):
    assert oracle.differences(queries.op11_prefix_trie(spark, sf), oracle.connect(sf), queries.OP11_SQL) == ""
