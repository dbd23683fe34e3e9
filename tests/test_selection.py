import math
import random

import pytest
from pyspark.sql import functions as F

from siftkite.operators import selection as Y


@pytest.mark.parametrize("kind", ["double", "long"])
def test_selection_is_that_of_sorting(spark, monkeypatch, kind):
    monkeypatch.setattr(Y, "BUCKETS", 7)
    monkeypatch.setattr(Y, "FEW", 5)
    rng = random.Random(3)
    if kind == "double":
        draw = {"few": lambda: rng.choice([1.0, 2.0, 2.5]), "flat": lambda: 4.0, "odd": lambda: rng.choice([None, math.nan, -math.inf, math.inf, 0.0, 5e-324, 1e308, -1e308, rng.gauss(0, 1)]), None: rng.random}
    else:
        draw = {"few": lambda: rng.choice([1, 2]), "flat": lambda: 4, "odd": lambda: rng.choice([None, 2**63 - 1, -(2**63), 2**62 + rng.randrange(40), 0]), None: lambda: rng.randrange(10**9)}
    rows = [(g, i % 2, draw[g](), i) for g in draw for i in range(300)] + [("lone", 0, 7, 9000), ("none", 1, None, 9001)]
    if kind == "double":
        rows = [(g, s, None if v is None else float(v), i) for g, s, v, i in rows]
    df = spark.createDataFrame(rows, f"g string, s int, v {kind}, pos long").repartition(4)
    groups = {}
    for g, s, v, i in rows:
        if v is not None and v == v:
            groups.setdefault((g, s), []).append((v, i))
    for rank in (F.floor(F.col("n") / 2), F.lit(0), F.col("n") - 1, F.col("n") - 40):
        at = {"n": len}
        got = {(r.g, r.s): (r.n, r["rank"], r.value, r.less) for r in Y.value_at(df, ["g", "s"], "v", rank).collect()}
        want = {}
        for k, v in groups.items():
            i = got[k][1] if k in got else None
            n = at["n"](v)
            if i is not None:
                value = sorted(v)[i][0]
                want[k] = (n, i, value, sum(x < value for x, _ in v))
        assert got == want
    got = {(r.g, r.s): (r.v, r.pos) for r in Y.row_at(df, ["g", "s"], "v", "pos", F.floor(F.col("n") / 2)).collect()}
    assert got == {k: sorted(v)[len(v) // 2] for k, v in groups.items()}
    assert set(got) == set(groups)


@pytest.mark.parametrize("share", [0.0, 0.3, 0.95, 1.0])
def test_top_share(spark, monkeypatch, share):
    monkeypatch.setattr(Y, "FEW", 8)
    rng = random.Random(5)
    rows = [(i * 7 % 1000, rng.choice([None, math.nan, 1.0, 2.0, rng.random()])) for i in range(200)]
    df = spark.createDataFrame(rows, "pos long, score double").repartition(3)
    order = sorted(rows, key=lambda r: (r[1] is None or r[1] != r[1], -(r[1] if r[1] is not None and r[1] == r[1] else 0), r[0]))
    assert sorted(r.pos for r in Y.top_share(df, "score", "pos", share).collect()) == sorted(p for p, _ in order[: max(1, int(share * 200))])
    assert Y.top_share(df.limit(0), "score", "pos", share).count() == 0
