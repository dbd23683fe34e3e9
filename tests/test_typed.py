import json
import random

from siftkite.operators import typed as T


def merged(values):
    """The rule by itself: (value, weight) pairs in order."""
    if len(values) == 1:
        return values[0][0]
    first = values[0][0]
    if all(isinstance(v, (int, float)) for v, _ in values):
        total = sum(w for _, w in values)
        if total <= 0:
            return first
        mean = sum(v * w for v, w in values) / total
        return round(mean) if all(isinstance(v, int) for v, _ in values) else round(mean, 4)
    if isinstance(first, list):
        out, seen = [], set()
        for v, _ in values:
            for x in v if isinstance(v, list) else []:
                key = x if isinstance(x, str) else json.dumps(x, sort_keys=True)
                if key not in seen:
                    seen.add(key)
                    out.append(x)
        return out
    if isinstance(first, dict):
        own = [(v, w) for v, w in values if isinstance(v, dict)]
        return {k: merged([(v[k], w) for v, w in own if k in v]) for k in {k for v, _ in own for k in v}}
    votes = {}
    for v, w in values:
        key = (v if isinstance(v, str) else json.dumps(v, sort_keys=True, separators=(",", ":"))).strip(" ").lower()
        votes[key] = (votes[key][0], votes[key][1] + w) if key in votes else (v, w)
    return votes[max(votes, key=lambda k: votes[k][1])][0]


def test_merges_are_those_of_the_rule(spark):
    rng = random.Random(7)

    def some(depth):
        kind = rng.choice(["n", "s", "l", "o", "b", "0"] if depth else ["n", "s", "f"])
        return {
            "n": lambda: rng.randrange(-5, 6), "f": lambda: rng.choice([0.5, 1.25, -2.125]), "s": lambda: rng.choice(["a", " A ", "b", "é\"", ""]), "b": lambda: rng.choice([True, False]), "0": lambda: None,
            "l": lambda: [rng.choice([1, "1", "x", None, {"k": 1}, [2]]) for _ in range(rng.randrange(4))],
            "o": lambda: {rng.choice(["p", "q", 'r"', "é"]): some(depth - 1) for _ in range(rng.randrange(4))},
        }[kind]()

    groups = {g: [({"sev": rng.choice(["high", "HIGH", "low"]), "n": rng.randrange(9), "deep": {"x": {"y": some(2)}}} if g % 3 == 0 else some(3), rng.choice([1.0, 0.5, 0.25])) for _ in range(rng.choice([1, 2, 3, 6]))] for g in range(120)}
    groups[500] = [(1, 0.0), (3, 0.0)]
    groups[501] = [({}, 1.0), ({}, 1.0), ("x", 9.0)]
    groups[502] = [([], 1.0), ([], 1.0)]
    rows = [(g, i * 2, w, json.dumps(v)) for g, vs in groups.items() for i, (v, w) in enumerate(vs)]
    rows += [(600, 1, 1.0, "{broken"), (600, 2, 1.0, None), (601, 1, None, '"kept"'), (601, 2, 1.0, "{broken")]
    df = spark.createDataFrame(rows, "g int, pos int, weight double, json string").repartition(4)
    got = {r.g: json.loads(r.json) for r in T.merge_typed(df, "g").collect()}
    want = {g: merged(vs) for g, vs in groups.items()} | {601: "kept"}
    assert got == want
    assert T.merge_typed(df.limit(0), "g").count() == 0


def test_equal_weights_are_equal_whatever_their_sums_order(spark):
    rows = [("v", 1, 0.3, '"b"'), ("v", 2, 0.1, '"a"'), ("v", 3, 0.2, '"a"'), ("m", 1, 0.1, "1"), ("m", 2, 0.2, "3"), ("m", 3, -0.3, "5")]
    df = spark.createDataFrame(rows, "g string, pos int, weight double, json string").coalesce(1)
    assert {r.g: json.loads(r.json) for r in T.merge_typed(df, "g").collect()} == {"v": "b", "m": 1}


def test_json_as_it_came(spark):
    """White space, empty values and text after the value."""
    cases = {"{ }": {}, "[ ]": [], ' { "a" : 1.0 } ': {"a": 1}, '{} {"a":1}': {}, '{"b": [1, 2 ]} x': {"b": [1, 2]}, "[\n]": [], '{\t"a":{ }}': {"a": {}}}
    rows = [(f"{name}{n}", i, 1.0, name) for name in cases for n in (1, 2) for i in range(n)]
    rows += [("vote", 1, 1.0, '"x"'), ("vote", 2, 1.0, '{ "a":1 }'), ("vote", 3, 1.0, '{"a": 1}')]
    df = spark.createDataFrame(rows, "g string, pos int, weight double, json string")
    got = {r.g: r.json for r in T.merge_typed(df, "g").collect()}
    assert {g: json.loads(j) for g, j in got.items() if g != "vote"} == {f"{name}{n}": v for name, v in cases.items() for n in (1, 2)}
    assert got["vote"] == '{"a":1}'


def test_equal_values_are_one_row_of_the_next_level(spark, monkeypatch):
    staged = []
    own = T.stage

    def counted(df, name, *rest):
        out = own(df, name, *rest)
        staged.append(out.count())
        return out

    monkeypatch.setattr(T, "stage", counted)
    rows = [(i % 2, i, 1.0, json.dumps({"s": "ab"[i % 4 // 2], "l": [i % 3], "o": {"n": i % 5}})) for i in range(600)]
    got = T.merge_typed(spark.createDataFrame(rows, "g int, pos int, weight double, json string").repartition(4), "g").collect()
    assert {r.g: json.loads(r.json) for r in got} == {0: {"s": "a", "l": [0, 2, 1], "o": {"n": 2}}, 1: {"s": "a", "l": [1, 0, 2], "o": {"n": 2}}}
    assert staged[0] == 600 and max(staged[1:]) <= 30
