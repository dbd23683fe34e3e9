import random

from siftkite.operators import containment as K


def test_containing_is_that_of_all_pairs(spark):
    rng = random.Random(6)
    make = lambda n: "".join(rng.choices(["a", "b", "c", "é", "𝒳", "\n", "%", "."], k=n))
    texts = [(i, make(rng.choice([0, 1, 2, 5, 40, 200])), rng.choice(["x", "y", None])) for i in range(150)] + [(900, None, "x"), (901, "a" * 50_000 + "b", "x"), (902, "aaaa", "x")]
    patterns = [(make(rng.choice([1, 2, 3, 4, 6, 9])), rng.choice(["x", "y", None])) for _ in range(200)]
    patterns += [(t[5 : 5 + n], b) for _, t, b in texts if t and len(t) > 30 for n in (12, 20)] + [("", "x"), (None, "x"), ("a" * 60, "x"), ("aab", "x"), ("nowhere at all", "x")]
    left = spark.createDataFrame([(*t, 1) for t in texts], "id long, text string, by string, pattern int")
    right = spark.createDataFrame([(*p, 1) for p in patterns] * 2, "pattern string, by string, id int")
    got = [(r.by, r.pattern, r.id) for r in K.containing(left.select("id", "text", "by"), right.select("pattern", "by")).collect()]
    want = {(b, p, i) for i, t, b in texts for p, c in patterns if b == c and p and t is not None and p in t}
    assert len(got) == len(set(got)) and set(got) == want
    assert {(r.pattern, r.id) for r in K.containing(left.select("id", "text"), right.select("pattern"), tiers=(1, 4)).collect()} == {(p, i) for i, t, _ in texts for p, _ in patterns if p and t is not None and p in t}
    assert K.containing(left.select("id", "text"), right.select("pattern").limit(0)).count() == 0
    assert K.containing(left.limit(0).select("id", "text"), right.select("pattern")).count() == 0


def test_patterns_that_share_a_prefix(spark):
    """Ten thousand names that differ in their digits against texts with one each."""
    texts = spark.range(3000).selectExpr("id", "concat('in module ', cast(id * 7 as string), '_component.handler it fails') as text")
    patterns = spark.range(10_000).selectExpr("concat('module ', cast(id as string), '_component') as pattern")
    got = K.containing(texts, patterns)
    assert got.count() == sum(1 for i in range(3000) if i * 7 < 10_000)


def test_edges_of_copies(spark):
    knowledge = spark.createDataFrame([("a", "x y"), ("b", "Y, x"), ("c", "x y z"), ("d", None), ("e", "")], "id string, content string")
    patterns = spark.createDataFrame([("p", "y"), ("q", ""), ("r", None), ("s", "y z")], "id string, value string")
    got = {(r.source, r.target, r.relationship, round(r.weight, 3)) for r in K.knowledge_edges(knowledge, patterns).collect()}
    both = lambda a, b, w: {(a, b, "related_to", w), (b, a, "related_to", w)}
    assert got == both("a", "b", 1.0) | both("a", "c", 0.667) | {(i, "p", "contains_pattern", 0.8) for i in "ac"} | {("c", "s", "contains_pattern", 0.8)}
