import random
import re

import pytest

from siftkite.llm import decontam


def brute(pattern, text):
    """Least distance of the pattern to any part of the text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        i = rng.randrange(len(chars))
        rng.choice([lambda i=i: chars.pop(i), lambda i=i: chars.insert(i, "#"), lambda i=i: chars.__setitem__(i, "%")])()
    return "".join(chars)


def test_myers():
    rng = random.Random(5)
    for _ in range(60):
        p = "".join(rng.choices("abé", k=rng.randrange(1, 90)))
        t = "".join(rng.choices("abé", k=rng.randrange(0, 120)))
        d, end = decontam.myers(p, t)
        assert d == brute(p, t) and (d == len(p) or brute(p, t[:end]) == d)


def test_pieces():
    assert decontam.pieces(10, 2) == [(0, 3), (3, 6), (6, 10)] and decontam.pieces(5, 0) == [(0, 5)]


@pytest.fixture(scope="module")
def data():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(10, 50))).capitalize()) for i in range(12)]
    items += [(20, items[0][1]), (21, None), (22, ""), (23, "short"), (24, "Zq 17"), (25, "q")]
    docs = []
    for i in range(120):
        text = " ".join(word() for _ in range(rng.randrange(0, 60)))
        if i % 3 == 0:
            _, item = items[rng.randrange(12)]
            text += "\n" + edited(rng, item.upper() if i % 2 else item, rng.randrange(0, 2 + len(item) // 12)) + " " + " ".join(word() for _ in range(5))
        docs.append((i, text, "b", i))
    docs += [(200, None, "b", 0), (201, "", "b", 0), (None, items[1][1], "b", 0), (5, items[2][1] * 2, "b", 0), (5, items[2][1] * 2, "b", 0), (202, "x" * 200_000 + " " + items[3][1], "b", 0)]
    docs += [(210, "a shortage, too Short.", "b", 0), (211, "shortshort ashort", "b", 0), (212, "(zq\n17)", "b", 0), (213, "zq 175 azq 17 zq 17", "b", 0)]
    return docs, items


def expected(docs, items):
    out = []
    for i, text, *_ in docs:
        for n, item in items:
            item = decontam.plain(item)
            if item and len(item) < decontam.MIN_CHARS:
                if re.search(r"(?<![^\W_])" + re.escape(item) + r"(?![^\W_])", decontam.plain(text)):
                    out.append((i, n, 0))
            elif item:
                short = decontam.plain(text)[-3000:]
                d = brute(item, short)
                if d <= int(len(item) * decontam.ERROR_RATE):
                    out.append((i, n, d))
    return sorted(out, key=str)


def test_against_brute_force(spark, data):
    docs, items = data
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string, start int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = expected(docs, items)
    assert any(x[2] for x in want) and len(want) < len(docs)
    for size in (decontam.PASS_CHARS, 300):  # 300: many passes
        out = decontam.find_leaks(d, b, pass_chars=size).collect()
        assert sorted(((r.doc_id, r.item_id, r.distance) for r in out), key=str) == want
        texts, by_item = {x[0]: decontam.plain(x[1]) for x in docs}, dict(items)
        for r in out:
            assert brute(decontam.plain(by_item[r.item_id]), texts[r.doc_id][r.start : r.end]) == r.distance <= r.budget
        left = decontam.drop_leaks(d, b, pass_chars=size)
        assert left.columns == d.columns
        clean = [x for x in docs if not expected([x], items)] if size == 300 else None
        assert clean is None or sorted(map(str, left.collect())) == sorted(map(str, spark.createDataFrame(clean, d.schema).collect()))


def test_empty(spark, data):
    d = spark.createDataFrame(data[0], "doc_id long, text string, item_id string, start int")
    b = spark.createDataFrame(data[1], "item_id long, text string")
    assert decontam.find_leaks(d, b.limit(0)).count() == 0 == decontam.find_leaks(d.limit(0), b).count()
    assert decontam.drop_leaks(d, b.limit(0)).count() == len(data[0]) and decontam.drop_leaks(d.limit(0), b).count() == 0
