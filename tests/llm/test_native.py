import random
from datetime import date, timedelta

import pytest
import xxhash

from siftkite.llm import urlfilter, winnow

M = (1 << 64) - 1


def rot(x, b):
    return ((x << b) | (x >> (64 - b))) & M if b else x


def brute_marks(text, k=winnow.K, w=winnow.W):
    text = (text or "").lower()
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in text.split(" ") if x]
    if not h:
        return []
    if len(h) < k:
        a = 0
        for x in h:
            a = rot(a, 1) ^ x
        grams = [a]
    else:
        grams = []
        for i in range(len(h) - k + 1):
            a = 0
            for x in h[i : i + k]:  # the rolling form: turn, then take the next word in
                a = rot(a, 1) ^ x
            grams.append(a)
    out = []
    for i in range(max(1, len(grams) - w + 1)):
        at = min(range(i, min(i + w, len(grams))), key=lambda j: (grams[j] >> 33, -j))
        if not out or out[-1] != at:
            out.append(at)
    signed = [g - (1 << 64) if g >> 63 else g for g in grams]
    return [(signed[i], i) for i in out]


def brute_likeness(a, b):
    a, b = {x for x, _ in a}, {x for x, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("gap", [1, 700, 1 << 40])
def test_edited_fingerprints(spark, gap):
    rng = random.Random(3)
    texts = [None, "", "one", "a b c d e", "É é naïve 日本 words " * 9, "same same same same same same " * 20, " \t"]
    texts += [" ".join(rng.choices(["red", "blue", "Green", "sky", "sea"], k=rng.randrange(1, 80))) for _ in range(40)]
    texts += ["word " * 30_000, texts[10], texts[10]]
    rows = [(-(i % 3) * 5 + i * gap, t, "m", "e") for i, t in enumerate(texts)] + [(None, "no id " * 9, "m", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, marks string, edited string").repartition(5)
    out = {r.doc_id: r for r in winnow.edited_fingerprints(df).withColumns({"near": winnow.likeness("marks", "edited_marks"), "near_next": winnow.likeness("marks", "next_marks"), "said": winnow.written("marks")}).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(out) == len(rows)
    for (i, text, *_), (_, following, *_) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        text, following, r = text or "", following or "", out[i]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        assert (r.n_chars, r.edited) == (len(text), edited)
        assert [tuple(x) for x in r.marks] == brute_marks(text) and [tuple(x) for x in r.edited_marks] == brute_marks(edited)
        assert r.near == pytest.approx(brute_likeness(brute_marks(text), brute_marks(edited)))
        assert r.near_next == pytest.approx(brute_likeness(brute_marks(text), brute_marks(following)))
        assert r.said == " ".join(f"{h & M:x}:{a}" for h, a in brute_marks(text))


def test_names_of_the_caller_stay(spark):
    df = spark.createDataFrame([("a b c d e f g", 1, 2, 3, 4, 5, "x")], "t string, _h int, _g int, _at int, _m0 int, _m int, marks string")
    row = winnow.with_marks(df, "t", "marks").first()
    assert (row._h, row._g, row._at, row._m0, row._m) == (1, 2, 3, 4, 5) and [tuple(x) for x in row.marks] == brute_marks("a b c d e f g")
    captures = spark.createDataFrame([(1, "http://a.x.org/", date(2024, 1, 5), "h", "a", "w", "s")], "page_id long, url string, fetched date, hit string, _at string, _host string, _hit string")
    listed = spark.createDataFrame([("x.org", date(2024, 1, 1), 1, "block")], "pattern string, effective date, seq int, action string")
    row = urlfilter.judge(captures, listed).first()
    assert (row.hit, row._at, row._host, row._hit, row.host, row.pattern, row.action) == ("h", "a", "w", "s", "a.x.org", "x.org", "block")


def test_addresses_have_no_parent(spark):
    day = date(2024, 1, 1)
    urls = ["http://1.2.3.4/x", "http://u@2.3.4:80/", "http://[::1]:8080/x", "https://[2001:DB8::7]", "http://a.2.3.4/", "http://[::1"]
    listed = spark.createDataFrame([(p, day, 1, "block") for p in ("2.3.4", "[::1]", "1.2.3.4", "4")], "pattern string, effective date, seq int, action string")
    captures = spark.createDataFrame([(u, day) for u in urls], "url string, fetched date")
    got = {r.url: (r.host, r.pattern) for r in urlfilter.judge(captures, listed).collect()}
    assert [got[u] for u in urls] == [("1.2.3.4", "1.2.3.4"), ("2.3.4", "2.3.4"), ("[::1]", "[::1]"), ("[2001:db8::7]", None), ("a.2.3.4", "2.3.4"), (None, None)]


def test_shared_passages_are_found(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(winnow.K + winnow.W - 1))
    rows = [(i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 50))) + " " + passage + " " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(40))) for i in range(20)]
    marks = [{x.hash for x in r.marks} for r in winnow.with_marks(spark.createDataFrame(rows, "doc_id long, text string"), "text", "marks").collect()]
    assert set.intersection(*marks)


def test_no_rows_and_one_row(spark):
    one = spark.createDataFrame([(7, "a b c d e f g h")], "doc_id long, text string")
    assert winnow.edited_fingerprints(one.limit(0)).count() == 0
    assert winnow.edited_fingerprints(one).first().edited == "a b c d e f g h"[:12] + "a b c d e f g h"[:3]


def test_successors(spark):
    rng = random.Random(2)
    keys = sorted({rng.choice([rng.randrange(-50, 50), rng.randrange(-(1 << 54), 1 << 54), rng.randrange(1 << 20)]) for _ in range(400)})
    got = {r.key: r.next for r in winnow.successors(spark.createDataFrame([(k,) for k in keys], "key long")).collect()}
    assert got == dict(zip(keys, [*keys[1:], None], strict=True))


def brute_judge(url_host, at, entries):
    best = None
    labels = url_host.split(".") if url_host and at else []
    for i in range(len(labels)):
        pattern = ".".join(labels[i:])
        own = sorted((e for e in entries if e[0] and e[1] and e[3] and e[0].lower() == pattern and e[1] <= at), key=lambda e: (e[1], e[2], e[3]))
        if own and own[-1][3] != "lift":
            best = best or (pattern, own[-1][3], own[-1][1])
    return best or (None, "none", None)


def test_judge(spark):
    rng = random.Random(1)
    day = lambda: date(2024, 1, 1) + timedelta(days=rng.randrange(60))
    hosts = ["a.b.example.com", "b.example.com", "example.com", "x.org", "other.net", "com"]
    entries = [(rng.choice(hosts).upper() if rng.random() < 0.2 else rng.choice(hosts), day(), n, rng.choice(["block", "allow", "lift"])) for n in range(60)]
    entries += [(None, day(), 1, "block"), ("x.org", None, 1, "block"), ("x.org", day(), 1, None)]
    shapes = ["http://{}/p", "https://u:p@{}:8080?q", "HTTP://{}", "ftp://{}.#f"]
    rows = [(i, rng.choice(shapes).format(h := rng.choice(hosts)), day(), "keep", h) for i in range(150)]
    rows += [(900, None, day(), "keep", None), (901, "no url", day(), "keep", None), (902, "http://x.org/", None, "keep", "x.org"), rows[0], rows[0]]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched date, action string, want string").repartition(3)
    listed = spark.createDataFrame(entries, "pattern string, effective date, seq int, action string")
    out = urlfilter.judge(captures, listed).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.host == r.want
        assert (r.pattern, r.action, r.since) == brute_judge(r.want, r.fetched, entries)
    assert {r.action for r in urlfilter.judge(captures, listed.limit(0)).collect()} == {"none"}
    assert urlfilter.judge(captures.limit(0), listed).count() == 0
