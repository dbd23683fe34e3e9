import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from siftkite.llm import langid, lmscore, ppm
from siftkite.llm.common import text_buffer

EN = "the cat and the dog went to the house with that thing and this one"
FR = "le chat et la maison sont dans une ville avec des rues très étroites"


def plain(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    return [w for w in lower.split(" ") if w]


class BrutePpm:
    """PPM by walking the tree for one byte after another."""

    def __init__(self, texts, order):
        self.order, self.counts = order, defaultdict(Counter)
        for row in texts:
            row = bytes([ppm.END]) * order + row
            for i in range(order, len(row)):
                for k in range(order + 1):
                    self.counts[row[i - k : i]][row[i]] += 1

    def p(self, context, symbol):
        p, excluded = 1.0, set()
        for k in range(len(context), -1, -1):
            seen = {s: n for s, n in self.counts[context[len(context) - k :]].items() if s not in excluded}
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if symbol in seen:
                return p * seen[symbol] / total
            p *= len(seen) / total
            excluded |= set(seen)
        return p / (256 - len(excluded))

    def length(self, row):
        """-ln P of a row that ends with END."""
        row = bytes([ppm.END]) * self.order + row
        return -sum(math.log(self.p(row[i - self.order : i], row[i])) for i in range(self.order, len(row)))


SCRIPTS = ("the cat and dog ", "le chat é è ", "кот и пёс ", "日本語の文 ", "Ωμέγα καὶ ", "\U0001f600 zz ")


def texts_of(rng, n):
    return [" ".join(plain("".join(rng.choices(rng.choice(SCRIPTS), k=rng.randrange(0, 60))))).encode() + b"\n" for _ in range(n)]


@pytest.mark.parametrize("order", [0, 1, 3, 4, 6])
def test_trie_is_ppm(order):
    rng = random.Random(order)
    texts = texts_of(rng, 30)
    counts = Counter()
    for row in texts:
        row = bytes([ppm.END]) * order + row
        counts.update(int.from_bytes(row[i - order : i + 1], "big") for i in range(order, len(row)))
    gram = np.array(list(counts), np.uint64)
    trie = ppm.Trie(ppm.levels_of(gram, np.array(list(counts.values())), order))
    brute = BrutePpm(texts, order)
    others = [bytes([ppm.END]) * order + t for t in texts_of(rng, 10)] + [bytes(rng.choices(range(256), k=order + 60))]
    asked = gram.tolist() + [int.from_bytes(t[i - order : i + 1], "big") for t in others for i in range(order, len(t))]
    for g, length in zip(asked, trie.lengths(np.array(asked, np.uint64)), strict=True):
        raw = g.to_bytes(order + 1, "big")
        assert length == pytest.approx(-math.log(brute.p(raw[:-1], raw[-1])), rel=1e-9, abs=1e-12)


def test_places():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 40, 5000).astype(np.uint64))
    places = ppm.Places(keys)
    assert (places(keys) == np.arange(len(keys))).all()
    assert (places(np.setdiff1d(rng.integers(0, 1 << 40, 5000).astype(np.uint64), keys)) == -1).all()
    assert (ppm.Places(keys[:0])(keys) == -1).all()
    crowded = ppm.Places(keys)
    crowded.tables = [np.where(np.arange(len(t)) % 3 == 0, t, -1) for t in crowded.tables]  # all that the tables have no room for is searched
    crowded.rest = np.arange(len(keys))
    assert (crowded(keys) == np.arange(len(keys))).all()


def test_lengths_of_thirty_languages_are_those_of_ppm(monkeypatch):
    rng = random.Random(30)
    monkeypatch.setattr(langid, "_RUN", 500)
    model, brutes = {"id": "thirty", "languages": [f"l{i:02}" for i in range(30)], "grams": []}, []
    for i in range(30):
        letters = SCRIPTS[i % len(SCRIPTS)] + chr(0x3B1 + i) + chr(0x4E00 + 7 * i)
        texts = [" ".join(plain("".join(rng.choices(letters, k=80)))).encode() + b"\n" for _ in range(4)]
        counts = Counter()
        for row in texts:
            row = bytes([ppm.END]) * 3 + row
            counts.update(int.from_bytes(row[i - 3 : i + 1], "big") for i in range(3, len(row)))
        gram, n = np.unique(np.array(list(counts.elements()), np.uint32), return_counts=True)
        model["grams"].append((gram, n))
        brutes.append(BrutePpm(texts, langid.ORDER))
    asked = [t.decode() for t in texts_of(rng, 12)] + ["", "Ünïcode\ttext", "x" * 700]
    got = langid.lengths(model, *text_buffer(pa.array(asked)))
    for text, row in zip(asked, got, strict=True):
        want = " ".join(plain(text)).encode() + b"\n"
        assert row == pytest.approx([b.length(want) for b in brutes], rel=1e-5)


def test_plain_rows():
    texts = ["  A b\t\nC ", None, "", " ", "é  É x", "abc", " z"]
    buf, rows, starts, ends = ppm.plain_rows(*text_buffer(pa.array(texts)))
    got = [bytes(buf[a:b]) for a, b in zip(rows[:-1], rows[1:], strict=True)]
    assert got == [" ".join(plain(t)).encode() + b"\n" for t in texts]
    assert [bytes(buf[a:b]).decode() for a, b in zip(starts, ends, strict=True)] == [w for t in texts for w in plain(t)]


def rows_of(n=60):
    rng = random.Random(1)
    out = []
    for i in range(n):
        words = (EN if i % 2 else FR).split()
        out.append((i, " ".join(rng.choices(words, k=rng.randrange(3, 40))), "en" if i % 2 else "fr", "x"))
    out += [(n, None, "en", "x"), (n + 1, "", "fr", "x"), (n + 2, "123 456 !!", "en", "x"), (n + 3, EN, None, "x"), (None, FR, "fr", "x"), (n + 4, "THE cat " * 30_000, None, "x"), (5, "twice", "en", "x"), (5, "twice", "en", "x"), (n + 5, "日本語 Ωμέγα", None, "x")]
    return out


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)


def is_held(doc_id, mod):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % mod == 1


def test_languages(spark, monkeypatch):
    rows = rows_of()
    monkeypatch.setattr(langid, "_RUN", 1000)
    out = langid.language_id(make(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, r)
        assert r.held_out == is_held(r.doc_id, 3) and 0 <= r.score <= 1
    assert all(by[i].lang_pred == lang for i, _, lang, _ in rows[:60])
    assert [(by[60 + i].lang_pred, by[60 + i].score) for i in range(3)] == [("und", 0)] * 3
    assert by[63].lang_pred == by[64].lang_pred == "en" and by[None].lang_pred == "fr" and by[65].lang_pred in ("en", "fr")


def test_held_out_rows_and_labels_teach_nothing(spark):
    rows = rows_of()
    other = [(i, t, "zz" if is_held(i, 3) else lang, s) for i, t, lang, s in rows]
    a = langid.language_id(make(spark, rows)).collect()
    b = langid.language_id(make(spark, other)).collect()
    assert Counter(map(tuple, a)) == Counter(map(tuple, b))


def test_no_language_and_no_rows(spark):
    assert langid.language_id(make(spark, rows_of()[:0])).count() == 0
    out = langid.language_id(make(spark, [(2, "text", None, "x")])).collect()
    assert [(r.lang_pred, r.score) for r in out] == [("und", 0)]


def thue_morse(n, a="a", b="b"):
    """Words that polynomial hashes of 64 bits give one value, from 1024 letters on."""
    return "".join(a if i.bit_count() % 2 else b for i in range(n))


def test_lm_scores(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "_PRICED", 700)
    rows = rows_of()
    rows += [(200 + i, thue_morse(n, *ab) + " x", None, "x") for i, (n, ab) in enumerate([(1024, "ab"), (1024, "ba"), (2048, "ab"), (2048, "ba")])]
    out = lmscore.lm_scores(make(spark, rows), block_bytes=5000).collect()
    train = [plain(t) for i, t, *_ in rows if not is_held(i, 5)]
    counts = Counter(w for t in train for w in [*t, None])
    total, distinct = sum(counts.values()), len(counts)
    brute = BrutePpm([" ".join(t).encode() + b"\n" for t in train], lmscore.ORDER)

    def expected(i, t):
        words = plain(t)
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in [*words, None])
        own = -brute.length(" ".join(words).encode() + b"\n") / math.log(10)
        return i, is_held(i, 5), len(words) + 1, sum(counts[w] > 0 for w in [*words, None]), total, base, own

    key = lambda r: (r[0] is None, r[0], r[2])
    want = sorted((expected(i, t) for i, t, *_ in rows), key=key)
    got = sorted(map(tuple, out), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-6)


def test_lm_scores_of_no_rows(spark):
    assert lmscore.lm_scores(make(spark, rows_of()[:0])).count() == 0
