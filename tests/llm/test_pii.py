import hashlib

import random
import re

import numpy as np
import pytest

from siftkite.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(re.fullmatch(r"0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])", x) for x in m.group().split(".")) if kind == "ip" else False, "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def test_base_spans():
    rng = random.Random(8)
    parts = ["1", "23", "456", "4111 1111 1111 1111", "4111-1111-1111-1111", ".", " ", "-", "+", "@", "a", "b.c", "x@y.z", "é", "(", ")", "10.0.0.1", "999.1.1.1", "+1 (523) 555-1055", "\n", "%", "_", "007.08.09.255"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 14)))
        assert pii.base_spans(text) == brute_base(text), text


@pytest.mark.parametrize("zeros", [5_000, 200_000])
def test_parts_of_many_zeros_are_numbers(zeros):
    for text in ("0" * zeros + "1.2.3.4", "1.2.3." + "0" * zeros + "255", "1.2." + "0" * zeros + ".4"):
        assert pii.base_spans(text) == [("ip", 0, len(text))]
        assert zeros > 5_000 or brute_base(text) == [("ip", 0, len(text))]  # the patterns themselves take quadratic time
        assert ("ip", 0, len(text)) in pii.spans_of(text, pii.SemiCrf())[1]
    for text in ("0" * zeros + "256.2.3.4", "9" * zeros + ".2.3.4"):
        assert pii.base_spans(text) == []
        assert zeros > 5_000 or brute_base(text) == []


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.luhn("79927398713")


def test_long_runs_are_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "a@" * 50_000, "1." * 100_000, "[at] " * 20_000):
        pii.spans_of(text, pii.SemiCrf())


@pytest.fixture(scope="module")
def model():
    return pii.SemiCrf(pii.trained())


def brute_best(model, text, tokens):
    """The score of the best of all segmentations, one by one."""
    segments, by = model.segments(text, tokens), {}
    for (i, j, _), row in zip(segments, model.scores(segments), strict=True):
        by.setdefault(i, []).extend((j, label, row[label]) for label in range(len(pii.LABELS)) if row[label] > -1e9)

    def walk(i, last):
        if i == len(tokens):
            yield model.turn[last, 0]
            return
        for j, label, s in by[i]:
            for rest in walk(j, label):
                yield s + model.turn[last, label] + rest

    return list(walk(0, 0))


def score_of(model, text, tokens, found):
    """The score of a segmentation that is given by its entities."""
    segments = model.segments(text, tokens)
    table = {(i, j, f[0] == "plain"): row for (i, j, f), row in zip(segments, model.scores(segments), strict=True)}
    starts, ends = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
    entity = {starts[a]: (ends[b], pii.LABELS.index(kind)) for kind, a, b in found}
    total, last, i = 0.0, 0, 0
    while i < len(tokens):
        j, label = entity.get(i, (i + 1, 0))
        total += table[i, j, label == 0][label] + model.turn[last, label]
        last, i = label, j
    return total + model.turn[last, 0]


def test_dynamic_programming(model):
    rng = np.random.default_rng(1)
    other = pii.SemiCrf({f: rng.normal(size=len(pii.LABELS)).tolist() for f in model.number})  # its best are others than what the words say
    for text, _ in pii.examples(25, 5):
        tokens = pii.tokens_of(text)[:6]
        for m in (model, other):
            every = brute_best(m, text, tokens)
            assert score_of(m, text, tokens, m.best(text, tokens)) == pytest.approx(max(every))
            segments = m.segments(text, tokens)
            assert m.expected(segments, m.scores(segments), len(tokens))[0] == pytest.approx(np.logaddexp.reduce(every))


def test_gradient(model):
    text, _ = pii.examples(3, 1)[1]
    tokens = pii.tokens_of(text)
    small = pii.SemiCrf({f: (model.w[k] / 5).tolist() for f, k in model.number.items()})
    segments = small.segments(text, tokens)

    def whole():
        return small.expected(segments, small.scores(segments), len(tokens))

    before, p, turns = whole()
    for s in range(0, len(segments), max(1, len(segments) // 6)):  # d log Z / d weight is how often it is expected
        feature = segments[s][2][0]
        for label in range(len(pii.LABELS)):
            want = sum(p[k, label] for k, (_, _, f) in enumerate(segments) if feature in f)
            small.w[small.number[feature], label] += 1e-5
            assert (whole()[0] - before) / 1e-5 == pytest.approx(want, abs=1e-4)
            small.w[small.number[feature], label] -= 1e-5
    for a, b in ((0, 0), (0, 3), (2, 0)):
        small.turn[a, b] += 1e-5
        assert (whole()[0] - before) / 1e-5 == pytest.approx(turns[a, b], abs=1e-4)
        small.turn[a, b] -= 1e-5


def test_windows_change_nothing(model):
    """Decoding near triggers only gives what one decode of the whole text gives, long tokens and all."""
    rng = random.Random(4)
    for k in range(40):
        text = "  ".join(t for t, _ in pii.examples(6, 100 + k)) + " " + "word " * rng.randrange(30) + "9x" * rng.choice((3, 200)) + " (at) " + "y" * rng.choice((3, 500)) + ".org dot"
        base, found = pii.spans_of(text, model)
        tokens = pii.tokens_of(text, [(a, b) for _, a, b in base])
        assert sorted({*base, *model.best(text, tokens)}) == sorted(found)
    long = f"write {'n' * 300}[at]{'d' * 300}[dot]org today"
    assert ("email", 6, len(long) - 6) in pii.spans_of(long, model)[1]


def test_held_out_accuracy(model):
    hit = found = true = 0
    for text, spans in pii.examples(300, 77):
        got = set(model.best(text, pii.tokens_of(text)))
        hit, found, true = hit + len(got & set(spans)), found + len(got), true + len(spans)
    assert hit >= 0.95 * true and hit >= 0.95 * found


def planted(n, seed=6):
    """Documents with forms that no pattern matches and look-alikes put between their words: (text, the forms' spans)."""
    import pyarrow.parquet as pq

    rng, out = random.Random(seed), []
    forms = [(text, spans) for text, spans in pii.examples(4 * n, 991) if spans]
    for text in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()[:n]:
        parts, spans, at = (text or "").split(" "), [], 0
        made = ""
        for k, part in enumerate(parts):
            made += part + " "
            if k % 150 == 75 and forms:
                source, own = forms.pop()
                for kind, a, b in own[:1]:  # with the words around it, as far as the next form
                    low = max(0, source.rfind(" ", 0, max(0, a - 12)) + 1)
                    high = min([b + 8, len(source), *(x for _, x, _ in own[1:2])])
                    spans.append((kind, len(made) + a - low, len(made) + b - low))
                    made += source[low:high] + " "
        out.append((made, spans))
    return out


def test_planted_documents(model):
    hit = found = true = 0
    for text, spans in planted(200):
        base, got = pii.spans_of(text, model)
        secrets = text.count("token = ") + text.count("TOKEN = ")  # the documents have some of their own
        own = {s for s in got if s not in base and not (s[0] == "secret" and secrets and text[max(0, s[1] - 9) : s[1]].lower().endswith('token = "'))}
        spans = {s for s in spans if not (s[0] == "secret" and text[max(0, s[1] - 9) : s[1]].lower().endswith('token = "'))}
        hit, found, true = hit + len(own & spans), found + len(own), true + len(spans)
    print(f"precision {hit / found:.3f}, recall {hit / true:.3f} of {true}")
    assert true > 200 and hit >= 0.9 * true and hit >= 0.9 * found


TEXTS = ["mail a.b@c.example.org or +1 (523) 555-1055", None, "", "call (521) 555-6210 today", "é 4111 1111 1111 1111 é 1.2.3.4", "nothing here at all", "x" * 200_000 + " 10.0.0.1", "write jo.doe [at] host [dot] com now", "in 2020-01-02 we paid $3.50 for 17 items"]


def test_documents(spark, model):
    rows = [(i, t, "s", 1) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], "s", 1), (3, TEXTS[3], "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_ip int").repartition(2)
    out = pii.find_pii(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        text = (TEXTS[0] if r.doc_id is None else TEXTS[r.doc_id]) or ""
        base = brute_base(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert set(base) <= set(spans) and len(spans) == len(base) + r.n_added
        added = [s for s in spans if s not in base]
        assert all(b <= x or y <= a for _, a, b in added for _, x, y in base)
    texts = {r.doc_id: r for r in out}
    assert texts[3].spans == "phone:5:19" and texts[7].spans.startswith("email:6:") and texts[8].spans == "" and texts[5].spans == ""
    masked = {(r.doc_id, r.text) for r in pii.mask_pii(docs).collect()}
    assert (0, "mail [EMAIL] or [PHONE]") in masked and (1, None) in masked and (3, "call [PHONE] today") in masked and (5, TEXTS[5]) in masked
    assert pii.mask_pii(docs).columns == docs.columns
    empty = docs.limit(0)
    assert pii.find_pii(empty).count() == 0 == pii.mask_pii(empty).count()
