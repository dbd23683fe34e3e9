"""Personal data: four fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The field scores whole candidate segments of one to MAX_TOKENS tokens: features of the segment's shape, digits, separators and the words around it, and of the
segment before it. Dynamic programming over the tokens outside the patterns' spans chooses boundaries and types together; an entity has a bounded number of tokens, so the
work is linear in the text. It adds the four kinds in forms that the patterns don't match, and secrets (keys, tokens, passwords), which have no pattern.
Weights are learned on the driver, once in a process, from sentences made by fixed rules (`examples`): entities among words in the four scripts of European prose,
and dates, versions, prices, hashes and plain numbers that are nobody's data.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftkite.llm.common import lean, row_runs, text_buffer

KINDS = ("email", "ip", "card", "phone")
#: What the field tells apart, the kinds of the patterns first.
ALL_KINDS = (*KINDS, "secret")
#: Tokens of the longest entity, the bound of the dynamic programme.
MAX_TOKENS = 5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i & 1)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from each @ in linear time."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            free = domain.end()
            out.append((start, free))
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns' spans, leftmost and non-overlapping within a kind; those that fail their check are dropped without another try."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x) <= 3 and int(x or "0") <= 255 for x in (part.lstrip("0") for part in m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# The field.

_CUES = {
    "email": ("mail", "email", "e-mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "address", "server", "addr", "client"),
    "card": ("card", "visa", "mastercard", "credit", "cc", "pan"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "dial"),
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "apikey", "api_key", "access_key", "bearer", "pass"),
    "other": ("commit", "sha", "hash", "version", "page", "chapter", "isbn", "order", "figure", "build", "revision", "checksum"),
}
_CUE_OF = {w: k for k, words in _CUES.items() for w in words}
_TRIM = frozenset("\"'`,;:!?*&$%#|<>")
#: White space that str.split knows.
_SPACES = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288], np.uint32)
_TRIGGER = re.compile(r"[0-9]|\[at\]|\(at\)|\{at\}|<at>|(?<![^\s])dot(?![^\s])", re.IGNORECASE)
_LONG = 64  # longer spans are described anew each time instead of being kept


def tokens_of(text: str, taken: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """All tokens of the text outside the taken parts, without the marks around them; each has a character left."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    gap = codes <= 32
    gap[gap] = np.isin(codes[gap], _SPACES)
    high = codes > 127
    if high.any():
        gap[high] = np.isin(codes[high], _SPACES)
    for a, b in taken:
        gap[a:b] = True
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    out = []
    for a, b in zip(np.flatnonzero(edge == -1).tolist(), np.flatnonzero(edge == 1).tolist(), strict=True):
        while a < b and text[a] in _TRIM:
            a += 1
        while b > a and (text[b - 1] in _TRIM or text[b - 1] == "."):
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def shape(span: str) -> str:
    """Runs of digits as 9 and of letters as a, the rest as it is; runs of mixed digits and letters of 16 or more as x."""
    short = re.sub(r"(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{16,}", "x", span[:4096])
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", short))[:24]


def cue_of(word: str) -> str:
    return _CUE_OF.get(word.strip(".,:;()=\"'").lower(), "=" if word in ("=", ":", ":=") else "-")


def _describe(span: str) -> tuple[str, ...]:
    digits = "".join(_DIGITS.findall(span))
    groups = [len(x) for x in _DIGITS.findall(span)]
    lower = span.lower()
    out = [f"shape={shape(span)}", f"digits={min(len(digits), 20)}", f"groups={min(len(groups), 9)}", f"sizes={'-'.join(map(str, groups[:6]))}"]
    out.append("letters" if any(c.isalpha() for c in span) else "no letters")
    for name, hit in (("paren", "(" in span), ("open paren", span.count("(") != span.count(")")), ("dot", "." in span), ("hyphen", "-" in span), ("slash", "/" in span), ("colon", ":" in span), ("blank", " " in span), ("equals", "=" in span)):
        if hit:
            out.append(name)
    if 12 <= len(digits) <= 19 and luhn(digits):
        out.append("luhn")
    if len(groups) == 4 and max(groups) <= 3 and all(int(x) <= 255 for x in _DIGITS.findall(span)):
        out.append("octets")
    if re.fullmatch(r"[a-z0-9._%+-]+ ?(?:\[at\]|\(at\)|\{at\}|<at>| at ) ?[a-z0-9-]+(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot |\.) ?[a-z0-9-]+)+", lower):
        out.append("spelled address")
    if " " not in span and len(span) >= 12 and digits and len(digits) < len(span):
        out.append(f"mixed={min(len(span) // 8, 6)}")
        if "=" in span and cue_of(span.partition("=")[0]) == "secret":
            out.append("assigned secret")
    return tuple(out)


_described = lru_cache(1 << 14)(_describe)


def span_features(span: str) -> tuple[str, ...]:
    return _described(span) if len(span) <= _LONG else _describe(span)


@lru_cache(1 << 14)
def _context(before: str, word: str, after: str) -> tuple[str, ...]:
    return (f"before={cue_of(word)}", f"second before={cue_of(before)}", f"cues={cue_of(before)} {cue_of(word)}", f"after={cue_of(after)}")


def context_features(before: str, word: str, after: str) -> tuple[str, ...]:
    """Of the two words before a segment and the one after it."""
    return _context(before[:_LONG], word[:_LONG], after[:_LONG])


def plain_features(token: str) -> tuple[str, ...]:
    digits = sum(c.isdigit() for c in token[:4096])
    return ("plain", f"plain digits={min(digits, 20)}", f"plain shape={shape(token)}")


LABELS = ("", *ALL_KINDS)


class SemiCrf:
    """Log-linear scores of segmentations: an entity of 1 to MAX_TOKENS tokens with a kind, or one token outside (label 0).

    A segment scores the weights of its features under its label, and the weight of its label after that of the segment before; before and after the text stands label 0.
    """

    def __init__(self, weights: dict[str, list[float]] | None = None):
        weights = weights or {}
        self.number = {f: k for k, f in enumerate(weights)}
        self.w = np.array(list(weights.values()), np.float64).reshape(-1, len(LABELS))
        self.turn = np.zeros((len(LABELS), len(LABELS)))
        for k, label in enumerate(LABELS):
            if (at := self.number.get(f"turn {label}")) is not None:
                self.turn[k] = self.w[at]

    def segments(self, text: str, tokens: list[tuple[int, int]], low: int = 0, high: int | None = None) -> list[tuple[int, int, tuple]]:
        """(first token, one past the last, features) of all candidates in tokens[low:high]; those that may be entities have features of entities."""
        high = len(tokens) if high is None else high
        word = lambda k: text[tokens[k][0] : tokens[k][1]] if 0 <= k < len(tokens) else ""
        out = []
        for i in range(low, high):
            a, b = tokens[i]
            out.append((i, i + 1, plain_features(text[a:b])))
            before, last = word(i - 2), word(i - 1)
            for j in range(i, min(i + MAX_TOKENS, high)):
                if j > i and text[tokens[j - 1][1] : tokens[j][0]] != " ":
                    break
                span = text[a : tokens[j][1]]
                if _TRIGGER.search(span):
                    out.append((i, j + 1, (*span_features(span), *context_features(before, last, word(j + 1)))))
        return out

    def scores(self, segments: list[tuple[int, int, tuple]]) -> np.ndarray:
        """[segment, label]; minus infinity where the segment cannot have the label."""
        get = self.number.get
        ids = [[k for f in features if (k := get(f)) is not None] for _, _, features in segments]
        out = np.zeros((len(segments), len(LABELS)))
        sizes = np.array([len(x) for x in ids])
        if sizes.any():
            some = np.flatnonzero(sizes)
            out[some] = np.add.reduceat(self.w[[k for x in ids for k in x]], np.cumsum(sizes[some]) - sizes[some])
        plain = np.array([f[0] == "plain" for _, _, f in segments], bool)
        out[plain, 1:] = -np.inf
        out[~plain, 0] = -np.inf
        return out

    def best(self, text: str, tokens: list[tuple[int, int]], low: int = 0, high: int | None = None) -> list[tuple[str, int, int]]:
        """Entities of the best segmentation of tokens[low:high]; of equal ones the one whose last segment starts last."""
        segments = self.segments(text, tokens, low, high)
        scores, turn = self.scores(segments).tolist(), self.turn.T.tolist()
        size, n = (len(tokens) if high is None else high) - low, len(LABELS)
        top = [[-math.inf] * n for _ in range(size + 1)]
        back: list[list] = [[None] * n for _ in range(size + 1)]
        top[0][0], at, enter, came = 0.0, -1, [], []
        for (i, j, _), score in zip(segments, scores, strict=True):
            i, j = i - low, j - low
            if i != at:  # top[i] is final
                at, enter, came = i, [], []
                for to in turn:
                    values = [x + y for x, y in zip(top[i], to, strict=True)]
                    enter.append(max(values))
                    came.append(values.index(enter[-1]))
            row, link = top[j], back[j]
            for label in range(n):
                if (value := enter[label] + score[label]) >= row[label] and value > -math.inf:
                    row[label], link[label] = value, (i, came[label])
        label = max(range(n), key=lambda k: top[size][k] + turn[0][k])
        out, at = [], size
        while at:
            i, came_from = back[at][label]
            if label:
                out.append((LABELS[label], tokens[low + i][0], tokens[low + at - 1][1]))
            at, label = i, came_from
        return out[::-1]

    def expected(self, segments: list, scores: np.ndarray, n: int) -> tuple[float, np.ndarray, np.ndarray]:
        """(log of the sum over all segmentations, probability of each [segment, label], expected turns [label, label]), by forward and backward sums."""
        k = len(LABELS)
        forward, backward = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
        forward[0, 0] = 0
        enter = np.full((n + 1, k), -np.inf)
        for s, (i, j, _) in enumerate(segments):
            if enter[i, 0] == -np.inf:
                enter[i] = np.logaddexp.reduce(forward[i][:, None] + self.turn, axis=0)
            forward[j] = np.logaddexp(forward[j], enter[i] + scores[s])
        backward[n] = self.turn[:, 0]
        leave = np.full((n + 1, k), -np.inf)  # of what starts at a place, by its label
        for s in range(len(segments) - 1, -1, -1):
            i, j, _ = segments[s]
            if j < n and backward[j, 0] == -np.inf:
                backward[j] = np.logaddexp.reduce(self.turn + leave[j], axis=1)
            leave[i] = np.logaddexp(leave[i], scores[s] + backward[j])
        whole = float(np.logaddexp.reduce(forward[n] + self.turn[:, 0]))
        firsts, lasts = np.array([i for i, _, _ in segments]), np.array([j for _, j, _ in segments])
        p = np.exp(enter[firsts] + scores + backward[lasts] - whole)
        turns = np.exp(forward[:n, :, None] + self.turn + leave[:n, None, :] - whole).sum(axis=0)
        turns[:, 0] += np.exp(forward[n] + self.turn[:, 0] - whole)
        return whole, p, turns


def examples(n: int = 700, seed: int = 10) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Passages and their entities, by rule: the forms that the fixed patterns miss, and look-alikes that are no entities."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    coded = lambda k, letters="0123456789abcdef": "".join(rng.choices(letters, k=k))
    parts = ("an", "ther", "ion", "le", "que", "der", "sch", "ou", "es", "ri", "to", "men", "é", "ção", "ñe", "ü", "ß", "и", "ов", "λο")

    def word() -> str:
        made = "".join(rng.choices(parts, k=rng.randrange(1, 4)))
        return made.capitalize() if rng.random() < 0.1 else made

    def card() -> str:
        body = digits(15)
        return body + next(c for c in "0123456789" if luhn(body + c))

    def phone() -> str:
        a, b, c = str(rng.randrange(200, 999)), digits(3), digits(4)
        return rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"({a}) {b} {c}", f"1-{a}-{b}-{c}", f"00{a[:2]} {b} {c} {digits(2)}", f"({a}){b}-{c}"))

    def email() -> str:
        at, dot = rng.choice(((" at ", " dot "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) "), (" [at] ", "."), (" (at) ", ".")))
        name = lambda: coded(rng.randrange(3, 9), "abcdefghijklmnopqrstuvwxyz")
        return f"{name()}{rng.choice(('', '.', '_'))}{name()}{at}{name()}{dot}{rng.choice(('com', 'org', 'net', 'de'))}"

    def spaced_card() -> str:
        c, s = card(), rng.choice((".", "/"))
        return s.join(c[i : i + 4] for i in range(0, 16, 4))

    def ip() -> str:
        a = [str(rng.randrange(256)) for _ in range(4)]
        return rng.choice(("[.]", "(.)", "[.]")).join(a) if rng.random() < 0.7 else f"{a[0]}[.]{a[1]}.{a[2]}.{a[3]}"

    def secret() -> str:
        many = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
        while True:
            made = rng.choice((lambda: coded(40), lambda: coded(32), lambda: coded(rng.randrange(16, 41), many), lambda: coded(40, "0123456789ABCDEF"), lambda: "AKIA" + coded(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")))()
            if any(c.isdigit() for c in made) and not made.isdigit():
                return made

    entity = {"email": email, "ip": ip, "card": spaced_card, "phone": phone, "secret": secret}
    other = (
        lambda: f"{rng.randrange(1900, 2030)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}",
        lambda: f"{rng.randrange(1, 29):02}.{rng.randrange(1, 13):02}.{rng.randrange(1900, 2030)}",
        lambda: f"{rng.randrange(1, 13)}/{rng.randrange(1, 29)}/{rng.randrange(1900, 2030)}",
        lambda: f"{rng.randrange(24)}:{rng.randrange(60):02}",
        lambda: f"{rng.randrange(1, 20)}.{rng.randrange(20)}.{rng.randrange(20)}",
        lambda: f"${rng.randrange(1, 900)}.{digits(2)}",
        lambda: f"{rng.randrange(1, 900)},{digits(3)},{digits(3)}",
        lambda: digits(rng.randrange(1, 20)),
        lambda: digits(16),
        lambda: f"{rng.choice(('commit', 'sha', 'hash', 'checksum', word()))} {coded(40)}",
        lambda: coded(40),
        lambda: f"{digits(3)}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
        lambda: f"{word()}{digits(rng.randrange(1, 4))}",
        lambda: f"{digits(4)} {digits(2)}",
        lambda: f"{digits(2)}%",
        lambda: f"{word()} at {word()}",
        lambda: f"{rng.randrange(1, 99)} at {word()}",
        lambda: f"{rng.randrange(1, 99)} {rng.randrange(1, 99)} {rng.randrange(1, 99)} {rng.randrange(1, 99)}",
        lambda: f"{digits(4)}-{digits(4)}",
        lambda: "€ " + digits(4),
        lambda: f"{rng.choice(_CUES['secret'])} {word()} {word()}",
        lambda: f"{rng.choice(_CUES['other'])} {digits(rng.randrange(1, 6))}",
        lambda: f"version {rng.randrange(1, 9)}.{rng.randrange(10)}",
        lambda: f"{word()} at {word()} {word()}",
        lambda: f"the dot {word()}",
    )
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randrange(1, 5)):
            for _ in range(rng.randrange(1, 7)):
                text += word() + rng.choice((" ", " ", " ", " ", ", ", ". ", "\n", " | "))
            if rng.random() < 0.5:
                kind = rng.choice(ALL_KINDS)
                if kind == "secret":  # nothing but its name tells a secret from a hash
                    name = rng.choice(_CUES[kind])
                    text += rng.choice((name.upper(), name, name)) + rng.choice((" = \"", ": ", " ", " = ", ": '", " := "))
                elif rng.random() < 0.4:
                    text += rng.choice(_CUES[kind]) + rng.choice((" ", ": "))
                made = entity[kind]()
                spans.append((kind, len(text), len(text) + len(made)))
            else:
                made = rng.choice(other)()
            text += made + rng.choice((" ", " ", ", ", ". ", "\" ", "!! ", "### "))
        out.append((text + word(), spans))
    return out


def trained_on(data: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 10, rate: float = 0.3, decay: float = 2e-3) -> dict[str, list[float]]:
    """Weights by stochastic gradient ascent of the regularised log-likelihood."""
    number: dict[str, int] = {f"turn {label}": k for k, label in enumerate(LABELS)}
    plain, known = SemiCrf(), []
    for text, spans in data:
        tokens = tokens_of(text)
        starts, ends = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
        gold = {(starts[a], ends[b]): ALL_KINDS.index(kind) + 1 for kind, a, b in spans if a in starts and b in ends}
        segments = plain.segments(text, tokens)
        have = {(i, j) for i, j, f in segments if f[0] != "plain"}
        if len(gold) < len(spans) or not set(gold) <= have:
            continue  # a mark at its edge was trimmed
        inside = {t for i, j in gold for t in range(i, j)}
        truth = np.zeros((len(segments), len(LABELS)))
        for s, (i, j, f) in enumerate(segments):
            if f[0] == "plain":
                truth[s, 0] = i not in inside
            elif (i, j) in gold:
                truth[s, gold[i, j]] = 1
        ids = [[number.setdefault(x, len(number)) for x in f] for _, _, f in segments]
        order = sorted((i, *truth[s].nonzero()[0]) for s, (i, _, _) in enumerate(segments) if truth[s].any())
        turns, last = np.zeros((len(LABELS), len(LABELS))), 0
        for _, label in order:
            turns[last, label] += 1
            last = label
        turns[last, 0] += 1
        known.append((segments, np.repeat(np.arange(len(ids)), [len(x) for x in ids]), np.array([k for x in ids for k in x]), truth, turns, len(tokens)))
    model = SemiCrf(dict.fromkeys(number, [0.0] * len(LABELS)))
    rng = random.Random(3)
    for turn in range(rounds):
        rng.shuffle(known)
        step = rate / (1 + turn / 4)
        for segments, of, ids, truth, turns, n in known:
            scores = np.zeros(truth.shape)
            np.add.at(scores, of, model.w[ids])
            is_plain = np.array([f[0] == "plain" for _, _, f in segments])
            scores[is_plain, 1:] = scores[~is_plain, 0] = -np.inf
            _, p, expected = model.expected(segments, scores, n)
            used = np.unique(ids)
            model.w[used] -= step * decay * model.w[used]
            np.add.at(model.w, ids, step * (truth - p)[of])
            model.turn += step * (turns - expected - decay * model.turn)
            model.w[: len(LABELS)] = model.turn
    rounded = np.round(model.w, 4)
    return {f: rounded[k].tolist() for f, k in number.items() if rounded[k].any()}


@lru_cache(1)
def trained() -> dict[str, list[float]]:
    return trained_on(examples())


def windows(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of tokens that hold all candidates: those with a trigger in them and MAX_TOKENS - 1 on either side. All other tokens can only be outside an entity."""
    out: list[list[int]] = []
    starts = [a for a, _ in tokens]
    at = 0
    for m in _TRIGGER.finditer(text):
        at = max(at, bisect_right(starts, m.start(), at) - 1)
        low, high = max(0, at - MAX_TOKENS + 1), min(len(tokens), at + MAX_TOKENS)
        if out and low <= out[-1][1]:
            out[-1][1] = max(high, out[-1][1])
        elif tokens:
            out.append([low, high])
    return [(a, b) for a, b in out]


def spans_of(text: str, model: SemiCrf) -> tuple[list, list]:
    """(base spans, all spans). The field's spans touch no base span."""
    base = base_spans(text)
    tokens = tokens_of(text, [(a, b) for _, a, b in base])
    added = [x for low, high in windows(text, tokens) for x in model.best(text, tokens, low, high)]
    return base, sorted({*base, *added}, key=lambda s: (s[1], ALL_KINDS.index(s[0]), s[2]))


def digest(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def mask(text: str, spans: list) -> str:
    """Each run of overlapping spans becomes the first one's kind in brackets."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, a, b = spans[i]
        while i + 1 < len(spans) and spans[i + 1][1] < b:
            i += 1
            b = max(b, spans[i][2])
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
        i += 1
    return "".join(out) + text[at:]


_SIGNS = np.zeros(256, bool)
_SIGNS[48:58] = True
_SIGNS[[ord(c) for c in "@[({<"]] = True


def _may_hold(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that have a digit, an @ or an opening bracket; a spelled address without these has the word dot, looked for by the caller."""
    return np.diff(np.searchsorted(np.flatnonzero(_SIGNS[buf]), offsets)) > 0


def _rows(texts: pa.Array):
    """(row, text) of the rows that may hold spans."""
    for low, high in row_runs(texts):
        buf, offsets = text_buffer(texts.slice(low, high - low))
        hit = _may_hold(buf, offsets)
        dots = b"dot" in buf.tobytes().lower()
        for i in range(high - low):
            if hit[i] or dots:
                yield low + i, buf[offsets[i] : offsets[i + 1]].tobytes().decode()


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the base spans), base_sha256, spans (all) and n_added of every row.

    Spans count code points, ends exclusive. A null text is empty and has none; texts go whole, in time linear in them; of spans that start together the kinds come as listed. Null
    ids stay, repeated rows are repeated, an empty table gives no rows. Columns besides the two are not read, whatever their names.
    """
    weights = docs.sparkSession.sparkContext.broadcast(trained())
    nothing = hashlib.sha256(b"").hexdigest()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SemiCrf(weights.value)
        for batch in batches:
            n = batch.num_rows
            counts, sha, spans, added = np.zeros((n, 4), np.int64), [nothing] * n, [""] * n, np.zeros(n, np.int64)
            for i, text in _rows(batch.column(1)):
                base, found = spans_of(text, model)
                if found:
                    for kind, _, _ in base:
                        counts[i, KINDS.index(kind)] += 1
                    sha[i], spans[i], added[i] = hashlib.sha256(digest(base).encode()).hexdigest(), digest(found), len(found) - len(base)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(counts[:, k]) for k in range(4)], pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(added)], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    return rows.mapInArrow(lean(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask_pii(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, the text with its spans masked. A null text stays null; texts go whole, repeated rows are each masked, an empty table gives no rows."""
    weights = docs.sparkSession.sparkContext.broadcast(trained())
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SemiCrf(weights.value)
        for batch in batches:
            changed = {}
            for i, text in _rows(batch.column(at)):
                _, found = spans_of(text, model)
                if found:
                    changed[i] = mask(text, found)
            if changed:
                texts = batch.column(at).to_pylist()
                for i, text in changed.items():
                    texts[i] = text
                batch = pa.RecordBatch.from_arrays([pa.array(texts, c.type) if k == at else c for k, c in enumerate(batch.columns)], schema=batch.schema)
            yield batch

    return docs.mapInArrow(lean(run), docs.schema)
