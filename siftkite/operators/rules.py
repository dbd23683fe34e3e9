"""Code rules: catalogs of expressions with gates over the text, the line and the surroundings of a hit.

A LineRule needs only its line, some lines around it and flags of the whole text; it stays in built-in expressions. A TextRule matches over line ends and
looks at a stretch of characters around each match. Built-ins give no offsets of matches, and Java's expressions recurse once for each turn of a
repeated group, so a long text can overflow the stack; TextRules therefore run Python's expressions over Arrow batches, one pass over each text.

Both look for an expression only where the words are that all its matches hold (`needs`), found by plain search in lower case; rows are dealt to all tasks first.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftkite.staging import spread

HIT = "path string, line int, col int, rule_id string, severity string, confidence double, snippet string"
#: Java's flags that make its classes and line ends those of Python.
JAVA = "(?dU)"


def any_of(*patterns: str, flags: str = "i") -> str:
    """One expression for any of them; '.' stands for no line end unless flags has s."""
    return f"(?{flags}{'' if 's' in flags else '-s'}:{'|'.join(patterns)})"


@dataclass(frozen=True)
class Near:
    """Text around a match: from `before` characters ahead of its start (None: from its end) to `after` characters past its end, or past its start where `of_start`."""

    regex: str
    before: int | None
    after: int
    wanted: bool = False
    of_start: bool = False


@dataclass(frozen=True)
class Gate:
    """Drops a hit whose line has `line`, lacks `lacks`, and whose text has each of `text`."""

    line: str | None = None
    lacks: str | None = None
    text: tuple[str, ...] = ()


@dataclass(frozen=True)
class TextRule:
    rule_id: str
    #: Each match of each expression is a hit.
    patterns: tuple[str, ...]
    severity: str
    confidence: float
    #: A text with `enough` of these has no hit.
    unless: tuple[str, ...] = ()
    enough: int = 1
    near: Near | None = None
    gates: tuple[Gate, ...] = ()
    #: What the match, and what its line, must have.
    word: str | None = None
    on_line: str | None = None
    #: The first of these found in the lines around the hit sets its severity; `lines` are how many before and after its own.
    levels: tuple[tuple[str, str], ...] = ()
    lines: tuple[int, int] = (0, 0)
    #: A text with this has hits of this confidence.
    softer: tuple[str, float] | None = None
    #: Replacements in the snippet.
    masks: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class LineRule:
    rule_id: str
    #: A hit is a line with all of these.
    all_of: tuple[str, ...]
    severity: str
    confidence: float
    none_of: str | None = None
    #: A text with this has no hit.
    unless: str | None = None
    #: A hit with this in the lines around it is none; `lines` are how many before and after.
    around: str | None = None
    lines: tuple[int, int] = (0, 0)


_re = lru_cache(maxsize=None)(re.compile)

#: Letters that expressions take for ASCII ones where case doesn't count, and these; lower() alone leaves them or makes two of one.
_LIKE, _ASCII = "\u0130\u0131\u017f\u212a", "iisk"
_FOLD = str.maketrans(_LIKE, _ASCII)


def folded(text: str) -> str:
    """The text in the case of the words of `needs`."""
    return (text if text.isascii() else text.translate(_FOLD)).lower()


def _strongest(groups: list[frozenset[str]]) -> frozenset[str] | None:
    return max(groups, key=lambda g: (min(map(len, g)), -len(g)), default=None)


def _groups(items) -> list[frozenset[str]]:
    """needs of a sequence of parsed items."""
    out, run = [], ""
    for op, value in [*items, ("END", None)]:
        if str(op) == "LITERAL" and value < 128:
            run += chr(value).lower()
            continue
        if run:
            out.append(frozenset([run]))
            run = ""
        if str(op) == "SUBPATTERN":
            out += _groups(value[3])
        elif str(op) in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
            out += _groups(value[2])
        elif str(op) == "BRANCH":
            each = [_strongest(_groups(x)) for x in value[1]]
            if None not in each:
                out.append(frozenset().union(*each))
    return out


@lru_cache(maxsize=None)
def needs(pattern: str) -> tuple[frozenset[str], ...]:
    """Groups of words in lower case: the folded text of any match holds one word of each. No groups: nothing is known."""
    try:
        from re import _parser
    except ImportError:
        return ()
    return tuple(dict.fromkeys(_groups(_parser.parse(pattern))))


class _Words:
    """The words of one text, each looked for once."""

    def __init__(self, text: str):
        self.text, self.known = folded(text), {}

    def __contains__(self, word: str) -> bool:
        if (has := self.known.get(word)) is None:
            has = self.known[word] = word in self.text
        return has

    def may_match(self, pattern: str) -> bool:
        return all(any(w in self for w in group) for group in needs(pattern))


def _dropped(gate: Gate, text: str, line: str) -> bool:
    has = lambda p, s: _re(p).search(s) is not None
    return (gate.line is None or has(gate.line, line)) and (gate.lacks is None or not has(gate.lacks, line)) and all(has(p, text) for p in gate.text)


def _surroundings(near: Near, text: str, start: int, end: int) -> str:
    low = end if near.before is None else max(0, start - near.before)
    return text[low : (start if near.of_start else end) + near.after]


def text_hits(text: str, rule: TextRule, words: _Words | None = None) -> Iterator[tuple[int, int, str, float, str]]:
    """(line, col, severity, confidence, snippet) of each hit, lines and columns from 1; by expression, then by place. words: the text's, where many rules share them."""
    words = words or _Words(text)
    patterns = [p for p in rule.patterns if words.may_match(p)]
    if not patterns or (rule.near and rule.near.wanted and not (words.may_match(rule.near.regex) and _re(rule.near.regex).search(text))):
        return
    starts, lines = None, None
    for p in patterns:
        for m in _re(p).finditer(text):
            if rule.word and not _re(rule.word).search(m.group()):
                continue
            if rule.near and (_re(rule.near.regex).search(_surroundings(rule.near, text, m.start(), m.end())) is not None) != rule.near.wanted:
                continue
            if lines is None:  # the first match: what holds for the whole text is looked for only now
                if rule.unless and sum(_re(q).search(text) is not None for q in rule.unless) >= rule.enough:
                    return
                confidence = rule.softer[1] if rule.softer and _re(rule.softer[0]).search(text) else rule.confidence
                lines = text.split("\n")
                starts = [0]
                for x in lines:
                    starts.append(starts[-1] + len(x) + 1)
            n = bisect_right(starts, m.start())
            line = lines[n - 1].strip()
            if (rule.on_line and not _re(rule.on_line).search(line)) or any(_dropped(g, text, line) for g in rule.gates):
                continue
            severity = rule.severity
            if rule.levels:
                block = "\n".join(lines[max(0, n - 1 - rule.lines[0]) : n + rule.lines[1]])
                severity = next((s for q, s in rule.levels if _re(q).search(block)), severity)
            for q, r in rule.masks:
                line = _re(q).sub(r, line)
            yield n, m.start() - starts[n - 1] + 1, severity, confidence, line


def text_rules(files: DataFrame, catalog: list[TextRule], *, path: str = "path", content: str = "content") -> DataFrame:
    """(path, line, col, rule_id, severity, confidence, snippet) of all hits of a catalog. A null text has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in HIT.split(", ")]
        for b in batches:
            texts = ((p, text, _Words(text)) for p, text in zip(b["path"], b["content"], strict=True))
            rows = [(p, n, col, rule.rule_id, severity, confidence, line) for p, text, words in texts for rule in catalog for n, col, severity, confidence, line in text_hits(text, rule, words)]
            yield pd.DataFrame(rows, columns=names)

    return spread(files.select(F.col(path).alias("path"), F.col(content).alias("content")).filter("content is not null")).mapInPandas(run, HIT)


def line_rules(files: DataFrame, catalog: list[LineRule], *, path: str = "path", content: str = "content") -> DataFrame:
    """The columns of text_rules, col being 1: one row for each line that a rule hits. A null text has none.

    A line is tried for the rules whose words it holds; a text's flags are found once, where a line is hit by their rule. Only lines that hit leave the array.
    """
    text = F.col("content")
    rows = spread(files.select(F.col(path).alias("path"), F.col(content).alias("content")).filter("content is not null"))
    fold = F.split(F.lower(F.translate(text, _LIKE, _ASCII)), "\n")
    rows = rows.select("path", "content", F.split("content", "\n").alias("lines"), fold.alias("folded"))

    def may_hit(rule: LineRule, low: Column) -> Column:
        groups = [reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in sorted(g, key=len)]) for p in rule.all_of for g in needs(p)]
        return reduce(lambda a, b: a & b, groups, F.lit(True))

    tried = F.transform("folded", lambda low, i: F.struct(i.alias("i"), F.array_compact(F.array(*[F.when(may_hit(r, low), F.lit(n)) for n, r in enumerate(catalog)])).alias("rules")))
    rows = rows.select("path", "content", "lines", F.filter(tried, lambda x: F.size(x["rules"]) > 0).alias("tried"))

    def hit(n: int, rule: LineRule, x: Column, i: Column) -> Column:
        tests = [x.rlike(JAVA + p) for p in rule.all_of]
        if rule.none_of:
            tests.append(~x.rlike(JAVA + rule.none_of))
        if rule.around:
            before, after = rule.lines
            first = F.greatest(i - before, F.lit(0))
            tests.append(~F.array_join(F.slice("lines", first + 1, i + after + 1 - first), "\n").rlike(JAVA + rule.around))
        return F.when(reduce(lambda a, b: a & b, tests), F.lit(n))

    def hits_of(x: Column) -> Column:
        i, line = x["i"], F.get("lines", x["i"])
        return F.struct((i + 1).alias("line"), line.alias("text"), F.array_compact(F.array(*[F.when(F.array_contains(x["rules"], n), hit(n, r, line, i)) for n, r in enumerate(catalog)])).alias("rules"))

    rows = rows.select("path", "content", F.filter(F.transform("tried", hits_of), lambda x: F.size(x["rules"]) > 0).alias("found"))
    rows = rows.select("path", "content", "found", F.flatten(F.transform("found", lambda x: x["rules"])).alias("hit"))
    flags = [F.when(F.array_contains("hit", n) & text.rlike(JAVA + r.unless), F.lit(n)) for n, r in enumerate(catalog) if r.unless]
    rows = rows.select("path", "found", (F.array_compact(F.array(*flags)) if flags else F.array().cast("array<int>")).alias("off"))
    # a filter that the optimizer derives from an inner explode would go below the exchange and try all lines there
    hits = rows.select("path", "off", F.explode_outer("found").alias("r")).filter("r is not null").select("path", "r.line", "r.text", F.explode(F.array_except("r.rules", "off")).alias("n"))
    about = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.confidence).alias("confidence")) for r in catalog])
    hits = hits.select("path", "line", "text", F.get(about, F.col("n")).alias("h"))
    snippet = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    return hits.select("path", "line", F.lit(1).alias("col"), "h.rule_id", "h.severity", "h.confidence", snippet.alias("snippet"))
