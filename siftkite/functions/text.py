"""Text expressions: cleaning, chunking, masking, similarity, keyword and pattern scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(text: Column) -> Column:
    """NULs dropped, white space collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "\\x00", ""), r"\s+", " "))


def strip_tags(text: Column) -> Column:
    """White space collapsed, then tags dropped; a tag leaves no blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "<[^>]+>", ""))


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def mask(text: Column, visible: int = 4) -> Column:
    """The first characters, then * for each other; all * if there are no more than those."""
    n = F.length(text)
    return F.when(n <= visible, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(text, 1, visible), F.repeat(F.lit("*"), n - visible)))


# What stands for a secret in examples.
PLACEHOLDERS = [
    "xxx", "xxx...", "your_password", "your_secret", "***", "****", "*****", "<secret>", "<password>", "${", "${}", "{{", "}}", "${password}", "${secret}", "changeme", "changepassword", "your-key-here",
    "xxxxxxxx", "xxxxxxxxxxxxxxxx", "xxxxxxxxxxxxx", "example", "test", "null", "none", "undefined",
]


def is_placeholder(value: Column) -> Column:
    lower = F.lower(F.trim(value))
    return lower.isin(PLACEHOLDERS) | lower.startswith("${") | lower.startswith("{{")


def char_chunks(text: Column, size: int, overlap: int) -> Column:
    """array of (start, content): pieces of `size` characters, each starting size - overlap after the last; none of an empty text."""
    n, step = F.length(text), size - overlap
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
    return F.when(n > 0, F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(size)).alias("content")))).otherwise(F.array().cast("array<struct<start:int,content:string>>"))


def line_chunks(text: Column, path: Column, size: int, overlap: int) -> Column:
    """array of (chunk_id, first_line, last_line, content) over lines; chunk_id is md5 of path:first-last."""
    lines = F.split(text, "\n")
    n, step = F.size(lines), size - overlap
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))

    def chunk(s: Column) -> Column:
        last = F.least(s + size, n)
        name = F.concat(path, F.lit(":"), (s + 1).cast("string"), F.lit("-"), last.cast("string"))
        return F.struct(F.md5(name).alias("chunk_id"), (s + 1).alias("first_line"), last.alias("last_line"), F.array_join(F.slice(lines, s + 1, F.lit(size)), "\n").alias("content"))

    # a start past the overlap of the last whole chunk would only repeat its lines
    return F.transform(F.filter(starts, lambda s: (s == 0) | (s + overlap < n)), chunk)


def pack_sentences(text: Column, limit: int) -> Column:
    """Sentences (split at '. ') packed greedily into pieces of at most `limit` characters; one longer than that, met with an empty piece, is dropped."""
    whole = F.split(text, r"\. ")
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))

    def add(acc: Column, sentence: Column) -> Column:
        joined = F.when(acc["now"] == "", sentence).otherwise(F.concat(acc["now"], F.lit(". "), sentence))
        fits = F.length(joined) <= limit
        alone = F.when(F.length(sentence) <= limit, sentence).otherwise(F.lit(""))
        return F.struct(F.when(fits | (acc["now"] == ""), acc["out"]).otherwise(F.array_append(acc["out"], acc["now"])).alias("out"), F.when(fits, joined).otherwise(alone).alias("now"))

    return F.aggregate(whole, state, add, lambda acc: F.when(acc["now"] == "", acc["out"]).otherwise(F.array_append(acc["out"], acc["now"])))


def words(text: Column, pattern: str = r"\w+") -> Column:
    """Distinct lower-case matches of the pattern, Unicode-aware."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?U){pattern}"), 0))


def word_jaccard(a: Column, b: Column) -> Column:
    x, y = words(a), words(b)
    n = F.size(F.array_union(x, y))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.when(n == 0, 1).otherwise(n))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / length of the longer; 1 for two empty ones."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / F.when(n == 0, 1).otherwise(n))


def edit_distance(a: Column, b: Column, limit: int = 10_000) -> Column:
    """Levenshtein; 999 when the product of the lengths passes the limit."""
    return F.when(F.length(a) * F.length(b) > limit, 999).otherwise(F.levenshtein(a, b))


def first_keyword(text: Column, families: list[tuple[str, list[str]]], default: str) -> Column:
    """The first family that has a word in the lower-case text."""
    lower = F.lower(text)
    out = None
    for name, own in families:
        hit = reduce(lambda a, b: a | b, [F.contains(lower, F.lit(w)) for w in own])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def keywords_in(text: Column, known: list[str]) -> Column:
    lower = F.lower(text)
    return F.filter(F.array(*map(F.lit, known)), lambda w: F.contains(lower, w))


def coverage(text: Column, known: list[str]) -> Column:
    return F.size(keywords_in(text, known)) / len(known)


def path_line(location: Column) -> Column:
    """(path, line) of `path:line`, a drive letter's colon aside; line null if there is none."""
    pattern = r"^((?:[A-Za-z]:)?[^:]*?)(?::(\d+))?(?::\d+)?$"
    return F.struct(F.regexp_extract(location, pattern, 1).alias("path"), F.regexp_extract(location, pattern, 2).try_cast("int").alias("line"))


def complexity(code: Column, risky: list[str]) -> Column:
    """Lines that are neither blank nor comments / 200, + .1 for each risky term, at most 1."""
    lines = F.filter(F.split(code, "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit("#")))
    return F.least(F.lit(1.0), F.size(lines) / 200 + 0.1 * F.size(F.filter(F.array(*map(F.lit, risky)), lambda w: F.contains(code, w))))


def glob_regex(pattern: str) -> str:
    """** as anything, * as anything but dots."""
    import re

    return ".*".join("[^.]*".join(map(re.escape, part.split("*"))) for part in pattern.split("**"))


def code_blocks(code: Column) -> Column:
    """Blocks of a source text: each starts at a line without indent that opens a function, class or import, and goes on to the next such line."""
    marked = F.regexp_replace(code, r"(?m)^(?=(?:async def|def|class|import|from|function|func|public|private)\b)", "\u0000")
    return F.filter(F.transform(F.split(marked, "\\x00"), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != "")
