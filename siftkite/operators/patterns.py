"""Pattern scans: many regular expressions over lines of many files.

A catalog is a list of Pattern, small and held in the plan as literals. Each file is exploded to lines once; blank and comment lines go
before any pattern is tried, and a file's text is read once whatever the number of rules.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Pattern:
    rule_id: str
    regex: str
    severity: str = "medium"
    weight: float = 1.0
    #: Files with a match of this give no hit of the rule.
    safe: str | None = None
    #: Lines with a match of this give no hit of the rule.
    line_safe: str | None = None
    confidence: float = 0.7


def lines_of(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, line from 1, text)."""
    return files.select(F.col(path).alias("path"), F.posexplode(F.split(content, "\n")).alias("i", "text")).select("path", (F.col("i") + 1).alias("line"), "text")


def scan_lines(files: DataFrame, catalog: list[Pattern], *, path: str = "path", content: str = "content", skip: str | None = r"^\s*(#|//|$)", first: bool = False) -> DataFrame:
    """One row for each match of each pattern in each line, or with `first` for a line's first match of each: path, line, col (from 0), rule_id, severity, confidence, weight, match."""
    gates = [F.struct(F.lit(p.rule_id).alias("rule_id"), F.col(content).rlike(p.safe).alias("off")) for p in catalog if p.safe]
    off = F.transform(F.filter(F.array(*gates), lambda g: g["off"]), lambda g: g["rule_id"]) if gates else F.array().cast("array<string>")
    rows = files.select(F.col(path).alias("path"), off.alias("off"), F.posexplode(F.split(content, "\n")).alias("i", "text"))
    if skip:
        rows = rows.filter(~F.col("text").rlike(skip))

    def hit(p: Pattern) -> Column:
        found = F.regexp_extract_all("text", F.lit(p.regex), 0)
        between = F.split("text", p.regex, -1)  # a match's column: all that lies before it
        before = lambda i: F.aggregate(F.zip_with(F.slice(between, 1, i + 1), F.slice(found, 1, i), lambda x, y: F.length(x) + F.coalesce(F.length(y), F.lit(0))), F.lit(0), lambda a, b: a + b)
        places = F.transform(F.slice(found, 1, 1) if first else found, lambda m, i: F.struct(before(i).alias("col"), m.alias("match")))
        test = F.col("text").rlike(p.regex) & ~F.array_contains("off", p.rule_id)
        if p.line_safe:
            test = test & ~F.col("text").rlike(p.line_safe)
        value = F.struct(F.lit(p.rule_id).alias("rule_id"), F.lit(p.severity).alias("severity"), F.lit(p.confidence).alias("confidence"), F.lit(p.weight).alias("weight"), places.alias("places"))
        return F.when(test, value)

    hits = rows.select("path", (F.col("i") + 1).alias("line"), "text", F.explode(F.array_compact(F.array(*map(hit, catalog)))).alias("h"))
    hits = hits.select("path", "line", "h", F.explode("h.places").alias("at"))
    return hits.select("path", "line", "at.col", "h.rule_id", "h.severity", "h.confidence", "h.weight", "at.match")


def family_lines(files: DataFrame, families: dict[str, list[str]], *, path: str = "path", content: str = "content") -> DataFrame:
    """(path, line, family): lines that hold a word of a family, whatever the case."""
    rows = lines_of(files, path, content)
    lower = F.lower("text")
    tests = [F.when(reduce(lambda a, b: a | b, [F.contains(lower, F.lit(w)) for w in ws]), name) for name, ws in families.items()]
    return rows.select("path", "line", F.explode(F.array_compact(F.array(*tests))).alias("family"))


def unguarded(hits: DataFrame, source: str = "source", sink: str = "sink", guard: str = "sanitizer") -> DataFrame:
    """(path, source_line, sink_line, guarded) of each source line and the next sink line at or below it in the file.

    guarded: a guard line lies strictly between. One window over a file's hits; no pair of lines is formed but a source and its next sink.
    """
    ahead = Window.partitionBy("path").orderBy("line", "family").rowsBetween(0, Window.unboundedFollowing)
    line_of = lambda name: F.min(F.when(F.col("family") == name, F.col("line"))).over(ahead)
    after = Window.partitionBy("path").orderBy("line").rangeBetween(1, Window.unboundedFollowing)
    rows = hits.withColumn("sink_line", line_of(sink)).withColumn("guard_line", F.min(F.when(F.col("family") == guard, F.col("line"))).over(after))
    return rows.filter((F.col("family") == source) & F.col("sink_line").isNotNull()).select("path", F.col("line").alias("source_line"), "sink_line", F.coalesce(F.col("guard_line") < F.col("sink_line"), F.lit(False)).alias("guarded"))


def input_flows(hits: DataFrame, *, key: str = "path", source: str = "source", sink: str = "sink", guard: str = "sanitizer", login: str = "auth") -> DataFrame:
    """(key, line, open_to, n_open, n_guarded, risk) of each source row against all sink rows of its file, wherever they stand.

    A sink is guarded if a guard lies strictly between it and the source above; open sinks are those down to line open_to (null: all), the first guard below. risk: HIGH, or MEDIUM where
    the file has a login check, for sources with an open sink, else LOW; sources of files without sinks are left out. Counted by windows over a file's hits; no pairs are made.
    """
    below = Window.partitionBy(key).orderBy("line").rangeBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(key)
    rows = hits.withColumn("open_to", F.min(F.when(F.col("family") == guard, F.col("line"))).over(below))
    # sinks at or above a line, of which a guard's line asks too
    upto = Window.partitionBy(key).orderBy("line").rangeBetween(Window.unboundedPreceding, 0)
    is_sink = F.when(F.col("family") == sink, 1).otherwise(0)
    rows = rows.withColumn("_upto", F.sum(is_sink).over(upto)).withColumn("_all", F.sum(is_sink).over(whole)).withColumn("_login", F.bool_or(F.col("family") == login).over(whole))
    # the first guard below a line is the first of the guards' own counts there
    rows = rows.withColumn("_at_guard", F.min(F.when(F.col("family") == guard, F.struct("line", "_upto"))).over(below))
    rows = rows.filter((F.col("family") == source) & (F.col("_all") > 0)).withColumn("n_open", F.coalesce(F.col("_at_guard._upto"), F.col("_all")))
    risk = F.when(F.col("n_open") == 0, "LOW").when(F.col("_login"), "MEDIUM").otherwise("HIGH")
    return rows.select(key, "line", "open_to", "n_open", (F.col("_all") - F.col("n_open")).alias("n_guarded"), risk.alias("risk"))


#: Sequences of neighbouring categories that speak for a flow.
FLOW_SEQUENCES = [("source", "transform", "sink"), ("source", "sink"), ("source", "transform", "transform", "sink")]


def token_flows(tokens: DataFrame, *, key: str = "path", sequences: list[tuple[str, ...]] | None = None) -> DataFrame:
    """(key, n_sequences, n_direct, risk_score) of each file's tokens (line, pos, category).

    n_sequences: places where the categories, by line and pos, run through a sequence (0.8 each); n_direct: pairs of a source and a sink on a later line with no sanitizer on a line
    strictly between (0.95 each); risk_score at most 1. Pairs are counted, not made.
    """
    order = Window.partitionBy(key).orderBy("line", "pos")
    category = lambda i: F.lead("category", i).over(order) if i else F.col("category")
    runs = [reduce(lambda a, b: a & b, [F.coalesce(category(i) == c, F.lit(False)) for i, c in enumerate(s)]) for s in sequences or FLOW_SEQUENCES]
    n = reduce(lambda a, b: a + b, [r.cast("int") for r in runs])
    upto = Window.partitionBy(key).orderBy("line").rangeBetween(Window.unboundedPreceding, 0)
    below = Window.partitionBy(key).orderBy("line").rangeBetween(1, Window.unboundedFollowing)
    is_sink = F.when(F.col("category") == "sink", 1).otherwise(0)
    rows = tokens.withColumn("_n", n).withColumn("_upto", F.sum(is_sink).over(upto)).withColumn("_all", F.sum(is_sink).over(Window.partitionBy(key)))
    rows = rows.withColumn("_guard", F.min(F.when(F.col("category") == "sanitizer", F.struct("line", "_upto"))).over(below))
    direct = F.when(F.col("category") == "source", F.coalesce(F.col("_guard._upto"), F.col("_all")) - F.col("_upto")).otherwise(0)
    out = rows.groupBy(key).agg(F.sum("_n").alias("n_sequences"), F.sum(direct).alias("n_direct"))
    return out.withColumn("risk_score", F.round(F.least(F.lit(1.0), F.col("n_sequences") * 0.8 + F.col("n_direct") * 0.95), 4))


def weighted_score(files: DataFrame, catalog: list[Pattern], *, path: str = "path", content: str = "content") -> DataFrame:
    """(path, score, hits): matches of all patterns times their weights."""
    counts = [F.regexp_count(content, F.lit(p.regex)) for p in catalog]
    score = reduce(lambda a, b: a + b, [n * p.weight for n, p in zip(counts, catalog, strict=True)])
    return files.select(F.col(path).alias("path"), score.alias("score"), reduce(lambda a, b: a + b, counts).alias("hits"))


def screen(files: DataFrame, catalog: list[Pattern], *, path: str = "path", content: str = "content") -> DataFrame:
    """(path, risk): the greatest weight hit, + .15 for three rules or more and .08 for two, halved if the text is short and clean, at most 1."""
    each = F.array(*[F.when(F.col(content).rlike(p.regex), F.struct(F.lit(p.rule_id).alias("rule"), F.lit(p.weight).alias("w"))) for p in catalog])
    rows = files.withColumn("_hit", F.array_compact(each))
    kinds = F.size(F.array_distinct(F.transform("_hit", lambda x: x["rule"])))
    base = F.coalesce(F.array_max(F.transform("_hit", lambda x: x["w"])), F.lit(0.0)) + F.when(kinds >= 3, 0.15).when(kinds >= 2, 0.08).otherwise(0.0)
    return rows.select(F.col(path).alias("path"), F.least(F.lit(1.0), F.when((F.length(content) < 200) & (kinds == 0), base * 0.5).otherwise(base)).alias("risk"), kinds.alias("rules"))


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, href): each link of each page, in any order."""
    return pages.select(key, F.explode(F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), 1)).alias("href"))


#: Words of sources, sinks and guards for family_lines; a caller gives its own where they differ.
FLOW_FAMILIES = {"source": ["request", "input(", "argv", "params"], "sink": ["execute", "eval(", "system(", "innerhtml"], "sanitizer": ["escape", "sanitize", "quote("]}
