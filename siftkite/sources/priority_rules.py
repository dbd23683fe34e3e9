"""A user's priority rules from a YAML or JSON file, and files scored by them. The rules are read on the driver; scores are Column expressions."""

from __future__ import annotations

import fnmatch
import json
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Points of a match by class, least totals of the levels, shares of own rules and of related files.
POINTS = {"high_priority": 1.0, "medium_priority": 0.6, "low_priority": 0.3}
HIGH_FROM, MEDIUM_FROM = 0.7, 0.4
BASE_SHARE, RELATED_SHARE = 0.7, 0.3


@dataclass
class PriorityRules:
    """Each of keywords, file_patterns and path_rules: lists of texts by class of POINTS."""

    name: str = "default"
    keywords: dict = field(default_factory=dict)
    file_patterns: dict = field(default_factory=dict)
    path_rules: dict = field(default_factory=dict)
    keyword_weight: float = 0.4
    pattern_weight: float = 0.3
    path_weight: float = 0.3


def read_priority_rules(path: str) -> PriorityRules:
    """The rules under priority_rules, custom of a .yaml, .yml or .json file (a URI); any other file is tried as YAML. YAML needs the yaml module."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_stream(name, compression=None) as f:
        text = f.read().decode()
    if path.lower().endswith(".json"):
        return parse_priority_rules(json.loads(text))
    import yaml

    return parse_priority_rules(yaml.safe_load(text))


def parse_priority_rules(config: dict | None) -> PriorityRules:
    custom = ((config or {}).get("priority_rules") or {}).get("custom") or {}
    weights = custom.get("weights") or {}
    lists = {c: {k: [str(x) for x in v or []] for k, v in (custom.get(c) or {}).items() if k in POINTS} for c in ("keywords", "file_patterns", "path_rules")}
    return PriorityRules(str(custom.get("name", "default")), **lists, keyword_weight=float(weights.get("keyword_match", 0.4)), pattern_weight=float(weights.get("file_pattern", 0.3)), path_weight=float(weights.get("path_match", 0.3)))


def _share(rules: dict, test) -> Column:
    """Points of the rules that hold by all points that there are."""
    most = sum(len(rules.get(k, [])) * p for k, p in POINTS.items())
    if not most:
        return F.lit(0.0)
    got = reduce(lambda a, b: a + b, [F.when(test(x), p).otherwise(0.0) for k, p in POINTS.items() for x in rules.get(k, [])])
    return F.least(F.round(got / most, 12), F.lit(1.0))


def path_matches(path: Column, pattern: str) -> Column:
    """`**/a/**/b`: the parts one after the other; `**/a` and a pattern without ** : contained; other ** stand for anything in an expression."""
    if pattern.startswith("**/"):
        parts = [p for p in pattern[3:].split("**/") if p]
        return path.rlike("(?s)" + ".*".join(map(re.escape, parts))) if parts else F.lit(True)
    if "**" in pattern:
        return path.rlike(pattern.replace("**/", ".*/").replace("**", ".*"))
    return F.contains(path, F.lit(pattern))


def name_matches(name: Column, pattern: str) -> Column:
    """Shell patterns on a whole name: *, ? and sets."""
    expression = fnmatch.translate(pattern)
    return name.rlike("^(?:" + re.sub(r"\\[zZ]$", "", expression) + r")\z")


def rule_priorities(files: DataFrame, rules: PriorityRules, *, path: str = "path", content: str = "content", related: Column | None = None) -> DataFrame:
    """(path, keyword_score, pattern_score, path_score, total, level) of each file.

    Each score is the share of its rules' points that hold: keywords in the path or the content whatever the case, shell patterns on the name, path rules on the path. total: BASE_SHARE of their weighted sum and RELATED_SHARE of `related`, the score of related files (none: 0).
    A null content is empty.
    """
    p, text = F.col(path), F.lower(F.coalesce(F.col(content), F.lit("")))
    low, name = F.lower(p), F.regexp_extract(p, "([^/]*)$", 1)
    scores = {
        "keyword_score": _share(rules.keywords, lambda k: F.contains(low, F.lit(k.lower())) | F.contains(text, F.lit(k.lower()))),
        "pattern_score": _share(rules.file_patterns, lambda x: name_matches(name, x)),
        "path_score": _share(rules.path_rules, lambda x: path_matches(p, x)),
    }
    weights = {"keyword_score": rules.keyword_weight, "pattern_score": rules.pattern_weight, "path_score": rules.path_weight}
    out = files.select(p.alias("path"), *[c.alias(n) for n, c in scores.items()], (related if related is not None else F.lit(0.0)).alias("_related"))
    base = reduce(lambda a, b: a + b, [F.col(n) * w for n, w in weights.items()])
    out = out.withColumn("total", F.round(base * BASE_SHARE + F.coalesce("_related", F.lit(0.0)) * RELATED_SHARE, 9)).drop("_related")
    return out.withColumn("level", F.when(F.col("total") >= HIGH_FROM, "high").when(F.col("total") >= MEDIUM_FROM, "medium").otherwise("low"))
