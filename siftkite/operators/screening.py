"""Screens of whole files and prompts: extension, name and content to a risk and a decision; families of patterns to a level each and one in all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftkite.operators.patterns import Pattern

# Extensions by class, what their files' risk starts from, what a name adds, where decisions change.
HIGH_EXTENSIONS = [".py", ".java", ".js", ".ts", ".php", ".rb", ".go", ".rs", ".c", ".cpp", ".h", ".hpp", ".cs", ".swift", ".kt"]
MEDIUM_EXTENSIONS = [".xml", ".yaml", ".yml", ".json", ".toml", ".ini", ".cfg", ".conf", ".properties", ".env", ".sql", ".html", ".jsp"]
SKIPPED_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".woff", ".woff2", ".ttf", ".eot", ".pdf", ".doc", ".docx", ".zip", ".tar", ".gz", ".rar", ".7z",
    ".mp3", ".mp4", ".avi", ".mov", ".wav", ".lock", ".sum", ".map", ".min.js", ".min.css", ".pyc", ".pyo", ".class", ".o", ".so", ".dll", ".exe",
]
HIGH_START, MEDIUM_START = 0.05, 0.02
NAME_BOOSTS = [
    ("(?i)(auth|login|session|token|credential)", 0.15), ("(?i)(crypto|encrypt|decrypt|hash|password|secret)", 0.15), ("(?i)(sql|query|database|db_|dao)", 0.12), ("(?i)(upload|download|file|path|directory)", 0.10),
    ("(?i)(command|exec|eval|shell|process|runtime)", 0.18), ("(?i)(config|setting|env|property)", 0.08), ("(?i)(api|endpoint|route|controller|handler)", 0.06),
]
SKIP_BELOW, CONFIRM_FROM = 0.2, 0.6
COMMENT = r"^\s*(#|//|/\*|\*|'|<!--|\{#)"
SHORT_LINES = 10


def tier_screen(files: DataFrame, catalog: list[Pattern], weaknesses: dict[str, str], *, path: str = "path", content: str = "content") -> DataFrame:
    """(path, risk, rules, hits, weaknesses, decision) of each file.

    A file of a skipped extension is not looked at: risk 1 and "skip". Else the risk starts from the extension and the boosts of the file's name, and is the greatest of that and of the weights of the rules that hit a line which is no comment; three kinds of weakness (the rules' `weaknesses`) add .15, two .08,
    to 1 at most; a clean file of fewer than SHORT_LINES lines has half. Under SKIP_BELOW: "skip", from CONFIRM_FROM: "fast_confirm", else "proceed". hits: rules and lines that hit. Whole contents are screened; a null one is empty.
    """
    name = F.regexp_extract(F.col(path), r"([^/\\]*)$", 1)
    extension = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    lines = F.split(F.coalesce(content, F.lit("")), "\n", -1)
    rows = files.select(F.col(path).alias("path"), extension.alias("_ext"), name.alias("_name"), F.size(lines).alias("_n"), F.filter(lines, lambda x: ~x.rlike(COMMENT)).alias("_lines"))
    counts = [F.size(F.filter("_lines", _matches(p.regex))).alias(f"_c{i}") for i, p in enumerate(catalog)]
    rows = rows.select("path", "_ext", "_name", "_n", *counts)
    hit = lambda i: F.col(f"_c{i}") > 0
    start = F.when(F.col("_ext").isin(HIGH_EXTENSIONS), HIGH_START).when(F.col("_ext").isin(MEDIUM_EXTENSIONS), MEDIUM_START).otherwise(0.0)
    start = reduce(lambda a, b: a + F.when(F.col("_name").rlike(b[0]), b[1]).otherwise(0.0), NAME_BOOSTS, start)
    worst = F.greatest(start, *[F.when(hit(i), p.weight).otherwise(0.0) for i, p in enumerate(catalog)])
    kinds = F.size(F.array_distinct(F.array_compact(F.array(*[F.when(hit(i), weaknesses[p.rule_id]) for i, p in enumerate(catalog)]))))
    rules = reduce(lambda a, b: a + b, [hit(i).cast("int") for i in range(len(catalog))])
    hits = reduce(lambda a, b: a + b, [F.col(f"_c{i}") for i in range(len(catalog))])
    risk = F.when(kinds >= 3, F.least(worst + 0.15, F.lit(1.0))).when(kinds >= 2, F.least(worst + 0.08, F.lit(1.0))).otherwise(worst)
    risk = F.when((F.col("_n") < SHORT_LINES) & (hits == 0), risk * 0.5).otherwise(risk)
    off = F.col("_ext").isin(SKIPPED_EXTENSIONS)
    shown = lambda c, name, none: F.when(off, none).otherwise(c).alias(name)
    out = rows.select("path", F.round(F.when(off, 1.0).otherwise(risk), 9).alias("risk"), shown(rules, "rules", 0), shown(hits, "hits", 0), shown(kinds, "weaknesses", 0), off.alias("_off"))
    decision = F.when(F.col("_off") | (F.col("risk") < SKIP_BELOW), "skip").when(F.col("risk") >= CONFIRM_FROM, "fast_confirm").otherwise("proceed")
    return out.withColumn("decision", decision).drop("_off")


def _matches(regex: str):
    return lambda x: x.rlike(regex)


# Expressions of each family.
PROMPT_FAMILIES = {
    "prompt_injection": ["ignore previous instructions", "system prompt", "prompt injection", "bypass security", "override instructions"],
    "data_exfiltration": ["send data to", "exfiltrate", "steal data", "access sensitive", "download file"],
    "malicious_code": ["execute command", "run code", r"eval\(", r"exec\(", r"system\("],
    "privilege_escalation": ["sudo", "root", "admin", "privilege", "escalate"],
}


def family_levels(rows: DataFrame, text: Column, families: dict[str, list[str]] | None = None) -> DataFrame:
    """rows with a score for each family (how many of its expressions the text has, in any case), total and level.

    A family is high from three and medium from one; in all it is "high" with two high families or a total of eight, "medium" with one or four, else "low". A null text has none.
    """
    families = families or PROMPT_FAMILIES
    text = F.coalesce(text, F.lit(""))
    scores = {name: reduce(lambda a, b: a + b, [text.rlike(f"(?i){x}").cast("int") for x in known]) for name, known in families.items()}
    out = rows.withColumns(scores)
    total = reduce(lambda a, b: a + b, [F.col(n) for n in families])
    high = reduce(lambda a, b: a + b, [(F.col(n) >= 3).cast("int") for n in families])
    level = F.when((high >= 2) | (total >= 8), "high").when((high >= 1) | (total >= 4), "medium").otherwise("low")
    return out.withColumns({"total": total, "level": level})
