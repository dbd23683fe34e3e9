"""Risk scores as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
WEIGHTS = {"exploitability": 0.30, "impact": 0.35, "prevalence": 0.15, "detectability": 0.20}
VECTOR_POINTS = {"network": 30.0, "adjacent": 22.0, "local": 12.0, "physical": 5.0}
COMPLEXITY_POINTS = {"low": 20.0, "medium": 12.0, "high": 5.0}
EXPLOIT_POINTS = {"available": 15.0, "functional": 12.0, "proof_of_concept": 7.0, "unavailable": 2.0}
CIA_SHARES = {"high": 1.0, "medium": 0.6, "low": 0.3, "none": 0.0}
FIX_HOURS = {"critical": 80.0, "high": 24.0, "medium": 8.0, "low": 2.0, "info": 0.5}
#: How common a weakness is, of 100.
PREVALENCE = {
    "CWE-79": 92.0, "CWE-78": 78.0, "CWE-89": 85.0, "CWE-416": 76.0, "CWE-787": 82.0, "CWE-125": 74.0, "CWE-22": 71.0, "CWE-352": 70.0, "CWE-798": 72.0, "CWE-918": 73.0, "CWE-502": 77.0, "CWE-434": 65.0, "CWE-20": 68.0,
    "CWE-23": 60.0, "CWE-36": 55.0, "CWE-426": 58.0, "CWE-190": 62.0, "CWE-287": 67.0, "CWE-522": 64.0, "CWE-611": 69.0, "CWE-732": 61.0, "CWE-617": 57.0, "CWE-476": 66.0, "CWE-269": 63.0, "CWE-295": 59.0, "CWE-306": 56.0,
    "CWE-862": 54.0, "CWE-863": 52.0, "CWE-276": 50.0, "CWE-94": 75.0, "CWE-91": 48.0, "CWE-119": 70.0, "CWE-120": 65.0, "CWE-400": 60.0, "CWE-77": 72.0, "CWE-90": 55.0, "CWE-96": 53.0, "CWE-601": 51.0, "CWE-311": 49.0,
    "CWE-327": 58.0, "CWE-330": 47.0, "CWE-331": 45.0, "CWE-362": 56.0, "CWE-693": 50.0, "CWE-706": 48.0, "CWE-754": 53.0, "CWE-760": 46.0, "CWE-829": 54.0, "CWE-834": 44.0, "CWE-908": 42.0, "CWE-940": 40.0, "CWE-1021": 38.0,
}
#: Parts of a technology stack that make a kind of finding more common.
STACKS = {
    "sql_injection": ["django", "flask", "sqlalchemy", "jdbc", "mysql", "postgres"],
    "xss": ["express", "react", "vue", "angular", "django", "flask", "jinja"],
    "command_injection": ["subprocess", "os.system", "shell", "cgi"],
    "ssrf": ["requests", "urllib", "http.client", "axios", "fetch"],
    "deserialization": ["pickle", "yaml", "java.io", "marshal", "php.unserialize"],
    "path_traversal": ["flask", "django", "express", "fastapi", "nginx", "apache"],
}
#: USD for 1000 prompt and completion tokens.
PRICES = {"deepseek-v4-flash": (0.00027, 0.0011), "deepseek": (0.00027, 0.0011), "gpt-4o": (0.005, 0.015), "gpt-4o-mini": (0.00015, 0.0006), "default": (0.001, 0.002)}


def lookup(value: Column, table: dict[str, float], default: float) -> Column:
    return reduce(lambda out, kv: out.when(value == kv[0], kv[1]), list(table.items())[1:], F.when(value == next(iter(table)), table[next(iter(table))])).otherwise(default)


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def bands(value: Column, cuts: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first cut that the value reaches."""
    out = None
    for at, name in cuts:
        out = F.when(value >= at, name) if out is None else out.when(value >= at, name)
    return out.otherwise(rest)


def exploitability(vector: Column, complexity: Column, auth: Column, interaction: Column, exploit: Column) -> Column:
    points = lookup(vector, VECTOR_POINTS, 12.0) + lookup(complexity, COMPLEXITY_POINTS, 12.0)
    points = points + F.when(auth, 6.0).otherwise(20.0) + F.when(interaction, 5.0).otherwise(15.0) + lookup(exploit, EXPLOIT_POINTS, 2.0)
    return F.bround(clamp(points), 2)


def impact(confidentiality: Column, integrity: Column, availability: Column, *, factors: Column) -> Column:
    """Half from the mean of the three, the rest from further factors already in points."""
    mean = (lookup(confidentiality, CIA_SHARES, 0.6) + lookup(integrity, CIA_SHARES, 0.6) + lookup(availability, CIA_SHARES, 0.6)) / 3
    return F.bround(clamp(mean * 50 + factors), 2)


def prevalence(base: Column, stacks: Column, has_cve: Column) -> Column:
    """The base rate (30 if unknown), 3 for each matching stack up to 10, and 5 for a known CVE."""
    return F.bround(clamp(F.coalesce(base, F.lit(30.0)) + F.least(stacks * 3.0, F.lit(10.0)) + F.when(has_cve, 5.0).otherwise(0.0)), 2)


def cwe_prevalence(cwe: Column, kind: Column, stack: Column, has_cve: Column) -> Column:
    """prevalence of a weakness from the fixed rates and from what of the stack (an array of names) fits the kind of finding; a repeated name counts again."""
    table = F.create_map(*[F.lit(x) for kv in PREVALENCE.items() for x in kv])
    fits = F.create_map(*[x for k, v in STACKS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    known = F.try_element_at(fits, F.lower(kind))
    count = F.size(F.filter(F.coalesce(stack, F.array().cast("array<string>")), lambda s: F.coalesce(F.array_contains(known, F.lower(s)), F.lit(False))))
    return prevalence(F.try_element_at(table, cwe), count, F.coalesce(has_cve, F.lit(False)))


def cvss_vector(exploitability_: Column, impact_: Column) -> Column:
    """The CVSS 3.1 vector that two scores of 100 stand for."""
    e = lambda cuts, rest: bands(exploitability_, cuts, rest)
    cia = lambda middle: bands(impact_, [(80, "H"), (50, "L"), (25, middle)], "N")
    parts = [("AV", e([(75, "N"), (50, "A"), (25, "L")], "P")), ("AC", e([(60, "L")], "H")), ("PR", e([(80, "N"), (40, "L")], "H")), ("UI", e([(65, "N")], "R")), ("S", bands(impact_, [(75, "C")], "U"))]
    parts += [("C", cia("L")), ("I", cia("N")), ("A", cia("N"))]
    return F.concat_ws("/", F.lit("CVSS:3.1"), *[F.concat(F.lit(f"{name}:"), value) for name, value in parts])


def detectability(static: Column, dynamic: Column, clarity: Column, depth: Column, false_positives: Column) -> Column:
    flow = F.when(depth <= 1, 15.0).when(depth <= 3, 11.0).when(depth <= 6, 7.0).otherwise(3.0)
    sure = F.when(false_positives.isNull(), 5.0).otherwise(F.greatest(F.lit(0.0), (1 - false_positives) * 10))
    return F.bround(clamp(static + dynamic + clarity + flow + sure), 2)


def composite(scores: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    total = reduce(lambda a, b: a + b, [scores[k] * w for k, w in (weights or WEIGHTS).items()])
    return F.bround(clamp(total), 2)


def to_cvss(score: Column) -> Column:
    """0-100 onto 0-10, straight between the bands' ends."""
    out = F.when(score >= 80, 9.0 + (score - 80) / 20 * 1.0).when(score >= 55, 7.0 + (score - 55) / 24 * 1.9).when(score >= 25, 4.0 + (score - 25) / 29 * 2.9).when(score >= 1, 0.1 + (score - 1) / 23 * 3.8).otherwise(0.0)
    return F.bround(clamp(out, 0.0, 10.0), 1)


def composite_band(score: Column) -> Column:
    return bands(score, [(80, "critical"), (55, "high"), (25, "medium"), (1, "low")], "info")


def real_risk(cvss: Column, exploit: Column, reach: Column, asset: Column) -> Column:
    return cvss / 10 * exploit * reach * asset


def priority_tier(score: Column) -> Column:
    return bands(score, [(0.7, "P0"), (0.5, "P1"), (0.3, "P2")], "P3")


def risk_level(cvss: Column, exploit: Column) -> Column:
    """Bands over two scales."""
    return F.when((cvss >= 9) & (exploit >= 0.7), "critical").when((cvss >= 7) & (exploit >= 0.5), "high").when(cvss >= 4, "medium").otherwise("low")


def reachability(entries: Column, path: Column, barriers: Column, modifier: Column) -> Column:
    """Entries out of three, less .2 for each step past the first and .3 for each barrier."""
    decay = F.greatest(F.lit(0.0), 1 - 0.2 * F.greatest(path - 1, F.lit(0)))
    stop = F.greatest(F.lit(0.0), 1 - 0.3 * barriers)
    return F.least(F.lit(1.0), F.least(F.lit(1.0), entries / 3) * decay * stop * modifier)


def confidence_decay(path_files: Column, source: Column, sink: Column, sanitized: Column) -> Column:
    base = (source + sink) / 2 * F.when(path_files > 1, 0.9).otherwise(1.0) + F.when((source > 0.8) & (sink > 0.8), 0.05).otherwise(0.0)
    return clamp(base * F.when(sanitized, 0.8).otherwise(1.0) * F.greatest(1 - 0.05 * path_files, F.lit(0.5)), 0.0, 1.0)


def assessment(severity: Column, exploit: Column, impact_: Column, confidence: Column, multiplier: Column, hallucination: Column) -> Column:
    return F.when(hallucination, 0.0).otherwise((0.4 * severity + 0.3 * exploit + 0.2 * impact_ + 0.1 * confidence) * multiplier)


def fix_hours(severity: Column, kind: Column) -> Column:
    """(fix, test, deploy) hours."""
    hours = lookup(severity, FIX_HOURS, 8.0)
    return F.struct(hours.alias("fix"), (hours * 0.5).alias("test"), (hours * 0.25).alias("deploy"))


def nonlinear(score: Column, content: Column) -> Column:
    lift = F.when(score > 0.7, 1.1).when(score > 0.5, 1.05).otherwise(1.0) * F.when(content > 0.8, 1.15).otherwise(1.0)
    return F.least(F.lit(1.0), score * lift)


def capped_counts(hits: Column, kinds: Column) -> Column:
    return F.least(F.lit(0.7), 0.1 * hits) + F.least(F.lit(0.3), 0.05 * kinds)


def file_priority(rules: Column, model: Column, listed: Column) -> Column:
    return F.bround(0.3 * rules + 0.5 * F.coalesce(model, F.lit(0.5)) + 0.2 * listed, 3)


def verification_level(confidence: Column) -> Column:
    return bands(confidence, [(0.9, "triple_verified"), (0.7, "double_verified"), (0.5, "single_verified"), (0.3, "unverified")], "unknown")


def model_price(model: Column, prices: dict[str, tuple[float, float]] | None = None) -> Column:
    """(prompt, completion) price of the exact name, else of the longest known prefix, else the default."""
    prices = prices or PRICES
    price = lambda k: F.struct(F.lit(prices[k][0]).alias("prompt"), F.lit(prices[k][1]).alias("completion"))
    out = None
    for k in sorted((k for k in prices if k != "default"), key=lambda k: (-len(k), k)):
        out = F.when(model.startswith(k), price(k)) if out is None else out.when(model.startswith(k), price(k))
    return out.otherwise(price("default"))


def cost(model: Column, prompt: Column, completion: Column) -> Column:
    p = model_price(model)
    return F.round(prompt / 1000 * p["prompt"] + completion / 1000 * p["completion"], 10)


#: A group whose values spread less than FLAT around a mean above AGREED agrees too well.
FLAT, AGREED = 0.05, 0.7


def evidence_confidence(items: Column) -> Column:
    """An array of (confidence, code_snippet, location, reason): quantity, mean quality, context and path clarity; lowered when all agree too well."""
    n = F.size(items)
    values = F.transform(items, lambda x: F.coalesce(x["confidence"], F.lit(0.5)))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    mean = total / F.when(n == 0, 1).otherwise(n)
    spread = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.when(n == 0, 1).otherwise(n))
    points = lambda test, p: F.aggregate(items, F.lit(0.0), lambda a, x: a + F.when(F.coalesce(test(x), F.lit(False)), p).otherwise(0.0))
    context = points(lambda x: F.length(x["code_snippet"]) > 10, 0.15) + points(lambda x: ~x["location"].isin("N/A", "Unknown", ""), 0.1)
    clarity = points(lambda x: F.length(x["reason"]) > 20, 0.15)
    base = F.when(n <= 3, 0.3).when(n <= 6, 0.5).otherwise(0.7)
    score = base * 0.4 + mean * 0.3 + F.least(context, F.lit(0.3)) + F.least(clarity, F.lit(0.3))
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(0.95), score * F.when((F.when(n < 2, 0.0).otherwise(spread) < 0.05) & (mean > 0.7), 0.85).otherwise(1.0)))


def evidence_score(confidence: Column, snippet: Column, location: Column, reason: Column, *, order: Column | None = None) -> Column:
    """`evidence_confidence` as an aggregate over a group's rows, of which none is gathered: counts, mean and spread say all that it needs.

    With `order`, unique in a group, the spread of two rows is summed by Welford's steps from the first to the last, as a scan in that order does: where it is 0.05 but for the last bits,
    the steps decide on which side.
    """
    n, value = F.count("*"), F.coalesce(confidence, F.lit(0.5))
    mean, spread = F.avg(value), F.stddev_pop(value)
    if order is not None:
        first, last = F.min_by(value, order), F.max_by(value, order)
        spread = F.when(n == 2, F.sqrt((last - (first + (last - first) / 2)) * (last - first) / 2)).otherwise(spread)
    return evidence_total(n, mean, spread, *evidence_points(snippet, location, reason))


def evidence_points(snippet: Column, location: Column, reason: Column) -> tuple[Column, Column]:
    """Context and path clarity of a group's rows, as aggregates."""
    holds = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    return 0.15 * holds(F.length(snippet) > 10) + 0.1 * holds(~location.isin("N/A", "Unknown", "")), 0.15 * holds(F.length(reason) > 20)


def evidence_total(n: Column, mean: Column, spread: Column, context: Column, clarity: Column) -> Column:
    """The score of a group from its count, mean, spread and points."""
    base = F.when(n <= 3, 0.3).when(n <= 6, 0.5).otherwise(0.7)
    score = base * 0.4 + mean * 0.3 + F.least(context, F.lit(0.3)) + F.least(clarity, F.lit(0.3))
    flat = (F.when(n < 2, 0.0).otherwise(spread) < FLAT) & (mean > AGREED)
    return F.least(F.lit(0.95), score * F.when(flat, 0.85).otherwise(1.0))


def near_bound(mean: Column, spread: Column) -> Column:
    """Whether the last bits of a mean or spread, and so the order in which they are added up, may decide on the score."""
    return (F.abs(mean - AGREED) < 1e-9) | (F.abs(spread - FLAT) < 1e-9)


def scan_steps(values: Column) -> Column:
    """(mean, spread) of an array of doubles by a sum and Welford's steps from the first to the last."""
    double = lambda x: F.lit(x).cast("double")
    start = F.struct(double(0).alias("n"), double(0).alias("sum"), double(0).alias("mean"), double(0).alias("square"))

    def step(a: Column, x: Column) -> Column:
        mean = a["mean"] + (x - a["mean"]) / (a["n"] + 1)
        return F.struct((a["n"] + 1).alias("n"), (a["sum"] + x).alias("sum"), mean.alias("mean"), (a["square"] + (x - mean) * (x - a["mean"])).alias("square"))

    return F.aggregate(values, start, step, lambda a: F.struct(F.try_divide(a["sum"], a["n"]).alias("mean"), F.sqrt(F.try_divide(a["square"], a["n"])).alias("spread")))
