"""Usage, cost, performance and trend aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftkite.functions.priorities import WARNING_POINTS
from siftkite.functions.scoring import cost, lookup


def breakdown(usage: DataFrame, dimensions: list[str]) -> DataFrame:
    """Tokens, cost by the price of each call's model, calls and latency by each dimension and in all, in one pass; level has a bit for each dimension that is summed over, the first highest."""
    sets = [[F.col(d)] for d in dimensions] + [[]]
    bits = sum((F.grouping(d) * (1 << (len(dimensions) - 1 - i)) for i, d in enumerate(dimensions)), F.lit(0))
    priced = usage.withColumn("_cost", cost(F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens")))
    return priced.groupingSets(sets, *dimensions).agg(
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.sum("_cost").alias("cost_usd"), F.count("*").alias("calls"), F.sum("latency").alias("latency"), bits.alias("level")
    )


def statistics(usage: DataFrame, by: str) -> DataFrame:
    """Count, mean, median, extremes, sample deviation (0 for one row), success and cache rates by `by` and over 'all'."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    out = usage.rollup(by).agg(
        F.count("*").alias("n"), F.avg("latency").alias("mean"), F.median("latency").alias("median"), F.min("latency").alias("least"), F.max("latency").alias("most"),
        F.coalesce(F.stddev_samp("latency"), F.lit(0.0)).alias("deviation"), rate("success").alias("success_rate"), F.avg(F.when(F.col("success"), F.col("latency"))).alias("success_latency"), rate("cache_hit").alias("hit_rate"),
    )
    return out.withColumn(by, F.coalesce(by, F.lit("all")))


def roi(usage: DataFrame, findings: DataFrame) -> DataFrame:
    """One row of what a scan's calls cost for what they found.

    usage: model, prompt_tokens, completion_tokens, file_path, cache_hit; findings: confirmed, eliminated (a false positive that was ruled out). Costs per finding, confirmed finding and eliminated one are infinite where there is none; without
    files, tokens or look-ups a ratio is 0. What the cache saves is the tokens of its hits at the mean price of a token.
    """
    tokens = F.col("prompt_tokens") + F.col("completion_tokens")
    spent = usage.agg(
        F.coalesce(F.sum(cost(F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens"))), F.lit(0.0)).alias("cost"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"), F.countDistinct("file_path").alias("files"),
        F.count_if("cache_hit").alias("hits"), F.count_if(~F.col("cache_hit")).alias("misses"), F.coalesce(F.sum(F.when(F.col("cache_hit"), tokens)), F.lit(0)).alias("saved"),
    )
    found = findings.agg(F.struct(F.count("*").alias("found"), F.count_if("confirmed").alias("confirmed"), F.count_if("eliminated").alias("eliminated"))).scalar()
    each = lambda n: F.when(F.col(n) > 0, F.round(F.col("cost") / F.col(n), 8)).otherwise(F.lit(float("inf")))
    rate = lambda n, d, digits: F.when(F.col(d) > 0, F.round(n / F.col(d), digits)).otherwise(F.lit(0.0))
    both = spent.withColumn("_f", found).select("*", "_f.*", (F.col("hits") + F.col("misses")).alias("asked"))
    return both.select(
        F.round(F.col("cost") / F.greatest("files", F.lit(1)), 8).alias("cost_per_file"), each("found").alias("cost_per_finding"), each("confirmed").alias("cost_per_confirmed"), each("eliminated").alias("cost_per_eliminated"),
        rate(F.col("found") * 1000, "tokens", 6).alias("findings_per_1k"), rate(F.col("confirmed") * 1000, "tokens", 6).alias("confirmed_per_1k"), rate(F.col("hits"), "asked", 4).alias("hit_rate"),
        rate(F.col("saved") * F.col("cost"), "tokens", 8).alias("saved_usd"), F.col("found").alias("findings"), "confirmed", "eliminated", F.round("cost", 8).alias("cost_usd"), "tokens",
    )


def daily(events: DataFrame, ts: str) -> DataFrame:
    return events.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))


def forecast(days: DataFrame, ahead: int, origin: str = "2024-01-01") -> DataFrame:
    """(day_index, predicted): the least-squares line over day indexes, carried on; never below 0. No rows for fewer than three days."""
    x = F.datediff("day", F.lit(origin).cast("date"))
    line = days.select(x.alias("x"), "n").agg(F.regr_slope("n", "x").alias("m"), F.regr_intercept("n", "x").alias("b"), F.max("x").alias("last"), F.count("*").alias("points")).filter("points >= 3")
    out = line.select("m", "b", F.explode(F.transform(F.sequence(F.lit(1), F.lit(ahead)), lambda i: F.col("last") + i)).alias("day_index"))
    return out.select("day_index", F.greatest(F.lit(0.0), F.bround(F.col("b") + F.col("m") * F.col("day_index"), 0)).alias("predicted"))


def dependency_risk(deps: DataFrame, by: str, warnings: DataFrame | None = None) -> DataFrame:
    """0 to 100: severities up to 50, supply-chain warnings (by, level, confidence) up to 30, and the number and depth of dependencies up to 20."""
    points = F.sum(F.when(F.col("cvss") >= 9, 15).when(F.col("cvss") >= 7, 10).when(F.col("cvss") >= 4, 5).otherwise(2))
    n, deep = F.count("*"), F.avg((F.col("dependency_type") == "transitive").cast("double"))
    size = F.when(n > 200, 15).when(n > 100, 10).when(n > 50, 5).otherwise(0) + F.when(deep > 0.8, 5).when(deep > 0.5, 3).otherwise(0)
    out = deps.groupBy(by).agg((F.least(F.lit(50), points) + F.least(F.lit(20), size)).cast("double").alias("own"))
    if warnings is None:
        return out.select(by, F.bround("own", 1).alias("risk"))
    warned = warnings.groupBy(by).agg(F.sum(lookup(F.col("level"), WARNING_POINTS, 1.0) * F.col("confidence")).alias("warned"))
    risk = F.least(F.lit(100.0), F.col("own") + F.least(F.lit(30.0), F.coalesce("warned", F.lit(0.0))))
    return out.join(warned, by, "left").select(by, F.bround(risk, 1).alias("risk"))
