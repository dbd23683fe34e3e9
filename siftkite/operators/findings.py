"""Findings: filters, de-duplication, votes, fusion, orders and roll-ups. Rows carry `pos`, their place in the input, wherever the first of equals wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftkite.functions import findings as X
from siftkite.functions import priorities as Q
from siftkite.functions import scoring as S
from siftkite.scan import prefix_sums


def at_least(df: DataFrame, value: Column, order: list[str], least: str, *, falling: bool = False) -> DataFrame:
    """Rows whose ordinal reaches `least`; falling: the order's first entry is the highest."""
    own, bound = X.ordinal(value, order), F.lit(order.index(least))
    return df.filter(own <= bound if falling else own >= bound)


def steady_mean(value: Column) -> Column:
    """The mean of a double column, the same in any order of its rows: decimals are summed, which rounds nothing, where every value is one of 18 places; else doubles in the order at hand."""
    exact = value.try_cast("decimal(28,18)")
    whole = F.bool_and(F.coalesce(exact.cast("double") == value, value.isNull()))
    return F.when(F.coalesce(whole, F.lit(True)), F.avg(exact).cast("double")).otherwise(F.avg(value))


def ordered_means(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, mean) of a double column, added up by each key in the order of a column that is unique there, as a scan in that order does: to the last bit the same, however the rows lie. A running sum needs no group in memory."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.select(*keys, order, value, F.sum(value).over(so_far).alias("_sum"))
    return rows.groupBy(*keys).agg(F.try_divide(F.max_by("_sum", order), F.count(value)).alias("mean"))


def first_of(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key by the order, which should be total."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_nth = 1").drop("_nth")


def deduplicate(df: DataFrame) -> DataFrame:
    """The first row of each (rule, file, line, first 50 characters of the snippet)."""
    return first_of(df, ["rule_id", "file_path", "line", F.substring("code_snippet", 1, 50)], ["pos"])


def smart_deduplicate(df: DataFrame, proximity: int = 5) -> DataFrame:
    """The most confident row of each (rule family, file, line bucket), then of each semantic key over all files; the first of equals."""
    order = [F.desc("confidence"), "pos"]
    near = first_of(df, [X.normal_rule(F.col("rule_id")), "file_path", X.line_bucket(F.col("line"), proximity)], order)
    return first_of(near, [X.semantic_key(F.col("rule_id"), F.col("description"))], order)


def most_confident(df: DataFrame) -> DataFrame:
    """The most confident row of each (rule, file:line, severity)."""
    return first_of(df, ["rule_id", "file_path", "line", "severity"], [F.desc("confidence"), "pos"])


def merge_verified(df: DataFrame) -> DataFrame:
    """One row of each (rule, file): verified before unverified, then the more severe, then the first."""
    return first_of(df, ["rule_id", "file_path"], [F.desc("verified"), X.severity_order(F.col("severity")), "pos"])


def merge_lists(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a (of a key (rule, line) the last) unless b has a strictly more confident one."""
    last = first_of(a, ["rule_id", "line"], [F.desc("pos")])
    both = last.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)))
    return first_of(both, ["rule_id", "line"], [F.desc("confidence"), "_side", "pos"]).drop("_side")


def protect_verified(df: DataFrame, trusted: list[str]) -> DataFrame:
    """Rows of other sources are replaced by the first verified row of a trusted source with the same rule and file, if there is one."""
    mine = df.filter(F.col("source").isin(trusted) & F.col("verified"))
    best = first_of(mine, ["rule_id", "file_path"], ["pos"]).select("rule_id", "file_path", F.struct(*[c for c in df.columns if c not in ("rule_id", "file_path")]).alias("_by"))
    out = df.join(best, ["rule_id", "file_path"], "left")
    swap = F.col("_by").isNotNull() & ~F.coalesce(F.col("source").isin(trusted), F.lit(False))
    return out.select(*[c if c in ("rule_id", "file_path") else F.when(swap, F.col(f"_by.{c}")).otherwise(F.col(c)).alias(c) for c in df.columns])


def near_lines(left: DataFrame, right: DataFrame, tolerance: int, *, file: str = "file_path", line: str = "line") -> DataFrame:
    """Inner band join: same file and lines at most `tolerance` apart, columns of the right with r_ before them.

    Lines fall into buckets a tolerance wide; a left row looks into its own and the two beside it, so the join is an equi join whose
    buckets hold few lines, whatever the file's size.
    """
    width = tolerance + 1
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("_b", F.floor(F.col(f"r_{line}") / width))
    probe = F.explode(F.array(*[F.floor(F.col(line) / width) + i for i in (-1, 0, 1)]))
    probed = left.withColumn("_lb", probe)
    return probed.join(r, (F.col(file) == F.col(f"r_{file}")) & (F.col("_lb") == F.col("_b"))).filter(F.abs(F.col(line) - F.col(f"r_{line}")) <= tolerance).drop("_b", "_lb")


def tool_matches(sarif: DataFrame, internal: DataFrame, *, tolerance: int = 3, similarity: float = 0.5) -> DataFrame:
    """(pos, r_pos) of findings of two tools that are one: path equal after normalising or the other's suffix, lines near, then the CWE, the rule or the words agree.

    A path that is another's suffix shares its last segment, so the last segment is the equi key.
    """
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    a = sarif.withColumn("path", X.normal_path(F.col("file_path"))).withColumn("base", name(F.col("path")))
    b = internal.withColumn("path", X.normal_path(F.col("file_path"))).withColumn("base", name(F.col("path")))
    # lines of 0 match only each other; the bucket join keeps them together
    near = near_lines(a, b, tolerance, file="base")
    same = (F.col("path") == F.col("r_path")) | F.col("path").endswith(F.col("r_path")) | F.col("r_path").endswith(F.col("path"))
    lined = ((F.col("line") > 0) & (F.col("r_line") > 0)) | ((F.col("line") == 0) & (F.col("r_line") == 0))
    alike = (F.col("cwe_id") == F.col("r_cwe_id")) | (F.lower("rule_id") == F.lower("r_rule_id")) | (X.jaccard(F.col("description"), F.col("r_description")) > similarity)
    return near.filter(same & lined & F.coalesce(alike, F.lit(False))).select("pos", "r_pos")


def votes_by_finding(votes: DataFrame) -> DataFrame:
    """Per finding and decision counts and summed confidence, mean time, tokens, agents, and the commonest severity (the most severe of equals)."""
    d = lambda x: F.col("decision") == x
    out = votes.groupBy("finding_id").agg(
        F.count("*").alias("votes"),
        *[F.count_if(d(x)).alias(f"n_{x.lower()}") for x in ("CONFIRMED", "REJECTED", "REFINED")],
        *[F.sum(F.when(d(x), F.col("confidence")).otherwise(0.0)).alias(f"c_{x.lower()}") for x in ("CONFIRMED", "REJECTED", "REFINED")],
        F.avg("execution_time_ms").alias("avg_time_ms"), F.sum("token_cost").alias("tokens"), F.countDistinct("agent_id").alias("agents"),
    )
    by = votes.groupBy("finding_id", "severity").agg(F.count("*").alias("n"))
    mode = by.groupBy("finding_id").agg(F.max_by("severity", F.struct(F.col("n"), -X.severity_order(F.col("severity")))).alias("severity"))
    return out.join(mode, "finding_id")


def _argmax(columns: dict[str, str]) -> tuple[Column, Column]:
    """The name whose column is greatest, the first of equals, and that greatest."""
    best = F.greatest(*[F.col(c) for c in columns.values()])
    return F.coalesce(*[F.when(F.col(c) == best, name) for name, c in columns.items()]), best


def decide(clusters: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Majority, confidence-weighted, unanimous and consensus decisions of `votes_by_finding`, the consensus level, and whether it is controversial."""
    names = ("CONFIRMED", "REJECTED", "REFINED")
    major, most = _argmax({x: f"n_{x.lower()}" for x in names})
    heavy, weight = _argmax({x: f"c_{x.lower()}" for x in names})
    total = F.col("c_confirmed") + F.col("c_rejected") + F.col("c_refined")
    share = lambda x: F.col(f"n_{x}") / F.col("votes")
    ratio = most / F.col("votes")
    return clusters.select(
        "*", major.alias("majority"), ratio.alias("majority_share"),
        F.when(total == 0, "REJECTED").otherwise(heavy).alias("weighted"),
        F.when(total == 0, 0.0).otherwise(weight / F.when(total == 0, 1.0).otherwise(total)).alias("weighted_share"),
        F.when(most == F.col("votes"), 1.0).otherwise(ratio).alias("unanimous_share"),
        F.when(share("confirmed") >= threshold, "CONFIRMED").when(share("rejected") >= threshold, "REJECTED").otherwise("REFINED").alias("consensus"),
        F.when(ratio >= 0.99, "unanimous").when(ratio >= 0.8, "strong").when(ratio >= 0.6, "moderate").when(ratio >= 0.4, "weak").otherwise("none").alias("level"),
        ((F.col("votes") >= 2) & (F.greatest("n_confirmed", "n_rejected", "n_refined") - F.least("n_confirmed", "n_rejected", "n_refined") <= 1)).alias("controversial"),
    )


def fuse(df: DataFrame, key: list[str]) -> DataFrame:
    """One row for each location: most severe (low at least), mean confidence, distinct sources and rules, rows by severity and mean confidence by source."""
    low = X.SEVERITIES.index("low")
    out = df.groupBy(*key).agg(
        F.least(F.min(X.severity_order(F.col("severity"))), F.lit(low)).alias("_o"), steady_mean(F.col("confidence")).alias("confidence"), F.count("*").alias("n"),
        F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("rule_id")).alias("rules"),
        *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in X.SEVERITIES],
    )
    return out.withColumn("severity", F.element_at(F.array(*map(F.lit, X.SEVERITIES)), F.col("_o").cast("int") + 1)).drop("_o")


def confidence_by_source(df: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """A map of each source's mean confidence by location; with `order` the means are `ordered_means`, else the same in any order of rows."""
    df = df.withColumn("source", F.coalesce("source", F.lit("Unknown")))
    by = [*key, "source"]
    means = ordered_means(df, by, "confidence", order) if order else df.groupBy(*by).agg(steady_mean(F.col("confidence")).alias("mean"))
    return means.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "mean")))).alias("confidence_by_source"))


def evidence_by(df: DataFrame, keys: list[str], confidence: str, snippet: str, location: str, reason: str, order: str) -> DataFrame:
    """(keys, confidence): `evidence_score` of each group, with its mean and spread as a scan in the order of `order`, unique in a group, finds them.

    Bits of these decide only where one is at its bound: the values of such groups, which are few, are gathered and added up in turn. Of the others no more is kept than counts, mean and spread.
    """
    value = F.coalesce(confidence, F.lit(0.5))
    context, clarity = S.evidence_points(F.col(snippet), F.col(location), F.col(reason))
    groups = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_spread"), context.alias("_context"), clarity.alias("_clarity"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    near = groups.filter(S.near_bound(F.col("_mean"), F.col("_spread"))).select(*[F.col(k).alias(f"_{k}") for k in keys])
    own = df.join(near, same, "left_semi").groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), value.alias("x")))).alias("_all"))
    steps = own.select(*[f"_{k}" for k in keys], S.scan_steps(F.transform("_all", lambda v: v["x"])).alias("_steps"))
    mean, spread = F.coalesce("_steps.mean", "_mean"), F.coalesce("_steps.spread", "_spread")
    score = S.evidence_total(F.col("_n"), mean, spread, F.col("_context"), F.col("_clarity"))
    return groups.join(steps, same, "left").select(*keys, score.alias("confidence"))


def histogram(df: DataFrame, value: Column, all_values: list[str]) -> DataFrame:
    """(value, n) with a zero for each value that doesn't occur; others are kept."""
    base = df.sparkSession.createDataFrame([(v,) for v in all_values], "value string")
    counts = df.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    return base.join(counts, "value", "full_outer").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def grouped_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """(dimension, value, n): counts by each key in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).cast("string").alias("value")) for k in keys]))
    return df.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def summary(df: DataFrame) -> DataFrame:
    """One row: how many, mean confidence, distinct files and rules, by verification level, hallucinated, coverage of verified rules."""
    seen = (F.col("status") == "CONFIRMED") | F.col("verified")
    return df.agg(
        F.count("*").alias("total"), F.avg("confidence").alias("avg_confidence"), F.countDistinct("file_path").alias("files"), F.countDistinct("rule_id").alias("rules"),
        *[F.count_if(F.col("verification_level") == v).alias(v) for v in X.VERIFICATION_LEVELS],
        F.count_if(F.col("verification_level").isNull()).alias("no_level"), F.count_if("is_hallucination").alias("hallucinations"),
        (100 * F.countDistinct(F.when(seen, F.col("rule_id"))) / F.countDistinct("rule_id")).alias("coverage"),
        (F.count_if(F.col("status") == "CONFIRMED") + F.count_if("verified")).alias("verified_twice"),
    )


def false_positive_rate(df: DataFrame) -> DataFrame:
    """The mean chance over all findings in percent, within 10 and 40, and by severity unbounded."""
    chance = X.false_positive_chance(F.col("confidence"), F.col("status"), F.col("title"))
    whole = df.agg(F.bround(100 * F.least(F.greatest(F.avg(chance), F.lit(0.10)), F.lit(0.40)), 2).alias("rate"), F.count("*").alias("n")).select(F.lit("all").alias("severity"), "n", "rate")
    return whole.unionByName(df.groupBy("severity").agg(F.count("*").alias("n"), F.bround(100 * F.avg(chance), 2).alias("rate")))


def ranked_files(files: DataFrame, strategies: list[str], *, key: str = "path", tie: str = "pos") -> DataFrame:
    """(key, strategy, total, level, rank) of every file by each strategy: the greatest total first, of equals the first by `tie`. Missing scores count 0. Ranks come from one sort over all tasks."""
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("_s"), F.lit(s).alias("strategy"), Q.strategy_total(s).alias("total")) for i, s in enumerate(strategies)])).alias("e")
    rows = files.select(F.col(key), F.col(tie).alias("_tie"), each).select(key, "_tie", "e.*", (-F.col("e.total")).alias("_order"))
    ranks = prefix_sums(rows, "_s", ["_order", "_tie"], at="_at", drop=["_order", "_tie"])
    return ranks.select(key, "strategy", "total", Q.priority_level(F.col("total")).alias("level"), (F.col("_at") + 1).alias("rank"))


def top_per(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key, numbered in column nth."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("nth") <= k)


def conflicts(df: DataFrame, gap: float = 0.3) -> DataFrame:
    """Pairs of results of one signal (pos_a < pos_b) whose states differ or whose confidences differ by more than the gap, one row for each kind."""
    a, b = df.alias("a"), df.alias("b")
    pairs = a.join(b, (F.col("a.signal_id") == F.col("b.signal_id")) & (F.col("a.pos") < F.col("b.pos")))
    kinds = F.array_compact(F.array(F.when(F.col("a.state") != F.col("b.state"), "state_conflict"), F.when(F.abs(F.col("a.confidence") - F.col("b.confidence")) > gap, "confidence_conflict")))
    return pairs.select(F.col("a.signal_id").alias("signal_id"), F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"), F.explode(kinds).alias("kind"))


def conflict_counts(df: DataFrame, gap: float = 0.3) -> DataFrame:
    """(signal_id, state, confidence, n, first_pos, n_state, n_confidence) of each kind of result of a signal: how many of its other results have another state, and how many a confidence that differs by more than the gap.

    Pairs are counted, not made: results are counted by kind before any window sees them. Confidences are compared to nine digits; null ones are in no confidence conflict, null states are a state.
    """
    kinds = df.groupBy("signal_id", "state", "confidence").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos")).withColumn("_c", F.round(F.col("confidence") * 1_000_000_000).cast("long"))
    of = Window.partitionBy("signal_id")
    step = round(gap * 1_000_000_000)
    near = F.sum(F.when(F.col("_c").isNotNull(), F.col("n"))).over(of.orderBy("_c").rangeBetween(-step, step))
    other = F.sum("n").over(of) - F.sum("n").over(Window.partitionBy("signal_id", "state"))
    apart = F.when(F.col("_c").isNull(), 0).otherwise(F.sum(F.when(F.col("_c").isNotNull(), F.col("n"))).over(of) - near)
    return kinds.select("signal_id", "state", "confidence", "n", "first_pos", other.alias("n_state"), apart.alias("n_confidence"))


def consensus(df: DataFrame, spread: float = 0.2) -> DataFrame:
    """Signals and whether their confidences agree: the largest and least at most `spread` apart."""
    return df.groupBy("signal_id").agg(F.count("*").alias("n"), (F.max("confidence") - F.min("confidence") <= spread + 1e-12).alias("agreed"))


def risk_matrix(df: DataFrame, row: Column, column: Column, columns: list[str]) -> DataFrame:
    """Counts by row and column; columns that don't occur are 0."""
    out = df.withColumn("_r", row).withColumn("_c", column).groupBy(F.col("_r").alias("likelihood")).pivot("_c", columns).count()
    return out.na.fill(0)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
