"""Exact selection by counts: the value of a given rank in each group, without sorting or gathering a group.

A group's range of values is cut into BUCKETS parts, the rows of each are counted (added up in each task before the shuffle), and the part that holds the rank becomes the next range, from its least to
its greatest value. A few passes, each over the rows still in range, end at one value, or at FEW rows, which are numbered.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftkite.staging import stage

#: Parts that a range is cut into, and rows of a group that are numbered together.
BUCKETS, FEW = 1024, 4096


def value_at(df: DataFrame, by: Sequence[str], value: str, rank: Column | DataFrame) -> DataFrame:
    """by, n, rank, value and less for each group: the value that stands at `rank` in ascending order, and how many rows have a smaller one. Ranks are from 0: a column of n, or a table of by and rank.

    Null and NaN values are not counted; groups without others, and ranks outside 0 to n - 1, have no row. Null keys are keys. `value` is a number.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).alias("v")).filter(F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double")))
    state = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    if isinstance(rank, DataFrame):
        state = state.join(rank.select(*[F.col(c).alias(f"s{k}") for c, k in zip(by, keys, strict=True)], F.col("rank").cast("long").alias("rank")), _same(keys, [f"s{k}" for k in keys]))
    else:
        state = state.withColumn("rank", rank.cast("long"))
    state = stage(state.filter("rank >= 0 and rank < n").select(*keys, "n", "rank", "low", "high", F.lit(0).cast("long").alias("less"), F.col("n").alias("within")), "ranges")
    if not keys:
        keys, rows, state = ["_k"], rows.withColumn("_k", F.lit(0)), state.withColumn("_k", F.lit(0))
    done = None
    while True:
        over = state.filter("low = high").select(*keys, "n", "rank", F.col("low").alias("value"), "less")
        few = state.filter(f"low <> high and within <= {FEW}")
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("v")) - 1
        held = _in_range(rows, few, keys).withColumn("_at", place).withColumn("_less", F.rank().over(Window.partitionBy(*keys).orderBy("v")) - 1)
        held = held.filter("_at = rank - less").select(*keys, "n", "rank", F.col("v").alias("value"), (F.col("less") + F.col("_less")).alias("less"))
        found = over.unionByName(held)
        done = found if done is None else done.unionByName(found)
        many = state.filter(f"low <> high and within > {FEW}")
        if many.isEmpty():
            break
        apart = lambda c: F.coalesce(F.try_subtract(F.col(c), F.col("low")).cast("double"), F.col(c).cast("double") - F.col("low").cast("double"))
        share = apart("v") / apart("high")  # not a number only where one end is infinite
        part = F.when(F.col("v") == F.col("low"), -1).when(F.isnan(share), BUCKETS).otherwise(F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS).cast("int")))
        counts = _in_range(rows, many, keys).withColumn("_part", part).groupBy(*keys, "n", "rank", "less", "_part").agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.coalesce(F.sum("c").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("less", F.col("less") + before).filter("less <= rank and rank < less + c")
        state = stage(counts.select(*keys, "n", "rank", "low", "high", "less", F.col("c").alias("within")), "ranges")
    return done.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=False)], "n", "rank", F.col("value"), "less")


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda out, k: out & F.col(k[0]).eqNullSafe(F.col(k[1])), zip(left, right, strict=True), F.lit(True))


def _in_range(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    sides = [f"s{k}" for k in keys]
    named = state.select(*[F.col(k).alias(s) for k, s in zip(keys, sides, strict=True)], "n", "rank", "less", "low", "high")
    return rows.join(named, _same(keys, sides) & (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))).drop(*sides)


def upper_median(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, n and median: the value at n // 2 in ascending order."""
    return value_at(df, by, value, F.floor(F.col("n") / 2)).select(*by, "n", F.col("value").alias("median"))


def row_at(df: DataFrame, by: Sequence[str], value: str, tie: str, rank: Column) -> DataFrame:
    """The row of each group that stands at `rank` by value, of equals by `tie` (a number, without nulls). All columns; rows without a value do not count."""
    sides = [f"_s{i}" for i in range(len(by))]
    beside = [F.col(c).alias(s) for c, s in zip(by, sides, strict=True)]
    found = stage(value_at(df, by, value, rank), "found")
    equal = stage(df.join(found.select(*beside, F.col("value").alias("_value")), _same(by, sides) & (F.col(value) == F.col("_value"))).select(*df.columns), "equal")
    ties = value_at(equal, by, tie, found.select(*by, (F.col("rank") - F.col("less")).alias("rank")))
    return equal.join(ties.select(*beside, F.col("value").alias("_tie")), _same(by, sides) & (F.col(tie) == F.col("_tie"))).select(*df.columns)


def top_share(df: DataFrame, score: str, tie: str, share: float) -> DataFrame:
    """The max(1, floor(share * n)) rows of greatest score, of equals at the cut the first by `tie` (a number, unique). Null and NaN scores come last; none of an empty table."""
    real = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    n = df.count()
    k = max(1, int(share * n)) if n else 0
    m = df.filter(real).count()
    if k >= m:
        return df.filter(real).unionByName(_first(df.filter(~real), tie, k - m))
    cut = value_at(df, [], score, F.col("n") - k).first()
    above = df.filter(real & (F.col(score) > F.lit(cut["value"])))
    return above.unionByName(_first(df.filter(F.col(score) == F.lit(cut["value"])), tie, k - above.count()))


def _first(df: DataFrame, tie: str, k: int) -> DataFrame:
    """The first k rows by tie."""
    if k <= 0:
        return df.limit(0)
    edge = value_at(df, [], tie, F.least(F.lit(k), F.col("n")) - 1).first()
    return df.limit(0) if edge is None else df.filter(F.col(tie) <= F.lit(edge["value"]))
