"""Joins that fall back: supplements, entry points that reach a file, the first of several matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftkite.operators.containment import containing
from siftkite.staging import stage


def supplement(current: DataFrame, extra: DataFrame, threshold: int) -> DataFrame:
    """current, and where it has fewer than `threshold` rows extra too. The columns are those of current."""
    few = current.limit(threshold).agg(F.count("*").alias("n")).scalar() < threshold
    return current.unionByName(extra.select(*current.columns).filter(few))


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def reachable(sinks: DataFrame, entries: DataFrame, calls: DataFrame, *, path: str = "path") -> DataFrame:
    """sinks with n_entries, entry (the path of the first by pos), reachable, base_score and confidence.

    An entry point (path, pos) reaches a sink if calls (entry, sink: paths) has the pair or both stand in one folder. Without any entry point all are reachable with 0.7 at confidence
    0.3; a sink that none reaches has 0 at 0.9, others null, to be scored from their paths, at 0.8. Entries are counted by folder and by call before the join, so no pairs are made.
    """
    points = entries.groupBy(F.col("path").alias("entry")).agg(F.min("pos").alias("pos"))
    first = F.min(F.struct("pos", "entry"))
    beside = points.groupBy(folder(F.col("entry")).alias("_folder")).agg(F.count("*").alias("_n"), first.alias("_first"))
    called = calls.select("entry", F.col("sink").alias("_sink")).distinct().filter(folder(F.col("entry")) != folder(F.col("_sink"))).join(points, "entry")
    called = called.groupBy("_sink").agg(F.count("*").alias("_m"), first.alias("_called"))
    out = sinks.withColumn("_folder", folder(F.col(path))).join(beside, "_folder", "left").join(called, F.col(path) == F.col("_sink"), "left")
    n = F.coalesce("_n", F.lit(0)) + F.coalesce("_m", F.lit(0))
    none = entries.limit(1).agg(F.count("*").alias("n")).scalar() == 0
    out = out.withColumn("n_entries", n).withColumn("entry", F.least("_first", "_called")["entry"])
    out = out.withColumn("reachable", none | (F.col("n_entries") > 0)).withColumn("base_score", F.when(none, 0.7).when(F.col("n_entries") == 0, 0.0))
    return out.withColumn("confidence", F.when(none, 0.3).when(F.col("n_entries") == 0, 0.9).otherwise(0.8)).select(*sinks.columns, "n_entries", "entry", "reachable", "base_score", "confidence")


def first_match(signals: DataFrame, findings: DataFrame, *, key: str, location: str, kind: str, order: str) -> DataFrame:
    """(key, the matched finding's order) of each signal: the first finding by `order` at its location, or whose kind contains the signal's.

    Kinds are compared as distinct values, by the rarest part of the signal's (`containing`). An empty kind is matched by location only.
    """
    kinds = stage(findings.filter(F.col(kind).isNotNull()).groupBy(F.lower(kind).alias("id")).agg(F.min(order).alias("at")), "kinds")
    parts = containing(kinds.select("id", F.col("id").alias("text")), signals.select(F.lower(kind).alias("pattern")))
    of_kind = parts.join(kinds, "id").groupBy(F.col("pattern").alias("part")).agg(F.min("at").alias("by_kind"))
    of_place = findings.filter(F.col(location).isNotNull()).groupBy(F.col(location).alias("place")).agg(F.min(order).alias("by_place"))
    out = signals.join(of_place, F.col(location) == F.col("place"), "left").join(of_kind, F.lower(kind) == F.col("part"), "left")
    return out.select(key, F.least("by_place", "by_kind").alias("matched"))


def similar_titles(items: DataFrame, of: str, limit: int = 5, *, key: str = "cve_id") -> DataFrame:
    """The first `limit` other items by key whose title or description contains the title of item `of`, with similarity 1. No rows if it has no title."""
    title = items.filter(F.col(key) == of).agg(F.min("title").alias("t")).scalar()
    hit = F.contains("description", title) | F.contains("title", title)
    return items.filter((F.col(key) != of) & F.coalesce(hit, F.lit(False))).orderBy(key).limit(limit).select(key, "title", "description", F.lit(1.0).alias("similarity"))


def flat_report(reports: DataFrame) -> DataFrame:
    """One row for each report: findings by severity 'critical' or 'high', all findings, and the tokens of its records.

    reports: report_id, findings array<struct<severity>>, token_records array<struct<total_tokens>>. Null arrays count as empty, null tokens as 0.
    """
    findings, records = F.coalesce("findings", F.array()), F.coalesce("token_records", F.array())
    risky = F.size(F.filter(findings, lambda x: F.coalesce(x["severity"].isin("critical", "high"), F.lit(False))))
    tokens = F.aggregate(records, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["total_tokens"].cast("long"), F.lit(0)))
    return reports.select("report_id", F.size(findings).alias("n_findings"), risky.alias("n_risky"), F.size(records).alias("n_records"), tokens.alias("tokens"))


# Words that stand for the last entity of a type; "entity" is any.
PRONOUNS = {
    "it": "entity", "this": "entity", "that": "entity", "these": "entity", "them": "entity", "the file": "file", "the function": "function", "this function": "function",
    "that function": "function", "the class": "class", "this class": "class", "that class": "class", "these files": "file", "those files": "file",
}
ENTITY_TYPES = ["file", "function", "class", "variable"]


def resolve_references(references: DataFrame, entities: DataFrame, *, scope: str, key: str, recent: int = 5) -> DataFrame:
    """(key, name) of what each reference (scope, key, reference) stands for among its scope's entities (type, name, seen, pos), null if for nothing.

    In turn: for a pronoun the last seen of its type among the `recent` last ones, of equals the first by pos; the entity of that very name, by type in the order of ENTITY_TYPES, then any
    by pos, then whatever the case; the first by pos whose name contains the reference. The last stage is a containment join by the rarest part of a reference.
    """
    asked = references.select(F.col(scope).alias("_s"), F.col(key).alias(key), "reference").withColumn("_low", F.lower(F.trim("reference")))
    known = entities.select(F.col(scope).alias("_s"), "type", "name", "seen", "pos")
    last = known.withColumn("_n", F.row_number().over(Window.partitionBy("_s").orderBy(F.desc("seen"), "pos"))).filter(F.col("_n") <= recent)
    last = last.select("_s", "name", "_n", F.explode(F.array("type", F.lit("entity"))).alias("_of")).groupBy("_s", "_of").agg(F.min_by("name", "_n").alias("by_pronoun"))
    of = F.create_map(*[F.lit(x) for kv in PRONOUNS.items() for x in kv])
    rows = asked.withColumn("_of", F.try_element_at(of, F.col("_low"))).join(last, ["_s", "_of"], "left")
    rank = F.coalesce(*[F.when(F.col("type") == t, i) for i, t in enumerate(ENTITY_TYPES)], F.lit(len(ENTITY_TYPES)))
    exact = known.groupBy("_s", F.col("name").alias("reference")).agg(F.min_by("name", F.struct(rank.alias("r"), "pos")).alias("by_name"))
    folded = known.groupBy("_s", F.lower("name").alias("_fold")).agg(F.min_by("name", "pos").alias("by_fold"))
    rows = rows.join(exact, ["_s", "reference"], "left").withColumn("_fold", F.lower("reference")).join(folded, ["_s", "_fold"], "left")
    rows = rows.withColumn("_found", F.coalesce("by_pronoun", "by_name", "by_fold"))
    open_ = rows.filter(F.col("_found").isNull() & F.col("_low").isNotNull()).select("_s", "_low").distinct()
    names = known.filter("name is not null").groupBy("_s", F.lower("name").alias("whole")).agg(F.min(F.struct("pos", "name")).alias("first"))
    names = stage(names.withColumn("id", F.monotonically_increasing_id()), "names")
    held = containing(names.select("id", F.col("whole").alias("text"), F.col("_s").alias("by")), open_.select(F.col("_low").alias("pattern"), F.col("_s").alias("by")))
    held = held.join(names.select("id", "first"), "id").groupBy(F.col("by").alias("_s"), F.col("pattern").alias("_low")).agg(F.min("first").alias("_first"))
    held = held.unionByName(names.groupBy("_s").agg(F.min("first").alias("_first")).withColumn("_low", F.lit("")))  # the empty reference is in every name
    rows = rows.join(held, ["_s", "_low"], "left")
    return rows.select(key, F.coalesce("_found", F.col("_first.name")).alias("name"))


def neighbourhood(hits: DataFrame, items: DataFrame, *, key: str = "cve_id", order: str = "place", first: int = 5, top: int = 5) -> DataFrame:
    """(key, neighbour, score): for each of the first hits by `order` the first `top` other items by key whose title or description contains its title, with score 1.

    The first hits are a handful of rows and go to all tasks; items meet them in one pass, and each task keeps `top` rows for each.
    """
    few = hits.filter(F.col(key).isNotNull()).orderBy(order).limit(first).select(key).distinct()
    titles = F.broadcast(items.join(F.broadcast(few), key).select(F.col(key).alias("_of"), F.col("title").alias("_title")))
    pairs = items.join(titles, (F.col(key) != F.col("_of")) & (F.contains("description", F.col("_title")) | F.contains("title", F.col("_title"))))
    place = F.row_number().over(Window.partitionBy("_of").orderBy(key))
    return pairs.withColumn("_n", place).filter(F.col("_n") <= top).select(F.col("_of").alias(key), F.col(key).alias("neighbour"), F.lit(1.0).alias("score"))
