"""Merge of samples of nested JSON by the kind of each field.

The samples are taken apart level by level: objects into their fields, each with the sample's weight and place. At every path the first value says what is done: numbers are averaged by weight, lists united in order, objects
taken apart further, anything else is voted on by weight. The results are put together again from the deepest level up. Each step is an aggregate or an equi join by group and path, so a group of any number of samples is
spread over tasks; what a result holds is in one row, as it is one value. Equal values of a path are one row from the second level on, and a level's values are taken apart once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftkite.staging import stage


def _is_list(json: Column) -> Column:
    return json.startswith("[")


def _is_object(json: Column) -> Column:
    return json.startswith("{")


def _is_number(json: Column) -> Column:
    """Whether a value's JSON, as to_json writes it, is a number or true or false."""
    return F.substring(json, 1, 1).isin(*"-0123456789tf")


def _is_whole(json: Column) -> Column:
    return _is_number(json) & (json.isin("true", "false") | json.try_cast("bigint").isNotNull())


def _text(json: Column) -> Column:
    """How a value is compared: the text of a string, else its JSON. Only strings with escapes are parsed."""
    plain = json.substr(F.lit(2), F.length(json) - 2)
    return F.when(~json.startswith('"'), json).when(json.contains("\\"), F.try_variant_get(F.parse_json(json), "$", "string")).otherwise(plain)


def _number(json: Column) -> Column:
    return F.when(json == "true", 1.0).when(json == "false", 0.0).when(_is_number(json), json.try_cast("double"))


def _plain(json: Column) -> Column:
    """A sample's JSON as to_json writes it, but for lists and objects with something in them, which go as they came: they are taken apart later. Null where it is broken."""
    parsed = F.try_parse_json(json)
    return F.when(json.rlike(r"^\{\s*[^\s}]") | json.rlike(r"^\[\s*[^\s\]]"), F.when(parsed.isNotNull(), json)).otherwise(F.to_json(parsed))


def _exact(value: Column, unit: float) -> Column:
    """A double as a whole number of 1/unit, else null."""
    whole = F.when(F.abs(value) * unit < 2.0**53, F.rint(value * unit).cast("bigint"))
    return F.when(whole / F.lit(unit) == value, whole)


def _exact_sum(exact: Column) -> Column:
    """The sum if no value is missing and it fits, the same in any order of the rows; else null."""
    return F.when(F.count(exact) == F.count("*"), F.try_sum(exact))


def _steady_sum() -> Column:
    """The sum of column w, by column exact (its billionths) where that can be."""
    return F.coalesce(_exact_sum(F.col("exact")) / F.lit(1e9), F.sum("w"))


def _quoted(name: Column) -> Column:
    json = F.to_json(F.array(name))
    return json.substr(F.lit(2), F.length(json) - 2)


def merge_typed(samples: DataFrame, by: str, *, json: str = "json", weight: str = "weight", pos: str = "pos") -> DataFrame:
    """(by, json): the merged value of each group's samples (by, pos, weight, json text), in order of pos.

    One value stays as it is. Numbers, if all are (true and false count as 1 and 0): their weighted mean, whole if all are whole, else to four digits; with no weight the first. A list first: the distinct items of all lists in order, by their
    text, others passed over. An object first: the fields of all objects, each merged by itself, others passed over. Else: the value whose text, trimmed and in lower case, has most weight, of equals the first. Rows whose JSON is null or broken are left out; a null
    weight is 0. pos is unique in a group. Keys of an object come in order. Weights of up to nine places, and numbers of up to six, are summed exactly, so equal weights are equal in any order of the rows.
    """
    spark = samples.sparkSession
    rows = samples.select(F.col(by).alias("g"), F.array().cast("array<string>").alias("path"), F.lit(1).cast("long").alias("n"), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("w"), F.col(pos).cast("long").alias("pos"), _plain(F.col(json).cast("string")).alias("v"))
    # filtered after it is staged: a filter would go below the caller's shuffles and have all JSON made and parsed twice
    rows = stage(rows.withColumn("exact", _exact(F.col("w"), 1e9)), "level").filter("v is not null")
    levels, v = [], F.col("v")
    while not rows.isEmpty():
        about = rows.groupBy("g", "path").agg(
            F.sum("n").alias("n"), F.min("pos").alias("first"), F.min(F.when(_is_list(v), F.col("pos"))).alias("list"), F.min(F.when(_is_object(v), F.col("pos"))).alias("object"),
            F.bool_or(_is_list(v) & (v != "[]")).alias("items"), F.bool_or(_is_object(v) & (v != "{}")).alias("fields"),
            F.bool_and(_is_number(v)).alias("numbers"), F.bool_and(_is_whole(v)).alias("whole"), _steady_sum().alias("total"), F.sum(F.col("w") * _number(v)).alias("weighted"),
            _exact_sum(F.col("exact")).alias("exact_total"), _exact_sum(F.col("exact").cast("decimal(19,0)") * _exact(_number(v), 1e6).cast("decimal(18,0)")).alias("exact_weighted"),
        )
        way = F.when(F.col("n") == 1, "one").when(F.col("numbers") & (F.col("total") <= 0), "first").when(F.col("numbers"), "mean").when(F.col("list") == F.col("first"), "list").when(F.col("object") == F.col("first"), "object").otherwise("vote")
        about = stage(about.withColumn("way", way), "about")
        parts = stage(_parts(rows, about), "parts")
        levels.append(_merged(about, parts))
        rows = parts.filter("way = 'object'").select(rows.columns)
    if not levels:
        return samples.select(F.col(by), F.lit("").alias(json)).limit(0)
    whole = levels.pop()
    while levels:
        field = F.struct(F.element_at("path", -1).alias("name"), F.concat(_quoted(F.element_at("path", -1)), F.lit(":"), v).alias("text"))
        objects = whole.groupBy("g", F.slice("path", 1, len(levels) - 1).alias("path")).agg(F.concat(F.lit("{"), F.array_join(F.transform(F.sort_array(F.collect_list(field)), lambda x: x["text"]), ","), F.lit("}")).alias("v"))
        whole = levels.pop().unionByName(objects)
    return whole.select(F.col("g").alias(by), v.alias(json))


def _parts(rows: DataFrame, about: DataFrame) -> DataFrame:
    """What the values of a level give to their path's result or, by fields, to the next level: votes, list items, fields, and values that stand for all. Equal parts of a path are one row: their number, their weight and their first place.

    They are counted before the shuffle, so few of the rows are moved where values repeat.
    """
    named = about.select(F.col("g").alias("_g"), F.col("path").alias("_p"), "way", "first")
    here = rows.join(named, F.col("g").eqNullSafe(F.col("_g")) & (F.col("path") == F.col("_p")))
    here = here.filter("case way when 'mean' then false when 'first' then pos = first when 'list' then startswith(v, '[') when 'object' then startswith(v, '{') else true end")
    # a value that is not taken apart is its own only part
    parts = rows.sparkSession.sql(
        """select t.g, case when t.way = 'object' then array_append(t.path, i.key) else t.path end as path, t.way, case when t.way = 'list' then i.pos else 0 end as nth, t.n, t.w, t.exact, t.pos,
            case when t.way in ('list', 'object') then to_json(i.value) when size(t.path) = 0 and substr(t.v, 1, 1) in ('{{', '[') then to_json(parse_json(t.v)) else t.v end as v
        from {t} t, lateral variant_explode(parse_json(case when t.way in ('list', 'object') then t.v else '[0]' end)) i""",
        t=here,
    )
    return parts.groupBy("g", "path", "way", "nth", "v").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.min("pos").alias("pos"), _exact_sum(F.col("exact")).alias("exact"))


def _merged(about: DataFrame, parts: DataFrame) -> DataFrame:
    """(g, path, v): the results of a level's paths, but for objects with fields."""
    at, v = ["g", "path"], F.col("v")
    mean = F.coalesce(F.try_divide(F.col("exact_weighted").cast("double") / 1e6, F.col("exact_total").cast("double")), F.try_divide("weighted", "total"))
    mean = F.when(F.col("whole"), F.bround(mean).cast("long").cast("string")).otherwise(F.bround(mean, 4).cast("string"))
    bare = F.when(F.col("way") == "mean", mean).when((F.col("way") == "list") & ~F.col("items"), "[]").when((F.col("way") == "object") & ~F.col("fields"), "{}")
    done = about.select(*at, bare.alias("v")).filter("v is not null").unionByName(parts.filter("way in ('one', 'first')").select(*at, "v"))
    votes = parts.filter("way = 'vote'").groupBy(*at, F.lower(F.trim(_text(v))).alias("text")).agg(_steady_sum().alias("w"), F.min_by("v", "pos").alias("v"), F.min("pos").alias("pos"))
    done = done.unionByName(votes.groupBy(*at).agg(F.min_by("v", F.struct(-F.col("w"), "pos")).alias("v")))
    items = parts.filter("way = 'list'").groupBy(*at, _text(v).alias("text")).agg(F.min(F.struct("pos", "nth", "v")).alias("i"))
    return done.unionByName(items.groupBy(*at).agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list("i")), lambda x: x["v"]), ","), F.lit("]")).alias("v")))
