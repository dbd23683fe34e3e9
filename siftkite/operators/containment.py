"""Which texts contain which patterns, by each pattern's rarest q-gram.

A pattern of length n goes to the tier of the largest q <= n. The texts' q-grams are counted (a text counts once, and counts are added up in each task before the shuffle), every pattern picks the one
that the fewest texts have, and only texts that have it meet the pattern and are looked through. A bit map of the picked q-grams, of a fixed size, keeps the other q-grams of the texts from moving at all.
So the work follows the texts' length and the candidates, not texts times patterns, and no part of a pattern but its q-grams is written out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftkite.operators.retrieval import similar_sets
from siftkite.staging import stage

#: Lengths of q-grams. Short patterns are found by themselves, long ones by pieces that few texts share.
TIERS = (1, 2, 3, 6, 12)
#: Bits of the map of picked q-grams, in rows of 4 KB: 128 KB whatever the number of patterns.
MAP_BITS, _ROW_BITS = 1 << 20, 1 << 15


def grams(text: Column, q: int) -> Column:
    """The distinct q-grams of a text, of characters of any script, found in one pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1)))


def containing(texts: DataFrame, patterns: DataFrame, *, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """(by, pattern, id) of every distinct pattern that a text contains, character by character, each pair once.

    texts: id (unique), text, by; patterns: pattern, by. Only equal `by` meet; null is a value, and both may lack the column. Null texts and null patterns contain nothing and are in nothing; the empty pattern, which is in
    every text, is not joined and has no rows. `tiers` ascend from 1.
    """
    texts = texts.select("id", "text", F.col("by") if "by" in texts.columns else F.lit(0).alias("by")).filter("text is not null")
    asked = patterns.select("pattern", F.col("by") if "by" in patterns.columns else F.lit(0).alias("by")).filter("pattern <> ''").distinct()
    tier = F.lit(tiers[0])
    for q in tiers[1:]:
        tier = F.when(F.length("pattern") >= q, q).otherwise(tier)
    asked = stage(asked.withColumn("q", tier), "patterns")
    out = None
    for q in sorted(r.q for r in asked.select("q").distinct().collect()):
        found = _tier(texts, asked.filter(F.col("q") == q).select("pattern", "by"), q)
        out = found if out is None else out.unionByName(found)
    return asked.select("by", "pattern").limit(0).join(texts.select("id", F.col("by").alias("_b")), F.col("by").eqNullSafe(F.col("_b"))).select("by", "pattern", "id") if out is None else out


def _tier(texts: DataFrame, asked: DataFrame, q: int) -> DataFrame:
    of_pattern = asked.select("pattern", "by", F.explode(grams(F.col("pattern"), q)).alias("gram"))
    of_text = texts.select("id", "by", F.explode(grams(F.col("text"), q)).alias("gram"))
    wanted = of_pattern.select(F.col("by").alias("_by"), F.col("gram").alias("_gram")).distinct()
    same = F.col("by").eqNullSafe(F.col("_by")) & (F.col("gram") == F.col("_gram"))
    counts = _may_be(of_text, wanted).groupBy("by", "gram").agg(F.count("*").alias("df")).join(wanted, same, "left_semi").select(F.col("by").alias("_by"), F.col("gram").alias("_gram"), "df")
    rarest = F.row_number().over(Window.partitionBy("by", "pattern").orderBy(F.coalesce("df", F.lit(0)), "gram"))
    picked = of_pattern.join(counts, same, "left").withColumn("_n", rarest).filter("_n = 1 and df > 0").select(F.col("by").alias("_by"), F.col("gram").alias("_gram"), "pattern")
    picked = stage(picked, "picked")
    pairs = _may_be(of_text, picked).join(picked, same).select("id", "by", "pattern")
    if q <= 3:  # these may be patterns of just this length
        sure, pairs = pairs.filter(F.length("pattern") == q), pairs.filter(F.length("pattern") > q)
    whole = texts.select(F.col("id").alias("_id"), "text")
    found = pairs.join(whole, F.col("id") == F.col("_id")).filter(F.contains("text", "pattern")).select("by", "pattern", "id")
    return found.unionByName(sure.select("by", "pattern", "id")) if q <= 3 else found


def _may_be(rows: DataFrame, named: DataFrame) -> DataFrame:
    """The rows whose gram may be one of the named `_gram`s."""
    h = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
    bits = named.select(h("_gram").alias("h")).select(F.shiftright("h", 15).alias("_slot"), F.col("h").bitwiseAND(F.lit(_ROW_BITS - 1)).alias("bit"))
    bits = bits.groupBy("_slot").agg(F.bitmap_construct_agg("bit").alias("_map"))
    bit = h("gram").bitwiseAND(F.lit(_ROW_BITS - 1)).cast("int")
    byte = F.conv(F.hex(F.col("_map").substr(F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    of_bit = F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), bit.bitwiseAND(F.lit(7)) + 1)
    return rows.withColumn("_slot", F.shiftright(h("gram"), 15)).join(F.broadcast(bits), "_slot").filter(byte.bitwiseAND(of_bit) != 0).select(*rows.columns)


def knowledge_edges(knowledge: DataFrame, patterns: DataFrame, *, threshold: float = 0.5, weight: float = 0.8, pattern: str = r"[\p{L}\p{N}_]+") -> DataFrame:
    """(edge_id, source, target, relationship, weight): "related_to" in both directions between items whose words' Jaccard similarity passes the threshold, "contains_pattern" from an item to each pattern whose value it contains.

    knowledge: id, content; patterns: id, value. Ids are text and unique. Items of equal word sets are one in the search: the edges are between the least ids of the sets, and every other
    item of a set has an edge to it and from it, with weight 1. edge_id: the first 16 hex digits of the SHA-256 of `source_target_kind`. Null contents and values have no edges; an empty value is in every content and has none.
    """
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("content", F.lit(""))), F.lit(pattern), F.lit(0))))
    rows = stage(knowledge.select("id", words.alias("w")).filter(F.size("w") > 0), "words")
    sets = rows.groupBy("w").agg(F.min("id").alias("id"))
    pairs = similar_sets(sets, threshold).select("a", "b", F.col("similarity").alias("weight"))
    if threshold < 1:
        copies = rows.join(sets.select(F.col("id").alias("a"), F.col("w").alias("u")), (F.col("w") == F.col("u")) & (F.col("id") != F.col("a"))).select("a", F.col("id").alias("b"), F.lit(1.0).alias("weight"))
        pairs = pairs.unionByName(copies)
    pairs = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("target")), F.struct(F.col("b").alias("source"), F.col("a").alias("target")))).alias("e"), "weight").select("e.*", "weight")
    found = containing(knowledge.select("id", F.col("content").alias("text")), patterns.select(F.col("value").alias("pattern")))
    found = found.select("pattern", "id").join(patterns.select(F.col("id").alias("target"), "value"), F.col("pattern") == F.col("value")).select(F.col("id").alias("source"), "target", F.lit(weight).alias("weight"))
    named = lambda df, kind, short: df.select(F.substring(F.sha2(F.concat_ws("_", "source", "target", F.lit(short)), 256), 1, 16).alias("edge_id"), "source", "target", F.lit(kind).alias("relationship"), "weight")
    return named(pairs, "related_to", "related").unionByName(named(found, "contains_pattern", "contains"))
