"""First-fit clustering: in order, each row joins the first cluster whose seed it resembles, else it is the seed of a new one.

The seeds are the lexicographically first maximal independent set of the resemblance graph: a row is a seed if no earlier neighbour is one. `decide` finds them in rounds over
blocks of the order: a task decides the rows of a block in turn as far as their earlier neighbours are decided, in the block or in earlier rounds. A chain through a block takes one round, whatever its length. When
all seeds are known each row takes its first one by a join. No task holds a group, a file or a source.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftkite.operators.retrieval import similar_sets
from siftkite.scan import prefix_sums
from siftkite.staging import stage

#: Nodes of a block.
BLOCK = 8192


#: Stands for an input that is known to be true.
TRUE = -1


def _solve(block: pa.Table) -> pa.Table:
    """Decides the nodes of one block in order, as far as it can."""
    known: dict[int, bool] = {TRUE: True}
    for at, nor, inputs in sorted(zip(*(block.column(c).to_pylist() for c in ("at", "nor", "inputs")), strict=True)):
        values = [known.get(i) for i in inputs]
        if True in values:
            known[at] = not nor
        elif None not in values:
            known[at] = nor
    del known[TRUE]
    return pa.table({"at": pa.array(list(known), pa.int64()), "value": pa.array(list(known.values()), pa.bool_())})


def decide(nodes: DataFrame) -> DataFrame:
    """(at, value) of nodes (at long, nor boolean, inputs array<long>): with nor true if no input is true, else true if one is. Inputs are nodes of a smaller `at`.

    A round decides at least the first block that is not decided, and all that hang on no other block; let neighbours lie near each other. A node's own inputs go to one task.
    """
    still, decided = nodes, None
    while not still.isEmpty():
        solved = stage(still.groupBy(F.floor(F.col("at") / BLOCK)).applyInArrow(_solve, "at long, value boolean"), "decided")
        decided = solved if decided is None else decided.unionByName(solved)
        rest = still.join(solved.select("at"), "at", "left_anti").select("at", "nor", F.explode("inputs").alias("input"))
        now = rest.join(solved.select(F.col("at").alias("input"), "value"), "input", "left")
        now = now.groupBy("at", "nor").agg(F.collect_set(F.when(F.col("value").isNull(), F.col("input")).when(F.col("value"), TRUE)).alias("inputs"))
        still = stage(now, "open", replaces=still if still is not nodes else None)
    return nodes.select("at", F.lit(True).alias("value")) if decided is None else decided


def _words(text: Column, pattern: str | None) -> Column:
    """The distinct words of a text in order: what the pattern finds in lower case, or with None what white space parts."""
    text = F.lower(F.coalesce(text, F.lit("")))
    found = F.array_remove(F.split(text, r"\s+"), "") if pattern is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_sort(F.array_distinct(found))


#: Runs of letters, numbers and underscores of any script.
WORD = r"[\p{L}\p{N}_]+"


def greedy_clusters(df: DataFrame, group: str, key: str, text: str, threshold: float, *, pattern: str | None = WORD) -> DataFrame:
    """(group, key, seed): in key order each row joins the first seed of its group whose words' Jaccard similarity to its own passes the threshold, else becomes one.

    Rows of equal word sets are one row to the search and share its seed; rows without words resemble none. A null group is a group; keys must be distinct in a group, null keys are left out.
    """
    rows = df.filter(F.col(key).isNotNull()).select(F.col(group).alias("_group"), F.col(key).alias("_key"), _words(F.col(text), pattern).alias("w"))
    rows = stage(rows, "words")
    sets = rows.filter(F.size("w") > 0).groupBy("_group", "w").agg(F.min("_key").alias("first"))
    sets = stage(prefix_sums(sets, None, ["_group", "first"]), "sets")
    pairs = stage(similar_sets(sets.select(F.col("at").alias("id"), "w", F.col("_group").alias("by")), threshold).select(F.col("a").alias("early"), F.col("b").alias("late")), "pairs")
    inputs = pairs.groupBy(F.col("late").alias("at")).agg(F.collect_list("early").alias("inputs"))
    nodes = sets.select("at").join(inputs, "at", "left").select("at", F.lit(True).alias("nor"), F.coalesce("inputs", F.array().cast("array<long>")).alias("inputs"))
    seeds = decide(nodes).filter("value").select("at")
    joined = pairs.join(seeds, F.col("early") == F.col("at"), "left_semi").groupBy("late").agg(F.min("early").alias("seed_at"))
    of = sets.select("at", "_group", "w").join(joined, F.col("at") == F.col("late"), "left").select("_group", "w", F.coalesce("seed_at", "at").alias("seed_at"))
    of = of.join(sets.select(F.col("at").alias("seed_at"), F.col("first").alias("seed")), "seed_at").select(F.col("_group").alias("g"), F.col("w").alias("v"), "seed")
    out = rows.join(of, F.col("_group").eqNullSafe(F.col("g")) & (F.col("w") == F.col("v")), "left")
    return out.select(F.col("_group").alias(group), F.col("_key").alias(key), F.coalesce("seed", "_key").alias("seed"))


#: Lines that a vote may lie from a cluster's first one; half of it without regard to words. Words' similarity of a match. Fixed values.
TOLERANCE, NEAR, ALIKE = 5, 2, 0.6
#: Votes of one finding whose least seed so far is found together.
RUN = 4096


def vote_clusters(votes: DataFrame) -> DataFrame:
    """(file, pos, seed): in order of pos each vote joins the first cluster that has a vote of its finding, or whose first vote resembles it, else it is the first vote of a new one.

    votes: file, pos (distinct), line (negative: none), finding_id, description. Two votes resemble each other if they are in one file and at most NEAR lines apart, or at most TOLERANCE lines apart or one
    without a line, and their words' Jaccard similarity is ALIKE or more. Null files and descriptions are empty; an empty finding_id is none. seed is the pos of the cluster's first vote, of any file.

    A vote can be a first one only if it is the first of its finding. A line's first votes so far are one node of `decide`, an "or" over the line's earlier ones, so that votes that crowd
    on a line make no pairs; a file's similar word sets are found by their rare words.
    """
    v = votes.select(F.coalesce("file", F.lit("")).alias("file"), "pos", F.coalesce("line", F.lit(-1)).cast("long").alias("line"), F.nullif("finding_id", F.lit("")).alias("finding"), _words(F.col("description"), None).alias("w"))
    v = stage(v.withColumn("line", F.greatest("line", F.lit(-1).cast("long"))), "votes")
    begin = v.filter("finding is not null").groupBy("finding").agg(F.min_by(F.struct("file", "pos", "line", "w"), "pos").alias("r")).select("r.*")
    begin = begin.unionByName(v.filter("finding is null").select("file", "pos", "line", "w"))
    # at one place and with the same words the first one stands for all; without line or words a vote resembles none
    alone = (F.col("line") < 0) & (F.size("w") == 0)
    begin = begin.groupBy("file", "line", "w", F.when(alone, F.col("pos")).alias("own")).agg(F.min("pos").alias("pos")).drop("own")
    begin = stage(prefix_sums(begin, None, ["file", "pos"]), "candidates")

    # similar words within a file, as pairs of word sets, each with itself
    sets = v.filter(F.size("w") > 0).groupBy("file", "w").agg(F.min("pos").alias("p"))
    sets = stage(prefix_sums(sets, None, ["file", "p"], at="id"), "sets")
    near = similar_sets(sets.select("id", "w", F.col("file").alias("by")), ALIKE, reach=True).select(F.col("a").alias("x"), F.col("b").alias("y"))
    alike = stage(near.unionByName(near.select(F.col("y").alias("x"), F.col("x").alias("y"))).unionByName(sets.select(F.col("id").alias("x"), F.col("id").alias("y"))), "alike")

    def with_set(df: DataFrame) -> DataFrame:
        s = sets.select(F.col("file").alias("_f"), F.col("w").alias("_w"), F.col("id").alias("set"))
        return df.join(s, (F.col("file") == F.col("_f")) & (F.col("w") == F.col("_w")), "left").drop("_f", "_w")

    begin = stage(with_set(begin).select("at", "file", "line", "pos", "set", "w"), "candidates", replaces=begin)
    seeds = stage(decide(_nodes(begin, alike)).filter("value and at % 2 = 0").select(F.expr("at div 2").alias("at")).join(begin, "at"), "seeds")

    # the first seed that each kind of vote resembles: those of lines around it, and those of similar words where one has no line
    kinds = stage(with_set(v.select("file", "line", "w").distinct()), "kinds")
    lined = seeds.filter("line >= 0").select(F.col("file").alias("f"), F.explode(F.sequence(F.col("line") - TOLERANCE, F.col("line") + TOLERANCE)).alias("l"), F.col("line").alias("seed_line"), F.col("w").alias("u"), F.col("pos").alias("seed"))
    same = F.size(F.array_intersect("w", "u")) >= ALIKE * F.size(F.array_union("w", "u"))
    hits = kinds.filter("line >= 0").join(lined, (F.col("file") == F.col("f")) & (F.col("line") == F.col("l"))).filter((F.abs(F.col("line") - F.col("seed_line")) <= NEAR) | (same & (F.size("w") > 0) & (F.size("u") > 0)))
    hits = hits.select("file", "line", "w", "seed")
    firsts = seeds.filter("set is not null").groupBy(F.col("set").alias("x")).agg(F.min("pos").alias("any_seed"), F.min(F.when(F.col("line") < 0, F.col("pos"))).alias("bare_seed"))
    of_set = alike.join(firsts, "x").groupBy("y").agg(F.min("any_seed").alias("any_seed"), F.min("bare_seed").alias("bare_seed"))
    more = kinds.join(of_set, F.col("set") == F.col("y")).select("file", "line", "w", F.when(F.col("line") < 0, F.col("any_seed")).otherwise(F.col("bare_seed")).alias("seed"))
    best = hits.unionByName(more.filter("seed is not null")).groupBy("file", "line", "w").agg(F.min("seed").alias("seed"))
    b = best.select(F.col("file").alias("f"), F.col("line").alias("l"), F.col("w").alias("u"), "seed")
    v = v.join(b, (F.col("file") == F.col("f")) & (F.col("line") == F.col("l")) & (F.col("w") == F.col("u")), "left").drop("f", "l", "u")
    # a vote that came before the first seed like it joined none; with no finding before it either, it is a seed itself
    v = v.withColumn("seed", F.when(F.col("seed") <= F.col("pos"), F.col("seed")))

    nameless = v.filter("finding is null").select("file", "pos", F.coalesce("seed", "pos").alias("seed"))
    ids = stage(prefix_sums(v.filter("finding is not null").groupBy("finding").agg(F.count("*").alias("n")), None, ["finding"], at="nth").select(F.col("finding").alias("named"), "nth"), "findings")
    named = v.filter("finding is not null").join(ids, F.col("finding") == F.col("named")).select("file", "pos", "nth", "seed")
    named = prefix_sums(named, "nth", ["pos"]).withColumn("seed", F.when(F.col("at") == 0, F.coalesce("seed", "pos")).otherwise(F.col("seed")))
    named = stage(named.withColumn("run", F.floor(F.col("at") / RUN)), "named")
    before = named.groupBy("nth", "run").agg(F.min("seed").alias("least"))
    before = before.withColumn("least", F.min("least").over(Window.partitionBy("nth").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.min("seed").over(Window.partitionBy("nth", "run").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    named = named.withColumn("seed", own).join(before, ["nth", "run"]).select("file", "pos", F.least("seed", "least").alias("seed"))
    return named.unionByName(nameless)


def _nodes(begin: DataFrame, alike: DataFrame) -> DataFrame:
    """The graph of candidates: 2 at is "is a first vote", 2 at + 1 "one of its line up to here is"."""
    lines = prefix_sums(begin.filter("line >= 0").select("file", "line").distinct(), None, ["file", "line"], at="lid").select(F.col("file").alias("f"), F.col("line").alias("l"), "lid")
    asks = begin.filter("line >= 0").select("at", "file", F.explode(F.sequence(F.col("line") - NEAR, F.col("line") + NEAR)).alias("ask"), "line")
    asks = asks.join(lines, (F.col("file") == F.col("f")) & (F.col("ask") == F.col("l"))).select(F.col("at").alias("node"), "lid", (F.col("ask") == F.col("line")).cast("long").alias("own"))
    asks = stage(prefix_sums(asks, "lid", ["node"], ["own"], at="nth").select("node", "lid", "own", "before_own"), "asks")
    place = asks.filter("own = 1").select(F.col("lid").alias("of"), (F.col("before_own") + 1).alias("count"), (2 * F.col("node") + 1).alias("input"))
    found = asks.join(place, (F.col("lid") == F.col("of")) & (F.col("before_own") == F.col("count"))).select("node", "own", "input")
    edges = found.select((2 * F.col("node")).alias("at"), "input")
    edges = edges.unionByName(found.filter("own = 1").select((2 * F.col("node") + 1).alias("at"), "input"))
    edges = edges.unionByName(asks.filter("own = 1").select((2 * F.col("node") + 1).alias("at"), (2 * F.col("node")).alias("input")))
    # words: lined votes meet those of lines around them, votes without a line all of their file
    some = begin.filter("set is not null").select("at", "line", "set", "file")
    pairs = some.join(alike, F.col("set") == F.col("x")).select("at", "line", F.col("y"), "file")
    lined = pairs.filter("line >= 0").select("at", "file", "y", "line", F.explode(F.sequence(F.col("line") - TOLERANCE, F.col("line") + TOLERANCE)).alias("l"))
    far = lined.filter(F.abs(F.col("l") - F.col("line")) > NEAR).join(some.select(F.col("at").alias("o"), F.col("set").alias("y"), F.col("line").alias("l")), ["y", "l"]).filter("o < at").select("at", "o")
    bare = pairs.join(some.select(F.col("at").alias("o"), F.col("set").alias("y"), F.col("line").alias("m")), "y").filter("(line < 0 or m < 0) and o < at").select("at", "o")
    edges = edges.unionByName(far.unionByName(bare).select((2 * F.col("at")).alias("at"), (2 * F.col("o")).alias("input")))
    inputs = edges.groupBy("at").agg(F.collect_set("input").alias("inputs"))
    every = begin.select(F.explode(F.array(2 * F.col("at"), F.when(F.col("line") >= 0, 2 * F.col("at") + 1))).alias("at")).filter("at is not null")
    return every.join(inputs, "at", "left").select("at", (F.col("at") % 2 == 0).alias("nor"), F.coalesce("inputs", F.array().cast("array<long>")).alias("inputs"))


def merged_knowledge(items: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(id, type, content, source, confidence, tags, metadata, n): the items of each first-fit cluster of one type as one.

    items: id (text, unique), pos (their order, unique), type, content, source, confidence, tags (array), metadata (map). A cluster's content is its items' with blanks between, its tags are all of theirs in order of the text, its confidence is their mean, of metadata the last item's value
    counts; source is "merged_learning" and id the first 16 hex digits of the SHA-256 of `merged_` and the ids joined by `_`. An item alone stays as it is. What a cluster holds is in one row, as it is one item.
    """
    seeds = greedy_clusters(items, "type", "pos", "content", threshold).select(F.col("pos").alias("_pos"), F.col("seed").alias("_seed"))
    rows = stage(items.join(seeds, F.col("pos") == F.col("_pos")).drop("_pos"), "clustered")
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("pos", c))), lambda x: x[c])
    out = rows.groupBy("_seed").agg(F.count("*").alias("n"), F.min_by("id", "pos").alias("first"), F.min_by("type", "pos").alias("type"), F.array_join(ordered("content"), " ").alias("content"), F.min_by("source", "pos").alias("source"), F.avg("confidence").alias("confidence"), F.array_join(ordered("id"), "_").alias("ids"))
    tags = rows.select("_seed", F.explode("tags").alias("t")).groupBy("_seed").agg(F.array_sort(F.collect_set("t")).alias("tags"))
    pairs = rows.select("_seed", "pos", F.explode("metadata").alias("k", "v")).groupBy("_seed", "k").agg(F.max_by("v", "pos").alias("v"))
    metadata = pairs.groupBy("_seed").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("metadata"))
    out = out.join(tags, "_seed", "left").join(metadata, "_seed", "left")
    many = F.col("n") > 1
    name = F.when(many, F.substring(F.sha2(F.concat(F.lit("merged_"), "ids"), 256), 1, 16)).otherwise(F.col("first"))
    return out.select(name.alias("id"), "type", "content", F.when(many, "merged_learning").otherwise(F.col("source")).alias("source"), "confidence", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"), "n")
