"""Prefix trie of conversations by preorder intervals.

Distinct conversations are ranked lexicographically, and with them the trie's nodes: a node first occurs in the least ranked conversation that has its prefix, so (that rank, depth) sorts the
nodes in preorder. The conversations under a node are an interval of ranks, its subtree an interval of positions; the subtree's end is stored with the node. Leaves and savings of a
subtree are differences of prefix sums at both ends of its interval.

- A turn is known by its MD5, a prefix by the sums of two hashes of (place, turn) over its turns, modulo 2^64 each. Prefixes of all conversations come from one sort by (conversation, place).
- Ranks come from blocks of BLOCK turns that are ranked as wholes and named by their rank, then blocks of names, until a conversation is one block.
- No task holds a conversation, a node's members or its children: ranks and sums are those of `prefix_sums`, the rest are aggregates with partial ones before each shuffle and joins of narrow rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftkite.llm.common import lean, stage
from siftkite.scan import prefix_sums

#: Turns, or names of blocks of them, that are compared as one string.
BLOCK = 64
#: Ids that one piece of a list of members holds at most, if ids are dense.
PIECE = 4096


def ordered_turns(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, at (place from 0), key and size (UTF-8 bytes of the text) of every turn. Null roles and texts are empty, a null turn comes first, ties go by the key; rows without a conversation are left out.

    key: MD5 of the role's length in bytes, the role and the text.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = turns.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("size"))
    return prefix_sums(rows, "conv_id", ["turn", "key"]).select("conv_id", "at", "key", "size")


def shared_heads(turns: DataFrame, head: Column, donor: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(conv_id, at, key, size of every conversation rebuilt, all conv_ids). A conversation begins with the first `head` turns of conversation `donor`, then has its own after its first `head`.

    Both are columns of conv_id; head is `most` at most, so of each conversation only that many turns are gathered.
    """
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("at") < most, F.struct("at", "key", "size")))).alias("firsts"))
    asked = convs.select("conv_id", donor.alias("donor"), head.alias("head")).join(convs.select(F.col("conv_id").alias("d"), "firsts"), F.col("donor") == F.col("d"), "left")
    asked = asked.select("conv_id", "head", F.slice(F.coalesce("firsts", F.array()), F.lit(1), F.col("head")).alias("taken"))
    asked = stage(asked, "heads")
    own = turns.withColumn("head", head).filter("at >= head").join(asked.select("conv_id", F.size("taken").alias("before")), "conv_id")
    own = own.select("conv_id", (F.col("at") - F.col("head") + F.col("before")).alias("at"), "key", "size")
    return asked.select("conv_id", F.inline("taken")).unionByName(own), asked.select("conv_id")


def _ranked(turns: DataFrame, whole: DataFrame) -> DataFrame:
    """conv_id and rank, from 0, of the conversations of `whole` (conv_id, depth), in the lexicographic order of their turns' keys; `turns` has the turns of these."""
    units = turns.select("conv_id", "at", F.col("key").alias("name"))
    longest = whole.agg(F.max("depth")).first()[0] or 0
    while True:
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]), "")
        units = units.withColumn("block", F.floor(F.col("at") / BLOCK)).groupBy("conv_id", "block").agg(joined.alias("name"))
        if longest <= BLOCK:
            break
        longest = -(-longest // BLOCK)
        units = stage(units, "blocks")
        names = prefix_sums(units.select("name").distinct(), None, ["name"], at="nth").select(F.col("name").alias("block_name"), F.lpad(F.hex("nth"), 16, "0").alias("short"))
        units = units.join(names, F.col("name") == F.col("block_name")).select("conv_id", F.col("block").alias("at"), F.col("short").alias("name"))
    keys = whole.select("conv_id").join(units.select("conv_id", "name"), "conv_id", "left").select("conv_id", F.coalesce("name", F.lit("")).alias("name"))
    return prefix_sums(keys, None, ["name"], at="rank").select("conv_id", "rank")


def _ends(members: DataFrame) -> DataFrame:
    """depth, p, q and ends_sha256 of (conv_id, depth, p, q): of each group the SHA-256 of its ids in ascending order, joined by commas.

    Pieces of a range of ids are joined first; a task then feeds a group's pieces to the hash one by one.
    """
    group = ["depth", "p", "q"]
    pieces = members.groupBy(*group, F.floor(F.col("conv_id") / PIECE).alias("range")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    pieces = pieces.repartition(*group).sortWithinPartitions(*group, "range")
    schema = pa.schema([*[(c, pa.int64()) for c in group], ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, running = None, None
        for batch in batches:
            out = []
            for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key == last:
                    running.update(b"," + ids.encode())
                    continue
                if last is not None:
                    out.append((*last, running.hexdigest()))
                last, running = key, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if last is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*last, running.hexdigest()), strict=True))], schema)

    return pieces.select(*group, "range", "ids").mapInArrow(lean(run), "depth long, p long, q long, ends_sha256 string")


NOTHING = hashlib.sha256(b"").hexdigest()


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node of the trie of conversations: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and first_at and last_at, the subtree's interval in preorder.

    `turns` (conv_id, at, key, size) has each conversation's turns at places 0, 1 ..., `convs` (conv_id) all conversations, those without a turn as well; conv_ids are distinct there.
    Every first d turns of a conversation are a node of depth d, the root being that of no turn. saved_tokens adds up (n_convs - 1) times the size of a node's last turn over its subtree; ends_sha256 is that
    of the conversations that end at the node. Without conversations there are no rows.
    """
    turns = turns.withColumns({"p": F.xxhash64(F.lit(1), "at", "key"), "q": F.xxhash64(F.lit(2), "key", "at")})
    turns = prefix_sums(turns.withColumnRenamed("at", "place"), "conv_id", ["place"], ["p", "q"])
    # a prefix's id is the sum up to its turn, modulo 2^64; the sum before it is its parent's
    whole_sum = lambda c: F.expr(f"pmod(cast(before_{c} as decimal(38, 0)) + {c} + 9223372036854775808BD, 18446744073709551616BD) - 9223372036854775808BD").cast("long")
    turns = turns.select("conv_id", "at", "key", "size", (F.col("at") + 1).alias("depth"), F.col("before_p").alias("up_p"), F.col("before_q").alias("up_q"), whole_sum("p").alias("p"), whole_sum("q").alias("q"))
    turns = stage(turns, "prefixes")

    whole = turns.groupBy("conv_id").agg(F.max(F.struct("depth", "p", "q")).alias("w"))
    zero = F.lit(0).cast("long")
    whole = stage(convs.join(whole, "conv_id", "left").select("conv_id", *[F.coalesce(f"w.{c}", zero).alias(c) for c in ("depth", "p", "q")]), "wholes")
    kinds = whole.groupBy("depth", "p", "q").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    kinds = stage(kinds, "kinds")
    own = turns.join(kinds.select("conv_id"), "conv_id", "left_semi")
    ranks = _ranked(own, kinds.select("conv_id", "depth"))
    kinds = stage(kinds.join(ranks, "conv_id").select("conv_id", "rank", "n", F.col("depth").alias("length")), "ranks")

    up = ["up_depth", "up_p", "up_q"]
    rows = turns.withColumn("up_depth", F.col("depth") - 1).join(kinds, "conv_id").select("depth", "p", "q", *up, "size", "conv_id", "rank", "n", "length")
    # the root is every conversation's: one row for each, made where they are
    none = F.lit(None).cast("long")
    rows = rows.unionByName(kinds.select(zero.alias("depth"), zero.alias("p"), zero.alias("q"), *[none.alias(c) for c in up], zero.alias("size"), "conv_id", "rank", "n", "length"))
    nodes = rows.groupBy("depth", "p", "q").agg(
        F.min("rank").alias("first"), F.max("rank").alias("last"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("length").alias("deepest"), *[F.max(c).alias(c) for c in (*up, "size")]
    )
    nodes = nodes.withColumns({"saved": (F.col("n_convs") - 1) * F.col("size"), "leaf": (F.col("deepest") == F.col("depth")).cast("long")}).drop("deepest", "size")
    nodes = prefix_sums(nodes, None, ["first", "depth"], ["saved", "leaf"])

    # where the nodes of each rank begin, and after them where all end
    marks = ("at", "before_saved", "before_leaf")
    begins = nodes.groupBy("first").agg(F.min(F.struct(*marks)).alias("b")).select(F.col("first").alias("stop"), *[F.col(f"b.{m}").alias(f"to_{m}") for m in marks])
    finish = nodes.agg((F.max("last") + 1).alias("stop"), F.count("*").alias("to_at"), F.sum("saved").alias("to_before_saved"), F.sum("leaf").alias("to_before_leaf")).filter("stop is not null")
    nodes = nodes.join(begins.unionByName(finish), F.col("last") + 1 == F.col("stop"))

    def known(side: str, of: list[str]) -> Column:
        return (F.col(of[0]) == F.col(f"{side}_depth")) & (F.col(of[1]) == F.col(f"{side}_p")) & (F.col(of[2]) == F.col(f"{side}_q"))

    def named(df: DataFrame, side: str, of: list[str], *kept: Column) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{side}_{name}") for c, name in zip(of, id_of, strict=True)], *kept)

    id_of = ["depth", "p", "q"]
    children = named(nodes.filter("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children")), "c", up, F.col("n_children"))
    parents = named(nodes, "u", id_of, F.col("conv_id").alias("parent_conv_id"))
    ends = named(_ends(whole), "e", id_of, F.col("ends_sha256"))
    out = nodes.join(children, known("c", id_of), "left").join(ends, known("e", id_of), "left").join(parents, known("u", up), "left")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", zero).alias("n_children"),
        (F.col("to_before_leaf") - F.col("before_leaf")).alias("n_leaves"),
        (F.col("to_before_saved") - F.col("before_saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
        F.col("at").alias("first_at"),
        (F.col("to_at") - 1).alias("last_at"),
    )


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """`prefix_trie` of the conversations, each rebuilt: conversation c begins with the first h turns of conversation c - c % 5 (all if it has fewer, none if there is no such), then has its own after its first h.

    h is crc32 of c in decimals, modulo 9. Rows without a conv_id belong to no conversation. Other columns are not read.
    """
    turns = ordered_turns(conversations)
    c = F.col("conv_id")
    return prefix_trie(*shared_heads(turns, (F.crc32(c.cast("string").cast("binary")) % 9).cast("int"), c - c % 5, 8))
