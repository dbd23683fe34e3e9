"""Three-way merge of two branches of a table of documents.

A document is a set of units: the row itself, its columns, its lines, and the gap after each line, where a line may be inserted. A unit's state is "-" (absent) or "+" and its value. The base
states every unit, a branch only those that it changes. States of one unit and branch are joined by taking the greater, so the fold is associative, commutative and idempotent
(a semilattice): it doesn't matter in which order or how often states arrive. The fold by key is a DataFrame aggregate with one buffer for each of base, left and
right; its result, a version triple, is finalised to the merged state and its count.

Then ordered fragments are combined as a tree: units to blocks of BLOCK slots, blocks to the document. One exchange by document serves all levels: the text is
shuffled once. A document comes from one row and ends in one row; nothing larger than a document meets in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE, LEFT, RIGHT = 0, 1, 2
#: Slots of a document's units in order. Line k has slot 2k and the gap after it 2k + 1.
ROW, LANG, SOURCE = -3, -2, -1
#: Slots that one fragment of the first level holds.
BLOCK = 512
STATES = "doc_id long, slot long, branch int, state string"
ABSENT = "-"


def present(value: Column) -> Column:
    return F.concat(F.lit("+"), value)


def added_row(text: Column, lang: Column, source: Column) -> Column:
    """The state of a row that a branch adds: all its values, so that equal rows have equal states."""
    return present(F.to_json(F.struct(text.alias("text"), lang.alias("lang"), source.alias("source"))))


def state(slot: Column, branch: int, value: Column) -> Column:
    return F.struct(slot.cast("long").alias("slot"), F.lit(branch).alias("branch"), value.alias("state"))


def keyed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, text, lang and source with one row for each id; nulls are empty. Rows that repeat an id are one document: the greatest by text, lang and source.

    Repeated ids cost a shuffle of the texts, with rows of a hot id joined before it; where no id is repeated (known from a count of the ids alone) there is none.
    """
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *filled)
    if rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return rows
    return rows.groupBy("doc_id").agg(F.max(F.struct("text", "lang", "source")).alias("r")).select("doc_id", "r.*")


def base_states(keyed_docs: DataFrame) -> DataFrame:
    """STATES of the base: its rows, columns and lines."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, k: state(2 * k, BASE, present(x)))
    own = F.array(state(F.lit(ROW), BASE, F.lit("+")), state(F.lit(LANG), BASE, present(F.col("lang"))), state(F.lit(SOURCE), BASE, present(F.col("source"))))
    return keyed_docs.select("doc_id", F.inline(F.concat(own, lines)))


def fold(states: DataFrame) -> DataFrame:
    """doc_id, block, slot and the version triple base, left, right of every unit; null: no state was given."""
    dealt = states.withColumn("block", F.floor(F.col("slot") / BLOCK)).repartition("doc_id")
    of = lambda branch, name: F.max(F.when(F.col("branch") == branch, F.col("state"))).alias(name)
    return dealt.groupBy("doc_id", "block", "slot").agg(of(BASE, "base"), of(LEFT, "left"), of(RIGHT, "right"))


def finalise(triples: DataFrame) -> DataFrame:
    """The triples with `merged` and `verdict`.

    Branches without a state have the base's. One-sided and equal changes are "clean"; others are conflicts that keep the base's state: "insert_insert" where the base has no state,
    "edit_delete" where one branch has none, else "edit_edit". No change: null. left_changed and right_changed say which branch differs from the base.
    """
    base = F.coalesce("base", F.lit(ABSENT))
    full = triples.select("doc_id", "block", "slot", base.alias("base"), F.coalesce(F.col("left"), base).alias("left"), F.coalesce(F.col("right"), base).alias("right"))
    full = full.withColumns({"left_changed": F.col("left") != F.col("base"), "right_changed": F.col("right") != F.col("base")})
    apart = F.col("left_changed") & F.col("right_changed") & (F.col("left") != F.col("right"))
    kind = F.when(F.col("base") == ABSENT, "insert_insert").when((F.col("left") == ABSENT) | (F.col("right") == ABSENT), "edit_delete").otherwise("edit_edit")
    verdict = F.when(apart, kind).when(F.col("left_changed") | F.col("right_changed"), "clean")
    merged = F.when(apart, F.col("base")).when(F.col("left_changed"), F.col("left")).otherwise(F.col("right"))
    return full.withColumns({"merged": merged, "verdict": verdict})


KINDS = ("clean", "edit_edit", "edit_delete", "insert_insert")


def _value(of: Column) -> Column:
    """The value of a state, null for an absent unit."""
    return F.when(of != ABSENT, of.substr(F.lit(2), F.length(of)))


def _joined(pieces: Column) -> Column:
    """The pieces that are there with line ends between, null if there is none (which is not one empty piece)."""
    return F.when(F.exists(pieces, lambda x: x.isNotNull()), F.array_join(pieces, "\n"))


def combine(units: DataFrame) -> DataFrame:
    """One row for each id of finalised units: its columns, texts and counts, merged and of the base, from blocks that are combined in order."""
    line, inner = F.col("slot") >= 0, F.col("slot") != ROW
    at = lambda slot, column: F.max(F.when(F.col("slot") == slot, F.col(column)))
    sums = [F.sum(F.when(inner & (F.col("verdict") == k), 1).otherwise(0)).alias(k) for k in KINDS]
    heads = [at(s, c).alias(f"{n}_{c}") for s, n in ((ROW, "row"), (LANG, "lang"), (SOURCE, "source")) for c in ("base", "merged")] + [at(ROW, c).alias(f"row_{c}") for c in ("left", "right", "verdict")]
    changed = [F.max(inner & F.col(f"{s}_changed")).alias(f"{s}_changed") for s in ("left", "right")]
    piece = F.when(line, F.struct("slot", _value(F.col("merged")).alias("merged"), _value(F.col("base")).alias("base")))
    blocks = units.groupBy("doc_id", "block").agg(*sums, *heads, *changed, F.sort_array(F.collect_list(piece)).alias("lines"))
    blocks = blocks.withColumns({c: _joined(F.col("lines")[c]) for c in ("merged", "base")}).drop("lines")

    heads = [F.max(c).alias(c) for c in blocks.columns if c.startswith(("row_", "lang_", "source_")) or c.endswith("_changed")]
    docs = blocks.groupBy("doc_id").agg(*[F.sum(k).alias(k) for k in KINDS], *heads, F.sort_array(F.collect_list(F.struct("block", "merged", "base"))).alias("blocks"))
    return docs.withColumns({c: F.coalesce(_joined(F.col("blocks")[c]), F.lit("")) for c in ("merged", "base")}).drop("blocks")


def merge_states(states: DataFrame) -> DataFrame:
    """doc_id, lang, source, text, n_clean, n_edit_edit, n_edit_delete and n_insert_insert of every id that the base or a branch has ever had; a row that is absent after the merge has nulls.

    `states` (STATES) hold all units of the base, as `base_states` gives them, and the changes of the branches. A row that one branch drops counts alone: an edit-delete conflict
    that keeps the whole row of the base if the other branch keeps the row and changes a unit of it, else clean. Changes that equal the base's state are none. A row that the
    base lacks is added whole (`added_row`); states of other units of an id without a row are not counted. An addition to an id that the base has is no change. States may be repeated and come in any order.
    Null ids are one document. An empty table gives no rows.
    """
    docs = combine(finalise(fold(states)))
    has, lost = F.col("row_base") != ABSENT, lambda side: F.col(f"row_{side}") == ABSENT
    gone = lost("left") | lost("right")
    both = lost("left") & lost("right")
    clash = gone & ~both & F.when(lost("left"), F.col("right_changed")).otherwise(F.col("left_changed"))
    added = F.from_json(F.substr("row_merged", F.lit(2)), "text string, lang string, source string")

    count = lambda k: F.when(has & ~gone, F.col(k)).when(has, (clash if k == "edit_delete" else ~clash if k == "clean" else F.lit(False)).cast("long")).otherwise((F.coalesce("row_verdict", F.lit("")) == k).cast("long"))
    docs = docs.filter(F.col("row_base").isNotNull()).withColumn("added", F.when(~has & (F.col("row_merged") != ABSENT), added))
    value = lambda kept, old, name: F.when(has & ~gone, kept).when(has & clash, old).when(~has, F.col(f"added.{name}")).alias(name)
    return docs.select(
        "doc_id",
        value(_value(F.col("lang_merged")), _value(F.col("lang_base")), "lang"),
        value(_value(F.col("source_merged")), _value(F.col("source_base")), "source"),
        value(F.col("merged"), F.col("base"), "text"),
        *[count(k).cast("long").alias(f"n_{k}") for k in KINDS],
    )


# The edits of op13.


def _code(branch: str, name: Column) -> Column:
    key = F.concat(F.lit(f"{branch}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), name)
    return F.crc32(key.cast("binary")) % 11


def edited_states(keyed_docs: DataFrame) -> DataFrame:
    """STATES of the documents and of two branches that edit them by a rule: the code of a unit, crc32(`branch:doc_id:name`) modulo 11, says what a branch does with it.

    0 drops a row or line and empties a column; 1 appends `!` to a line or column, 2 `?`; 3 inserts line `!` after a line, 4 `?`; at a row 3 adds row -1 - doc_id (right branch: -2 - doc_id) with text `!`, 4 with `?`. A row without an id adds none.
    """
    branches = ((LEFT, "L", -1), (RIGHT, "R", -2))

    def edits(slot: Column, branch: int, code: Column, value: Column, emptied: str) -> Column:
        made = F.when(code == 0, emptied).when(code == 1, F.concat(present(value), F.lit("!"))).when(code == 2, F.concat(present(value), F.lit("?")))
        return state(slot, branch, made)

    def stated(rows: DataFrame, units: list[Column]) -> DataFrame:
        return rows.select("doc_id", F.inline(F.array(*units))).filter("state is not null")

    lines = keyed_docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "line"))
    lines = lines.withColumns({name: _code(name, F.col("k").cast("string")) for _, name, _ in branches})
    units = [state(2 * F.col("k"), BASE, present(F.col("line")))]
    for branch, name, _ in branches:
        units.append(edits(2 * F.col("k"), branch, F.col(name), F.col("line"), ABSENT))
        units.append(state(2 * F.col("k") + 1, branch, F.when(F.col(name) == 3, "+!").when(F.col(name) == 4, "+?")))
    out = stated(lines, units)

    rows = keyed_docs.select("doc_id", "lang", "source", *[_code(name, F.lit(c)).alias(f"{name}_{c}") for _, name, _ in branches for c in ("row", "lang", "source")])
    units = [state(F.lit(ROW), BASE, F.lit("+"))] + [state(F.lit(slot), BASE, present(F.col(c))) for slot, c in ((LANG, "lang"), (SOURCE, "source"))]
    for branch, name, _ in branches:
        units.append(state(F.lit(ROW), branch, F.when(F.col(f"{name}_row") == 0, ABSENT)))
        units += [edits(F.lit(slot), branch, F.col(f"{name}_{c}"), F.col(c), "+") for slot, c in ((LANG, "lang"), (SOURCE, "source"))]
    out = out.unionByName(stated(rows, units))

    for branch, name, shift in branches:
        code = F.col(f"{name}_row")
        more = rows.filter(code.isin(3, 4) & F.col("doc_id").isNotNull())
        added = added_row(F.when(code == 3, "!").otherwise("?"), F.col("lang"), F.col("source"))
        out = out.unionByName(more.select((shift - F.col("doc_id")).alias("doc_id"), F.lit(ROW).cast("long").alias("slot"), F.lit(branch).alias("branch"), added.alias("state")))
    return out


def merge_edited(docs: DataFrame) -> DataFrame:
    """`merge_states` of the documents and the two branches that `edited_states` makes of them. Columns besides doc_id, text, lang and source are not read."""
    return merge_states(edited_states(keyed(docs)))
