"""Document fingerprints by winnowing, in DataFrame functions only.

A text's words are hashed, every run of K words gets a cyclic polynomial hash (the value that rolling gives), and of every W neighbouring ones the least by its top 31 bits is
kept, the rightmost of equal ones, with its position. So two texts that share a passage of K + W - 1 words share a fingerprint, and no match is shorter than K words.
The window minima come from doubling: minima over 2, 4, ... neighbours, each from two of the step before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftkite.llm.common import fresh

#: Words of a gram, and grams of a window (a power of two). Shared passages of K + W - 1 = 6 words are found; short, so that texts of a line or two have marks to compare.
K, W = 3, 4
#: Neighbouring ids form a block of 2 ** BLOCK_BITS ids, the rows that stand together in a task's window.
BLOCK_BITS = 9
#: Blocks are ordered in groups of 2 ** ORDER_BITS by three levels, so that no task orders more keys than that.
ORDER_BITS, LEVELS = 18, 3

_LOW = (1 << 32) - 1


def _rotated(x: Column, bits: int) -> Column:
    return F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits)) if bits else x


def _with_later(column: str, by: int):
    return lambda x, i: F.least(x, F.get(column, i + by))


def with_marks(df: DataFrame, text: str, out: str, *, k: int = K, w: int = W) -> DataFrame:
    """df and a column `out`: array of (hash long, at int), the winnowed grams of the whole text by position. No words give an empty array; fewer than k words are one gram.
    A null text is empty. A column `out` of df is replaced, all others stay, whatever their names.

    Each step is a column of its own, so that no step is worked out twice.
    """
    if w & (w - 1):
        raise ValueError("w must be a power of two")
    keep = [c for c in df.columns if c != out]
    h, g, at = (fresh(df, name) for name in ("_h", "_g", "_at"))
    m = "_m"
    while any(c.lower().startswith(m) for c in df.columns):
        m = "_" + m
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[\\x20\\x09-\\x0D]+"), "")
    df = df.withColumn(h, F.transform(words, lambda x: F.xxhash64(x)))

    def gram(x: Column, i: Column) -> Column:
        out = _rotated(x, k - 1)
        for j in range(1, k):
            out = out.bitwiseXOR(_rotated(F.get(h, i + j), k - 1 - j))
        return out

    n = F.size(h)
    short = F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.shiftrightunsigned(a, 63)).bitwiseXOR(x))
    grams = F.when(n >= k, F.transform(F.slice(h, 1, F.greatest(n - (k - 1), F.lit(1))), gram)).when(n > 0, F.array(short)).otherwise(F.array().cast("array<long>"))
    df = df.withColumn(g, grams)
    # 31 bits of the hash above 32 bits that fall as the position grows: the least is the least hash, rightmost of equals
    order = F.transform(g, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 33), 32) + (F.lit(_LOW) - i))
    df = df.withColumn(f"{m}0", order)
    step, size = 0, 1
    while size < w:
        last = f"{m}{step}"
        # past the end there is null, which least() passes over
        df = df.withColumn(f"{m}{step + 1}", F.transform(last, _with_later(last, size)))
        step, size = step + 1, size * 2
    least = f"{m}{step}"
    chosen = F.array_distinct(F.slice(least, 1, F.greatest(F.size(least) - (w - 1), F.lit(1))))
    df = df.withColumn(at, F.transform(chosen, lambda v: (F.lit(_LOW) - v.bitwiseAND(F.lit(_LOW))).cast("int")))
    return df.select(*keep, F.transform(at, lambda a: F.struct(F.get(g, a).alias("hash"), a.alias("at"))).alias(out))


def hashes(marks: str) -> Column:
    return F.col(marks)["hash"]


def written(marks: str) -> Column:
    """The marks as text: hex hash, colon, position; blanks between."""
    return F.array_join(F.transform(marks, lambda x: F.concat(F.lower(F.hex(x["hash"])), F.lit(":"), x["at"].cast("string"))), " ")


def likeness(a: str, b: str) -> Column:
    """Shared hashes over all hashes of two columns of marks; 1 for two empty ones."""
    both = F.size(F.array_union(hashes(a), hashes(b)))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(hashes(a), hashes(b))) / F.when(both == 0, 1).otherwise(both))


def successors(keys: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(key, next) for each of the distinct longs in column key; next is null after the largest.

    Keys are ordered within groups of neighbouring keys, and only a group's last key looks at the next group, which is found in the same way.
    """
    if not levels:
        return keys.withColumn("next", F.lead("key").over(Window.orderBy("key")))  # two keys at most: the sign
    keys = keys.withColumn("g", F.shiftright("key", ORDER_BITS))
    heads = keys.groupBy("g").agg(F.min("key").alias("head"))
    after = successors(heads.select(F.col("g").alias("key")), levels - 1).join(heads.withColumnRenamed("g", "next"), "next").select(F.col("key").alias("g"), "head")
    inner = keys.withColumn("within", F.lead("key").over(Window.partitionBy("g").orderBy("key")))
    return inner.join(after, "g", "left").select("key", F.coalesce("within", "head").alias("next"))


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: int = 4, k: int = K, w: int = W) -> DataFrame:
    """Each text's marks, those of the next document's text and those of an edited text, whose last floor(n_chars / share) code points are the next text's first ones.

    doc_id, n_chars, edited, marks, edited_marks, next_marks. Next is by ascending id; after the last comes the first. A null text is empty. Null
    ids come first; rows of one id are ordered by a hash of their text and stand in one block (ids are keys). An empty table gives no rows. Other columns are not read.

    Texts move once, to their block of ids, where most find the next one beside them; a block's first row goes to the row before it in the block before.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # null ids are a block below all others
    rows = rows.withColumn("block", F.coalesce(F.shiftright("doc_id", BLOCK_BITS), F.lit(-(1 << 62))))
    bounds = rows.agg(F.min("block")).first()
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    in_block = Window.partitionBy("block").orderBy(*order)

    heads = rows.withColumn("nth", F.row_number().over(in_block)).filter("nth = 1").select(F.col("block").alias("head"), F.col("text").alias("head_text"))
    heads = with_marks(heads, "head_text", "head_marks", k=k, w=w)
    after = successors(rows.select(F.col("block").alias("key")).distinct()).select(F.col("key").alias("of"), F.coalesce("next", F.lit(bounds[0])).alias("next"))
    heads = heads.join(after, F.col("head") == F.col("next")).select("of", "head_text", "head_marks")

    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = with_marks(rows.repartition(count, "block"), "text", "marks", k=k, w=w)
    placed = placed.select("doc_id", "block", "text", "marks", F.lead("text").over(in_block).alias("beside"), F.lead("marks").over(in_block).alias("beside_marks"))
    out = placed.join(heads, (F.col("block") == F.col("of")) & F.col("beside").isNull(), "left")
    out = out.withColumn("next_text", F.coalesce("beside", "head_text")).withColumn("next_marks", F.coalesce("beside_marks", "head_marks")).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / share).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut))
    out = out.select("doc_id", "n_chars", "marks", "next_marks", edited.alias("edited"))
    return with_marks(out, "edited", "edited_marks", k=k, w=w)
