"""Proportional stratified interleaving: every shard is a cut through all sources at the mixture's own rates.

Rows are shuffled by a seeded hash within their source and ranked; a row's fractional rank is (rank + 1/2) / rows of the source. All rows sorted by
it run through every source at an even pace, so equal cuts of that order hold each source in proportion. Both ranks are global,
yet no window holds a whole source: rows are counted by hash prefix (then by range of the fractional rank), the counts' running sums give each
bucket's base, and only a bucket's few thousand rows are numbered together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftkite.llm.common import stage

#: Rows that a bucket holds on average; the number of buckets follows the table.
BUCKET_ROWS = 4096


def stratified_shards(docs: DataFrame, *, shards: int = 16, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; shard counts differ by one at most, slots have no gaps from 0.

    size: the text's UTF-8 bytes (null: none) plus 1; text_crc32 of a null text is that of no bytes. A null stratum is a stratum of its own. Null ids are
    hashed like any other, rows that repeat an id are told apart by size and checksum, and wholly equal rows may swap places with no difference
    in the result. An empty table gives no rows. Other columns are not read.
    """
    data = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    rows = stage(rows.withColumn("shuffled", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")), "rows")
    total = rows.count()
    bits = max(1, (total // BUCKET_ROWS).bit_length())
    order = ["shuffled", "doc_id", "text_crc32", "size"]

    rows = rows.withColumn("prefix", F.shiftrightunsigned("shuffled", 64 - bits))
    counts = rows.groupBy("stratum", "prefix").agg(F.count("*").alias("n"))
    in_stratum = Window.partitionBy("stratum").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("stratum")
    counts = counts.select(F.col("stratum").alias("s"), F.col("prefix").alias("p"), F.coalesce(F.sum("n").over(in_stratum), F.lit(0)).alias("base"), F.sum("n").over(whole).alias("of"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("stratum", "prefix").orderBy(*order)) - 1)
    rows = rows.join(counts, F.col("stratum").eqNullSafe(F.col("s")) & (F.col("prefix") == F.col("p")))
    rows = rows.withColumn("pace", (2 * (F.col("base") + F.col("nth")) + 1) / (2 * F.col("of"))).drop("s", "p", "base", "of", "nth", "prefix")

    rows = stage(rows.withColumn("range", F.floor(F.col("pace") * (1 << bits))), "paces")
    ranges = rows.groupBy("range").agg(F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    ranges = ranges.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("range").orderBy("pace", "stratum", *order)) - 1).join(ranges, "range")
    rows = rows.withColumn("at", F.col("base") + F.col("nth")).withColumn("shard", F.expr(f"int(at * {shards} div {max(total, 1)})"))
    # shard k starts at ceil(k * total / shards)
    rows = rows.withColumn("slot", F.expr(f"at - (shard * {total}L + {shards - 1}) div {shards}"))
    return rows.select("doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, placed: DataFrame, folder: str, *, id_col: str = "doc_id") -> None:
    """Write all columns of docs, whose ids must be unique, as Parquet in one folder for each shard, in slot order within files."""
    out = docs.join(placed.select(F.col("doc_id").alias(id_col), F.col("shard").alias("_shard"), F.col("slot").alias("_slot")), id_col)
    out.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(folder)
