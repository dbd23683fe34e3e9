"""Packing by power-of-two decomposition: a document's ids are cut into pieces of binary lengths, and pieces of one length form a bucket.

No sequence crosses documents and none is padded: each piece is a sequence of its own, a power of two long, at most `max_length`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftkite.llm.common import lean, row_runs, stage, text_buffer
from siftkite.llm.tokens import encoder

_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())]


def binary_lengths(n: int, max_length: int) -> list[int]:
    """n as a sum of powers of two, largest first: as often max_length as it fits, then the binary digits of the rest."""
    full, rest = divmod(n, max_length)
    return [max_length] * full + [1 << b for b in range(max_length.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", max_length: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with with_ids the ids.

    sequence_id runs from 0 without gaps, the longest bucket first, so a bucket's sequences are one range of it and a batch of equal lengths is
    a sub-range; offset is 0 as each sequence is one piece. Tasks number the pieces of a bucket as they cut them, which the staged table freezes;
    the numbers' bases come from a count for each task and bucket, so no row is shuffled. A null text is empty: its end id makes one piece
    of length 1. Null ids stay null and repeated rows are packed each. An empty table gives no rows. Other columns are not read.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    schema = pa.schema([*_FIELDS, ("ids", pa.list_(pa.int32()))] if with_ids else _FIELDS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, words, numbered = TaskContext.get().partitionId(), encoder(tokenizer), dict.fromkeys((1 << b for b in range(max_length.bit_length())), 0)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for low, high in row_runs(texts):
                ids, rows = words.encode(*text_buffer(texts.slice(low, high - low)), end_id)
                ids, rows, made = ids.astype("<u4"), rows.tolist(), []
                for i, (a, b) in enumerate(zip(rows[:-1], rows[1:], strict=True), low):
                    start = 0
                    for length in binary_lengths(b - a, max_length):
                        piece = ids[a + start : a + start + length]
                        row = (doc_ids[i], start, length, zlib.crc32(piece), b - a, part, numbered[length])
                        made.append((*row, piece.astype(np.int32)) if with_ids else row)
                        numbered[length] += 1
                        start += length
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long" + (", ids array<int>" if with_ids else "")
    pieces = stage(rows.mapInArrow(lean(cut), kinds), "pieces")
    # a row for each task and bucket: twelve times the number of tasks
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.orderBy(F.desc("length"), "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    out = pieces.join(bases, ["part", "length"]).withColumn("sequence_id", F.col("base") + F.col("nth")).withColumn("offset", F.lit(0).cast("long"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)
