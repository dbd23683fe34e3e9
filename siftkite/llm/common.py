"""What the operators of this subpackage share: the shared folder, staged tables, and text as numpy arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftkite.staging import drop_staged, scratch, shared_dir, stage

__all__ = ["drop_staged", "scratch", "shared_dir", "stage"]

#: Bytes that separate words: [\x20\x09-\x0D].
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

#: Text bytes that numpy code handles at once; an Arrow batch is cut into runs of rows of about this size.
CHUNK_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bits of the map that `marks_of` makes: 8 MB, the bound of what its joins broadcast.
MARK_BITS = 1 << 26
#: Bits that bitmap_construct_agg puts into one binary.
_MAP_BITS = 1 << 15


def _mark(id_col: str) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(MARK_BITS))


def marks_of(ids: DataFrame) -> DataFrame:
    """A bit map over the hashes of the longs in column doc_id, of MARK_BITS at most whatever their number, in rows of 4 KB."""
    at = ids.select(_mark("doc_id").alias("h")).select(F.shiftright("h", 15).alias("_slot"), F.col("h").bitwiseAND(F.lit(_MAP_BITS - 1)).alias("bit"))
    return at.groupBy("_slot").agg(F.bitmap_construct_agg("bit").alias("_map"))


def split_by_marks(df: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose doc_id may be one of the marked ids, rows whose doc_id surely isn't).

    So a join of wide rows with ids moves the wide rows of those ids and no others, at any number of ids by one plan: what is broadcast is the map. With n ids a share of
    n / MARK_BITS of the other rows comes along. Null ids are in the second part.
    """
    slot, bits, hit = (fresh(df, name) for name in ("_slot", "_map", "_hit"))
    h = _mark("doc_id")
    bit = h.bitwiseAND(F.lit(_MAP_BITS - 1)).cast("int")
    marks = marks.select(F.col("_slot").alias(slot), F.col("_map").alias(bits))
    marked = df.withColumn(slot, F.shiftright(h, 15)).join(F.broadcast(marks), slot, "left")
    byte = F.conv(F.hex(F.col(bits).substr(F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    of_bit = F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), bit.bitwiseAND(F.lit(7)) + 1)
    marked = marked.withColumn(hit, F.coalesce(F.col("doc_id").isNotNull() & (byte.bitwiseAND(of_bit) != 0), F.lit(False)))
    return marked.filter(F.col(hit)).select(*df.columns), marked.filter(~F.col(hit)).select(*df.columns)


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def id_crc(id_col: str) -> Column:
    """crc32 of the id as text; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def held_out(id_col: str, mod: int) -> Column:
    """True where crc32(id as text) mod `mod` is 1. A null id is not held out."""
    return F.coalesce(id_crc(id_col) % mod == 1, F.lit(False))


_KEPT: dict = {}
_LIBC: list = []


def give_back() -> None:
    """Return what Python, numpy and Arrow have freed to the system. Workers live on from task to task and from query to query, so what they hold on to adds up."""
    if not _LIBC:
        libc = ctypes.CDLL(None)
        _LIBC.append(libc if hasattr(libc, "malloc_trim") else None)
    pa.default_memory_pool().release_unused()
    if _LIBC[0]:
        _LIBC[0].malloc_trim(0)


#: Rows of an Arrow batch where the session has Spark's default of 10,000, which are 30 MB of texts, held by the JVM and by Python in more than one copy.
BATCH_ROWS, _BATCH_KEY, _BATCH_DEFAULT = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives memory back before and after a task. Sets the session's batches to BATCH_ROWS rows unless they are set otherwise."""
    spark = SparkSession.getActiveSession()
    if spark and spark.conf.get(_BATCH_KEY) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def kept(key, make):
    """What a worker process keeps from task to task: one model, that of the stage at hand; another one's memory is given back first."""
    if key not in _KEPT:
        _KEPT.clear()
        give_back()
        _KEPT[key] = make()
    return _KEPT[key]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row offsets into them, from 0. Nulls are empty."""
    if column.null_count:
        column = pa.compute.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    low, high = int(offsets[0]), int(offsets[-1])
    buf = np.frombuffer(data, np.uint8, high - low, low) if high > low else np.zeros(0, np.uint8)
    return buf, offsets - low


def row_runs(column: pa.Array, limit: int = CHUNK_BYTES):
    """(from, to) row ranges of about `limit` text bytes; one longer text is a run by itself."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0).cast(pa.int64()))
    at, total = 0, 0
    for i, size in enumerate(sizes):
        if i > at and total + size > limit:
            yield at, i
            at, total = i, 0
        total += int(size)
    if at < len(sizes):
        yield at, len(sizes)


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; a row's end also ends a word."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[0] = edge[n] = True
    before, after = edge[:n].copy(), edge[1:].copy()
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    return np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1


def distinct_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(the distinct words, the number of each word in them). Words are compared byte by byte; they must cover all bytes but white space, as `word_spans` gives them."""
    if not len(starts):
        return [], np.zeros(0, np.int32)
    flat = np.ascontiguousarray(buf[~_SPACE[buf]])
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(flat)]).dictionary_encode()
    return coded.dictionary.to_pylist(), np.asarray(coded.indices)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH3-64 of each word: equal words have equal hashes, others but by chance."""
    from xxhash import xxh3_64_intdigest

    words, which = distinct_words(buf, starts, ends)
    return np.array([xxh3_64_intdigest(w, 7) for w in words], np.uint64)[which]


def gather_runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the runs [start, start + length), run after run."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
