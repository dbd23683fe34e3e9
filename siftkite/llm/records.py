"""Token ids as length-delimited binary records with masked checksums and a separate offset index.

A shard file is a sequence of frames; all numbers are little-endian:

    uint64 length | uint32 masked crc32 of the length's 8 bytes | payload | uint32 masked crc32 of the payload

A payload holds one document: int64 doc_id, uint8 flags (1: doc_id is null), uint8 bytes per id (2 or 4), then its ids.
The index file beside a shard starts with the 8 bytes SKINDEX1 and has two uint64 for each record: the frame's offset and the
number of ids. A reader seeks to any record by it, so shuffled reads touch only the frames they ask for.

Shards are written by tasks through pyarrow's file systems (file, hdfs, s3, gs). Each attempt of a task writes files of its own name; the
manifest, a table that Spark commits, names those of the attempt that succeeded, so lost executors and second attempts leave no trace in it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftkite.llm.common import lean, row_runs, scratch, stage, text_buffer
from siftkite.llm.tokens import encoder

MAGIC = b"SKINDEX1"
_FRAME = struct.Struct("<QI")
_HEAD = struct.Struct("<qBB")
#: Records that one task of a reader takes at a time.
SLICE = 4096
_MANIFEST = "shard int, path string, n_records long, n_tokens long, n_bytes long"


def masked_crc(data) -> int:
    """CRC-32, rotated right by 15 bits plus a constant, so that a checksum stored within checked data doesn't upset it."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The payload of the frame at `at` and where the next one starts. ValueError on a checksum or length that doesn't fit."""
    if len(data) < at + 12:
        raise ValueError("a record's header is cut off")
    length, crc = _FRAME.unpack_from(data, at)
    if masked_crc(data[at : at + 8]) != crc:
        raise ValueError("a record's length doesn't fit its checksum")
    end = at + 12 + length
    if len(data) < end + 4:
        raise ValueError("a record is cut off")
    payload = data[at + 12 : end]
    if masked_crc(payload) != struct.unpack_from("<I", data, end)[0]:
        raise ValueError("a record doesn't fit its checksum")
    return payload, end + 4


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    return _HEAD.pack(doc_id or 0, doc_id is None, ids.dtype.itemsize) + ids.tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, width = _HEAD.unpack_from(payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=_HEAD.size)


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _writer(folder: str, tokenizer: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, words = TaskContext.get().partitionId(), encoder(tokenizer)
        dtype = words.dtype if end_id < 1 << (8 * words.dtype.itemsize) else np.dtype("<u4")
        store, base = open_fs(folder)
        name = f"{base}/part-{shard:06d}-{uuid.uuid4().hex}"
        out, index, at, tokens = None, [], 0, 0
        try:
            for batch in batches:
                doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
                for low, high in row_runs(texts):
                    ids, rows = words.encode(*text_buffer(texts.slice(low, high - low)), end_id)
                    ids, rows = ids.astype(dtype), rows.tolist()
                    for i, (a, b) in enumerate(zip(rows[:-1], rows[1:], strict=True), low):
                        if out is None:
                            store.create_dir(base, recursive=True)
                            out = store.open_output_stream(name + ".rec", buffer_size=1 << 20)
                        made = frame(pack(doc_ids[i], ids[a:b]))
                        out.write(made)
                        index.append((at, b - a))
                        at += len(made)
                        tokens += b - a
        finally:
            if out is not None:
                out.close()
        if index:
            with store.open_output_stream(name + ".idx") as f:
                f.write(MAGIC + np.array(index, "<u8").tobytes())
            done = {"shard": [shard], "path": [f"{folder}/{name.rpartition('/')[2]}"], "n_records": [len(index)], "n_tokens": [tokens], "n_bytes": [at]}
            yield pa.RecordBatch.from_pydict(done, pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_records", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    return write


def write_records(docs: DataFrame, folder: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, shards: int | None = None) -> DataFrame:
    """Encode whole texts and write them as records under `folder` (a URI) in ascending id order; returns the manifest, a row for each shard.

    Null texts are empty and give the end id alone; a null id comes first and reads back as null; rows that repeat an id all stay, one
    record each, and may span shards. An empty table writes nothing. Columns besides the two are not read. Ranges of ids come from a sample
    of the ids; within a shard rows stream through Arrow batches, so memory is bounded by a batch and the longest text.
    """
    spark = docs.sparkSession
    count = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("nth"))
    ordered = rows.repartitionByRange(count, "doc_id", "nth").sortWithinPartitions("doc_id", "nth").drop("nth")
    return stage(ordered.mapInArrow(lean(_writer(folder, tokenizer, end_id)), _MANIFEST), "manifest")


def _index(store, name: str) -> np.ndarray:
    with store.open_input_stream(f"{name}.idx") as f:
        data = f.read()
    if data[:8] != MAGIC:
        raise ValueError(f"{name}.idx is not an index")
    return np.frombuffer(data, "<u8", offset=8).reshape(-1, 2).astype(np.int64)


def read_shard(path: str, first: int = 0, count: int | None = None) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """(ids before it in the shard, doc_id, ids) of `count` records from number `first` on."""
    store, name = open_fs(path)
    index = _index(store, name)
    before = np.cumsum(index[:, 1]) - index[:, 1]
    last = len(index) if count is None else min(len(index), first + count)
    with store.open_input_file(f"{name}.rec") as f:
        size = f.size()
        for i in range(first, last):
            at, end = int(index[i, 0]), int(index[i + 1, 0]) if i + 1 < len(index) else size
            f.seek(at)
            doc_id, ids = unpack(unframe(f.read(end - at))[0])
            if len(ids) != index[i, 1]:
                raise ValueError(f"{name}: record {i} doesn't fit its index")
            yield int(before[i]), doc_id, ids


def read_records(manifest: DataFrame, slice_records: int = SLICE, with_ids: bool = False) -> DataFrame:
    """One row for each record of the manifest's shards, read through the offset index in slices that tasks share out.

    doc_id, start (ids in all records before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), and with
    with_ids the ids. A frame that doesn't fit its checksums fails the read.
    """
    # a row for each shard, so this window holds one row for each partition of the write
    starts = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    slices = starts.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_records") - 1, F.lit(0)), F.lit(slice_records).cast("long"))))
    slices = slices.select("path", "base", "first").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema([*fields, ("ids", pa.list_(pa.int64()))] if with_ids else fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                rows = []
                for before, doc_id, ids in read_shard(x["path"], x["first"], slice_records):
                    row = (doc_id, x["base"] + before, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    rows.append((*row, ids.tolist()) if with_ids else row)
                    if len(rows) == 1024:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    made = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return slices.mapInArrow(lean(read), made)


def write_and_read(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The round trip: write all documents to a new folder under the shared one, then read every record back."""
    folder = scratch(docs.sparkSession, "records")
    return read_records(write_records(docs, folder, tokenizer))


