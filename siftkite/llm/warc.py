"""WARC archives in Zstandard with a dictionary: a writer, and a reader that decodes one frame for each record.

An archive (.warc.zst) starts with a skippable frame, magic 0x184D2A5D, that holds the dictionary, itself a Zstandard frame or as it is. Each record follows in a frame
of its own, with its content size and checksum. So a record is decoded by the dictionary and its own bytes alone, and an archive is read in slices.

A record's block is an HTTP response: its header lines, an empty line and the payload. A revisit has the header lines and no payload; its HTTP Content-Length and
WARC-Payload-Digest are those of the payload that the response it refers to holds.

Archives are written by tasks through pyarrow's file systems under names of their own for each attempt. The manifest, a table that Spark commits, names those of the attempts
that succeeded, with a row for each slice of about SLICE_BYTES; so lost executors and second attempts leave no trace in it, and a large archive is read by many tasks.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftkite.llm.common import fresh, lean, marks_of, scratch, split_by_marks, stage
from siftkite.llm.records import open_fs

#: Of the leading frame that holds the dictionary, and of any skippable frame but its last four bits (fixed values of the format).
DICTIONARY_MAGIC, SKIPPABLE_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
#: Payloads of fewer bytes are always written whole.
LEAST_REVISIT = 100
#: Compressed bytes of a slice, which one task reads at a time; a longer record is a slice by itself.
SLICE_BYTES = 16 << 20
#: Rows, and bytes of each, that the dictionary is made from. It changes the archives' size and no result.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 8192, 32 << 10
_MANIFEST = "path string, first long, last long, n_records long"
_DATE = "2024-01-01T00:00:00Z"
_REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


def make_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of the samples: trained where there is enough to train on, else their own bytes. b"" without samples."""
    samples = [s[:SAMPLE_BYTES] for s in samples if s]
    if len(samples) >= 32:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except zstandard.ZstdError:  # too alike or too short to train on
            pass
    raw = b"".join(samples)[:DICTIONARY_BYTES]
    return raw if len(raw) >= 8 and raw[:4] != struct.pack("<I", 0xEC30A437) else b""


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def dictionary_frame(raw: bytes) -> bytes:
    """The leading skippable frame."""
    held = zstandard.ZstdCompressor(level=9).compress(raw) if raw else b""
    return struct.pack("<II", DICTIONARY_MAGIC, len(held)) + held


def read_dictionary(head: bytes) -> tuple[bytes, int]:
    """(the dictionary in an archive's leading frame or b"", where the records start). ValueError if the frame is cut off."""
    if len(head) < 8 or struct.unpack_from("<I", head)[0] != DICTIONARY_MAGIC:
        return b"", 0
    end = 8 + struct.unpack_from("<I", head, 4)[0]
    if len(head) < end:
        raise ValueError("the dictionary is cut off")
    held = head[8:end]
    if held[:4] == struct.pack("<I", FRAME_MAGIC):
        held = zstandard.ZstdDecompressor().decompress(held, max_output_size=1 << 30)
    return held, end


def frame_length(data: bytes, at: int) -> int:
    """Bytes of the Zstandard or skippable frame at `at`, by its header and block headers alone; 0 if data ends within it, ValueError if there is none."""
    if len(data) < at + 8:
        return 0
    magic, size = struct.unpack_from("<II", data, at)
    if magic & 0xFFFFFFF0 == SKIPPABLE_MAGIC:
        return 8 + size if len(data) >= at + 8 + size else 0
    if magic != FRAME_MAGIC:
        raise ValueError("there is no Zstandard frame")
    flags = data[at + 4]
    single = flags >> 5 & 1
    end = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while True:
        if len(data) < end + 3:
            return 0
        block = int.from_bytes(data[end : end + 3], "little")
        end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            end += 4 * (flags >> 2 & 1)
            return end - at if len(data) >= end else 0


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    number = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def write_record(kind: str, page_id: int | None, url: str | None, payload: bytes, n_bytes: int, digest: str, refers_to: int | None = None) -> bytes:
    """A record. n_bytes and digest (SHA-256 in hex) are those of the full payload, which a revisit leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if "!" <= c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name.strip() != name:
            raise ValueError("a header line has no name")
        out[name.decode("latin-1").title()] = value.strip().decode()
    return out


def _length(field: str) -> int:
    if not field.isascii() or not field.isdigit() or len(field) > 18:
        raise ValueError("a length is no number")
    return int(field)


def read_record(data: bytes) -> dict:
    """The fields and the payload of one record. ValueError on a version, header, length or digest that doesn't hold."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("a record doesn't start with its version")
    fields = _fields(lines)
    if missing := [x for x in _REQUIRED if not fields.get(x.title())]:
        raise ValueError(f"a record has no {missing[0]}")
    length = _length(fields["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("a record's block hasn't the length that it states")
    kind, block = fields["Warc-Type"], rest[:length]
    out = {"record_type": kind, "record_id": fields["Warc-Record-Id"], "target_uri": fields.get("Warc-Target-Uri"), "refers_to": fields.get("Warc-Refers-To"), "payload": block, "payload_bytes": length, "digest": None}
    if kind in ("response", "revisit"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        status, *lines = http.split(b"\r\n")
        if not gap or not status.startswith(b"HTTP/"):
            raise ValueError("a response doesn't start with its status")
        stated = _fields(lines).get("Content-Length")
        out |= {"payload": payload, "payload_bytes": _length(stated) if stated is not None else len(payload)}
        digest = fields.get("Warc-Payload-Digest", "")
        if digest.startswith("sha256:"):
            out["digest"] = digest.removeprefix("sha256:")
        if kind == "response" and (out["payload_bytes"] != len(payload) or out["digest"] not in (None, hashlib.sha256(payload).hexdigest())):
            raise ValueError("a payload hasn't the length or digest that its record states")
        if kind == "revisit" and (payload or not out["refers_to"] or out["digest"] is None or stated is None):
            raise ValueError("a revisit must refer to a response by its digest and length, and have no payload")
    return out


def _writer(folder: str, raw: bytes):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_fs(folder)
        name = f"part-{uuid.uuid4().hex}.warc.zst"
        press = zstandard.ZstdCompressor(dict_data=_dictionary(raw), write_content_size=True, write_checksum=True)
        out, slices, at, first, n = None, [], 0, 0, 0
        try:
            for batch in batches:
                for page_id, url, payload, n_bytes, digest, refers_to, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20)
                        lead = dictionary_frame(raw)
                        out.write(lead)
                        at = first = len(lead)
                    made = press.compress(write_record("revisit" if again else "response", page_id, url, payload or b"", n_bytes, digest, refers_to))
                    if n and at - first + len(made) > SLICE_BYTES:
                        slices.append((first, at, n))
                        first, n = at, 0
                    out.write(made)
                    at, n = at + len(made), n + 1
        finally:
            if out is not None:
                out.close()
        if n:
            slices.append((first, at, n))
            columns = [pa.array([f"{folder}/{name}"] * len(slices)), *[pa.array([s[k] for s in slices], pa.int64()) for k in range(3)]]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "first", "last", "n_records"])

    return write


def plan_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, n_bytes, digest, refers_to and again of every row: what `write_archives` writes. A row with `again` is a revisit and has no payload.

    Of the rows with equal payloads (by SHA-256) of LEAST_REVISIT bytes or more, those with the smallest id are responses and the others revisit it. Whole payloads are
    not shuffled: digests are grouped by themselves, and of the payloads only those of the rows move whose ids a bit map of the revisits may hold.
    """
    data = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("doc_id"), F.col(url_col).cast("string").alias("url"), data.alias("payload"), F.octet_length(data).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("digest"))
    facts = rows.filter(F.col("n_bytes") >= LEAST_REVISIT).select("doc_id", "digest")
    groups = facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select(F.col("digest").alias("same"), "first")
    again = stage(facts.join(groups, F.col("digest") == F.col("same")).filter("doc_id is null or doc_id <> first").select("doc_id", "digest", "first").distinct(), "revisits")
    known = again.filter("doc_id is not null")
    maybe, sure = split_by_marks(rows, marks_of(known.select("doc_id")))
    nameless = sure.filter("doc_id is null")
    sure = sure.filter("doc_id is not null")
    none = (F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("again"))
    own, found = ["doc_id", "url", "payload", "n_bytes", "digest"], again.select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), F.col("first").alias("refers_to"))
    hit = F.col("g").isNotNull()
    closed = [F.when(~hit, F.col("payload")).alias("payload") if c == "payload" else F.col(c) for c in own]
    out = sure.select(*own, *none)
    out = out.unionByName(maybe.join(found, (F.col("doc_id") == F.col("d")) & (F.col("digest") == F.col("g")), "left").select(*closed, "refers_to", hit.alias("again")))
    out = out.unionByName(nameless.join(found.filter("d is null"), F.col("digest") == F.col("g"), "left").select(*closed, "refers_to", hit.alias("again")))
    return out.withColumnRenamed("doc_id", "page_id")


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record for every row, in archives under `folder` (a URI); returns the manifest, a row for each slice of an archive.

    A null payload is empty, a null URL is left out, control characters and blanks in URLs are percent-encoded. Null ids stay null; a row without an id revisits the
    smallest id of its payload, and where no row of a payload has an id all are responses. Rows that repeat id and payload are alike: responses if theirs is the smallest id.
    An empty table writes nothing. Other columns are not read, whatever their names. A task writes one archive as its rows come and holds one batch of rows.
    """
    samples = [bytes(r[0]) for r in pages.select(F.substring(F.col(payload_col).cast("string"), 1, SAMPLE_BYTES).cast("binary")).filter(F.col(payload_col).isNotNull()).limit(SAMPLE_ROWS).collect()]
    rows = plan_records(pages, id_col=id_col, url_col=url_col, payload_col=payload_col)
    return stage(rows.mapInArrow(lean(_writer(folder, make_dictionary(samples))), _MANIFEST), "manifest")


def list_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A manifest of archives from elsewhere: each is one slice, up to its end."""
    return spark.createDataFrame([(p, 0, None, None) for p in paths], _MANIFEST)


def read_slice(path: str, first: int, last: int | None, chunk: int = 4 << 20) -> Iterator[tuple[int, dict]]:
    """(offset, record) of the records whose frames lie in bytes first to last of an archive; the dictionary comes from its leading frame. ValueError names the place of a fault.

    Holds a chunk and the longest record at most.
    """
    store, name = open_fs(path)
    with store.open_input_file(name) as f:
        size = f.size()
        head = f.read(8)
        if len(head) == 8 and struct.unpack_from("<I", head)[0] == DICTIONARY_MAGIC:
            head += f.read(struct.unpack_from("<I", head, 4)[0])
        raw, start = read_dictionary(head)
        reader = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
        at, last = max(first, start), size if last is None else min(last, size)
        f.seek(at)
        data, here = b"", 0
        while at < last:
            try:
                length = frame_length(data, here)
                if not length:
                    more = f.read(min(chunk, last - at - (len(data) - here)))
                    if not more:
                        raise ValueError("a frame is cut off")
                    data, here = data[here:] + more, 0
                    chunk = max(chunk, len(data))  # a record of many chunks is not copied for each of them
                    continue
                if struct.unpack_from("<I", data, here)[0] == FRAME_MAGIC:
                    record = reader.decompressobj().decompress(data[here : here + length])
                    yield at, read_record(record)
            except (ValueError, zstandard.ZstdError) as e:
                raise ValueError(f"{path} at {at}: {e}") from e
            at, here = at + length, here + length


_READ = [("path", pa.string()), ("at", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]


def read_archives(manifest: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """path, at (the frame's offset), record_type, record_id, target_uri, refers_to, payload_bytes and payload_digest (SHA-256 in hex) of every record, and with with_payload the payload.

    Length and digest are those of the full payload, for revisits as they state them. Slices are shared out among tasks. A fault fails the read with its archive and offset; so does a slice
    that hasn't the number of records that the manifest states. Warcinfo and other records come with their block as payload. An empty manifest gives no rows.
    """
    schema = pa.schema([*_READ, ("payload", pa.binary())] if with_payload else _READ)
    slices = manifest.select("path", "first", "last", "n_records").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                rows, held, n = [], 0, 0
                for at, r in read_slice(s["path"], s["first"], s["last"]):
                    digest = r["digest"] or hashlib.sha256(r["payload"]).hexdigest()
                    rows.append((s["path"], at, r["record_type"], r["record_id"], r["target_uri"], r["refers_to"], r["payload_bytes"], digest, r["payload"])[: len(schema)])
                    n, held = n + 1, held + (len(r["payload"]) if with_payload else 0)
                    if len(rows) == 1024 or held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if s["n_records"] not in (None, n):
                    raise ValueError(f"{s['path']}: {n} records from {s['first']} on, {s['n_records']} in the manifest")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    kinds = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    return slices.mapInArrow(lean(read), ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))


def with_full_payloads(records: DataFrame) -> DataFrame:
    """`read_archives(..., with_payload=True)` with the payloads of revisits filled in from the responses that they refer to; null where there is none of that id and digest."""
    name = fresh(records, "_full")
    whole = records.filter("record_type = 'response'").groupBy(F.col("record_id").alias("_id"), F.col("payload_digest").alias("_digest")).agg(F.any_value("payload").alias(name))
    back = records.filter("record_type = 'revisit'").join(whole, (F.col("refers_to") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    return records.filter("record_type <> 'revisit'").unionByName(back.withColumn("payload", F.col(name)).select(*records.columns))


def write_and_read(pages: DataFrame) -> DataFrame:
    """The round trip: page_id, payload_bytes, payload_digest, record_type and refers_to of every page, from archives in a new folder under the shared one."""
    out = read_archives(write_archives(pages, scratch(pages.sparkSession, "warc")))
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    as_id = lambda c: F.when(number(c) != "", number(c).cast("long"))
    return out.select(as_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to").alias("refers_to"), "target_uri")
