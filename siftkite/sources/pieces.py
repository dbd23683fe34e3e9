"""Large JSON arrays and zip archives as partitioned sources, in batches and as streams that resume.

A JSON array is cut at borders of its elements by byte ranges. Whether a range starts within a string, and how deep, depends on all bytes before it; so tasks first scan the ranges for both cases, the driver
adds up one short row for each range, and then every range knows its borders. A zip archive is cut by its directory. Either way the pieces (path, first, last) are written to an index file;
the data source `pieces` reads them, a partition for each, and its stream takes `per_batch` of them at a time with the number of the next piece as offset.
"""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from siftkite.staging import scratch

PIECE_BYTES = 8 << 20
SCHEMA = "path string, at long, name string, text string"
_ARROW = pa.schema([("path", pa.string()), ("at", pa.int64()), ("name", pa.string()), ("text", pa.string())])
_OPEN, _CLOSE = np.zeros(256, bool), np.zeros(256, bool)
_OPEN[[ord("["), ord("{")]] = True
_CLOSE[[ord("]"), ord("}")]] = True


def open_file(uri: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def quotes(data: np.ndarray, slashes: int) -> np.ndarray:
    """Places of the quotes that are no escaped ones; `slashes`: how many backslashes end what comes before."""
    at = np.flatnonzero(data == ord('"'))
    back = np.flatnonzero(data != ord("\\"))  # the last other byte before a quote
    k = np.searchsorted(back, at) - 1
    before = np.where(k >= 0, at - back[np.maximum(k, 0)] - 1, at + slashes)
    return at[before % 2 == 0]


def depths(data: np.ndarray, slashes: int, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether each byte is within a string, the depth after each byte)."""
    turns = np.zeros(len(data) + 1, np.int8)
    turns[quotes(data, slashes)] = 1
    within = (np.cumsum(turns[:-1]) + inside) % 2 == 1
    step = (_OPEN[data] & ~within).astype(np.int32) - (_CLOSE[data] & ~within)
    return within, np.cumsum(step) + depth


def _read(f, first: int, last: int) -> tuple[np.ndarray, int]:
    """(the bytes, backslashes right before them)."""
    slashes, back = 0, first
    while back > 0:
        low = max(0, back - 4096)
        f.seek(low)
        tail = f.read(back - low)
        run = len(tail) - len(tail.rstrip(b"\\"))
        slashes, back = slashes + run, low
        if run < len(tail):
            break
    f.seek(first)
    return np.frombuffer(f.read(last - first), np.uint8), slashes


def index_json(spark: SparkSession, path: str, field: str | None = None, *, piece_bytes: int = PIECE_BYTES) -> list[tuple[str, int, int]]:
    """Pieces (path, first, last) of the array in the root's `field`, or of an array that is the root: whole elements with the commas between them, of about piece_bytes each. None if there is no such array."""
    with open_file(path) as f:
        size = f.size()
    ranges = [(k, low, min(low + piece_bytes, size)) for k, low in enumerate(range(0, size, piece_bytes))]
    tasks = lambda rows, names: spark.createDataFrame(rows, names).repartition(max(1, min(len(rows), int(spark.conf.get("spark.sql.shuffle.partitions")))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open_file(path) as f:
                    data, slashes = _read(f, low, high)
                turns = len(quotes(data, slashes)) % 2
                out.append((k, turns, *(int(depths(data, slashes, inside, 0)[1][-1]) for inside in (False, True))))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["k", "turns", "out", "within"])

    inside, depth, starts = False, 0, []
    if not ranges:
        return []
    for r in sorted(tasks(ranges, "k long, low long, high long").mapInArrow(scan, "k long, turns long, out long, within long").collect()):  # a row for each piece_bytes of the file
        starts.append((*ranges[r.k], inside, depth))
        depth += r.within if inside else r.out
        inside ^= bool(r.turns)
    level = 1 if field is None else 2
    wanted = None if field is None else json.dumps(field).encode()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, low, high, inside, depth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open_file(path) as f:
                    data, slashes = _read(f, low, high)
                    within, deep = depths(data, slashes, inside, depth)
                    opens = np.flatnonzero((data == ord("[")) & ~within & (deep == level))
                    begin = next((int(i) for i in opens if wanted is None or _named(f, low + int(i), wanted)), None)
                after = 0 if begin is None else begin + 1
                ends = np.flatnonzero((data[after:] == ord("]")) & ~within[after:] & (deep[after:] == level - 1))
                commas = np.flatnonzero((data[after:] == ord(",")) & ~within[after:] & (deep[after:] == level))
                place = lambda i, low=low, after=after: None if not len(i) else low + after + int(i[0])
                out.append((k, None if begin is None else low + begin, place(ends), place(commas)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["k", "begin", "end", "comma"])

    seen = sorted(tasks(starts, "k long, low long, high long, inside boolean, depth long").mapInArrow(find, "k long, begin long, end long, comma long").collect(), key=lambda r: r.k)
    first = next((r for r in seen if r.begin is not None), None)
    if first is None:
        return []
    end = next((r.end for r in seen[first.k :] if r.end is not None), None)
    if end is None:
        raise ValueError(f"{path}: the array has no end")
    cuts = [r.comma for r in seen[first.k + 1 :] if r.comma is not None and r.comma < end]
    edges = [first.begin, *cuts, end]
    return [(path, a + 1, b) for a, b in zip(edges, edges[1:], strict=False)]


def _named(f, at: int, wanted: bytes) -> bool:
    """Whether `"field":` stands before the bracket at `at`."""
    low = max(0, at - len(wanted) - 256)
    f.seek(low)
    before = f.read(at - low).rstrip()
    return before.endswith(b":") and before[:-1].rstrip().endswith(wanted)


def json_elements(path: str, first: int, last: int) -> Iterator[tuple[str, int, str, str]]:
    """(path, place, "", text) of the elements between two borders."""
    with open_file(path) as f:
        f.seek(first)
        raw = f.read(last - first)
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return
    within, deep = depths(data, 0, False, 0)
    cuts = [-1, *np.flatnonzero((data == ord(",")) & ~within & (deep == 0)).tolist(), len(raw)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        text = raw[a + 1 : b]
        if text.strip():
            yield path, first + a + 1 + len(text) - len(text.lstrip()), "", text.strip().decode()


def index_zip(path: str, suffix: str = "", *, piece_bytes: int = PIECE_BYTES) -> list[tuple[str, int, int]]:
    """Pieces (path, number of the first member, number after the last) of an archive's members whose names end in `suffix`, by number in the directory; only the directory is read."""
    with open_file(path) as f, zipfile.ZipFile(f) as z:
        out, first, held = [], None, 0
        for k, m in enumerate(z.infolist()):
            if m.is_dir() or not m.filename.endswith(suffix):
                if first is not None:
                    out.append((path, first, k))
                first, held = None, 0
                continue
            if first is not None and held + m.compress_size > piece_bytes:
                out.append((path, first, k))
                first, held = None, 0
            first = k if first is None else first
            held += m.compress_size
        if first is not None:
            out.append((path, first, len(z.infolist())))
    return out


def zip_members(path: str, first: int, last: int) -> Iterator[tuple[str, int, str, str]]:
    """(path, number, name, text) of the members; bytes that are no UTF-8 are replaced."""
    with open_file(path) as f, zipfile.ZipFile(f) as z:
        for k, m in list(enumerate(z.infolist()))[first:last]:
            yield path, k, m.filename, z.read(m).decode("utf-8", "replace")


_KINDS = {"json": json_elements, "zip": zip_members}


class Piece(InputPartition):
    def __init__(self, kind: str, path: str, first: int, last: int):
        self.kind, self.path, self.first, self.last = kind, path, first, last


def _rows(piece: Piece) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for r in _KINDS[piece.kind](piece.path, piece.first, piece.last):
        rows.append(r)
        size += len(r[3])
        if size > 4 << 20 or len(rows) == 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class PiecesReader(DataSourceReader):
    def __init__(self, index: dict):
        self.index = index

    def partitions(self) -> list[Piece]:
        return [Piece(self.index["kind"], *p) for p in self.index["pieces"]]

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from _rows(partition)


class PiecesStream(DataSourceStreamReader):
    """Offsets are numbers of pieces. `progress` is a file that remembers the end of the last batch that was planned, so that a restarted stream asks for the `per_batch` pieces after it.

    A batch is planned after its end has been logged, and one that did not finish is planned again at the restart, so what is remembered is the last logged end when the next one is asked for.
    """

    def __init__(self, index: dict, per_batch: int, progress: str):
        self.index, self.per_batch, self.progress, self.asked = index, per_batch, progress, None

    def initialOffset(self) -> dict:
        return {"piece": 0}

    def latestOffset(self) -> dict:
        if self.asked is None:
            self.asked = _load(self.progress, {"piece": 0})["piece"]
        self.asked = min(len(self.index["pieces"]), self.asked + self.per_batch)
        return {"piece": self.asked}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.asked = max(self.asked or 0, end["piece"])
        _save(self.progress, {"piece": self.asked})
        return [Piece(self.index["kind"], *p) for p in self.index["pieces"][start["piece"] : end["piece"]]]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        yield from _rows(partition)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def _load(uri: str, default=None):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if default is not None and store.get_file_info(path).type == fs.FileType.NotFound:
        return default
    with store.open_input_stream(path, compression=None) as f:
        return json.loads(f.read())


def _save(uri: str, value) -> None:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path + ".new", compression=None) as f:
        f.write(json.dumps(value).encode())
    store.move(path + ".new", path)


class PiecesSource(DataSource):
    """Format `pieces`: option `index`, and for streams `per_batch` and `progress`."""

    @classmethod
    def name(cls) -> str:
        return "pieces"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PiecesReader:
        return PiecesReader(_load(self.options["index"]))

    def streamReader(self, schema) -> PiecesStream:
        return PiecesStream(_load(self.options["index"]), int(self.options.get("per_batch", 64)), self.options["progress"])


def save_index(spark: SparkSession, kind: str, pieces: list[tuple[str, int, int]]) -> str:
    """Registers the source and writes an index file in the shared folder; gives its path."""
    spark.dataSource.register(PiecesSource)
    uri = f"{scratch(spark, 'index')}/index.json"
    uri = uri if "://" in uri or uri.startswith("file:") else f"file://{uri}"
    _save(uri, {"kind": kind, "pieces": pieces})
    return uri


def read_json_array(spark: SparkSession, path: str, field: str | None = None, *, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """path, at (byte of its start), name and text of every element of a JSON array, read by as many tasks as the file has pieces. Give `text` to from_json or parse_json."""
    return spark.read.format("pieces").option("index", save_index(spark, "json", index_json(spark, path, field, piece_bytes=piece_bytes))).load()


def read_zip(spark: SparkSession, paths: list[str], suffix: str = "", *, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """path, at (number), name and text of every member of zip archives whose name ends in `suffix`, read by groups of members."""
    pieces = [p for path in paths for p in index_zip(path, suffix, piece_bytes=piece_bytes)]
    return spark.read.format("pieces").option("index", save_index(spark, "zip", pieces)).load()


def stream_pieces(spark: SparkSession, index: str, progress: str, *, per_batch: int = 64) -> DataFrame:
    """A stream over an index of `save_index`: with a checkpoint it goes on after the last committed batch, without loss or repeat."""
    spark.dataSource.register(PiecesSource)
    return spark.readStream.format("pieces").option("index", index).option("per_batch", per_batch).option("progress", progress).load()
