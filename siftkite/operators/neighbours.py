"""A neighbour index of coarse cells whose recall is measured and not hoped for.

Centroids are fitted on a bounded sample; every row goes to its nearest one's cell. A search looks into the cells nearest to a query. How many is found by calibration: for some rows the exact
neighbours are sought among all rows, and the rank of each one's cell in its query's order of cells says how many cells must be looked into to find the wanted share of them. So data without structure
cost more cells, up to all of them, and never recall.

The index is a table of (cell, piece, key, vector): cells over PIECE_ROWS rows are cut into pieces, and a piece meets CHUNK_QUERIES queries at a time, so no cell is in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftkite.operators.retrieval import valid_vector
from siftkite.staging import stage

#: Rows that centroids are fitted on, and the most cells: the bounds of what the driver and a broadcast hold.
SAMPLE_ROWS, MOST_CELLS = 16384, 4096
#: Queries whose exact neighbours are sought to set the number of cells.
CALIBRATION = 128
PIECE_ROWS, CHUNK_QUERIES = 16384, 4096


@dataclass
class CellIndex:
    """rows: key, vector, cell, piece. pieces: cell, pieces. probes: cells that a search looks into."""

    rows: DataFrame
    pieces: DataFrame
    centroids: np.ndarray
    metric: str
    probes: int
    key_type: str


def _matrix(column: pa.Array, metric: str) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    m = flat.reshape(len(column), -1)
    if metric == "cosine":
        size = np.sqrt((m * m).sum(1, keepdims=True))
        m = m / np.where(size == 0, 1.0, size)
    return m


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared L2 distances of all rows of a to all of b."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def fit_centroids(sample: np.ndarray, cells: int, *, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm from rows drawn at random. A cell that runs empty stays where it is."""
    start = np.random.default_rng(seed).choice(len(sample), cells, replace=False)
    centroids = sample[start].copy()
    for _ in range(rounds):
        of = np.concatenate([_distances(part, centroids).argmin(1) for part in np.array_split(sample, -(-len(sample) // 2048))])
        size = np.bincount(of, minlength=cells)
        total = np.stack([np.bincount(of, sample[:, k], cells) for k in range(sample.shape[1])], 1)
        centroids = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centroids)
    return centroids


def _usable(vectors: DataFrame, key: str, vector: str, width: int | None = None) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    rows = vectors.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), v.alias("vector")).filter(valid_vector(F.col("vector")))
    return rows if width is None else rows.filter(F.size("vector") == width)


def build_index(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", metric: str = "l2", cells: int | None = None, k: int = 10, target: float = 0.95) -> CellIndex | None:
    """An index of all rows whose vector is valid and as wide as the first of the sample; None without any. metric: "l2" or "cosine".

    `cells`: the square root of the number of rows by default, MOST_CELLS at most. `target`: the share of each row's k nearest that the calibrating queries must find.
    """
    usable = _usable(vectors, key, vector)
    head = usable.orderBy(F.xxhash64("key", F.lit(7)), "key").limit(SAMPLE_ROWS).select("vector").toArrow().column("vector").to_pylist()
    if not head:
        return None
    width = len(head[0])
    sample = np.array([v for v in head if len(v) == width])
    if metric == "cosine":
        sample = sample / np.maximum(np.sqrt((sample * sample).sum(1, keepdims=True)), 1e-300)
    usable = usable.filter(F.size("vector") == width)
    total = usable.count()
    cells = min(MOST_CELLS, len(sample), cells or max(1, round(total**0.5)))
    centroids = fit_centroids(sample, cells)
    held = usable.sparkSession.sparkContext.broadcast(centroids)
    key_type = usable.schema["key"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                of = _distances(_matrix(part.column(1), metric), held.value).argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(of, pa.int32())], names=["key", "vector", "cell"])

    rows = stage(usable.mapInArrow(assign, f"key {key_type}, vector array<double>, cell int"), "cells")
    pieces = stage(rows.groupBy("cell").agg(F.ceil(F.count("*") / PIECE_ROWS).cast("int").alias("pieces")), "pieces")
    # a row for each cell: MOST_CELLS at most
    rows = rows.join(F.broadcast(pieces), "cell").select("key", "vector", "cell", F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int").alias("piece"))
    index = CellIndex(rows, pieces, centroids, metric, cells, key_type)
    index.probes = _calibrate(index, k, target)
    return index


def exact_neighbours(rows: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(query, key, distance, cell) of the k nearest of all rows (key, vector, cell) to each of a few queries (key, vector), itself left out; ties by key. Queries are held by every task: let them be few."""
    held = queries.select("key", "vector").toArrow()
    names, matrix = held.column("key").to_pylist(), held.column("vector").to_pylist()
    types = {f.name: f.dataType.simpleString() for f in rows.select("key", "cell").schema}
    schema = f"query {types['key']}, key {types['key']}, distance double, cell int"
    spread = rows.sparkSession.sparkContext.broadcast((names, np.array(matrix, np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = spread.value
        for batch in batches:
            if batch.num_rows and names:
                yield _nearest(names, _unit(q, metric), _matrix(batch.column(1), metric), batch.column(0).to_pylist(), k, batch.schema.field(0).type, np.asarray(batch.column(2)))

    found = rows.select("key", "vector", "cell").mapInArrow(run, schema)
    return _best(found, k)


def _unit(m: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cosine" or not len(m):
        return m
    size = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(size == 0, 1.0, size)


def _nearest(names: list, q: np.ndarray, x: np.ndarray, keys: list, k: int, key_type: pa.DataType, cells: np.ndarray) -> pa.RecordBatch:
    """For each query its k nearest rows, itself left out, ties by key. Products choose the rows; what is returned are sums of squared differences."""
    d = _distances(q, x)
    out = ([], [], [], [])
    most = min(k + 1, len(keys))
    edge = np.partition(d, most - 1, axis=1)[:, most - 1]
    edge += 1e-9 * ((q * q).sum(1) + (x * x).sum(1).max())
    for i, name in enumerate(names):
        near = np.flatnonzero(d[i] <= edge[i])
        far = np.sqrt(((x[near] - q[i]) ** 2).sum(1)).tolist()
        for distance, other, j in heapq.nsmallest(k, ((f, keys[j], j) for f, j in zip(far, near.tolist(), strict=True) if keys[j] != name)):
            for column, value in zip(out, (name, other, distance, int(cells[j])), strict=True):
                column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(out[0], key_type), pa.array(out[1], key_type), pa.array(out[2], pa.float64()), pa.array(out[3], pa.int32())], names=["query", "key", "distance", "cell"])


def _best(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy("distance", "key")))
    return ranked.filter(F.col("nth") <= k)


def _calibrate(index: CellIndex, k: int, target: float) -> int:
    asked = index.rows.orderBy(F.xxhash64("key", F.lit(11)), "key").limit(CALIBRATION).select("key", "vector")
    asked = stage(asked, "asked")
    found = exact_neighbours(index.rows, asked, k, index.metric).select("query", "cell").collect()
    if not found:
        return 1
    held = asked.toArrow()
    order = np.argsort(_distances(_unit(np.array(held.column("vector").to_pylist()), index.metric), index.centroids), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), 1)
    of = {q: i for i, q in enumerate(held.column("key").to_pylist())}
    needed = np.sort([place[of[r["query"]], r["cell"]] for r in found]) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)])


def search(index: CellIndex | None, queries: DataFrame, k: int = 10, *, key: str = "vec_id", vector: str = "embedding", probes: int | None = None) -> DataFrame:
    """(query, key, distance, nth): for each query its k nearest rows of the index's nearest cells, itself left out; ties by key.

    Null, empty or invalid vectors and those of another width find nothing. Repeated queries are one, queries need not be rows of the index.
    """
    if index is None:
        return queries.select(F.col(key).alias("query"), F.col(key).alias("key"), F.lit(0.0).alias("distance"), F.lit(1).alias("nth")).limit(0)
    cells = len(index.centroids)
    probes = min(cells, probes or index.probes)
    asked = stage(_usable(queries, key, vector, index.centroids.shape[1]).dropDuplicates(["key"]), "queries")
    chunks = max(1, -(-asked.count() * probes // (cells * CHUNK_QUERIES)))
    held, metric = asked.sparkSession.sparkContext.broadcast(index.centroids), index.metric

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                d = _distances(_matrix(part.column(1), metric), held.value)
                near = np.argpartition(d, probes - 1, axis=1)[:, :probes] if probes < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))], names=["key", "vector", "cells"])

    aimed = asked.mapInArrow(reach, f"key {index.key_type}, vector array<double>, cells array<int>")
    aimed = aimed.select("key", "vector", F.explode("cells").alias("cell")).join(F.broadcast(index.pieces), "cell")
    aimed = aimed.select("key", "vector", "cell", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int").alias("chunk"))
    rows = index.rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))) if chunks > 1 else index.rows.withColumn("chunk", F.lit(0))
    by = ["cell", "piece", "chunk"]

    found = rows.groupBy(*by).cogroup(aimed.groupBy(*by)).applyInArrow(_meet(metric, k), f"query {index.key_type}, key {index.key_type}, distance double, cell int")
    return _best(found, k).select("query", "key", "distance", "nth")


def _meet(metric: str, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        kind = rows.schema.field("key").type if rows.num_rows else asked.schema.field("key").type
        out = []
        if rows.num_rows and asked.num_rows:
            x, keys = _matrix(rows.column("vector").combine_chunks(), metric), rows.column("key").to_pylist()
            cells = np.asarray(rows.column("cell"))
            for low in range(0, asked.num_rows, 512):
                part = asked.slice(low, 512)
                out.append(_nearest(part.column("key").to_pylist(), _matrix(part.column("vector").combine_chunks(), metric), x, keys, k, kind, cells))
        return pa.Table.from_batches(out, pa.schema([("query", kind), ("key", kind), ("distance", pa.float64()), ("cell", pa.int32())]))

    return meet
