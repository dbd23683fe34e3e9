"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a few differing bits through BK-trees.

A BK-tree hangs each node under its parent by their integer Hamming distance; a search at radius r follows only edges within r of the
query's distance to the node. One tree over all fingerprints would be neither bounded nor selective, and broadcasting it would pass every
fingerprint through the driver. So the trees are shards: two fingerprints at most r bits apart agree on one of r + 1 bit blocks at least, so each
(block, value) is a shard, and the tree of a shard meets the shard's own queries. A shard of more than `tree_size` fingerprints is cut
into pieces; each piece's tree goes to the queries of every other piece, so no task holds more than two pieces and no link is lost.
Tasks build and search the trees of thousands of small shards at once, as one forest in numpy arrays, and give only spanning links.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftkite.llm.common import LOWER, SPACES, drop_staged, gather_runs, lean, marks_of, row_runs, split_by_marks, stage, text_buffer, word_hashes, word_spans

SHINGLE_WORDS = 3
RADIUS = 3
#: Fingerprints in a piece of a shard. A task holds two pieces at most.
TREE_SIZE = 20_000
#: Shingles hashed before their bits are summed.
_STEP = 1 << 16
_LOWER_TEXT = {c: c + 32 for c in range(65, 91)}
_FLAT = LOWER.copy()
_FLAT[list(SPACES)] = 0x20


def fold(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A-Z in lower case, each white space a blank and runs of them one blank."""
    buf = _FLAT[buf]
    if len(buf) > 1:
        blank = buf == 0x20
        again = np.flatnonzero(blank[1:] & blank[:-1]) + 1
        if len(again):
            buf = np.delete(buf, again)
            offsets = offsets - np.searchsorted(again, offsets)
    return buf, offsets


def _mixed(h: np.ndarray) -> np.ndarray:
    """Other 64 bits from each hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def simhash_rows(buf: np.ndarray, offsets: np.ndarray, words: int = SHINGLE_WORDS, parts: int = 1) -> np.ndarray:
    """The fingerprint of each row as `parts` uint64, [row, part]; the parts after the first come from mixed hashes."""
    from xxhash import xxh64_intdigest

    buf, offsets = fold(buf, offsets)
    starts, ends = word_spans(buf, offsets)
    first = np.searchsorted(starts, offsets)
    data, out = memoryview(buf.tobytes()), np.zeros((len(offsets) - 1, parts), np.uint64)
    for row, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if a == b:
            continue
        n = max(1, b - a - words + 1)
        ones = np.zeros((parts, 64), np.int64)
        for low in range(a, a + n, _STEP):
            high = min(low + _STEP, a + n)
            last = ends[low + words - 1 : high + words - 1] if b - a >= words else ends[b - 1 : b]
            hashes = np.array([xxh64_intdigest(data[x:y], 42) for x, y in zip(starts[low:high].tolist(), last.tolist(), strict=True)], "<u8")
            for k in range(parts):
                hashes = hashes if not k else _mixed(hashes)
                ones[k] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[row] = np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, parts: int = 1) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long; with two parts fp and fp1) of every row. A null text is empty; no words: 0."""
    names = ["fp", *[f"fp{k}" for k in range(1, parts)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for low, high in row_runs(texts):
                fp = simhash_rows(*text_buffer(texts.slice(low, high - low)), words, parts).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(low, high - low), *[pa.array(np.ascontiguousarray(fp[:, k])) for k in range(parts)]], names=["doc_id", *names])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, " + ", ".join(f"{n} long" for n in names))


def _gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of points [n, parts]."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """BK-trees over the points [n, parts] of many groups; points of a group are distinct."""

    def __init__(self, groups: np.ndarray, points: np.ndarray):
        """groups: 0, 1, ... ascending, none missing."""
        heads = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        nodes, keys, to = [heads], [], []
        made = len(heads)
        place = groups.copy()  # the node that a point hangs under so far
        self.at = np.concatenate([heads, np.zeros(len(points) - made, np.int64)])  # a node's point
        rest = np.ones(len(points), bool)
        rest[heads] = False
        rest = np.flatnonzero(rest)
        while len(rest):
            gap = _gap(points[rest], points[self.at[place[rest]]])
            key, first, which = np.unique(place[rest] << 9 | gap, return_index=True, return_inverse=True)
            nodes.append(rest[first])
            self.at[made : made + len(key)] = rest[first]
            keys.append(key)
            to.append(np.arange(made, made + len(key)))
            place[rest] = made + which
            stay = np.ones(len(rest), bool)
            stay[first] = False
            rest, made = rest[stay], made + len(key)
        keys, to = np.concatenate(keys or [np.zeros(0, np.int64)]), np.concatenate(to or [np.zeros(0, np.int64)])
        order = np.argsort(keys)
        self.points, self.keys, self.to = points, keys[order], to[order]

    def within(self, roots: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query number, point number) of all pairs at most radius apart; roots: each query's tree."""
        q, node, found = np.arange(len(queries)), roots, []
        while len(q):
            gap = _gap(queries[q], self.points[self.at[node]])
            near = gap <= radius
            found.append((q[near], self.at[node[near]]))
            low = np.searchsorted(self.keys, node << 9 | np.maximum(gap - radius, 0))
            count = np.searchsorted(self.keys, node << 9 | np.minimum(gap + radius, 511), "right") - low
            q, node = np.repeat(q, count), self.to[gather_runs(low, count)]
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def spanning(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels after joining the classes of a[i] and b[i]; a class's label is its smallest member."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels = labels[labels]


def _led(labels: np.ndarray, groups: np.ndarray, points: np.ndarray, radius: int) -> np.ndarray:
    """labels after linking, in each large group, the points within radius of its first point to that: a group of copies is then one class, at the cost of one look at each."""
    heads = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    sizes = np.diff(np.append(heads, len(groups)))
    for low, n in zip(heads[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        near = np.flatnonzero(_gap(points[low : low + n], points[low]) <= radius)
        labels[low + near] = low
    return labels


def link_rows(groups: np.ndarray, side: np.ndarray, points: np.ndarray, radius: int, *, work: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (a, b) of links that span the classes of the points [n, parts] within radius of each other in a group, each point with its class's first.

    side 0: in the tree; 1: a query only. A group without queries of side 1 is searched with its own points. groups: sorted, side within.
    """
    _, of, sizes = np.unique(groups, return_inverse=True, return_counts=True)
    row = np.flatnonzero(sizes[of] > 1)
    groups, side, points = groups[row], side[row], points[row]
    if not len(points):
        return row, row
    _, groups, sizes = np.unique(groups, return_inverse=True, return_counts=True)
    crossed = np.bincount(groups, side) > 0
    labels = np.arange(len(points))
    if not crossed.any():
        labels = _led(labels, groups, points, radius)
    first = np.concatenate([[True], groups[1:] != groups[:-1]])
    whole = np.bincount(groups, labels != np.flatnonzero(first)[groups]) == 0  # one class already
    tree = np.flatnonzero((side == 0) & ~whole[groups])
    planted, root = np.unique(groups[tree], return_inverse=True)
    ask = np.flatnonzero(((side == 1) | ~crossed[groups]) & ~whole[groups])
    if len(tree) and len(ask):
        forest = Forest(root, points[tree])
        roots = np.searchsorted(planted, groups[ask])
        grown = (roots < len(planted)) & (planted[np.minimum(roots, len(planted) - 1)] == groups[ask])
        ask, roots = ask[grown], roots[grown]
        cost = np.cumsum(sizes[groups[ask]])
        low = 0
        while low < len(ask):  # so many queries at once that the search's front stays small
            high = max(low + 1, int(np.searchsorted(cost, (cost[low - 1] if low else 0) + work)))
            q, hit = forest.within(roots[low:high], points[ask[low:high]], radius)
            labels = spanning(labels, ask[low:high][q], tree[hit])
            low = high
    child = np.flatnonzero(labels != np.arange(len(points)))
    return row[child], row[labels[child]]


def links_of(groups: np.ndarray, side: np.ndarray, points: np.ndarray, radius: int, *, work: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The points of `link_rows`."""
    a, b = link_rows(groups, side, points, radius, work=work)
    return points[a], points[b]


def shard_links(keyed: DataFrame, keys: list[str], point: list[str], radius: int, tree_size: int) -> DataFrame:
    """Distinct links (a, b; with more parts a, a1, b, b1) of the points within each shard: a shard is the rows that agree in `keys` (longs or ints)."""
    # shards over the bound are few: at most (rows / tree_size)
    hot = keyed.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > tree_size).withColumn("pieces", F.ceil(F.col("n") / tree_size).cast("int")).drop("n")
    piece = F.pmod(F.xxhash64(*point), F.col("pieces")).cast("int")
    units = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda other: F.struct(F.least(F.col("piece"), other).alias("low"), F.greatest(F.col("piece"), other).alias("high"), (F.col("piece") > other).cast("int").alias("side")))
    placed = keyed.join(hot, keys, "left").withColumn("pieces", F.coalesce("pieces", F.lit(1))).withColumn("piece", piece)
    placed = placed.select(*keys, *point, F.explode(units).alias("u")).select(*keys, "u.*", *point)
    count = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = [*keys, "low", "high"]
    placed = placed.repartition(count, *group).sortWithinPartitions(*group, "side", *point)
    wide, names = len(group), [*[f"a{k or ''}" for k in range(len(point))], *[f"b{k or ''}" for k in range(len(point))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def give(rows: np.ndarray) -> pa.RecordBatch:
            key = rows[:, :wide]
            new = np.concatenate([[False], (key[1:] != key[:-1]).any(axis=1)])
            a, b = links_of(np.cumsum(new), rows[:, wide], np.ascontiguousarray(rows[:, wide + 1 :]).view(np.uint64), radius)
            both = np.concatenate([a, b], axis=1).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k])) for k in range(both.shape[1])], names=names)

        size = 0
        for batch in batches:
            held.append(np.stack([np.asarray(c).astype(np.int64) for c in batch.columns], axis=1))
            size += batch.num_rows
            if size >= 100_000:  # all whole groups so far; the last one may go on
                rows = np.concatenate(held)
                cut = int(np.flatnonzero((rows[:, :wide] != rows[-1, :wide]).any(axis=1)).max(initial=-1)) + 1
                if cut:
                    yield give(rows[:cut])
                held, size = [rows[cut:]], len(rows) - cut
        if size:
            yield give(np.concatenate(held))

    return placed.select(*group, "side", *point).mapInArrow(lean(run), ", ".join(f"{n} long" for n in names)).distinct()


def near_links(distinct: DataFrame, *, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """Links (a, b) that span the classes of the distinct fingerprints in column fp within each shard, a shard for each value of each of radius + 1 blocks."""
    blocks = radius + 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    shard = [F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.shiftleft(F.col("fp"), 64 - cuts[i + 1]), 64 - cuts[i + 1] + cuts[i]).alias("value")) for i in range(blocks)]
    keyed = distinct.select("fp", F.explode(F.array(*shard)).alias("s")).select("fp", "s.block", "s.value")
    return shard_links(keyed, ["block", "value"], ["fp"], radius, tree_size)


def star_labels(links: DataFrame) -> DataFrame:
    """Connected components: (node, root) for each node of the links other than its component's smallest, by alternating large and small stars.

    Each round is staged in the shared folder; the rounds end when the links no longer change. A star's hot centre meets one row, its minimum,
    so a join splits where it is skewed.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            out = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:  # a > b holds in what a large star gives
            low = e.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
            near = e.select(F.col("a").alias("u"), F.col("b").alias("v")).join(low, "u")
            out = near.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("u", "m"))
        return stage(out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars", replaces=e)

    edges = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        edges = star(star(edges, True), False)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable over links, its own included) of every row.

    Null and wordless texts have fingerprint 0 and link like any other. A null id stays null, counts for no minimum, and has a null
    component_id if no row of its component has an id. Repeated rows are repeated in the result. Equal fingerprints are one point of the trees, so
    copies cost nothing there. An empty table gives no rows; other columns are not read.
    """
    rows = stage(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "fingerprints")
    points = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    labels = star_labels(near_links(points.select("fp"), radius=radius, tree_size=tree_size))
    members = labels.union(labels.select("root", "root").distinct()).select(F.col("node").alias("fp"), "root")
    lows = members.join(points, "fp").groupBy("root").agg(F.min("low").alias("least"))
    joined = members.join(lows, "root").select("fp", "least")
    known = points.join(joined, "fp", "left").select("fp", F.coalesce("least", "low").alias("component_id"))
    return rows.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Copies by similarity: texts that share a rare shingle form a shard, a BK-tree of the shard finds those whose fingerprints are near, and every candidate that could still
# join two classes is checked on the whole shingle sets.

#: Words of a shingle and least Jaccard similarity of the shingle sets of a copy.
COPY_WORDS, COPY_SIMILARITY = 5, 0.8
#: Texts and shingles in a piece of a large candidate group. A task holds two pieces at most.
PIECE_TEXTS, PIECE_SHINGLES = 4_000, 1_000_000
#: Sets in a piece of a hot shard.
PIECE_SETS = 2_000
#: Prefix hashes in a bucket.
BUCKET_HASHES = 1_000_000
#: Longs of a copy's fingerprint, and the differing bits up to which two of them are compared. Sets 0.8 alike differ in 39 of 256 bits on average (deviation 6; the worst small
#: sets in 48), so fewer than one pair in 10 ** 11 lies beyond; unrelated ones differ in 128 (deviation 8), of which three in a million lie within.
COPY_PARTS, COPY_RADIUS = 4, 92
#: Texts, and at most what share of them, in which common shingles are looked for, and the bits of the map that marks them. They decide what the search costs, not what it finds.
COMMON_TEXTS, COMMON_SHARE, COMMON_BITS = 50_000, 0.2, 1 << 25
#: Against rounding of a similarity times a size.
_SLACK = 1e-9


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, words: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each row's distinct shingle hashes, ascending. A text of fewer words is one shingle; no words: none.

    A hash has 63 bits; the top bit is set where the map `common` says so, so that common shingles come last in every row.
    """
    buf = LOWER[buf]
    starts, ends = word_spans(buf, offsets)
    own = word_hashes(buf, starts, ends)
    first = np.searchsorted(starts, offsets)
    have = np.diff(first)
    count = np.where(have >= words, have - words + 1, np.minimum(have, 1))
    row = np.repeat(np.arange(len(have)), count)
    at = gather_runs(first[:-1], count)
    out = np.zeros(len(at), np.uint64)
    for k in range(words):
        inside = at + k < first[1:][row]
        out[inside] = _mixed(out[inside] + own[at[inside] + k] + np.uint64(k + 1))
    out >>= np.uint64(1)
    if common is not None:
        at = (out % np.uint64(len(common) * 8)).astype(np.int64)
        out |= (common[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(np.uint64) << np.uint64(63)
    order = np.argsort(out)
    order = order[np.argsort(row[order], kind="stable")]
    out, row = out[order], row[order]
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return out[fresh], np.concatenate([[0], np.cumsum(np.bincount(row[fresh], minlength=len(have)))]).astype(np.int64)


def prefix_lengths(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """How many of a set's smallest hashes it takes: two sets that are alike enough share one of them, whatever the order."""
    return np.minimum(sizes, sizes - np.ceil(similarity * sizes - _SLACK).astype(np.int64) + 1)


def common_shingles(rows: DataFrame, words: int) -> np.ndarray:
    """A bit map, packed, over hash % COMMON_BITS: set where a shingle is in two texts or more of a sample by doc_id."""
    count = rows.count()
    share = min(COMMON_SHARE, COMMON_TEXTS / max(count, 1))
    buckets = 64

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in row_runs(batch.column(0)):
                hashes, _ = shingle_sets(*text_buffer(batch.column(0).slice(low, high - low)), words)
                bucket = (hashes % np.uint64(COMMON_BITS)).astype(np.int64) // (COMMON_BITS // buckets)
                order = np.argsort(bucket.astype(np.uint8), kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                hashes = hashes[order]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array([hashes[a:b].tobytes() for a, b in itertools.pairwise(cuts)], pa.binary())], names=["bucket", "hash"])

    def give(bucket: int, held: list) -> pa.RecordBatch:
        hashes, n = np.unique(np.frombuffer(b"".join(held), "<u8"), return_counts=True)
        bits = np.zeros(COMMON_BITS // buckets, bool)
        bits[(hashes[n > 1] % np.uint64(COMMON_BITS)).astype(np.int64) - bucket * len(bits)] = True
        return pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["bucket", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], -1
        for batch in batches:
            for b, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != of and held:
                    yield give(of, held)
                    held = []
                of = b
                held.append(x)
        if held:
            yield give(of, held)

    some = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("text")
    dealt = some.mapInArrow(lean(deal), "bucket long, hash binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    out = np.zeros((buckets, COMMON_BITS // buckets // 8), np.uint8)
    for r in dealt.mapInArrow(lean(run), "bucket long, bits binary").collect():
        out[r.bucket] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def copy_sets(rows: DataFrame, words: int, similarity: float, common) -> DataFrame:
    """doc_id, fp and fp1 (128 bits that tell shingle sets apart), n (the set's size), prefix (its smallest hashes, 8 bytes each) and p0, p1, ... (its SimHash) of every row of doc_id and text."""
    names = [f"p{k}" for k in range(COPY_PARTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            for low, high in row_runs(texts):
                hashes, at = shingle_sets(*text_buffer(texts.slice(low, high - low)), words, common.value)
                n = np.diff(at)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)]) for h in (hashes, _mixed(hashes))]
                fp, fp1 = ((x[at[1:]] - x[at[:-1]]).view(np.int64) for x in sums)
                take = prefix_lengths(n, similarity)
                ends = np.concatenate([[0], np.cumsum(take) * 8]).astype(np.int64)
                prefix = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(hashes[gather_runs(at[:-1], take)].tobytes())])
                points = [pa.array(p.view(np.int64)) for p in set_prints(hashes, at)]
                yield pa.RecordBatch.from_arrays([ids.slice(low, high - low), pa.array(fp), pa.array(fp1), pa.array(n), prefix.cast(pa.binary()), *points], names=["doc_id", "fp", "fp1", "n", "prefix", *names])

    return rows.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, fp long, fp1 long, n long, prefix binary, " + ", ".join(f"{p} long" for p in names))


def set_prints(hashes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """COPY_PARTS arrays of 64 bits: a bit of a row's fingerprint is 1 if set in over half of its hashes (with the top bit, which marks common ones, left out)."""
    rows = len(at) - 1
    out = [np.zeros(rows, np.uint64) for _ in range(COPY_PARTS)]
    full = np.flatnonzero(at[1:] > at[:-1])
    half = (at[1:] - at[:-1])[full][:, None] // 2
    cuts = np.append(np.searchsorted(at[full], np.arange(0, len(hashes), _STEP)), len(full))
    mixed = hashes & np.uint64((1 << 63) - 1)
    for part in out:
        mixed = _mixed(mixed)
        ones = np.zeros((len(full), 64), np.int64)
        for low, high in itertools.pairwise(np.unique(cuts).tolist()):  # whole rows, of about _STEP hashes
            a, b = int(at[full[low]]), int(at[full[high - 1] + 1])
            for x in range(a, b, 16 * _STEP):  # one long row may span many
                y = min(x + 16 * _STEP, b)
                bits = np.unpackbits(mixed[x:y].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                i, j = np.searchsorted(at[full], x, "right") - 1, np.searchsorted(at[full], y, "left")
                ones[i:j] += np.add.reduceat(bits, np.maximum(at[full[i:j]], x) - x, axis=0, dtype=np.int64)
        part[full] = np.packbits(ones > half, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def prefix_members(sets: DataFrame, similarity: float) -> DataFrame:
    """(shard, doc_id, hot): a shard is the sets that share a prefix hash and are near in size, two or more. Every pair that can be alike is in one. hot: there are over PIECE_SETS."""
    total = sets.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    count = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(count, math.ceil(total / 8 / BUCKET_HASHES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, prefix = (batch.column(k) for k in range(3))
            lengths = np.asarray(pa.compute.binary_length(prefix)).astype(np.int64) // 8
            hashes = np.frombuffer(b"".join(prefix.to_pylist()), "<u8")
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            row = np.repeat(np.arange(len(lengths)), lengths)[order]
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(cuts))
            parts = [hashes[order], np.asarray(ids).astype("<i8")[row], np.asarray(n).astype("<i8")[row]]
            packed = [pa.array([x[cuts[b] : cuts[b + 1]].tobytes() for b in some], pa.binary()) for x in parts]
            yield pa.RecordBatch.from_arrays([pa.array(some), *packed], names=["bucket", "hash", "id", "n"])

    def give(held: list) -> pa.RecordBatch:
        h, ids, n = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*held, strict=True), ("<u8", "<i8", "<i8"), strict=True))
        order = np.lexsort((ids, n, h))
        h, ids, n = h[order], ids[order], n[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (n[:-1] < similarity * n[1:] - _SLACK)
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(h)))
        heads, sizes = heads[sizes > 1], sizes[sizes > 1]
        # shards of the same sets are one
        member = gather_runs(heads, sizes)
        sums = np.add.reduceat(_mixed(ids[member].view(np.uint64)), np.cumsum(sizes) - sizes) if len(heads) else np.zeros(0, np.uint64)
        _, some = np.unique(sums, return_index=True)
        heads, sizes = heads[some], sizes[some]
        shard = _mixed(h[heads] + n[heads].view(np.uint64)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(shard, sizes)), pa.array(ids[gather_runs(heads, sizes)]), pa.array(np.repeat(sizes > PIECE_SETS, sizes))], names=["shard", "doc_id", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None
        for batch in batches:
            for b, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != of and held:
                    yield give(held)
                    held = []
                of = b
                held.append(parts)
        if held:
            yield give(held)

    dealt = sets.select("doc_id", "n", "prefix").mapInArrow(lean(deal), "bucket long, hash binary, id binary, n binary")
    return dealt.repartition(count, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(run), "shard long, doc_id long, hot boolean")


def candidate_links(sets: DataFrame, shards: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that span, within each shard, the classes of sets whose fingerprints are within radius of each other, found by the shard's BK-tree.

    A shard is narrow: 48 bytes a set. Of one with many sets those near its first are linked at once, as copies are; the rest are searched. Of hot shards each set first meets
    the shard's first one, in a join; then those that are not near it are the queries, in pieces of PIECE_SETS, and each piece of them meets the tree of each piece of the shard. So a task's unit has two pieces, whatever the shard's size,
    and a shard of copies of one text has no queries left.
    """
    names = [f"p{k}" for k in range(COPY_PARTS)]
    shards = stage(shards, "shards")
    prints = sets.select("doc_id", *names)
    cold = shards.filter("not hot").join(prints, "doc_id").select("shard", F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("side"), "doc_id", *names)

    hot = stage(shards.filter("hot").join(prints, "doc_id").select("shard", "doc_id", *names), "hot")
    first = hot.groupBy("shard").agg(F.min_by(F.struct("doc_id", *[F.col(p).alias(f"q{p}") for p in names]), "doc_id").alias("f")).select(F.col("shard").alias("of"), F.col("f.doc_id").alias("first"), *[f"f.q{p}" for p in names])
    gap = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"q{p}"))) for p in names), F.lit(0))
    met = stage(hot.join(first, F.col("shard") == F.col("of")).select("shard", "doc_id", *names, "first", (gap <= radius).alias("near")), "met", replaces=hot)
    led = met.filter("near and doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    pieces = lambda n: F.ceil(n / PIECE_SETS).cast("int")
    cut = met.groupBy("shard").agg(pieces(F.count("*")).alias("trees"), pieces(F.count_if(~F.col("near"))).alias("asks")).filter("asks > 0").select(F.col("shard").alias("of"), "trees", "asks")
    placed = met.join(cut, F.col("shard") == F.col("of"))
    piece = lambda n, seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    trees = placed.select("shard", piece("trees", 1).alias("low"), every("asks").alias("high"), F.lit(0).alias("side"), "doc_id", *names)
    asks = placed.filter("not near").select("shard", every("trees").alias("low"), piece("asks", 2).alias("high"), F.lit(1).alias("side"), "doc_id", *names)
    return led.unionByName(_tree_links(cold, radius)).unionByName(_tree_links(trees.unionByName(asks), radius))


def _tree_links(units: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of the units (shard, low, high) of rows with side, doc_id and fingerprint: of side 1's rows with side 0's, or where there is no side 1 of all."""
    count = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["shard", "low", "high"]
    keyed = units.repartition(count, *keys).sortWithinPartitions(*keys, "side", "doc_id")

    def give(rows: np.ndarray) -> pa.RecordBatch:
        groups = np.cumsum(np.concatenate([[False], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]))
        a, b = link_rows(groups, rows[:, 3], np.ascontiguousarray(rows[:, 5:]).view(np.uint64), radius)
        both = np.unique(np.stack([rows[a, 4], rows[b, 4]], axis=1), axis=0)
        both = both[both[:, 0] != both[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            held.append(np.stack([np.asarray(c).astype(np.int64) for c in batch.columns], axis=1))
            size += batch.num_rows
            if size >= 100_000:  # all whole units so far; the last one may go on
                rows = np.concatenate(held)
                if cut := int(np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1)).max(initial=-1)) + 1:
                    yield give(rows[:cut])
                held, size = [rows[cut:]], len(rows) - cut
        if size:
            yield give(np.concatenate(held))

    return keyed.mapInArrow(lean(run), "a long, b long")


def alike_links(hashes: np.ndarray, at: np.ndarray, groups: np.ndarray, crossed: np.ndarray, side: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (a, b) that span the classes of rows at least `similarity` alike within each group; where `crossed`, of rows of two sides only.

    hashes[at[i]:at[i + 1]]: row i's set, ascending. A row is compared with the earlier ones that share a prefix hash, those that share most first, until each
    of them is in its class or has failed: a failed neighbour costs no other one, and members of one class are not compared again.
    """
    n = np.diff(at)
    token = np.unique(hashes, return_inverse=True)[1]
    take = prefix_lengths(n, similarity)
    shown, row = token[gather_runs(at[:-1], take)], np.repeat(np.arange(len(n)), take)
    order = np.argsort(shown, kind="stable")
    by = row[order]  # rows of each token, ascending
    head = np.searchsorted(shown[order], shown)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    first = np.concatenate([[0], np.cumsum(take)])
    labels, mark, out = np.arange(len(n)), np.zeros(len(token) + 1, bool), []
    for x in range(len(n)):
        low = head[first[x] : first[x + 1]]
        other, shared = np.unique(by[gather_runs(low, place[first[x] : first[x + 1]] - low)], return_counts=True)
        fit = (groups[other] == groups[x]) & (np.minimum(n[other], n[x]) >= similarity * np.maximum(n[other], n[x]) - _SLACK) & ((side[other] != side[x]) | ~crossed[x])
        other = other[fit][np.argsort(-shared[fit], kind="stable")]
        other = other[labels[other] != labels[x]]
        if not len(other):
            continue
        mark[token[at[x] : at[x + 1]]] = True
        step = 1
        while len(other):
            ask, other = other[:step], other[step:]
            step = min(4 * step, max(1, PIECE_SHINGLES // int(n[x])))
            hit = mark[token[gather_runs(at[ask], n[ask])]]
            both = np.add.reduceat(hit, np.cumsum(n[ask]) - n[ask], dtype=np.int64)
            for y in ask[both / (n[ask] + n[x] - both) >= similarity]:
                if labels[y] != labels[x]:
                    out.append((x, int(y)))
                    labels[labels == labels[x]] = labels[y]
            other = other[labels[other] != labels[x]]
        mark[token[at[x] : at[x + 1]]] = False
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def copy_links(rows: DataFrame, members: DataFrame, words: int, similarity: float, tree_size: int, common) -> DataFrame:
    """Links (a, b) that span the classes of copies among the members (doc_id, root, n), each root a candidate group; groups over the bounds go in pieces, each with itself and each other."""
    sizes = members.groupBy("root").agg(F.count("*").alias("texts"), F.sum("n").alias("all"))
    hot = sizes.select("root", F.greatest(F.ceil(F.col("texts") / tree_size), F.ceil(F.col("all") / PIECE_SHINGLES)).cast("int").alias("pieces")).filter("pieces > 1")
    units = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda o: F.struct(F.least(F.col("piece"), o).alias("low"), F.greatest(F.col("piece"), o).alias("high"), (F.col("piece") > o).cast("int").alias("side")))
    placed = members.join(hot, "root", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1))).withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("int"))
    placed = stage(placed.select("doc_id", "root", F.explode(units).alias("u")).select("doc_id", "root", "u.*"), "units")
    some, _ = split_by_marks(rows, marks_of(placed))  # of the texts only those of members move
    texts = some.join(placed, "doc_id").select("root", "low", "high", "side", "doc_id", "text")
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = texts.repartition(count, "root", "low", "high").sortWithinPartitions("root", "low", "high", "side", "doc_id")

    def give(table: pa.Table) -> pa.RecordBatch:
        root, low, high, side, ids = (np.asarray(table.column(k)) for k in range(5))
        found, ends = [], [np.zeros(1, np.int64)]
        for chunk in table.column(5).chunks:
            for i, j in row_runs(chunk):
                h, at = shingle_sets(*text_buffer(chunk.slice(i, j - i)), words, common.value)
                found.append(h)
                ends.append(at[1:] + ends[-1][-1])
        new = np.zeros(len(root), np.int64)
        new[1:] = (root[1:] != root[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        a, b = alike_links(np.concatenate(found), np.concatenate(ends), np.cumsum(new), low != high, side, similarity)
        return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i, j in row_runs(batch.column(5)):
                held.append(batch.slice(i, j - i))
                size += j - i
                key = [np.concatenate([np.asarray(x.column(k)) for x in held]) for k in range(3)] if size >= 2000 else None
                if key is not None:  # all whole groups so far; the last one may go on
                    cut = int(np.flatnonzero(np.any([k != k[-1] for k in key], axis=0)).max(initial=-1)) + 1
                    if cut:
                        table = pa.Table.from_batches(held)
                        yield give(table.slice(0, cut))
                        held = table.slice(cut).to_batches()
                        size -= cut
        if size:
            yield give(pa.Table.from_batches(held))

    return texts.mapInArrow(lean(check), "a long, b long")


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = COPY_WORDS, similarity: float = COPY_SIMILARITY, tree_size: int = PIECE_TEXTS) -> DataFrame:
    """doc_id and component_id (the smallest doc_id of its group) of every row with an id: groups of texts whose shingle sets are at least `similarity` alike, directly or over others.

    The trees are those of shards: two sets that are alike enough share one of the smallest hashes of each (`prefix_lengths`), so both are in one shard, whatever the corpus. A
    shard's BK-tree links sets whose fingerprints are within COPY_RADIUS; a component of those links is a candidate group, and there every pair that shares such a hash is
    compared on the whole sets of 63-bit shingle hashes until both are in one class. So only the fingerprint can miss a pair, with the chance stated at COPY_RADIUS.
    The order in which hashes count as smallest puts common shingles last, so that shards stay small; a candidate group over the bounds is searched in pieces.
    Equal sets are one point. Rows without an id are left out; null and wordless texts are alike. Texts go whole. Columns besides the two are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).filter("doc_id is not null")
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(rows, words))
    prints = stage(copy_sets(rows, words, similarity, common), "prints")
    points = stage(prints.groupBy("fp", "fp1").agg(F.min("doc_id").alias("low")), "points")
    sets = prints.join(points.select("fp", "fp1", F.col("low").alias("doc_id")), ["fp", "fp1", "doc_id"], "left_semi")
    candidates = star_labels(candidate_links(sets, prefix_members(sets, similarity), COPY_RADIUS))
    members = candidates.union(candidates.select("root", "root").distinct()).select(F.col("node").alias("doc_id"), "root")
    members = members.join(prints.groupBy("doc_id").agg(F.max("n").alias("n")), "doc_id")
    labels = star_labels(copy_links(rows, members, words, similarity, tree_size, common))
    known = points.join(labels.withColumnRenamed("node", "low"), "low", "left").select("fp", "fp1", F.coalesce("root", "low").alias("component_id"))
    return prints.select("doc_id", "fp", "fp1").join(known, ["fp", "fp1"]).select("doc_id", "component_id")


def drop_copies(docs: DataFrame, *, text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, all columns as they are, but for those whose doc_id is in a group of `near_copies` with a smaller one.

    Rows without an id stay; ids are taken as keys, so rows that repeat an id stay or go together. An empty table gives no rows.
    """
    classes = near_copies(docs, text_col=text_col, **how)
    gone = stage(classes.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "gone")
    asked, others = split_by_marks(docs, marks_of(gone))
    return others.unionByName(asked.join(gone, "doc_id", "left_anti").select(*docs.columns))
