import struct
import zlib
from collections import Counter
from fractions import Fraction

import xxhash

from siftkite.llm import sharding


def make(spark, n):
    rows = [(i, f"text {i}é", "hot" if i % 3 else f"s{i % 5}", "x") for i in range(n)]
    rows += [(n, None, None, "x"), (n + 1, "", "rare", "x"), (None, "z" * 200_000, None, "x"), (3, "again", "hot", "x"), (3, "again", "hot", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, shard string").repartition(3), rows


def test_every_shard_matches_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 16)
    docs, rows = make(spark, 400)
    out = sharding.stratified_shards(docs, shards=7).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    by = {k: sorted(r.slot for r in out if r.shard == k) for k in range(7)}
    assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    source = {r[0]: r[2] for r in rows}
    for s, n in Counter(r[2] for r in rows).items():
        for k in range(7):
            assert abs(sum(source[r.doc_id] == s for r in out if r.shard == k) - n / 7) <= 2
    again = sharding.stratified_shards(docs.repartition(5), shards=7).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    assert Counter(map(tuple, out)) != Counter(map(tuple, sharding.stratified_shards(docs, shards=7, seed=1).collect()))


def brute_shards(rows, shards, seed):
    """The definition in one place: rows shuffled by a seeded hash and ranked within their source, sorted by fractional rank, cut into equal shards."""

    def shuffled(i, crc, size):
        h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
        for x in ([] if i is None else [i]) + [crc, size]:
            h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
        return h - (1 << 64) if h >> 63 else h

    made = {}
    for i, t, source, _ in rows:
        data = (t or "").encode()
        crc, size = zlib.crc32(data), len(data) + 1
        h = shuffled(i, crc, size)
        made.setdefault(source, []).append((h % (1 << 64), h, i is not None, i or 0, crc, size))
    order = []
    for source, own in made.items():
        for rank, (_, h, known, i, crc, size) in enumerate(sorted(own)):
            order.append((Fraction(2 * rank + 1, 2 * len(own)), source is not None, source or "", h, known, i, crc, size))
    out, slots = [], Counter()
    for at, (*_, known, i, crc, size) in enumerate(sorted(order)):
        shard = at * shards // len(order)
        out.append((i if known else None, size, crc, shard, slots[shard]))
        slots[shard] += 1
    return Counter(out)


def test_the_order_is_that_of_the_definition(spark, monkeypatch):
    docs, rows = make(spark, 300)
    want = brute_shards(rows, 5, 20)
    for size in (8, 100_000):
        monkeypatch.setattr(sharding, "BUCKET_ROWS", size)
        assert Counter(map(tuple, sharding.stratified_shards(docs, shards=5).collect())) == want


def test_few_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert sharding.stratified_shards(empty).count() == 0
    two = spark.createDataFrame([(1, "a", "s"), (2, "b", "t")], "doc_id long, text string, source string")
    placed = sharding.stratified_shards(two)
    assert [r.slot for r in placed.collect()] == [0, 0]
    sharding.write_shards(two, placed, str(tmp_path / "out"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("doc_id", "text", "source").collect()} == {(1, "a", "s"), (2, "b", "t")}
