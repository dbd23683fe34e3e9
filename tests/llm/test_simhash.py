import itertools
import random

import numpy as np
import pytest
import xxhash

from siftkite.llm import simhash


def brute_fingerprint(text, words=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    got = [w for w in lower.split(" ") if w]
    grams = [" ".join(got[i : i + words]) for i in range(len(got) - words + 1)] or ([" ".join(got)] if got else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points, radius=3):
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in itertools.combinations(points, 2):
        if (a ^ b).bit_count() <= radius:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {p: find(p) for p in points}


def clustered(n, seed):
    rng = random.Random(seed)
    points = {rng.getrandbits(64) for _ in range(n)}
    for p in list(points)[: n // 3]:
        for _ in range(6):
            p ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            points.add(p)
    return list(points)


def test_forest_finds_what_brute_force_finds():
    points = np.array(clustered(300, 1), np.uint64)[:, None]
    groups = np.sort(np.random.default_rng(2).integers(0, 5, len(points)))
    a, b = simhash.links_of(groups, np.zeros(len(points), int), points, 3, work=500)
    want = set()
    for g in range(5):
        own = [int(p) for p in points[groups == g, 0]]
        classes = {}
        for p, r in brute_components(own).items():
            classes.setdefault(r, set()).add(p)
        want |= {frozenset(c) for c in classes.values() if len(c) > 1}
    got = brute_classes(zip(a[:, 0].tolist(), b[:, 0].tolist(), strict=True))
    assert got == want


def brute_classes(links):
    sets = []
    for a, b in links:
        hit = [s for s in sets if a in s or b in s]
        sets = [s for s in sets if s not in hit] + [set().union({a, b}, *hit)]
    return {frozenset(s) for s in sets}


def test_shards_lose_no_link(spark):
    points = clustered(400, 3)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in points]
    for size in (20_000, 4):  # 4: every larger shard is cut into pieces
        links = simhash.near_links(spark.createDataFrame(signed, "fp long"), tree_size=size)
        got = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.star_labels(links).collect()}
        want = brute_components(points)
        classes = lambda root: {frozenset(p for p in points if root(p) == r) for r in map(root, points)}
        assert classes(lambda p: got.get(p, p)) == classes(want.get)


def test_long_chain(spark):
    chain = [(1 << i) - 1 for i in range(0, 63, 3)]
    labels = simhash.star_labels(simhash.near_links(spark.createDataFrame([(p,) for p in chain], "fp long")))
    assert {r.node: r.root for r in labels.collect()} == {p: 0 for p in chain[1:]}


def test_documents(spark):
    long = " ".join(f"w{i * i % 997}" for i in range(3000))
    texts = ["The cat sat on the mat", "the CAT\tsat \n on the mat ", "the cat sat", None, "", " ", "a b", "a  B", long, long + " end", "naïve Éa É", "x" * 300_000, "Other words\x0bfill this one"]
    rows = [(i + 10, t, "n", i) for i, t in enumerate(texts)] + [(None, "no id here at all", "n", 0), (5, "a b", "n", 0), (5, "a b", "n", 0)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")).collect()
    assert len(out) == len(rows)
    prints = {}
    for i, t, *_ in rows:
        prints.setdefault(brute_fingerprint(t), []).append(i)
    root = brute_components(list(prints))
    for r in out:
        f = int(r.fingerprint, 16)
        assert r.doc_id in prints[f] and len(r.fingerprint) == 16
        ids = [i for g in prints if root[g] == root[f] for i in prints[g] if i is not None]
        assert r.component_id == min(ids, default=None)
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_groups_of_copies():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, (3, 4)).astype(np.uint64)
    points = base[rng.integers(0, 3, 900)]
    points[:, 0] ^= np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)  # up to two bits apart within a copy group
    groups = np.sort(rng.integers(0, 3, 900))
    a, b = simhash.link_rows(groups, np.zeros(900, int), points, 5, work=5000)
    root = {i: i for i in range(900)}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        root[x] = y
    want = {}
    for i in range(900):
        want.setdefault((groups[i], *points[i, 1:].tolist()), i)
    assert all(root[i] == want[(groups[i], *points[i, 1:].tolist())] for i in range(900))


def test_set_prints():
    rng = np.random.default_rng(2)
    sizes = [0, 1, 5, 0, 3000, 2, 140_000, 7]
    at = np.concatenate([[0], np.cumsum(sizes)])
    hashes = rng.integers(0, 1 << 63, at[-1]).astype(np.uint64)
    got = simhash.set_prints(hashes, at)
    for row, n in enumerate(sizes):
        own = hashes[at[row] : at[row + 1]]
        for part in got:
            own = simhash._mixed(own)
            bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) if n else np.zeros(64, np.int64)
            assert int(part[row]) == sum(1 << b for b in range(64) if 2 * bits[b] > n)


def test_near_copies(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for g in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(120, 300))]
        rows.append((g * 10, " ".join(words), "c"))
        want[g * 10] = g * 10
        for c in range(1, 4):  # one to three words changed: five to fifteen shingles of over a hundred
            own = list(words)
            for i in rng.sample(range(len(own)), min(c, len(own) // 100)):
                own[i] = "changed"
            rows.append((g * 10 + c, " ".join(own).upper() if c == 2 else " ".join(own), "c"))
            want[g * 10 + c] = g * 10
        half = words[: len(words) // 2] + [f"z{rng.randrange(10**6)}" for _ in range(len(words) // 2)]
        rows.append((g * 10 + 5, " ".join(half), "c"))  # a third alike: no copy
        want[g * 10 + 5] = g * 10 + 5
    rows += [(900, None, "c"), (901, "", "c"), (902, "a b", "c"), (903, "A  b", "c"), (None, "a b", "c"), (904, "x" * 100_000, "c")]
    want |= {900: 900, 901: 900, 902: 902, 903: 902, 904: 904}
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").repartition(3)
    for size in (simhash.TREE_SIZE, 3):
        assert {r.doc_id: r.component_id for r in simhash.near_copies(df, tree_size=size).collect()} == want
    assert simhash.near_copies(df.limit(0)).count() == 0


def brute_copies(texts, words=5, similarity=0.8):
    """Smallest id of each id's group, by comparing all pairs."""
    sets = {i: {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} for i, w in ((i, t.lower().split()) for i, t in texts.items())}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) >= similarity * max(len(x), len(y)) - 1e-9 and len(x & y) / len(x | y) >= similarity:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("hot", [2_000, 30])
def test_copies_of_one_base_meet_it(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "PIECE_SETS", hot)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(204)]
    texts = {500: " ".join(base)}
    for c in range(400):  # each 0.8 alike or more to the base, most of them less than that to each other
        own = list(base)
        for i in rng.sample(range(len(own)), 4):
            own[i] = f"z{rng.randrange(10**6)}"
        texts[c] = " ".join(own)
    want = brute_copies(texts)
    assert sum(r == 0 for r in want.values()) > 390
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for size in (simhash.PIECE_TEXTS, 50):
        assert {r.doc_id: r.component_id for r in simhash.near_copies(df, tree_size=size).collect()} == want


@pytest.mark.parametrize("marks", ["none", "half", "all"])
def test_copies_do_not_depend_on_the_map_of_common_shingles(spark, sf, monkeypatch, marks):
    """The map comes from a sample of the texts and sets only the order of a text's hashes, so that shards are small: the groups are those of all pairs under any map."""
    size = simhash.COMMON_BITS // 8
    made = {"none": np.zeros(size, np.uint8), "half": np.random.default_rng(1).integers(0, 256, size, dtype=np.uint8), "all": np.full(size, 255, np.uint8)}[marks]
    monkeypatch.setattr(simhash, "common_shingles", lambda rows, words: made)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = brute_copies({r.doc_id: r.text or "" for r in docs.collect()})
    assert {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()} == want and len(set(want.values())) < len(want)


def test_no_pair_just_alike_is_missed(spark):
    rng = random.Random(8)
    texts = {}
    for g in range(150):  # 89 of 111 shingles in common: 0.802
        words = [f"w{rng.randrange(10**6)}" for _ in range(115)]
        texts |= {2 * g: " ".join(words[:104]), 2 * g + 1: " ".join(words[11:])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()} == {i: i - i % 2 for i in texts}


def test_a_hot_shard_of_unrelated_sets_and_copies(spark, monkeypatch):
    """Sets that share nothing but a shard, a group of copies among them and pairs beyond the first one's reach: the links are those of all pairs, in units of two pieces."""
    monkeypatch.setattr(simhash, "PIECE_SETS", 50)
    rng = np.random.default_rng(9)
    points = rng.integers(0, 1 << 63, (400, 4)).astype(np.uint64)
    points[300:] = points[rng.integers(0, 3, 100)]
    points[:, 1] ^= np.uint64(1) << rng.integers(0, 63, 400).astype(np.uint64)
    ids = rng.permutation(400)
    names = [f"p{k}" for k in range(4)]
    sets = spark.createDataFrame([(int(i), *[int(x) for x in p.view(np.int64)]) for i, p in zip(ids, points, strict=True)], ["doc_id", *names])
    for hot in (True, False):
        shards = spark.createDataFrame([(7, int(i), hot) for i in ids] + [(8, int(i), False) for i in ids[:5]], "shard long, doc_id long, hot boolean")
        got = {r.node: r.root for r in simhash.star_labels(simhash.candidate_links(sets, shards, 92)).collect()}
        root = {int(i): int(i) for i in ids}

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for a in range(400):
            for b in np.flatnonzero(np.bitwise_count(points ^ points[a]).sum(axis=1) <= 92):
                low, high = sorted((find(int(ids[a])), find(int(ids[b]))))
                root[high] = low
        assert got == {i: find(i) for i in root if find(i) != i} and len(got) > 90
