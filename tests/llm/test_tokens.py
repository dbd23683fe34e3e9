import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from siftkite.llm import records
from siftkite.llm.packing import binary_lengths, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
def thue_morse(n, a="a", b="b"):
    """Words that polynomial hashes of 64 bits give one value, from 1024 letters on."""
    return "".join(a if i.bit_count() % 2 else b for i in range(n))


TEXTS = [f"{thue_morse(1024)} {thue_morse(1024, 'b', 'a')}", f"{thue_morse(2048)} x {thue_morse(2048, 'b', 'a')}", "Hello, World's end.", None, "", " \t\n", "a" * 300_000, "Don't <|endoftext|> <|ENDOFTEXT|>x ÀÉÑ éá Σίσυφος ΣΑΣ 日本語 12,345 ª µm a\x85b \x1c", "same words here " * 900, "same words here " * 900]


def expected(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, length int")


def test_frames_find_damage():
    data = records.frame(b"abc") + records.frame(b"")
    payload, at = records.unframe(data)
    assert (payload, records.unframe(data, at)) == (b"abc", (b"", len(data)))
    for i in range(len(data)):
        with pytest.raises(ValueError):
            bad = bytearray(data)
            bad[i] ^= 1
            _, at = records.unframe(bytes(bad))
            records.unframe(bytes(bad), at)


def test_records_round_trip(spark):
    rows = [(i * 7 % 10, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "twice"), (3, "twice")]
    folder = records.scratch(spark, "test")
    manifest = records.write_records(table(spark, rows), folder, PATH, shards=3)
    out = records.read_records(manifest, 2, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in out] == sorted([r[0] for r in rows], key=lambda x: -1 if x is None else x)
    at = 0
    left = sorted(((-1 if i is None else i), expected(t)) for i, t in rows)
    for r in out:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), crc(r.ids))
        at += r.n_tokens
    assert sorted(((-1 if r.doc_id is None else r.doc_id), list(r.ids)) for r in out) == left
    shard = manifest.orderBy("shard").first()
    assert [x[1] for x in records.read_shard(shard.path, 1, 1)] == [x[1] for x in records.read_shard(shard.path)][1:2]


def test_empty_tables(spark):
    empty = table(spark, []).limit(0)
    assert records.write_and_read(empty, PATH).count() == 0
    assert pack_documents(empty, PATH).count() == 0


def test_binary_lengths():
    for n in range(1, 5000, 7):
        cut = binary_lengths(n, 2048)
        assert sum(cut) == n and cut == sorted(cut, reverse=True) and all(x & (x - 1) == 0 and x <= 2048 for x in cut)
        assert len({x for x in cut if x < 2048}) == len([x for x in cut if x < 2048])


def test_packing(spark):
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (3, "twice"), (3, "twice")]
    out = pack_documents(table(spark, rows).repartition(3), PATH, with_ids=True).collect()
    assert sorted(r.sequence_id for r in out) == list(range(len(out))) and {r.offset for r in out} == {0}
    assert [r.length for r in sorted(out, key=lambda r: r.sequence_id)] == sorted((r.length for r in out), reverse=True)
    for i, t in enumerate(TEXTS):
        if i != 3:
            pieces = sorted((r for r in out if r.doc_id == i), key=lambda r: r.start)
            assert [x for r in pieces for x in r.ids] == expected(t)
            assert [r.length for r in pieces] == binary_lengths(pieces[0].doc_tokens, 2048)
            assert all(crc(r.ids) == r.ids_crc32 and len(r.ids) == r.length for r in pieces)
    assert sum(r.length for r in out) == sum(len(expected(t)) for _, t in rows)


def test_words_learned_together_have_the_ids_of_each_alone():
    from siftkite.llm.tokens import WordEncoder

    rng = random.Random(5)
    words = sorted({"".join(rng.choice(["a", "the", "ß", "É", "ÿ", "9", "10", ".", "!!", "<", "_"]) for _ in range(rng.randrange(1, 6))) for _ in range(3000)} | {"<|endoftext|>", "it's", "日本", "×", "µ", "a\x85b", "`´"})
    encoder, whole = WordEncoder(PATH), Tokenizer.from_file(PATH)
    wanted = {w: whole.encode(w, add_special_tokens=False).ids for w in words}
    for some in (words, words[:1], [w for w in words if w.isascii() and "'" not in w and "<|" not in w], ["日本"]):
        encoder.reset()
        encoder.learn([w.encode() for w in some])
        got = [encoder.pool[a : a + n].tolist() for a, n in zip(encoder.at, encoder.count[: len(some)])]
        assert got == [wanted[w] for w in some]
    ids, count = encoder.plain_ids(["the9", "it.", "the9"])  # all in one call
    assert ids.tolist() == wanted_ids(whole, "the9 it. the9") and count.sum() == len(ids) and count[0] == count[2]


def wanted_ids(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids
