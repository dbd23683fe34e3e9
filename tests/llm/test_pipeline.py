import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from siftkite.llm import pii
from test_decontam import brute
from test_simhash import brute_copies

BENCH = "the quick brown fox jumps over the lazy dog while seven wizards watch"


def docs_of():
    base = "some words that make a text long enough to be told from every other one number {}"
    rows = [(i, base.format(chr(97 + i) * 9 + " " + " ".join(chr(98 + i + k % 7) * (k % 5 + 1) for k in range(30))), "en", "s", 0) for i in range(8)]
    rows += [(20, rows[2][1], "en", "s", 0), (21, rows[2][1].upper(), "en", "s", 0), (22, "123 --", "en", "s", 0), (23, None, None, "s", 0)]
    rows += [(24, "we saw that The quick brown fox jumps over the lazy dog, while seven wizards watch it", "en", "s", 0), (25, "mail me: some.body@mail.example.org or call +1 (523) 555-1055 at once", "en", None, 0)]
    near = rows[5][1].split()
    rows += [(26, " ".join([*near, "and", "more"]), "en", "s", 0), (27, " ".join([*near[: len(near) // 2], *"quite another end of it all that goes on for long".split()]), "en", "s", 0), (28, "é ü " * 20_000, "fr", "s", 0)]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s, _ in rows]


def brute_pieces(rows):
    tokenizer, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), set()
    for i, t, *_ in rows:
        n, start = len(tokenizer.encode(t, add_special_tokens=False).ids) + 1, 0
        while start < n:
            length = min(2048, 1 << (n - start).bit_length() - 1)
            out.add((i, start, length, n))
            start += length
    return out


def test_stages_and_run(spark, tmp_path):
    rows = docs_of()
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "decontaminate", "personal_data", "packing"]

    want = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    docs = stages["language_id"](spark, docs, folder)
    assert sorted(map(tuple, docs.collect())) == sorted(want, key=lambda r: r[0])

    first = brute_copies({r[0]: r[1] for r in want})
    want = [r for r in want if first[r[0]] == r[0]]
    assert {20, 21, 26}.isdisjoint(r[0] for r in want) and 27 in {r[0] for r in want}
    docs = stages["near_dedup"](spark, docs, folder)
    assert sorted(r.doc_id for r in docs.collect()) == sorted(r[0] for r in want)

    want = [r for r in want if brute(BENCH, r[1].lower()) > len(BENCH) * 0.05]
    docs = stages["decontaminate"](spark, docs, folder)
    assert sorted(r.doc_id for r in docs.collect()) == sorted(r[0] for r in want) and 24 not in {r[0] for r in want}

    model = pii.SemiCrf(pii.trained())
    want = [(i, pii.mask(t, pii.spans_of(t, model)[1]), lang, s) for i, t, lang, s, _ in want]
    docs = stages["personal_data"](spark, docs, folder)
    assert docs.columns == corpus_pipeline.COLUMNS
    assert sorted(map(tuple, docs.collect()), key=lambda r: r[0]) == sorted(((*r, len(r[1])) for r in want), key=lambda r: r[0])
    assert "mail me: [EMAIL] or call [PHONE] at once" in {r[1] for r in want}

    out = stages["packing"](spark, docs, folder)
    assert {(r.doc_id, r.start, r.length, r.doc_tokens) for r in out.collect()} == brute_pieces(want)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert {(r.doc_id, r.start, r.length, r.doc_tokens) for r in whole} == brute_pieces(want)


def test_stages_with_null_ids_repeats_and_no_rows(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    words = " ".join(f"w{k * k}x" for k in range(60))
    rows = [(None, words, "en", "s", 1, "e"), (None, words, None, None, None, "e"), (7, words + " end", "en", "s", 1, "e"), (7, words + " end", "en", "s", 1, "e"), (9, "alone here", "en", "s", 1, "e"), (3, None, "en", "s", None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _hit string").repartition(2)
    left = {"language_id": [None, None, 7, 7, 9], "near_dedup": [None, None, 3, 7, 7, 9], "decontaminate": [None, None, 3, 7, 7, 9], "personal_data": [None, None, 3, 7, 7, 9]}
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, folder), stage(spark, docs.limit(0), folder)
        assert none.count() == 0
        if name in left:
            assert out.columns == none.columns == corpus_pipeline.COLUMNS
            assert sorted((r.doc_id for r in out.collect()), key=lambda i: -1 if i is None else i) == left[name]
        else:
            assert sum(r.length for r in out.collect()) > 0
