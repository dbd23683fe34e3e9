"""Language-model scoring: a byte PPM and a word unigram, both learned from all training documents.

What is learned is a table of words and a table of grams (a context of ORDER bytes and the byte after it), each as large as the corpus makes it. No task and no
driver holds either: documents are dealt into blocks, a block sends each of its words and grams once, and what is known of them all comes back to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftkite.llm import ppm
from siftkite.llm.common import distinct_words, drop_staged, give_back, held_out, lean, row_runs, stage, text_buffer

#: Bytes of context. A gram fits a long up to 7.
ORDER = 4
#: Text bytes of a block. A block's words and grams are looked up together.
BLOCK_BYTES = 32 << 20
#: Grams that are priced together at least; whole groups of one two-byte context.
_PRICED = 1 << 20


def _plain_runs(texts: pa.Array):
    for low, high in row_runs(texts):
        yield low, high, ppm.plain_rows(*text_buffer(texts.slice(low, high - low)))


def word_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """95 bits of each word's BLAKE2b digest, as a long and an int that is not negative. Two words that share them would be a collision of that hash."""
    raw = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=12).digest() for w in words), np.uint8).reshape(-1, 12)
    return np.ascontiguousarray(raw[:, :8]).view("<i8")[:, 0], np.ascontiguousarray(raw[:, 8:]).view("<i4")[:, 0] & 0x7FFFFFFF


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, which = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_inverse=True)
    return key, np.bincount(which, np.concatenate([np.zeros(0), *counts]), len(key)).astype(np.int64)


def asked(table: pa.Table) -> pa.Table:
    """What a block asks for: its distinct words (k0, k1) and grams (k0, k1 = -1), with how often its training documents have them (n)."""
    give_back()
    learns = np.asarray(table.column("held_out").combine_chunks().cast(pa.uint8())) == 0
    words: dict[bytes, int] = {}
    grams, times = [], []
    for low, high, (buf, rows, starts, ends) in _plain_runs(table.column("text").combine_chunks()):
        own, which = distinct_words(buf, starts, ends)
        taught = np.repeat(learns[low:high], np.diff(np.searchsorted(starts, rows)))
        for w, n in zip(own, np.bincount(which[taught], minlength=len(own)).tolist(), strict=True):
            words[w] = words.get(w, 0) + n
        held = np.repeat(~learns[low:high], np.diff(rows)).astype(np.uint64)
        gram, n = np.unique(ppm.grams(buf, rows, ORDER).astype(np.uint64) << np.uint64(1) | held, return_counts=True)
        n[(gram & np.uint64(1)) == 1] = 0
        gram, n = _summed([gram >> np.uint64(1)], [n])
        grams.append(gram)
        times.append(n)
    gram, n = _summed(grams, times)
    k0, k1 = word_keys(list(words))
    size = len(k0) + len(gram)
    block = np.full(size, table.column("block")[0].as_py(), np.int32)
    counts = np.concatenate([np.fromiter(words.values(), np.int64, len(words)), n])
    return pa.table({"block": block, "k0": np.concatenate([k0, gram.view(np.int64)]), "k1": np.concatenate([k1, np.full(len(gram), -1, np.int32)]), "n": counts})


def priced(totals: DataFrame) -> DataFrame:
    """(k0, v): -ln P of every gram of the totals (k0, n), by the counts of all of them.

    A task holds the grams of whole two-byte contexts: 2 ** 24 of one context at most, however large the corpus. The orders below are a table of
    65,536 counts at most, which every task gets.
    """
    spark = totals.sparkSession
    low = totals.filter("n > 0").groupBy(F.col("k0").bitwiseAND(F.lit(0xFFFF)).alias("gram")).agg(F.sum("n").alias("n")).toArrow().sort_by("gram")
    gram, n = (np.asarray(low.column(c).combine_chunks()).astype(np.int64) for c in ("gram", "n"))
    lowest = spark.sparkContext.broadcast(ppm.levels_of(gram.view(np.uint64), n, 1))

    def price(gram: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        gram = gram.view(np.uint64)
        trie = ppm.Trie([*lowest.value, *ppm.levels_of(gram[n > 0], n[n > 0], ORDER, 2)])
        return pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(trie.lengths(gram))], names=["k0", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
            size += batch.num_rows
            if size >= _PRICED:  # all whole groups so far; the last one may go on
                gram, n = (np.concatenate(x) for x in zip(*held, strict=True))
                group = gram >> 8 & 0xFFFF
                if cut := int(np.flatnonzero(group != group[-1]).max(initial=-1)) + 1:
                    yield price(gram[:cut], n[:cut])
                held, size = [(gram[cut:], n[cut:])], size - cut
        if size:
            yield price(*(np.concatenate(x) for x in zip(*held, strict=True)))

    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = F.shiftright("k0", 8).bitwiseAND(F.lit(0xFFFF)).alias("group")
    dealt = totals.select("k0", "n", group).repartition(count, "group").sortWithinPartitions("group").select("k0", "n")
    return dealt.mapInArrow(lean(run), "k0 long, v double")


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hold_out: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Tokens are lower-case (A-Z) words, then one end. base_score is the add-1/2 unigram's sum of log10 over them; score is the log10 probability that the
    byte PPM gives the words, joined by blanks, and the end. Both learn from all rows that are not held out (crc32(id as text) mod hold_out is 1; a null id is
    not). Null texts are empty: one token, the end. Texts go whole; one longer than a block is a block's share by itself. Repeated rows are learned from and returned as
    often as they occur; an empty table gives no rows. Columns besides the two are not read, whatever their names.

    Words are matched by 95 bits of a cryptographic hash, grams as they are. Counts meet by word and by gram, summed within a block first, so a word or gram
    that is everywhere sends one row for each block.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), held_out(id_col, hold_out).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text")), F.count_if(~F.col("held_out"))).first()
    blocks = max(1, -(-(size[0] or 0) // block_bytes))
    train_rows = size[1]
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(blocks)).cast("int"))

    sent = stage(blocked.select("block", "text", "held_out").groupBy("block").applyInArrow(asked, "block int, k0 long, k1 int, n long"), "asked")
    totals = stage(sent.groupBy("k0", "k1").agg(F.sum("n").alias("n")), "totals")
    counted = totals.filter("k1 >= 0").agg(F.sum("n"), F.count_if(F.col("n") > 0)).first()
    total, distinct = (counted[0] or 0) + train_rows, counted[1] + (train_rows > 0)
    whole = float(np.log10(total + 0.5 * (distinct + 1)))
    prices = priced(totals.filter("k1 < 0").select("k0", "n"))
    values = totals.filter("k1 >= 0").select("k0", "k1", F.col("n").cast("double").alias("v")).union(prices.select("k0", F.lit(-1).alias("k1"), "v"))
    answers = stage(sent.select("block", "k0", "k1").join(values, ["k0", "k1"]).select("block", "k0", "k1", "v"), "answers", replaces=sent)
    drop_staged(totals)

    def score(docs_of: pa.Table, told: pa.Table) -> pa.Table:
        give_back()
        k0, k1, v = (np.asarray(told.column(c).combine_chunks()) for c in ("k0", "k1", "v"))
        of_gram = k1 < 0
        gram, price = k0[of_gram].view(np.uint64), v[of_gram]
        places = ppm.Places(gram)
        order = np.lexsort((k1[~of_gram], k0[~of_gram]))
        k0, k1, c = k0[~of_gram][order], k1[~of_gram][order], v[~of_gram][order]
        log = np.log10(c + 0.5) - whole
        end = np.log10(train_rows + 0.5) - whole
        out = []
        for _, _, (buf, offsets, starts, ends) in _plain_runs(docs_of.column("text").combine_chunks()):
            words, which = distinct_words(buf, starts, ends)
            a, b = word_keys(words)
            at = np.searchsorted(k0, a)
            for _ in range(len(k0)):  # rarely more than once: k0 of two words alike
                apart = k1[at] != b if len(at) else np.zeros(0, bool)
                if not apart.any():
                    break
                at[apart] += 1
            span = np.searchsorted(starts, offsets)
            n = np.diff(span)
            base = ppm.row_sums(log[at][which], span) + end
            seen = ppm.row_sums((c[at] > 0)[which].astype(np.int64), span).astype(np.int64) + (train_rows > 0)
            own = -ppm.row_sums(price[places(ppm.grams(buf, offsets, ORDER).astype(np.uint64))], offsets) / np.log(10)
            out.append((n + 1, seen, base, own))
        tokens, seen, base, own = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"doc_id": docs_of.column("doc_id"), "held_out": docs_of.column("held_out"), "n_tokens": tokens, "n_known": seen, "train_tokens": np.full(len(tokens), total), "base_score": base, "score": own})

    def run(key: tuple, docs_of: pa.Table, told: pa.Table) -> pa.Table:
        return score(docs_of, told) if docs_of.num_rows else empty

    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    empty = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]).empty_table()
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, kinds)
