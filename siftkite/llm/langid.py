"""Language identification by prediction by partial matching: the language whose context tree codes the text shortest."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftkite.llm import ppm
from siftkite.llm.common import held_out, kept, lean, row_runs, stage, text_buffer

#: Documents of each language that the model learns from, chosen by a hash of the id (about so many where there are more). The bound of the sample.
SAMPLE_DOCUMENTS = 2000
#: Bytes of context.
ORDER = 3
UNKNOWN = "und"
#: Code lengths handled at once: each byte has one for each language.
_RUN = 4 << 20

_ASCII_LETTERS = np.zeros(256, bool)
_ASCII_LETTERS[65:91] = _ASCII_LETTERS[97:123] = True


def has_letter(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row has a letter of any script."""
    out = np.diff(np.searchsorted(np.flatnonzero(_ASCII_LETTERS[buf]), offsets)) > 0
    for i in np.flatnonzero(~out):
        out[i] = any(map(str.isalpha, buf[offsets[i] : offsets[i + 1]].tobytes().decode()))
    return out


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", hold_out: int | None = 3, sample: int = SAMPLE_DOCUMENTS) -> dict:
    """The model: languages, and each one's grams of ORDER + 1 bytes with their counts.

    Learns from rows with a language and a text (with hold_out, only those whose crc32(id as text) mod hold_out is not 1), from whole texts of about `sample`
    documents of each language. What comes to the driver is a count for each language and the counts of the grams that occur in the sample; the sample bounds both.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if hold_out:
        known = known.filter(~held_out(id_col, hold_out))
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # a row for each label
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).withColumn("lang_no", (F.row_number().over(Window.orderBy("lang")) - 1).cast("int"))
    sizes = stage(sizes, "languages")
    languages = [r.lang for r in sizes.orderBy("lang_no").collect()]
    model = {"id": uuid.uuid4().hex, "languages": languages, "grams": []}
    if not languages:
        return model
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(6), "id"), 34) < F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n")) * (1 << 30)
    chosen = known.join(sizes, "lang").filter(drawn).select("lang_no", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.asarray(batch.column(0)).astype(np.int64)
            for low, high in row_runs(batch.column(1)):
                buf, rows, *_ = ppm.plain_rows(*text_buffer(batch.column(1).slice(low, high - low)))
                gram = ppm.grams(buf, rows, ORDER).astype(np.int64)
                gram |= np.repeat(langs[low:high], np.diff(rows)) << 32
                key, n = np.unique(gram, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["gram", "n"])

    cells = chosen.mapInArrow(lean(count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow().sort_by("gram")
    gram, n = np.asarray(cells.column("gram").combine_chunks()), np.asarray(cells.column("n").combine_chunks())
    cuts = np.searchsorted(gram >> 32, np.arange(len(languages) + 1))
    parts = [((gram[a:b] & 0xFFFFFFFF).astype(np.uint32), n[a:b]) for a, b in itertools.pairwise(cuts)]
    return model | {"grams": parts}


class Prices:
    """Code lengths of grams under each language: a table of all grams that any language has seen; those that none has are priced when they are met."""

    def __init__(self, model: dict):
        self.tries = [ppm.Trie(ppm.levels_of(gram, n, ORDER)) for gram, n in model["grams"]]
        seen = np.unique(np.concatenate([g for g, _ in model["grams"]]))
        self.places, self.table = ppm.Places(seen), self.priced(seen)

    def priced(self, gram: np.ndarray) -> np.ndarray:
        return np.stack([t.lengths(gram).astype(np.float32) for t in self.tries], axis=1)

    def __call__(self, gram: np.ndarray) -> np.ndarray:
        place = self.places(gram)
        out = self.table[place]
        if len(miss := np.flatnonzero(place < 0)):
            new, which = np.unique(gram[miss], return_inverse=True)
            out[miss] = self.priced(new)[which]
        return out


def lengths(model: dict, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code length in nats of each row under each language, by tables built once in each worker process."""
    plain, rows, *_ = ppm.plain_rows(buf, offsets)
    prices = kept(model["id"], lambda: Prices(model))
    out = np.zeros((len(rows) - 1, len(model["languages"])))
    gram = ppm.grams(plain, rows, ORDER)
    step = max(1, _RUN // len(model["languages"]))
    for low in range(0, len(gram), step):  # one long row may span many runs
        high = min(low + step, len(gram))
        a, b = np.searchsorted(rows, low, "right") - 1, np.searchsorted(rows, high, "left")
        out[a:b] += ppm.row_sums(prices(gram[low:high]), np.clip(rows[a : b + 1], low, high) - low)
    return out


def identify(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """doc_id, lang_pred and score of every row, and the columns `keep` as they are.

    lang_pred is the language that codes the whole text shortest (ties: the first by name), score its share of 2^-length over all languages. A null
    text, one with no letter, and a model without languages give `und` and 0. Texts go whole, in runs of a bounded size. Null ids stay, repeated rows are repeated, an empty
    table gives no rows. Columns besides the two and `keep` are not read, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = np.array([*model["languages"], UNKNOWN], object)
    kept = [docs.schema[c] for c in keep]
    rows = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).cast("long").alias("_id"), *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(0)
            for low, high in row_runs(texts):
                buf, offsets = text_buffer(texts.slice(low, high - low))
                best, score = np.full(high - low, len(names) - 1), np.zeros(high - low)
                if m["languages"]:
                    lettered = has_letter(buf, offsets)
                    cost = lengths(m, buf, offsets)
                    first = cost.argmin(axis=1)
                    share = 1 / np.exp(cost.min(axis=1, keepdims=True) - cost).sum(axis=1)
                    best, score = np.where(lettered, first, best), np.where(lettered, share, 0)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(low, high - low), pa.array(names[best], pa.string()), pa.array(score), *[c.slice(low, high - low) for c in batch.columns[2:]]], names=["doc_id", "lang_pred", "score", *[f"_keep{i}" for i in range(len(kept))]])

    kinds = ", ".join(["doc_id long", "lang_pred string", "score double", *[f"_keep{i} {f.dataType.simpleString()}" for i, f in enumerate(kept)]])
    out = rows.mapInArrow(lean(run), kinds)
    return out.select("doc_id", "lang_pred", "score", *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)])


def language_id(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", hold_out: int = 3) -> DataFrame:
    """Learn, then identify every row: doc_id, held_out, lang_pred, score. The held-out rows (crc32(id as text) mod hold_out is 1) teach nothing."""
    model = learn(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, hold_out=hold_out)
    out = identify(docs, model, id_col=id_col, text_col=text_col)
    return out.select("doc_id", held_out("doc_id", hold_out).alias("held_out"), "lang_pred", "score")
