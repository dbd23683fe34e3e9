"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftkite.llm.common import documents, stage
from siftkite.llm.decontam import drop_leaks
from siftkite.llm.langid import UNKNOWN, identify, learn
from siftkite.llm.packing import pack_documents
from siftkite.llm.pii import mask_pii
from siftkite.llm.simhash import drop_copies

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; those without a text or a letter go. Learns from the labels of the documents at hand.

    Null ids stay, repeated rows are repeated, an empty table gives none; without any label every document goes. Texts go whole; columns besides COLUMNS are dropped.
    """
    known = identify(docs, learn(docs, hold_out=None), keep=COLUMNS[1:])
    return known.filter(F.col("lang_pred") != UNKNOWN).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (four fifths of their five-word shingles alike) the document with the smallest id.

    Documents without an id stay; ids are taken as keys; of equal texts the smallest id stays. Null and wordless texts are alike. Texts go whole. An empty table gives none.
    """
    return drop_copies(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs.

    Null and empty texts hold none and stay, as do null ids; repeated rows stay or go together. Texts go whole. An empty benchmark drops nothing, an empty table gives none.
    """
    return drop_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts masked and n_chars counted again.

    A null text stays null, its n_chars too; null ids and repeated rows stay. Texts go whole. An empty table gives none.
    """
    return mask_pii(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each a sequence, as `pack_documents` cuts them: null texts are empty, null ids and repeated rows stay. An empty table gives none."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("personal_data", personal_data), ("packing", packing)]

#: SQL can express neither the models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name, replaces=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
