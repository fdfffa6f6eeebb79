"""The corpus pipeline: language, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's docs.
All stages but the last return the columns of docs, and pass on columns they don't read, whatever their names.
Empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import decontam, jaccard, langid, packing
from sluice.llm.util import discard, saved, scratch, small_batches, table
from sluice.shipping import ship

#: A text is rejected if it has no language (no letter) or is less like its best language than chance.
MIN_LIFT = 0.0
#: Near duplicates: word shingles and per cent of Jaccard similarity.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language. The model learns from the rows of docs that are not held out.

    Null and empty texts, and those without a letter, have none and go. A null label is not learned from, and a null key is
    neither held out nor learned from. Repeated rows are judged alike, each for itself, and stay repeated; of
    languages that fit equally the first by name counts. Texts are scored whole, however long.
    """
    small_batches(spark)
    model = langid.train(docs.where(F.coalesce(langid.remainder() != 2, F.lit(False))))
    return langid.known(docs, model, MIN_LIFT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least doc_id, of each group that links of similar texts connect.

    Null, empty and blank texts are like nothing and stay. Rows without a key stay and stand for no group. Rows that repeat
    a key and its text become one. Texts are compared whole, however long.
    """
    small_batches(spark)
    return jaccard.one_of_each(docs, k=SHINGLE_WORDS, percent=SIMILAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item.

    Null and empty texts leak nothing and stay, as do rows without a key; repeated rows are judged alike. Null and empty
    items are leaked by nothing. Texts are searched whole, however long.
    """
    small_batches(spark)
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left and their places in sequences.

    Null and empty texts are one piece, the end id alone. Repeated rows and null keys are documents of their own. Of
    pieces that take equal room any may take a place. Long texts are cut into pieces, whole.
    """
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is deleted when the next one has been written; the last one's lie in the scratch folder until the application ends."""
    ship(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        at = scratch(spark, name)
        docs = saved(stage(spark, docs, sf_dir), at=at)
        if before:
            discard(spark, before)
        before = at
    out = STAGES[-1][1](spark, docs, sf_dir)
    discard(spark, before)  # the pieces are a table of their own
    return out


#: No SQL: naive Bayes over hashed n-grams, template leaks and cutting-stock plans are tested against brute force.
ORACLE_SQL = None
