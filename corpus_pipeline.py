"""A training-data pipeline over ``documents``; each stage is one of the operators.

Each stage takes (spark, docs, sf_dir) and handles all rows that the stage before kept. All but the last return the columns
of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import langid, neardup, packing, quality, repeats
from attesta.llm.common import materialise, table
from attesta.llm.queries import TOKENIZER
from attesta.session import ship


#: Columns that the classifying operators append; columns of the input by these names step aside meanwhile.
_APPENDED = ("held_out", "lang_pred", "score", "predicted")


def _filtered(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], keep: str) -> DataFrame:
    """The rows of ``docs`` that ``keep`` holds for after ``judge``, with their own columns."""
    aside = {c: f"__own_{c}" for c in docs.columns if c in _APPENDED}
    told = judge(docs.withColumnsRenamed(aside)).where(keep)
    return told.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can't be told go."""
    ship(spark)
    return _filtered(docs, langid.predict, f"lang_pred <> '{langid.UNDETERMINED}'")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted to be of low quality go."""
    labels = table(spark, sf_dir, "labels")
    return _filtered(docs, lambda rows: quality.score(rows, labels), "predicted = 1")


#: A link of the stage, in percent. By the operator's 24 bands of 4, sets at a similarity of 0.8 share no band with probability 3.2e-6.
NEAR_PERCENT = 80


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, from a similarity of 0.8, stays."""
    ship(spark)
    return neardup.deduplicated(docs, percent=NEAR_PERCENT)


#: Words of a repeated passage that is cut out: over 50.
PASSAGE_WORDS = 51


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that stand elsewhere too are cut out of the texts; n_chars follows."""
    ship(spark)
    return repeats.without_repeats(docs, count_col="n_chars", words=PASSAGE_WORDS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences."""
    ship(spark)
    return packing.pack(docs, TOKENIZER)


STAGES = [("language_id", language_id), ("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packing", pack)]

#: Language models, dictionaries and retrieval can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
