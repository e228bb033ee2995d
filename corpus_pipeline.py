"""The corpus pipeline: language identification, exact and near deduplication, mixing, packing.

Each stage takes a table with the columns of documents and, but for the last, returns one; extra columns pass through. Null ids and
sources are values of their own, a null text is empty. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import dedup, langid, mixing, nearcopies, packing
from orrery.llm.common import documents, staged
from orrery.llm.queries import tokenizer_path

#: A document stays if its language is found with at least this probability.
LEAST_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without an identifiable language, null and empty texts among them; fills a missing lang with the one found.
    Repeated rows are judged alike and all stay."""
    found = langid.identify(docs).where((F.col("_lang_pred") != langid.UND) & (F.col("_lang_score") >= LEAST_LANGUAGE_SCORE))
    return found.withColumn("lang", F.coalesce("lang", "_lang_pred")).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null equals empty) the document with the largest doc_id stays, one without an id only if all are; of rows that
    repeat id and text one stays."""
    return dedup.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays; of several with that id (or of a group without
    ids) the one whose text has the smallest hash. Documents are known by id and text, as an id may carry several texts. Near are
    texts whose SimHash fingerprints differ in at most 3 bits, and texts with a five-word similarity of 0.8 or more."""
    return nearcopies.keep(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, or the parts of them, that the mix takes, once for each time; documents without words are not taken. Words of one
    source are in order of doc_id, nulls last, ties by a hash of the text; rows that repeat id, source and text are mixed as one."""
    return mixing.mix_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their window and offset, one at least for each row: empty texts give their end alone, repeated rows are
    packed each. Pieces of equal length are taken in order of their hash."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack_windows", pack_windows)]

ORACLE_SQL = None  # language identification, SimHash and tokenization can't be expressed in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
