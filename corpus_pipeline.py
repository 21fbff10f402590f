"""The corpus pipeline: toxic documents go, then exact copies, then near copies; sources are mixed; texts are encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Stages
decide by row: null texts count as empty and are not toxic; of rows that repeat a text one stays; rows with a null or
repeated id are rows like any other; very long texts are read whole; an empty table passes through as one. Columns beyond
those named doc_id and text go through unread, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeplane.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from lodeplane.llm.common import crc_mod, scratch, table, written
from lodeplane.llm.queries import TARGETS, domains, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the lexicon rejects. The lexicon is fitted on labelled rows of the stage's own input."""
    lexicon = toxicity.fit_on(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    return toxicity.drop_toxic(docs, lexicon)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for A-Z and a-z), the document with the largest id; documents without an id give way to others."""
    return exact_dedup.drop_exact_duplicates(docs, keep="max", fold_case=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the least id; texts without a word are no class and stay."""
    return near_dedup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, 0 times among them; the classifier is fitted on labelled documents of the stage's own input."""
    return mixing.mixed(docs, domains(spark, sf_dir), TARGETS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, their digest, and the digest of the bytes decoded from them; an empty text has no ids."""
    words = vocabulary()
    encoded = bpe.encode(docs, words)
    return encoded.select("doc_id", "n_tokens", "ids", *(c.alias(n) for n, c in bpe.digest_columns(words).items()))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix), ("byte_bpe", encode)]

#: The toxicity stage learns a lexicon and the encoding stage merges by ranks: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another over written tables, of which only the last stage's input is left.

    The last stage runs outside of the scratch, as its result still reads the tables that it keeps.
    """
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as here:
        for name, stage in STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir), name)
        here.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
