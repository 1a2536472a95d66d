"""Corpus pipeline: the STAGES one after the other over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and reread as the next one's ``docs``.  All but the last
return the columns of ``documents``.

Defined cases: an empty table gives an empty result; null texts are empty texts
and stay (nothing is toxic, copied or secret about them; of size 0, they are
taken as often as their source's rate says); rows with a null id stay and are
never linked; of rows that repeat an id only those whose texts are linked count
as copies; rows with a null source are a source; columns beyond those of
``documents``, whatever their names, pass through all stages but the last,
which returns id and digests.  A document that the mix takes twice comes out as
two equal rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkgram.llm import bpe, mixing, near_dedup, secrets, toxicity
from sparkgram.llm.common import cut, table


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of the documents at hand and drops what the model rejects."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return near_dedup.drop_near_duplicates(docs)


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret found; no document goes."""
    return secrets.redact_documents(docs)


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources reach their target weights."""
    return mixing.mix_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests that prove their decoding."""
    return bpe.token_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxic_documents_go),
    ("near_dedup", one_of_each_group),
    ("secrets", secrets_masked),
    ("mixing", mixed_to_weights),
    ("byte_bpe", encoded),
]

#: SQL can express neither the automata nor the merges; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
