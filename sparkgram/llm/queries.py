"""The thin queries over the operators of this package, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkgram.llm import audio, bpe, chat, fingerprints, html_text, mixing, near_dedup, oracles, secrets, token_files, toxicity
from sparkgram.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"), html_text.production_model())


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.token_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.media_digests(table(spark, sf_dir, "documents"))


#: A conversation whose texts hold the template's own control strings.
CONTROL_CONVERSATION = ((-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(CONTROL_CONVERSATION, conversations.schema)
    return chat.conversation_digests(conversations.unionByName(extra))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    shards = token_files.tokenize_to_files(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=0)
    return token_files.read_documents(shards)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents")).drop("findings", "groups")


def queries() -> dict[str, Query]:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_mixing": op2_mixing,
        "op3_media_columns": op3_media_columns,
        "op4_chat_formatting": op4_chat_formatting,
        "op5_token_files": op5_token_files,
        "op6_near_dedup": op6_near_dedup,
        "op7_toxicity": op7_toxicity,
        "op8_secret_scans": op8_secret_scans,
        "op9_html_text": op9_html_text,
        "op10_byte_bpe": op10_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": oracles.MIXING}
