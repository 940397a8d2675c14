"""The thin queries of this subpackage, one opN_<name> for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import chat, decontaminate, iblt, jaccard, langid, lm, mix, pii, retention, sql, suffixes, tokenblocks, toxicity, whitening


def crc(modulus: int) -> Column:
    """crc32 of doc_id as text, by a modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc(4) == 2)
    model = langid.fit(rows) if (rows := langid.sample(docs, ~F.col("held_out"))) else None
    return langid.identify(docs, model, ("doc_id", "held_out"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.maximal_conversations(table(spark, sf_dir, "conversations"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc(3) == 1)
    texts, toxic = toxicity.sample(docs, table(spark, sf_dir, "labels"), crc(3) != 1)
    return toxicity.scored(docs, toxicity.fit(texts, toxic), ("doc_id", "held_out"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix.fair_queue(docs, mix.n_words(F.col("text"))).drop("source")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), crc(7) == 2)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(table(spark, sf_dir, "documents")).drop("kept")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents")).drop("masked_text")


def op11_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenblocks.read(tokenblocks.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_cohort_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.retention(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "clients"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": sql.JACCARD, "op4_chat_formatting": sql.CHAT, "op7_source_mixing": sql.MIX, "op9_suffix_dedup": sql.SUFFIXES, "op13_cohort_retention": sql.RETENTION}
