"""Registered queries of this subpackage: thin layers over the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.llm import ann, conversations, divergence, langid, latticelm, lines, media, mixing, packing, quality, simhash, tokens, vectordup
from skirmish.llm.common import crc_mod, table
from skirmish.llm.sql import ORACLE


def _part(n: int, held: int) -> F.Column:
    """If a document is held out, by its id; one without an id isn't, and is learned from."""
    return F.coalesce(crc_mod("doc_id", n) == held, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = _part(5, 0)
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs, model).withColumn("held_out", held_out)


def op2_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latticelm.score_documents(table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) == 1)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(crc_mod("doc_id", 3) != 1))
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", _part(3, 1).alias("held_out"), "score", "predicted")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    # The digest is of the text that came through the shuffle.
    return mixed.select("doc_id", "source", "lang", "n_chars", "copy", "shuffle_key", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search_table(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_section_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.section_token_counts(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.dedup_lines(table(spark, sf_dir, "documents")))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.media_columns(table(spark, sf_dir, "documents")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")), F.col("present"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordup.near_duplicates(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
