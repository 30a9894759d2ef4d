"""The queries that apply each operator to its whole table, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from posmv.llm import audio, bpe, brown_lm, exact_dedup, html_text, langid, mixing, orc_tokens, simhash, substring
from posmv.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; `und` and 0 where the text is null or has no letter."""
    return langid.predict_documents(table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document stored as 8-bit WAV and read back; null and empty texts are 64 bytes 0."""
    return audio.digests(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_tokens, ids_sha256, decoded_sha256 of every document; null and empty texts have no ids."""
    return bpe.digests(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed order of documents; weights are the roots of the sources' sizes."""
    return mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_words, n_removed, kept_sha256 of every document; null and short texts lose nothing."""
    return substring.digests(table(spark, sf_dir, "documents"))


def op6_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """start, n_tokens, ids_crc32 of every document, read from the ORC files; null and empty texts are the end id alone."""
    return orc_tokens.token_offsets(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text and n_chars of every page; empty and 0 where the html is null or has no main text."""
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fingerprint and component_id of every document; null and empty texts have fingerprint zero."""
    return simhash.near_dedup(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keep_id, group_size, kept, text_sha256 of every document; null counts as empty text."""
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score, score, perplexity of every document; null text is the end alone."""
    return brown_lm.score_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_media, op3_bpe, op4_mix_sources, op5_substring_dedup, op6_orc_tokens, op7_html_text, op8_simhash, op9_exact_dedup, op10_brown_lm)}

ORACLE_SQL = {"op4_mix_sources": mixing.ORACLE, "op5_substring_dedup": substring.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE}
