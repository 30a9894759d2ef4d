"""A corpus pipeline of five stages over documents. Each stage reads what the one before wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posmv.llm import bpe, exact_dedup, langid, mixing, near_copies
from posmv.llm.common import materialize, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language that the labelled documents teach, go."""
    return langid.keep_known_languages(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose five-word shingles are alike by 0.8 or more the document with the smallest id stays."""
    return near_copies.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order that interleaves the sources by their target weights."""
    return mixing.in_mixed_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, whether their decoding gives the text back, and the row's slot and place in the mixed order, in that
    order. Files are not read in the order in which they were written, so the places are worked out from the rows here."""
    mixed = mixing.mix_sources(docs.select("doc_id", "text", "source")).repartitionByRange("slot", "place").sortWithinPartitions("slot", "place")
    marked = mixed.select(F.struct("doc_id", "slot", "place").alias("doc_id"), "text")
    return bpe.bpe_round_trip(marked).selectExpr("doc_id.doc_id", "ids", "cast(size(ids) as bigint) AS n_tokens", "sha2(decoded, 256) AS decoded_sha256", "doc_id.slot", "doc_id.place")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("near_dedup", drop_near),
    ("mixing", mix),
    ("bpe", encode),
]

#: Learned filters, XXH64 and the merges have no SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
