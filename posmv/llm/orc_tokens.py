"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt out by ranges of doc_id and sorted before they are tokenized, so the files and their rows
ascend in doc_id and the shuffle carries text, not ids. Each file's stripes can be read in parallel; a read
for some ids skips stripes and row groups by the footer's ranges and the Bloom filters.
"""

from __future__ import annotations

import functools
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posmv.llm.chunks import ChunkEncoder, encode_batches
from posmv.llm.common import delete_at_end, materialize, scratch

#: The id after each document.
END = 0


class Library:
    """The tokenizers library over distinct chunks; tokens that the file adds to its vocabulary are chunks."""

    def __init__(self, path: str):
        # Spark has a worker for each core; the library's threads beside them would double its CPU seconds
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks = ChunkEncoder(self.encode_many, apart=added)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        return [array("i", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@functools.cache
def load(path: str) -> Library:
    return Library(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", stripe_mb: int = 16, rows_in_index: int = 1000) -> None:
    """Write doc_id and ids (END appended) of every whole text as ORC files under path, ascending in doc_id.

    Null text is empty: END alone. Rows that repeat a doc_id follow each other; null ids come first. An empty
    table gives files without rows. Other columns are not read, whatever their names.
    """
    file = tokenizer or default_tokenizer()
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    tokens = rows.mapInArrow(lambda batches: encode_batches(batches, load(file).chunks, END), f"doc_id {kind}, ids array<int>")
    (
        tokens.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", rows_in_index).option("orc.stripe.size", stripe_mb << 20).option("orc.compress", "ZSTD").orc(path)
    )


def read_tokens(spark: SparkSession, path: str, ids: list | None = None) -> DataFrame:
    """doc_id and ids; with `ids`, those documents alone, the rest pruned by footers, row indexes and filters."""
    read = spark.read.orc(path)
    return read if ids is None else read.filter(F.col("doc_id").isin(ids))


def measure(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all rows before), n_tokens, ids_crc32.

    Each file's rows are summed within it; the files' totals, one row a file, give where it starts.
    """
    kind = read_tokens(spark, path).schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("row"), batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())], ["file", "row", "doc_id", "n_tokens", "ids_crc32"])

    read = read_tokens(spark, path).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("row"), "doc_id", "ids")
    rows = materialize(read.mapInArrow(run, f"file string, row long, doc_id {kind}, n_tokens long, ids_crc32 long"), "tokens-measured")
    held = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    # One row a file; files of one range follow each other by their first and last id.
    starts = held.select("file", (F.sum("n").over(Window.orderBy(F.col("first").asc_nulls_first(), F.col("last").asc_nulls_first(), "file")) - F.col("n")).alias("base"))
    within = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("doc_id", "row")) - F.col("n_tokens")
    inside = rows.withColumn("inside", within)
    return inside.join(starts, "file").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_offsets(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the documents' ids to the shared folder, read the files back and measure them."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens-orc")
    write_tokens(docs, path, tokenizer)
    delete_at_end(spark, path)
    return measure(spark, path)
