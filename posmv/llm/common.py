"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts write it; the same set that bytes.split() uses.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the driver and all executors share.

    The cluster names that folder in spark.checkpoint.dir. Where it is unset and Spark runs on one machine (tests), a
    temporary folder of this process takes its place; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/posmv/{name}-{uuid.uuid4().hex}"


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="posmv-")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: it cuts the lineage, and lost executors
    cost no recomputation of what is below."""
    return stored(df, name)[0]


def stored(df: DataFrame, name: str, *by: str) -> tuple[DataFrame, str]:
    """materialize, and the path of the table, for discard; in folders by the columns `by`."""
    path = scratch(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    delete_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete a path that is there when the application ends; results may be read from it until then."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that are no longer read, and let Spark drop the shuffle files that nothing refers to any more: its cleaner
    waits for the driver's garbage collector."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    gc.collect()
    spark._jvm.System.gc()


def id_text_crc(doc_id: str) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], text: str, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about so many bytes of text each, one row at least; views, not copies."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > chars:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if len(sizes) > start:
            yield batch.slice(start)
