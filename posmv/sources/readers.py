"""Batch and streaming readers. Files are the transport that needs nothing else; the message broker's reader is
there where its package is."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A dump of JSON lines; lines that are no JSON are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Lines as they are: value."""
    return spark.read.text(path)


def stream_raw(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def stream_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def broker_options(servers: str, topic: str, start: str = "earliest", end: str | None = None, group: str | None = None, per_trigger: int | None = None, more: Mapping[str, str] | None = None) -> dict[str, str]:
    """Options of the broker's reader; `more` is passed through with its prefix."""
    found = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": start}
    if end:
        found["endingOffsets"] = end
    if group:
        found["kafka.group.id"] = group
    if per_trigger:
        found["maxOffsetsPerTrigger"] = str(per_trigger)
    return found | {f"kafka.{k}": v for k, v in (more or {}).items()}


def stream_topic(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    """value, timestamp of a topic; needs the broker's package on the class path."""
    return spark.readStream.format("kafka").options(**options).load().selectExpr("cast(key as string) key", "cast(value as string) value", "timestamp")


def drain_topic(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    """All records up to the offsets of now, as a batch."""
    held = {"endingOffsets": "latest", **options}
    return spark.read.format("kafka").options(**held).load().selectExpr("cast(key as string) key", "cast(value as string) value", "partition", "offset", "timestamp")


def with_processing_time(raw: DataFrame) -> DataFrame:
    return raw.withColumn("proc_ts", F.current_timestamp())


def with_event_time(raw: DataFrame, column: str = "timestamp", delay: str = "1 second") -> DataFrame:
    """The record's own time as event time, late by at most `delay`."""
    return raw.withColumn("event_ts", F.col(column)).withWatermark("event_ts", delay)


def bucketed(df: DataFrame, key: str = "key", buckets: int = 48) -> DataFrame:
    return df.repartition(buckets, key)
