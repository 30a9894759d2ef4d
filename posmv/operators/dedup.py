"""First-wins dedup of trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_wins(trades: DataFrame, order: tuple[str, ...] | list[str], key: str = "trade_id") -> DataFrame:
    """Of the rows of each key the first by `order`; the rank limit runs before the shuffle as well."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return trades.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def accounting(trades: DataFrame, key: str = "trade_id") -> DataFrame:
    """total, distinct_ids, duplicates: counted by key first, so no distinct set is gathered."""
    per = trades.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(key).alias("distinct_ids")).withColumn("duplicates", F.col("total") - F.col("distinct_ids"))


def stream_within(trades: DataFrame, ttl_ms: int = 3_600_000, key: str = "trade_id") -> DataFrame:
    """On a stream: ids are remembered for ttl_ms of event time after the newest event."""
    timed = trades.withColumn("event_ts", F.timestamp_millis("event_time")).withWatermark("event_ts", f"{ttl_ms} milliseconds")
    return timed.dropDuplicatesWithinWatermark([key])


def stream_forever(trades: DataFrame, key: str = "trade_id") -> DataFrame:
    return trades.dropDuplicates([key])
