"""Net positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posmv.functions import scalars as S

ACCOUNT_TICKER, TICKER = ("account", "ticker"), ("ticker",)


def positions(trades: DataFrame, by: tuple[str, ...] = ACCOUNT_TICKER) -> DataFrame:
    """net_qty and as_of (the newest event time) of each key."""
    return trades.groupBy(*by).agg(F.sum("qty").alias("net_qty"), F.max("event_time").alias("as_of"))


def positions_concat_key(trades: DataFrame, sentinel: str | None = None) -> DataFrame:
    """The same grouped on account|ticker; account and ticker are constant within a group."""
    keyed = trades.withColumn("key", S.composite_key(sentinel=sentinel))
    return keyed.groupBy("key").agg(F.max("account").alias("account"), F.max("ticker").alias("ticker"), F.sum("qty").alias("net_qty"), F.max("event_time").alias("as_of"))


def snapshots(trades: DataFrame, by: tuple[str, ...] = ACCOUNT_TICKER, order: tuple[str, ...] = ("event_time", "trade_id")) -> DataFrame:
    """The position after each trade."""
    so_far = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return trades.select(*by, "trade_id", F.sum("qty").over(so_far).alias("net_qty"), F.max("event_time").over(so_far).alias("as_of"))


def roll_up(by_account: DataFrame) -> DataFrame:
    """Positions by ticker from those by account and ticker."""
    return by_account.groupBy("ticker").agg(F.sum("net_qty").alias("net_qty"), F.max("as_of").alias("as_of"))


def cumulate(trades: DataFrame, step_ms: int, size_ms: int, by: tuple[str, ...] = TICKER) -> DataFrame:
    """Growing windows: for every step from a key's first event in a window of size_ms to its end, the sum so
    far. Steps are summed before they are spread over the windows that hold them."""
    step_end = (F.floor(F.col("event_time") / step_ms) + 1) * step_ms
    start = F.floor(F.col("event_time") / size_ms) * size_ms
    per = trades.groupBy(*by, start.alias("window_start"), step_end.alias("first_end")).agg(F.sum("qty").alias("qty"), F.max("event_time").alias("event_time"))
    ends = F.sequence(F.col("first_end"), F.col("window_start") + size_ms, F.lit(step_ms).cast("bigint"))
    return per.withColumn("window_end", F.explode(ends)).groupBy(*by, "window_start", "window_end").agg(F.sum("qty").alias("net_qty"), F.max("event_time").alias("as_of"))
