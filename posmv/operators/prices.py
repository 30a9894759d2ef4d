"""Newest prices: by event time, then by the source's order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posmv.functions import scalars as S


def newest(prices: DataFrame, *by, order: tuple[str, ...] = ("event_time", "seq"), carry: tuple[str, ...] = ("price",)) -> DataFrame:
    """The newest row of each group: one aggregate, so that ticks meet before the shuffle."""
    best = F.max(F.struct(*order, *[c for c in carry if c not in order])).alias("best")
    grouped = prices.groupBy(*by).agg(best)
    names = [c for c in grouped.columns if c != "best"]
    return grouped.select(*names, *[F.col(f"best.{c}") for c in dict.fromkeys((*carry, *order))])


def latest(prices: DataFrame, order: tuple[str, ...] = ("event_time", "seq")) -> DataFrame:
    """symbol, price, event_time."""
    return newest(prices, "symbol", order=order).select("symbol", "price", "event_time")


def latest_by_rank(prices: DataFrame) -> DataFrame:
    """The same by row_number."""
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("event_time"), F.desc("seq")))
    return prices.withColumn("rank", rank).filter("rank = 1").select("symbol", "price", "event_time")


def window_start(size_ms: int, column: str = "event_time"):
    return (F.floor(F.col(column) / size_ms) * size_ms).alias("window_start")


def tumble_last(prices: DataFrame, size_ms: int = 250) -> DataFrame:
    """The last tick of each symbol and window: input conflation. Off unless asked for, as it makes values late."""
    return newest(prices, window_start(size_ms), "symbol").withColumn("window_end", F.col("window_start") + size_ms)


def latest_from_windows(conflated: DataFrame) -> DataFrame:
    """The newest of the conflated ticks, by the end of their windows."""
    return newest(conflated, "symbol", order=("window_end", "event_time")).select("symbol", "price", "event_time")


def salted_latest(prices: DataFrame, factor: int = 8) -> DataFrame:
    """The newest of the newest of (symbol, event_time mod factor)."""
    local = newest(prices, "symbol", S.floor_mod("event_time", factor).alias("salt"))
    return latest(local)


def salted_tumble(prices: DataFrame, size_ms: int = 250, factor: int = 8) -> DataFrame:
    """Two ranks: within window, symbol and salt, then within window and symbol."""
    newest_first = [F.desc("event_time"), F.desc("seq")]
    salted = prices.select("*", window_start(size_ms), S.floor_mod("event_time", factor).alias("salt"))
    local = salted.withColumn("rn", F.row_number().over(Window.partitionBy("window_start", "symbol", "salt").orderBy(*newest_first))).filter("rn = 1")
    each = local.withColumn("rn2", F.row_number().over(Window.partitionBy("window_start", "symbol").orderBy(*newest_first))).filter("rn2 = 1")
    return each.select("window_start", "symbol", "price", "event_time")


def lexicographic_latest(prices: DataFrame) -> DataFrame:
    """symbol, price text: the largest of time padded to 20 digits and price, its first 20 characters cut off."""
    coded = F.concat(F.lpad(F.col("event_time").cast("string"), 20, "0"), F.col("price").cast("string"))
    return prices.groupBy("symbol").agg(F.max(coded).alias("coded")).select("symbol", F.expr("substring(coded, 21)").alias("price_text"))


def stats(prices: DataFrame) -> DataFrame:
    """Least and largest price, first and last time, ticks and the mean gap of each symbol."""
    found = prices.groupBy("symbol").agg(F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.min("event_time").alias("first_ts"), F.max("event_time").alias("last_ts"), F.count("*").alias("ticks"))
    return found.withColumn("ms_per_tick", F.when(F.col("ticks") > 1, (F.col("last_ts") - F.col("first_ts")) / (F.col("ticks") - 1)))


def ring(prices: DataFrame, size: int = 40) -> DataFrame:
    """The last `size` ticks of each symbol, 1 the newest."""
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("event_time"), F.desc("seq")))
    return prices.withColumn("age", rank).filter(F.col("age") <= size)


def trailing(prices: DataFrame, lag_ms: int = 2000) -> DataFrame:
    """Ticks within lag_ms of their symbol's newest."""
    newest_ts = prices.groupBy("symbol").agg(F.max("event_time").alias("newest_ts"))
    return prices.join(newest_ts, "symbol").filter(F.col("event_time") >= F.col("newest_ts") - lag_ms).drop("newest_ts")
