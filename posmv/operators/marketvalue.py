"""Positions joined with the newest prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posmv.functions import scalars as S


def market_values(positions: DataFrame, latest: DataFrame) -> DataFrame:
    """positions with price, mv and the later of both times as as_of; keys without a price have no row."""
    priced = positions.join(latest.select(F.col("symbol").alias("ticker"), "price", "event_time"), "ticker")
    by = ["account", "ticker"] if "account" in positions.columns else ["ticker"]
    return priced.select(*by, "net_qty", "price", S.market_value().alias("mv"), F.greatest("as_of", "event_time").alias("as_of"))


def changed_only(positions: DataFrame, latest: DataFrame, tickers: DataFrame) -> DataFrame:
    """Market values of the tickers that a batch has changed."""
    return market_values(positions.join(tickers.select("ticker").distinct(), "ticker", "left_semi"), latest)


def revalue_on_ticks(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Each price tick times each holder: what is emitted without conflation."""
    ticks = prices.select(F.col("symbol").alias("ticker"), "price", "event_time", "seq")
    return positions.join(ticks, "ticker").select("account", "ticker", "seq", "net_qty", "price", S.market_value().alias("mv"), F.greatest("as_of", "event_time").alias("as_of"))


def without_price(positions: DataFrame, latest: DataFrame) -> DataFrame:
    """Positions that have no market value."""
    return positions.join(latest.select(F.col("symbol").alias("ticker")), "ticker", "left_anti")
