"""Trades and prices derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posmv.sources.readers import read_table

#: The order in which the first of several trades with one id is told; no two rows tie on it.
FIRST = ("event_time", "l_partkey", "l_suppkey", "l_extendedprice", "qty", "account", "ticker")


def millis(column: str) -> Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trade_id, account, ticker, qty, event_time and the columns of FIRST; ids repeat."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_shipdate")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.concat(F.lit("T-"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber")).alias("trade_id"),
        F.concat(F.lit("ACC-"), F.lpad((F.col("o_custkey") % 50 + 1).cast("string"), 3, "0")).alias("account"),
        F.concat(F.lit("SYM"), F.lpad((F.col("l_partkey") % 120).cast("string"), 4, "0")).alias("ticker"),
        (F.when(F.col("l_returnflag") == "R", -1).otherwise(1) * F.col("l_quantity")).cast("bigint").alias("qty"),
        millis("l_shipdate").alias("event_time"),
        "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice",
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, price, event_time, seq (the source's order)."""
    return read_table(spark, sf_dir, "events").select(
        F.concat(F.lit("SYM"), F.lpad((F.col("user_id") % 100).cast("string"), 4, "0")).alias("symbol"),
        F.col("value").cast("decimal(18,2)").alias("price"),
        millis("ts").alias("event_time"),
        F.col("event_id").alias("seq"),
    )


def raw_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value: JSON with known faults, by l_orderkey: 97 no JSON, 101 no account, 103 no qty."""
    k = F.col("l_orderkey")
    body = F.to_json(F.struct(
        "trade_id", F.when(k % 101 != 0, F.col("account")).alias("account"), "ticker",
        F.when(k % 103 != 0, F.col("qty")).alias("qty"), "event_time", F.lit("x").alias("desk"),
    ))
    return trades(spark, sf_dir).select(F.when(k % 97 == 0, F.lit("{not json")).otherwise(body).alias("value"))


def raw_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value, seq: JSON with known faults, by event id: 97 no JSON, 89 three decimals, 83 no number."""
    k = F.col("seq")
    text = F.when(k % 89 == 0, F.concat(F.col("price").cast("string"), F.lit("5"))).when(k % 83 == 0, F.lit("abc")).otherwise(F.col("price").cast("string"))
    body = F.to_json(F.struct("symbol", text.alias("price"), "event_time"))
    return prices(spark, sf_dir).select(F.when(k % 97 == 0, F.lit("{not json")).otherwise(body).alias("value"), "seq")
