"""Positions and market values over streams: the batch operators plus triggers, state and keyed sinks.

A micro-batch emits each changed key once, with its newest value, so the trigger's interval is the cadence; the
input is never thinned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from posmv.config import Config
from posmv.operators import dedup, marketvalue
from posmv.operators.positions import ACCOUNT_TICKER, TICKER, positions
from posmv.operators.prices import newest
from posmv.sources import schemas
from posmv.streaming.sinks import KeyedTable, shared_path

SOURCE = "kind STRING, account STRING, ticker STRING, qty BIGINT, price DECIMAL(18,2), event_time BIGINT, seq BIGINT"
LATEST = "symbol STRING, price DECIMAL(18,2), event_time BIGINT, seq BIGINT"


def tagged(trades: DataFrame, prices: DataFrame) -> DataFrame:
    """Both inputs as one stream; columns as in SOURCE."""
    t = trades.select(F.lit("T").alias("kind"), "account", "ticker", "qty", F.lit(None).cast("decimal(18,2)").alias("price"), "event_time", F.lit(None).cast("bigint").alias("seq"))
    p = prices.select(F.lit("P").alias("kind"), F.lit(None).cast("string").alias("account"), F.col("symbol").alias("ticker"), F.lit(None).cast("bigint").alias("qty"), "price", "event_time", "seq")
    return t.unionByName(p)


def deduped(trades: DataFrame, config: Config) -> DataFrame:
    if not config.bool("dedup.enabled"):
        return trades
    ttl = config.int("dedup.state.ttl.ms")
    return dedup.stream_within(trades, ttl).drop("event_ts") if ttl > 0 else dedup.stream_forever(trades)


class Outputs:
    """The engine's keyed tables below one path."""

    def __init__(self, spark: SparkSession, path: str | None = None, guarantee: str = "exactly-once"):
        self.spark, self.path = spark, path or shared_path(spark, "outputs")
        make = lambda name, schema, keys: KeyedTable(spark, f"{self.path}/{name}", schema, keys, guarantee)
        self.by_account = make("position-by-account-ticker", schemas.POSITION, ACCOUNT_TICKER)
        self.by_ticker = make("position-by-ticker", schemas.TICKER_POSITION, TICKER)
        self.latest = make("latest-price", LATEST, ("symbol",))
        self.mv_account = make("mv-by-account-ticker", schemas.MARKET_VALUE, ACCOUNT_TICKER)
        self.mv_ticker = make("mv-by-ticker", schemas.TICKER_MARKET_VALUE, TICKER)

    def checkpoint(self, name: str) -> str:
        """Stable for a query's name, so that a restart goes on where it stopped."""
        return f"{self.path}/checkpoints/{name}"


def start_positions(trades: DataFrame, table: KeyedTable, by: tuple[str, ...], checkpoint: str, config: Config, trigger: dict | None = None) -> StreamingQuery:
    """trades: a stream. Each trigger updates the positions that changed."""
    held = positions(deduped(trades, config), by)
    writer = held.writeStream.outputMode("update").queryName(f"positions-by-{'-'.join(by)}").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": f"{config.int('position.emit.interval.ms')} milliseconds"})).foreachBatch(table.upsert).start()


def start_market_values(trades: DataFrame, prices: DataFrame, out: Outputs, config: Config, trigger: dict | None = None) -> StreamingQuery:
    """One query, five keyed tables: positions and newest prices are brought forward by what a batch holds, and the
    market values of the tickers it touched are computed once. Each step reads the state before its own batch, so
    a replay gives the same rows."""
    source = tagged(deduped(trades, config), prices)

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            new = batch.filter("kind = 'T'")
            touched = positions(new, ACCOUNT_TICKER)
            before = out.by_account.read(number)
            merged = touched.unionByName(before.join(touched.select(*ACCOUNT_TICKER), list(ACCOUNT_TICKER), "left_semi"))
            out.by_account.upsert(merged.groupBy(*ACCOUNT_TICKER).agg(F.sum("net_qty").alias("net_qty"), F.max("as_of").alias("as_of")), number)

            by_ticker = positions(new, TICKER)
            held = by_ticker.unionByName(out.by_ticker.read(number).join(by_ticker.select("ticker"), "ticker", "left_semi"))
            out.by_ticker.upsert(held.groupBy("ticker").agg(F.sum("net_qty").alias("net_qty"), F.max("as_of").alias("as_of")), number)

            ticks = batch.filter("kind = 'P'").select(F.col("ticker").alias("symbol"), "price", "event_time", "seq")
            known = out.latest.read(number).join(ticks.select("symbol").distinct(), "symbol", "left_semi")
            out.latest.upsert(newest(ticks.unionByName(known), "symbol").select("symbol", "price", "event_time", "seq"), number)

            if not config.bool("positions.only"):
                changed = batch.select("ticker")
                latest = out.latest.read(number + 1)
                if not config.bool("single.output"):
                    out.mv_account.upsert(marketvalue.changed_only(out.by_account.read(number + 1), latest, changed), number)
                out.mv_ticker.upsert(marketvalue.changed_only(out.by_ticker.read(number + 1), latest, changed), number)
        finally:
            batch.unpersist()

    writer = source.writeStream.outputMode("append").queryName("market-values").option("checkpointLocation", out.checkpoint("market-values"))
    return writer.trigger(**(trigger or {"processingTime": f"{config.int('mv.emit.interval.ms')} milliseconds"})).foreachBatch(step).start()


def finish(query: StreamingQuery, seconds: float = 600) -> None:
    """Wait for a query over what is there now; raise if it failed or took too long."""
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"{query.name} did not end within {seconds} s")
    if query.exception():
        raise query.exception()
