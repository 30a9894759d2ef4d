"""Streaming queries run over staged files until all of them are read, and their final state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posmv.config import Config
from posmv.operators import dedup
from posmv.sources import fixtures
from posmv.sources.readers import stream_files
from posmv.streaming import jobs, stateful
from posmv.streaming.jobs import Outputs, finish
from posmv.streaming.sinks import KeyedTable, shared_path
from posmv.sources import schemas

NOW = {"availableNow": True}


def session(spark: SparkSession) -> SparkSession:
    """A session of its own, so that its settings touch no other query."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", Config().int("state.partitions"))
    own.conf.set("spark.sql.session.timeZone", "UTC")
    return own


def staged_trades(spark: SparkSession, d: str) -> DataFrame:
    """A stream of trades in the order of their time, every tenth sent again verbatim. First-wins is decided by the order
    of arrival there: the rows that repeat an id with other values arrive after all others."""
    columns = ["trade_id", "account", "ticker", "qty", "event_time"]
    all_ = fixtures.trades(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("trade_id").orderBy(*fixtures.FIRST)))
    first = all_.filter("rank = 1").select(columns)
    copies = F.when(F.pmod(F.xxhash64("trade_id"), F.lit(10)) == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    path = shared_path(spark, "staged-trades")
    sent = first.withColumn("copy", F.explode(copies)).drop("copy")
    sent.repartitionByRange(3, "event_time").write.parquet(path)
    # files are read by their time of change: these come later
    all_.filter("rank > 1").select(columns).repartitionByRange(2, "event_time").write.mode("append").parquet(path)
    return stream_files(spark, path, sent.schema, files_per_trigger=1)


def staged_prices(spark: SparkSession, d: str, files: int = 3) -> DataFrame:
    path = shared_path(spark, "staged-prices")
    ticks = fixtures.prices(spark, d)
    # files are read in the order of their names, which is not that of time: ticks come out of order
    ticks.repartition(files, "seq").write.parquet(path)
    return stream_files(spark, path, ticks.schema, files_per_trigger=1)


#: Staged trades reach over years; ids are kept throughout.
KEEP = Config({"dedup.state.ttl.ms": "0"})


def positions_final(spark: SparkSession, d: str, by: tuple[str, ...]) -> DataFrame:
    own = session(spark)
    out = Outputs(own)
    table = out.by_account if len(by) == 2 else out.by_ticker
    finish(jobs.start_positions(staged_trades(own, d), table, by, out.checkpoint("positions"), KEEP, NOW))
    return table.read()


def dedup_final(spark: SparkSession, d: str) -> DataFrame:
    own = session(spark)
    path = shared_path(own, "deduped")
    query = jobs.deduped(staged_trades(own, d), KEEP).writeStream.format("parquet").option("checkpointLocation", path + "-checkpoint").trigger(**NOW).start(path)
    finish(query)
    return own.read.schema(schemas.TRADE).parquet(path)


def mv_final(spark: SparkSession, d: str) -> Outputs:
    own = session(spark)
    out = Outputs(own)
    finish(jobs.start_market_values(staged_trades(own, d), staged_prices(own, d), out, KEEP, NOW))
    return out


def stateful_mv_final(spark: SparkSession, d: str) -> DataFrame:
    """The market values by a state machine for each ticker, all of them in one query."""
    own = session(spark)
    stateful.use_rocksdb(own)
    source = jobs.tagged(dedup.stream_forever(staged_trades(own, d)), staged_prices(own, d))
    path = shared_path(own, "stateful-mv")
    table = KeyedTable(own, path, schemas.MARKET_VALUE, ("account", "ticker"))

    # only the last state is asked for: a batch emits each holder once
    values = stateful.market_values(source, each=False)
    finish(values.writeStream.outputMode("update").queryName("stateful-market-values").option("checkpointLocation", path + "-checkpoint").trigger(**NOW).foreachBatch(table.upsert).start())
    return table.read()


def tumble_closed(spark: SparkSession, d: str, size_ms: int) -> DataFrame:
    """The last tick of each closed window of event time, with a second of lateness allowed."""
    own = session(spark)
    path = shared_path(own, "staged-ordered")
    ticks = fixtures.prices(own, d)
    ticks.coalesce(1).sortWithinPartitions("event_time").write.parquet(path)
    fed = stream_files(own, path, ticks.schema).withColumn("event_ts", F.timestamp_millis("event_time")).withWatermark("event_ts", "1 second")
    best = F.max(F.struct("event_time", "seq", "price")).alias("best")
    closed = fed.groupBy(F.window("event_ts", f"{size_ms} milliseconds"), "symbol").agg(best).select(F.unix_millis("window.start").alias("window_start"), "symbol", "best.price", "best.event_time")
    out = shared_path(own, "tumbled")
    finish(closed.writeStream.format("parquet").outputMode("append").option("checkpointLocation", out + "-checkpoint").trigger(**NOW).start(out))
    return own.read.schema(closed.schema).parquet(out)


