"""The four outputs as Spark SQL over views of raw JSON text: raw_trades(value), raw_prices(value, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TRADES = """
trades AS (
  SELECT trade_id, account, ticker, coalesce(try_cast(qty AS BIGINT), 0) AS qty, coalesce(try_cast(event_time AS BIGINT), 0) AS event_time
  FROM raw_trades LATERAL VIEW json_tuple(value, 'trade_id', 'account', 'ticker', 'qty', 'event_time') t AS trade_id, account, ticker, qty, event_time),
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_id ORDER BY event_time, qty, account, ticker) AS rn FROM trades
                 WHERE trade_id IS NOT NULL AND account IS NOT NULL AND ticker IS NOT NULL) WHERE rn = 1)"""
POSITIONS = {
    "account": "positions AS (SELECT account, ticker, sum(qty) AS net_qty, max(event_time) AS as_of FROM firsts GROUP BY account, ticker)",
    "ticker": "positions AS (SELECT ticker, sum(qty) AS net_qty, max(event_time) AS as_of FROM firsts GROUP BY ticker)",
}
LATEST = """
ticks AS (
  SELECT symbol, try_cast(price AS DECIMAL(38,18)) AS number, try_cast(event_time AS BIGINT) AS event_time, seq
  FROM raw_prices LATERAL VIEW json_tuple(value, 'symbol', 'price', 'event_time') t AS symbol, price, event_time),
latest AS (
  SELECT symbol, max_by(struct(CAST(number AS DECIMAL(18,2)) AS price, event_time), struct(event_time, seq)) AS last
  FROM ticks WHERE symbol IS NOT NULL AND number = CAST(number AS DECIMAL(18,2)) GROUP BY symbol)"""


def position_sql(by: str) -> str:
    return f"WITH {TRADES}, {POSITIONS[by]} SELECT * FROM positions"


def market_value_sql(by: str) -> str:
    keys = "p.account, p.ticker" if by == "account" else "p.ticker"
    return f"""WITH {TRADES}, {POSITIONS[by]}, {LATEST}
SELECT {keys}, p.net_qty, last.price, CAST(CAST(p.net_qty AS DECIMAL(20,0)) * last.price AS DECIMAL(38,2)) AS mv,
       greatest(p.as_of, last.event_time) AS as_of
FROM positions p JOIN latest ON p.ticker = latest.symbol"""


def outputs(spark: SparkSession, raw_trades: DataFrame, raw_prices: DataFrame) -> dict[str, DataFrame]:
    raw_trades.createOrReplaceTempView("raw_trades")
    raw_prices.createOrReplaceTempView("raw_prices")
    return {
        "position-by-account-ticker": spark.sql(position_sql("account")), "position-by-ticker": spark.sql(position_sql("ticker")),
        "mv-by-account-ticker": spark.sql(market_value_sql("account")), "mv-by-ticker": spark.sql(market_value_sql("ticker")),
    }
